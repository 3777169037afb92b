import pytest
from pyspark.sql import functions as F

from quipu.functions import dates, html, lexicon, numbers, text


def one(spark, expr, *values, schema="v string"):
    return spark.createDataFrame([tuple(values)], schema).select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    "sentence, entities, indicators, risk, relief, stress, level",
    [
        ("La escasez de divisas y la caída de las reservas aumentan la presión económica.", [], ["tipo de cambio", "reservas internacionales"], 17, 0, 67, "alto"),
        ("El BCB informó que las reservas internacionales y el tipo de cambio continúan bajo presión.", ["BCB"], ["tipo de cambio", "reservas internacionales"], 4, 0, 54, "moderado"),
        ("YPFB anunció una mejora en la provisión de diésel y gasolina.", ["YPFB"], ["combustibles"], 0, 4, 46, "moderado"),
        ("La economía creció sin aumentar el déficit fiscal.", [], ["déficit fiscal"], 6, 0, 56, "moderado"),
        ("El SIN anunció nuevas facilidades tributarias.", ["SIN"], [], 0, 0, 50, "moderado"),
        ("El Servicio de Impuestos Nacionales amplió el plazo de pago.", ["SIN"], [], 0, 0, 50, "moderado"),
        ("El BCB informó que la inflación y la escasez de divisas generan presión económica.", ["BCB"], ["inflación", "tipo de cambio"], 17, 0, 67, "alto"),
        ("El tipo de cambio y la falta de dólares afectan la importación de combustibles.", [], ["tipo de cambio", "combustibles", "importaciones"], 4, 0, 54, "moderado"),
        ("", [], [], 0, 0, 50, "moderado"),
    ],
)
def test_lexical_analysis(spark, sentence, entities, indicators, risk, relief, stress, level):
    v = F.col("v")
    r, a = text.weigh(text.term_counts(v, lexicon.RISK), lexicon.RISK), text.weigh(text.term_counts(v, lexicon.RELIEF), lexicon.RELIEF)
    row = spark.createDataFrame([(sentence,)], "v string").select(text.entities(v).alias("e"), text.indicators(v).alias("i"), r.alias("r"), a.alias("a"), text.stress(r, a).alias("s"), text.level(text.stress(r, a)).alias("l")).first()
    assert (row.e, row.i, row.r, row.a, row.s, row.l) == (entities, indicators, risk, relief, stress, level)


def test_nulls_give_empty_results(spark):
    assert one(spark, text.entities(F.col("v")), None) == []
    assert one(spark, text.clean_text(F.col("v")), None) == ""
    assert one(spark, text.tokens(F.col("v")), None) == []
    assert one(spark, text.missing(F.col("v")), " NaN ") is None


def test_prepared_texts(spark):
    assert one(spark, text.classic_text(F.col("v")), "El BCB informó que las reservas no mejoraron y la inflación subió.") == "el bcb que las reservas no mejoraron y la inflación subió"
    assert one(spark, text.topic_text(F.col("v")), "El Banco Central informó que la inflación subió durante el año.") == "banco central inflación subió año"
    assert one(spark, text.clean_text(F.col("v")), "Ver https://x.y/z #Litio a@b.co @yo Bs. 5") == "ver litio bob 5"


def test_addresses(spark):
    v = F.col("v")
    assert one(spark, text.normalize_url(v), "https://x/y/#t") == "https://x/y"
    assert one(spark, text.url_host(v), "HTTPS://User@WWW.X.bo:80/a?b") == "www.x.bo"
    assert one(spark, text.url_host(v), "/a") is None
    for link, want in (("/a", "https://x.bo/a"), ("b", "https://x.bo/p/b"), ("//y.bo/c", "https://y.bo/c"), ("http://z/", "http://z/")):
        assert one(spark, text.absolute_url(F.lit("https://x.bo/p/q"), v), link) == want


def test_decoding_repair(spark):
    broken = "EconomÃ­a".replace("­", "­")
    assert one(spark, text.repair_mojibake(F.col("v")), broken) == "Economía"
    assert one(spark, text.repair_mojibake(F.col("v")), "Economía") == "Economía"
    assert one(spark, text.repair_mojibake(F.col("v")), None) is None
    assert one(spark, text.repair_text(F.col("v")), None) == ""


@pytest.mark.parametrize(
    "value, want",
    [
        ("2026-07-10T18:00:43+00:00", "2026-07-10 14:00:43"), ("2026-07-11T00:43:00+00:00", "2026-07-10 20:43:00"), ("2026-07-01", "2026-06-30 20:00:00"),
        ("10 de julio de 2026", "2026-07-10 00:00:00"), ("10/07/2026", "2026-07-10 00:00:00"), ("julio 10, 2026", "2026-07-10 00:00:00"), ("31/02/2026", None), ("nada", None), (None, None),
    ],
)
def test_spanish_dates(spark, value, want):
    assert one(spark, F.date_format(dates.spanish_date(F.col("v")), "yyyy-MM-dd HH:mm:ss"), value) == want


def test_numbers(spark):
    c = F.col
    row = spark.createDataFrame([(31, 44)], "a int, b int").select(numbers.momentum_label(numbers.momentum_ratio(c("a") - 1, c("b") - 1)).alias("exact"), numbers.momentum_label(numbers.round2(numbers.momentum_ratio(c("a") - 1, c("b") - 1))).alias("rounded"), numbers.momentum(F.lit(17), F.lit(2)).alias("m")).first()
    assert (row.exact, row.rounded, row.m) == ("estable", "en descenso", 1.0)
    assert one(spark, numbers.json_list(c("v")), '[" a ", "", 1]') == ["a", "1"]
    for bad in ("roto", "{}", "", None):
        assert one(spark, numbers.json_list(c("v")), bad) == []
    assert one(spark, numbers.json_list(c("v"), keep_malformed=True), "roto") == ["roto"]
    assert one(spark, numbers.number(c("v"), 0.5, 0, 1), "7") == 1.0
    assert one(spark, numbers.number(c("v"), 0.5), "x") == 0.5


def test_article_from_html(spark):
    page = "<html><head><title>Una página cualquiera</title><style>p{}</style></head><body><nav><p>Menú con muchas palabras que no cuentan aquí</p></nav><article><h1>Un título bastante largo</h1><p>Primer párrafo con más de treinta caracteres.<p>Segundo párrafo, también lo bastante largo.</article><script>'</p>'</script><footer><p>Pie de página con más de treinta letras</p></footer>"
    assert html.parse(page) == ("Un título bastante largo", "Primer párrafo con más de treinta caracteres.\nSegundo párrafo, también lo bastante largo.", "")
    assert html.parse("") == ("", "", "")
    assert one(spark, html.article("v"), None).titulo == ""
