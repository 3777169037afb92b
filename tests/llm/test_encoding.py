import random

from pyspark.sql import functions as F

from quipu.llm import encoding

SCHEMA = "seq bigint, titulo string, texto string, fuente string"
WORDS = "la inflación subió según el índice económico de mañana el año pasado también cayó la producción de azúcar y café en Río Ñuño".split()


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    rows, damaged = [], {}
    swaps = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("cp1252", "mac_roman"), ("cp1252", "cp850"), ("utf-8", "cp437"), ("cp1252", "cp1251")]
    for i in range(n):
        title = " ".join(rng.choice(WORDS) for _ in range(10))
        body = " ".join(rng.choice(WORDS) for _ in range(40)) + " «cita» 18 °C ± 2 y 14 € © 2026"
        bad = title
        if i % 10 == 0 and not title.isascii():
            written, read = swaps[(i // 10) % len(swaps)]
            try:
                bad = title.encode(written).decode(read)
            except UnicodeDecodeError:
                bad = title
            if bad != title:
                damaged[i] = title
        rows.append((i, bad, body, "La Crónica" if i % 3 else "Agencia Río"))
    return rows, damaged


def test_finds_and_restores(spark):
    rows, damaged = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    found = {(r.seq, r.campo) for r in encoding.damaged_fields(df, ["titulo", "texto", "fuente"]).collect()}
    assert found == {(i, "titulo") for i in damaged}
    fixed = {r.seq: r.restored for r in encoding.restored_fields(df, ["titulo", "texto", "fuente"]).collect()}
    assert fixed == damaged


def test_joined_and_local_learning_agree(spark):
    df = spark.createDataFrame(corpus()[0], SCHEMA)
    counts = encoding.count_places(df, ["titulo", "texto"]).cache()
    one, two = ({tuple(r) for r in f(counts).select("source", "left", "symbol", "right", "true").collect()} for f in (encoding.learn_counts, encoding.learn_joined))
    assert one == two and one


def test_joined_judging_agrees(spark, monkeypatch):
    df = spark.createDataFrame(corpus()[0], SCHEMA)
    learned = encoding.learn(df, ["titulo"])
    one = {tuple(r) for r in encoding._judged(df, learned, ["titulo"], "fuente", "seq").collect()}
    monkeypatch.setattr(encoding, "BROADCAST_ROWS", 0)
    two = {tuple(r) for r in encoding._judged(df, learned, ["titulo"], "fuente", "seq").collect()}
    assert one == two and one


def test_edge_cases(spark):
    rows = [(1, None, "", None), (2, "café �", "y" * 200_000 + "ó", "A"), (2, "café �", "y", "A")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("source", F.lit("x"))
    assert {(r.seq, r.campo) for r in encoding.damaged_fields(df, ["titulo", "texto", "fuente"]).collect()} == {(2, "titulo")}
    assert encoding.damaged_fields(df.limit(0), ["titulo"]).count() == 0
    assert encoding.restored_fields(df.limit(0), ["titulo"]).count() == 0


def test_readings():
    tables = {c: encoding._tables(c) for c in encoding.READ}
    for written, read in (("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("cp1252", "cp850")):
        assert "ñ" in {t for _, t in encoding.readings("ñ".encode(written).decode(read), tables)}
    twice = "ó".encode().decode("cp1252").encode().decode("cp1252")
    assert "ó" in {t for _, t in encoding.readings(twice, tables)}
