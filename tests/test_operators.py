import itertools
import random

import pytest
from pyspark.sql import functions as F

from quipu.functions import numbers, text
from quipu.operators import annotation, corpus, events, grams, gates, metrics, models, ranking, temporal
from quipu.plans import pipeline, service
from quipu.sources import catalogue

NOW = "2026-07-10 12:00:00+00:00"


def now():
    return F.lit(NOW).cast("timestamp")


NEWS = "seq bigint, titulo string, texto string, fuente string, fecha string, url string, collected_at string, economic_score int, source_weight double, source_type string, department string, scope string, stress_score int, tema string, indicadores array<string>, entidades array<string>, tono_consolidado string"


def item(seq, titulo="Un título de prueba suficiente", texto="x" * 300, fuente="A", fecha=None, url=None, collected=None, score=3, weight=0.5, stress=50, tema=None):
    return (seq, titulo, texto, fuente, fecha, url, collected, score, weight, "unknown", "", None, stress, tema, None, None, None)


def test_temporal_policy(spark):
    rows = [
        item(1, fecha="2026-07-10T22:00:00+00:00", collected="2026-07-10T11:00:00+00:00"), item(2, fecha="2026-07-10T15:00:00Z"), item(3, fecha="2026-07-07T11:59:45Z"),
        item(4, fecha="bad", collected="2026-07-10T11:00:00+00:00"), item(5), item(6, fecha="2026-07-09T12:00:00Z"),
    ]
    got = {r.seq: (r.date_quality, r.temporal_exclusion_reason, r.is_recent, r.age_hours) for r in temporal.temporal_columns(spark.createDataFrame(rows, NEWS), now()).collect()}
    assert got[1] == ("invalid_future", "future_date", False, 1.0)
    assert got[2][1:3] == ("future_effective_date", False)
    assert got[3] == ("published", "outside_operational_window", False, 72.0)
    assert got[4] == ("inferred_collected", "recent", True, 1.0)
    assert got[5] == ("missing", "missing_date", False, None)
    assert got[6] == ("published", "recent", True, 24.0)


def test_event_ranking_golden(spark):
    rows = [(f"e{i}", "a" if i < 27 else "b" if i < 45 else None, f'["s{i % 4 if i < 27 else i % 3}"]', 58.56 if i < 27 else 47.28) for i in range(61)]
    got = {r.name: r.score for r in ranking.rank_events(spark.createDataFrame(rows, "event_id string, t string, sources string, average_stress double"), "t").collect()}
    assert got == {"a": 55.80, "b": 46.08}


def test_document_ranking_counts_missing_as_none(spark):
    rows = [("x", 10.0, "A", 50), ("x", 20.0, None, None), ("x", 100.0, "B", 1), (" nan ", 5.0, "A", 1), (None, 5.0, "A", 1), ("old", 100.0, "A", 1)]
    df = spark.createDataFrame(rows, "t string, age_hours double, fuente string, stress_score int")
    got = ranking.rank_dimension(df, "t").collect()
    assert [(r.name, r["count"], r.previous_count, r.sources, r.average_stress) for r in got] == [("x", 2, 1, 1, 50.0)]
    assert ranking.rank_dimension(df.limit(0), "t").collect() == []
    assert ranking.leader(ranking.rank_dimension(df, "t")).first().eligible is False


def test_merge_prefers_quality_and_keeps_rows_without_address(spark):
    a = spark.createDataFrame([item(1, url="https://x/1", texto="a" * 200), item(2, "Otro título de prueba", url=None), item(3, "Tercer título aquí", url="")], NEWS)
    b = spark.createDataFrame([item(4, "Título mejor que el primero", url="https://x/1/#t", texto="b" * 400), item(5, "corto")], NEWS)
    got = corpus.merge_corpus(a, b, "2026-01-01T00:00:00Z").collect()
    assert sorted(r.seq for r in got) == [2, 3, 4]
    assert all(len(r.id) == 20 for r in got) and {r.collected_at for r in got if r.seq == 4} == {"2026-01-01T00:00:00Z"}


def test_clean_keeps_one_row_without_address(spark):
    body = "La inflación y el dólar suben por la escasez de divisas. " * 8
    rows = [item(i, f"Noticia económica número {i} del día", body) for i in (1, 2)]
    assert [r.seq for r in corpus.clean_corpus(spark.createDataFrame(rows, NEWS)).collect()] == [1]



def test_merge_and_clean_choose_before_texts_move(spark, monkeypatch):
    body = "La inflación y el dólar suben por la escasez de divisas. "
    rows = [item(i, f"Noticia econÃ³mica nÃºmero {i % 17} del dÃ³lar", body * (3 + i % 7), url=(None, f"https://x/{i % 23}", "")[i % 3], score=i % 5) for i in range(120)]
    a, b = spark.createDataFrame(rows[:60], NEWS), spark.createDataFrame(rows[60:], NEWS)
    both = sorted(corpus.clean_corpus(corpus.merge_corpus(a, b, "2026-01-01T00:00:00Z")).collect())
    done = corpus.merge_and_clean(a, b, "2026-01-01T00:00:00Z")
    assert 1 < len(both) < 17 + 1 and sorted(done.select(both[0].__fields__).collect()) == both
    for df in (done, corpus.merge_corpus(a, b, "2026-01-01T00:00:00Z"), corpus.clean_corpus(a)):
        assert "Exchange hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(corpus, "KEPT_ROWS", 1)
    assert sorted(corpus.merge_and_clean(a, b, "2026-01-01T00:00:00Z").select(both[0].__fields__).collect()) == both


def greedy(rows):
    urls, titles, kept = set(), set(), []
    for seq, u, t in sorted(rows):
        if u not in urls and t not in titles:
            urls.add(u)
            titles.add(t)
            kept.append(seq)
    return kept


def test_greedy_deduplication_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(1, "u1", "t1"), (2, "u2", "t1"), (3, "u2", "t3")] + [(i, f"u{rng.randrange(30)}", f"t{rng.randrange(30)}") for i in range(10, 150)]
    got = corpus.greedy_deduplicate(spark.createDataFrame(rows, "seq bigint, url string, titulo string"))
    assert sorted(r.seq for r in got.collect()) == greedy(rows)


def test_backfill(spark):
    meta = spark.createDataFrame([(1, "Diario  A", "newspaper", "La Paz", "national", 0.7)], "fuente_id int, name string, source_type string, department string, scope string, source_weight double")
    rows = spark.createDataFrame([item(1, fuente="diario a "), item(2, fuente="B"), item(3, fuente=None)], NEWS)
    got = {r.seq: (r.source_type, r.source_weight) for r in corpus.backfill_metadata(rows, meta).collect()}
    assert got == {1: ("newspaper", 0.7), 2: ("unknown", 0.5), 3: ("unknown", 0.5)}
    assert [r.fuente for r in corpus.unknown_sources(rows, meta).where("fuente is not null").collect()] == ["B"]


@pytest.mark.parametrize("local", [10**6, 0])
def test_components_against_brute_force(spark, monkeypatch, local):
    monkeypatch.setattr(events, "LOCAL_EDGES", local)
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    root = {}
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    root = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in events.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got.get(n, n) == root[n] for n in nodes)


def cosine_pairs(texts, threshold):
    import math
    import re
    from collections import Counter

    docs = []
    for t in texts:
        w = [x for x in re.findall(r"\w+", t.lower()) if len(x) > 1]
        docs.append(Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]))
    df = Counter(t for d in docs for t in d)
    vec = []
    for d in docs:
        v = {t: (1 + math.log(c)) * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t, c in d.items()}
        n = math.sqrt(sum(x * x for x in v.values())) or 1
        vec.append({t: x / n for t, x in v.items()})
    return {(i, j) for i, j in itertools.combinations(range(len(docs)), 2) if sum(x * vec[j].get(t, 0) for t, x in vec[i].items()) >= threshold}


def test_similar_pairs_against_brute_force(spark):
    rng = random.Random(9)
    words = ["banco", "reservas", "dólar", "gas", "litio", "precio", "alza", "crisis", "diésel", "aduana", "salario", "deuda"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 9))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "seq bigint, t string")
    got = events.similar_pairs(events.tfidf(df, "seq", F.col("t")), 0.48).collect()
    want = cosine_pairs(texts, 0.48)
    assert {(r.a, r.b) for r in got} == want
    at = {i: None if i % 9 == 0 else rng.randrange(20) for i in range(len(texts))}
    times = spark.createDataFrame([(i, None if d is None else 86400 * d) for i, d in at.items()], "key bigint, s bigint").select("key", F.timestamp_seconds("s").alias("at"))
    got = events.similar_pairs(events.tfidf(df, "seq", F.col("t")), 0.48, times).collect()
    assert {(r.a, r.b) for r in got} == {(a, b) for a, b in want if at[a] is None or at[b] is None or abs(at[a] - at[b]) <= 3}


def test_ids_of_large_events_need_no_gathering(spark):
    rows = [(g, f"u{i}", "t", "z") for g in (1, 2) for i in range(30 + g)]
    df = spark.createDataFrame(rows, "g int, url string, titulo string, effective_at string")
    ids = lambda d, most: {r.g: (r.event_id, r.event_size) for r in events.event_ids(d, "g", most).collect()}
    whole, parts = ids(df, 100), ids(df, 31)
    assert whole[1] == parts[1] and whole[2] != parts[2] and parts[2][1] == 32
    assert ids(df.orderBy(F.desc("url")), 31) == parts


def test_greedy_chain_of_many_rows(spark):
    rows = [item(i, f"Título {(i + 1) // 2}", url=f"https://x/{i // 2}") for i in range(150)]
    want, urls, titles = [], set(), set()
    for r in rows:
        u, t = r[5], r[1].lower()
        if u not in urls and t not in titles:
            want.append(r[0])
            urls.add(u)
            titles.add(t)
    df = spark.createDataFrame(rows, NEWS)
    assert sorted(r.seq for r in corpus.greedy_deduplicate(df).collect()) == want
    assert sorted(r.seq for r in corpus.greedy_deduplicate(df, 146).collect()) == want


def test_clustering_and_summary(spark):
    t = "2026-07-10T10:00:00Z"
    rows = [
        item(0, "BCB informa sobre reservas internacionales", "El Banco Central informa que las reservas internacionales subieron", "A", t),
        item(1, "BCB informa reservas internacionales", "El Banco Central informa que las reservas internacionales subieron hoy", "B", t),
        item(2, "Suben los precios del tomate", "En los mercados el tomate cuesta más", None, t), item(3, None, None, "C", None),
    ]
    df = spark.createDataFrame(rows, NEWS).withColumn("effective_at", F.col("fecha"))
    done = events.cluster_news(df, threshold=0.20)
    ids = {r.seq: (r.event_id, r.event_size) for r in done.collect()}
    assert ids[0] == ids[1] and ids[0][1] == 2 and len({v[0] for v in ids.values()}) == 3
    summary = events.summarize_events(done)
    assert summary.agg(F.sum("documents")).first()[0] == 4 and len(summary.columns) == 14
    gate = gates.event_gate(summary, done, df).collect()
    assert {g.check for g in gate if not g.passed} == {"untitled_events", "sourceless_events"}
    assert events.cluster_news(df.limit(0)).count() == 0


def test_quotas_and_split(spark):
    rows = [(i, "A" if i < 50 else "B" if i < 80 else "C") for i in range(101)]
    df = spark.createDataFrame(rows, "seq bigint, fuente string")
    counts = df.groupBy(F.col("fuente").alias("grupo")).agg(F.count("*").alias("n"))
    assert {r.grupo: r.quota for r in annotation.quotas(counts, 10).collect()} == {"A": 5, "B": 3, "C": 2}
    assert annotation.quota_sample(df, "fuente", "seq", 10).count() == 10
    parts = annotation.stratified_split(df, "fuente", "seq").groupBy("split").count().collect()
    assert sum(r["count"] for r in parts) == 101
    with pytest.raises(ValueError):
        annotation.page(df, [F.col("seq")], 201)


def test_naive_bayes_against_brute_force(spark):
    import math

    train = [(1, "sube el dólar", "n"), (2, "sube la crisis", "n"), (3, "mejora el empleo", "p"), (4, "mejora la economía", "p")]
    df = spark.createDataFrame(train, "seq bigint, t string, label string")
    tf = models.terms(df, "seq", F.col("t"))
    vec = models.weights(tf, models.vocabulary(tf, least=1, most_share=1.0))
    theta, prior = models.nb_train(vec, df.select(F.col("seq").alias("key"), "label"))
    rows = vec.collect()
    label = {k: y for k, _, y in train}
    terms = {r.term for r in rows}
    want = {}
    for k, _, _ in train:
        s = {}
        for y in ("n", "p"):
            whole = sum(r.w for r in rows if label[r.key] == y)
            mass = {t: sum(r.w for r in rows if label[r.key] == y and r.term == t) for t in terms}
            s[y] = math.log(0.5) + sum(r.w * math.log((mass[r.term] + 0.5) / (whole + 0.5 * len(terms))) for r in rows if r.key == k)
        best = max(s, key=s.get)
        want[k] = (best, 1 / sum(math.exp(v - s[best]) for v in s.values()))
    got = {r.key: (r.label, r.probability) for r in models.nb_predict(vec, theta, prior).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_metrics_of_nothing(spark):
    df = spark.createDataFrame([], NEWS + ", stress_nivel string, coincidencia_modelos boolean")
    assert metrics.macro_score(df).first().macro_score == 0.0
    assert metrics.optimism_index(df, F.col("texto")).first().documents == 0
    report = metrics.macro_report(spark.createDataFrame([], "a string, b string"), "a", "b", ["x"]).first()
    assert (report.accuracy, report.macro_f1) == (None, 0.0)


def test_topics_read_every_text_in_each_iteration(spark, tmp_path):
    from quipu.plans import queries

    texts = [f"reservas banco divisas {w}" for w in ("dólar", "bonos") for _ in range(15)] + [f"litio salar planta {w}" for w in ("uyuni", "baterías") for _ in range(15)]
    spark.createDataFrame(list(enumerate(texts)), "seq bigint, texto string").write.parquet(f"{tmp_path}/noticias.parquet")
    asked = []

    def fit(df, content, **options):
        asked.append(real(df, content, **options))
        return asked[-1]

    real, models.topic_fit = models.topic_fit, fit
    try:
        assert {r.topic_id for r in queries.lda_topics(spark, str(tmp_path)).collect()} == set(range(6))
    finally:
        models.topic_fit = real
    counts, lda = asked[0].transform(queries.news(spark, str(tmp_path)).select(F.col("texto").alias("content"))), asked[0].stages[-1]
    tokens = sum(float(r.counts.values.sum()) for r in counts.select("counts").collect())
    assert lda.getMaxIter() == 40
    # EM's topic table is made of the expected uses in all texts
    assert abs(lda.topicsMatrix().toArray().sum() - tokens) < 1e-6 * tokens


def test_bayes_over_whole_records_against_brute_force(spark, tmp_path):
    import math
    from collections import Counter

    from quipu.plans import queries

    news = [
        (1, "sube dólar", "crisis bancaria grave", "n"), (2, "nada nuevo", "crisis bancaria sigue", "n"), (3, None, "empleo crece fuerte", "p"),
        (4, "nada nuevo", "empleo crece otra vez", "p"), (5, "sube dólar", None, "n"), (6, None, None, "p"),
    ]
    spark.createDataFrame(news, "seq bigint, titulo string, texto string, tono_consolidado string").write.parquet(f"{tmp_path}/noticias.parquet")
    docs = {}
    for seq, titulo, texto, _ in news:
        said = ". ".join(x for x in (titulo, texto) if x)
        if said:
            r = spark.range(1).select(models.text.classic_text(F.lit(said)).alias("c")).first()
            w = [x for x in r.c.split(" ") if len(x) >= 2]
            docs[seq] = Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    df = Counter(t for d in docs.values() for t in d)
    idf = {t: math.log((1 + len(docs)) / (1 + n)) + 1 for t, n in df.items() if 2 <= n <= 0.95 * len(docs)}
    vec = {}
    for k, d in docs.items():
        v = {t: (1 + math.log(c)) * idf[t] for t, c in d.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vec[k] = {t: x / norm for t, x in v.items()}
    label, want = {seq: y for seq, *_, y in news}, {}
    for y in ("n", "p"):
        mass = Counter()
        for k, v in vec.items():
            if label[k] == y:
                mass.update(v)
        want |= {(y, t): math.log((m + 0.5) / (sum(mass.values()) + 0.5 * len(idf))) for t, m in mass.items()}
    got = {(r.label, r.term): r.theta for r in queries.nb_document_parameters(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 0.00501 for k in want)
    said = {r.seq: r.label for r in queries.nb_document_predictions(spark, str(tmp_path)).collect()}
    assert said == {k: label[k] for k in docs}


def test_merge_repairs_all_string_columns(spark):
    from quipu.plans import pipeline

    bad = lambda x: x.encode().decode("latin-1")
    body = "La inflación y el dólar suben por la escasez de divisas. " * 8
    rows = [item(1, bad("La inflación sube en el país otra vez"), bad(body), bad("Opinión"), url="https://x/1"), item(2, "Dólar: la inflación sigue en alza hoy", body, "Opinión", url="https://x/2")]
    rows[0] = (*rows[0][:-4], bad("Economía"), *rows[0][-3:])
    a, b = (spark.createDataFrame([r], NEWS) for r in rows)
    got = {r.seq: r for r in corpus.merge_corpus(a, b, "2026-01-01T00:00:00Z").collect()}
    assert (got[1].titulo, got[1].texto, got[1].fuente, got[1].tema) == ("La inflación sube en el país otra vez", body.strip(), "Opinión", "Economía")
    done = pipeline.daily(a.drop("entidades", "indicadores", "stress_score"), b.drop("entidades", "indicadores", "stress_score"), "2026-01-01T00:00:00Z", now())
    assert [r.fuente for r in done.clean.select("fuente").distinct().collect()] == ["Opinión"]


def test_repair_queries_cover_all_string_columns(spark, tmp_path):
    from quipu.plans import queries

    bad = "Economía".encode().decode("latin-1")
    spark.createDataFrame([(1, bad, bad, "A", bad), (2, None, bad, None, "B")], "seq bigint, titulo string, texto string, fuente string, tema string").write.parquet(f"{tmp_path}/noticias.parquet")
    got = {r.seq: (r.titulo, r.texto, r.fuente, r.tema) for r in queries.mojibake_repair(spark, str(tmp_path)).collect()}
    assert got == {1: ("Economía", "Economía", "A", "Economía"), 2: (None, "Economía", None, "B")}
    report = {r.column: (r.rows, r.repaired, r.suspicious_after) for r in queries.repair_report(spark, str(tmp_path)).collect()}
    assert report == {"titulo": (2, 1, 0), "texto": (2, 2, 0), "fuente": (2, 0, 0), "tema": (2, 1, 0)}


def test_compatibility_forms(spark):
    rows = [("ﬁnanzas del BCB — 1º año…",), ("El ＢＣＢ informó",), ("áéíóúñ ü «sí» €5",), (None,), ("",)]
    got = [r.v for r in spark.createDataFrame(rows, "t string").select(text.compatible(F.col("t")).alias("v")).collect()]
    assert got == ["finanzas del BCB — 1o año...", "El BCB informó", "áéíóúñ ü «sí» €5", None, ""]
    done = pipeline.lexical_columns(spark.createDataFrame([(None, "El ＢＣＢ informó sobre la inﬂación")], "titulo string, texto string")).first()
    assert done.entidades == ["BCB"] and done.indicadores == ["inflación"]


def test_unknown_sentiment_is_an_error(spark):
    df = spark.createDataFrame([("Positive ",), ("neutral",), (None,)], "s string")
    assert [r.v for r in df.select(numbers.sentiment(F.col("s")).alias("v")).collect()] == ["positivo", "neutral", None]
    with pytest.raises(Exception, match="unknown label"):
        spark.createDataFrame([("otro",)], "s string").select(numbers.sentiment(F.col("s"))).collect()


def test_bayes_survives_storing(spark, tmp_path):
    df = spark.createDataFrame([(i, "sube el precio" if i % 2 else "baja la deuda", "a" if i % 2 else "b") for i in range(12)], "seq bigint, t string, y string")
    tf = models.terms(df, "seq", F.col("t"))
    known = models.vocabulary(tf)
    vectors = models.weights(tf, known)
    theta, prior = models.nb_train(vectors, df.select(F.col("seq").alias("key"), F.col("y").alias("label")))
    models.save_bayes(known, theta, prior, str(tmp_path / "nb"))
    known, theta, prior = models.load_bayes(spark, str(tmp_path / "nb"))
    new = spark.createDataFrame([(1, "el precio sube"), (2, "la deuda baja")], "seq bigint, t string")
    got = models.nb_predict(models.weights(models.terms(new, "seq", F.col("t")), known), theta, prior).collect()
    assert {r.key: r.label for r in got} == {1: "a", 2: "b"}


def test_topic_model_survives_storing(spark, tmp_path):
    df = spark.createDataFrame([(i, "litio salar mina agua" if i % 2 else "banco crédito tasa ahorro") for i in range(20)], "seq bigint, t string")
    fitted = models.topic_fit(df, F.col("t"), k=2, iterations=5, least=1, most_share=0.9)
    models.save_pipeline(fitted, str(tmp_path / "lda"))
    got = {r.key: r.topic_id for r in models.topic_infer(models.load_pipeline(str(tmp_path / "lda")), df, "seq", F.col("t")).collect()}
    assert len({got[i] for i in range(0, 20, 2)}) == len({got[i] for i in range(1, 20, 2)}) == 1
    words = service.topic_keywords(models.topic_words(fitted), {0: "Primero"}, 3).collect()
    assert {r.name for r in words} == {"Primero", "Tema 1"} and all(len(r.keywords) == 3 for r in words)


def test_date_column_is_chosen_for_the_whole_table(spark):
    df = spark.createDataFrame([("x", "2026-01-01", None), (None, None, "2026-01-02")], "published_at string, fecha string, collected_at string")
    assert temporal.date_column(df) == "fecha" and temporal.date_column(df.select("published_at", "collected_at")) == "collected_at"
    assert temporal.date_column(df.limit(0)) is None and temporal.date_column(df.select(F.lit(1).alias("z"))) is None


def test_gates_name_missing_columns_and_wrong_counts(spark):
    ops = spark.createDataFrame([item(1), item(2)], NEWS)
    bare = spark.createDataFrame([("e", 2, 1)], "event_id string, documents int, unique_sources int")
    payload = spark.createDataFrame([(2, 5, 0)], "documents int, events int, multi_source_events int")
    got = {r.check: (r.value, r.passed) for r in gates.event_gate(bare, ops, ops, payload=payload, rankings={"topics": bare}, snapshot=bare.select(F.lit(1).alias("economic_events"))).collect()}
    assert got["missing_event_columns"] == (9.0, False) and got["missing_clustered_columns"] == (2.0, False) and got["missing_rankings"] == (2.0, False)
    assert got["payload_events"] == (4.0, False) and got["payload_documents"] == (0.0, True) and got["snapshot_events"] == (0.0, True)
    report = spark.createDataFrame([(3, 1.0)], "total_documents int, macro_index double")
    got = {r.check: (r.value, r.passed) for r in gates.pipeline_gate(ops, ops, report=report).collect()}
    assert got["missing_report_sections"] == (3.0, False) and got["report_total"] == (1.0, False)


def test_day_has_all_outputs(spark):
    body = "La escasez de divisas y el tipo de cambio preocupan al BCB por la inflación y las reservas del país. " * 4
    rows = [item(i, f"Título número {i} sobre el dólar paralelo", body + f" caso{i}", f"F{i % 4}", f"2026-07-10T0{i % 9}:00:00Z", f"https://x/{i}", "2026-07-10T11:00:00Z") for i in range(40)]
    df = spark.createDataFrame(rows, NEWS).drop("entidades", "indicadores", "stress_score").withColumn("tema", F.lit("t")).withColumn("tono_consolidado", F.lit("favorable"))
    done = pipeline.daily(df.limit(0), df, "2026-07-10T11:00:00Z", now())
    day = done.snapshot.first()
    assert done.snapshot.columns[:22] == pipeline.SNAPSHOT and (day.documents, day.historical_documents, day.favorable_percentage, day.top_topic) == (40, 40, 100.0, "t")
    assert day.economic_events == done.events.count() and day.top_entity == "BCB" and day.operational_window_hours == 72.0
    assert not [r.check for r in done.gates.collect() if not r.passed and r.check not in ("event_ratio", "largest_event_share")]
    assert {r.output: r.rows for r in done.counts().collect()}["series"] == 1
    old = pipeline.add_to_history(spark.createDataFrame([("2026-07-10", 1), ("2026-07-09", 2)], "date string, documents bigint"), done.snapshot)
    assert [(r.date, r.documents) for r in service.history(old, 5).collect()] == [("2026-07-09", 2), ("2026-07-10", 40)]


def test_batch_report_and_collected_order(spark):
    rows = [(None, "favorable", "t", ["BCB"], ["i"]), (None, None, "t", [], None), ("e", "favorable", "t", ["BCB"], [])]
    df = spark.createDataFrame(rows, "error string, tono_consolidado string, tema string, entidades array<string>, indicadores array<string>")
    got = {(r.kind, r.value): r["count"] for r in service.batch_report(df).collect()}
    assert got == {("outcome", "processed"): 2, ("outcome", "failed"): 1, ("sentiment", "favorable"): 1, ("topic", "t"): 2, ("entity", "BCB"): 1, ("indicator", "i"): 1}
    news = spark.createDataFrame([item(1, "b", fuente="B"), item(2, "a", fuente="A", score=1), item(3, "c", fuente="A", score=5), item(4, "a", fuente="A", score=5)], NEWS)
    assert [r.seq for r in corpus.collected_order(news).collect()] == [4, 3, 2, 1]


def test_catalogue_rules_are_told_apart(spark):
    rows = [("1", "A", "official", "LP", "n", "active", 0.5, "h"), ("1", "a ", "blog", None, "n", "gone", 2.0, None), ("2", None, "", "LP", "", "inactive", None, None)]
    got = {(r.id, r.rule) for r in catalogue.violations(spark.createDataFrame(rows, "id string, name string, source_type string, department string, scope string, status string, source_weight double, homepage string")).collect()}
    assert got == {
        ("1", "unknown_source_type"), ("1", "missing_department"), ("1", "unknown_status"), ("1", "weight_out_of_range"), ("1", "duplicate_id"), ("1", "duplicate_name"),
        ("2", "missing_name"), ("2", "missing_source_type"), ("2", "missing_scope"), ("2", "weight_out_of_range"),
    }


def test_similar_news_are_joined_without_listing_pairs(spark, monkeypatch):
    rng = random.Random(4)
    words = ["banco", "reservas", "dólar", "gas", "litio", "precio", "alza", "crisis", "diésel", "aduana", "salario", "deuda"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 9))) for _ in range(90)]
    at = [None if i % 29 == 0 else rng.randrange(20) for i in range(len(texts))]
    rows = [item(i, None, t, None, None if d is None else f"2026-07-{d + 1:02}T10:00:00Z", f"u{i}") for i, (t, d) in enumerate(zip(texts, at))]
    root = list(range(len(texts)))
    edges = [(a, b) for a, b in cosine_pairs(texts, 0.48) if at[a] is None or at[b] is None or abs(at[a] - at[b]) <= 3]
    edges += [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if texts[a] == texts[b] and at[a] == at[b]]
    for _ in texts:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(rows, NEWS).withColumn("effective_at", F.col("fecha"))
    for block, dense, tile in ((8192, 512, (2048, 4096)), (3, 4, (2, 3))):
        for name, value in (("BLOCK", block), ("DENSE", dense), ("TILE", tile)):
            monkeypatch.setattr(events, name, value)
        got = events.cluster_news(df).collect()
        first = {}
        for r in sorted(got, key=lambda r: r.seq):
            first.setdefault(r.event_id, r.seq)
        assert {r.seq: first[r.event_id] for r in got} == dict(enumerate(root))
        assert all(r.event_size == root.count(root[r.seq]) for r in got)


def test_links_of_one_event_grow_with_its_documents(spark):
    docs = grams.packed(spark.createDataFrame([(i, 0, False, "banco reservas") for i in range(60)], "key bigint, at bigint, free boolean, words string"), ["banco", "reservas"], kept=("key", "at", "free"))
    assert events.similar_links(docs, [1.0, 1.0], 0.48).count() <= 60


def test_packed_terms_of_rows(spark, monkeypatch):
    rows = [(0, "a uno dos uno dos"), (1, "uno " * 300), (2, ""), (3, "tres dos")]
    df = spark.createDataFrame(rows, "key bigint, words string")
    want = {"uno": (302, 2), "dos": (3, 2), "uno dos": (2, 1), "dos uno": (1, 1), "uno uno": (299, 1), "tres": (1, 1), "tres dos": (1, 1)}
    for most in (10**6, 1):
        monkeypatch.setattr(grams, "MOST_COUNTED", most)
        assert {r.term: (r.uses, r.df) for r in grams.counted(df).collect()} == want
    got = grams.packed(df, ["dos", "uno", "uno dos"]).toPandas().sort_values("key")
    row, term, uses = grams.flat(got["ids"], got["tf"], 3)
    assert list(zip(row.tolist(), term.tolist(), uses.tolist())) == [(0, 0, 2), (0, 1, 2), (0, 2, 2), (1, 1, 300), (3, 0, 1)]


def test_bayes_over_packed_rows(spark, monkeypatch):
    rng = random.Random(6)
    words = ["banco", "reservas", "dólar", "gas", "litio", "precio", "alza", "crisis"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 7))), "xyz"[i % 3]) for i in range(40)]
    df = spark.createDataFrame(rows, "seq bigint, t string, y string")
    vectors = models.weights(tf := models.terms(df, "seq", F.col("t")), models.vocabulary(tf))
    labels = df.select(F.col("seq").alias("key"), F.col("y").alias("label"))
    theta, prior = models.nb_train(vectors, labels)
    want = {r.key: (r.label, r.probability) for r in models.nb_predict(vectors, theta, prior).collect()}
    pack = models.nb_pack(df, "seq", F.col("t"), "y")
    # one row a text, none a term
    assert pack[0].count() == len(want)
    for most in (64, 1):
        monkeypatch.setattr(models, "MOST_LABELS", most)
        got_theta, got_prior = models.nb_train_packed(*pack, labels)
        assert {(r.label, r.term): pytest.approx(r.theta) for r in theta.collect()} == {(r.label, r.term): r.theta for r in got_theta.collect()}
        got = {r.key: (r.label, r.probability) for r in models.nb_predict_packed(*pack, got_theta, got_prior).collect()}
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
        assert all(v[1] == pytest.approx(want[k][1]) for k, v in got.items())


def test_topics_by_em_do_not_depend_on_where_texts_lie(spark):
    import numpy as np

    from quipu.operators import grams, topics

    texts = [" ".join(f"palabra{chr(97 + (i * j) % 7)}{chr(97 + j % 3)}" for j in range(3 + i % 5)) for i in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "seq bigint, t string")
    options = {"k": 3, "iterations": 6, "least": 1, "most_share": 0.9}
    one, many = (models.topic_fit(df, F.col("t"), **options) for df in (rows.coalesce(1), rows.orderBy(F.desc("seq")).repartition(7)))
    words = one.stages[-2].vocabulary
    assert words == many.stages[-2].vocabulary
    got = one.stages[-1].topicsMatrix().toArray()
    assert np.allclose(got, many.stages[-1].topicsMatrix().toArray(), rtol=1e-4)
    # by brute force from the same start
    packed = grams.packed(rows.select(F.xxhash64("t").alias("key"), F.col("t").alias("words")), words).collect()
    n, first = np.zeros((40, len(words))), np.zeros((40, len(words), 3))
    for i, r in enumerate(packed):
        ids = np.frombuffer(r.ids, "<u2")
        n[i, ids] = np.frombuffer(r.tf, "u1")
        first[i, ids] = topics.start(np.full(len(ids), r.key), ids, 3, 42).T
    text, term = (np.einsum("jw,jwk->" + to, n, first) for to in ("jk", "wk"))
    for _ in range(6):
        p = (text[:, None, :] + 1 / 3) * (term + 1 / 3) / (term.sum(axis=0) + len(words) / 3)
        p *= (n / p.sum(axis=2))[:, :, None]
        text, term = p.sum(axis=1), p.sum(axis=0)
    assert np.allclose(got, term, rtol=1e-4)


def test_topics_of_texts_are_those_of_the_stored_stages(spark):
    from pyspark.ml.functions import vector_to_array

    from quipu.functions import text
    from quipu.operators import topics

    df = spark.createDataFrame([(i, "litio salar mina agua litio" if i % 2 else "banco crédito tasa ahorro agua") for i in range(30)] + [(30, "otra cosa"), (31, None)], "seq bigint, t string")
    fitted = models.topic_fit(df, F.col("t"), k=2, iterations=5, least=1, most_share=0.9)
    got = {r.key: r for r in models.topic_infer(fitted, df, "seq", F.col("t")).collect()}
    stages = fitted.transform(df.select("seq", text.topic_text(F.col("t")).alias("content"))).select("seq", vector_to_array("topics").alias("t")).collect()
    assert len(got) == len(stages) == 32
    assert all(abs(max(r.t) - got[r.seq].confianza_tema) < 2e-3 and (not max(r.t) or r.t[got[r.seq].topic_id] == max(r.t)) for r in stages)
    once = models.topic_fit_infer(df, "seq", F.col("t"), k=2, iterations=5, least=1, most_share=0.9).collect()
    assert {r.key: r.topic_id for r in once} == {k: r.topic_id for k, r in got.items()}
    assert abs(topics.digamma([0.5])[0] + 1.9635100260214235) < 1e-10
