import itertools
import random

import pytest

from pyspark.sql import functions as F

from quipu.llm import fusion, linking

SCHEMA = "seq bigint, lote int, titulo string, fuente string, url string"
ROLES = "exportadores productores dirigentes técnicos socios mayoristas".split()
GOODS = "café litio soya carne azúcar quinua".split()
VERBS = "piden rechazan negocian evalúan critican".split()
PLACES = ["Tres Molles", "Alto Wayra", "Río Quirquiña", "Vado Hondo"]
ENDS = ["por la sequía prolongada", "tras el acuerdo salarial", "ante la mora bancaria", "por el cierre de frontera"]


def news(n=120, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = f"{rng.choice(ROLES)} de {rng.choice(GOODS)} {rng.choice(VERBS)} nuevos subsidios focalizados en {rng.choice(PLACES)} {rng.choice(ENDS)} con {rng.randrange(3)} votos"
        t = t[0].upper() + t[1:]
        if i % 4 == 1:
            t = rows[-1][2]
            t = [t.upper(), t + " - Diario Uno", t.replace("é", "Ã©"), t.replace(" nuevos", ""), "ÚLTIMO – " + t][rng.randrange(5)]
        rows.append((i + 1, i // 10 + 1, t, "Diario Uno", f"https://x.bo/n/{rng.randrange(200)}" if i % 2 else None))
    return rows


def components(n, links):
    root = list(range(n))
    for _ in range(n):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def brute(rows, index):
    """All pairs over the same spelling and fixed words."""
    profiles = {r.id: (r.core, r.fixed) for r in sorted(index._all("headlines").collect(), key=lambda r: r.batch)}
    record = {r.seq: (r.h, r.u) for r in index._all("records").collect()}
    links = []
    for a, b in itertools.combinations(range(len(rows)), 2):
        (h, u), (k, v) = record[rows[a][0]], record[rows[b][0]]
        same = u is not None and u == v
        if h is not None and k is not None and not same:
            same = h == k or profiles[h][1] == profiles[k][1] and linking._edits(profiles[h][0].split(), profiles[k][0].split()) <= 2
        if same:
            links.append((a, b))
    return {rows[i][0]: rows[r][0] for i, r in enumerate(components(len(rows), links))}


@pytest.mark.parametrize("hot", [32, 1])
def test_articles_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(linking, "HOT_KEY", hot)
    rows = news()
    index = linking.ArticleIndex(spark)
    index.extend(spark.createDataFrame(rows, SCHEMA))
    got = {r.seq: r.grupo for r in index.articles().collect()}
    assert got == brute(rows, index)
    assert len(set(got.values())) < len(rows) * 0.9


def test_batches_agree_with_the_whole(spark):
    rows = news(160)
    df = spark.createDataFrame(rows, SCHEMA)
    index = linking.ArticleIndex(spark)
    for low, high in ((1, 9), (9, 12), (12, 99)):
        index.extend(df.where(f"lote >= {low} and lote < {high}"))
    got = {r.seq: r.grupo for r in index.articles().collect()}
    assert got == brute(rows, index)


def test_index_is_opened_again_and_learns(spark, tmp_path):
    """A segment that only the second batch shows to be an affix ties an earlier headline to its article."""
    t = "Exportadores de café piden nuevos subsidios focalizados en Tres Molles por la sequía"
    other = ["Mayoristas de litio rechazan tarifas altas del puerto ante la mora bancaria", "Socios de quinua evalúan créditos blandos del fondo tras el acuerdo salarial"]
    first = [(1, 1, "Alerta: " + t, "A", None), (2, 1, other[0], "A", None)]
    second = [(3, 2, t, "B", None), (4, 2, other[0], "B", None)] + [(5 + i, 2, x + y, "B", None) for i, (x, y) in enumerate(itertools.product(["", "Alerta: "], other))]
    folder = str(tmp_path / "index")
    linking.ArticleIndex(spark, folder).extend(spark.createDataFrame(first, SCHEMA))
    index = linking.ArticleIndex(spark, folder)
    assert index.batches == 1
    index.extend(spark.createDataFrame(second, SCHEMA))
    got = {r.seq: r.grupo for r in linking.ArticleIndex(spark, folder).articles().collect()}
    assert got[3] == got[1] == 1 and got[4] == got[2] == got[5] == got[7] == 2 and got[6] == got[8] == 6
    assert linking.ArticleIndex(spark, folder).weights() is not None


def test_titles_and_addresses(spark):
    t = "Exportadores de café piden nuevos subsidios focalizados en Tres Molles por la sequía"
    rows = [(1, 1, t, "A", None), (2, 1, t.replace("Tres Molles", "Alto Wayra"), "A", None), (3, 1, "EXPORTADORES DE CAFE PIDEN NUEVOS SUBSIDIOS FOCALIZADOS EN TRES MOLLES POR LA SEQUIA", "B", None), (4, 2, "[VIDEO] " + t, "A", None)]
    rows += [(5 + i, 2, f"{x}: {y}", "A", None) for i, (x, y) in enumerate(itertools.product(["[VIDEO] otra", "Video"], ["nota breve de prueba uno en Alto Wayra", "nota breve de prueba dos en Tres Molles"]))]
    rows += [(20, 3, None, None, "https://www.x.bo/a/1/?utm_source=y#z"), (21, 3, "Mercados", "A", "http://X.bo/a/1/amp"), (22, 3, "Mercados", "A", "/a/1"), (23, 3, "", None, ""), (24, None, None, None, None)]
    got = {r.seq: r.grupo for r in linking.articles(spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit(1))).collect()}
    assert got[3] == 1 and got[2] == 2 and got[21] == got[20] == 20
    assert (got[22], got[23], got[24]) == (22, 23, 24)


def test_no_records(spark):
    assert linking.articles(spark.createDataFrame([], SCHEMA)).count() == 0


def test_wildcard_links_are_within_two_edits_and_complete(spark):
    rng = random.Random(4)
    cores = sorted({" ".join(rng.choice("ab") for _ in range(rng.randrange(5, 8))) for _ in range(60)})
    df = spark.createDataFrame([(i, c, "") for i, c in enumerate(cores)], "id bigint, core string, fixed string")
    links = [(r.a, r.b) for r in linking.hot_links(linking.wild_keys(df)).collect()]
    edits = lambda a, b: linking._edits(cores[a].split(), cores[b].split())
    assert all(edits(a, b) <= 2 for a, b in links)
    every = [(a, b) for a, b in itertools.combinations(range(len(cores)), 2) if edits(a, b) <= 2]
    assert components(len(cores), links) == components(len(cores), every)


def test_joined_vocabulary_agrees(spark):
    index = linking.ArticleIndex(spark)
    index.extend(spark.createDataFrame(news(), SCHEMA))
    long_ = index._all("headlines").select("id", "core")
    key = lambda df: {(r.id, r.core, r.fixed, tuple(r.soft)) for r in df.select("id", "core", "fixed", "soft").collect()}
    assert key(linking._profiles_joined(long_, linking.choose_words(index._all("words")))) == key(index._all("headlines"))


def test_weights_separate():
    w = linking.learn_weights([((0,), 90.0), ((1,), 10.0), ((4,), 200.0), ((5,), 300.0)])
    assert w[(0,)] > w[(4,)]


def test_fusion_against_brute_force(spark):
    rng = random.Random(6)
    schema = "seq bigint, fuente string, collected_at string, w double, s int, url string"
    rows = [(i, rng.choice(["A", "B", "C", None]), rng.choice([f"2026-01-{d:02d}T00:00:00Z" for d in range(1, 5)] + [None, "x"]), rng.choice([0.5, 0.7, 0.9, None]), rng.choice([1, 2, None]), rng.choice(["https://a/1", "/x", None])) for i in range(1, 200)]
    groups = [(r[0], r[0] % 40) for r in rows]
    w = F.col("w")
    rules = {"w": (w, [w]), "s": (F.col("s"), [F.col("s")]), "url": (F.when(F.col("url").startswith("http"), F.col("url")), [w])}
    df, gs = spark.createDataFrame(rows, schema), spark.createDataFrame(groups, "seq bigint, grupo bigint")
    got = {(r.grupo, r.campo): r.seq for r in fusion.fuse(df, gs, rules).collect()}
    want = {}
    for g in range(40):
        mine = [r for r in rows if r[0] % 40 == g]
        late = lambda r: (r[2] is not None and r[2] != "x", r[2] if r[2] and r[2] != "x" else "")
        low = lambda x: -1.0 if x is None else x
        for campo, has, rank in (("w", lambda r: r[3] is not None, lambda r: r[3]), ("s", lambda r: r[4] is not None, lambda r: r[4]), ("url", lambda r: (r[5] or "").startswith("http"), lambda r: low(r[3]))):
            ok = [r for r in mine if has(r)]
            if ok and len(mine) > 1:
                want[g, campo] = max(ok, key=lambda r: (rank(r), late(r), -r[0]))[0]
    assert got == want
    assert fusion.fuse(df.limit(0), gs.limit(0), rules).count() == 0


@pytest.mark.parametrize("local", [10**6, 0])
def test_quality_model_finds_planted_truth(spark, monkeypatch, local):
    """Three good sources, two that name a false value more often than not; several values may be true."""
    monkeypatch.setattr(fusion, "MOST_ROUNDS", 200 if local else 6)
    rng = random.Random(11)
    rows, covers, true = [], [], set()
    for g in range(300):
        good = [g * 10] + [g * 10 + 1] * (rng.random() < 0.3)
        true |= {(g, v) for v in good}
        for s in (1, 2, 3):
            covers.append((g, s))
            rows += [(g, "f", v, s) for v in good if rng.random() < 0.9] + [(g, "f", g * 10 + 5 + s, s)] * (rng.random() < 0.05)
        for s in (4, 5):
            covers.append((g, s))
            rows += [(g, "f", g * 10 + s - 2, s)] if rng.random() < 0.6 else [(g, "f", good[0], s)]
    truth, quality = fusion.quality_model(spark.createDataFrame(rows, "grupo bigint, campo string, value bigint, source bigint"), spark.createDataFrame(covers, "grupo bigint, source bigint"), local)
    said = {(r.grupo, r.value): r.p_true for r in truth.collect()}
    kept = {k for k, p in said.items() if p >= 0.5}
    right = true & set(said)
    assert len(kept & right) >= 0.95 * len(right) and len(kept & right) >= 0.95 * len(kept)
    quality = {r.source: (r.sensitivity, r.specificity) for r in quality.collect()}
    assert all(quality[a][0] > quality[b][0] and quality[a][1] > quality[b][1] for a in (1, 2, 3) for b in (4, 5))
    assert fusion.quality_model(spark.createDataFrame([], "grupo bigint, campo string, value bigint, source bigint"))[0].count() == 0
