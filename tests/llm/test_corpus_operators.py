import itertools
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quipu.llm import areas, leaks, mixing, pages, quotas, sitelines


def line_case(n=90, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        src = "Diario Ñeembo" if i % 3 else "Otro"
        lines = [f"Texto propio número {rng.randrange(10**6)} abc{i}"]
        if rng.random() < 0.7:
            lines.append(rng.choice(["© 2026 Síguenos en redes", "© 2025  SÍGUENOS en  redes\t", "Â© 2024 SÃ­guenos en redes"]))
        if rng.random() < 0.3:
            lines.insert(0, "Lea también la línea")
        lines.append(rng.choice(["", "   ", "123"]))
        rows.append((i, "\n".join(lines), src if i % 7 else "Diario Ã‘eembo" if i % 3 else src))
    return rows


def test_lines_against_brute_force(spark):
    rows = line_case() + [(1000, None, "Otro"), (1001, "", None), (1002, "x\n" * 5000, "Otro"), (1003, "Lea también la línea", None)]
    df = spark.createDataFrame(rows, "seq bigint, texto string, fuente string").withColumn("line", F.lit(1))
    key = lambda s: re.sub(r"[^\x21-\x7e]+", "", re.sub(r"[\s\d\xa0]+", "", s.lower()))
    docs, sizes = defaultdict(set), Counter()
    for seq, t, src in rows:
        if src:
            s = re.sub(r"[^\x00-\x7f]+", "?", src.lower())
            sizes[s] += 1
            for x in (t or "").split("\n"):
                if x.strip():
                    docs[s, key(x)].add(seq)
    want = set()
    for seq, t, src in rows:
        if src:
            s = re.sub(r"[^\x00-\x7f]+", "?", src.lower())
            for i, x in enumerate((t or "").split("\n"), 1):
                if x.strip() and len(docs[s, key(x)]) >= max(15, 0.05 * sizes[s]):
                    want.add((seq, i))
    assert {(r.seq, r.linea) for r in sitelines.repeated_lines(df).collect()} == want and want
    kept = {r.seq: r.texto for r in sitelines.without_lines(df).collect()}
    for seq, t, _ in rows:
        assert kept[seq] == (None if t is None else "\n".join(x for i, x in enumerate(t.split("\n"), 1) if (seq, i) not in want))
    assert sitelines.repeated_lines(df.limit(0)).count() == 0


def test_lines_of_other_scripts_and_repeated_rows(spark):
    rows = [(i, f"Фото: AP\nВидео: AP{'' if i else ' x'}\naño{i}\ntexto 5G 中文" if i % 2 else "Фото: AP\nao\ntexto 5G 汉字", "A") for i in range(40)] + [(100, "una sola", "A")] * 30
    df = spark.createDataFrame(rows, "seq bigint, texto string, fuente string")
    got = {(r.seq, r.linea) for r in sitelines.repeated_lines(df).collect()}
    assert {i for i, n in got if n == 1} == set(range(40)) and (100, 1) not in got
    key = lambda t: spark.createDataFrame([(t,)], "t string").select(sitelines.line_key(F.col("t"))).first()[0]
    assert key("Фото: AP") != key("Видео: AP") and key("año 12") == key("AÃ±O") == key("aÃ±o 3")


def test_quotas(spark):
    pool = spark.createDataFrame([(f"k{i}", "a" if i < 60 else "b" if i < 90 else "c") for i in range(100)], "key string, category string")
    targets = spark.createDataFrame([("f", " A", 0.5, 5), ("f", "B", 0.2, 5), ("f", "c", 0.3, 5), ("f", "d", 0.0, 3)], "campo string, categoria string, target_share double, min_rows int")
    got = {r.categoria: (r.available, r.quota, r.slack) for r in quotas.report(pool, targets).collect()}
    assert got["c"] == (10, 10, 5) and got["d"] == (0, 0, 3)
    assert got[" A"][1] + got["B"][1] + got["c"][1] == 50 and got[" A"][2] == got["B"][2] == 0
    drawn = quotas.draw(pool, quotas.report(pool, targets)).groupBy("category").count().collect()
    assert {r.category: r["count"] for r in drawn} == {"a": got[" A"][1], "b": got["B"][1], "c": 10}
    empty = quotas.report(pool.limit(0), targets).collect()
    assert {r.categoria for r in empty if r.slack > 0} == {" A", "B", "c", "d"}
    assert quotas.draw(pool.limit(0), quotas.report(pool.limit(0), targets)).count() == 0


def test_flow_crosses_two_fields():
    cells = [(("a", "x"), 10), (("a", "y"), 10), (("b", "x"), 10), (("b", "y"), 0)]
    targets = {(0, "a"): (0.5, 0), (0, "b"): (0.5, 0), (1, "x"): (0.6, 0), (1, "y"): (0.4, 0)}
    quota, short = quotas.solve(cells, targets, 10)
    assert quota == [1, 4, 5, 0] and not any(short.values())


def test_flow_crosses_two_fields_against_brute_force():
    rng = random.Random(3)
    for _ in range(30):
        cells = [((a, b), rng.randrange(4)) for a in "ab" for b in "xy"]
        size = rng.randrange(1, 1 + max(1, sum(n for _, n in cells)))
        targets = {(0, "a"): (rng.random(), rng.randrange(2)), (0, "b"): (rng.random(), 0), (1, "x"): (rng.random(), 0), (1, "y"): (rng.random(), rng.randrange(2))}
        want = {k: max(m, int(p * size + 1e-9)) for k, (p, m) in targets.items()}

        def cost(q):
            total = 0
            for k, (_, least) in targets.items():
                got = sum(v for (cats, _), v in zip(cells, q) if cats[k[0]] == k[1])
                least = min(least, want[k])
                total += max(0, min(got, want[k]) - least) + 50 * max(0, got - want[k])
            return total

        quota, _ = quotas.solve(cells, targets, size)
        every = [q for q in itertools.product(*[range(n + 1) for _, n in cells]) if sum(q) == min(size, sum(n for _, n in cells))]
        assert sum(quota) == min(size, sum(n for _, n in cells)) and cost(quota) == min(map(cost, every))


def test_many_categories_are_all_met():
    cells = [((i,), 2) for i in range(10_001)]
    quota, _ = quotas.solve(cells, {(0, i): (1 / 10_001, 1) for i in range(10_001)}, 10_001)
    assert quota == [1] * 10_001
    assert sum(quotas.slack(cells, {(0, i): (0.0, 3) for i in range(10_001)}, 10).values()) == 10_001


def test_crossed_sample(spark):
    pool = spark.createDataFrame([(f"k{i}", "ab"[i % 2], "xyz"[i % 3]) for i in range(60)], "key string, a string, b string")
    target = lambda name, **kinds: spark.createDataFrame([(name, k, p, 2) for k, p in kinds.items()], "campo string, categoria string, target_share double, min_rows int")
    cells, report = quotas.crossed(pool, target("f", a=0.5, b=0.5), target("g", x=0.2, y=0.5, w=0.1))
    got = {(r.campo, r.categoria): (r.available, r.quota, r.slack, r.missed) for r in report.collect()}
    assert got["f", "a"][:2] == (30, 15) and got["f", "b"][:2] == (30, 15) and got["g", "w"] == (0, 0, 3, 3) and got["g", "y"] == (20, 15, 0, 0)
    every = pool.select("key", F.concat_ws("|", "a", F.when(F.col("b").isin("x", "y", "w"), F.col("b")).otherwise("")).alias("category"))
    assert quotas.draw(every, cells).count() == 30


def test_eligible_takes_the_latest_row(spark):
    rows = [("1", "Positivo", "2026-01-02"), ("1", "negativo", "2026-01-01"), ("2", " POSÍTIVO ", None), ("2", "otro", "2026-01-01"), ("3", None, None), (None, "positivo", None), ("", "positivo", None)]
    targets = spark.createDataFrame([("f", "positivo", 1.0, 1)], "campo string, categoria string, target_share double, min_rows int")
    got = quotas.eligible(spark.createDataFrame(rows, "key string, s string, at string"), "key", "s", targets, F.col("at")).collect()
    assert [(r.key, r.category) for r in got] == [("1", "positivo")]


def test_mix(spark):
    rows = [(i, f"t{i} a b c", "big" if i < 80 else "small") for i in range(90)] + [(200, None, None), (201, "", "big"), (300, "shared x y z", "big"), (301, "shared x y z", "small")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("size", F.lit("x"))
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 3), ("none", 0.0, 1), ("gone", 0.2, 2)], "source string, target_share double, max_repeats int")
    table, routes, report = mixing.plan(docs, targets, mixing.word_count(F.col("text")))
    got = {r.source: r for r in report.collect()}
    total = sum(len((t or "").split()) for _, t, _ in rows) / 2
    assert got["small"].available == 44 and got["small"].wanted == 0.5 * total
    assert {s for s, r in got.items() if r.short} == {"gone"}
    chosen = mixing.select(table, routes).collect()
    size = {i: len((t or "").split()) for i, t, _ in rows}
    for s, most in (("big", 1), ("small", 3)):
        mine = [r for r in chosen if r.source == s]
        assert max(r.copies for r in mine) <= most
        assert abs(sum(r.copies * size[r.doc_id] for r in mine) - got[s].routed) <= 8
    actual = {r.source: r for r in mixing.shares(table, routes, report).collect()}
    assert abs(sum(r.actual_share for r in actual.values()) - 1) < 1e-9 and actual["gone"].selected == 0
    assert actual["small"].selected == sum(r.copies * size[r.doc_id] for r in chosen if r.source == "small")
    assert mixing.plan(docs.limit(0), targets, mixing.word_count(F.col("text")))[2].where("short").count() == 0


def test_no_small_pattern_is_lost(spark, monkeypatch):
    size = {p: 4 for p in range(20)} | {99: 10**12}
    routes = mixing._route([(p, ["tail" if p < 99 else "big"], n) for p, n in size.items()], {"tail": (80.0, 1), "big": (10.0**11, 1)})
    assert sum(v for (_, s), v in routes.items() if s == "tail") == 80
    rows = [(i, f"t{i // 2}", f"s{i % 2 if i % 3 else 0}{i % 5}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([(s, 0.1, 2) for s in {r[2] for r in rows}], "source string, target_share double, max_repeats int")
    monkeypatch.setattr(mixing, "MOST_PATTERNS", 3)
    table, _, report = mixing.plan(docs, targets, mixing.word_count(F.col("text")))
    assert table.count() == 60 and all(r.routed == 3 for r in report.collect())


def test_texts_of_several_sources_fill_any_of_them_beyond_the_patterns_fetched_at_once(spark, monkeypatch):
    rows = [(6 * i + j, f"word{i} of it", "a" if j == 0 else f"b{i % 3}") for i in range(6) for j in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 1), *[(f"b{i}", 0.0, 1) for i in range(3)]], "source string, target_share double, max_repeats int")
    routed = lambda: {r.source: r.routed for r in mixing.plan(docs, targets, mixing.word_count(F.col("text")))[2].collect()}
    want = routed()
    monkeypatch.setattr(mixing, "MOST_PATTERNS", 1)
    assert routed() == want and want["a"] == 54  # of its own it has 18


def test_token_count(spark):
    df = spark.createDataFrame([("Hola, mundo",), ("",), (None,)], "t string")
    got = [r.n for r in df.select(mixing.token_count(F.col("t")).alias("n")).collect()]
    assert got[0] >= 3 and got[1:] == [0, 0]


def leak_brute(docs, items, least):
    out = set()
    for (d, t), (i, q) in itertools.product(docs, items):
        a, b = leaks.words(t).split(), leaks.words(q).split()
        k = min(least, len(b))
        if k and any(a[x : x + k] == b[y : y + k] for x in range(len(a) - k + 1) for y in range(len(b) - k + 1)):
            out.add((d, i))
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"palabra{i}é" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 12, 30])))) for i in range(30)] + [(90, None), (91, "¡!"), (92, "sí"), (93, items_text := "uno dos"), (94, items_text)]
    docs = []
    for d in range(80):
        text = [rng.choice(vocabulary) for _ in range(60)]
        w = (rng.choice(items)[1] or "").split()
        s = rng.randrange(0, max(1, len(w) - 11)) if w else 0
        text[20:20] = w[s : s + rng.choice([11, 12, 40])]
        docs.append((d, " ".join(text).upper().replace("É", "e") if d % 2 else ", ".join(text)))
    docs += [(500, None), (501, ""), (502, "x " * 100_000 + "uno dos"), (502, "x " * 100_000 + "uno dos")]
    got = leaks.leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    rows = [(r.doc_id, r.item_id) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == leak_brute(docs, [x for x in items if x[1]], 12)


def test_leaks_in_blocks_and_shared_grams(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 400)
    monkeypatch.setattr(leaks, "HITS_AT_ONCE", 50)
    same = " ".join(f"palabra{i}" for i in range(14))
    items = [(i, same + f" final{i}") for i in range(20)] + [(50, "otra cosa corta")]
    docs = [(1, "antes " + same + " final3 x"), (2, "otra cosa corta"), (3, "nada")]
    got = leaks.leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == leak_brute(docs, items, 12)


def test_leaks_with_edits(spark):
    item = " ".join(f"término{i}" for i in range(14))
    w = item.split()
    docs = [(1, "a b c " + " ".join(w[:6] + ["otro"] + w[7:]) + " d"), (2, "x " + " ".join(w[:5] + w[6:])), (3, " ".join(w[::2]))]
    got = leaks.leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(7, item)], "item_id bigint, text string"), edits=1)
    assert {r.doc_id for r in got.collect()} == {1, 2}
    none = leaks.leaked_items(spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string"))
    assert none.count() == 0


def site_page(i):
    head = f"Productores de café número {i} piden apoyo al gobierno nacional"
    body = [f"El sector creció {i} por ciento en el año. La cámara pidió medidas urgentes.", "El problema", "«Es necesario», dijo un vocero del sector.", "- Arroz: Bs 5", "• Azúcar: Bs 7"]
    page = ["Inicio | Economía | Deportes | Cultura", "Usamos cookies propias para mejorar su experiencia.", head, body[0], "Por Redacción Diario", *body[1:3], "Le puede interesar: otra nota de la sección económica de hoy", *body[3:], "Notas relacionadas", "Sindicatos de cuero en Tres Molles exigen controles fronterizos", "La aduana redujo el déficit fiscal.", "Comentarios (2)", "lector_1 dice:", "No estoy de acuerdo con nada de lo que dice.", "© 2026 Diario. Todos los derechos reservados."]
    return (i, "\n".join(page), head if i % 2 else None, f"https://x.bo/productores-de-cafe-numero-{i}-piden-apoyo-{i}0", head, [head, *body])


def test_pages(spark):
    made = [site_page(i) for i in range(1, 40)]
    rows = [m[:4] for m in made] + [(100, "Página no encontrada\nMapa del sitio", None, None), (101, None, None, None), (102, "", "x", "y")]
    df = spark.createDataFrame(rows, "page_id bigint, texto string, titulo string, url string").withColumn("fuente", F.lit(None).cast("string"))
    bodies = {r.page_id: r.body for r in pages.main_bodies(df).collect()}
    wrong = [m[0] for m in made if bodies[m[0]].split("\n") != m[5]]
    assert not wrong and bodies[100] == "" and bodies[102] == "" and 101 not in bodies
    lines = {(r.page_id, r.linea) for r in pages.boilerplate_lines(df).collect()}
    assert {(100, 1), (100, 2)} <= lines and (1, 3) not in lines
    assert pages.boilerplate_lines(df.limit(0)).count() == 0


def test_headline_without_title_and_slug():
    _, text, _, _, head, _ = site_page(3)
    lines, at = pages.tree(text, None, "https://x.bo/?id=9")
    assert lines[at].text == head
    assert pages.tree("Inicio | Deportes | Más\nPágina no encontrada\nMapa del sitio", None, None)[1] == -1


AREAS = {"deporte": "equipo gol partido torneo árbitro cancha", "salud": "hospital vacuna médico paciente dosis fiebre", "derecho": "tribunal sentencia juez demanda amparo fiscal"}


def area_corpus(n=300, seed=5):
    rng = random.Random(seed)
    docs, labels, true = [], [], {}
    for i in range(n):
        mine = rng.sample(sorted(AREAS), rng.choice([1, 1, 2]))
        body = []
        for a in mine * 3:
            w = AREAS[a].split()
            body.append(f"El {rng.choice(w)} y la {rng.choice(w)} del {rng.choice(w)} siguen hoy.")
        body.append("No se dieron más datos.")
        docs.append((i, " ".join(body)))
        true[i] = set(mine)
        if i % 2:
            told = mine if rng.random() > 0.1 else [rng.choice(sorted(AREAS))]
            labels += [(i, a) for a in told]
    return docs, labels, true


def test_areas_on_unlabelled_documents(spark):
    docs, labels, true = area_corpus()
    df = spark.createDataFrame(docs + [(9000, None), (9001, ""), (9002, "123.")], "doc_id bigint, text string").withColumn("area", F.lit("x"))
    got = areas.document_areas(df, spark.createDataFrame(labels, "doc_id bigint, area string"))
    by = defaultdict(set)
    for r in got.collect():
        by[r.doc_id].add(r.area)
    held = [i for i in true if not i % 2]
    assert sum(by[i] == true[i] for i in held) >= 0.95 * len(held)
    assert not {9000, 9001, 9002} & set(by)
    shares = areas.composition(got, df).collect()
    assert sum(r.documents for r in shares if r.area == "ninguna") >= 3
    none = areas.document_areas(df.limit(0), spark.createDataFrame([], "doc_id bigint, area string"))
    assert none.count() == 0
