"""Events: clusters of documents that tell the same, and their summaries.

Similarity is the cosine of TF-IDF vectors.  Documents meet all those of their own and the next span of time, as packed vectors
in blocks; of the similar pairs of a block only as many leave it as join its documents, so what is shuffled and kept grows
with the documents, not with their pairs.  Copies collapse first.  ``similar_pairs`` lists the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quipu.functions import dates, numbers, text
from quipu.operators import grams
from quipu.operators.lineage import bounded, cut, small, store

THRESHOLD, MAX_DAYS, MAX_TERMS = 0.48, 3.0, 8000
#: Norm of what a document's indexed terms leave out, at most.
REST = 0.3
#: Edges (16 bytes each) that one task joins to components; more are joined in rounds over all tasks.
LOCAL_EDGES = 1_000_000
#: Documents (some kB each) of one span that are held at once; those of fuller spans are dealt out over several blocks.
BLOCK = 8192
#: Terms multiplied as dense columns, the most frequent; the others by the few documents that have them.
DENSE = 512
#: Rows and columns of the pairs that are worked out at once, and how near to the threshold they are worked out again in full precision.
TILE, NEAR = (2048, 4096), 1e-4
#: Rows of a table that is broadcast, of two numbers.
BROADCAST_ROWS = 300_000
#: Members of an event whose texts one task puts together; the ids of larger ones are made from digests of parts.
MOST_MEMBERS = 10_000


def document_text() -> Column:
    """Title twice, then the text, so that titles weigh more."""
    return text.cluster_text(F.concat_ws(" ", "titulo", "titulo", "texto"))


def known_terms(counts: DataFrame, most_terms: int = MAX_TERMS) -> DataFrame:
    """The most frequent of ``(term, uses, df)``, by name where equal."""
    return counts.orderBy(F.desc("uses"), "term").limit(most_terms)


def tfidf(df: DataFrame, key: str, content: Column, most_terms: int = MAX_TERMS) -> DataFrame:
    """``(key, term, w)``: unit vectors of words and word pairs; words have two characters or more.

    Weight is (1 + ln tf) x (ln((1 + n) / (1 + df)) + 1).  The most frequent terms are kept, by name where equal.
    """
    words = F.regexp_extract_all(F.lower(content), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    base = df.select(F.col(key).alias("key"), words.alias("words"))
    pairs = F.when(F.size("words") > 1, F.zip_with(F.slice("words", F.lit(1), F.size("words") - 1), F.slice("words", F.lit(2), F.size("words") - 1), lambda a, b: F.concat_ws(" ", a, b)))
    terms = base.select("key", F.explode(F.concat("words", F.coalesce(pairs, F.array().cast("array<string>")))).alias("term"))
    tf = terms.groupBy("key", "term").agg(F.count("*").alias("tf"))
    known = known_terms(tf.groupBy("term").agg(F.sum("tf").alias("uses"), F.count("*").alias("df")), most_terms)
    total = df.agg(F.count("*").alias("n"))
    idf = known.crossJoin(F.broadcast(total)).select("term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = tf.join(F.broadcast(idf), "term").withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    norm = raw.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "key").select("key", "term", "df", (F.col("w") / F.col("norm")).alias("w"))


@F.pandas_udf(DoubleType())
def _dot(ta: pd.Series, wa: pd.Series, tb: pd.Series, wb: pd.Series) -> pd.Series:
    """Product of two sparse vectors: terms and weights of each."""
    out = np.empty(len(ta))
    for i, (p, u, q, v) in enumerate(zip(ta, wa, tb, wb)):
        _, x, y = np.intersect1d(p, q, assume_unique=True, return_indices=True)
        out[i] = float(np.dot(u[x], v[y]))
    return pd.Series(out)


def similar_pairs(vectors: DataFrame, threshold: float, times: DataFrame | None = None, days: float = MAX_DAYS) -> DataFrame:
    """``(a, b, cosine)`` of different vectors, a < b, at or above the threshold; with ``times`` (key, at) only pairs close in time.

    In an order common to all, from rare to frequent, each document is indexed by its first terms, until what is left has a
    norm of REST at most.  Of two documents, the one whose indexed terms end first shares with the other only terms that
    both index, and beyond them no more than REST; so the products of common indexed terms reach threshold - REST in any
    pair sought.  Timed documents meet per span of ``days`` and its neighbours, those without time meet all.
    """
    least = min(REST, threshold)
    rest = F.sqrt(F.greatest(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("key").orderBy(F.desc("df"), F.desc("term"))), F.lit(0.0)))
    prefix = vectors.withColumn("rest", rest).where(F.col("rest") >= least - 1e-9).select(F.xxhash64("term").alias("term"), "key", "w")
    if times is None:
        prefix = prefix.withColumns({"at": F.lit(None).cast("bigint"), "span": F.lit(0)})
    else:
        prefix = prefix.join(times.select("key", F.unix_micros("at").alias("at")), "key", "left")
        prefix = prefix.withColumn("span", F.floor(F.col("at") / (days * 86_400_000_000)))
    side = lambda df, s: df.select("term", "span", *[F.col(c).alias(f"{c}_{s}") for c in ("key", "at", "w")])
    if times is None:
        met = side(prefix, "a").join(side(prefix, "b"), ["term", "span"])
    else:
        timed, free = prefix.where("at is not null"), prefix.where("at is null")
        near = timed.withColumn("span", F.explode(F.array(*[F.col("span") + i for i in (-1, 0, 1)])))
        met = side(timed, "a").join(side(near, "b"), ["term", "span"]).where(F.abs(F.col("at_a") - F.col("at_b")) <= days * 86_400_000_000)
        for x, y in ((free, prefix), (timed, free)):
            met = met.unionByName(side(x, "a").drop("span").join(side(y, "b").drop("span"), "term").withColumn("span", F.lit(0)))
    met = met.where("key_a < key_b").groupBy(F.col("key_a").alias("a"), F.col("key_b").alias("b")).agg(F.sum(F.col("w_a") * F.col("w_b")).alias("part"))
    met = met.where(F.col("part") >= threshold - least - 1e-9).select("a", "b")
    packed = vectors.groupBy("key").agg(F.collect_list(F.struct(F.xxhash64("term").alias("t"), "w")).alias("v")).select("key", "v.t", "v.w")
    of = lambda s: packed.select(F.col("key").alias(s), F.col("t").alias(f"t{s}"), F.col("w").alias(f"w{s}"))
    both = met.join(of("a"), "a").join(of("b"), "b")
    return both.select("a", "b", _dot("ta", "wa", "tb", "wb").alias("cosine")).where(F.col("cosine") >= threshold)


def _joined(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Components of edges (a, b) on arrays: every node takes its neighbours' least root until nothing changes."""
    frames = list(parts)
    a, b = (np.concatenate([f[c].to_numpy("int64") for f in frames]) if frames else np.empty(0, "int64") for c in ("a", "b"))
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[a], root[b])
        now = root.copy()
        for x in (a, b):
            np.minimum.at(now, root[x], low)
            np.minimum.at(now, x, low)
        while not np.array_equal(now, now[now]):
            now = now[now]
        if np.array_equal(now, root):
            break
        root = now
    moved = root != np.arange(len(names))
    yield pd.DataFrame({"node": names[moved], "root": names[root[moved]]})


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the same nodes, one a node at most."""
    out = next(_joined(iter([pd.DataFrame({"a": a, "b": b})])))
    return out["node"].to_numpy(), out["root"].to_numpy()


class _Vectors:
    """Unit vectors of some documents: dense columns of frequent terms, the others as flat rows by term."""

    def __init__(self, part: pd.DataFrame, idf: np.ndarray) -> None:
        self.key, self.at, self.free = (part[c].to_numpy() for c in ("key", "at", "free"))
        row, term, uses = grams.flat(part["ids"], part["tf"], len(idf))
        w = grams.unit(row, term, uses, idf, len(part))
        self.start, self.term, self.w = np.searchsorted(row, np.arange(len(part) + 1)), term, w
        often = term < DENSE
        self.dense = np.zeros((len(part), min(DENSE, len(idf))), "float32")
        self.dense[row[often], term[often]] = w[often]
        order = np.argsort(term[~often], kind="stable")
        self.rows, self.weights = row[~often][order], w[~often][order].astype("float32")
        self.terms, self.from_ = np.unique(term[~often][order], return_index=True)
        self.to = np.append(self.from_[1:], len(order))

    def exact(self, i: int, other: _Vectors, j: int) -> float:
        a, b = slice(*self.start[i : i + 2]), slice(*other.start[j : j + 2])
        _, x, y = np.intersect1d(self.term[a], other.term[b], assume_unique=True, return_indices=True)
        return float(np.dot(self.w[a][x], other.w[b][y]))

    def near(self, other: _Vectors, threshold: float, micros: float | None) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the pairs at or above the threshold and close in time."""
        cos = self.dense @ other.dense.T
        _, x, y = np.intersect1d(self.terms, other.terms, assume_unique=True, return_indices=True)
        for a, b, c, d in zip(self.from_[x].tolist(), self.to[x].tolist(), other.from_[y].tolist(), other.to[y].tolist()):
            cos[self.rows[a:b, None], other.rows[c:d]] += self.weights[a:b, None] * other.weights[c:d]
        i, j = np.nonzero(cos >= threshold - NEAR)
        ok = self.key[i] != other.key[j]
        if micros is not None:
            ok &= (np.abs(self.at[i] - other.at[j]) <= micros) | self.free[i] | other.free[j]
        i, j = i[ok], j[ok]
        close = cos[i, j] < threshold + NEAR
        ok = np.ones(len(i), bool)
        ok[close] = [self.exact(p, other, q) >= threshold for p, q in zip(i[close].tolist(), j[close].tolist())]
        return self.key[i[ok]], other.key[j[ok]]


def similar_links(docs: DataFrame, idf: list[float], threshold: float, days: float = MAX_DAYS, times: DataFrame | None = None) -> DataFrame:
    """Edges ``(a, b)`` that join what pairs of similar documents close in time join; docs ``(key, at, free, ids, tf)`` are packed
    vectors, ``at`` in microseconds, free those without time, which meet all.

    A block are documents of one span of ``days``; it meets itself, the blocks of its span after it and those of the next span.
    ``times`` (at, free) are those of the documents, where they can be read without packing.
    """
    micros = days * 86_400_000_000
    span = F.floor(F.col("at") / F.lit(micros)).cast("bigint").alias("span")
    times = docs if times is None else times
    timed = docs.where(~F.col("free")).withColumn("span", span)
    crowd = cut(times.where(~F.col("free")).groupBy(span).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n")).where("n > 1"))
    here, last = crowd.withColumnRenamed("n", "here"), crowd.select((F.col("span") + 1).alias("span"), F.col("n").alias("last"))
    # as few rows as there are full blocks, whatever the number of spans
    timed = timed.join(F.broadcast(here), "span", "left").join(F.broadcast(last), "span", "left").fillna(1, ["here", "last"])
    timed = timed.withColumn("block", F.pmod(F.xxhash64("key"), F.col("here")).cast("int"))
    to = lambda span, n, own: F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(span.alias("span"), i.cast("int").alias("block"), F.lit(own).alias("other")))
    own = F.array(F.struct(F.col("span"), F.col("block"), F.lit(0).alias("other")))
    sent = timed.withColumn("to", F.concat(own, to(F.col("span"), F.col("block"), 1), to(F.col("span") - 1, F.col("last"), 1)))
    free = docs.where("free")
    if not times.where("free").isEmpty():
        # blocks of all documents, each of which meets the free ones
        n = max(1, -(-times.count() // BLOCK))
        block = F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
        away = F.lit(None).cast("bigint")
        every = docs.withColumn("to", F.array(F.struct(away.alias("span"), block.alias("block"), F.lit(0).alias("other"))))
        met = free.withColumn("to", to(away, F.lit(n), 1))
        columns = ["key", "at", "free", "ids", "tf", "to"]
        sent = sent.select(*columns).unionByName(every).unionByName(met)
    sent = sent.select(F.explode("to").alias("x"), "key", "at", "free", "ids", "tf").select("x.*", "key", "at", "free", "ids", "tf")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.sparkSession.sparkContext.defaultParallelism)
    sent = sent.withColumn("span", F.coalesce("span", F.lit(-(1 << 62)))).repartition(tasks, "span", "block").sortWithinPartitions("span", "block", "other")
    weights, high, wide = np.array(idf, "float64"), *TILE

    def joined(mine: list[_Vectors], cols: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not mine:  # a span without documents before one with some
            return
        many = _Vectors(cols, weights)
        found = [_forest(*v.near(many, threshold, micros)) for v in mine]
        a, b = _forest(*(np.concatenate([f[i] for f in found]) for i in (0, 1)))
        if len(a):
            yield pd.DataFrame({"a": a, "b": b})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = (g for part in parts for _, g in part.groupby(["span", "block"], sort=False))
        for _, group in groupby(pieces, lambda g: tuple(g[["span", "block"]].iloc[0])):
            own, mine, waiting = [], [], []  # the block's own rows come first, and meet themselves too
            for piece in group:
                own.append(piece[piece["other"] == 0])
                waiting.append(piece)
                if (piece["other"].iloc[-1] == 0) or sum(map(len, waiting)) < wide:
                    continue
                mine = mine or tiles(own)
                cols = pd.concat(waiting)
                for k in range(0, len(cols), wide):
                    yield from joined(mine, cols.iloc[k : k + wide])
                waiting = []
            if waiting:
                mine, cols = mine or tiles(own), pd.concat(waiting)
                for k in range(0, len(cols), wide):
                    yield from joined(mine, cols.iloc[k : k + wide])

    def tiles(own: list[pd.DataFrame]) -> list[_Vectors]:
        rows = pd.concat(own)
        return [_Vectors(rows.iloc[k : k + high], weights) for k in range(0, len(rows), high)]

    return sent.mapInPandas(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of the edges ``(a, b)`` but the roots, which are the smallest nodes of their components.

    Up to LOCAL_EDGES edges are joined in one task, more by large-star and small-star steps in turn until nothing changes;
    each round is checkpointed.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if bounded(edges, LOCAL_EDGES):
        return cut(edges.coalesce(1).mapInPandas(_joined, "node bigint, root bigint"))
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        near = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(near, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        nxt = cut(small.unionByName(near.select("a", F.col("m").alias("b"))).distinct())
        same = nxt.groupBy("a").count().where("count > 1").isEmpty() and nxt.join(nxt.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()
        if same:
            return nxt.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges = nxt


def event_id(members: Column) -> Column:
    """Id from the sorted addresses, titles and times of an event's members."""
    return F.concat(F.lit("evt-"), F.substring(F.sha1(F.array_join(F.array_sort(F.flatten(members)), "|")), 1, 12))


def event_ids(df: DataFrame, group: str, most: int = MOST_MEMBERS) -> DataFrame:
    """``(group, event_id, event_size)`` by the columns ``url, titulo, effective_at`` of a group's rows.

    The texts of up to ``most`` members are put together as a whole; a larger group's id comes from the digests of 1024
    parts of its texts, so none is gathered.
    """
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = df.select(group, F.array(text_of("url"), text_of("titulo"), text_of("effective_at")).alias("__m"))
    sizes = cut(rows.groupBy(group).agg(F.count("*").cast("int").alias("event_size")))
    large = sizes.where(F.col("event_size") > most).select(group)
    ids = rows.join(sizes.where(F.col("event_size") <= most).select(group), group, "left_semi").groupBy(group).agg(event_id(F.collect_list("__m")).alias("event_id"))
    if not large.isEmpty():
        each = rows.join(F.broadcast(large), group).select(group, F.explode("__m").alias("x")).withColumn("p", F.pmod(F.xxhash64("x"), F.lit(1024)))
        # equal texts are counted, so a part is as long as its different texts
        part = each.groupBy(group, "p", F.sha1("x").alias("x")).agg(F.count("*").alias("n")).groupBy(group, "p").agg(F.bit_xor(F.xxhash64("x", "n")).alias("a"), F.sum(F.xxhash64("n", "x") % 1_000_000_007).alias("b"))
        told = part.groupBy(group).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "p", "a", "b"))), "|").alias("t"))
        ids = ids.unionByName(told.select(group, F.concat(F.lit("evt-"), F.substring(F.sha1("t"), 1, 12)).alias("event_id")))
    return ids.join(sizes, group)


def _named(df: DataFrame, sizes: DataFrame) -> DataFrame:
    """The rows with their event's id and size by ``__root``; sizes (__root, event_size) are those of the events of several rows.

    The others' ids are made where they lie: only rows of events of several documents are put together.
    """
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    several = small(sizes.select("__root"), BROADCAST_ROWS)
    ids = cut(event_ids(df.select("__root", "url", "titulo", "effective_at").join(several, "__root", "left_semi"), "__root"))
    own = event_id(F.array(F.array(text_of("url"), text_of("titulo"), text_of("effective_at"))))
    out = df.join(small(ids, BROADCAST_ROWS // 4), "__root", "left")
    return out.withColumns({"event_id": F.coalesce("event_id", own), "event_size": F.coalesce("event_size", F.lit(1))}).drop("__root", "__at")


def cluster_news(df: DataFrame, threshold: float = THRESHOLD, days: float = MAX_DAYS, most_terms: int = MAX_TERMS) -> DataFrame:
    """Add ``event_id`` and ``event_size``: components of similar documents close in time; df has ``seq`` and ``effective_at``.

    Documents without words are events of their own.  Copies (same text and time) are one node.
    """
    df = df.withColumn("__at", dates.instant(F.col("effective_at")))
    content = document_text()
    rows = df.select("seq", F.unix_micros("__at").alias("at"), content.alias("content"))
    rows = store(rows.select("seq", "at", F.xxhash64("content", "at").alias("copy"), F.translate("content", "%$", "  ").alias("words")), "zstd")
    nodes = rows.groupBy("copy").agg(F.min("seq").alias("node"), F.count("*").alias("n")).where("n > 1").select("copy", "node")
    copies = cut(rows.select("copy", "seq").join(small(cut(nodes), BROADCAST_ROWS), "copy").where("seq <> node").select("seq", "node"))
    known, n = known_terms(grams.counted(rows), most_terms), rows.count()
    known = sorted(known.collect(), key=lambda r: (-r["df"], r["term"]))  # by frequency, for DENSE
    alone = rows.join(small(copies.select("seq"), BROADCAST_ROWS), "seq", "left_anti").select(F.col("seq").alias("key"), F.coalesce("at", F.lit(0)).alias("at"), F.col("at").isNull().alias("free"), "words")
    docs = grams.packed(alone, [r["term"] for r in known], kept=("key", "at", "free")).where("length(ids) > 0")
    roots = components(similar_links(docs, [log((1 + n) / (1 + r["df"])) + 1 for r in known], threshold, days, alone))
    moved = copies.join(roots, copies["node"] == roots["node"], "left").select("seq", F.coalesce("root", copies["node"]).alias("__root"))
    moved = cut(moved.unionByName(roots.select(F.col("node").alias("seq"), F.col("root").alias("__root"))))
    out = df.join(small(moved, BROADCAST_ROWS), "seq", "left").withColumn("__root", F.coalesce("__root", "seq"))
    members = cut(moved.select("__root").unionByName(moved.select("__root").distinct()).groupBy("__root").agg(F.count("*").cast("int").alias("event_size")))
    return _named(out, members)


def dominant(df: DataFrame, group: str, value: Column, name: str) -> DataFrame:
    """``(group, name)``: most frequent value of each group, of equally frequent the one seen first by ``seq``."""
    rows = df.select(group, value.alias("__v"), "seq").where("__v is not null")
    counts = rows.groupBy(group, "__v").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    return counts.groupBy(group).agg(F.max_by("__v", F.struct("n", -F.col("first"), "__v")).alias(name))


def representative(df: DataFrame) -> DataFrame:
    """The document that stands for each event: by stress, lengths of title and text and time, then by arrival."""
    at = F.unix_micros(dates.instant(F.col("effective_at")))
    latest = df.groupBy("event_id").agg(F.max(at).alias("__latest"))
    short = lambda c, most, weight: F.least(F.length(F.coalesce(F.col(c), F.lit(""))), F.lit(most)) / most * weight
    score = F.coalesce(F.col("stress_score").cast("double"), F.lit(0.0)) * 0.35 + short("titulo", 180, 20.0) + short("texto", 3000, 25.0)
    score = score + F.coalesce(at / F.col("__latest"), F.lit(0.0)) * 20.0
    rows = df.join(latest, "event_id").withColumn("__score", score)
    best = F.max_by(F.struct("titulo", "fuente", "url", "tono_consolidado", "seq"), F.struct("__score", -F.col("seq"))).alias("r")
    return rows.groupBy("event_id").agg(best).select("event_id", "r.*")


def summarize_events(df: DataFrame) -> DataFrame:
    """One row per event of a clustered table, in 14 columns, most sources and documents first."""
    source = text.missing(F.trim("fuente"))
    stress = F.coalesce(F.col("stress_score").cast("double"), F.lit(0.0))
    sums = df.groupBy("event_id").agg(
        F.count("*").cast("int").alias("documents"), F.array_sort(F.collect_set(source)).alias("__sources"), F.max(dates.instant(F.col("effective_at"))).alias("__at"),
        numbers.round2(F.avg(stress)).alias("average_stress"), numbers.round2(F.max(stress)).alias("maximum_stress"))
    lists = lambda c: df.select("event_id", F.explode(c).alias("__x"), "seq")
    rep = representative(df).select("event_id", F.trim("titulo").alias("event_title"), F.trim("fuente").alias("representative_source"), F.trim("url").alias("representative_url"), F.trim("tono_consolidado").alias("representative_tone"))
    out = sums.join(rep, "event_id")
    for d in (
        dominant(df, "event_id", text.missing(F.trim("tema")), "dominant_topic"),
        dominant(lists("indicadores"), "event_id", F.col("__x"), "dominant_indicator"),
        dominant(lists("entidades"), "event_id", F.col("__x"), "dominant_entity"),
    ):
        out = out.join(d, "event_id", "left")
    out = out.select(
        "event_id", "event_title", "documents", F.size("__sources").alias("unique_sources"), F.to_json("__sources").alias("sources"), dates.iso(F.col("__at")).alias("effective_at"),
        "average_stress", "maximum_stress", "dominant_topic", "dominant_indicator", "dominant_entity", "representative_source", "representative_url", "representative_tone")
    return out.orderBy(F.desc_nulls_last("unique_sources"), F.desc_nulls_last("documents"), F.desc_nulls_last("maximum_stress"), F.desc_nulls_last("effective_at"), "event_id")


def event_payload(events: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: documents, events, how much fewer in percent, events of several sources."""
    n = documents.agg(F.count("*").alias("documents"))
    sums = events.agg(F.count("*").alias("events"), F.count_if(F.col("unique_sources") >= 2).alias("multi_source_events"), F.coalesce(F.max("documents"), F.lit(0)).alias("largest_event"))
    ratio = F.when(F.col("documents") > 0, numbers.round2((1 - F.col("events") / F.col("documents")) * 100)).otherwise(0.0)
    return sums.crossJoin(F.broadcast(n)).select("documents", "events", ratio.alias("compression_ratio"), "multi_source_events", "largest_event")
