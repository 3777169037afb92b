"""Corpus operators: merging, cleaning, duplicates of the reference kinds, source metadata.

Duplicates are dropped by windows over their keys; ``seq`` is the order of arrival and settles ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quipu.functions import lexicon, numbers, text
from quipu.operators.lineage import bounded, cut, small, store

#: Most rows of a dimension table that is broadcast (about 200 bytes each).
BROADCAST_ROWS = 100_000
#: Chosen rows of two numbers (about 40 bytes each) that are broadcast to where the texts lie; of more, the texts move, once.
KEPT_ROWS = 2_000_000
#: Undecided rows (24 bytes each) that one task goes through in order.
LOCAL_ROWS = 2_000_000

# Defaults of missing columns.
DEFAULTS = {"economic_score": 0, "source_type": "unknown", "department": "No especificado", "scope": "unknown", "source_weight": 0.5}
COLUMNS = ["id", "titulo", "texto", "fuente", "fecha", "url", "economic_score", "source_type", "department", "scope", "source_weight", "collected_at"]


def keep_first(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key by the order; nulls are one key.

    Only the first row is asked for, so Spark keeps one row per key and input partition before it shuffles (window group
    limit): a key that holds a third of all rows sends as few rows as any other.
    """
    span = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(span)).where("__n = 1").drop("__n")


def only(df: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``seq``, which is unique, is in ``kept``: choices are made on keys alone, so wide rows move at most once."""
    return df.join(kept.select("seq"), "seq", "left_semi")


def with_defaults(df: DataFrame) -> DataFrame:
    """Missing columns added, blank texts and unreadable numbers replaced by the defaults."""
    for c in COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    fill = {c: F.coalesce(F.nullif(text.normalize_space(F.col(c)), F.lit("")), F.lit(d)) for c, d in DEFAULTS.items() if isinstance(d, str)}
    fill["economic_score"] = numbers.number(F.col("economic_score"), 0.0).cast("int")
    fill["source_weight"] = numbers.number(F.col("source_weight"), 0.5, 0.0, 1.0)
    return df.withColumns(fill | {c: text.normalize_space(F.col(c)) for c in ("titulo", "texto", "fuente", "fecha")} | {"url": text.normalize_url(F.col("url"))})


def _quality() -> list[Column]:
    return [F.length("texto"), F.col("economic_score"), F.length("titulo"), F.col("source_weight")]


def _collected(previous: DataFrame, current: DataFrame, collected_at: str, title: int, body: int) -> DataFrame:
    """Union of two corpora, without records of a short title or text."""
    fill = F.coalesce(text.missing(F.col("collected_at")), F.lit(collected_at))
    rows = with_defaults(previous).unionByName(with_defaults(current).withColumn("collected_at", fill), allowMissingColumns=True)
    return rows.where((F.length("titulo") >= title) & (F.length("texto") >= body))


def _best(rows: DataFrame) -> DataFrame:
    """``(seq)`` of the best record of each address, then of each title; texts are read once and only hashes of the keys kept."""
    slim = rows.select("seq", (F.col("url") != "").alias("has"), F.xxhash64("url").alias("url"), F.xxhash64(text.title_key(F.col("titulo"))).alias("key"), *[c.alias(f"q{i}") for i, c in enumerate(_quality())])
    slim = store(slim)
    order = [F.desc("q0"), F.desc("q1"), F.desc("q2"), F.desc("q3"), F.asc("seq")]
    placed = keep_first(slim.where("has"), [F.col("url")], order).unionByName(slim.where("not has"))
    return cut(keep_first(placed, [F.col("key")], [F.desc("has"), *order]).select("seq"))


def _identified(rows: DataFrame) -> DataFrame:
    """With an id, and wrong encodings undone in all string columns."""
    made = text.document_id(F.col("fuente"), F.col("url"), F.col("titulo"))
    rows = rows.withColumn("id", F.coalesce(text.missing(F.col("id")), made))
    return repair_strings(rows, string_columns(rows))


def _substantial(df: DataFrame, title: int, body: int, least_score: int) -> DataFrame:
    """``(seq, url, key, score_recalculado)`` of records of substance, keys as hashes; texts are read once."""
    score = text.economic_score(F.concat_ws(" ", "titulo", "texto")).alias("score_recalculado")
    slim = df.where((F.length("titulo") >= title) & (F.length("texto") >= body))
    slim = slim.select("seq", F.xxhash64("url").alias("url"), F.xxhash64(text.title_key(F.col("titulo"))).alias("key"), text.excluded_title(F.col("titulo")).alias("out"), score)
    return store(slim).where(~F.col("out") & (F.col("score_recalculado") >= least_score)).drop("out")


def _first(slim: DataFrame) -> DataFrame:
    """``(seq, score_recalculado)`` of the first of each address, then of each title."""
    slim = keep_first(keep_first(slim, [F.col("url")], [F.col("seq")]), [F.col("key")], [F.col("seq")])
    return small(cut(slim.select("seq", "score_recalculado")), KEPT_ROWS)


def merge_corpus(previous: DataFrame, current: DataFrame, collected_at: str, title: int = 10, body: int = 100) -> DataFrame:
    """Union of two corpora with ``seq``, best record of each address, then of each title; records without address compete by title only.

    Records with a short title or text are dropped.  ``collected_at`` fills the current records that have none.  Wrong
    encodings are undone in all string columns of the result, as in the reference after duplicates and ids.
    """
    rows = _collected(previous, current, collected_at, title, body)
    return _identified(only(rows, small(_best(rows), KEPT_ROWS)))


def clean_corpus(df: DataFrame, title: int = 20, body: int = 250, least_score: int = 2) -> DataFrame:
    """Records of substance: long enough, not an excluded title, economically relevant; first of each address, then of each title.

    All records without address are one address.
    """
    return df.drop("score_recalculado").join(_first(_substantial(df, title, body, least_score)), "seq")


def merge_and_clean(previous: DataFrame, current: DataFrame, collected_at: str, title: int = 10, body: int = 100, clean_title: int = 20, clean_body: int = 250, least_score: int = 2) -> DataFrame:
    """``clean_corpus`` of ``merge_corpus``; both choose on keys alone before the records with their texts are taken once.

    The normalised records are stored: three passes read them, and each would normalise a text several times over.
    """
    rows = store(_collected(previous, current, collected_at, title, body), "zstd")
    kept = _best(rows)
    whole = _identified(rows)
    chosen = _first(only(_substantial(whole, clean_title, clean_body, least_score), small(kept, KEPT_ROWS)))
    return whole.drop("score_recalculado").join(chosen, "seq")


def _in_order(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows (seq, u, t) that the rule of ``greedy_deduplicate`` keeps, in one pass."""
    frames = list(parts)
    rows = pd.concat(frames, ignore_index=True).sort_values("seq") if frames else pd.DataFrame({"seq": [], "u": [], "t": []})
    urls, titles, kept = set(), set(), []
    for seq, u, t in zip(rows["seq"], rows["u"], rows["t"]):
        if u not in urls and t not in titles:
            urls.add(u)
            titles.add(t)
            kept.append(seq)
    yield pd.DataFrame({"seq": kept}, dtype="int64")


def greedy_deduplicate(df: DataFrame, local: int = LOCAL_ROWS) -> DataFrame:
    """Rows kept in order of arrival unless their address or title was kept before; dropped rows block nothing.

    A row is kept once no earlier undecided or kept row shares a key with it, and dropped once a kept one does.  Rounds of
    that over all tasks leave fewer and fewer undecided; once they are at most ``local`` rows of three numbers, one task goes
    through them in order, so long chains end too.  Blank keys are keys like others.
    """
    rows = df.select("seq", F.xxhash64(text.normalize_url(F.col("url"))).alias("u"), F.xxhash64(text.simple_title_key(F.col("titulo"))).alias("t"))
    # rows that share a key with nobody need no rounds
    alone = cut(rows.withColumns({"nu": F.count("*").over(Window.partitionBy("u")), "nt": F.count("*").over(Window.partitionBy("t"))}))
    kept = alone.where("nu = 1 and nt = 1").select("seq")
    undecided = alone.where("nu > 1 or nt > 1").select("seq", "u", "t")
    while not bounded(undecided, local):
        first = undecided.groupBy("u").agg(F.min("seq").alias("fu")), undecided.groupBy("t").agg(F.min("seq").alias("ft"))
        now = cut(undecided.join(first[0], "u").join(first[1], "t").where("seq = fu and seq = ft").select("seq", "u", "t"))
        kept = kept.unionByName(now.select("seq"))
        undecided = cut(undecided.join(now.select("u"), "u", "left_anti").join(now.select("t"), "t", "left_anti"))
    return only(df, kept.unionByName(undecided.coalesce(1).mapInPandas(_in_order, "seq bigint")))


def best_for_annotation(df: DataFrame) -> DataFrame:
    """Best record of each title by source weight and economic score; titles are compared in their annotation form."""
    order = [F.desc_nulls_last("source_weight"), F.desc_nulls_last("economic_score"), F.asc("seq")]
    return keep_first(df, [text.annotation_title_key(F.col("titulo"))], order)


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows added to a table, replacing those of the same key; columns may differ.  Keys are unique in each of the two."""
    both = table.withColumn("__old", F.lit(1)).unionByName(rows.withColumn("__old", F.lit(0)), allowMissingColumns=True)
    return keep_first(both, [F.col(key)], [F.col("__old")]).drop("__old")


def _unknown(c: str, word: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit("")).isin("", word, "nan")


def backfill_metadata(df: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Type, department, scope and weight from the catalogue for rows that lack one of the first three; source names are
    compared without case and outer space.  Repeated names of the catalogue: the first by id counts."""
    names = catalogue.where("name is not null").groupBy(text.normalize(F.col("name")).alias("__name"))
    meta = names.agg(F.min_by(F.struct("source_type", "department", "scope", "source_weight"), "fuente_id").alias("__m"))
    rows = df.withColumn("__name", text.normalize(F.col("fuente"))).join(small(meta, BROADCAST_ROWS), "__name", "left")
    lacks = _unknown("source_type", "unknown") | _unknown("department", "No especificado") | _unknown("scope", "unknown")
    use = F.col("__m").isNotNull() & lacks
    return rows.withColumns({c: F.when(use, F.col(f"__m.{c}")).otherwise(F.col(c)) for c in ("source_type", "department", "scope", "source_weight")}).drop("__m", "__name")


def unknown_sources(df: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``(fuente)``: distinct sources that the catalogue doesn't name."""
    known = catalogue.select(text.normalize(F.col("name")).alias("__name")).distinct()
    return df.withColumn("__name", text.normalize(F.col("fuente"))).join(small(known, BROADCAST_ROWS), "__name", "left_anti").select("fuente").distinct()


def string_columns(df: DataFrame) -> list[str]:
    return [c for c, kind in df.dtypes if kind == "string"]


def repair_strings(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: text.repair_mojibake(F.col(c)) for c in columns})


def select_existing(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that there are."""
    return df.select(*[c for c in wanted if c in df.columns])


def require_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The table, or a ValueError that names the columns it lacks."""
    lacks = sorted(set(wanted) - set(df.columns))
    if lacks:
        raise ValueError("missing columns: " + ", ".join(lacks))
    return df


def resolve_column(columns: list[str], candidates: list[str]) -> str:
    """The first candidate that is a column, whatever the case."""
    by = {c.lower().strip(): c for c in columns}
    for c in candidates:
        if c.lower() in by:
            return by[c.lower()]
    raise ValueError("none of these is a column: " + ", ".join(candidates))


def cap_per_source(df: DataFrame, most: int, source: str = "fuente") -> DataFrame:
    """The first ``most`` rows of each source in order of arrival."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(source).orderBy("seq"))).where(F.col("__n") <= most).drop("__n")


def relevant(df: DataFrame, terms: list[str] = lexicon.COLLECT_TERMS, least: int = 2, body: int = 250) -> DataFrame:
    """Collected pages worth keeping: a title that isn't an index page's, enough text, enough economic terms."""
    score = text.economic_score(F.concat_ws(" ", "titulo", "texto"), terms)
    rows = df.where((text.normalize_space(F.col("titulo")) != "") & ~text.generic_title(F.col("titulo")) & (F.length("texto") >= body))
    return rows.withColumn("economic_score", score).where(F.col("economic_score") >= least)


def find(df: DataFrame, key: str, value: object) -> DataFrame:
    """The rows of one key; none if there is no such key."""
    return df.where(F.col(key) == F.lit(value))


def clean_order(df: DataFrame) -> DataFrame:
    """Most relevant first, then by source, title and arrival."""
    return df.orderBy(F.desc("score_recalculado"), "fuente", "titulo", "seq")


def merge_order(df: DataFrame) -> DataFrame:
    """Latest collected first, then by source, title and arrival."""
    return df.orderBy(F.desc_nulls_last("collected_at"), "fuente", "titulo", "seq")


def collected_order(df: DataFrame) -> DataFrame:
    """By source, there most relevant first, then by title and arrival."""
    return df.orderBy("fuente", F.desc_nulls_last("economic_score"), "titulo", "seq")


def drop_incomplete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that have a value in every one of the columns."""
    return df.dropna(subset=columns)
