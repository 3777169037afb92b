"""Annotation batches: quotas, sampling, progress, pages, updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quipu.functions import numbers, text
from quipu.operators.corpus import best_for_annotation, keep_first, repair_strings, select_existing
from quipu.operators.lineage import small

LABELS = ["positivo", "neutral", "negativo"]


def hash_order(key: str, seed: int) -> Column:
    """Portable random order: the same in every engine that has SHA-256."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256)


def quotas(counts: DataFrame, size: int) -> DataFrame:
    """``(grupo, n, quota)`` by largest remainders of ``size``; equal remainders by group name.  counts is (grupo, n)."""
    total = counts.agg(F.sum("n").alias("total"))
    rows = counts.crossJoin(F.broadcast(total)).withColumn("exact", F.col("n") * F.lit(size) / F.col("total"))
    rows = rows.withColumn("base", F.least("n", F.floor("exact"))).withColumn("rest", F.lit(size) - F.sum("base").over(Window.partitionBy()))
    open_ = F.col("base") < F.col("n")
    order = Window.partitionBy().orderBy(F.desc(open_), F.desc(F.col("exact") - F.floor("exact")), "grupo")
    more = (F.row_number().over(order) <= F.col("rest")) & open_
    return rows.select("grupo", "n", (F.col("base") + more.cast("int")).alias("quota"))


def hash_rank(df: DataFrame, group: str, key: str, seed: int) -> DataFrame:
    """Add ``__n``, the row's place (from 1) in the hash order of its group, and ``__of``, the group's rows.

    Hash order is cut into 4096 cells that are counted first; only within a cell are rows ranked, so no task sorts a group.
    """
    rows = df.withColumn("__h", hash_order(key, seed)).withColumn("__c", F.substring("__h", 1, 3))
    counts = rows.groupBy(group, "__c").agg(F.count("*").alias("__k"))
    span = Window.partitionBy(group)
    before = counts.select(F.col(group).alias("__g"), F.col("__c").alias("__d"), (F.sum("__k").over(span.orderBy("__c")) - F.col("__k")).alias("__b"), F.sum("__k").over(span).alias("__of"))
    place = F.row_number().over(Window.partitionBy(group, "__c").orderBy("__h", key))
    ranked = rows.withColumn("__r", place).join(before, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__c") == F.col("__d")))
    return ranked.withColumn("__n", F.col("__b") + F.col("__r")).drop("__h", "__c", "__g", "__d", "__b", "__r")


def quota_sample(df: DataFrame, group: str, key: str, size: int, seed: int = 42) -> DataFrame:
    """As many rows of each group as its quota, in hash order; too small a table is taken whole."""
    counts = df.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("grupo")).agg(F.count("*").alias("n"))
    wanted = quotas(counts, size).select(F.col("grupo").alias("__q"), "quota")
    rows = hash_rank(df.where(F.col(group).isNotNull()), group, key, seed).join(small(wanted, 100_000), F.col(group) == F.col("__q"))
    return rows.where("__n <= quota").drop("__n", "__of", "__q", "quota")


def stratified_split(df: DataFrame, label: str, key: str, shares: tuple[float, float] = (0.70, 0.15), seed: int = 42) -> DataFrame:
    """Add ``split``: train, validation or test, each label divided alike, in hash order."""
    rows = hash_rank(df, label, key, seed)
    place = (F.col("__n") - 1) / F.col("__of")
    return rows.withColumn("split", F.when(place < shares[0], "train").when(place < shares[0] + shares[1], "validation").otherwise("test")).drop("__n", "__of")


def build_batch(df: DataFrame, size: int = 200, title: int = 20, body: int = 150, seed: int = 42) -> DataFrame:
    """A batch to annotate: long enough records (the first by ``seq`` of each id) by source quota, topped up from the rest, with ids, in hash order."""
    rows = keep_first(df.where((F.length("titulo") >= title) & (F.length("texto") >= body)), [F.col("id")], [F.col("seq")])
    first = quota_sample(rows, "fuente", "id", size, seed)
    lacks = first.agg((F.lit(size) - F.count("*")).alias("lacks"))
    rest = rows.join(first.select("id"), "id", "left_anti").orderBy(hash_order("id", seed), "id").limit(size)
    more = rest.withColumn("__n", F.row_number().over(Window.orderBy(hash_order("id", seed), "id"))).crossJoin(F.broadcast(lacks)).where("__n <= lacks").drop("__n", "lacks")
    batch = first.unionByName(more).withColumn("annotation_id", text.annotation_id(F.col("id")))
    return select_existing(batch, ["annotation_id", "id", "titulo", "texto", "fuente", "fecha", "url"]).orderBy(hash_order("annotation_id", seed))


def prepare_corpus(df: DataFrame) -> DataFrame:
    """Repaired texts, best record of each title, the columns annotation uses."""
    fixed = repair_strings(df, [c for c in ("titulo", "texto", "fuente", "department", "scope") if c in df.columns])
    return select_existing(best_for_annotation(fixed), ["id", "titulo", "texto", "fuente", "fecha", "url", "economic_score", "source_weight"])


def _label() -> Column:
    return F.lower(F.trim("sentimiento"))


def state(df: DataFrame, which: str) -> DataFrame:
    """Rows that are pending, annotated, doubtful or all.  Annotated is a known label in any case."""
    known = F.coalesce(_label().isin(LABELS), F.lit(False))
    return {"all": df, "annotated": df.where(known), "pending": df.where(~known), "doubtful": df.where(F.coalesce(F.col("duda"), F.lit(0)) == 1)}[which]


def status(df: DataFrame) -> DataFrame:
    """One row: total, annotated, pending, doubtful, progress in percent, counts per label."""
    known = F.coalesce(_label().isin(LABELS), F.lit(False))
    sums = df.agg(F.count("*").alias("total"), F.count_if(known).alias("annotated"), F.count_if(F.coalesce(F.col("duda"), F.lit(0)) == 1).alias("doubtful"), *[F.count_if(_label() == x).alias(x) for x in LABELS])
    return sums.select("total", "annotated", (F.col("total") - F.col("annotated")).alias("pending"), "doubtful", numbers.percentage(F.col("annotated"), F.col("total")).alias("progress"), *LABELS)


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of rows, 1 to 200 of them."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit is 1 to 200, offset 0 or more")
    return df.orderBy(*order).offset(offset).limit(limit)


def update(df: DataFrame, key: str, value: str, changes: dict[str, object]) -> DataFrame:
    """The table with columns of one key's rows set to new values."""
    hit = F.col(key) == value
    return df.withColumns({c: F.when(hit, F.lit(v).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in changes.items()})


def clear(df: DataFrame, key: str, value: str) -> DataFrame:
    return update(df, key, value, {c: None for c in ("sentimiento", "anotador", "fecha_anotacion", "duda", "comentario") if c in df.columns})
