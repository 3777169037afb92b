"""Lines that stand in very many documents of one source, and texts without them.

A line's key leaves out case, digits, white space and all characters that aren't ASCII: a wrong encoding leaves ASCII
alone, so a damaged line has the key of the line it was, also where white space was damaged.  Lines that differ in
accents only have one key.  Lines whose letters are mostly not ASCII keep all their characters.  Only (source, key) hashes are shuffled, counted in
part before; the frequent keys of each source, of which there can only be few, go back to its texts in one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quipu.llm.common import cut, name_key, null_if_blank, small

LEAST_DOCUMENTS = 15
LEAST_SHARE = 0.05
#: Sources (with their frequent keys) that are broadcast; more are joined by source.
BROADCAST_ROWS = 100_000


def lines(text: Column) -> Column:
    """Lines of a text, what lies between line feeds; a carriage return at the end is white space."""
    return F.split(text, "\n")


def line_key(line: Column) -> Column:
    """64-bit key of a line; null for a line of white space."""

    def keyed(rest: Column) -> Column:
        foreign, plain = F.regexp_replace(rest, r"[\x00-\x7f]+", ""), F.regexp_replace(rest, r"[^\x21-\x7e]+", "")
        own = F.length(F.regexp_replace(rest, "[^a-z]+", ""))
        # damage makes more characters of a letter, but of few letters
        other = (F.length(F.regexp_replace(foreign, r"[^\p{L}]+", "")) > own) | (own == 0)
        return F.when((foreign != "") & other, F.xxhash64(F.lit("b"), rest)).otherwise(F.xxhash64(F.lit("a"), plain))

    rest = F.regexp_replace(F.lower(line), r"[\s\p{Z}\d]+", "")
    key = F.element_at(F.transform(F.array(rest), keyed), 1)
    return F.when(F.regexp_replace(line, r"[\s\p{Z}]+", "") != "", key)


def _keyed(items: DataFrame, text: str, source: str, key: str) -> DataFrame:
    kept = items.select(F.col(key), name_key(null_if_blank(F.col(source))).alias("source"), F.col(text).alias("text")).where("source is not null")
    return kept.select(key, F.xxhash64("source").alias("source"), F.transform(lines(F.col("text")), line_key).alias("keys"))


def frequent_lines(items: DataFrame, text: str, source: str, key: str, least: int = LEAST_DOCUMENTS, share: float = LEAST_SHARE) -> DataFrame:
    """``(source, lines)``: hashes of lines in at least ``least`` documents and ``share`` of all documents of their source.

    Documents without a source (null, blank or nan) are left out; those without text count for the share.  A document
    (``key``) that comes several times counts once.
    """
    keyed = _keyed(items, text, source, key)
    each = keyed.select(key, "source", F.explode(F.array_distinct(F.filter("keys", lambda x: x.isNotNull()))).alias("line"))
    documents = items.select(F.col(key), F.xxhash64(name_key(null_if_blank(F.col(source)))).alias("source"), name_key(null_if_blank(F.col(source))).isNotNull().alias("named")).where("named").drop("named")
    rows, distinct = items.agg(F.count(key), F.countDistinct(key)).first()
    if rows != distinct:
        each, documents = each.distinct(), documents.distinct()
    counts = each.groupBy("source", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    sizes = documents.groupBy("source").agg(F.count("*").alias("documents"))
    found = counts.join(small(cut(sizes), BROADCAST_ROWS), "source").where(F.col("n") >= share * F.col("documents"))
    return found.groupBy("source").agg(F.collect_list("line").alias("lines"))


def repeated_lines(items: DataFrame, text: str = "texto", source: str = "fuente", key: str = "seq") -> DataFrame:
    """``(key, linea)``: number, from 1, of each line that is frequent in its source."""
    found = small(cut(frequent_lines(items, text, source, key)), BROADCAST_ROWS)
    rows = _keyed(items, text, source, key).join(found, "source")
    numbers = F.filter(F.transform("keys", lambda x, i: F.when(F.array_contains("lines", x), (i + 1).cast("int"))), lambda x: x.isNotNull())
    return rows.select(key, F.explode(numbers).alias("linea")).distinct()


def without_lines(items: DataFrame, text: str = "texto", source: str = "fuente", key: str = "seq") -> DataFrame:
    """``(key, text)`` with the frequent lines gone and all else as it was; a null text stays null.

    Each text is rebuilt where it lies.
    """
    found = small(cut(frequent_lines(items, text, source, key)), BROADCAST_ROWS)
    rows = items.select(F.col(key), F.col(text).alias("__t"), F.xxhash64(name_key(null_if_blank(F.col(source)))).alias("source"), name_key(null_if_blank(F.col(source))).isNotNull().alias("named"))
    rows = rows.withColumn("source", F.when(F.col("named"), F.col("source"))).join(found, "source", "left")
    split = lines(F.col("__t"))
    gone = lambda x: F.coalesce(F.array_contains("lines", line_key(x)), F.lit(False))
    some = F.col("lines").isNotNull() & F.exists(split, gone)
    return rows.select(key, F.when(some, F.array_join(F.filter(split, lambda x: ~gone(x)), "\n")).otherwise(F.col("__t")).alias(text))
