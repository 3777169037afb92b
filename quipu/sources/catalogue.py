"""The source catalogue: loading, checking, choosing sources, reports by source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quipu.functions import text
from quipu.operators.lineage import small

# What a source may be.
SOURCE_TYPES = ["official", "newspaper", "television", "agency", "business", "regional"]
STATUSES = ["active", "pending_validation", "pending_discovery", "inactive"]
METHODS = ["rss", "listing", "wordpress", "generic", "sitemap", "discovery"]
REQUIRED = ["id", "name", "source_type", "department", "scope", "status"]


def load(spark: SparkSession, path: str, entries: str = "sources") -> DataFrame:
    """Sources of a JSON document that lists them under ``entries``."""
    return spark.read.option("multiLine", True).json(path).select(F.explode(entries).alias("s")).select("s.*")


def violations(catalogue: DataFrame, key: str = "id") -> DataFrame:
    """``(id, rule)`` of every rule a source breaks; rules about columns the catalogue lacks aren't checked."""
    have, c = set(catalogue.columns), F.col
    blank = lambda x: F.coalesce(F.trim(c(x).cast("string")), F.lit("")) == ""
    rules = [(f"missing_{x}", blank(x)) for x in REQUIRED if x in have]
    rules += [(f"unknown_{x}", ~blank(x) & ~c(x).isin(ok)) for x, ok in (("source_type", SOURCE_TYPES), ("status", STATUSES), ("collection_method", METHODS)) if x in have]
    if "source_weight" in have:
        rules.append(("weight_out_of_range", c("source_weight").isNull() | ~c("source_weight").between(0.0, 1.0)))
    if "max_documents" in have:
        rules.append(("max_documents_not_positive", c("max_documents").isNull() | (c("max_documents") <= 0)))
    if "homepage" in have:
        rules.append(("no_homepage", (c("status") == "active" if "status" in have else F.lit(True)) & blank("homepage")))
    each = F.filter(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules]), lambda x: x.isNotNull())
    out = catalogue.select(c(key).cast("string").alias("id"), F.explode(each).alias("rule"))
    for name, k in (("duplicate_id", c(key).cast("string")), ("duplicate_name", text.normalize(c("name")))):
        twice = catalogue.groupBy(k.alias("k")).agg(F.count("*").alias("n")).where("n > 1 and k is not null").select("k")
        rows = catalogue.select(c(key).cast("string").alias("id"), k.alias("k")).join(small(twice, 100_000), "k")
        out = out.unionByName(rows.select("id", F.lit(name).alias("rule")))
    return out


def runnable(catalogue: DataFrame, include_pending: bool = False) -> DataFrame:
    """Sources that can be collected: active (or awaiting validation) with a homepage."""
    ok = ["active"] + (["pending_validation"] if include_pending else [])
    return catalogue.where(F.col("status").isin(ok) & (F.coalesce(F.trim("homepage"), F.lit("")) != ""))


def collector_of(method: str = "collection_method") -> Column:
    """Which collector a source needs: rss, listing, or null where there is none."""
    return F.when(F.col(method) == "rss", "rss").when(F.col(method).isin("listing", "wordpress", "generic"), "listing")


def collection_report(catalogue: DataFrame, items: DataFrame) -> DataFrame:
    """``(name, documents)`` of every source of the catalogue, also those without documents."""
    counts = items.groupBy(text.normalize(F.col("fuente")).alias("__n")).agg(F.count("*").alias("documents"))
    names = catalogue.where("name is not null").select("name", text.normalize(F.col("name")).alias("__n")).distinct()
    return names.join(counts, "__n", "left").select("name", F.coalesce("documents", F.lit(0)).alias("documents"))
