"""Temporal policy: what time a record counts under, how trustworthy that is, and whether it is recent."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quipu.functions import dates, numbers


@dataclass(frozen=True)
class TemporalPolicy:
    recent_hours: float = 72.0
    future_tolerance_hours: float = 6.0


def temporal_columns(df: DataFrame, now: Column, policy: TemporalPolicy = TemporalPolicy(), published: Column | None = None, collected: Column | None = None) -> DataFrame:
    """Add ``published_at, collected_at_normalized, effective_at, age_hours, date_quality, is_recent, temporal_exclusion_reason``.

    A published time more than the tolerance after ``now`` is invalid; the collection time then counts.  Recency uses the
    exact age, ``age_hours`` is rounded.  Unreadable and null times count as missing.
    """
    published = dates.instant(F.col("fecha")) if published is None else published
    collected = dates.instant(F.col("collected_at")) if collected is None else collected
    df = df.withColumns({"__p": published, "__c": collected})
    future = F.coalesce(F.unix_micros("__p") > F.unix_micros(now) + F.lit(int(policy.future_tolerance_hours * 3.6e9)), F.lit(False))
    valid = F.col("__p").isNotNull() & ~future
    df = df.withColumns({"__f": future, "__e": F.when(valid, F.col("__p")).otherwise(F.col("__c"))})
    df = df.withColumn("__a", dates.age_hours(now, F.col("__e")))
    quality = F.when(F.col("__f"), "invalid_future").when(F.col("__p").isNotNull(), "published").when(F.col("__c").isNotNull(), "inferred_collected").otherwise("missing")
    reason = (
        F.when(F.col("__f"), "future_date").when(F.col("__e").isNull(), "missing_date").when(F.col("__a") < 0, "future_effective_date")
        .when(F.col("__a") > policy.recent_hours, "outside_operational_window").otherwise("recent")
    )
    return df.withColumns({
        "published_at": dates.iso(F.col("__p")), "collected_at_normalized": dates.iso(F.col("__c")), "effective_at": dates.iso(F.col("__e")),
        "age_hours": numbers.round2(F.col("__a")), "date_quality": quality, "is_recent": reason == "recent", "temporal_exclusion_reason": reason,
    }).drop("__p", "__c", "__f", "__e", "__a")


# Columns that may tell when a document counts, best first.
DATE_COLUMNS = ["effective_at", "published_at", "fecha", "collected_at"]


def date_column(df: DataFrame, candidates: list[str] = DATE_COLUMNS) -> str | None:
    """The first candidate with a readable time in any row, for the table as a whole; None if there is none."""
    have = [c for c in candidates if c in df.columns]
    if not have:
        return None
    counts = df.agg(*[F.count(dates.instant(F.col(c).cast("string"))).alias(c) for c in have]).first()
    return next((c for c in have if counts[c]), None)


def operational(df: DataFrame) -> DataFrame:
    """Recent rows, latest first, then by stress; missing stress last."""
    return df.where("is_recent").orderBy(F.desc_nulls_last("effective_at"), F.desc_nulls_last("stress_score"))


def temporal_audit(df: DataFrame) -> DataFrame:
    """``(measure, value, documents)``: counts by date quality and by exclusion reason, missing values too."""
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in ("date_quality", "temporal_exclusion_reason")]))
    return df.select(pairs).groupBy("measure", "value").agg(F.count("*").alias("documents"))


def period(age: Column, hours: float) -> Column:
    """``current`` up to the window, ``previous`` up to twice it, else null."""
    return F.when((age >= 0) & (age <= hours), "current").when((age > hours) & (age <= 2 * hours), "previous")


def in_range(df: DataFrame, at: Column, first: Column, last: Column) -> tuple[DataFrame, DataFrame]:
    """Rows within a range of times, both ends included, and the rest; rows without time are in neither."""
    return df.where(at.between(first, last)), df.where(~at.between(first, last))
