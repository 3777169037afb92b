"""Relevance rankings of labels, over documents and over events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quipu.functions import numbers, text
from quipu.operators.temporal import period


@dataclass(frozen=True)
class RankingWeights:
    frequency: float = 0.35
    source_diversity: float = 0.20
    recency: float = 0.15
    stress: float = 0.10
    momentum: float = 0.20


EVENT_WEIGHTS = RankingWeights(frequency=0.30, source_diversity=0.25, recency=0.15, stress=0.10, momentum=0.20)


def _ranked(stats: DataFrame, weights: RankingWeights, per_source: int, most_sources: int, hours: float, exact_ratio: bool, limit: int) -> DataFrame:
    c = F.col
    parts = {
        "frequency": numbers.clamp(c("current") / F.greatest(c("total"), F.lit(1))),
        "diversity": numbers.clamp(c("sources") / F.greatest(F.least(c("current") * per_source, F.lit(most_sources)), F.lit(1))),
        "recency": F.coalesce(c("recency"), F.lit(0.0)),
        "stress": numbers.clamp(F.coalesce(c("average_stress"), F.lit(0.0)) / 100.0),
        "momentum": numbers.momentum(c("current"), c("previous")),
    }
    w = {"frequency": weights.frequency, "diversity": weights.source_diversity, "recency": weights.recency, "stress": weights.stress, "momentum": weights.momentum}
    score = sum((parts[k] * w[k] for k in w), F.lit(0.0)) * 100
    ratio = numbers.momentum_ratio(c("current"), c("previous"))
    told = ratio if exact_ratio else numbers.round2(ratio)
    out = stats.select(
        "name", numbers.round2(score).alias("score"), c("current").alias("count"), c("previous").alias("previous_count"), "sources",
        numbers.round2(F.coalesce(c("average_stress"), F.lit(0.0))).alias("average_stress"), numbers.round2(ratio).alias("momentum_ratio"), numbers.momentum_label(told).alias("momentum"),
    )
    return out.orderBy(F.desc("score"), F.desc("count"), F.desc("sources"), "name").limit(limit)


def rank_dimension(df: DataFrame, column: str, is_json: bool = False, hours: float = 72.0, limit: int = 10, weights: RankingWeights = RankingWeights(), labels: Column | None = None) -> DataFrame:
    """Labels of recent documents by score; df has ``age_hours, fuente, stress_score`` and the label column.

    A label in no document of the current window isn't ranked.  Missing labels and sources count as none, missing stress
    isn't averaged.  The total is the documents of the window, at least 1.
    """
    df = df.withColumn("__period", period(F.col("age_hours"), hours)).where("__period is not null")
    total = df.agg(F.count_if(F.col("__period") == "current").alias("total"))
    now = F.col("__period") == "current"
    rows = df.select(
        F.explode(numbers.labels(F.col(column), is_json) if labels is None else labels).alias("name"), "__period", "age_hours",
        text.missing(F.trim("fuente")).alias("__source"), F.col("stress_score").cast("double").alias("__stress"))
    stats = rows.groupBy("name").agg(
        F.count_if(now).alias("current"), F.count_if(~now).alias("previous"), F.countDistinct(F.when(now, F.col("__source"))).alias("sources"),
        F.avg(F.when(now, F.exp(-F.col("age_hours") / hours))).alias("recency"), F.avg(F.when(now, F.col("__stress"))).alias("average_stress"),
    ).where("current > 0")
    return _ranked(stats.crossJoin(F.broadcast(total)), weights, 1, 5, hours, True, limit)


def rank_events(events: DataFrame, column: str, previous: DataFrame | None = None, age: str | None = None, hours: float = 72.0, limit: int = 10, weights: RankingWeights = EVENT_WEIGHTS) -> DataFrame:
    """Labels of events by score; events have ``sources`` (JSON list), ``average_stress`` and the label column.

    Sources are the union of the events' lists.  Without ``previous`` nothing came before; without ``age`` recency is 0.
    The total is all events, labelled or not.
    """
    label = text.missing(F.trim(column))
    hours_old = F.lit(None).cast("double") if age is None else F.col(age).cast("double")
    total = events.agg(F.count("*").alias("total"))
    rows = events.select(label.alias("name"), numbers.json_list(F.col("sources")).alias("__sources"), F.col("average_stress").cast("double").alias("__stress"), hours_old.alias("__age")).where("name is not null")
    stats = rows.groupBy("name").agg(F.count("*").alias("current"), F.avg(F.when(F.col("__age").isNotNull(), F.exp(-F.greatest(F.col("__age"), F.lit(0.0)) / hours))).alias("recency"), F.avg("__stress").alias("average_stress"))
    union = rows.select("name", F.explode("__sources").alias("s")).groupBy("name").agg(F.countDistinct("s").alias("sources"))
    stats = stats.join(union, "name", "left").fillna(0, ["sources"])
    if previous is None:
        stats = stats.withColumn("previous", F.lit(0))
    else:
        before = previous.select(label.alias("name")).where("name is not null").groupBy("name").agg(F.count("*").alias("previous"))
        stats = stats.join(before, "name", "left").fillna(0, ["previous"])
    return _ranked(stats.crossJoin(F.broadcast(total)), weights, 2, 6, hours, False, limit)


def leader(ranking: DataFrame, least_count: int = 2, least_sources: int = 2, either: bool = False) -> DataFrame:
    """First label of a ranking with enough documents and sources (or one of the two), else the first of all."""
    enough = (F.col("count") >= least_count, F.col("sources") >= least_sources)
    ok = (enough[0] | enough[1]) if either else (enough[0] & enough[1])
    return ranking.withColumn("eligible", ok).orderBy(F.desc("eligible"), F.desc("score"), F.desc("count"), F.desc("sources"), "name").limit(1)
