"""Counts, shares, indices and time series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quipu.functions import dates, lexicon, numbers, text


def frequency_table(df: DataFrame, column: str) -> DataFrame:
    """``(value, count, percentage)`` of a column, missing values left out of the rows but not of the total."""
    total = df.agg(F.count("*").alias("total"))
    rows = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count"))
    return rows.crossJoin(F.broadcast(total)).select("value", "count", numbers.percentage(F.col("count"), F.col("total")).alias("percentage"))


def list_frequency(df: DataFrame, items: Column, limit: int | None = None) -> DataFrame:
    """``(value, count, percentage)`` of list items; the percentage is of rows, not of items."""
    total = df.agg(F.count("*").alias("total"))
    rows = df.select(F.explode(items).alias("value")).groupBy("value").agg(F.count("*").alias("count"))
    rows = rows.crossJoin(F.broadcast(total)).select("value", "count", numbers.percentage(F.col("count"), F.col("total")).alias("percentage"))
    return rows if limit is None else rows.orderBy(F.desc("count"), "value").limit(limit)


def merged_counts(df: DataFrame, counts: str) -> DataFrame:
    """``(term, uses)``: sum of a map column of counts by key."""
    return df.select(F.explode(counts).alias("term", "n")).groupBy("term").agg(F.sum("n").alias("uses"))


def source_breakdown(df: DataFrame) -> DataFrame:
    """Per source: documents, unfavourable, favourable, high stress, mean stress.  Rows without source are left out."""
    return df.where("fuente is not null").groupBy("fuente").agg(
        F.count("*").alias("documents"), F.count_if(F.col("tono_consolidado") == "desfavorable").alias("unfavorable"),
        F.count_if(F.col("tono_consolidado") == "favorable").alias("favorable"), F.count_if(F.col("stress_nivel").isin("alto", "crítico")).alias("high_stress"),
        numbers.round2(F.avg("stress_score")).alias("stress_average"),
    )


def _index(average: Column, unfavorable: Column, high: Column, disagreement: Column) -> Column:
    return numbers.round2(numbers.clamp(average * 0.5 + unfavorable * 0.3 + high * 0.1 + disagreement * 0.1, 0.0, 100.0))


_DISAGREES = "lower(cast(coincidencia_modelos as string)) in ('false', '0')"


def macro_score(df: DataFrame) -> DataFrame:
    """One row: index of stress, tone and disagreement of the models, with its level.  No rows give a score of 0."""
    c = F.col
    sums = df.agg(
        F.count("*").alias("documents"), F.avg("stress_score").alias("average"), F.count_if(c("tono_consolidado") == "desfavorable").alias("unfavorable"),
        F.count_if(c("stress_nivel").isin("alto", "crítico")).alias("high"), F.count_if(F.expr(_DISAGREES)).alias("disagree"))
    share = lambda k: F.when(c("documents") > 0, c(k) * 100.0 / c("documents")).otherwise(0.0)
    score = _index(numbers.round2(F.coalesce("average", F.lit(0.0))), share("unfavorable"), share("high"), share("disagree"))
    return sums.select("documents", numbers.round2(F.coalesce("average", F.lit(0.0))).alias("average_stress"), score.alias("macro_score"), text.level(score).alias("level"))


def monthly_series(df: DataFrame, at: Column, least: int = 2) -> DataFrame:
    """Per month with enough documents: shares and index.  Rows without time are left out; months without stress have no index."""
    c = F.col
    sums = df.withColumn("period", dates.month(at)).where("period is not null").groupBy("period").agg(
        F.count("*").alias("documents"), F.avg("stress_score").alias("average"), F.count_if(c("tono_consolidado") == "desfavorable").alias("unfavorable"),
        F.count_if(c("stress_nivel").isin("alto", "crítico")).alias("high"), F.count_if(F.expr(_DISAGREES)).alias("disagree")).where(c("documents") >= least)
    share = lambda k: numbers.percentage(c(k), c("documents"))
    return sums.select(
        "period", "documents", numbers.round2(c("average")).alias("stress_average"), share("unfavorable").alias("unfavorable_percentage"), share("high").alias("high_stress_percentage"),
        share("disagree").alias("model_disagreement_percentage"), _index(c("average"), share("unfavorable"), share("high"), share("disagree")).alias("index_score"),
    )


def optimism_index(df: DataFrame, content: Column, weights: dict[str, int] = lexicon.OPTIMISM) -> DataFrame:
    """One row: index of optimistic terms, favourable tone and low stress, with its level."""
    c = F.col
    signals = text.weigh(text.term_counts(content, weights, whole=True), weights)
    sums = df.select(signals.alias("signals"), "tono_consolidado", "stress_nivel").agg(
        F.count("*").alias("documents"), F.coalesce(F.avg("signals"), F.lit(0.0)).alias("average"),
        F.count_if(c("tono_consolidado") == "favorable").alias("favorable"), F.count_if(c("stress_nivel").isin("bajo", "moderado")).alias("low"))
    lexical = numbers.round2(c("average"))
    score = numbers.round2(F.least(lexical * 6.0, F.lit(100.0)) * 0.5 + numbers.percentage(c("favorable"), c("documents")) * 0.35 + numbers.percentage(c("low"), c("documents")) * 0.15)
    return sums.select("documents", lexical.alias("lexical_average"), score.alias("optimism"), text.level(score, (70, 45, 25), ("alto", "moderado", "limitado", "bajo")).alias("level"))


def confusion_matrix(df: DataFrame, label: str, predicted: str, order: list[str]) -> DataFrame:
    """``(label, predicted, count)`` for every pair of the given labels, also those that don't occur."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, b) for a in order for b in order], "label string, predicted string")
    counts = df.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return F.broadcast(grid).join(counts, ["label", "predicted"], "left").select("label", "predicted", F.coalesce("n", F.lit(0)).alias("count"))


def class_report(df: DataFrame, label: str, predicted: str, order: list[str]) -> DataFrame:
    """``(label, precision, recall, f1, support)`` per class; a ratio without cases is 0."""
    sums = []
    for k in order:
        sums += [F.count_if((F.col(label) == k) & (F.col(predicted) == k)), F.count_if(F.col(predicted) == k), F.count_if(F.col(label) == k)]
    one = df.agg(F.array(*[s.cast("double") for s in sums]).alias("a"))
    rows = one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("label"), F.col("a")[3 * i].alias("hit"), F.col("a")[3 * i + 1].alias("said"), F.col("a")[3 * i + 2].alias("support")) for i, k in enumerate(order)])))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    rows = rows.withColumns({"precision": ratio(F.col("hit"), F.col("said")), "recall": ratio(F.col("hit"), F.col("support"))})
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return rows.select("label", "precision", "recall", f1.alias("f1"), F.col("support").cast("bigint").alias("support"))


def macro_report(df: DataFrame, label: str, predicted: str, order: list[str]) -> DataFrame:
    """One row: accuracy and the unweighted means of the classes."""
    means = class_report(df, label, predicted, order).agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"))
    right = df.agg(F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("accuracy"), F.count("*").alias("rows"))
    return right.crossJoin(F.broadcast(means))


def repair_report(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Per column (before, after): cells changed and suspicious sequences before and after; null is the empty text."""
    sums = []
    for before, after in pairs.values():
        sums += [F.count_if(F.coalesce(before, F.lit("")) != F.coalesce(after, F.lit(""))), F.coalesce(F.sum(text.suspicious_score(F.col(before))), F.lit(0)), F.coalesce(F.sum(text.suspicious_score(F.col(after))), F.lit(0))]
    one = df.agg(F.count("*").alias("rows"), F.array(*[s.cast("bigint") for s in sums]).alias("a"))
    cells = [F.struct(F.lit(k).alias("column"), F.col("a")[3 * i].alias("repaired"), F.col("a")[3 * i + 1].alias("suspicious_before"), F.col("a")[3 * i + 2].alias("suspicious_after")) for i, k in enumerate(pairs)]
    return one.select("rows", F.inline(F.array(*cells)))
