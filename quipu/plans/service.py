"""What the read interface answers, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quipu.operators import annotation, events, metrics, temporal


def _limit(limit: int, most: int) -> int:
    if not 1 <= limit <= most:
        raise ValueError(f"limit is 1 to {most}")
    return limit


def overview(event_table: DataFrame, documents: DataFrame) -> DataFrame:
    return events.event_payload(event_table, documents)


def temporal_quality(dated: DataFrame) -> DataFrame:
    return temporal.temporal_audit(dated)


def event_list(event_table: DataFrame, limit: int = 20, minimum_sources: int = 1) -> DataFrame:
    """Events of at least so many sources, most sources and documents first."""
    order = [F.desc_nulls_last(c) for c in ("unique_sources", "documents", "maximum_stress", "effective_at")]
    return event_table.where(F.col("unique_sources") >= minimum_sources).orderBy(*order, "event_id").limit(_limit(limit, 100))


def ranked(ranking: DataFrame, limit: int = 10, momentum: str | None = None) -> DataFrame:
    """A ranking's first labels, of one momentum if given."""
    rows = ranking if momentum is None else ranking.where(F.lower("momentum") == momentum.lower())
    return rows.orderBy(F.desc("score"), F.desc("count"), F.desc("sources"), "name").limit(_limit(limit, 50))


def emerging(rankings: dict[str, DataFrame], limit: int = 20) -> DataFrame:
    """``(dimension, ...)``: labels of any ranking that emerge."""
    out = None
    for name, df in rankings.items():
        one = df.where("momentum = 'emergente'").withColumn("dimension", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.orderBy(F.desc("score"), "dimension", "name").limit(_limit(limit, 50))


def analyze(df: DataFrame, least: int = 10, most: int = 20_000) -> DataFrame:
    """Lexical analysis of texts (id, texto); texts too short or long get an error instead."""
    from quipu.plans.pipeline import lexical_columns

    length = F.length(F.trim("texto"))
    error = F.when(length.isNull() | (length < least), "texto demasiado corto").when(length > most, "texto demasiado largo")
    return lexical_columns(df.withColumn("titulo", F.lit(None).cast("string"))).drop("titulo").withColumn("error", error)


def batch_summary(analysed: DataFrame) -> DataFrame:
    """One row over an analysed batch: documents, errors, mean stress, levels."""
    ok = F.col("error").isNull()
    return analysed.agg(
        F.count("*").alias("documents"), F.count_if(~ok).alias("errors"), F.avg(F.when(ok, F.col("stress_score"))).alias("average_stress"),
        *[F.count_if(ok & (F.col("stress_nivel") == n)).alias(a) for n, a in (("crítico", "critical"), ("alto", "high"), ("moderado", "moderate"), ("bajo", "low"))])


def batch_report(analysed: DataFrame, limit: int | None = None) -> DataFrame:
    """``(kind, value, count)`` over an analysed batch: tones, topics, entities, indicators, whether the models agree, outcomes.

    Rows with an error count as failed and for nothing else; missing tones, topics and agreements aren't counted.
    """
    ok = analysed.where(F.col("error").isNull())
    count = lambda df, kind, value: df.select(F.lit(kind).alias("kind"), value.cast("string").alias("value")).where("value is not null").groupBy("kind", "value").agg(F.count("*").alias("count"))
    out = count(analysed, "outcome", F.when(F.col("error").isNull(), "processed").otherwise("failed"))
    for kind, c in (("sentiment", "tono_consolidado"), ("topic", "tema"), ("agreement", "coincidencia_modelos")):
        if c in analysed.columns:
            out = out.unionByName(count(ok, kind, F.col(c)))
    for kind, c in (("entity", "entidades"), ("indicator", "indicadores")):
        out = out.unionByName(count(ok.select(F.explode(c).alias("x")), kind, F.col("x")))
    return out if limit is None else out.orderBy("kind", F.desc("count"), "value").limit(limit)


def history(table: DataFrame, days: int = 30) -> DataFrame:
    """The latest rows of the history, 1 to 365, by date."""
    return table.orderBy(F.desc("date")).limit(_limit(days, 365)).orderBy("date")


def topic_keywords(words: DataFrame, names: dict[int, str] = {}, most: int = 10) -> DataFrame:
    """``(topic_id, name, keywords)`` of ``models.topic_words``; a topic without name is called by its number."""
    rows = words.where(F.col("rank") <= most).groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("x"))
    name = F.concat(F.lit("Tema "), F.col("topic_id").cast("string"))
    if names:
        name = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("topic_id").cast("int")), name)
    return rows.select("topic_id", name.alias("name"), F.transform("x", lambda r: r["term"]).alias("keywords"))


def frequencies(analysed: DataFrame, limit: int = 15) -> DataFrame:
    """``(kind, value, count, percentage)`` of entities and indicators."""
    one = lambda c: metrics.list_frequency(analysed, F.col(c), limit).withColumn("kind", F.lit(c))
    return one("entidades").unionByName(one("indicadores"))


annotation_status, annotation_items = annotation.status, annotation.page
