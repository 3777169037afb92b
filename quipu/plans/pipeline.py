"""The daily batch as a composition of operators, from collected items to rankings and history."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quipu.functions import dates, numbers, text
from quipu.operators import corpus, events, gates, lineage, metrics, ranking, temporal

# Columns of the history, in order.
SNAPSHOT = [
    "date", "generated_at", "documents", "macro_index", "macro_level", "optimism_index", "optimism_level", "stress_average", "favorable_percentage", "neutral_percentage",
    "unfavorable_percentage", "top_topic", "top_entity", "top_indicator", "historical_documents", "operational_window_hours", "top_topic_score", "top_topic_momentum",
    "top_entity_score", "top_entity_momentum", "top_indicator_score", "top_indicator_momentum",
]


@dataclass
class Daily:
    """Tables of one day's run."""

    clean: DataFrame
    analysed: DataFrame
    operational: DataFrame
    clustered: DataFrame
    events: DataFrame
    rankings: dict[str, DataFrame]
    snapshot: DataFrame
    gates: DataFrame
    series: DataFrame
    report: DataFrame

    def counts(self) -> DataFrame:
        """``(output, rows)`` of every output."""
        tables = {"clean": self.clean, "operational": self.operational, "clustered": self.clustered, "events": self.events, "snapshot": self.snapshot, "gates": self.gates, "series": self.series, "report": self.report}
        tables |= {f"ranking_{k}": v for k, v in self.rankings.items()}
        out = None
        for name, df in tables.items():
            one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("output"), "rows")
            out = one if out is None else out.unionByName(one)
        return out


def lexical_columns(df: DataFrame) -> DataFrame:
    """Add entities, indicators, terms of risk and relief, stress and its level, from title and text."""
    from quipu.functions import lexicon

    df = df.withColumn("__t", text.compatible(F.concat_ws(". ", "titulo", "texto")))
    df = df.withColumns({
        "entidades": text.entities(F.col("__t")), "indicadores": text.indicators(F.col("__t")),
        "terminos_riesgo": text.term_counts(F.col("__t"), lexicon.RISK), "terminos_alivio": text.term_counts(F.col("__t"), lexicon.RELIEF)})
    score = text.stress(text.weigh(F.col("terminos_riesgo"), lexicon.RISK), text.weigh(F.col("terminos_alivio"), lexicon.RELIEF))
    df = df.withColumn("stress_score", score)
    return df.withColumn("stress_nivel", text.level(F.col("stress_score"))).drop("__t")


def daily(previous: DataFrame, current: DataFrame, collected_at: str, now: Column, models=lambda df: df, policy: temporal.TemporalPolicy = temporal.TemporalPolicy()) -> Daily:
    """One day's run; ``models`` adds tone, topic and agreement columns to the lexically analysed corpus.

    The analysed corpus, its recent rows, the clustered news and the events are stored, as several outputs are made from each.
    """
    analysed = models(lexical_columns(corpus.merge_and_clean(previous, current, collected_at)))
    for c, kind in (("tono_consolidado", "string"), ("tema", "string"), ("coincidencia_modelos", "boolean")):
        if c not in analysed.columns:
            analysed = analysed.withColumn(c, F.lit(None).cast(kind))
    dated = lineage.store(temporal.temporal_columns(analysed, now, policy), "zstd")
    # many outputs read the recent rows, in no order
    operational = lineage.store(dated.where("is_recent"), "zstd")
    clustered = lineage.store(events.cluster_news(operational), "zstd")
    summary = lineage.store(events.summarize_events(clustered))
    hours = policy.recent_hours
    rankings = {
        "topics": ranking.rank_dimension(dated, "tema", hours=hours), "indicators": ranking.rank_dimension(dated, "indicadores", hours=hours, labels=F.col("indicadores")),
        "entities": ranking.rank_dimension(dated, "entidades", hours=hours, labels=F.col("entidades")), "event_topics": ranking.rank_events(summary, "dominant_topic"),
        "event_indicators": ranking.rank_events(summary, "dominant_indicator"), "event_entities": ranking.rank_events(summary, "dominant_entity")}
    day = lineage.store(snapshot(operational, dated, now, rankings, hours, summary))
    payload = events.event_payload(summary, operational)
    series = metrics.monthly_series(dated, dates.instant(F.col("effective_at")))
    section = lambda df: df.agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("x"))
    report = dated.agg(F.count("*").alias("total_documents")).crossJoin(F.broadcast(day.select("macro_index", "optimism_index")))
    for name, df in (("topics", rankings["topics"]), ("stress", metrics.macro_score(operational))):
        report = report.crossJoin(F.broadcast(section(df).withColumnRenamed("x", name)))
    checks = gates.pipeline_gate(operational, dated, report=report)
    checks = checks.unionByName(gates.event_gate(summary, clustered, operational, payload=payload, rankings={k.removeprefix("event_"): v for k, v in rankings.items() if k.startswith("event_")}, snapshot=day))
    return Daily(dated, dated, temporal.operational(operational), clustered, summary, rankings, day, checks, series, report)


def snapshot(operational: DataFrame, historical: DataFrame, now: Column, rankings: dict[str, DataFrame], hours: float = 72.0, event_table: DataFrame | None = None) -> DataFrame:
    """One row of the history: the day, counts, indices, shares of tones, leaders with score and momentum.

    An empty ranking has the leader ``""`` without score.  ``economic_events`` counts the events, null if none are given.
    """
    macro = metrics.macro_score(operational).select("documents", F.col("macro_score").alias("macro_index"), F.col("level").alias("macro_level"), F.col("average_stress").alias("stress_average"))
    hope = metrics.optimism_index(operational, F.concat_ws(". ", "titulo", "texto")).select(F.col("optimism").alias("optimism_index"), F.col("level").alias("optimism_level"))
    share = lambda tone: numbers.percentage(F.count_if(F.col("tono_consolidado") == tone), F.count("*"))
    tones = operational.agg(share("favorable").alias("favorable_percentage"), share("neutral").alias("neutral_percentage"), share("desfavorable").alias("unfavorable_percentage"))
    out = macro.crossJoin(F.broadcast(hope)).crossJoin(F.broadcast(tones)).crossJoin(F.broadcast(historical.agg(F.count("*").alias("historical_documents"))))
    for kind, name in (("topic", "topics"), ("entity", "entities"), ("indicator", "indicators")):
        top = ranking.leader(rankings[name], either=kind == "entity")
        out = out.crossJoin(F.broadcast(top.agg(F.coalesce(F.first("name"), F.lit("")).alias(f"top_{kind}"), F.first("score").alias(f"top_{kind}_score"), F.first("momentum").alias(f"top_{kind}_momentum"))))
    counted = event_table.agg(F.count("*").alias("economic_events")) if event_table is not None else operational.sparkSession.range(1).select(F.lit(None).cast("bigint").alias("economic_events"))
    out = out.crossJoin(F.broadcast(counted)).withColumns({"date": F.date_format(now, "yyyy-MM-dd"), "generated_at": dates.iso(now), "operational_window_hours": F.lit(hours)})
    return out.select(*SNAPSHOT, "economic_events")


def add_to_history(history: DataFrame, day: DataFrame) -> DataFrame:
    """The history with the day's row, which replaces an earlier one of that day; columns may have changed."""
    return corpus.upsert(history, day, "date").orderBy("date")
