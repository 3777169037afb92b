"""Quality gates: each check as a row ``(check, value, threshold, passed)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quipu.functions import text

Rule = tuple[str, Column, float, Column]


def _rows(one: DataFrame, rules: list[Rule]) -> DataFrame:
    cells = [F.struct(F.lit(n).alias("check"), v.cast("double").alias("value"), F.lit(float(t)).alias("threshold"), F.coalesce(p, F.lit(False)).alias("passed")) for n, v, t, p in rules]
    return one.select(F.inline(F.array(*cells)))


# What a day's report must have, and the columns of its tables.
SECTIONS = {"total_documents", "macro_index", "optimism_index", "topics", "stress"}
CLUSTERED = {"event_id", "event_size", "titulo", "fuente"}
EVENTS = {
    "event_id", "event_title", "documents", "unique_sources", "sources", "effective_at", "average_stress", "maximum_stress", "dominant_topic", "dominant_indicator",
    "dominant_entity", "representative_url",
}
RANKINGS = {"topics", "indicators", "entities"}


def report_rules(report: DataFrame, clean_rows: int) -> list[Rule]:
    """Checks of the day's report, one row with a column per section: all sections there, total as in the clean corpus."""
    lacks = len(SECTIONS - set(report.columns))
    total = report.select("total_documents").first() if "total_documents" in report.columns else None
    off = (total[0] if total and total[0] is not None else 0) - clean_rows
    return [("missing_report_sections", F.lit(lacks), 0, F.lit(lacks == 0)), ("report_total", F.lit(off), 0, F.lit(total is not None and off == 0))]


def pipeline_gate(operational: DataFrame, clean: DataFrame, sources: int = 3, generic: float = 0.05, rows: int = 30, report: DataFrame | None = None) -> DataFrame:
    """Checks of the operational and the clean corpus: not empty, metadata columns, sources, index-page titles, size; and of the
    day's report, if given."""
    c = F.col
    lacks = len({"source_type", "department", "scope", "source_weight", "collected_at"} - set(operational.columns))
    one = operational.agg(F.count("*").alias("n"), F.countDistinct("fuente").alias("sources"), F.coalesce(F.avg(text.generic_title(c("titulo")).cast("double")), F.lit(0.0)).alias("generic"))
    one = one.crossJoin(F.broadcast(clean.agg(F.count("*").alias("clean"))))
    more = report_rules(report, clean.count()) if report is not None else []
    return _rows(one, [
        ("operational_rows", c("n"), 1, c("n") >= 1), ("missing_metadata_columns", F.lit(lacks), 0, F.lit(lacks == 0)), ("distinct_sources", c("sources"), sources, c("sources") >= sources),
        ("generic_title_ratio", c("generic"), generic, c("generic") <= generic), ("clean_rows", c("clean"), rows, c("clean") >= rows), *more,
    ])


def _whole(df: DataFrame, wanted: set[str]) -> tuple[DataFrame, int]:
    """The table with null for each wanted column it lacks, and how many it lacks."""
    lacks = sorted(wanted - set(df.columns))
    return df.withColumns({c: F.lit(None).cast("string") for c in lacks}) if lacks else df, len(lacks)


def event_gate(
    events: DataFrame, clustered: DataFrame, operational: DataFrame, largest: float = 0.5, compression: float = 0.2, from_documents: int = 10,
    payload: DataFrame | None = None, rankings: dict[str, DataFrame] | None = None, snapshot: DataFrame | None = None,
) -> DataFrame:
    """Checks that events and their documents agree; shares are only judged from enough documents on.

    Also, where given: the payload (``events.event_payload``) counts the same documents and events, all rankings are there, the
    snapshot (one row with ``economic_events``) counts the events.  A missing column fails its own check and those on it.
    """
    c = F.col
    events, lacks_e = _whole(events, EVENTS)
    clustered, lacks_c = _whole(clustered, CLUSTERED)
    blank = lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    e = events.agg(
        F.count("*").alias("events"), F.countDistinct("event_id").alias("ids"), F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.coalesce(F.max("documents"), F.lit(0)).alias("largest"),
        F.count_if(blank("event_title")).alias("untitled"), F.count_if(c("documents") <= 0).alias("empty"), F.count_if(c("unique_sources") <= 0).alias("sourceless"))
    k = clustered.agg(F.count("*").alias("clustered"), F.count_if(blank("event_id")).alias("unclustered"), F.countDistinct("event_id").alias("clusters"))
    o = operational.agg(F.count("*").alias("operational"))
    one = e.crossJoin(F.broadcast(k)).crossJoin(F.broadcast(o))
    more: list[Rule] = [(f"missing_{n}_columns", F.lit(x), 0, F.lit(x == 0)) for n, x in (("event", lacks_e), ("clustered", lacks_c))]
    if payload is not None:
        one = one.crossJoin(F.broadcast(payload.agg(F.first("events").alias("p_events"), F.first("documents").alias("p_documents"), F.first("multi_source_events").alias("p_multi"))))
        one = one.crossJoin(F.broadcast(events.agg(F.count_if(c("unique_sources") >= 2).alias("multi"))))
        more += [(f"payload_{n}", c(f"p_{n}") - c(m), 0, c(f"p_{n}") == c(m)) for n, m in (("events", "events"), ("documents", "operational"), ("multi", "multi"))]
    if rankings is not None:
        gone = len(RANKINGS - set(rankings))
        more.append(("missing_rankings", F.lit(gone), 0, F.lit(gone == 0)))
    if snapshot is not None:
        one = one.crossJoin(F.broadcast(snapshot.agg(F.first("economic_events").alias("s_events"))))
        more.append(("snapshot_events", c("s_events") - c("events"), 0, c("s_events") == c("events")))
    few = c("operational") < from_documents
    share, ratio = c("largest") / F.greatest(c("operational"), F.lit(1)), c("events") / F.greatest(c("operational"), F.lit(1))
    return _rows(one, [
        ("operational_rows", c("operational"), 1, c("operational") >= 1), ("clustered_rows", c("clustered") - c("operational"), 0, c("clustered") == c("operational")),
        ("unclustered_rows", c("unclustered"), 0, c("unclustered") == 0), ("documents_sum", c("documents") - c("operational"), 0, c("documents") == c("operational")),
        ("event_ids", c("clusters") - c("events"), 0, c("clusters") == c("events")), ("duplicate_ids", c("events") - c("ids"), 0, c("events") == c("ids")),
        ("untitled_events", c("untitled"), 0, c("untitled") == 0), ("empty_events", c("empty"), 0, c("empty") == 0), ("sourceless_events", c("sourceless"), 0, c("sourceless") == 0),
        ("largest_event_share", share, largest, few | (share <= largest)), ("event_ratio", ratio, compression, few | (ratio >= compression)), *more,
    ])
