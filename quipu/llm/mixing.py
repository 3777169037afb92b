"""Mixing documents by source to target shares of the total size, small sources repeated up to a cap.

Documents are first put together by membership pattern: a text that lies in several sources may fill the quota of
any of them.  A minimum-cost flow then routes the patterns' sizes to the sources' quotas; each further repetition of a
pattern costs more, so repetition is spread and used last, and what can't be filled runs through slack arcs.  The flow
sees patterns and sources only, in whole units of size.  Documents are then picked by seeded hash order until a
pattern's share is reached.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quipu.llm.common import cut, small
from quipu.llm.quotas import SLACK, Flow

#: Tokenizer file, on every executor; ``SparkFiles`` finds it by name where it was added to the application.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Membership patterns fetched at once; more are fetched part by part.  The flow takes them all.
MOST_PATTERNS = 100_000
BROADCAST_ROWS = 300_000


def word_count(text: Column) -> Column:
    """White-space separated words; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0)).cast("bigint")


def token_count(text: Column, tokenizer: str = TOKENIZER) -> Column:
    """Tokens of a public tokenizer, a file of the tokenizers library that every executor can read."""

    @F.pandas_udf(LongType())
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import os

        from pyspark import SparkFiles
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(tokenizer if os.path.exists(tokenizer) else SparkFiles.get(os.path.basename(tokenizer)))
        model.encode_special_tokens = True
        for s in parts:
            yield pd.Series([len(x.ids) for x in model.encode_batch(s.fillna("").tolist(), add_special_tokens=False)], dtype="int64")

    return count(text)


def _route(patterns: list[tuple[int, list[str], int]], targets: dict[str, tuple[float, int]]) -> dict[tuple[int, str], int]:
    """Size that each pattern gives to each of its sources; further rounds of a pattern cost more."""
    flow, arcs, whole = Flow(), [], 0
    for p, sources, size in patterns:
        wanted = [s for s in sources if s in targets]
        if not wanted or not size:
            continue
        for k in range(max(targets[s][1] for s in wanted)):
            flow.arc("all", ("pattern", p), size, k * k)
        for s in wanted:
            arcs.append((p, s, flow.arc(("pattern", p), ("source", s), size * targets[s][1], 0)))
    for s, (want, _) in targets.items():
        flow.arc(("source", s), "sink", round(want), 0)
        whole += round(want)
    flow.run("all", "sink", whole)
    return {(p, s): flow.sent(a) for p, s, a in arcs if flow.sent(a)}


def unfilled(have: dict[str, int], targets: dict[str, tuple[float, int]]) -> dict[str, int]:
    """What each source's quota lacks if the source is repeated up to its cap: the flow through its slack arc."""
    flow, arcs, whole = Flow(), {}, 0
    for s, (want, most) in targets.items():
        flow.arc("all", ("quota", s), ceil(want), 0)
        flow.arc(("quota", s), ("source", s), ceil(want), 0)
        flow.arc(("source", s), "sink", most * have.get(s, 0), 0)
        arcs[s] = flow.arc(("quota", s), "slack", ceil(want), SLACK)
        whole += ceil(want)
    flow.arc("slack", "sink", whole, 0)
    flow.run("all", "sink", whole)
    return {s: flow.sent(a) for s, a in arcs.items()}


def plan(documents: DataFrame, targets: DataFrame, size: Column, text: str = "text", part: float = 2.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sizes, routes and report of a mix whose total is ``1/part`` of the size of all documents.

    * documents ``(doc_id, source, size, pattern)``, pattern a hash of the text's sources among the targets;
    * routes ``(pattern, source, routed)``;
    * report ``(source, target_share, max_repeats, available, wanted, routed, unfilled, short)``: a source is short
      if all its documents repeated up to its cap are smaller than its share (``unfilled`` is what they lack).
    Documents without source count for the total only, empty ones for nothing.  Sources of the targets without documents are
    short if they want any.
    """
    asked = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).where("source is not null").collect()
    rows = cut(documents.select("doc_id", "source", F.xxhash64(text).alias("text_id"), size.alias("size")))
    total = (rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]) / part
    wanted = small(targets.select("source").where("source is not null").distinct(), BROADCAST_ROWS)
    rows = rows.where("source is not null and size > 0").join(wanted, "source", "left_semi")
    # only texts that lie in several sources need to be told apart; the others' pattern is their source
    several = rows.groupBy("text_id").agg(F.collect_set("source").alias("sources")).where("size(sources) > 1").select("text_id", F.sort_array("sources").alias("sources"))
    rows = rows.join(small(cut(several), BROADCAST_ROWS), "text_id", "left").withColumn("sources", F.coalesce("sources", F.array("source")))
    rows = cut(rows.select("doc_id", "source", "size", "sources", F.xxhash64("sources").alias("pattern")))
    sums = rows.groupBy("pattern").agg(F.first("sources").alias("sources"), F.sum("size").alias("size"))
    sizes = sums.orderBy(F.desc("size"), "pattern").limit(MOST_PATTERNS + 1).collect()
    if len(sizes) > MOST_PATTERNS:
        sizes = sorted(cut(sums).toLocalIterator(), key=lambda r: (-r["size"], r["pattern"]))
    have = {r["source"]: int(r["size"]) for r in rows.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    want = {r["source"]: ((r["target_share"] or 0.0) * total, max(0, r["max_repeats"] or 0)) for r in asked}
    routes = _route([(r["pattern"], r["sources"], int(r["size"])) for r in sizes], want)
    lacks = unfilled(have, want)
    got = {s: sum(v for (_, t), v in routes.items() if t == s) for s in want}
    report = [(r["source"], r["target_share"], r["max_repeats"], have.get(s := r["source"], 0), want[s][0], got[s], lacks[s], lacks[s] > 0) for r in asked]
    spark = documents.sparkSession
    return (
        rows.select("doc_id", "source", "size", "pattern"),
        spark.createDataFrame([(p, s, float(v)) for (p, s), v in routes.items()], "pattern bigint, source string, routed double"),
        spark.createDataFrame(report, "source string, target_share double, max_repeats int, available bigint, wanted double, routed bigint, unfilled bigint, short boolean"),
    )


def shares(rows: DataFrame, routes: DataFrame, report: DataFrame) -> DataFrame:
    """The report with ``selected`` and ``actual_share``: size and share of the documents that ``select`` picks."""
    size = rows.groupBy("doc_id").agg(F.first("size").alias("size"))
    picked = select(rows, routes).join(size, "doc_id").groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("selected"))
    out = report.join(small(picked, BROADCAST_ROWS), "source", "left").fillna(0, ["selected"])
    whole = out.agg(F.sum("selected").alias("whole"))
    return out.crossJoin(F.broadcast(whole)).withColumn("actual_share", F.when(F.col("whole") > 0, F.col("selected") / F.col("whole")).otherwise(0.0)).drop("whole")


def select(rows: DataFrame, routes: DataFrame, seed: int = 11, cells: int = 4096) -> DataFrame:
    """``(doc_id, source, copies)``: seeded choice of documents that fills the routes.

    A route larger than its pattern takes whole rounds of it and, for the rest, documents in hash order up to the
    size.  Hash order is cut into cells whose sizes are summed first, so only the one cell at the edge is ranked.
    The routes of one pattern start at different places of that order, so they take different documents first.
    """
    pool = rows.where("source is not null").groupBy("pattern").agg(F.sum("size").alias("pool"))
    span = Window.partitionBy("pattern").orderBy("source")
    plan_ = routes.join(pool, "pattern").where("pool > 0").withColumn("rounds", F.floor(F.col("routed") / F.col("pool"))).withColumn("rest", F.col("routed") - F.col("rounds") * F.col("pool"))
    plan_ = plan_.withColumn("turn", F.row_number().over(span))
    docs = rows.where("source is not null").select("doc_id", "pattern", "size")
    each = docs.join(small(cut(plan_), BROADCAST_ROWS), "pattern").withColumn("order", F.xxhash64(F.lit(seed), "turn", "doc_id")).withColumn("cell", F.pmod(F.shiftright("order", 20), F.lit(cells)))
    sums = each.groupBy("pattern", "source", "rest", "cell").agg(F.sum("size").alias("in_cell"))
    before = sums.withColumn("before", F.sum("in_cell").over(Window.partitionBy("pattern", "source").orderBy("cell")) - F.col("in_cell"))
    each = each.join(before.select("pattern", "source", "cell", "in_cell", "before"), ["pattern", "source", "cell"])
    edge = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("in_cell") > F.col("rest"))
    inside = each.where(edge).withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("pattern", "source").orderBy("order", "doc_id")))
    more = F.when(F.col("upto") <= F.col("rest"), 1).otherwise(0)
    chosen = inside.select("doc_id", "source", (F.col("rounds") + more).alias("copies")).unionByName(
        each.where(~edge).select("doc_id", "source", (F.col("rounds") + (F.col("before") + F.col("in_cell") <= F.col("rest")).cast("int")).alias("copies"))
    )
    return chosen.where("copies > 0").select("doc_id", "source", F.col("copies").cast("int").alias("copies"))
