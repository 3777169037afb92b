"""One surviving record per group of duplicates, chosen field by field.

Every value a source gives for a field of a group is a claim.  A two-sided quality model says how far to believe
claims: each source has a sensitivity (it gives a value that is true) and a specificity (it doesn't give one that is
false), found with the values' truth by expectation-maximisation.  Several values of a field may be judged true and
are then all retained.  The record that a field is taken from is the first by the field's rule of preference among
the claims; the model's verdict stands beside it.

Sources that cover a group without giving a value count against it.  The work is linear in the number of claims
however large a group is: nothing is made per pair of its records.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quipu.llm.common import bounded, cut, name_key, small, store
from quipu.operators.timestamps import with_instant

#: Rounds end when no value's truth moves by so much; there are MOST_ROUNDS at most.
TOLERANCE, MOST_ROUNDS = 1e-4, 200
PRIOR = 0.5
#: Sensitivity and specificity to begin with.
START = (0.8, 0.6)
#: Rows (pattern, source), about 60 bytes each, over which one task runs the rounds.
LOCAL_ROWS = 2_000_000
#: Claims a source is credited with beforehand, so that rare sources stay near the average.
PSEUDO = 2.0


def _in_task(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rounds of ``quality_model`` on arrays."""
    frames = list(parts)
    rows = pd.concat(frames, ignore_index=True) if frames else pd.DataFrame(columns=["pattern", "campo", "n", "source", "said"])
    rows = rows.sort_values(["pattern", "source"], kind="stable")
    names, at = np.unique(rows["pattern"].to_numpy("int64"), return_inverse=True)
    who = rows.groupby(["campo", "source"], sort=True)
    by, teller = who.ngroup().to_numpy("int64"), list(who.groups)
    said, n = rows["said"].to_numpy("float64"), rows["n"].to_numpy("float64")
    sens, spec = np.full(len(teller), START[0]), np.full(len(teller), START[1])
    p = np.full(len(names), -1.0)
    for _ in range(MOST_ROUNDS):
        vote = np.where(said == 1, np.log(sens / (1 - spec))[by], np.log((1 - sens) / spec)[by]) if len(rows) else said
        odds = np.clip(np.bincount(at, vote, len(names)) + log(PRIOR / (1 - PRIOR)), -40.0, 40.0)
        now = 1 / (1 + np.exp(-odds))
        moved = np.abs(now - p).max(initial=0.0)
        p = now
        if moved < TOLERANCE:
            break
        true, false = (np.bincount(by, n * x[at], len(teller)) for x in (p, 1 - p))
        hit, miss = (np.bincount(by, n * x[at] * said, len(teller)) for x in (p, 1 - p))
        sens = np.clip((hit + START[0] * PSEUDO) / (true + PSEUDO), 0.01, 0.99)
        spec = np.clip((false - miss + START[1] * PSEUDO) / (false + PSEUDO), 0.01, 0.99)
    yield pd.DataFrame({"pattern": names, "p_true": p}).assign(campo=None, source=None, sensitivity=None, specificity=None).astype({"source": "Int64", "sensitivity": "float64", "specificity": "float64"})
    yield pd.DataFrame({"campo": pd.Series([str(c) for c, _ in teller], dtype=object), "source": [x for _, x in teller], "sensitivity": sens, "specificity": spec}).assign(pattern=None, p_true=None)[["pattern", "p_true", "campo", "source", "sensitivity", "specificity"]].astype({"pattern": "Int64", "p_true": "float64", "source": "Int64"})


def quality_model(claims: DataFrame, covers: DataFrame | None = None, local: int = LOCAL_ROWS) -> tuple[DataFrame, DataFrame]:
    """EM over ``claims`` (grupo, campo, value, source; hashes will do): truth of values, quality of sources.

    ``covers`` (grupo, source) are the sources that have a record in a group; by default those with a claim in it.  Gives
    ``(grupo, campo, value, p_true)`` and ``(campo, source, sensitivity, specificity)``.  A value's odds depend only on the
    field, on who says it and on who covers the group, so the rounds run over the different patterns of these, with their
    counts, and not over the values; they end when no value's truth moves by TOLERANCE.  Up to ``local`` rows (pattern,
    source) they run within one task, beyond that as joins.
    """
    values = claims.groupBy("grupo", "campo", "value").agg(F.sort_array(F.collect_set("source")).alias("said"))
    covers = (claims if covers is None else covers).groupBy("grupo").agg(F.sort_array(F.collect_set("source")).alias("cover"))
    values = store(values.join(covers, "grupo").select("grupo", "campo", "value", "said", "cover", F.xxhash64("campo", "said", "cover").alias("pattern")))
    patterns = values.groupBy("pattern").agg(F.first("campo").alias("campo"), F.first("said").alias("said"), F.first("cover").alias("cover"), F.count("*").alias("n"))
    seen = cut(patterns.select("pattern", "campo", "n", F.explode("cover").alias("source"), "said").select("pattern", "campo", "n", "source", F.array_contains("said", F.col("source")).cast("int").alias("said")))
    if bounded(seen, local):
        out = cut(seen.coalesce(1).mapInPandas(_in_task, "pattern bigint, p_true double, campo string, source bigint, sensitivity double, specificity double"))
        truth, quality = out.where("pattern is not null").select("pattern", "p_true"), out.where("campo is not null").select("campo", "source", "sensitivity", "specificity")
    else:
        truth, quality = _joined(seen)
    return values.join(small(truth, 200_000), "pattern").select("grupo", "campo", "value", "p_true"), quality


def _joined(seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rounds for any number of patterns."""
    quality = seen.select("campo", "source").distinct().withColumns({"sensitivity": F.lit(START[0]), "specificity": F.lit(START[1])})
    truth = None
    for _ in range(MOST_ROUNDS):
        s, c = F.col("sensitivity"), F.col("specificity")
        vote = F.when(F.col("said") == 1, F.log(s / (1 - c))).otherwise(F.log((1 - s) / c))
        odds = seen.join(quality, ["campo", "source"]).groupBy("pattern").agg(F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.sum(vote) + log(PRIOR / (1 - PRIOR)))).alias("odds"))
        now = cut(odds.select("pattern", (1 / (1 + F.exp(-F.col("odds")))).alias("p_true")))
        moved = 1.0 if truth is None else now.join(truth.withColumnRenamed("p_true", "old"), "pattern").agg(F.coalesce(F.max(F.abs(F.col("p_true") - F.col("old"))), F.lit(0.0))).first()[0]
        truth = now
        if moved < TOLERANCE:
            break
        mass = seen.join(truth, "pattern").groupBy("campo", "source").agg(
            F.sum(F.col("n") * F.col("p_true")).alias("true"), F.sum(F.col("n") * (1 - F.col("p_true"))).alias("false"),
            F.sum(F.col("n") * F.col("p_true") * F.col("said")).alias("hit"), F.sum(F.col("n") * (1 - F.col("p_true")) * F.col("said")).alias("miss"))
        near = lambda e, name: F.greatest(F.lit(0.01), F.least(F.lit(0.99), e)).alias(name)
        quality = cut(mass.select(
            "campo", "source", near((F.col("hit") + START[0] * PSEUDO) / (F.col("true") + PSEUDO), "sensitivity"),
            near((F.col("false") - F.col("miss") + START[1] * PSEUDO) / (F.col("false") + PSEUDO), "specificity")))
    return truth, quality


def fuse(items: DataFrame, groups: DataFrame, rules: dict[str, tuple[Column, list[Column]]], source: str = "fuente", retained: bool = True) -> DataFrame:
    """``(grupo, campo, seq, p_true)`` and, if asked for, ``(value, retained)`` for every group of two or more records.

    ``groups`` is (seq, grupo); ``rules`` gives for each field its value (null: no claim) and the keys by which the
    largest record survives.  Ties go to the latest ``collected_at`` (undetermined is oldest), then the smallest seq.
    ``retained`` are all values judged true.  A field without a claim gives no row; repeated rows count once.
    """
    several = groups.groupBy("grupo").agg(F.countDistinct("seq").alias("n")).where("n > 1").select("grupo")
    member = store(groups.join(several, "grupo").select("seq", "grupo").distinct())
    timed = with_instant(items.join(member, "seq"), "collected_at", "collected_s", None, F.lit("UTC"))
    fields = [F.struct(F.lit(c).alias("campo"), v.cast("string").alias("text"), F.struct(*[k.cast("double") for k in keys], F.col("collected_s"), -F.col("seq"), F.xxhash64(v.cast("string"))).alias("rank")) for c, (v, keys) in rules.items()]
    who = F.xxhash64(F.coalesce(name_key(F.col(source)), F.lit(""))).alias("source")
    covers = items.select("seq", who).join(member, "seq").select("grupo", "source").distinct()
    claims = store(timed.select("seq", "grupo", who, F.inline(F.array(*fields))).where("text is not null").withColumn("value", F.xxhash64("text")).select("grupo", "campo", "value", "source", "rank", *["text"] * retained))
    truth, _ = quality_model(claims, covers)
    first = claims.groupBy("grupo", "campo").agg(F.max("rank").alias("rank"))
    first = first.select("grupo", "campo", *[F.col(f"rank.{k}").alias(n) for k, n in _last(claims, 2, ("seq", "value"))]).withColumn("seq", -F.col("seq"))
    rows = first.join(truth, ["grupo", "campo", "value"])
    if not retained:
        return rows.select("grupo", "campo", "seq", "p_true")
    texts = claims.groupBy("grupo", "campo", "value").agg(F.first("text").alias("text"))
    told = truth.join(texts, ["grupo", "campo", "value"])
    kept = told.groupBy("grupo", "campo").agg(F.sort_array(F.collect_set(F.when(F.col("p_true") >= 0.5, F.col("text")))).alias("retained"))
    rows = rows.join(texts, ["grupo", "campo", "value"]).join(kept, ["grupo", "campo"])
    return rows.select("grupo", "campo", "seq", F.col("text").alias("value"), "p_true", "retained")


def _last(claims: DataFrame, n: int, names: tuple[str, ...]) -> list[tuple[str, str]]:
    """The last fields of the rank, with the names they get."""
    return list(zip([f.name for f in claims.schema["rank"].dataType.fields][-n:], names))
