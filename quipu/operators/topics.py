"""Topics of packed texts: the EM of MLlib's LDA over rows of many texts each, and topics of texts by a fitted table.

A row of a block table holds the term numbers and uses of some texts as binaries and beside them the texts' expected uses of
each topic, so an iteration reads and writes one table, shuffles nothing and hands on one sum of terms by topics a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quipu.operators import grams
from quipu.operators.lineage import drop, place

#: Texts of a block, and those that are worked out at once, so that their terms stay in a core's cache.
BLOCK, CHUNK = 4096, 256
#: Sums of tasks (8 bytes a term and topic) that go to the driver at once.
SUMS = 16
#: Mean change of a text's expected uses below which its topics stand, as in MLlib and the reference.
STILL = 1e-3
_SCHEMA = "ids binary, tf binary, size binary, state binary, sums binary"


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well mixed 64 bits of each number (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def start(text: np.ndarray, term: np.ndarray, k: int, seed: int) -> np.ndarray:
    """First shares ``(topic, use)`` of topics in each term of a text: random by the text's hash, so they don't depend on where it lies."""
    both = _mixed(_mixed(text.astype("int64").view("uint64") ^ np.uint64(seed)) + term.astype("uint64"))
    share = np.array([(_mixed(both + np.uint64(i)) >> np.uint64(11)) * 2.0**-53 for i in range(k)])
    return share / share.sum(axis=0)


def _sums(start_: np.ndarray, size: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sums of consecutive parts, none of which is empty."""
    return np.add.reduceat(x, start_) if len(size) else np.empty(0)


def _chunks(size: np.ndarray) -> Iterator[tuple[slice, slice, np.ndarray, np.ndarray]]:
    """Texts and their uses, a chunk at a time: slices of both, sizes and where they begin."""
    ends = np.append(0, np.cumsum(size))
    for a in range(0, len(size), CHUNK):
        own = slice(a, min(a + CHUNK, len(size)))
        yield own, slice(ends[own.start], ends[own.stop]), size[own], ends[own] - ends[own.start]


def _blocks(packed: DataFrame, terms: int, k: int, seed: int) -> DataFrame:
    """Block table of packed texts ``(key, ids, tf)`` with terms, by their first shares; key is the hash of a text."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, terms))
        for part in parts:
            for a in range(0, len(part), BLOCK):
                p = part.iloc[a : a + BLOCK]
                row, term, uses = grams.flat(p["ids"], p["tf"], terms)
                size, key = np.bincount(row, minlength=len(p)), p["key"].to_numpy()
                state = np.empty((k, len(p)))
                for own, at, n, begin in _chunks(size):
                    share = start(np.repeat(key[own], n), term[at], k, seed) * uses[at]
                    for i in range(k):
                        state[i, own] = _sums(begin, n, share[i])
                        total[i] += np.bincount(term[at], share[i], terms)
                kind = "u1" if uses.max() < 256 else "<u4"
                yield _row(b"".join(p["ids"]), uses.astype(kind).tobytes(), size.astype("<u4").tobytes(), state.tobytes(), None)
        yield _row(None, None, None, None, total.tobytes())

    return packed.select("key", "ids", "tf").mapInPandas(run, _SCHEMA)


def _row(*cells: bytes | None) -> pd.DataFrame:
    return pd.DataFrame([cells], columns=["ids", "tf", "size", "state", "sums"], dtype="object")


def _next(blocks: DataFrame, weight: np.ndarray, rest: float) -> DataFrame:
    """The block table after one iteration; weight ``(topic, term)`` are the terms' weights, rest is what is added to a text's uses."""
    k, terms = weight.shape
    kind, weight = grams._kind(terms), weight.astype("float32")  # of single uses; sums over texts are in full precision

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, terms))
        for part in parts:
            for r in part.itertuples():
                size = np.frombuffer(r.size, "<u4").astype("int64")
                ids = np.frombuffer(r.ids, kind)
                uses = np.frombuffer(r.tf, "u1" if len(r.tf) == len(ids) else "<u4")
                old = (np.frombuffer(r.state).reshape(k, len(size)) + rest).astype("float32")
                state = np.empty((k, len(size)))
                for own, at, n, begin in _chunks(size):
                    term = ids[at].astype("intp")
                    each = [weight[i][term] * np.repeat(old[i, own], n) for i in range(k)]
                    share = uses[at].astype("float32") / sum(each)
                    for i, x in enumerate(each):
                        x *= share
                        state[i, own] = _sums(begin, n, x)
                        total[i] += np.bincount(term, x, terms)
                yield _row(r.ids, r.tf, r.size, state.tobytes(), None)
        yield _row(None, None, None, None, total.tobytes())

    return blocks.where("ids is not null").mapInPandas(run, _SCHEMA)


def _total(blocks: DataFrame, k: int) -> np.ndarray:
    """Expected uses ``(topic, term)`` in all texts."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for part in parts:
            for x in part["sums"]:
                total = np.frombuffer(x) + (0 if total is None else total)
        if total is not None:
            yield pd.DataFrame({"sums": [total.tobytes()]})

    each = blocks.where("sums is not null").select("sums")
    if len(blocks.inputFiles()) > SUMS:
        each = each.coalesce(SUMS).mapInPandas(run, "sums binary")
    return sum(np.frombuffer(r["sums"]) for r in each.collect()).reshape(k, -1)


def fit(packed: DataFrame, terms: int, k: int, iterations: int, text: float, topic: float, seed: int) -> np.ndarray:
    """Expected uses ``(topic, term)`` after so many iterations over all packed texts ``(key, ids, tf)``, as MLlib's EM has them.

    text and topic are the concentrations, both above 1.  An iteration gives each use of a term to the topics by
    (uses of the topic in the text + text - 1) x (uses of the term in the topic + topic - 1) / (uses of the topic + terms x (topic - 1)).
    """
    spark = packed.sparkSession
    total, path, table = None, None, None
    for i in range(iterations + 1):
        if total is None:
            made = _blocks(packed.where("length(ids) > 0"), terms, k, seed)
        else:
            made = _next(table, (total + topic - 1) / (total.sum(axis=1, keepdims=True) + terms * (topic - 1)), text - 1)
        before, path = path, place(spark)
        made.write.option("compression", "uncompressed").option("parquet.enable.dictionary", "false").parquet(path)
        table = spark.read.schema(_SCHEMA).parquet(path)
        total = _total(table, k)
        drop(spark, [before] if before else [])
    drop(spark, [path])
    return total


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of the logarithm of the gamma function, of numbers from 0 on: six steps up, then a series."""
    x = np.asarray(x, "float64")
    with np.errstate(divide="ignore"):
        less = sum(1 / (x + i) for i in range(6))
    x = x + 6
    y = 1 / (x * x)
    return np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132)))) - less


def infer(packed: DataFrame, table: np.ndarray, text: np.ndarray, kind: str = "bigint") -> DataFrame:
    """``(key, topics)``: shares of the topics in packed texts by variational Bayes, from a start where all topics are alike.

    table ``(topic, term)`` are expected uses, text the concentrations of topics in a text; a text without terms has zeros.
    """
    k, terms = table.shape
    weight = np.exp(digamma(table) - digamma(table.sum(axis=1))[:, None])
    weight = (weight / np.maximum(weight.max(axis=0), 1e-300)).astype("float32")  # a factor of all topics of a term cancels out

    def topics(term: np.ndarray, uses: np.ndarray, size: np.ndarray) -> np.ndarray:
        out, rows = np.empty((len(size), k)), np.arange(len(size))
        each, uses, now, moving = weight[:, term], uses.astype("float32"), np.ones((len(size), k)), np.ones(len(size), bool)
        while moving.any():
            if moving.sum() < 0.7 * len(rows):  # texts that stand are left out, but not a few at a time
                use = np.repeat(moving, size)
                rows, size, uses, each, now, moving = rows[moving], size[moving], uses[use], each[:, use], now[moving], moving[moving]
            share = np.exp(digamma(now) - digamma(now.sum(axis=1))[:, None]).astype("float32")
            norm = np.repeat(share[:, 0], size) * each[0]
            for i in range(1, k):
                norm += np.repeat(share[:, i], size) * each[i]
            part, begin = uses / (norm + np.float32(1e-30)), np.append(0, np.cumsum(size)[:-1])
            new = np.column_stack([share[:, i] * _sums(begin, size, e * part) for i, e in enumerate(each)]) + text
            out[rows[moving]] = new[moving]
            moving &= np.abs(new - now).mean(axis=1) > STILL
            now = new
        return out / out.sum(axis=1, keepdims=True)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            row, term, uses = grams.flat(part["ids"], part["tf"], terms)
            size, out = np.bincount(row, minlength=len(part)), np.zeros((len(part), k))
            some = np.flatnonzero(size)
            for own, at, n, _ in _chunks(size[some]):
                out[some[own]] = topics(term[at], uses[at].astype("float64"), n)
            yield pd.DataFrame({"key": part["key"], "topics": list(out)})

    return packed.select("key", "ids", "tf").mapInPandas(run, f"key {kind}, topics array<double>")
