"""Words and word pairs of texts, counted row by row in Python: no row per word is ever shuffled.

A row's words come as one text with spaces between; those of one character don't count.  What is shuffled are counts of different terms, one per task, and what
is kept of a row is one binary of term numbers.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Different terms (some 100 bytes each) that a task counts before it hands them on and begins anew.
MOST_COUNTED = 500_000
_ALONE = (1 << 32) - 1


def _codes(texts: pd.Series, number: Callable[[str], int]) -> tuple[np.ndarray, np.ndarray]:
    """Row and code of each term: word and ``_ALONE``, or two words, of 32 bits each; words with negative numbers have none."""
    parts = [[w for w in x.split(" ") if len(w) > 1] for x in texts]
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    word = np.fromiter((number(w) for p in parts for w in p), "int64", len(row))
    pair = (row[1:] == row[:-1]) & (word[1:] >= 0) & (word[:-1] >= 0)
    code = np.concatenate([(word << 32 | _ALONE)[word >= 0], (word[:-1] << 32 | word[1:])[pair]])
    return np.concatenate([row[word >= 0], row[:-1][pair]]), code


def _grouped(row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, code and number of uses of each term of each row, by row and code."""
    names, at = np.unique(code, return_inverse=True)
    both, uses = np.unique(row * max(1, len(names)) + at, return_counts=True)
    return both // max(1, len(names)), names[both % max(1, len(names))], uses


def counted(df: DataFrame, words: str = "words") -> DataFrame:
    """``(term, uses, df)`` of all words and pairs: how often, and in how many rows."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, held = defaultdict(count().__next__), []

        def told() -> pd.DataFrame:
            names = list(known)
            terms = [names[c >> 32] if c & _ALONE == _ALONE else f"{names[c >> 32]} {names[c & _ALONE]}" for c in held[0][0].tolist()]
            return pd.DataFrame({"term": terms, "uses": held[0][1], "df": held[0][2]})

        for part in parts:
            _, code, uses = _grouped(*_codes(part[words], known.__getitem__))
            held.append((code, uses, np.ones(len(code), "int64")))
            code, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            held = [(code, *(np.bincount(at, np.concatenate([h[i] for h in held]), len(code)).astype("int64") for i in (1, 2)))]
            if len(code) > MOST_COUNTED:
                yield told()
                known, held = defaultdict(count().__next__), []
        if held and len(held[0][0]):
            yield told()

    each = df.select(words).mapInPandas(run, "term string, uses bigint, df bigint")
    return each.groupBy("term").agg(F.sum("uses").alias("uses"), F.sum("df").alias("df"))


def packed(df: DataFrame, terms: list[str], words: str = "words", kept: tuple[str, ...] = ("key",)) -> DataFrame:
    """The kept columns, all numbers or texts, with ``(ids, tf)``: numbers of the terms that a row holds, its place in ``terms``, and uses.

    Both are binaries, ids in order and of 16 bits if they suffice for all terms, uses of 8 bits if they suffice for the row and
    else of 32; rows without a known term have empty ones.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words_ = {w: i for i, w in enumerate(dict.fromkeys(w for t in terms for w in t.split(" ")))}
        code = np.array([words_[t[0]] << 32 | (words_[t[1]] if len(t) > 1 else _ALONE) for t in (t.split(" ") for t in terms)], "int64")
        order = np.argsort(code)
        code = code[order]
        number = words_.get
        for part in parts:
            row, found = _codes(part[words], lambda w: number(w, -1))
            at = np.minimum(np.searchsorted(code, found), max(0, len(code) - 1))
            here = code[at] == found if len(code) else np.zeros(len(found), bool)
            row, ids, uses = _grouped(row[here], order[at[here]])
            ends = np.searchsorted(row, np.arange(len(part) + 1)).tolist()
            ids, many = ids.astype(_kind(len(terms))), np.zeros(len(part), bool)
            many[row[uses > 255]] = True
            out = part[list(kept)].reset_index(drop=True)
            out["ids"] = [ids[a:b].tobytes() for a, b in zip(ends, ends[1:])]
            out["tf"] = [uses[a:b].astype("<u4" if m else "u1").tobytes() for a, b, m in zip(ends, ends[1:], many.tolist())]
            yield out

    rows = df.select(*kept, words)
    return rows.mapInPandas(run, ", ".join(f"{c} {kind}" for c, kind in df.select(*kept).dtypes) + ", ids binary, tf binary")


def _kind(terms: int) -> str:
    return "<u2" if terms <= 1 << 16 else "<u4"


def flat(ids: pd.Series, tf: pd.Series, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term number and uses of rows packed with so many terms."""
    kind = np.dtype(_kind(terms))
    size = np.fromiter((len(x) // kind.itemsize for x in ids), "int64", len(ids))
    uses = [np.frombuffer(t, "u1" if len(t) == n else "<u4") for t, n in zip(tf, size.tolist())]
    uses = np.concatenate(uses).astype("int64") if uses else np.empty(0, "int64")
    return np.repeat(np.arange(len(ids)), size), np.frombuffer(b"".join(ids), kind).astype("int64"), uses


def unit(row: np.ndarray, term: np.ndarray, uses: np.ndarray, idf: np.ndarray, rows: int) -> np.ndarray:
    """TF-IDF weights of flat rows, each row of length one: (1 + ln tf) x idf."""
    w = (1 + np.log(uses)) * idf[term]
    norm = np.sqrt(np.bincount(row, w * w, rows))
    return w / np.where(norm > 0, norm, 1)[row]
