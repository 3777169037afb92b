"""Passages of held-out items inside a corpus, by q-gram filtering and banded alignment.

Both sides become lower-case words without accents, one space between.  The items' q-grams are one sorted hash array,
which every Python worker builds once and holds; its size is bounded.  Tasks hash every position of their documents, keep those in the array,
and count them by (document, item, band of diagonals).  A passage of L characters with at most e word edits shares at
least L - q + 1 - e * (q + W) q-grams within one band, W being the longest word of the item; regions that reach this
bound are aligned word by word along the band.  Items that are too many for one array are taken in blocks, by the hash
of their id, each against all documents; the driver holds one block at a time.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_WORDS = 12
#: Item characters that one worker holds, about 40 bytes each; more items are taken block by block.
BLOCK_CHARS = 4_000_000
#: Hits of grams that are counted together, about 60 bytes each.
HITS_AT_ONCE = 2_000_000
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Table(dict):
    """Character to what stands for it: its base letter in lower case, or a space."""

    def __missing__(self, code: int) -> str:
        out = "".join(c for c in unicodedata.normalize("NFKD", chr(code)).lower() if not unicodedata.combining(c))
        self[code] = got = "" if unicodedata.combining(chr(code)) else "".join(c if c.isalnum() else " " for c in out)
        return got


_TABLE = _Table()


def words(text: str | None) -> str:
    """Words of a text, one space between."""
    return " ".join((text or "").translate(_TABLE).split())


def _grams(data: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q bytes from each position on; q is 8 or 16."""
    n = len(data) - q + 1
    if n <= 0:
        return np.empty(0, "uint64")
    eight = np.zeros(len(data) - 7, "uint64")
    for k in range(8):
        eight |= data[k : len(data) - 7 + k].astype("uint64") << np.uint64(8 * k)
    with np.errstate(over="ignore"):
        h = eight[:n] * _K1
        if q == 16:
            h ^= (eight[8 : 8 + n] * _K2) >> np.uint64(7)
            h *= _K2
        return h ^ (h >> np.uint64(29))


class Items:
    """Items as q-gram index."""

    def __init__(self, items: list[tuple[int, str]], least: int, edits: int):
        self.least, self.edits = least, edits
        self.words = {i: words(t).split(" ") for i, t in items}
        self.words = {i: w for i, w in self.words.items() if w != [""]}
        self.need: dict[int, int] = {}
        self.names: list[int] = []
        region = {}
        for i, w in self.words.items():
            k = min(least, len(w))
            region[i] = min(len(" ".join(w[s : s + k]).encode()) for s in range(len(w) - k + 1))
        self.short = {i for i, n in region.items() if n < 8}
        self.q = 16 if all(n >= 16 + edits * 24 for i, n in region.items() if i not in self.short) else 8
        hashes, owners, places = [], [], []
        for i, w in self.words.items():
            if i in self.short:
                continue
            data = np.frombuffer(" ".join(w).encode(), "uint8")
            h = _grams(data, self.q)
            hashes.append(h)
            owners.append(np.full(len(h), len(self.names), "int32"))
            places.append(np.arange(len(h), dtype="int32"))
            self.names.append(i)
            self.need[i] = max(1, region[i] - self.q + 1 - edits * (self.q + max(map(len, w))))
        cat = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
        h, o, p = cat(hashes, "uint64"), cat(owners, "int32"), cat(places, "int32")
        by = np.argsort(h, kind="stable")
        self.hash, self.owner, self.place = h[by], o[by], p[by]
        bits = max(16, int(len(h) * 8).bit_length())
        self.shift = np.uint64(64 - bits)
        self.sieve = np.zeros(1 << bits, bool)
        self.sieve[self.hash >> self.shift] = True
        self.least_of = np.array([self.need[i] for i in self.names], "int64")
        self.band = max(1, edits * 24)

    def found(self, docs: list[str]) -> Iterator[tuple[int, int]]:
        """(place of the document, item) of every leak."""
        coded = [d.encode() for d in docs]
        data = np.frombuffer(b"\0\0".join(coded) + b"\0" * 16, "uint8")
        starts = np.cumsum([0] + [len(c) + 2 for c in coded])
        h = _grams(data, self.q)
        at = np.flatnonzero(self.sieve[h >> self.shift])
        low = np.searchsorted(self.hash, h[at], "left")
        n = np.searchsorted(self.hash, h[at], "right") - low
        at, low, n = at[n > 0], low[n > 0], n[n > 0]
        out = set()
        if len(at):
            # grams that many items share are counted in arrays, a few million hits at a time
            ends = np.cumsum(n)
            codes, sums = np.empty(0, "int64"), np.empty(0, "int64")
            span = (int(starts[-1]) + int(self.place.max(initial=0))) // self.band + 3
            for first in range(0, int(ends[-1]), HITS_AT_ONCE):
                i, j = np.searchsorted(ends, [first, first + HITS_AT_ONCE], "right")
                j = min(j + 1, len(n))
                lows, ns, pos_ = low[i:j], n[i:j], at[i:j]
                begin = np.maximum(first - (ends[i:j] - ns), 0)
                stop = np.minimum(first + HITS_AT_ONCE - (ends[i:j] - ns), ns)
                ns = np.maximum(stop - begin, 0)
                hit = np.repeat(lows + begin, ns) + np.arange(ns.sum()) - np.repeat(np.cumsum(ns) - ns, ns)
                pos = np.repeat(pos_, ns)
                doc = np.searchsorted(starts, pos, "right") - 1
                band = (pos - starts[doc] - self.place[hit]) // self.band + int(self.place.max(initial=0)) // self.band + 1
                code = (doc * len(self.names) + self.owner[hit]) * span + band
                codes, back = np.unique(np.concatenate([codes, code]), return_inverse=True)
                sums = np.bincount(back, np.concatenate([sums, np.ones(len(code), "int64")]), len(codes)).astype("int64")
            reach = sums.copy()
            if self.edits:
                after = np.searchsorted(codes, codes + 1)
                after[after == len(codes)] = 0
                reach += np.where(codes[after] == codes + 1, sums[after], 0)
            some = np.flatnonzero(reach >= self.least_of[codes // span % len(self.names)])
            bands: dict[tuple[int, int], list[int]] = defaultdict(list)
            for c in codes[some].tolist():
                bands[c // span // len(self.names), self.names[c // span % len(self.names)]].append(c % span - int(self.place.max(initial=0)) // self.band - 1)
            cache: dict[int, list[str]] = {}
            for (d, i), own in bands.items():
                w = cache.setdefault(d, docs[d].split(" "))
                if self._aligned(w, i, [(b * self.band, (b + 2 if self.edits else b + 1) * self.band) for b in own]):
                    out.add((d, i))
        for i in self.short:
            whole = " " + " ".join(self.words[i]) + " "
            out |= {(d, i) for d, t in enumerate(docs) if whole in f" {t} "}
        yield from sorted(out)

    def _aligned(self, doc: list[str], item: int, bands: list[tuple[int, int]]) -> bool:
        """Whether some window of the item's words lies in the document within the edits, on the bands' diagonals."""
        w, e = self.words[item], self.edits
        k = min(self.least, len(w))
        doc_at = np.cumsum([0] + [len(x.encode()) + 1 for x in doc])
        item_at = np.cumsum([0] + [len(x.encode()) + 1 for x in w])
        for low, high in bands:
            for s in range(len(w) - k + 1):
                want = w[s : s + k]
                first = np.searchsorted(doc_at, item_at[s] + low - e * 24, "left")
                last = np.searchsorted(doc_at, item_at[s] + high + e * 24, "right")
                for t in range(max(0, int(first)), min(len(doc), int(last))):
                    if e == 0:
                        if doc[t : t + k] == want:
                            return True
                    elif _within(want, doc[t : t + k + e], e):
                        return True
        return False


def _within(want: list[str], have: list[str], edits: int) -> bool:
    """Whether ``want`` and some beginning of ``have`` are within so many word edits; only the band is computed."""
    row = {j: j for j in range(min(edits, len(have)) + 1)}
    for i, x in enumerate(want, 1):
        new = {}
        for j in range(max(0, i - edits), min(len(have), i + edits) + 1):
            best = min(row.get(j, 99) + 1, new.get(j - 1, 99) + 1)
            if j:
                best = min(best, row.get(j - 1, 99) + (x != have[j - 1]))
            new[j] = best
        row = new
        if not row or min(row.values()) > edits:
            return False
    return min(row.values()) <= edits


def leaked_items(documents: DataFrame, items: DataFrame, least: int = LEAST_WORDS, edits: int = 0) -> DataFrame:
    """``(doc_id, item_id)``: the document holds ``least`` consecutive words of the item (all of them, if it has fewer),
    up to ``edits`` words replaced, added or missing.

    Null and empty texts, and items without words, hold and are held by nothing.  Repeated rows count once.
    """
    known = items.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    chars = known.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // BLOCK_CHARS))
    out = None
    for block in range(blocks):
        rows = known.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else known
        shared = documents.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in rows.toLocalIterator()])
        name = f"{shared._jbroadcast.id()}-{least}-{edits}"

        def scan(parts: Iterator[pd.DataFrame], shared=shared, name=name) -> Iterator[pd.DataFrame]:
            import sys
            import types

            # workers serve many tasks; the last index stays with them
            held = sys.modules.setdefault("_quipu_leaks", types.ModuleType("_quipu_leaks"))
            if getattr(held, "name", None) != name:
                held.index = None
                held.index, held.name = Items(shared.value, least, edits), name
            for part in parts:
                for s in range(0, len(part), 500):
                    some = part.iloc[s : s + 500]
                    ids = some["doc_id"].tolist()
                    rows = [(ids[d], i) for d, i in held.index.found([words(t) for t in some["text"]])]
                    yield pd.DataFrame(rows, columns=["doc_id", "item_id"])

        now = documents.where("doc_id is not null and text is not null").select("doc_id", "text").mapInPandas(scan, "doc_id bigint, item_id bigint")
        out = now if out is None else out.unionByName(now)
    return out.distinct()
