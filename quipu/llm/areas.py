"""Subject areas of documents by class-association rules.

Rules of the form words -> area are mined with parallel frequent-pattern growth from the sentences of a sample of
labelled documents (at most SAMPLE_LABELLED) and, in a second round, of those and of as many unlabelled ones whose
sentences the first rules are sure of.  A rule is redundant if a part of its words says the same at least as surely.
Every sentence of every document is scored by the evidence of its matching rules; how sure a score is comes from a
monotone calibration on labels held out.  A document belongs to the areas that enough of its sentences belong to.

Labels are per document and partly wrong, which the rules survive as a wrong label is rarer than a right one.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import log

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quipu.llm.common import cut

SAMPLE_LABELLED = 4000
SAMPLE_PLAIN = 4000
#: Words (and pairs of neighbours) of a sentence that go into mining, those that tell areas apart best.
MOST_ITEMS = 6
LEAST_COUNT = 4
LEAST_CONFIDENCE = 0.3
#: Rules of one area that count for one sentence, the strongest.
MOST_EVIDENCE = 3
#: A sentence belongs to an area if the calibrated share of right cases at its score is this or more.
SURE, VERY_SURE = 0.5, 0.8
LEAST_SHARE = 0.25
NONE = "ninguna"


class _Folds(dict):
    def __missing__(self, code: int) -> str:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)).lower() if not unicodedata.combining(c))
        self[code] = out = "" if unicodedata.combining(chr(code)) else "".join(c if c.isalnum() else " " for c in base)
        return out


_FOLDS = _Folds()


def sentences(text: str) -> list[str]:
    """Sentences of a text: lines cut after closing punctuation; a piece without letters is none."""
    parts = (s for line in text.split("\n") for s in re.split(r"(?<=[.!?])[\"'”»)\]]*\s+", line))
    return [s for s in parts if re.search(r"[^\W\d_]", s)]


def items(sentence: str) -> set[str]:
    """Folded words without numbers, and pairs of neighbours."""
    words = [w for w in sentence.translate(_FOLDS).split() if not any(c.isdigit() for c in w)]
    return {w for w in words if len(w) > 2} | {f"{a}_{b}" for a, b in zip(words, words[1:]) if len(a) > 3 or len(b) > 3}


class Rules:
    """Evidence for areas by item set."""

    def __init__(self, rules: list[tuple[frozenset, str, float]]):
        self.by: dict[str, list[tuple[frozenset, str, float]]] = defaultdict(list)
        for words, area, weight in rules:
            self.by[min(words)].append((words, area, weight))
        self.curve: tuple[list[float], list[float]] = ([0.0], [1.0])

    def score(self, have: set[str]) -> tuple[str | None, float]:
        """Best area and its lead over the next."""
        found: dict[str, list[float]] = defaultdict(list)
        for w in have:
            for words, area, weight in self.by.get(w, ()):
                if len(words) == 1 or words <= have:
                    found[area].append(weight)
        if not found:
            return None, 0.0
        ranked = sorted(((sum(sorted(v)[-MOST_EVIDENCE:]), a) for a, v in found.items()), key=lambda x: (-x[0], x[1]))
        return ranked[0][1], ranked[0][0] - (ranked[1][0] if len(ranked) > 1 else 0.0)

    def sure(self, lead: float) -> float:
        return self.curve[1][max(0, bisect_right(self.curve[0], lead) - 1)]

    def calibrate(self, cases: list[tuple[float, bool]]) -> None:
        """Monotone share of right cases by lead, pooling neighbours that are out of order."""
        pools: list[list[float]] = []
        for lead, right in sorted(cases):
            pools.append([lead, float(right), 1.0])
            while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
                last = pools.pop()
                pools[-1][1] += last[1]
                pools[-1][2] += last[2]
        if pools:
            self.curve = ([float("-inf")] + [p[0] for p in pools], [pools[0][1] / pools[0][2]] + [p[1] / p[2] for p in pools])


class Told:
    """Sentences as tuples of item numbers, with the areas told of them; the driver holds no more than this."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self.names: list[str] = []
        self.rows: list[tuple[tuple[int, ...], tuple[str, ...]]] = []

    def add(self, sentence: str, areas: tuple[str, ...]) -> None:
        own = []
        for w in items(sentence):
            k = self.numbers.get(w)
            if k is None:
                k = self.numbers[w] = len(self.names)
                self.names.append(w)
            own.append(k)
        self.rows.append((tuple(own), areas))

    def words(self, row: tuple[int, ...]) -> set[str]:
        return {self.names[k] for k in row}


def mine(spark, told: Told, rows: list[tuple[tuple[int, ...], tuple[str, ...]]]) -> Rules:
    """Rules from (items, areas) of sentences; areas may be none."""
    total, by = Counter(), defaultdict(Counter)
    prior: Counter = Counter()
    for have, areas in rows:
        total.update(have)
        for a in areas:
            by[a].update(have)
            prior[a] += 1
    n = max(1, len(rows))
    base = {a: min(0.95, max(0.001, c / n)) for a, c in prior.items()}
    odds = lambda p: log((p + 1e-3) / (1 - p + 1e-3))
    tells = {w: max((odds((by[a][w] + 0.5) / (c + 1.0)) - odds(base[a]) for a in prior), default=0.0) for w, c in total.items() if c >= LEAST_COUNT}
    del by, total
    best = lambda have: sorted((w for w in have if tells.get(w, 0.0) > 0.5), key=lambda w: (-tells[w], told.names[w]))[:MOST_ITEMS]
    kept = ((" ".join(map(str, sorted(best(have)))), areas) for have, areas in rows)
    lines = [words + "".join(f" ={a}" for a in areas) for words, areas in kept if words]
    if not lines:
        return Rules([])
    frame = spark.createDataFrame(pd.DataFrame({"line": lines})).select(F.split("line", " ").alias("items"))
    count = len(lines)
    model = FPGrowth(itemsCol="items", minSupport=LEAST_COUNT / count, minConfidence=LEAST_CONFIDENCE).fit(frame)
    of_area = model.associationRules.where("consequent[0] like '=%' and not exists(antecedent, x -> x like '=%')")
    # confidence shrunk towards the area's share, so that rare words aren't trusted beyond their count
    sure = {}
    for r in of_area.select("antecedent", "consequent", "confidence", "support").toLocalIterator():
        a, c, k = r["consequent"][0][1:], r["confidence"], r["support"] * count
        sure[frozenset(int(x) for x in r["antecedent"]), a] = (k + 2 * base[a]) / (k / c + 2)
    out = []
    for (w, a), c in sure.items():
        parts = [w - {x} for x in w] if len(w) > 1 else []
        if len(w) > 2:
            parts += [frozenset([x]) for x in w]
        if not any(sure.get((p, a), -1.0) >= c - 0.02 for p in parts) and c > base[a]:
            weight = odds(c) - odds(base[a])
            if weight > 0.3:
                out.append((frozenset(told.names[x] for x in w), a, weight))
    return Rules(out)


def learn(documents: DataFrame, labels: DataFrame) -> Rules:
    """Rules from the labelled sample; every fourth labelled document is kept for calibration."""
    spark = documents.sparkSession
    marks = labels.where("doc_id is not null and trim(area) <> ''").groupBy("doc_id").agg(F.collect_set(F.lower(F.trim("area"))).alias("areas"))
    order = F.xxhash64(F.lit("areas"), "doc_id")
    texts = documents.where("text is not null and doc_id is not null").select("doc_id", "text")
    # ids are chosen first, then their texts are fetched by a broadcast of these few
    ids = texts.select("doc_id").distinct()
    labelled = ids.join(marks, "doc_id").orderBy(order, "doc_id").limit(SAMPLE_LABELLED)
    unlabelled = ids.join(marks.select("doc_id"), "doc_id", "left_anti").orderBy(order, "doc_id").limit(SAMPLE_PLAIN)
    one, plain = (cut(texts.join(F.broadcast(cut(x)), "doc_id")).orderBy(order, "doc_id") for x in (labelled, unlabelled))
    told = Told()
    held_from: list[bool] = []
    for i, r in enumerate(one.toLocalIterator()):
        for s in sentences(r["text"]):
            told.add(s, tuple(sorted(r["areas"])))
            held_from.append(i % 4 == 0)
    labelled = len(told.rows)
    held = [x for x, h in zip(told.rows, held_from) if h]
    fit = [x for x, h in zip(told.rows, held_from) if not h]

    def judge(rules: Rules) -> None:
        cases = ((rules.score(told.words(have)), areas) for have, areas in held)
        rules.calibrate([(lead, area in areas) for (area, lead), areas in cases if area is not None])

    rules = mine(spark, told, fit)
    judge(rules)
    for r in plain.toLocalIterator():
        for s in sentences(r["text"]):
            told.add(s, ())
    again = []
    for have, _ in fit + told.rows[labelled:]:
        area, lead = rules.score(told.words(have))
        again.append((have, (area,) if area is not None and rules.sure(lead) >= VERY_SURE else ()))
    better = mine(spark, told, again)
    judge(better)
    return better if better.by else rules


def document_areas(documents: DataFrame, labels: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """``(doc_id, area, share)``: areas that at least ``least`` of the document's sentences belong to.

    Null, empty and sentence-less texts have none, nor do documents about no area.  Repeated rows count once.
    """
    rules = learn(documents, labels)
    shared = documents.sparkSession.sparkContext.broadcast((dict(rules.by), rules.curve))

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Rules([])
        own.by, own.curve = shared.value
        for part in parts:
            rows = []
            for doc, text in zip(part["doc_id"], part["text"]):
                whole = sentences(text)
                count: Counter = Counter()
                for s in whole:
                    area, lead = own.score(items(s))
                    if area is not None and area != NONE and own.sure(lead) >= SURE:
                        count[area] += 1
                rows += [(doc, a, n / len(whole)) for a, n in count.items() if n >= least * len(whole)]
            yield pd.DataFrame(rows, columns=["doc_id", "area", "share"])

    return documents.where("doc_id is not null and text is not null").select("doc_id", "text").mapInPandas(each, "doc_id bigint, area string, share double").distinct()


def composition(areas: DataFrame, documents: DataFrame) -> DataFrame:
    """``(area, documents, share)`` of the corpus; documents without area are counted under ``ninguna``."""
    total = documents.select("doc_id").distinct()
    rows = total.join(areas.select("doc_id", "area"), "doc_id", "left").groupBy(F.coalesce("area", F.lit(NONE)).alias("area")).agg(F.count("*").alias("documents"))
    return rows.crossJoin(F.broadcast(total.agg(F.count("*").alias("n")))).select("area", "documents", (F.col("documents") / F.col("n")).alias("share"))
