"""Text read in the wrong character encoding: find the fields and restore what was written.

A wrong reading leaves ASCII alone and turns every other character, or a run of them, into something else:
a substitution cipher whose key is the pair of code pages.  The runs of non-ASCII characters are the cipher's
symbols.  Per source, expectation-maximisation weighs the keys against a bigram model of the language:

* the model is the corpus itself: how often a symbol stands after its left and before its right neighbour;
* E: a symbol between two neighbours stands for itself or for what one of the keys makes of it, with weight
  (symbol count in that place under the model) x (weight of the key in that source);
* M: the model's counts and the sources' key weights become the expected ones.

Wrong symbols are a minority beside the right ones in the same place, so their own counts vanish within a few
rounds.  Everything runs on counts by (source, left, symbol, right), which is far smaller than the text; the
result is a table of replacements that is then applied to every text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from quipu.llm.common import bounded, cut, name_key

# Code pages that texts are written in, and those they are wrongly read in (Python codec names).
WRITTEN = ["utf-8", "cp1252"]
READ = ["latin-1", "cp1252", "mac_roman", "cp850", "cp437", "cp1251", "cp1250", "koi8_r", "cp866", "cp852", "cp1253", "iso8859_15"]
ROUNDS = 3
#: Weight of a neighbour's kind beside the neighbour itself.
BACKOFF = 0.02
#: Places that one task learns from; about 300 bytes each there.
LOCAL_ROWS = 400_000
#: Replacements are broadcast up to this many rows (under 100 bytes each); beyond that they are joined.
BROADCAST_ROWS = 300_000
_RUN = re.compile("[^\\x00-\\x7f]+")
_CANDIDATES = ArrayType(StructType([StructField("key", StringType()), StructField("true", StringType())]))


def _tables(codec: str) -> dict[str, int]:
    """Byte of each character of a single-byte code page; undefined bytes are the control characters of that number."""
    table = {}
    for b in range(256):
        try:
            ch = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            ch = chr(b)
        table.setdefault(ch, b)
    return table


def _reread(text: str, table: dict[str, int], written: str) -> str | None:
    try:
        return bytes(table[c] for c in text).decode(written)
    except (KeyError, UnicodeDecodeError):
        return None


def _plain(text: str) -> bool:
    """Whether a text could have been written so: no control, private, box or replacement characters."""
    return all(c in "\n\t\r" or (c.isprintable() or c == " " or c == "­") and not 0x2400 <= ord(c) <= 0x25FF and c != "�" for c in text)


def readings(symbol: str, tables: dict[str, dict[str, int]]) -> list[tuple[str, str]]:
    """What a symbol may stand for: (key, text) for every pair of code pages, applied once or twice."""
    found: dict[str, str] = {}
    for read, table in tables.items():
        for written in WRITTEN:
            once = _reread(symbol, table, written)
            if once is None or once == symbol:
                continue
            if _plain(once):
                found.setdefault(once, f"{written}>{read}")
            if written == "utf-8":
                for again, other in tables.items():
                    twice = _reread(once, other, written)
                    if twice and twice != symbol and _plain(twice):
                        found.setdefault(twice, f"{written}>{again}>{read}")
    return [(k, t) for t, k in found.items()]


@F.pandas_udf(_CANDIDATES)
def _readings(symbols: Iterator[pd.Series]) -> Iterator[pd.Series]:
    tables = {c: _tables(c) for c in READ}
    for s in symbols:
        yield s.map(lambda u: [{"key": k, "true": t} for k, t in readings(u, tables)])


def places(text: str) -> Iterator[tuple[str, str, str]]:
    """(left, symbol, right) of every run of non-ASCII characters; the text's ends count as line ends."""
    for m in _RUN.finditer(text):
        i, j = m.span()
        left, right = text[i - 1 : i] or "\n", text[j : j + 1] or "\n"
        yield "\n" if left == "\r" else left, m.group(), "\n" if right == "\r" else right


def _class(c: Column) -> Column:
    """Kind of a neighbour, for neighbours that a symbol hasn't been seen with."""
    return F.when(c.rlike("[a-z]"), "a").when(c.rlike("[A-Z]"), "A").when(c.rlike("[0-9]"), "0").when(c.rlike(r"\s"), " ").otherwise(".")


def count_places(items: DataFrame, columns: list[str], source: str = "fuente") -> DataFrame:
    """``(source, left, symbol, right, n)``: how often each symbol stands in each place; tables of parts of a corpus add up.

    Each batch of texts is counted before anything is shuffled.
    """

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            n: Counter = Counter()
            for c in columns:
                for s, text in zip(part["__source"], part[c]):
                    if text and not text.isascii():
                        n.update((s, *p) for p in places(text))
            yield pd.DataFrame([(*k, v) for k, v in n.items()], columns=["source", "left", "symbol", "right", "n"])

    rows = items.select(F.coalesce(name_key(F.col(source)), F.lit("")).alias("__source"), *columns)
    counts = rows.mapInPandas(count, "source string, left string, symbol string, right string, n bigint")
    return counts.groupBy("source", "left", "symbol", "right").agg(F.sum("n").alias("n"))


def learn(items: DataFrame, columns: list[str], source: str = "fuente", rounds: int = ROUNDS) -> DataFrame:
    """Replacements learned from the texts themselves, see ``learn_counts``.

    Null texts count as empty, a null source is a source of its own.
    """
    return learn_counts(cut(count_places(items, columns, source)), rounds)


def learn_counts(counts: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``(source, left, symbol, right, true)``: the symbols that stand for something else, by place and source.

    ``true`` is null where a symbol is surely wrong but nothing fits (replacement and control characters).
    Up to LOCAL_ROWS places the rounds run within one task, beyond that as joins; the result is the same.
    """
    if bounded(counts, LOCAL_ROWS):
        return cut(counts.coalesce(1).mapInPandas(_within_task(rounds), "source string, left string, symbol string, right string, true string"))
    return learn_joined(counts, rounds)


def _within_task(rounds: int):
    """The rounds of ``learn_joined`` on arrays."""

    def groups(*columns: np.ndarray) -> np.ndarray:
        """Number of the group of each row, equal rows in equal groups."""
        code = np.zeros(len(columns[0]), "int64")
        for c in columns:
            _, own = np.unique(c, return_inverse=True)
            _, code = np.unique(code * (own.max(initial=0) + 1) + own, return_inverse=True)
        return code

    def kinds(values: np.ndarray) -> np.ndarray:
        kind = lambda c: "a" if re.match("[a-z]", c) else "A" if re.match("[A-Z]", c) else "0" if re.match("[0-9]", c) else " " if re.match(r"[ \t\n\x0b\f\r]", c) else "."
        table = {c: kind(c) for c in set(values.tolist())}
        return np.array([table[c] for c in values.tolist()], dtype=object)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["source", "left", "symbol", "right"]
        frames = list(parts)
        df = pd.concat(frames, ignore_index=True) if frames else pd.DataFrame(columns=[*columns, "n"])
        if not len(df):
            return
        tables = {c: _tables(c) for c in READ}
        known = df.groupby("symbol")["n"].sum().to_dict()
        keys = {u: [(k, t) for k, t in readings(u, tables) if t in known] for u in known}
        rows, keyed, true = [], [], []
        for i, u in enumerate(df["symbol"].tolist()):
            for k, t in [("", u), *keys[u]]:
                rows.append(i)
                keyed.append(k)
                true.append(t)
        row = np.array(rows)
        key, what = np.array(keyed, dtype=object), np.array(true, dtype=object)
        left, right, source = (df[c].to_numpy(object)[row] for c in ("left", "right", "source"))
        n = df["n"].to_numpy("float64")[row]
        itself = key == ""
        lc, rc = kinds(left), kinds(right)
        many = np.bincount(row)[row] > 1
        ids = {"near": groups(left, what, right), "before": groups(left, what), "after": groups(right, what), "lc": groups(lc, what), "rc": groups(rc, what), "alone": groups(what), "share": groups(source, key), "source": groups(source)}
        w = itself.astype("float64")
        share = np.ones(len(row))
        for step in range(rounds):
            sums = {k: np.bincount(ids[k], weights=n * w)[ids[k]] for k in ("near", "before", "after", "lc", "rc", "alone")}
            less = {k: np.maximum(v - itself, 0.0) for k, v in sums.items()}
            top = (less["before"] + BACKOFF * less["lc"]) * (less["after"] + BACKOFF * less["rc"])
            smooth = np.divide(top, less["alone"], out=np.zeros_like(top), where=less["alone"] > 0)
            rated = share * (less["near"] + smooth)
            total = np.bincount(row, weights=rated)[row]
            w = np.where(many, np.where(total > 0, rated / np.where(total > 0, total, 1.0), itself.astype("float64")), 1.0)
            mass = np.bincount(ids["share"], weights=np.where(many, n * w, 0.0))[ids["share"]]
            whole = np.bincount(ids["source"], weights=np.where(many, n * w, 0.0))[ids["source"]]
            share = (mass + 1) / (whole + 1)
        own = np.zeros(len(df))
        own[row[itself]] = w[itself]
        best: dict[int, tuple] = {}
        for i, t, k, x in zip(row.tolist(), what.tolist(), key.tolist(), w.tolist()):
            best[i] = max(best.get(i, (-1.0, "", "")), (x, k, t))
        out = []
        for i, r in enumerate(df[columns].itertuples(index=False)):
            if own[i] < 0.5:
                out.append((*r, best[i][2]))
            elif re.search("[\ufffd\u0080-\u009f]", r.symbol):
                out.append((*r, max(((known[t], t) for _, t in keys[r.symbol]), default=(0, None))[1]))
        yield pd.DataFrame(out, columns=[*columns, "true"])

    return run


def learn_joined(counts: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``learn_counts`` for any number of places."""
    keys = counts.select("symbol").distinct().withColumn("reading", F.explode(_readings("symbol"))).select("symbol", "reading.key", "reading.true")
    # a reading counts only if the corpus has it as a symbol of its own
    known = counts.groupBy(F.col("symbol").alias("true")).agg(F.sum("n").alias("known"))
    keys = cut(keys.join(known, "true", "left_semi"))
    open_ = counts.join(keys.select("symbol").distinct(), "symbol", "left_semi")
    closed = counts.join(keys.select("symbol").distinct(), "symbol", "left_anti").select("source", "left", F.col("symbol").alias("true"), "right", F.col("n").cast("double").alias("n"))
    identity = open_.withColumns({"key": F.lit(""), "true": F.col("symbol")})
    options = cut(identity.unionByName(open_.join(keys, "symbol")).withColumns({"lc": _class(F.col("left")), "rc": _class(F.col("right"))}))
    group = ["source", "left", "symbol", "right"]
    weighed = options.where("key = ''").withColumn("w", F.lit(1.0))
    share = options.select("source", "key").distinct().withColumn("share", F.lit(1.0))
    for step in range(rounds):
        now = closed.unionByName(weighed.select("source", "left", "true", "right", (F.col("n") * F.col("w")).alias("n")))
        near = cut(now.groupBy("left", "true", "right").agg(F.sum("n").alias("near")))
        count = lambda name, *by: near.groupBy(*by, "true").agg(F.sum("near").alias(name))
        sides = near.withColumns({"lc": _class(F.col("left")), "rc": _class(F.col("right"))})
        kind = lambda name, by: sides.groupBy(by, "true").agg(F.sum("near").alias(name))
        rated = (
            options.join(near, ["left", "true", "right"], "left").join(count("before", "left"), ["left", "true"], "left").join(count("after", "right"), ["right", "true"], "left")
            .join(kind("lc_n", "lc"), ["lc", "true"], "left").join(kind("rc_n", "rc"), ["rc", "true"], "left").join(count("alone"), "true", "left").join(share, ["source", "key"])
        )
        # a symbol standing for itself is judged without the one occurrence that is being judged
        less = lambda name: F.greatest(F.coalesce(F.col(name), F.lit(0.0)) - (F.col("key") == "").cast("int"), F.lit(0.0))
        smooth = F.try_divide((less("before") + BACKOFF * less("lc_n")) * (less("after") + BACKOFF * less("rc_n")), less("alone"))
        rated = rated.select(*group, "key", "true", "n", "lc", "rc", (F.col("share") * (less("near") + F.coalesce(smooth, F.lit(0.0)))).alias("w"))
        total = rated.groupBy(*group).agg(F.sum("w").alias("total"))
        weighed = cut(rated.join(total, group).withColumn("w", F.when(F.col("total") > 0, F.col("w") / F.col("total")).otherwise((F.col("key") == "").cast("double"))).drop("total"))
        if step + 1 < rounds:
            mass = weighed.groupBy("source", "key").agg(F.sum(F.col("n") * F.col("w")).alias("mass"))
            whole = mass.groupBy("source").agg(F.sum("mass").alias("whole"))
            share = mass.join(whole, "source").select("source", "key", ((F.col("mass") + 1) / (F.col("whole") + 1)).alias("share"))
    best = weighed.groupBy(*group).agg(F.max_by("true", F.struct("w", "key")).alias("true"), F.max(F.when(F.col("key") == "", F.col("w"))).alias("itself"))
    found = best.where("itself < 0.5").select(*group, "true")
    # replacement and control characters are wrong in any place; the commonest reading is taken where none fits the place
    broken = counts.where(F.col("symbol").rlike("[\ufffd\u0080-\u009f]")).join(found, group, "left_anti").select(*group)
    common = keys.join(known, "true").groupBy("symbol").agg(F.max_by("true", F.struct("known", "true")).alias("true"))
    return cut(found.unionByName(broken.join(common, "symbol", "left").select(*group, "true")))


def _fields(items: DataFrame, columns: list[str], source: str, key: str) -> DataFrame:
    """``(key, source, campo, text)``, one row per field that isn't plain ASCII."""
    fields = F.inline(F.array(*[F.struct(F.lit(c).alias("campo"), F.col(c).alias("text")) for c in columns]))
    return items.select(F.col(key), F.coalesce(name_key(F.col(source)), F.lit("")).alias("source"), fields).where(r"text rlike '[^\\x00-\\x7f]'")


def _judged(items: DataFrame, learned: DataFrame, columns: list[str], source: str, key: str) -> DataFrame:
    """``(key, campo, place, true)`` of the symbols that stand for something else."""
    kind = items.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, campo string, place int, true string"
    rows = items.select(F.col(key), F.coalesce(name_key(F.col(source)), F.lit("")).alias("__source"), *columns)
    if bounded(learned, BROADCAST_ROWS):
        known = {(r["source"], r["left"], r["symbol"], r["right"]): r["true"] for r in learned.toLocalIterator()}
        shared = items.sparkSession.sparkContext.broadcast(known)

        def judge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            table = shared.value
            symbols = {k[2] for k in table}
            for part in parts:
                out = []
                for c in columns:
                    for k, s, text in zip(part[key], part["__source"], part[c]):
                        if text and not text.isascii():
                            for i, (left, symbol, right) in enumerate(places(text)):
                                if symbol in symbols and (s, left, symbol, right) in table:
                                    out.append((k, c, i, table[s, left, symbol, right]))
                yield pd.DataFrame(out, columns=[key, "campo", "place", "true"])

        return rows.mapInPandas(judge, schema)

    def spread(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = [(k, c, i, s, *p) for c in columns for k, s, text in zip(part[key], part["__source"], part[c]) if text and not text.isascii() for i, p in enumerate(places(text))]
            yield pd.DataFrame(out, columns=[key, "campo", "place", "source", "left", "symbol", "right"])

    each = rows.mapInPandas(spread, f"`{key}` {kind}, campo string, place int, source string, left string, symbol string, right string")
    return each.join(learned, ["source", "left", "symbol", "right"]).select(key, "campo", "place", "true")


def mender(learned: DataFrame):
    """A function (source, text) for executors that applies the replacements; ``learned`` is small enough to broadcast."""
    shared = learned.sparkSession.sparkContext.broadcast({(r["source"], r["left"], r["symbol"], r["right"]): r["true"] for r in learned.toLocalIterator() if r["true"] is not None})

    def mend(source: str, text: str) -> str:
        table, out, at = shared.value, [], 0
        for m, (left, symbol, right) in zip(_RUN.finditer(text), places(text)):
            out += [text[at : m.start()], table.get((source, left, symbol, right), symbol)]
            at = m.end()
        return "".join(out) + text[at:]

    return mend


def damaged_fields(items: DataFrame, columns: list[str], source: str = "fuente", key: str = "seq") -> DataFrame:
    """``(key, campo)`` of every field that holds characters produced by a wrong reading, restorable or not.

    Null and empty fields have none; a key that repeats comes once per field.
    """
    learned = learn(items, columns, source)
    return _judged(items, learned, columns, source, key).select(key, "campo").distinct()


def restored_fields(items: DataFrame, columns: list[str], source: str = "fuente", key: str = "seq", learned: DataFrame | None = None) -> DataFrame:
    """``(key, campo, text, restored)`` of the damaged fields only; what can't be restored stays as it is.

    ``key`` must be unique; a null key is left out.
    """
    learned = learn(items, columns, source) if learned is None else learned
    changes = _judged(items, learned, columns, source, key).where("true is not null")
    changes = changes.groupBy(key, "campo").agg(F.map_from_entries(F.collect_list(F.struct("place", "true"))).alias("changes"))
    fields = _fields(items, columns, source, key).drop("source").join(changes, [key, "campo"])
    plain, runs = F.split("text", r"[^\x00-\x7f]+", -1), F.expr(r"regexp_extract_all(text, '[^\\x00-\\x7f]+', 0)")
    fields = fields.withColumns({"plain": plain, "runs": runs})
    # the text starts with a run: the first plain piece is empty, so pieces and runs always alternate
    true = F.transform("runs", lambda r, i: F.coalesce(F.element_at("changes", i), r))
    fields = fields.withColumn("true", true)
    joined = F.array_join(F.transform("plain", lambda x, i: F.concat(x, F.coalesce(F.get("true", i), F.lit("")))), "")
    return fields.select(key, "campo", "text", joined.alias("restored"))
