"""Records of the same article: by page address and by headline, whole tables or batch by batch.

Two records are linked if their absolute addresses lead to the same page or if their headlines are the same;
an article is a connected component of such links.  Headlines are the same if they differ in at most two words
once writing (case, accents, punctuation, spacing, entities, wrong encoding) and what a site sets before or
after a headline are taken off; numbers and places must agree.  Headlines of fewer than five words and null or
relative addresses link nothing.

Nothing compares records pairwise within a group: records collapse to distinct headlines and pages, which link
by stars; near headlines meet in blocking keys made of a headline's rarest words, and where too many meet in
one key, they are linked through wildcard keys instead, again by stars.

``ArticleIndex`` keeps all that in tables of a folder and takes in batch after batch: a batch's keys are probed in the
stored ones, which are scanned but never shuffled or written again, and only clusters that new links touch change.
"""

from __future__ import annotations

import gc
import itertools
import math
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from quipu.llm import encoding
from quipu.llm.common import bounded, cut, drop, name_key, null_if_blank, place, small
from quipu.operators.events import components

#: Words by which headlines of one article may differ.
EDITS = 2
#: Headlines with fewer words identify nothing.
LEAST_WORDS = 5
#: More distinct headlines than this in one blocking key are linked by wildcard keys instead of pairs.
HOT_KEY = 32
#: Rare words in a blocking key.  Words come in phrases, so fewer would tell headlines apart too little.
KEY_WORDS = 5
#: A segment is an affix if this share of the headlines it is set around also stand alone.
AFFIX_SHARE = 0.2
#: Count of the segments that are affixes in any case.
SURE = 1 << 40
#: A word is part of a name if this share of its uses inside a headline is capitalised.
NAME_SHARE = 0.8
BROADCAST_ROWS = 300_000
#: Most numbers (about 40 bytes each) that are broadcast to probe a stored table; more are joined.
KEY_ROWS = 1_000_000
#: Records of a batch that one task works on.
ROWS_A_TASK = 20_000

_BASE = {chr(c): unicodedata.normalize("NFKD", chr(c))[0] for c in range(0xDF, 0x250) if chr(c) == chr(c).lower()}
_BASE = {k: v for k, v in _BASE.items() if v != k and v.isascii()}
# What sites set between a headline and their own words around it.
_HEAD = r"(?s)^\s*(?:[(\[]([^)\]]{1,40})[)\]]|(.{1,40}?)\s*(?:::|:|\||–|—|\s-\s|»|/)(?=\s))\s*(\S.*)$"
_TAIL = r"(?s)^(.*\S)\s*(?:[(\[]([^)\]]{1,50})[)\]]|\s(?:::|:|\||–|—|-|»|/)\s+([^|–—]{1,50}?))\s*$"
_SOME = r"[:|–—»/(\[]|\s-\s"


def spell(c: Column) -> Column:
    """Words as written, one space between; entities of accented letters are resolved, punctuation is dropped."""
    c = F.when(c.contains("&"), F.regexp_replace(F.regexp_replace(c, r"&([A-Za-z])(?:acute|grave|circ|tilde|uml|ring|cedil|caron);", "$1"), r"&#?\w+;", " ")).otherwise(c)
    return F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}\x{300}-\x{36f}\x{fffd}]+", " "))


def fold(c: Column) -> Column:
    """Spelled words without case and accents."""
    return F.translate(F.regexp_replace(F.lower(c), "[̀-ͯ]", ""), "".join(_BASE), "".join(_BASE.values()))


def page_key(url: Column) -> Column:
    """Address of the page an absolute address leads to; null for others.

    Scheme, case of the host, www., m. and amp. hosts, default ports, fragments, campaign parameters, parameter
    order, amp endings and closing slashes don't matter.
    """
    u = F.trim(url)
    whole = r"(?i)^https?://(?:[^/?#@]*@)?(?:www\.|m\.|amp\.|mobile\.)*([^/?#:]+)(?::\d+)?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
    part = lambda i: F.regexp_extract(u, whole, i)
    path = F.regexp_replace(F.regexp_replace(part(2), r"/+$", ""), r"(?i)/(?:amp|amp\.html|index\.(?:html?|php))$", "")
    own = F.filter(F.split(part(3), "&"), lambda x: (x != "") & ~x.rlike(r"(?i)^(?:utm_\w*|fbclid|gclid|dclid|msclkid|ref|outputtype|amp|mc_cid|mc_eid|igshid|from|share)(?:=|$)"))
    key = F.concat(F.lower(part(1)), F.regexp_replace(path, r"/+$", ""), F.lit("?"), F.array_join(F.array_sort(own), "&"))
    return F.when(u.rlike(whole), key)


class _Spelling(dict):
    """Character to itself if it is part of a word, else to a space; to its folded form if ``folded``."""

    def __init__(self, folded: bool):
        self.folded = folded

    def __missing__(self, code: int) -> str:
        c, kind = chr(code), unicodedata.category(chr(code))
        if 0x300 <= code <= 0x36F:
            out = "" if self.folded else c
        elif kind[0] not in "LN" and c != "\ufffd":
            out = " "
        else:
            out = "".join(_BASE.get(x, x) for x in c.lower() if not 0x300 <= ord(x) <= 0x36F) if self.folded else c
        self[code] = out
        return out


_WORDS, _FOLDED = _Spelling(False), _Spelling(True)


def _written(text: str) -> str:
    """As ``spell``, of a Python text."""
    import re

    if "&" in text:
        text = re.sub(r"&#?\w+;", " ", re.sub(r"&([A-Za-z])(?:acute|grave|circ|tilde|uml|ring|cedil|caron);", r"\1", text))
    return " ".join(text.translate(_WORDS).split())


def _folded(text: str) -> str:
    """As ``fold`` of spelled words."""
    return " ".join(text.translate(_FOLDED).split())


_FORMS = "seq bigint, lote int, u bigint, title string, pre string, suf string, no_pre string, no_suf string, no_both string, was bigint"


def read_titles(items: DataFrame, learned: DataFrame) -> DataFrame:
    """``(seq, lote, u, title, pre, suf, no_pre, no_suf, no_both)`` of items (seq, lote, titulo, fuente, u).

    The headline as spelled, wrong encodings undone, whole and without what may be an affix before or after it, and these
    affixes folded; ``was`` is null.  Null and blank headlines have a null title.
    """
    if bounded(learned, BROADCAST_ROWS):
        mend = encoding.mender(learned)
    else:
        fixed = cut(encoding.restored_fields(items, ["titulo"], learned=learned).select("seq", "restored"))
        items = items.join(fixed, "seq", "left").withColumn("titulo", F.coalesce("restored", "titulo")).drop("restored")
        mend = lambda _, text: text

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        head, tail, some = re.compile(_HEAD), re.compile(_TAIL), re.compile(_SOME)
        for part in parts:
            rows = []
            for text, source in zip(part["titulo"], part["source"]):
                if text is None or text.strip().lower() in ("", "nan", "none", "null"):
                    rows.append((None,) * 6)
                    continue
                if not text.isascii():
                    text = mend(source, text)
                pre = suf = no_pre = no_suf = no_both = None
                if some.search(text):
                    m, k = head.match(text), tail.match(text)
                    if m:
                        pre, no_pre = _folded(_written(m[1] or m[2])), _written(m[3])
                    if k:
                        suf, no_suf = _folded(_written(k[2] or k[3])), _written(k[1])
                    if m and k and (both := tail.match(m[3])):
                        no_both = _written(both[1])
                rows.append((_written(text), pre or None, suf or None, no_pre, no_suf, no_both))
            out = pd.DataFrame(rows, columns=["title", "pre", "suf", "no_pre", "no_suf", "no_both"])
            for i, c in enumerate(("seq", "lote", "u")):
                out.insert(i, c, part[c].to_numpy())
            yield out.assign(was=None).astype({"lote": "Int32", "u": "Int64", "was": "Int64"})

    rows = items.select("seq", F.col("lote").cast("int").alias("lote"), "u", "titulo", F.coalesce(name_key(F.col("fuente")), F.lit("")).alias("source"))
    return rows.mapInPandas(read, _FORMS)


def count_affixes(forms: DataFrame, past: DataFrame | None, sites: DataFrame) -> DataFrame:
    """``(side, segment, n, alone)``: headlines each segment is set around, and how many of them also stand alone, here or in ``past`` (id).

    Names of sites (``site``) are affixes by themselves and come with a count that no share undoes.
    """
    key = lambda c: F.xxhash64(F.lit("h"), fold(F.col(c)))
    some = F.inline(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("segment"), key(f"no_{s}").alias("h")) for s in ("pre", "suf")]))
    pairs = cut(forms.where("pre is not null or suf is not null").select(some).where("segment is not null and h is not null").distinct())
    wanted = small(pairs.select("h").distinct(), BROADCAST_ROWS)
    alone = forms.select(key("title").alias("h")).join(wanted, "h", "left_semi")
    if past is not None:
        alone = alone.union(past.select(F.col("id").alias("h")).join(wanted, "h", "left_semi"))
    alone = alone.distinct().withColumn("alone", F.lit(1))
    hits = pairs.join(alone, "h", "left").groupBy("side", "segment").agg(F.count("*").alias("n"), F.coalesce(F.sum("alone"), F.lit(0)).alias("alone"))
    names = sites.select(fold(spell(F.col("site"))).alias("segment")).where("segment <> ''").distinct()
    return hits.union(names.select(F.explode(F.array(F.lit("pre"), F.lit("suf"))).alias("side"), "segment", F.lit(0), F.lit(SURE)))


def choose_affixes(counts: DataFrame) -> DataFrame:
    """``(side, segment)`` of what sites set around headlines: their names, or anything without which the rest often stands alone too."""
    hits = counts.groupBy("side", "segment").agg(F.sum("n").alias("n"), F.sum("alone").alias("alone"))
    return hits.where(f"alone >= 2 and alone >= {AFFIX_SHARE} * n").select("side", "segment")


def count_skeletons(forms: DataFrame) -> DataFrame:
    """``(w, n)``: words with other than ASCII letters, of which some may elsewhere be unknown."""
    words = forms.select(F.explode(F.expr(r"regexp_extract_all(lower(title), '[a-z]*[\\u00df-\\u00ff][a-z\\u00df-\\u00ff]*', 0)")).alias("w"))
    return words.groupBy("w").agg(F.count("*").alias("n"))


def choose_skeletons(counts: DataFrame) -> DataFrame:
    """``(skeleton, word)``: the commonest folded word for each word whose other than ASCII letters are unknown."""
    words = counts.groupBy("w").agg(F.sum("n").alias("n")).select(F.regexp_replace("w", "[^a-z]", "�").alias("skeleton"), fold(F.col("w")).alias("word"), "n")
    return words.groupBy("skeleton").agg(F.max_by("word", F.struct("n", "word")).alias("word"))


_PENDING = "title string, pre string, suf string, no_pre string, no_suf string, no_both string"


def strip_affixes(forms: DataFrame, affixes: DataFrame) -> DataFrame:
    """``(seq, lote, u, was, core, raw, title, ...)``: the folded headline without affixes, unknown letters filled in, and as written.

    The forms stay beside it where later batches may teach more: affixes not known yet, letters unknown.
    """
    for s in ("pre", "suf"):
        known = affixes.where(F.col("side") == s).select(F.col("segment").alias(s), F.lit(True).alias(f"is_{s}"))
        forms = forms.join(small(known, BROADCAST_ROWS), s, "left")

    def strip(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["title", "pre", "suf", "no_pre", "no_suf", "no_both"]
        for part in parts:
            raws, cores, open_ = [], [], []
            for is_pre, is_suf, *forms_ in zip(*[part[c] for c in ("is_pre", "is_suf", *names)]):
                title, pre, suf, no_pre, no_suf, no_both = forms_
                raw = (no_both or no_pre) if is_pre is True and is_suf is True else no_pre if is_pre is True else no_suf if is_suf is True else title
                raws.append(raw or None)
                cores.append((_folded(raw) or None) if raw else None)
                open_.append(forms_ if title and (pre or suf or "\ufffd" in title) else [None] * 6)
            out = pd.DataFrame({"seq": part["seq"], **{c: part[c].astype(t) for c, t in (("lote", "Int32"), ("u", "Int64"), ("was", "Int64"))}, "core": cores, "raw": raws})
            yield out.join(pd.DataFrame(open_, columns=names, index=out.index))

    return forms.mapInPandas(strip, f"seq bigint, lote int, u bigint, was bigint, core string, raw string, {_PENDING}")


def fill_letters(cores: DataFrame, skeletons: DataFrame) -> DataFrame:
    """``(seq, mended)`` of headlines with unknown letters: their words filled in where a known word fits."""
    lost = cores.where(F.col("core").contains("�")).select("seq", F.posexplode(F.split("core", " ")).alias("i", "skeleton")).join(skeletons, "skeleton", "left")
    return lost.groupBy("seq").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("word", "skeleton").alias("w")))), lambda x: x["w"]), " ").alias("mended"))


def count_words(cores: DataFrame) -> DataFrame:
    """``(word, n, told, caps)``: headlines' words, their uses inside headlines not capitalised throughout, and those capitalised.

    Each batch is counted before the words are shuffled.
    """

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            n, told, caps = Counter(), Counter(), Counter()
            for core, raw in zip(part["core"], part["raw"]):
                words, written = core.split(" "), raw.split(" ")
                n.update(words)
                upper = [w[:1].isupper() for w in written]
                if sum(upper) < 0.6 * len(written):
                    told.update(words[1:])
                    caps.update(w for w, u in zip(words[1:], upper[1:]) if u)
            yield pd.DataFrame([(w, k, told[w], caps[w]) for w, k in n.items()], columns=["word", "n", "told", "caps"])

    found = cores.select("core", "raw").mapInPandas(count, "word string, n bigint, told bigint, caps bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n"), F.sum("told").alias("told"), F.sum("caps").alias("caps"))


def choose_words(counts: DataFrame) -> DataFrame:
    """``(word, n, fixed, changed)`` of counts by batch: whether a word may not differ (numbers and parts of names), and whether
    the last batch changed that.

    A word is part of a name if it is mostly capitalised inside headlines.  ``n`` is the count of the first batch that had the
    word and stays, so that the order of words, on which blocking keys rest, never changes.
    """
    name = lambda told, caps: ((told >= 2) & (caps >= NAME_SHARE * told)) | F.col("word").rlike("[0-9]")
    now = F.lit(counts.agg(F.max("batch")).first()[0])
    old = lambda c: F.coalesce(F.sum(F.when(F.col("batch") < now, F.col(c))), F.lit(0)).alias(f"old_{c}")
    sums = counts.where("word is not null").groupBy("word").agg(F.min_by("n", "batch").alias("n"), F.min("batch").alias("since"), F.sum("told").alias("told"), F.sum("caps").alias("caps"), old("told"), old("caps"))
    fixed, before = name(F.col("told"), F.col("caps")), name(F.col("old_told"), F.col("old_caps"))
    return sums.select("word", "n", fixed.alias("fixed"), ((F.col("since") < now) & (fixed != before)).alias("changed"))


def _profiles(cores: DataFrame, words: DataFrame) -> DataFrame:
    """``(id, core, fixed, soft)`` of headlines (id, core): what may not differ as one string, and the other words from rare to frequent.

    A vocabulary of up to BROADCAST_ROWS words goes to every task; a larger one is joined.
    """
    long_ = cores.select("id", "core")
    if not bounded(words, BROADCAST_ROWS):
        return _profiles_joined(cut(long_), words)
    shared = words.sparkSession.sparkContext.broadcast({r["word"]: (r["n"], r["fixed"]) for r in words.toLocalIterator()})

    def told(items: list[str]) -> list[str]:
        seen: Counter = Counter()
        out = []
        for w in items:
            seen[w] += 1
            out.append(f"{w}#{seen[w]}")
        return out

    def split(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for part in parts:
            fixed, soft = [], []
            for core in part["core"]:
                hard, rest = [], []
                for w in core.split(" "):
                    n, is_fixed = known.get(w) or (0, any("0" <= c <= "9" for c in w))
                    if is_fixed:
                        hard.append(w)
                    else:
                        rest.append((n, w))
                fixed.append(" ".join(told(sorted(hard))))
                soft.append(told([w for _, w in sorted(rest)]))
            yield pd.DataFrame({"id": part["id"], "core": part["core"], "fixed": fixed, "soft": soft})

    return long_.mapInPandas(split, "id bigint, core string, fixed string, soft array<string>")


def _profiles_joined(long_: DataFrame, words: DataFrame) -> DataFrame:
    """``_profiles`` for any vocabulary."""
    each = long_.select("id", F.explode(F.split("core", " ")).alias("word")).join(words, "word", "left")
    each = each.select("id", F.coalesce("fixed", F.col("word").rlike("[0-9]")).alias("fixed"), F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word").alias("x"))
    some = each.groupBy("id").agg(F.sort_array(F.collect_list(F.when(F.col("fixed"), F.col("x.word")))).alias("fixed"), F.transform(F.sort_array(F.collect_list(F.when(~F.col("fixed"), F.col("x")))), lambda x: x["word"]).alias("soft"))
    # repeated words are told apart by their number
    told = lambda c: F.transform(c, lambda x, i: F.concat_ws("#", x, F.size(F.filter(F.slice(c, 1, i + 1), lambda y: y == x)).cast("string")))
    some = some.select("id", F.array_join(told(F.col("fixed")), " ").alias("fixed"), told(F.col("soft")).alias("soft"))
    return long_.join(some, "id")


def blocking_keys(profiles: DataFrame) -> DataFrame:
    """``(key, id)``.  Headlines with at most EDITS word edits share ``max(a, b) - EDITS`` soft words, so among the first
    ``k + EDITS`` of each there are k in common; a key is the fixed words and k soft ones, k as large as KEY_WORDS."""
    s = F.size("soft")

    def keys(k: int, least: int, most: int) -> Column:
        each = [F.when(s > max(c, default=-1), F.xxhash64(F.lit(k), F.col("fixed"), *[F.get("soft", i) for i in c])) for c in itertools.combinations(range(k + EDITS), k)]
        return F.when((s >= least) & (s <= most), F.filter(F.array(*each), lambda x: x.isNotNull())).otherwise(F.array().cast("array<bigint>"))

    # a pair whose longer side has m soft words meets in keys of min(KEY_WORDS, m - EDITS) words; the shorter has EDITS fewer at most
    every = F.concat(*[keys(k, k, 10**6 if k == KEY_WORDS else k + EDITS) for k in range(KEY_WORDS + 1)])
    return profiles.select(F.explode(every).alias("key"), "id")


def _edits(a: list[str], b: list[str]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@F.pandas_udf(IntegerType())
def word_edits(a: pd.Series, b: pd.Series) -> pd.Series:
    """Words replaced, added or missing between two folded headlines; null where one is null."""
    return pd.Series([None if x is None or y is None else _edits(x.split(" "), y.split(" ")) for x, y in zip(a, b)], dtype="Int32")


def _wild(words: list[str], fixed: set[int]) -> Iterator[tuple[str, bool]]:
    """(key, whether no word was left out): all ways of leaving out or masking at most two words."""
    free = [i for i in range(len(words)) if i not in fixed]
    some = lambda gone, mask: " ".join("*" if i in mask else w for i, w in enumerate(words) if i not in gone)
    yield "s" + some((), ()), True
    for i in free:
        yield "d" + some((i,), ()), False
    for i, j in itertools.combinations(free, 2):
        yield "m" + some((), (i, j)), True
        yield "s" + some((i, j), ()), False
    for i in free:
        yield "m1" + some((), (i,)), True
        for j in free:
            if i != j:
                yield "m1" + some((i,), (j,)), False


def wild_keys(profiles: DataFrame) -> DataFrame:
    """``(key, id, hub)`` of headlines (id, core, fixed): wildcard keys by which crowded headlines are linked.

    Headlines with the same two words masked, or equal but for one word left out in each, are within two edits
    of each other; those with a word left out and one masked, or two left out, are within two edits of any that
    has none left out (``hub``).  Together these are all ways to be within two edits.
    """

    def keys(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in (p.iloc[i : i + 100] for p in parts for i in range(0, len(p), 100)):
            rows = []
            for node, core, fixed in zip(part["id"], part["core"], part["fixed"]):
                words = core.split(" ")
                names = {x.partition("#")[0] for x in fixed.split(" ")}
                stuck = {i for i, x in enumerate(words) if x in names}
                whole: dict[str, bool] = {}
                for k, w in _wild(words, stuck):
                    whole[k] = whole.get(k, False) or w
                rows += [(k, node, w) for k, w in whole.items()]
            yield pd.DataFrame(rows, columns=["wild", "id", "whole"])

    wild = profiles.select("id", "core", "fixed").mapInPandas(keys, "wild string, id bigint, whole boolean")
    return wild.select(F.xxhash64("wild").alias("key"), "id", (F.col("whole") | F.col("wild").startswith("d")).alias("hub"))


def hot_links(wild: DataFrame) -> DataFrame:
    """``(a, b)`` links among headlines that share a wildcard key, by stars, so in linear space."""
    hubs = wild.groupBy("key").agg(F.min(F.when(F.col("hub"), F.col("id"))).alias("a"), F.count("*").alias("n")).where("n > 1 and a is not null")
    return wild.join(hubs.select("key", "a"), "key").where("a <> id").select("a", F.col("id").alias("b")).distinct()


def candidate_pairs(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs ``(a, b)`` of headlines that meet in a key ``(key, id, new)``, and the headlines of crowded keys.

    Only keys with a new headline count, and only pairs with one.  Keys are counted in part before they are shuffled; nearly
    all stand alone, and only the rows of the others are looked at again.
    """
    counts = keys.groupBy("key").agg(F.count("*").alias("n"), F.max("new").alias("any")).where("n > 1 and any").select("key", "n")
    met = cut(keys.join(small(cut(counts), KEY_ROWS), "key"))
    crowded = met.where(f"n > {HOT_KEY}").select("id").distinct()
    few = met.where(f"n <= {HOT_KEY}")
    a, b = (few.select("key", F.col("id").alias(s), F.col("new").alias(f"new_{s}")) for s in "ab")
    return a.join(b, "key").where("a < b and (new_a or new_b)").select("a", "b").distinct(), crowded


def learn_weights(patterns: list[tuple[tuple[int, ...], float]], rounds: int = 30) -> dict[tuple[int, ...], float]:
    """Log odds of a match for each agreement pattern, by EM over two classes with independent fields.

    ``patterns`` are (levels of the fields, number of pairs); there are as many as combinations of levels, so few.
    Lower levels agree more; that is all the start says.
    """
    fields = range(len(patterns[0][0])) if patterns else range(0)
    levels = [sorted({p[f] for p, _ in patterns}) for f in fields]
    prob = {c: [{v: 1.0 + (len(ls) - i if c else i) for i, v in enumerate(ls)} for ls in levels] for c in (0, 1)}
    share = 0.5

    def odds(p: tuple[int, ...]) -> float:
        got = math.log(share / (1 - share))
        for f in fields:
            m, u = prob[1][f], prob[0][f]
            got += math.log(m[p[f]] / sum(m.values())) - math.log(u[p[f]] / sum(u.values()))
        return got

    for _ in range(rounds if patterns else 0):
        match = {p: 1 / (1 + math.exp(-max(-50.0, min(50.0, odds(p))))) for p, _ in patterns}
        total = sum(n for _, n in patterns)
        share = min(0.999, max(0.001, sum(n * match[p] for p, n in patterns) / total))
        prob = {c: [{v: 0.5 + sum(n * (match[p] if c else 1 - match[p]) for p, n in patterns if p[f] == v) for v in levels[f]} for f in fields] for c in (0, 1)}
    return {p: odds(p) for p, _ in patterns}


class ArticleIndex:
    """Articles of all batches so far: stored keys, headlines and representatives, extended batch by batch.

    The tables lie in ``folder``, which all executors share, one subfolder a batch; an index opened on a folder that has
    batches goes on from there.  Without a folder a temporary one is used.  A batch's keys are probed in the stored ones by a
    scan without a shuffle; only clusters that it touches change their representative.  Counts behind encodings, affixes and
    words are stored per batch and add up; where a batch changes what is an affix or may not differ, the headlines concerned
    are keyed again.
    """

    TABLES = {
        "places": "source string, left string, symbol string, right string, n bigint", "affixes": "side string, segment string, n bigint, alone bigint",
        "skeletons": "w string, n bigint", "words": "word string, n bigint, told bigint, caps bigint, batch int",
        "records": f"seq bigint, lote int, h bigint, u bigint, node bigint, {_PENDING}",
        "headlines": "id bigint, core string, fixed string, soft array<string>, batch int", "keys": "key bigint, id bigint", "wild": "key bigint, id bigint, hub boolean",
        "rated": "a bigint, b bigint, edits int, unlike int, longer int", "roots": "node bigint, root bigint, batch int",
    }

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = (folder or place(spark)).rstrip("/")
        self.parts = 1
        self.temporary: list[str] = []
        self.batches = 0
        # representatives are written last, so a batch cut short is taken in again
        while self._there(f"{self.folder}/roots/{self.batches:05d}"):
            self.batches += 1

    def _there(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _keep(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}/{self.batches:05d}"
        df.coalesce(self.parts).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(self.TABLES[name]).parquet(path)

    def _temp(self, df: DataFrame) -> DataFrame:
        self.temporary.append(place(self.spark))
        df.coalesce(self.parts).write.option("compression", "snappy").parquet(self.temporary[-1])
        return self.spark.read.schema(df.schema).parquet(self.temporary[-1])

    def _all(self, name: str, more: int = 0) -> DataFrame | None:
        """A table of all batches before this one, or with ``more`` of 1 also of this one."""
        paths = [p for i in range(self.batches + more) if self._there(p := f"{self.folder}/{name}/{i:05d}")]
        return self.spark.read.schema(self.TABLES[name]).parquet(*paths) if paths else None

    def _of(self, name: str, column: str, wanted: DataFrame, more: int = 0) -> DataFrame:
        """Rows of a stored table whose ``column`` is one of ``wanted``, by a scan; beyond KEY_ROWS wanted by a join."""
        stored = self._all(name, more)
        return stored.join(small(wanted.select(F.col(wanted.columns[0]).alias(column)), KEY_ROWS), column, "left_semi")

    def extend(self, items: DataFrame) -> None:
        """Take in a batch (seq, lote, titulo, fuente, url).  Rows without seq are left out; exact duplicates count once."""
        items = items.select("seq", "lote", "titulo", "fuente", page_key(F.col("url")).alias("page")).where("seq is not null")
        items = items.select("seq", "lote", "titulo", "fuente", F.when(F.col("page").isNotNull(), F.xxhash64(F.lit("u"), F.col("page"))).alias("u"))
        self.parts = max(1, math.ceil(items.count() / ROWS_A_TASK))
        again = self.batches > 0
        self._keep("places", encoding.count_places(items, ["titulo"]))
        learned = encoding.learn_counts(cut(self._all("places", 1).groupBy("source", "left", "symbol", "right").agg(F.sum("n").alias("n"))))
        forms = self._temp(read_titles(items, learned))
        cores = self._temp(self._cores(items, forms))
        h = F.when(F.size(F.split("core", " ")) >= LEAST_WORDS, F.xxhash64(F.lit("h"), F.col("core")))
        cores = cores.withColumn("h", h)
        forms_ = [c.split(" ")[0] for c in _PENDING.split(", ")]
        records = self._keep("records", cores.where("was is null").select("seq", "lote", "h", "u", F.coalesce("h", "u").alias("node"), *forms_))
        links = records.where("h is not null and u is not null").select(F.col("h").alias("a"), F.col("u").alias("b"))
        if again:  # the same headline under what it was taken for before
            links = links.union(cores.where("was is not null and h is not null").select("was", "h"))
        self._join(links.union(self._near(self._keyed(cores))).where("a <> b").distinct())
        drop(self.spark, self.temporary)
        self.temporary = []
        self.batches += 1
        # what the batch broadcast and shuffled is freed only once the driver collects its garbage
        gc.collect()
        self.spark._jvm.System.gc()

    def _cores(self, items: DataFrame, forms: DataFrame) -> DataFrame:
        """Cores of the batch and of earlier headlines that what it teaches changes."""
        again = self.batches > 0
        self._keep("affixes", count_affixes(forms, self._all("headlines"), items.select(F.col("fuente").alias("site")).distinct()))
        self._keep("skeletons", count_skeletons(forms))
        affixes = cut(choose_affixes(self._all("affixes", 1)))
        every = forms
        if again:
            new = affixes.subtract(choose_affixes(self._all("affixes")))
            new = small(cut(new), BROADCAST_ROWS)
            past = self._all("records").where("title is not null and h is not null").withColumn("was", F.col("h")).select(*[c.split(" ")[0] for c in _FORMS.split(", ")])
            side = lambda s: past.join(new.where(F.col("side") == s).select(F.col("segment").alias(s)), s, "left_semi").select(past.columns)
            every = forms.unionByName(side("pre").union(side("suf")).union(past.where(F.col("title").contains("�"))).distinct())
        cores = strip_affixes(every, affixes)
        if forms.where(F.col("title").contains("�")).isEmpty() and not again:
            return cores
        cores = self._temp(cores)
        mended = small(cut(fill_letters(cores, choose_skeletons(self._all("skeletons", 1)))), BROADCAST_ROWS)
        return cores.join(mended, "seq", "left").withColumn("core", F.coalesce("mended", "core")).drop("mended")

    def _keyed(self, cores: DataFrame) -> DataFrame:
        """Blocking keys of the batch's new headlines and of those whose words that may not differ have changed."""
        again = self.batches > 0
        fresh = cores.where("h is not null").groupBy(F.col("h").alias("id")).agg(F.first("core").alias("core"), F.first("raw").alias("raw"))
        if again:
            fresh = self._temp(fresh)
            known = cut(self._of("headlines", "id", fresh.select("id")).select("id").distinct())
            fresh = fresh.join(small(known, KEY_ROWS), "id", "left_anti")
        else:
            fresh = self._temp(fresh)
        self._keep("words", count_words(fresh).withColumn("batch", F.lit(self.batches)))
        words = cut(choose_words(self._all("words", 1)))
        every = fresh.select("id", "core")
        if again:
            changed = words.where("changed").select("word")
            if not changed.isEmpty():
                every = every.union(self._holding(changed))
        profiles = self._keep("headlines", _profiles(every, words).withColumn("batch", F.lit(self.batches)))
        return self._keep("keys", blocking_keys(profiles))

    def _holding(self, words: DataFrame) -> DataFrame:
        """``(id, core)`` of stored headlines that hold one of the words."""
        stored = self._all("headlines").select("id", "core")
        if bounded(words, BROADCAST_ROWS):
            shared = self.spark.sparkContext.broadcast({r[0] for r in words.toLocalIterator()})

            def hold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for part in parts:
                    yield part[[not shared.value.isdisjoint(c.split(" ")) for c in part["core"]]]

            return stored.mapInPandas(hold, "id bigint, core string").distinct()
        each = stored.select("id", "core", F.explode(F.split("core", " ")).alias("word"))
        return each.join(words, "word", "left_semi").select("id", "core").distinct()

    def _near(self, keys: DataFrame) -> DataFrame:
        """Links ``(a, b)`` among the new headlines and between them and stored ones."""
        every = keys.withColumn("new", F.lit(True))
        if self.batches:
            every = every.unionByName(cut(self._of("keys", "key", keys.select("key"))).select("key", "id").withColumn("new", F.lit(False)))
        pairs, crowded = candidate_pairs(every)
        near = self._scored(cut(pairs))
        if crowded.isEmpty():
            return near
        # headlines that became crowded get wildcard keys; they are stored, so each is made once
        stored = self._all("wild") is not None
        if stored:
            crowded = crowded.join(small(cut(self._of("wild", "id", crowded).select("id").distinct()), KEY_ROWS), "id", "left_anti")
        wild = self._keep("wild", wild_keys(self._latest(crowded)).distinct())
        if stored:
            wild = wild.unionByName(self._of("wild", "key", wild.select("key").distinct()))
        return near.union(hot_links(wild))

    def _latest(self, ids: DataFrame) -> DataFrame:
        """``(id, core, fixed, soft)`` of headlines as they are keyed now."""
        found = self._of("headlines", "id", ids.select("id"), 1)
        return found.groupBy("id").agg(F.max_by(F.struct("core", "fixed", "soft"), "batch").alias("x")).select("id", "x.*")

    def _scored(self, pairs: DataFrame) -> DataFrame:
        """Pairs that differ in at most EDITS words, none of them fixed.

        All pairs that were compared are stored with their agreement, for ``weights``.
        """
        profiles = cut(self._latest(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
        side = lambda s: small(profiles.select(F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("core", "fixed", "soft")]), BROADCAST_ROWS)
        both = pairs.join(side("a"), "a").join(side("b"), "b").where("fixed_a = fixed_b")
        lost = F.greatest(F.size("soft_a"), F.size("soft_b")) - F.size(F.array_intersect("soft_a", "soft_b"))
        rare = F.size(F.array_intersect(F.slice("soft_a", 1, 4), F.slice("soft_b", 1, 4)))
        # word edits are at least the words lost, so they are only worked out where these are few
        near = lost <= EDITS
        edits = F.coalesce(word_edits(F.when(near, F.col("core_a")), F.when(near, F.col("core_b"))), lost)
        rated = self._keep("rated", both.select("a", "b", F.least(edits, F.lit(EDITS + 3)).cast("int").alias("edits"), (4 - rare).cast("int").alias("unlike"), F.least(F.abs(F.size("soft_a") - F.size("soft_b")), F.lit(3)).cast("int").alias("longer")))
        return rated.where(f"edits <= {EDITS}").select("a", "b")

    def weights(self) -> dict[tuple[int, ...], float]:
        """Log odds of a match by (edits, rare words unlike, difference in length), learned from the patterns so far.

        The definition of the same headline is a rule on edits, so the weights rate links and don't overrule it.
        """
        rows = self._all("rated").groupBy("edits", "unlike", "longer").agg(F.count("*").alias("n")).orderBy("edits", "unlike", "longer").collect()
        return learn_weights([((r[0], r[1], r[2]), float(r[3])) for r in rows])

    def _join(self, links: DataFrame) -> None:
        """Union of the clusters that the links touch: new rows of the representative table."""
        if self.batches:
            links = cut(links)
            nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            roots = small(cut(self._of("roots", "node", nodes).groupBy("node").agg(F.max_by("root", "batch").alias("root"))), KEY_ROWS)
            for side in ("a", "b"):
                links = links.join(roots.select(F.col("node").alias(side), "root"), side, "left").withColumn(side, F.coalesce("root", side)).drop("root")
        found = components(links)
        if self.batches:  # nodes of clusters that got another representative
            now = small(found.select(F.col("node").alias("root"), F.col("root").alias("now")), KEY_ROWS)
            found = found.unionByName(self._all("roots").join(now, "root").select("node", F.col("now").alias("root")).distinct())
        self._keep("roots", found.withColumn("batch", F.lit(self.batches)))

    def roots(self) -> DataFrame:
        """``(node, root)`` as of now: the latest row of each node; nodes without a row are their own."""
        return self._all("roots").groupBy("node").agg(F.max_by("root", "batch").alias("root"))

    def articles(self) -> DataFrame:
        """``(seq, lote, grupo)`` of all records so far; grupo is the article's smallest seq.

        A record with neither headline nor page is an article of its own.
        """
        records = self._all("records").join(self.roots(), "node", "left").withColumn("root", F.coalesce("root", "node"))
        least = records.where("root is not null").groupBy("root").agg(F.min("seq").alias("grupo"))
        return records.join(least, "root", "left").select("seq", "lote", F.coalesce("grupo", "seq").alias("grupo"))


def ranges(items: DataFrame, batches: int) -> list[tuple[int | None, int | None]]:
    """Consecutive ranges [low, high) of lotes with about as many rows each; fewer if few lotes have most rows."""
    shares = [i / batches for i in range(1, batches)]
    cuts = items.agg(F.percentile_approx("lote", shares, 1000).alias("c")).first()["c"] if shares else None
    cuts = sorted(set(cuts or []))
    return list(zip([None, *cuts], [*cuts, None]))


def articles(items: DataFrame, batches: int = 1) -> DataFrame:
    """``(seq, lote, grupo)``, taken in by that many ranges of lotes; a null lote belongs to the first range.

    Exact duplicate rows count once.
    """
    index = ArticleIndex(items.sparkSession)
    for low, high in ranges(items, batches):
        part = items
        if low is not None:
            part = part.where(F.col("lote") >= low)
        if high is not None:
            part = part.where((F.col("lote") < high) | (F.col("lote").isNull() & F.lit(low is None)))
        index.extend(part)
    return index.articles().distinct()
