"""Text functions, Column to Column; null counts as empty text unless said otherwise.

Everything stays within built-in expressions.  Patterns are Unicode-aware, as the texts are Spanish.  Unicode
compatibility normalisation has no built-in: ``nfkc`` is an Arrow UDF to be put before the others where texts need it.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from quipu.functions import lexicon

LETTERS = "a-záéíóúüñ"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility form; null stays null."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def compatible(c: Column) -> Column:
    """``nfkc`` of texts that hold a character it may change; all others stay out of Python."""
    told = r"[^\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e\u00a1\u00bf\u00ab\u00bb\u2013\u2014\u2018-\u201d\u20ac]"
    return F.coalesce(nfkc(F.when(c.rlike(told), c)), c)


def missing(c: Column) -> Column:
    """The text, or null where it is null, blank or the word nan."""
    return F.when(~F.lower(F.trim(c)).isin("", "nan"), c)


def normalize_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(_text(c), r"(?U)\s+", " "))


def normalize(c: Column) -> Column:
    """Lower case, single spaces."""
    return normalize_space(F.lower(_text(c)))


def cluster_text(c: Column) -> Column:
    """Lower case without addresses and punctuation, percent and dollar signs kept."""
    c = F.regexp_replace(F.lower(_text(c)), r"https?://\S+", " ")
    return F.trim(F.regexp_replace(c, rf"[^{LETTERS}0-9%$]+", " "))


def title_key(c: Column) -> Column:
    """Key by which titles count as equal when merging and cleaning; may be empty."""
    return F.trim(F.regexp_replace(F.lower(_text(c)), rf"[^{LETTERS}0-9]+", " "))


def annotation_title_key(c: Column) -> Column:
    """Key by which titles count as equal when preparing annotation: other characters are deleted, not spaced."""
    return normalize_space(F.regexp_replace(F.lower(_text(c)), r"(?U)[^\wáéíóúüñ ]+", ""))


def simple_title_key(c: Column) -> Column:
    """Key by which titles count as equal when collecting."""
    return normalize(c)


def normalize_url(c: Column) -> Column:
    """Without fragment and closing slashes."""
    return F.regexp_replace(F.substring_index(normalize_space(c), "#", 1), "/+$", "")


def url_host(c: Column) -> Column:
    """Host of an absolute address in lower case, null for others."""
    host = F.regexp_extract(F.trim(c), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host != "", F.lower(host))


def absolute_url(base: Column, link: Column) -> Column:
    """A link as an address, read from a page at ``base``: absolute, of the same scheme, of the same host or relative."""
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^?#]*)", 1), r"(?<=[^/]/)[^/]*$", "")
    folder = F.when(folder == root, F.concat(root, F.lit("/"))).otherwise(folder)
    link = F.trim(link)
    return (
        F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .otherwise(F.concat(folder, F.regexp_replace(link, r"^\./", "")))
    )


#: What ``clean_text`` replaces in lower-case text, each with signs without one of which it isn't there.
_REPLACED = (
    (("http", "www."), r"https?://\S+|www\.\S+", " "), (("@",), r"\S+@\S+\.\S+", " "), (("@",), r"(?U)@\w+", " "), (("#",), r"(?U)#(\w+)", "$1"),
    (("us$",), r"(?U)\bus\$\b", " usd "), (("u$s",), r"(?U)\bu\$s\b", " usd "), (("bs",), r"(?U)\bbs\.?\b", " bob "),
)


def clean_text(c: Column, keep_punctuation: bool = False) -> Column:
    """Lower case without addresses, mails and mentions; ``#word`` as word, currency signs as words, other signs as spaces."""
    c = F.trim(F.lower(_text(c)))
    for _, pattern, by in _REPLACED:
        c = F.regexp_replace(c, pattern, by)
    signs = r".,;:!?%$+\-" if keep_punctuation else "%$"
    return normalize_space(F.regexp_replace(c, rf"[^{LETTERS}0-9{signs}\s]", " "))


def tokens(c: Column) -> Column:
    """Words and numbers of the cleaned text, in order."""
    return F.regexp_extract_all(clean_text(c), F.lit(rf"[{LETTERS}]+|\d+(?:[.,]\d+)?%?"), F.lit(0))


def drop_stopwords(words: Column, stop: list[str] = lexicon.STOPWORDS, keep: list[str] = lexicon.NEGATORS) -> Column:
    gone = [w for w in stop if w not in keep]
    return F.filter(words, lambda w: ~w.isin(gone))


def classic_text(c: Column) -> Column:
    """Tokens without stop words, negators kept, as one text."""
    return F.array_join(drop_stopwords(tokens(c)), " ")


def _replaced_if_there(signs: tuple[str, ...], pattern: str, by: str, c: Column) -> Column:
    return F.when(reduce(or_, [c.contains(s) for s in signs]), F.regexp_replace(c, pattern, by)).otherwise(c)


def topic_text(c: Column, stop: list[str] = lexicon.TOPIC_STOPWORDS) -> Column:
    """Tokens for topic models: no stop words, no numbers, at least three characters.

    The words of ``tokens`` without digits are the runs of letters of the text before other signs become spaces; each
    replacement is only tried where its signs are.
    """
    c = F.trim(F.lower(_text(c)))
    for replaced in _REPLACED:
        c = _once(c, lambda x: _replaced_if_there(*replaced, x))  # noqa: B023
    return F.array_join(F.filter(F.regexp_extract_all(c, F.lit(rf"[{LETTERS}]{{3,}}"), F.lit(0)), lambda w: ~w.isin(stop)), " ")


def strip_accents(c: Column) -> Column:
    return F.translate(c, "áéíóúüñÁÉÍÓÚÜÑ", "aeiouunAEIOUUN")


def plain_text(c: Column, stop: list[str] | None = None, accents: bool = True) -> Column:
    """Older normalisation: lower case, letters only, optionally without stop words and accents."""
    c = normalize_space(F.regexp_replace(F.regexp_replace(F.lower(_text(c)), r"https?://\S+|www\.\S+", " "), rf"[^{LETTERS}\s]", " "))
    c = c if stop is None else F.array_join(F.filter(F.split(c, " "), lambda w: ~w.isin(stop)), " ")
    return c if accents else strip_accents(c)


def term_pattern(term: str) -> str | None:
    """Pattern of a term that must stand alone (alphabetic, up to three letters); None if it may stand inside words."""
    return rf"(?U)\b{re.escape(term)}\b" if len(term) <= 3 and term.isalpha() else None


def holds_term(normal: Column, term: str) -> Column:
    pattern = term_pattern(term)
    return normal.contains(term) & normal.rlike(pattern) if pattern else normal.contains(term)


def _once(c: Column, made) -> Column:
    """``made`` of a column that is worked out once a row, however often ``made`` names it."""
    return F.element_at(F.transform(F.array(c), made), 1)


def _held(normal: Column, terms: list[str]) -> Column:
    found = F.lit(False)
    for t in terms:
        found = found | holds_term(normal, t)
    return found


def _labels(normal: Column, terms: dict[str, list[str]]) -> Column:
    held = lambda t: F.filter(F.array(*[F.when(_held(t, words), F.lit(name)) for name, words in terms.items()]), lambda x: x.isNotNull())
    return _once(normal, held)


def entities(c: Column, terms: dict[str, list[str]] = lexicon.ENTITIES) -> Column:
    """Names of the entities that the text mentions, in the list's order."""
    name = lexicon.CAPITALS_ONLY
    if name not in terms:
        return _labels(normalize(c), terms)
    full = terms | {name: [t for t in terms[name] if t != name.lower()]}
    written = _text(c).contains(name) & _text(c).rlike(rf"(?U)(?<!\w){name}(?!\w)")
    found = _labels(normalize(c), full)
    # the name in capitals counts too, in its place in the list
    every = F.array(*[F.lit(n) for n in terms])
    return F.when(written & ~F.array_contains(found, name), F.filter(every, lambda x: F.array_contains(found, x) | (x == name))).otherwise(found)


def indicators(c: Column, terms: dict[str, list[str]] = lexicon.INDICATORS) -> Column:
    return _labels(normalize(c), terms)


def term_counts(c: Column, weights: dict[str, int], whole: bool = False) -> Column:
    """Map of term to number of uses.  Phrases count anywhere unless ``whole``; words count where they stand alone."""

    def uses(normal: Column, t: str) -> Column:
        if whole:
            pattern = rf"(?U)(?<!\w){re.escape(t)}(?!\w)"
        else:
            pattern = re.escape(t) if " " in t else rf"(?U)\b{re.escape(t)}\b"
        return F.when(normal.contains(t), F.regexp_count(normal, F.lit(pattern))).otherwise(0)

    names = F.array(*[F.lit(t) for t in weights])
    counts = _once(normalize(c), lambda normal: F.array(*[uses(normal, t) for t in weights]))
    return F.map_filter(F.map_from_arrays(names, counts), lambda _, n: n > 0)


def weigh(counts: Column, weights: dict[str, int]) -> Column:
    """Sum of counts times weights."""
    by = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.aggregate(F.map_entries(counts), F.lit(0), lambda a, e: a + e["value"] * F.element_at(by, e["key"]))


def stress(risk: Column, relief: Column) -> Column:
    """Score from 0 to 100 of weighed risk and relief, 50 without either."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.lit(50) + risk - relief)).cast(IntegerType())


def level(score: Column, steps: tuple[int, int, int] = (75, 60, 40), names: tuple[str, ...] = ("crítico", "alto", "moderado", "bajo")) -> Column:
    out = F.lit(names[-1])
    for s, n in sorted(zip(steps, names)):
        out = F.when(score >= s, n).otherwise(out)
    return F.when(score.isNotNull(), out)


def economic_score(c: Column, terms: list[str] = lexicon.CLEAN_TERMS) -> Column:
    """Number of different terms that the text holds, also inside words."""

    def count(low: Column) -> Column:
        out = F.lit(0)
        for t in terms:
            out = out + low.contains(t).cast("int")
        return out

    return _once(normalize(c), count)


def _told(normal: Column, titles: list[str], patterns: list[str]) -> Column:
    return _once(normal, lambda t: t.isin(titles) | t.rlike("(?U)(?:" + "|".join(patterns) + ")"))


def excluded_title(c: Column) -> Column:
    return _told(normalize(c), lexicon.EXCLUDED_TITLES, lexicon.EXCLUDED_PATTERNS)


def generic_title(c: Column) -> Column:
    """Titles of index pages, a bank's or institute's name after them taken off."""
    key = normalize_space(F.regexp_replace(normalize(c), r"(?i)\s*[|–-]\s*(?:banco central de bolivia|bcb|ine).*$", ""))
    return _told(key, lexicon.GENERIC_TITLES, lexicon.GENERIC_PATTERNS)


def document_id(source: Column, url: Column, title: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", _text(source), _text(url), _text(title)), 256), 1, 20)


def annotation_id(doc_id: Column) -> Column:
    return F.concat(F.lit("ann-"), F.substring(F.sha2(doc_id, 256), 1, 12))


# Sequences that show UTF-8 read as a single-byte code page.
MERGE_SIGNS = ["Ã", "Â", "â€", "â€™", "â€œ", "â€\x9d", "â€“", "â€”", "\ufffd"]
SUSPICIOUS_SIGNS = ["Ã", "Â", "â€", "â€™", "â€œ", "â€“", "â€”", "\ufffd"]
_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"


def suspicious_score(c: Column) -> Column:
    """Number of sequences and control characters that show a wrong decoding."""
    out = F.regexp_count(_text(c), F.lit(_CONTROL))
    for sign in SUSPICIOUS_SIGNS:
        out = out + F.regexp_count(_text(c), F.lit(re.escape(sign)))
    return out


def _signs(text: str, control: bool) -> int:
    if control:
        return sum(text.count(s) for s in SUSPICIOUS_SIGNS) + len(re.findall(_CONTROL, text))
    return sum(text.count(s) for s in MERGE_SIGNS)


def _redecode(text: str, codecs: tuple[str, ...], rounds: int, control: bool) -> str:
    """The reading with fewest signs, as long as another round lessens them."""
    for _ in range(rounds):
        if not _signs(text, control):
            return text
        options = [text]
        for codec in codecs:
            try:
                options.append(text.encode(codec).decode("utf-8"))
            except UnicodeError:
                pass
        best = min(options, key=lambda x: _signs(x, control))
        if _signs(best, control) >= _signs(text, control):
            return text
        text = best
    return text


@F.pandas_udf(StringType())
def _repair_mojibake(s: pd.Series) -> pd.Series:
    return s.map(lambda x: _redecode(x, ("latin-1", "cp1252"), 3, False), na_action="ignore")


@F.pandas_udf(StringType())
def _repair_text(s: pd.Series) -> pd.Series:
    return s.map(lambda x: re.sub(_CONTROL, "", unicodedata.normalize("NFC", _redecode(x, ("latin-1",), 2, True))).strip(), na_action="ignore")


def repair_mojibake(c: Column) -> Column:
    """UTF-8 that was read as Latin-1 or Windows-1252, up to three times over; null stays null.

    Only texts with a sign of it go through Python.
    """
    signs = c.rlike("[" + "".join(sorted({s[0] for s in MERGE_SIGNS})) + "]")
    return F.coalesce(_repair_mojibake(F.when(signs, c)), c)


def repair_text(c: Column) -> Column:
    """As ``repair_mojibake`` for Latin-1, up to twice; composed form, no control characters, trimmed; null becomes empty.

    Plain ASCII without control characters is only trimmed, without Python.
    """
    plain = c.rlike(r"^[\x09\x0a\x0d\x20-\x7e]*$")
    return F.coalesce(F.when(plain, F.regexp_replace(c, r"^\s+|\s+$", "")), _repair_text(F.when(~plain, c)), F.lit(""))
