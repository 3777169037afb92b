"""Numbers, lists and labels: Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Within bounds; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def round2(c: Column) -> Column:
    """Two decimals, halves up, the same in every engine."""
    return F.floor(c * 100 + 0.5) / 100.0


def percentage(part: Column, whole: Column) -> Column:
    """Share in percent to two decimals; 0 of nothing."""
    return F.when(whole > 0, round2(part / whole * 100)).otherwise(F.lit(0.0))


def momentum(now: Column, before: Column) -> Column:
    """Growth of a count from 0 (a quarter or less) over 0.5 (equal) to 1 (fourfold or more)."""
    return clamp((F.log2((now + 1) / (before + 1)) + 2) / 4)


def momentum_ratio(now: Column, before: Column) -> Column:
    return (now + 1) / (before + 1)


def momentum_label(ratio: Column) -> Column:
    return F.when(ratio >= 1.5, "emergente").when(ratio <= 0.70, "en descenso").otherwise("estable")


def number(c: Column, default: float, low: float | None = None, high: float | None = None) -> Column:
    """A column as number, the default where it isn't one, within bounds."""
    got = F.coalesce(c.try_cast("double"), F.lit(default))
    got = F.when(F.isnan(got), default).otherwise(got)
    return got if low is None else clamp(got, low, high)


def softmax(scores: Column) -> Column:
    """Probabilities of an array of log scores."""
    # the largest score and the sum are worked out once a row
    one = lambda made, then: F.element_at(F.transform(F.array(made), then), 1)
    shifted = one(F.struct(scores.alias("a"), F.array_max(scores).alias("m")), lambda s: F.transform(s["a"], lambda x: F.exp(x - s["m"])))
    total = lambda e: F.struct(e.alias("e"), F.aggregate(e, F.lit(0.0), lambda a, y: a + y).alias("t"))
    return one(one(shifted, total), lambda s: F.transform(s["e"], lambda x: x / s["t"]))


def argmax(scores: Column) -> Column:
    """Place, from 0, of the first largest element."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def json_list(c: Column, keep_malformed: bool = False) -> Column:
    """Texts of a JSON array, trimmed, blanks dropped.  What isn't an array gives an empty list, or, if malformed text is
    kept, itself as only item unless it is valid JSON of another kind."""
    items = F.from_json(c, "array<string>")
    clean = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    empty = F.array().cast("array<string>")
    if not keep_malformed:
        return F.coalesce(clean, empty)
    valid = F.get_json_object(c, "$").isNotNull()
    text = F.when(~F.lower(F.trim(c)).isin("", "nan") & ~valid, F.array(F.trim(c)))
    return F.coalesce(clean, text, empty)


def json_text(items: Column) -> Column:
    """JSON array of the sorted distinct items."""
    return F.to_json(F.array_sort(F.array_distinct(items)))


def labels(c: Column, is_json: bool) -> Column:
    """Labels of a row: a JSON list, or one text unless it is missing."""
    if is_json:
        return json_list(c)
    return F.when(~F.lower(F.trim(c)).isin("", "nan"), F.array(F.trim(c))).otherwise(F.array().cast("array<string>"))


def lookup(c: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """Value of a label in a small table; the default, or an error where there is none."""
    got = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.lower(F.trim(c)))
    return F.coalesce(got, F.raise_error(F.concat(F.lit("unknown label: "), c)) if default is None else default)


# Sentiment labels by what they are called in datasets.
SENTIMENTS = {"positive": "positivo", "positivo": "positivo", "neutral": "neutral", "negative": "negativo", "negativo": "negativo"}


def sentiment(c: Column) -> Column:
    """Canonical sentiment of a label in any case; null stays null, an unknown label is an error."""
    return F.when(c.isNotNull(), lookup(c, SENTIMENTS))


# Tone of a sentiment label.
TONES = {"positivo": "favorable", "neutral": "neutral", "negativo": "desfavorable"}
