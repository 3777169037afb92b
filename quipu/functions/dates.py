"""Dates of news pages, Column to Column; the session time zone must be UTC for timestamps to read as written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quipu.operators.timestamps import MONTHS

LOCAL_ZONE = "America/La_Paz"
_SPANISH = {n: m for m, names in MONTHS.items() for n in names[:1]} | {"setiembre": 9}


_ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?\s?(?:Z|[+-]\d{2}:?\d{2})?)?$"


def instant(c: Column) -> Column:
    """ISO text as instant, null if it isn't one; a text without zone is UTC, a date alone midnight."""
    text = F.trim(c)
    plain = F.regexp_replace(F.regexp_replace(text, "T", " "), r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(text.rlike(_ISO), F.try_to_timestamp(plain))


def spanish_date(c: Column) -> Column:
    """Local time of a date text: ISO (converted from UTC), ``10 de julio de 2026``, ``julio 10 2026`` or day first in numbers.

    A date alone in ISO form is midnight UTC and so falls on the evening before.
    """
    text = F.lower(F.trim(c))
    month = lambda name: F.element_at(F.create_map(*[F.lit(x) for kv in _SPANISH.items() for x in kv]), name)
    names = "|".join(_SPANISH)
    long_, short = rf"(\d{{1,2}})\s+de\s+({names})\s+(?:de|del)\s+(\d{{4}})", rf"({names})\s+(\d{{1,2}}),?\s+(\d{{4}})"
    part = lambda p, i: F.regexp_extract(text, p, i)
    day = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, F.lpad(m.cast("string"), 2, "0"), F.lpad(d, 2, "0")))
    numeric = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$"
    return F.coalesce(
        F.when(text.rlike(r"^\d{4}-\d\d-\d\d"), F.from_utc_timestamp(instant(c), LOCAL_ZONE)),
        F.when(text.rlike(long_), day(part(long_, 3), month(part(long_, 2)), part(long_, 1))).cast("timestamp"),
        F.when(text.rlike(short), day(part(short, 3), month(part(short, 1)), part(short, 2))).cast("timestamp"),
        F.when(text.rlike(numeric), day(part(numeric, 3), part(numeric, 2).cast("int"), part(numeric, 1))).cast("timestamp"),
    )


def age_hours(now: Column, at: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(at)) / 3.6e9


def month(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM")


def iso(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def compatible(a: Column, b: Column, days: float) -> Column:
    """Whether two times are at most so many days apart; a missing time fits any."""
    return a.isNull() | b.isNull() | (F.abs(F.unix_micros(a) - F.unix_micros(b)) <= days * 86400 * 1000000)
