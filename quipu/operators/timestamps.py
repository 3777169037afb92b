"""Mixed timestamp spellings to one UTC instant.

All spellings are one regular expression: an alternation of date shapes, a time of day and an optional
zone, every part a named group.  One ``regexp_replace`` whose replacement lists the groups pulls all
components out of a value in a single match; the rest is integer arithmetic on them (calendar checks,
days since 1970, seconds), so nothing depends on the session time zone or on parser leniency.
"""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quipu.operators.lineage import small

# Month names (Spanish, English, Portuguese), full and short.
MONTHS = {
    1: ["enero", "january", "janeiro", "ene", "jan"],
    2: ["febrero", "february", "fevereiro", "feb", "fev"],
    3: ["marzo", "march", "março", "marco", "mar"],
    4: ["abril", "april", "abr", "apr"],
    5: ["mayo", "may", "maio", "mai"],
    6: ["junio", "june", "junho", "jun"],
    7: ["julio", "july", "julho", "jul"],
    8: ["agosto", "august", "ago", "aug"],
    9: ["septiembre", "setiembre", "september", "setembro", "sept", "sep", "set"],
    10: ["octubre", "october", "outubro", "oct", "out"],
    11: ["noviembre", "november", "novembro", "nov"],
    12: ["diciembre", "december", "dezembro", "dic", "dec", "dez"],
}

# Zone abbreviations with one common meaning, in minutes east of UTC.
ZONE_MINUTES = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
    "EST": -300, "EDT": -240, "PST": -480, "PDT": -420, "MST": -420, "MDT": -360, "CDT": -300,
    "BOT": -240, "PET": -300, "COT": -300, "ART": -180, "BRT": -180, "CLT": -240, "CLST": -180, "UYT": -180,
}

_NAME = "(?:" + "|".join(sorted((n for v in MONTHS.values() for n in v), key=len, reverse=True)) + ")"
_DATES = [
    r"(?<ya>\d{4})(?<sa>[-/.])(?<ma>\d{1,2})\k<sa>(?<da>\d{1,2})",
    r"(?<yb>\d{4})(?<mb>\d{2})(?<db>\d{2})(?=T)",
    r"(?<p>\d{1,2})(?<sp>[-/.])(?<q>\d{1,2})\k<sp>(?<yc>\d{4}|\d{2})",
    rf"(?<dd>\d{{1,2}})(?:\s+de)?[\s-]+(?<nd>{_NAME})\.?(?:,|\s+de|\s+del)?[\s-]+(?<yd>\d{{4}})",
    rf"(?<ne>{_NAME})\.?\s+(?<de>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?<ye>\d{{4}})",
]
_TIME = (
    r"(?:T|,?\s+(?:(?:a\s+las|às|at|-|–|\|)\s+)?)(?:(?<h>\d{1,2})[:h.](?<mi>\d{2})(?:[:.](?<s>\d{2})(?:[.,]\d{1,9})?)?"
    r"|(?<hc>\d{2})(?<mc>\d{2})(?<sc>\d{2})?)"
    r"(?:\s*(?<ap>[ap])\.?\s?m\.?)?(?:\s*(?:hrs|hs|horas|h)\.?)?"
)
_ZONE = r"\s*(?:\(?(?<zn>Z|[A-Z]{3,4})\)?)?(?:(?<zs>[+-])(?<zh>\d{2}):?(?<zm>\d{2})?)?"
#: One pattern for every spelling; a value that doesn't match as a whole has no instant.
PATTERN = (
    r"(?iu)^\s*(?:(?<e>\d{10}|\d{13}|\d{16})|(?:\p{L}+:\s*)?(?:\p{L}{2,}\.?,\s*)?(?:" + "|".join(_DATES) + ")" + _TIME + _ZONE + r")\s*$"
)
_PARTS = ["${e}", "${ya}${yb}${yc}${yd}${ye}", "${ma}${mb}", "${nd}${ne}", "${da}${db}${dd}${de}", "${p}", "${q}",
          "${h}${hc}", "${mi}${mc}", "${s}${sc}", "${ap}", "${zn}", "${zs}", "${zh}", "${zm}"]
_KEYS = ["e", "y", "m", "name", "d", "p", "q", "h", "mi", "s", "ap", "zn", "zs", "zh", "zm"]


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days from 1970-01-01 to a date of the Gregorian calendar, years counted from March."""
    yy = y - F.when(m <= 2, 1).otherwise(0)
    era = F.floor(yy / 400)
    yoe = yy - era * 400
    doy = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    return era * 146097 + yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy - 719468


def _valid(y: Column, m: Column, d: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    last = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    return F.coalesce((y >= 1) & (m >= 1) & (m <= 12) & (d >= 1) & (d <= last), F.lit(False))


def _lookup(keys: dict, c: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in keys.items() for x in kv]), c)


def _offset(zone: Column, seconds: Column) -> Column:
    """Seconds east of UTC in ``zone`` at an instant."""
    at = F.timestamp_seconds(seconds)
    return F.unix_seconds(F.from_utc_timestamp(at, zone)) - F.unix_seconds(at)


def with_instant(df: DataFrame, value: str, out: str, order: Column | None = None, zone: Column | None = None) -> DataFrame:
    """Add ``out``: the UTC second that ``value`` denotes, or null.

    ``order`` is 'dmy' or 'mdy', how all-number dates are written; where it is null such a date counts
    only if one reading is possible or both agree.  ``zone`` is the IANA zone of wall-clock values without
    zone; where it is null they are undetermined, as are times that the zone's clock showed twice or never.
    Values without a time of day, relative or impossible ones give null.  Fractions are cut off.
    """
    pre = f"__{out}_"
    made: list[str] = []

    def add(**columns: Column) -> None:
        """Columns as a step of their own, so that later steps read them instead of computing them again."""
        nonlocal df
        made.extend(pre + k for k in columns)
        df = df.withColumns({pre + k: c for k, c in columns.items()})

    def c(k: str) -> Column:
        return F.col(pre + k)

    missing = F.lit(None).cast("string")
    add(order=missing if order is None else order, zone=missing if zone is None else zone)
    # the value stays as it is where the pattern doesn't match as a whole: it then has no separator pair
    add(raw=F.regexp_replace(F.col(value), PATTERN, "\u0001" + ";".join(_PARTS)))
    add(parts=F.when(c("raw").startswith("\u0001"), F.split(F.substring(c("raw"), 2, 200), ";")))
    text = {k: c("parts")[i] for i, k in enumerate(_KEYS)}
    # the pattern has only digits there; try_cast would be slow, as it throws on each empty part
    whole = {k: F.when(text[k] != "", text[k].cast("bigint")) for k in ("e", "y", "m", "d", "p", "q", "h", "mi", "s", "zh", "zm")}
    months = {n: m for m, names in MONTHS.items() for n in names}
    add(e=whole["e"], e_len=F.length(text["e"]), y=whole["y"] + F.when(F.length(text["y"]) == 2, 2000).otherwise(0),
        m=F.coalesce(whole["m"], _lookup(months, F.lower(text["name"])).cast("bigint")), d=whole["d"], p=whole["p"], q=whole["q"],
        ap=F.lower(text["ap"]), h=whole["h"], mi=whole["mi"], s=F.coalesce(whole["s"], F.lit(0)),
        zn=F.upper(text["zn"]), zs=text["zs"], zh=whole["zh"], zm=F.coalesce(whole["zm"], F.lit(0)))
    # minutes east of UTC: a name alone, an offset alone, or UTC/GMT with an offset; 9999: no such zone
    named = F.coalesce(_lookup(ZONE_MINUTES, c("zn")), F.lit(9999))
    shifted = F.when(c("zh").between(0, 18) & c("zm").between(0, 59), (c("zh") * 60 + c("zm")) * F.when(c("zs") == "-", -1).otherwise(1)).otherwise(9999)
    add(hour=F.when(c("ap") == "", c("h")).when(c("h").between(1, 12), c("h") % 12 + F.when(c("ap") == "p", 12).otherwise(0)),
        shift=F.when(c("zs") == "", F.when(c("zn") != "", named)).when(c("zn").isin("", "GMT", "UTC"), shifted).otherwise(9999).cast("bigint"))
    # two readings of an all-number date, one of any other
    add(m1=F.coalesce(c("q"), c("m")), d1=F.coalesce(c("p"), c("d")))
    add(dmy=F.when(_valid(c("y"), c("m1"), c("d1")), _days(c("y"), c("m1"), c("d1"))), mdy=F.when(_valid(c("y"), c("p"), c("q")), _days(c("y"), c("p"), c("q"))))
    add(day=F.when(c("p").isNull() | (c("order") == "dmy"), c("dmy")).when(c("order") == "mdy", c("mdy"))
        .when(c("dmy").isNull(), c("mdy")).when(c("mdy").isNull() | (c("dmy") == c("mdy")), c("dmy")).cast("bigint"))
    clock = c("hour").between(0, 23) & c("mi").between(0, 59) & c("s").between(0, 59)
    add(local=F.when(clock, c("day") * 86400 + c("hour") * 3600 + c("mi") * 60 + c("s")))
    # the zone's offsets a day before and a day after; the clock showed a time once if just one of them gives it
    add(wall=c("local").isNotNull() & c("shift").isNull() & c("zone").isNotNull())
    add(a=F.when(c("wall"), _offset(c("zone"), c("local") - 86400)), b=F.when(c("wall"), _offset(c("zone"), c("local") + 86400)))
    add(fa=_offset(c("zone"), c("local") - c("a")) == c("a"), fb=(c("a") != c("b")) & (_offset(c("zone"), c("local") - c("b")) == c("b")))
    epoch = F.floor(c("e") / F.when(c("e_len") == 10, 1).when(c("e_len") == 13, 1000).otherwise(1000000))
    result = (
        F.when(c("e").isNotNull(), epoch)
        .when(c("shift") == 9999, None)
        .when(c("shift").isNotNull(), c("local") - c("shift") * 60)
        .when(c("fa") & ~c("fb"), c("local") - c("a"))
        .when(c("fb") & ~c("fa"), c("local") - c("b"))
    )
    return df.withColumn(out, result.cast("bigint")).drop(*made)


def name_key(c: Column) -> Column:
    """What of a name survives any wrong decoding: its ASCII part, each run of other characters as one mark."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))), r"[^\x00-\x7f]+", "?")


def source_clock(catalogue: DataFrame) -> DataFrame:
    """``(source_key, zone, day_order)`` by damage-proof name key; keys of several entries are left out.

    Zones that aren't IANA names and orders other than dmy and mdy count as unknown.
    """
    zone = F.when(F.col("zona_horaria").isin(sorted(available_timezones())), F.col("zona_horaria"))
    order = F.when(F.col("orden_fecha").isin("dmy", "mdy"), F.col("orden_fecha"))
    return (
        catalogue.where(F.col("name").isNotNull())
        .select(name_key(F.col("name")).alias("source_key"), "name", zone.alias("zone"), order.alias("day_order"))
        .groupBy("source_key")
        .agg(F.countDistinct("name").alias("n"), F.max("zone").alias("zone"), F.max("day_order").alias("day_order"))
        .where("n = 1")
        .drop("n")
    )


#: A catalogue is broadcast up to this many rows (about 100 bytes each), beyond that joined by shuffle.
BROADCAST_ROWS = 100_000


def normalize_instants(items: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``(seq, campo, utc_s)`` for every ``fecha`` and ``collected_at`` that denotes exactly one instant.

    Rows with null, empty or undetermined values give no row; exact duplicate rows give one.  A fecha
    without zone is wall-clock time at its source, a collected_at without zone is UTC.
    """
    clock = source_clock(catalogue)
    rows = items.where("seq is not null").select("seq", "fecha", "collected_at", name_key(F.col("fuente")).alias("source_key"))
    rows = rows.join(small(clock, BROADCAST_ROWS), "source_key", "left")
    one = lambda campo, order, zone: F.struct(F.lit(campo).alias("campo"), F.col(campo).alias("value"), order.alias("day_order"), zone.alias("zone"))
    both = F.array(one("fecha", F.col("day_order"), F.col("zone")), one("collected_at", F.lit(None).cast("string"), F.lit("UTC")))
    rows = rows.select("seq", F.inline(both))
    rows = with_instant(rows, "value", "utc_s", F.col("day_order"), F.col("zone"))
    # the set leaves out nulls; a filter would be pushed down, and every step above copied into its condition
    return rows.groupBy("seq", "campo").agg(F.collect_set("utc_s").alias("utc_s")).select("seq", "campo", F.explode("utc_s").alias("utc_s"))
