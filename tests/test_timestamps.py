import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from quipu.operators.timestamps import normalize_instants, with_instant

ITEMS = "seq bigint, fuente string, fecha string, collected_at string"
CATALOGUE = "name string, zona_horaria string, orden_fecha string"
SOURCES = [("Cable Ibérico", "Europe/Madrid", "dmy"), ("NorthDesk", "America/New_York", "mdy"), ("La Crónica", "America/La_Paz", "dmy"), ("Sin Zona", "nowhere", None)]


def seconds(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp())


def run(spark, rows):
    got = normalize_instants(spark.createDataFrame(rows, ITEMS), spark.createDataFrame(SOURCES, CATALOGUE)).collect()
    assert len(got) == len({(r.seq, r.campo) for r in got})
    return {(r.seq, r.campo): r.utc_s for r in got}


@pytest.mark.parametrize(
    "source, value, want",
    [
        ("La Crónica", "2025-07-01T11:50:16+00:00", seconds(2025, 7, 1, 11, 50, 16)),
        ("La Crónica", "2025-07-01 11:50:16.999-0400", seconds(2025, 7, 1, 15, 50, 16)),
        ("La Crónica", "20250701T044136Z", seconds(2025, 7, 1, 4, 41, 36)),
        ("La Crónica", "Wed, 02 Jul 2025 18:07:34 GMT", seconds(2025, 7, 2, 18, 7, 34)),
        ("La Crónica", "1 de julio de 2025 a las 14:24", seconds(2025, 7, 1, 18, 24)),
        ("La Cr├│nica", "03/07/2025 23:19", seconds(2025, 7, 4, 3, 19)),
        ("La Crónica", "Publicado: 27.07.2025 | 12:05 a. m.", seconds(2025, 7, 27, 4, 5)),
        ("La Crónica", "15 jul. 2025, 02:18 p. m.", seconds(2025, 7, 15, 18, 18)),
        ("La Crónica", "Julio 12, 2025 10h05", seconds(2025, 7, 12, 14, 5)),
        ("NorthDesk", "8/13/25 4:15 PM", seconds(2025, 8, 13, 20, 15)),
        ("NorthDesk", "Aug 11, 2025, 5:35 AM EDT", seconds(2025, 8, 11, 9, 35)),
        ("NorthDesk", "11/22/2025 21:51:26 GMT-04:00", seconds(2025, 11, 23, 1, 51, 26)),
        ("Cable Ibérico", "26/08/2025 21:47 CEST", seconds(2025, 8, 26, 19, 47)),
        (None, "1751498531", seconds(2025, 7, 2, 23, 22, 11)),
        (None, "1751498531690", seconds(2025, 7, 2, 23, 22, 11)),
        (None, "26/08/2025 21:47 CEST", seconds(2025, 8, 26, 19, 47)),
        (None, "05/07/2025 13:25:41 GMT-03:00", None),
        (None, "2025-07-02 14:26:21", None),
        ("Sin Zona", "2025-07-02 14:26:21", None),
        ("Cable Ibérico", "2025-10-26 02:30:00", None),
        ("Cable Ibérico", "2026-03-29 02:30:00", None),
        ("Cable Ibérico", "2025-10-26 01:59:59", seconds(2025, 10, 25, 23, 59, 59)),
        ("Cable Ibérico", "2025-10-26 03:00:00", seconds(2025, 10, 26, 2)),
        ("NorthDesk", "11/2/25 1:41 AM", None),
        ("La Crónica", "2026-02-30T02:54:00", None),
        ("La Crónica", "2025-09-01 25:47", None),
        ("La Crónica", "2025-07-01 10:60", None),
        ("La Crónica", "14 de agosto de 2025", None),
        ("La Crónica", "2025-07-01", None),
        ("La Crónica", "hace 26 horas", None),
        ("La Crónica", "ayer", None),
        ("La Crónica", "", None),
        ("La Crónica", None, None),
        ("La Crónica", "x" * 100_000, None),
    ],
)
def test_spellings(spark, source, value, want):
    assert run(spark, [(1, source, value, None)]).get((1, "fecha")) == want


def test_collected_at_without_zone_is_utc_and_repeats_count_once(spark):
    rows = [(1, None, None, "2025-07-01 02:57:24")] * 3 + [(None, None, None, "2025-07-01 02:57:24")]
    assert run(spark, rows) == {(1, "collected_at"): seconds(2025, 7, 1, 2, 57, 24)}


def test_empty_and_extra_columns(spark):
    assert run(spark, []) == {}
    items = spark.createDataFrame([(1, "La Crónica", "2025-07-01 10:00", None, "x", "y")], ITEMS + ", zone string, e string")
    got = normalize_instants(items, spark.createDataFrame(SOURCES, CATALOGUE).withColumn("seq", F.lit(1))).collect()
    assert [(r.seq, r.utc_s) for r in got] == [(1, seconds(2025, 7, 1, 14))]


def test_wall_clock_against_brute_force(spark):
    """Every half hour around the changes: the instants whose local reading is the value, if there is exactly one."""
    zone, rows, want = ZoneInfo("Europe/Madrid"), [], {}
    for day in (datetime(2025, 10, 25, 20), datetime(2026, 3, 28, 20)):
        for k in range(24):
            wall = day + timedelta(minutes=30 * k)
            seq = len(rows)
            rows.append((seq, "Cable Ibérico", wall.strftime("%Y-%m-%d %H:%M:%S"), None))
            base = int(wall.replace(tzinfo=timezone.utc).timestamp())
            hits = [s for s in range(base - 4 * 3600, base + 4 * 3600, 1800) if datetime.fromtimestamp(s, zone).replace(tzinfo=None) == wall]
            if len(hits) == 1:
                want[seq, "fecha"] = hits[0]
    assert run(spark, rows) == want


def test_calendar_arithmetic_against_the_standard_library(spark):
    rng, rows, want = random.Random(3), [], {}
    for i in range(300):
        at = datetime(1970, 1, 1) + timedelta(seconds=rng.randrange(0, 4_000_000_000))
        rows.append((i, at.strftime("%Y-%m-%dT%H:%M:%SZ")))
        want[i] = int(at.replace(tzinfo=timezone.utc).timestamp())
    got = with_instant(spark.createDataFrame(rows, "seq int, v string"), "v", "s").collect()
    assert {r.seq: r.s for r in got} == want
