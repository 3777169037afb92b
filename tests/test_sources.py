import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

import __spark_entry__ as entry
from quipu.operators.corpus import upsert
from quipu.sources import catalogue, pages, tables
from quipu.streaming import incremental

SCHEMA = StructType([StructField("a", StringType()), StructField("n", IntegerType()), StructField("z", StringType())])


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([('x, "y"\nz', 1), (None, None)], "a string, n int")
    tables.write_csv(df, str(tmp_path / "t"))
    got = tables.read_csv(spark, str(tmp_path / "t"), SCHEMA).collect()
    assert sorted((r.a or "", r.n or 0, r.z) for r in got) == [("", 0, None), ('x, "y"\nz', 1, None)]
    assert tables.read_csv_or_empty(spark, str(tmp_path / "none"), SCHEMA).count() == 0


def test_replace_table_from_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_table(spark.range(3), path)
    tables.replace_table(spark.read.parquet(path).where("id > 0"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2]


def test_feed_and_listing_links(spark):
    xml = "<rss><item><link>https://x.bo/a#t</link></item><item><link>https://x.bo/a/</link></item><entry><link href='https://x.bo/b'/></entry></rss>"
    feed = pages.feed_links(spark.createDataFrame([("A", xml), ("B", None)], "fuente string, xml string"))
    assert sorted(r.url for r in feed.collect()) == ["https://x.bo/a", "https://x.bo/b"]
    page = '<a href="/n/1">x</a><a class=y href=\'https://y.bo/n/2\'>y</a><a href="/n/1#c">z</a><a href="/tag">t</a>'
    got = pages.listing_links(spark.createDataFrame([("A", "https://x.bo/p", page)], "fuente string, url string, html string"), r"/n/\d+")
    assert [r.url for r in got.collect()] == ["https://x.bo/n/1"]


def test_catalogue_rules(spark):
    rows = [(1, "A", "newspaper", "active", "https://a", 0.5), (1, "a ", "blog", "active", "", 2.0), (3, None, "official", "paused", "https://c", None)]
    df = spark.createDataFrame(rows, "id int, name string, source_type string, status string, homepage string, source_weight double")
    got = {(r.id, r.rule) for r in catalogue.violations(df).collect()}
    assert {("1", "duplicate_id"), ("1", "duplicate_name"), ("1", "unknown_source_type"), ("1", "no_homepage"), ("1", "weight_out_of_range"), ("3", "missing_name"), ("3", "unknown_status"), ("3", "weight_out_of_range")} == got
    assert [r.name for r in catalogue.runnable(df).collect()] == ["A"]


def test_upsert_with_new_columns(spark):
    old, new = spark.createDataFrame([("d1", 1), ("d2", 2)], "date string, n int"), spark.createDataFrame([("d2", 5, "x")], "date string, n int, s string")
    assert {(r.date, r.n, r.s) for r in upsert(old, new, "date").collect()} == {("d1", 1, None), ("d2", 5, "x")}


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("d1", 1), ("d2", 2)], "date string, n int").write.parquet(source)
    stream = spark.readStream.schema("date string, n int").parquet(source)
    for _ in range(2):
        incremental.upsert_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck"), "date").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    rows = spark.createDataFrame([("2026-01-01 00:00:00", "a", 5), ("2026-01-02 00:00:00", "a", 7)], "at string, tema string, stress_score int").withColumn("at", F.col("at").cast("timestamp"))
    got = incremental.windowed_counts(rows, "at", "tema").collect()
    assert max(r.documents for r in got) == 2 and len(got) == 4


def test_entry(spark):
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and "p7_found" in names
    assert entry.entry(spark).count() >= 0


def test_replacement_keeps_the_old_table_if_the_move_fails(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_table(spark.range(3), path)
    (tmp_path / "t.lock").touch()
    with pytest.raises(FileExistsError):
        tables.replace_table(spark.range(5), path)
    (tmp_path / "t.lock").unlink()
    assert spark.read.parquet(path).count() == 3
    tables.replace_table(spark.read.parquet(path).where("id > 0"), path)
    assert spark.read.parquet(path).count() == 2 and [p.name for p in tmp_path.iterdir()] == ["t"]
