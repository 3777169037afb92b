"""Reading and writing tables: delimited text, JSON, Parquet; defaults for what is missing; safe replacement."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

_S = StringType()
#: Schema of a news corpus; ``seq`` is the order of arrival.
CORPUS = StructType(
    [StructField(c, _S) for c in ("id", "titulo", "texto", "fuente", "fecha", "url")]
    + [StructField("economic_score", IntegerType())]
    + [StructField(c, _S) for c in ("source_type", "department", "scope")]
    + [StructField("source_weight", DoubleType()), StructField("collected_at", _S)]
)


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Comma-separated text with a header, quotes doubled, line ends within quotes; a byte-order mark is dropped.

    With a schema, columns are matched by name: missing ones are null, others are left out, unreadable numbers null.
    Without, types are inferred.
    """
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", schema is None).csv(path)
    rows = rows.toDF(*[c.lstrip("﻿") for c in rows.columns])
    if schema is None:
        return rows
    return rows.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def read_csv_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """As ``read_csv``, an empty table where there is no file."""
    try:
        return read_csv(spark, path, schema)
    except Exception as problem:
        if "PATH_NOT_FOUND" in str(problem):
            return spark.createDataFrame([], schema)
        raise


def write_csv(df: DataFrame, path: str, bom: bool = True) -> None:
    """Comma-separated text with a header; lists and maps as JSON; optionally with a byte-order mark in the header."""
    flat = df.select(*[(F.to_json(c) if t.startswith(("array", "map", "struct")) else F.col(c)).alias(c) for c, t in df.dtypes])
    if bom and flat.columns:
        flat = flat.withColumnRenamed(flat.columns[0], "﻿" + flat.columns[0])
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A JSON document (one row) or one document a line."""
    return spark.read.option("multiLine", not lines).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def document(spark: SparkSession, **sections: DataFrame) -> DataFrame:
    """One row, one column per section: the section's rows as JSON.  Sections are reports, small by nature."""
    out = None
    for name, df in sections.items():
        one = df.agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias(name))
        out = one if out is None else out.crossJoin(one)
    return out


def replace_table(df: DataFrame, path: str) -> None:
    """Replace a Parquet table, also with rows made from itself: written beside it, then moved into its place.

    The old table is set aside, not deleted, until the new one is in place, and put back if that fails; every move's
    outcome is checked.  One writer at a time: a lock file beside the table keeps others out (FileExistsError).
    """
    spark, path = df.sparkSession, path.rstrip("/")
    jvm = spark._jvm
    run = uuid.uuid4().hex
    at = {k: jvm.org.apache.hadoop.fs.Path(path + v) for k, v in (("table", ""), ("new", f".new-{run}"), ("old", f".old-{run}"), ("lock", ".lock"))}
    fs = at["table"].getFileSystem(spark._jsc.hadoopConfiguration())
    if at["lock"].getParent() is not None:
        fs.mkdirs(at["lock"].getParent())
    if not fs.createNewFile(at["lock"]):
        raise FileExistsError(f"another writer holds {path}.lock")
    try:
        df.write.parquet(f"{path}.new-{run}")
        aside = fs.exists(at["table"])
        if aside and not fs.rename(at["table"], at["old"]):
            raise OSError(f"can't set {path} aside; it is unchanged")
        try:
            moved = fs.rename(at["new"], at["table"])
        except Exception:
            moved = False
        if not moved:
            if aside and not fs.rename(at["old"], at["table"]):
                raise OSError(f"can't move the new table into place; the old one is {path}.old-{run}")
            raise OSError(f"can't move the new table into place; {path} is unchanged")
        fs.delete(at["old"], True)
    finally:
        fs.delete(at["new"], True)
        fs.delete(at["lock"], False)
    spark.catalog.refreshByPath(path)
