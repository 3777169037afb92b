"""Queries of the training-data operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quipu.llm import areas, encoding, fusion, leaks, linking, mixing, pages, quotas, sitelines
from quipu.llm.sql import SQL
from quipu.operators.lineage import spread


__all__ = ["QUERIES", "SQL"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Batches in which p6_found takes in the lotes, one after the other.
BATCHES = 8
def texts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table for work on whole texts, spread over all cores if it is small."""
    return spread(table(spark, folder, name))


TEXTS = ["titulo", "texto", "fuente"]


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.damaged_fields(texts(spark, folder, "noticias"), TEXTS)


def p3_restored(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.restored_fields(table(spark, folder, "noticias"), TEXTS).select("seq", "campo", "restored")


def _best(spark: SparkSession, folder: str, retained: bool) -> DataFrame:
    items = table(spark, folder, "noticias")
    weight = F.when(~F.isnan("source_weight"), F.col("source_weight"))
    rules = {
        "source_weight": (weight, [weight]),
        "economic_score": (F.col("economic_score"), [F.col("economic_score")]),
        "url": (F.when(linking.page_key(F.col("url")).isNotNull(), F.col("url")), [weight]),
    }
    return fusion.fuse(items, linking.articles(items), rules, retained=retained)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _best(spark, folder, False).select("grupo", "campo", "seq")


def p1_fused(spark: SparkSession, folder: str) -> DataFrame:
    return _best(spark, folder, True)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return sitelines.repeated_lines(texts(spark, folder, "noticias"))


def p2_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return sitelines.without_lines(texts(spark, folder, "noticias"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return pages.boilerplate_lines(texts(spark, folder, "paginas"))


def p4_bodies(spark: SparkSession, folder: str) -> DataFrame:
    return pages.main_bodies(texts(spark, folder, "paginas"))


def _pools(spark: SparkSession, folder: str) -> list[tuple[DataFrame, DataFrame]]:
    targets = table(spark, folder, "cuotas_muestra")
    latest = F.try_to_timestamp("fecha_anotacion")
    pools = []
    for campo, name, key, at in (("sentimiento", "anotaciones", "annotation_id", latest), ("dominant_topic", "eventos_operativos", "event_id", None)):
        wanted = targets.where(F.col("campo") == campo)
        pools.append((quotas.eligible(table(spark, folder, name), key, campo, wanted, at), wanted))
    return pools


def _reports(spark: SparkSession, folder: str) -> DataFrame:
    first, second = (quotas.report(pool, wanted) for pool, wanted in _pools(spark, folder))
    return first.unionByName(second)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _reports(spark, folder).where("slack > 0").select("campo", "categoria")


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    return _reports(spark, folder)


def p5_sample(spark: SparkSession, folder: str) -> DataFrame:
    drawn = [quotas.draw(pool, quotas.report(pool, wanted)).withColumn("campo", F.lit(campo)) for campo, (pool, wanted) in zip(("sentimiento", "dominant_topic"), _pools(spark, folder))]
    return drawn[0].unionByName(drawn[1])


def _crossed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Annotations by sentiment and topic, the topics' targets being those of events."""
    targets = table(spark, folder, "cuotas_muestra")
    rows = table(spark, folder, "anotaciones").where(F.trim("annotation_id") != "").withColumn("at", F.try_to_timestamp("fecha_anotacion"))
    rows = rows.select(F.col("annotation_id").alias("key"), quotas.category_key(F.col("sentimiento")).alias("a"), quotas.category_key(F.col("tema")).alias("b"), "at")
    pool = rows.groupBy("key").agg(F.max_by(F.struct("a", "b"), F.struct("at", "a", "b")).alias("x")).select("key", "x.a", "x.b")
    cells, report = quotas.crossed(pool, *(targets.where(F.col("campo") == c) for c in ("sentimiento", "dominant_topic")))
    return pool, cells, report


def p5_crossed(spark: SparkSession, folder: str) -> DataFrame:
    return _crossed(spark, folder)[2]


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "noticias")
    rows = linking.articles(items, BATCHES)
    first = rows.where("seq = grupo").select("grupo", F.col("lote").alias("first"))
    later = rows.join(first, "grupo").where("lote > first and seq > grupo")
    return later.select(F.col("grupo").alias("seq_a"), F.col("seq").alias("seq_b")).distinct()


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked_items(texts(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    _, _, report = mixing.plan(texts(spark, folder, "documents"), table(spark, folder, "mezcla_fuentes"), mixing.word_count(F.col("text")))
    return report.where("short").select("source")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The mix by tokens: target shares and those of the documents selected."""
    return mixing.shares(*mixing.plan(texts(spark, folder, "documents"), table(spark, folder, "mezcla_fuentes"), mixing.token_count(F.col("text"))))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The mix by tokens: documents and how often each is taken for which source."""
    rows, routes, _ = mixing.plan(texts(spark, folder, "documents"), table(spark, folder, "mezcla_fuentes"), mixing.token_count(F.col("text")))
    return mixing.select(rows, routes)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return areas.document_areas(texts(spark, folder, "documents"), table(spark, folder, "etiquetas_area")).select("doc_id", "area")


def p10_composition(spark: SparkSession, folder: str) -> DataFrame:
    documents = texts(spark, folder, "documents")
    return areas.composition(areas.document_areas(documents, table(spark, folder, "etiquetas_area")), documents)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_fused": p1_fused,
    "p2_found": p2_found,
    "p2_cleaned": p2_cleaned,
    "p3_found": p3_found,
    "p3_restored": p3_restored,
    "p4_found": p4_found,
    "p4_bodies": p4_bodies,
    "p5_found": p5_found,
    "p5_report": p5_report,
    "p5_sample": p5_sample,
    "p5_crossed": p5_crossed,
    "p6_found": p6_found,
    "p8_found": p8_found,
    "p9_found": p9_found,
    "p9_shares": p9_shares,
    "p9_mix": p9_mix,
    "p10_found": p10_found,
    "p10_composition": p10_composition,
}
