"""Collecting from fetched pages and feeds.  Fetching itself is left to a crawler that fills these tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quipu.functions import html, text
from quipu.operators.corpus import cap_per_source, relevant
from quipu.operators.annotation import hash_order

_ITEM = r"(?is)<(?:item|entry)\b[^>]*>(.*?)</(?:item|entry)>"


def feed_links(feeds: DataFrame, most: int = 20) -> DataFrame:
    """``(fuente, url, seq)`` of RSS and Atom feeds (fuente, xml): first links of each source, each once."""
    items = feeds.select("fuente", F.posexplode(F.regexp_extract_all("xml", F.lit(_ITEM), F.lit(1))).alias("place", "item"))
    inner = F.regexp_extract("item", r"(?is)<link[^>]*>\s*(?:<!\[CDATA\[)?\s*([^<\]\s]+)", 1)
    href = F.regexp_extract("item", r"(?is)<link[^>]*href\s*=\s*[\"']([^\"']+)", 1)
    rows = items.select("fuente", text.normalize_url(F.coalesce(F.nullif(inner, F.lit("")), href)).alias("url"), "place").where("url <> ''")
    rows = rows.groupBy("fuente", "url").agg(F.min("place").alias("seq"))
    return cap_per_source(rows, most)


def listing_links(pages: DataFrame, pattern: str = r".", most: int = 20) -> DataFrame:
    """``(fuente, url, seq)`` of listing pages (fuente, url, html): first links to the same host that match, each once."""
    hrefs = F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"), F.lit(1))
    rows = pages.select("fuente", F.col("url").alias("base"), F.posexplode(hrefs).alias("place", "link"))
    rows = rows.withColumn("to", text.absolute_url(F.col("base"), F.col("link")))
    rows = rows.where((text.url_host(F.col("to")) == text.url_host(F.col("base"))) & F.col("to").rlike(pattern))
    rows = rows.groupBy("fuente", text.normalize_url(F.col("to")).alias("url")).agg(F.min("place").alias("seq"))
    return cap_per_source(rows, most)


def articles(pages: DataFrame) -> DataFrame:
    """Collected items of article pages (fuente, url, html): title, text and date taken out, index pages and others dropped."""
    got = pages.withColumn("__a", html.article("html")).select("*", "__a.*").drop("__a", "html")
    return relevant(got)


def synthetic_reviews(spark: SparkSession, templates: dict[str, list[str]], products: list[str], adjectives: dict[str, list[str]], per_class: int, seed: int = 42) -> DataFrame:
    """``(texto, sentimiento)``: as many different texts of each class, templates filled with ``{p}`` and ``{a}``, by seed."""
    rows = [(k, t) for k, v in templates.items() for t in v]
    a = spark.createDataFrame(rows, "sentimiento string, t string").crossJoin(spark.createDataFrame([(p,) for p in products], "p string"))
    b = a.join(spark.createDataFrame([(k, x) for k, v in adjectives.items() for x in v], "sentimiento string, a string"), "sentimiento")
    full = b.select(F.replace(F.replace("t", F.lit("{p}"), F.col("p")), F.lit("{a}"), F.col("a")).alias("texto"), "sentimiento").distinct()
    span = Window.partitionBy("sentimiento").orderBy(hash_order("texto", seed), "texto")
    return full.withColumn("n", F.row_number().over(span)).where(F.col("n") <= per_class).drop("n")


def labelled_texts(df: DataFrame, content: Column, label: Column, least: int = 10) -> DataFrame:
    """``(texto, sentimiento)`` of a labelled dataset: known labels in lower case, texts of some length."""
    rows = df.select(text.normalize_space(content).alias("texto"), F.lower(F.trim(label)).alias("sentimiento"))
    return rows.where(F.col("sentimiento").isin("positivo", "neutral", "negativo") & (F.length("texto") >= least))
