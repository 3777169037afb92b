"""Queries over the driver's tables, one or more per operator.

``noticias`` is the corpus, ``eventos_operativos`` the clustered events, ``fuentes`` the catalogue, ``anotaciones`` the
annotation batch; the clock stands at NOW.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quipu.functions import dates, lexicon, numbers, text
from quipu.operators import annotation, corpus, events, gates, lineage, metrics, models, ranking, temporal, timestamps
from quipu.plans import pipeline, service
from quipu.sources import catalogue, pages

FLAGSHIP = "rank_documents_topics"
NOW = "2026-02-01 00:00:00"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def now() -> Column:
    return F.lit(NOW + "+00:00").cast("timestamp")


def news(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "noticias")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """News for work on whole texts, spread over all cores."""
    return lineage.spread(news(spark, folder))


def dated(spark: SparkSession, folder: str) -> DataFrame:
    return temporal.temporal_columns(news(spark, folder), now())


def levelled(spark: SparkSession, folder: str) -> DataFrame:
    """News with a stress level; whether the models agree isn't told in these tables."""
    return texts(spark, folder).withColumns({"stress_nivel": text.level(F.col("stress_score")), "coincidencia_modelos": F.lit(None).cast("boolean")})


def content() -> Column:
    return F.concat_ws(". ", "titulo", "texto")


@query
def p7_found(spark, folder):
    return timestamps.normalize_instants(news(spark, folder), table(spark, folder, "fuentes"))


@query
def rank_documents_topics(spark, folder):
    return ranking.rank_dimension(dated(spark, folder), "tema", hours=720.0)


@query
def rank_documents_indicators(spark, folder):
    return ranking.rank_dimension(dated(spark, folder), "indicadores", hours=720.0, limit=15, labels=F.col("indicadores"))


@query
def rank_events_unwindowed(spark, folder):
    return ranking.rank_events(table(spark, folder, "eventos_operativos"), "dominant_topic")


@query
def rank_events_windowed(spark, folder):
    rows = table(spark, folder, "eventos_operativos").withColumn("age", dates.age_hours(now(), dates.instant(F.col("effective_at"))))
    rows = rows.withColumn("period", temporal.period(F.col("age"), 2160.0))
    return ranking.rank_events(rows.where("period = 'current'"), "dominant_topic", rows.where("period = 'previous'"), "age", 2160.0)


@query
def leader_topic(spark, folder):
    return ranking.leader(rank_documents_topics(spark, folder)).select("name", "eligible")


@query
def temporal_policy(spark, folder):
    return dated(spark, folder).select("seq", "published_at", "collected_at_normalized", "effective_at", "age_hours", "date_quality", "is_recent", "temporal_exclusion_reason")


@query
def temporal_audit(spark, folder):
    return temporal.temporal_audit(dated(spark, folder))


@query
def operational_top(spark, folder):
    rows = temporal.temporal_columns(news(spark, folder), now(), temporal.TemporalPolicy(recent_hours=720.0)).where("is_recent")
    return rows.orderBy(F.desc_nulls_last("effective_at"), F.desc_nulls_last("stress_score"), "seq").limit(30).select("seq", "effective_at", "stress_score")


@query
def range_filter(spark, folder):
    inside, outside = temporal.in_range(news(spark, folder), dates.instant(F.col("fecha")), F.lit("2025-09-01 00:00:00+00:00").cast("timestamp"), now())
    return inside.select("seq", F.lit(True).alias("inside")).unionByName(outside.select("seq", F.lit(False).alias("inside")))


@query
def spanish_dates(spark, folder):
    return news(spark, folder).select("seq", F.date_format(dates.spanish_date(F.col("fecha")), "yyyy-MM-dd HH:mm").alias("local_time")).where("local_time is not null")


@query
def monthly_macro_score(spark, folder):
    return metrics.monthly_series(levelled(spark, folder), dates.instant(F.col("fecha")))


@query
def macro_score(spark, folder):
    return metrics.macro_score(levelled(spark, folder))


@query
def optimism_index(spark, folder):
    return metrics.optimism_index(levelled(spark, folder), F.concat_ws(" ", "titulo", "texto"))


@query
def frequency_table(spark, folder):
    return metrics.frequency_table(news(spark, folder), "tono_consolidado")


@query
def indicator_frequency(spark, folder):
    return metrics.list_frequency(news(spark, folder), F.col("indicadores"))


@query
def entity_top(spark, folder):
    return metrics.list_frequency(news(spark, folder), F.col("entidades"), 5)


@query
def json_label_frequency(spark, folder):
    return metrics.list_frequency(table(spark, folder, "anotaciones"), numbers.json_list(F.col("indicadores")))


@query
def source_breakdown(spark, folder):
    return metrics.source_breakdown(levelled(spark, folder))


@query
def history_upsert(spark, folder):
    rows = news(spark, folder).withColumn("date", F.date_format(dates.instant(F.col("collected_at")), "yyyy-MM-dd")).where("date is not null")
    old = rows.where("lote <= 200").groupBy("date").agg(F.count("*").alias("documents"))
    new = rows.where("lote > 150").groupBy("date").agg(F.count("*").alias("documents"), F.countDistinct("fuente").alias("sources"))
    return corpus.upsert(old, new, "date")


@query
def title_keys(spark, folder):
    t = F.col("titulo")
    return news(spark, folder).select("seq", text.title_key(t).alias("title_key"), text.simple_title_key(t).alias("simple_key"), text.annotation_title_key(t).alias("annotation_key"))


@query
def url_keys(spark, folder):
    return news(spark, folder).select("seq", text.normalize_url(F.col("url")).alias("url_key"), text.url_host(F.col("url")).alias("host"))


@query
def economic_scores(spark, folder):
    return texts(spark, folder).select("seq", text.economic_score(content()).alias("clean_score"), text.economic_score(content(), lexicon.COLLECT_TERMS).alias("collect_score"))


@query
def lexical_stress(spark, folder):
    risk, relief = text.weigh(text.term_counts(content(), lexicon.RISK), lexicon.RISK), text.weigh(text.term_counts(content(), lexicon.RELIEF), lexicon.RELIEF)
    rows = texts(spark, folder).select("seq", risk.alias("risk"), relief.alias("relief"))
    return rows.select("seq", "risk", "relief", text.stress(F.col("risk"), F.col("relief")).alias("stress")).withColumn("level", text.level(F.col("stress")))


@query
def optimism_terms(spark, folder):
    counts = text.term_counts(F.concat_ws(" ", "titulo", "texto"), lexicon.OPTIMISM, whole=True)
    return metrics.merged_counts(texts(spark, folder).select(counts.alias("counts")), "counts")


@query
def entity_mentions(spark, folder):
    return texts(spark, folder).select("seq", F.explode(text.entities(content())).alias("entity"))


@query
def indicator_mentions(spark, folder):
    return texts(spark, folder).select("seq", F.explode(text.indicators(content())).alias("indicator"))


@query
def token_counts(spark, folder):
    words = text.tokens(F.col("texto"))
    return texts(spark, folder).select("seq", F.size(words).alias("tokens"), F.length(text.classic_text(F.col("texto"))).alias("classic_length"), F.length(text.topic_text(F.col("texto"))).alias("topic_length"))


@query
def excluded_titles(spark, folder):
    t = F.col("titulo")
    return news(spark, folder).select("seq", text.excluded_title(t).alias("excluded"), text.generic_title(t).alias("generic"))


@query
def stable_ids(spark, folder):
    made = text.document_id(F.col("fuente"), F.col("url"), F.col("titulo"))
    return news(spark, folder).select("seq", made.alias("document_id"), text.annotation_id(F.col("id")).alias("annotation_id"))


@query
def event_ids(spark, folder):
    of = lambda c: F.coalesce(F.col(c), F.lit(""))
    return news(spark, folder).groupBy("lote").agg(events.event_id(F.collect_list(F.array(of("url"), of("titulo"), of("fecha")))).alias("event_id"))


@query
def mojibake_repair(spark, folder):
    rows = texts(spark, folder)
    named = corpus.string_columns(rows)
    return corpus.repair_strings(rows.select("seq", *named), named)


@query
def repair_report(spark, folder):
    rows = texts(spark, folder)
    named = corpus.string_columns(rows)
    fixed = rows.select(*named, *[text.repair_text(F.col(c)).alias(f"fixed_{c}") for c in named])
    return metrics.repair_report(fixed, {c: (c, f"fixed_{c}") for c in named})


def _merged(spark, folder):
    rows = texts(spark, folder)
    return corpus.merge_corpus(rows.where("lote <= 200"), rows.where("lote > 200"), "2026-02-01T00:00:00Z")


@query
def corpus_merge(spark, folder):
    return _merged(spark, folder).select("seq", "id", "url", "economic_score", "source_weight", "source_type")


@query
def clean_dedup(spark, folder):
    return corpus.clean_corpus(texts(spark, folder)).select("seq", "score_recalculado")


@query
def greedy_dedup(spark, folder):
    return corpus.greedy_deduplicate(news(spark, folder)).select("seq")


@query
def best_by_title(spark, folder):
    return corpus.best_for_annotation(news(spark, folder)).select("seq", "source_weight", "economic_score")


@query
def backfill_metadata(spark, folder):
    return corpus.backfill_metadata(news(spark, folder), table(spark, folder, "fuentes")).select("seq", "source_type", "department", "scope", "source_weight")


@query
def unknown_sources(spark, folder):
    return corpus.unknown_sources(news(spark, folder), table(spark, folder, "fuentes"))


@query
def union_evolve(spark, folder):
    a = news(spark, folder).select("seq", "fuente", "tema")
    b = table(spark, folder, "documents").select(F.col("doc_id").alias("seq"), F.col("source").alias("fuente"), "lang")
    return a.unionByName(b, allowMissingColumns=True)


@query
def anti_join(spark, folder):
    return news(spark, folder).join(table(spark, folder, "anotaciones").select("id"), "id", "left_anti").select("seq", "id")


@query
def semi_join(spark, folder):
    return news(spark, folder).join(table(spark, folder, "anotaciones").select("id"), "id", "left_semi").select("seq", "id")


@query
def per_source_cap(spark, folder):
    return corpus.cap_per_source(news(spark, folder).where("fuente is not null"), 20).select("fuente", "seq")


def _operational(spark, folder):
    rows = temporal.temporal_columns(news(spark, folder), now(), temporal.TemporalPolicy(recent_hours=240.0))
    return lineage.spread(lineage.store(rows.where("is_recent")))


@query
def tfidf_weights(spark, folder):
    rows = events.tfidf(_operational(spark, folder), "seq", events.document_text())
    return rows.groupBy(F.col("key").alias("seq")).agg(F.count("*").alias("terms"), numbers.round2(F.sum("w") * 100).alias("weight"))


@query
def event_clusters(spark, folder):
    return events.cluster_news(_operational(spark, folder)).select("seq", "event_id", "event_size")


@query
def event_clusters_corpus(spark, folder):
    """Clusters of all dated news, whatever their age."""
    rows = temporal.temporal_columns(texts(spark, folder), now())
    return events.cluster_news(rows.where("effective_at is not null")).select("seq", "event_id", "event_size")


@query
def event_summary(spark, folder):
    return events.summarize_events(events.cluster_news(_operational(spark, folder)))


@query
def event_payload(spark, folder):
    rows = table(spark, folder, "eventos_operativos")
    return events.event_payload(rows, rows.select(F.explode(F.sequence(F.lit(1), F.greatest("documents", F.lit(1))))))


@query
def dominant_topic(spark, folder):
    return events.dominant(news(spark, folder).where("fuente is not null"), "fuente", text.missing(F.trim("tema")), "tema")


@query
def representative_documents(spark, folder):
    rows = news(spark, folder).withColumns({"event_id": F.col("lote").cast("string"), "effective_at": F.col("collected_at")})
    return events.representative(rows).select("event_id", "seq")


@query
def quota_sample(spark, folder):
    return annotation.quota_sample(news(spark, folder), "fuente", "seq", 200).select("fuente", "seq")


@query
def stratified_split(spark, folder):
    rows = news(spark, folder).where("tono_consolidado is not null")
    return annotation.stratified_split(rows, "tono_consolidado", "seq").select("seq", "split")


@query
def annotation_batch(spark, folder):
    return annotation.build_batch(news(spark, folder)).select("annotation_id", "id")


@query
def annotation_corpus(spark, folder):
    return annotation.prepare_corpus(news(spark, folder)).select("id", "titulo", "source_weight")


@query
def annotation_status(spark, folder):
    return annotation.status(table(spark, folder, "anotaciones"))


@query
def annotation_pending(spark, folder):
    return annotation.state(table(spark, folder, "anotaciones"), "pending").select("annotation_id", "id", "sentimiento")


@query
def annotation_page(spark, folder):
    return annotation.page(table(spark, folder, "anotaciones").select("annotation_id", "id").distinct(), [F.col("annotation_id"), F.col("id")], 50, 25)


@query
def annotation_update(spark, folder):
    rows = table(spark, folder, "anotaciones")
    return annotation.update(rows, "annotation_id", "ann-000000010", {"sentimiento": "negativo", "duda": 1}).select("annotation_id", "id", "sentimiento", "duda", "fecha_anotacion")


def _bayes(spark, folder, said: Column):
    rows = texts(spark, folder).where(F.col("tono_consolidado").isNotNull() & said.isNotNull())
    packed, words, idf = models.nb_pack(rows, "seq", said, "tono_consolidado")
    labels = rows.select(F.col("seq").alias("key"), F.col("tono_consolidado").alias("label"))
    return (packed, words, idf), models.nb_train_packed(packed, words, idf, labels)


def _document() -> Column:
    return F.nullif(content(), F.lit(""))


def _nb_parameters(spark, folder, said: Column):
    _, (theta, _) = _bayes(spark, folder, said)
    return theta.select("label", "term", numbers.round2(F.col("theta")).alias("theta"))


def _nb_predictions(spark, folder, said: Column):
    packed, (theta, prior) = _bayes(spark, folder, said)
    return models.nb_predict_packed(*packed, theta, prior).select(F.col("key").alias("seq"), "label", numbers.round2(F.col("probability")).alias("probability"))


@query
def nb_parameters(spark, folder):
    """Of titles alone, as its SQL says; ``nb_document_parameters`` is over whole records."""
    return _nb_parameters(spark, folder, F.col("titulo"))


@query
def nb_predictions(spark, folder):
    """Of titles alone, as its SQL says; ``nb_document_predictions`` is over whole records."""
    return _nb_predictions(spark, folder, F.col("titulo"))


@query
def nb_document_parameters(spark, folder):
    return _nb_parameters(spark, folder, _document())


@query
def nb_document_predictions(spark, folder):
    return _nb_predictions(spark, folder, _document())


@query
def lda_topics(spark, folder):
    rows = texts(spark, folder).where("texto is not null")
    fitted = models.topic_fit(rows, F.col("texto"))
    return models.topic_words(fitted)


_ORDER = ["favorable", "neutral", "desfavorable"]


def _judged(spark, folder):
    tone = F.when(F.col("stress_score") >= 60, "desfavorable").when(F.col("stress_score") < 45, "favorable").otherwise("neutral")
    return news(spark, folder).where("tono_consolidado is not null and stress_score is not null").select(F.col("tono_consolidado").alias("label"), tone.alias("said"))


@query
def confusion_matrix(spark, folder):
    return metrics.confusion_matrix(_judged(spark, folder), "label", "said", _ORDER)


@query
def class_report(spark, folder):
    return metrics.class_report(_judged(spark, folder), "label", "said", _ORDER)


@query
def macro_report(spark, folder):
    return metrics.macro_report(_judged(spark, folder), "label", "said", _ORDER)


@query
def consolidated_tone(spark, folder):
    rows = table(spark, folder, "anotaciones").select("annotation_id", "id", F.lower(F.trim("sentimiento")).alias("primero"), F.when(F.col("duda") == 0, F.lower(F.trim("sentimiento"))).alias("segundo"))
    return models.consolidate(rows, "primero", "segundo").select("annotation_id", "id", "etiqueta_consolidada", "coincidencia_modelos", "tono_consolidado")


@query
def catalogue_violations(spark, folder):
    return catalogue.violations(table(spark, folder, "fuentes"), "fuente_id")


@query
def collected_violations(spark, folder):
    """Rules of the catalogue over the sources as collected records describe them, which break most."""
    rows = news(spark, folder).select("seq", F.col("fuente").alias("name"), "source_type", "department", "scope", "source_weight")
    return catalogue.violations(rows, "seq")


@query
def collection_report(spark, folder):
    return catalogue.collection_report(table(spark, folder, "fuentes"), news(spark, folder))


@query
def pipeline_gate(spark, folder):
    rows = news(spark, folder)
    return gates.pipeline_gate(rows, rows.where("length(titulo) >= 20"))


@query
def event_gate(spark, folder):
    clustered = lineage.store(events.cluster_news(_operational(spark, folder)))
    summary = lineage.store(events.summarize_events(clustered))
    return gates.event_gate(summary, clustered, _operational(spark, folder), payload=events.event_payload(summary, clustered))


def _daily(spark, folder):
    rows = news(spark, folder).drop("entidades", "indicadores", "stress_score")
    return pipeline.daily(rows.where("lote <= 200"), rows.where("lote > 200"), "2026-08-20T00:00:00Z", F.lit("2026-08-20 00:00:00+00:00").cast("timestamp"), policy=temporal.TemporalPolicy(recent_hours=720.0))


@query
def daily_pipeline(spark, folder):
    """The whole day's run over the corpus, near its newest records: rows of every output."""
    return _daily(spark, folder).counts()


@query
def daily_gates(spark, folder):
    return _daily(spark, folder).gates


@query
def daily_snapshot(spark, folder):
    return _daily(spark, folder).snapshot


@query
def service_events(spark, folder):
    return service.event_list(table(spark, folder, "eventos_operativos").distinct(), 50, 2).select("event_id", "unique_sources", "documents", "maximum_stress", "effective_at")


@query
def service_emerging(spark, folder):
    rows = dated(spark, folder)
    return service.emerging({"tema": ranking.rank_dimension(rows, "tema", hours=720.0), "indicadores": ranking.rank_dimension(rows, "indicadores", hours=720.0, labels=F.col("indicadores"))}).select("dimension", "name", "score")


@query
def service_analyze(spark, folder):
    return service.batch_summary(service.analyze(table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("texto"))))


@query
def service_batch_report(spark, folder):
    """Tones, topics, entities and indicators of the news as analysed; records without text are errors."""
    rows = news(spark, folder).withColumn("error", F.when(F.col("texto").isNull(), "sin texto"))
    return service.batch_report(rows.select("error", "tono_consolidado", "tema", "entidades", "indicadores"))


@query
def collected_top(spark, folder):
    return corpus.collected_order(news(spark, folder)).limit(50).select("seq", "fuente", "economic_score")


@query
def relevant_items(spark, folder):
    return corpus.relevant(texts(spark, folder)).select("seq", "economic_score")


@query
def labelled_texts(spark, folder):
    return pages.labelled_texts(table(spark, folder, "anotaciones"), F.col("titulo"), F.col("sentimiento"))


@query
def softmax_argmax(spark, folder):
    rows = table(spark, folder, "embeddings").withColumn("p", numbers.softmax(F.transform("embedding", lambda x: x.cast("double"))))
    return rows.select("vec_id", numbers.argmax(F.col("p")).alias("label"), numbers.round2(F.array_max("p") * 100).alias("confidence"))


@query
def date_columns(spark, folder):
    """Which column dates the corpus, and which if it had no collection times."""
    rows = news(spark, folder)
    found = [("all", temporal.date_column(rows)), ("collected", temporal.date_column(rows, ["tema", "collected_at"]))]
    return spark.createDataFrame(found, "of string, `column` string")


@query
def topic_inference(spark, folder):
    """Topics of all texts by the other model's parameters: rarer terms left out, 30 iterations."""
    rows = texts(spark, folder).where("texto is not null")
    return models.topic_fit_infer(rows, "seq", F.col("texto"), {0: "Primer tema"}, iterations=30, least=8, most_share=0.7, most_terms=12_000)


@query
def clean_top(spark, folder):
    return corpus.clean_order(corpus.clean_corpus(texts(spark, folder))).limit(50).select("seq", "score_recalculado")


@query
def merge_top(spark, folder):
    return corpus.merge_order(_merged(spark, folder)).limit(50).select("seq", "collected_at")


@query
def complete_rows(spark, folder):
    return corpus.drop_incomplete(news(spark, folder), ["titulo", "texto", "tema"]).select("seq")


@query
def point_lookup(spark, folder):
    return corpus.find(table(spark, folder, "anotaciones"), "annotation_id", "ann-000000010").select("annotation_id", "id", "sentimiento")


@query
def momentum_values(spark, folder):
    rows = table(spark, folder, "eventos_operativos").select("event_id", F.col("documents").alias("now"), F.col("unique_sources").alias("before")).distinct()
    n, b = F.col("now"), F.col("before")
    ratio = numbers.momentum_ratio(n, b)
    return rows.select("event_id", "now", "before", numbers.momentum(n, b).alias("momentum"), ratio.alias("ratio"), numbers.momentum_label(ratio).alias("label"))


@query
def number_coercion(spark, folder):
    rows = news(spark, folder)
    return rows.select("seq", numbers.number(F.col("fecha"), -1.0).alias("as_number"), numbers.number(F.col("source_weight"), 0.5, 0.0, 0.75).alias("weight"))


@query
def plain_texts(spark, folder):
    return news(spark, folder).select("seq", text.plain_text(F.col("titulo"), accents=False).alias("plain"))


@query
def absolute_urls(spark, folder):
    rows = news(spark, folder).where("url is not null and trim(url) <> ''")
    return rows.select("seq", text.absolute_url(F.lit("https://www.x.example/a/b"), F.col("url")).alias("absolute"))


@query
def label_shares(spark, folder):
    """Percentages of each sentiment among the annotations, by source."""
    rows = table(spark, folder, "anotaciones").where("fuente is not null")
    total = rows.groupBy("fuente").agg(F.count("*").alias("total"), F.count_if(F.lower(F.trim("sentimiento")) == "negativo").alias("negative"))
    return total.select("fuente", "total", numbers.percentage(F.col("negative"), F.col("total")).alias("negative_share"))
