"""Text models: naive Bayes by aggregates, topics by LDA, label consolidation, a place for other scorers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import LDA, LocalLDAModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, NGram, SQLTransformer, Tokenizer
from pyspark.mllib.common import _py2java
from pyspark.mllib.linalg import DenseMatrix as OldMatrix
from pyspark.mllib.linalg import Vectors as OldVectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quipu.functions import numbers, text
from quipu.operators import grams, topics
from quipu.operators.lineage import cut, store


#: Labels whose sums over the vocabulary (8 bytes a term) are held at once.
MOST_LABELS = 64


def terms(df: DataFrame, key: str, content: Column) -> DataFrame:
    """``(key, term, tf)`` of words and word pairs of cleaned text."""
    words = F.split(text.classic_text(content), " ")
    base = df.select(F.col(key).alias("key"), F.filter(words, lambda w: F.length(w) >= 2).alias("words"))
    pairs = F.when(F.size("words") > 1, F.zip_with(F.slice("words", F.lit(1), F.size("words") - 1), F.slice("words", F.lit(2), F.size("words") - 1), lambda a, b: F.concat_ws(" ", a, b)))
    each = base.select("key", F.explode(F.concat("words", F.coalesce(pairs, F.array().cast("array<string>")))).alias("term"))
    return each.groupBy("key", "term").agg(F.count("*").alias("tf"))


def vocabulary(tf: DataFrame, least: int = 2, most_share: float = 0.95, most_terms: int = 30_000) -> DataFrame:
    """``(term, idf)`` of terms in enough but not nearly all documents, the most frequent by uses."""
    total = tf.select("key").distinct().agg(F.count("*").alias("n"))
    known = tf.groupBy("term").agg(F.sum("tf").alias("uses"), F.count("*").alias("df")).crossJoin(F.broadcast(total))
    known = known.where((F.col("df") >= least) & (F.col("df") <= most_share * F.col("n")))
    return known.orderBy(F.desc("uses"), "term").limit(most_terms).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def weights(tf: DataFrame, known: DataFrame) -> DataFrame:
    """``(key, term, w)``: unit TF-IDF vectors over a vocabulary."""
    raw = tf.join(known, "term").withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    norm = raw.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "key").select("key", "term", (F.col("w") / F.col("norm")).alias("w"))


def nb_train(vectors: DataFrame, labels: DataFrame, alpha: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Multinomial naive Bayes: ``(label, term, theta)`` log probabilities and ``(label, prior, unseen)``; labels is (key, label)."""
    each = vectors.join(labels, "key")
    size = vectors.select("term").distinct().agg(F.count("*").alias("v"))
    whole = each.groupBy("label").agg(F.sum("w").alias("whole")).crossJoin(F.broadcast(size))
    counts = each.groupBy("label", "term").agg(F.sum("w").alias("c"))
    return _smoothed(counts, whole, labels, alpha)


def _smoothed(counts: DataFrame, whole: DataFrame, labels: DataFrame, alpha: float) -> tuple[DataFrame, DataFrame]:
    """Log probabilities of weights ``(label, term, c)``; whole is (label, whole, v)."""
    theta = counts.join(whole, "label").select("label", "term", F.log((F.col("c") + alpha) / (F.col("whole") + alpha * F.col("v"))).alias("theta"))
    n = labels.agg(F.count("*").alias("n"))
    prior = labels.groupBy("label").agg(F.count("*").alias("k")).crossJoin(F.broadcast(n))
    prior = prior.join(whole, "label", "left").select("label", F.log(F.col("k") / F.col("n")).alias("prior"), F.log(alpha / (F.coalesce("whole", F.lit(0.0)) + alpha * F.col("v"))).alias("unseen"))
    return theta, prior


def nb_predict(vectors: DataFrame, theta: DataFrame, prior: DataFrame) -> DataFrame:
    """``(key, label, probability)``; terms that training didn't see in any class don't count."""
    known = theta.select("term").distinct()
    each = vectors.join(known, "term", "left_semi")
    sums = each.groupBy("key").agg(F.sum("w").alias("mass"))
    seen = each.join(theta, "term").join(F.broadcast(prior.select("label", "unseen")), "label")
    seen = seen.groupBy("key", "label").agg(F.sum(F.col("w") * (F.col("theta") - F.col("unseen"))).alias("s"))
    keys = vectors.select("key").distinct().join(sums, "key", "left").crossJoin(F.broadcast(prior))
    score = F.col("prior") + F.coalesce("mass", F.lit(0.0)) * F.col("unseen") + F.coalesce("s", F.lit(0.0))
    scored = keys.join(seen, ["key", "label"], "left").select("key", "label", score.alias("score"))
    best = scored.groupBy("key").agg(F.max("score").alias("top"), F.max_by("label", F.struct("score", "label")).alias("label"), F.collect_list("score").alias("all"))
    return best.select("key", "label", (1 / F.aggregate("all", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))).alias("probability"))


def nb_pack(df: DataFrame, key: str, content: Column, label: str, least: int = 2, most_share: float = 0.95, most_terms: int = 30_000) -> tuple[DataFrame, list[str], list[float]]:
    """``(key, label, ids, tf)`` of rows that hold a term of the vocabulary, the vocabulary and its idf: what ``terms``,
    ``vocabulary`` and ``weights`` give, with one row a text, so no term of a text is shuffled."""
    rows = store(df.select(F.col(key).alias("key"), F.col(label).alias("label"), text.classic_text(content).alias("words")), "zstd")
    n = rows.where(F.col("words").rlike("[^ ]{2}")).count()
    known = grams.counted(rows).where((F.col("df") >= least) & (F.col("df") <= most_share * n)).orderBy(F.desc("uses"), "term").limit(most_terms)
    known = known.select("term", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf")).collect()
    words = [r["term"] for r in known]
    return store(grams.packed(rows, words, kept=("key", "label")).where("length(ids) > 0"), "zstd"), words, [r["idf"] for r in known]


def nb_train_packed(packed: DataFrame, words: list[str], idf: list[float], labels: DataFrame, alpha: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """As ``nb_train``, over packed rows: tasks hand on sums by label and term."""
    weight = np.array(idf, "float64")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}

        def told() -> Iterator[pd.DataFrame]:
            for label, c in sums.items():
                term = np.flatnonzero(c)
                yield pd.DataFrame({"label": label, "i": term, "c": c[term]})
            sums.clear()

        for part in parts:
            row, term, uses = grams.flat(part["ids"], part["tf"], len(weight))
            w = grams.unit(row, term, uses, weight, len(part))
            code, names = pd.factorize(part["label"])
            for k, label in enumerate(names):
                mine = code[row] == k
                sums[label] = sums.get(label, 0) + np.bincount(term[mine], w[mine], len(weight))
                if len(sums) > MOST_LABELS:
                    yield from told()
        yield from told()

    counts = cut(packed.select("label", "ids", "tf").mapInPandas(run, "label string, i int, c double").groupBy("label", "i").agg(F.sum("c").alias("c")))
    table = packed.sparkSession.createDataFrame(pd.DataFrame({"i": np.arange(len(words), dtype="int32"), "term": pd.Series(words, dtype="object")}), "i int, term string")
    counts = counts.join(F.broadcast(table), "i").select("label", "term", "c")
    whole = counts.groupBy("label").agg(F.sum("c").alias("whole")).withColumn("v", F.lit(len(words)))
    return _smoothed(counts, whole, labels, alpha)


def nb_predict_packed(packed: DataFrame, words: list[str], idf: list[float], theta: DataFrame, prior: DataFrame) -> DataFrame:
    """As ``nb_predict``, over packed rows, for a model of the same vocabulary and up to MOST_LABELS labels; of more, by joins."""
    known = sorted(prior.limit(MOST_LABELS + 1).collect(), key=lambda r: r["label"])
    weight = np.array(idf, "float64")
    if len(known) > MOST_LABELS:
        return nb_predict(_unpacked(packed, words, idf), theta, prior)
    place, at = {r["label"]: k for k, r in enumerate(known)}, {w: i for i, w in enumerate(words)}
    first, unseen = (np.array([r[c] for r in known], "float64") for c in ("prior", "unseen"))
    gain, seen, names = np.zeros((len(words), len(known))), np.zeros(len(words), bool), [r["label"] for r in known]
    for r in theta.toLocalIterator():
        gain[at[r["term"]], place[r["label"]]] = r["theta"] - unseen[place[r["label"]]]
        seen[at[r["term"]]] = True

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            row, term, uses = grams.flat(part["ids"], part["tf"], len(weight))
            w = grams.unit(row, term, uses, weight, len(part)) * seen[term]
            mass = np.bincount(row, w, len(part))
            score = first + mass[:, None] * unseen + np.column_stack([np.bincount(row, w * gain[term, k], len(part)) for k in range(len(names))])
            top = score.max(axis=1)
            best = len(names) - 1 - score[:, ::-1].argmax(axis=1)  # of equal scores the last name
            yield pd.DataFrame({"key": part["key"], "label": [names[k] for k in best], "probability": 1 / np.exp(score - top[:, None]).sum(axis=1)})

    return packed.select("key", "ids", "tf").mapInPandas(run, "key bigint, label string, probability double")


def _unpacked(packed: DataFrame, words: list[str], idf: list[float]) -> DataFrame:
    """``(key, term, w)`` of packed rows."""
    weight = np.array(idf, "float64")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            row, term, uses = grams.flat(part["ids"], part["tf"], len(weight))
            yield pd.DataFrame({"key": part["key"].to_numpy()[row], "term": [words[t] for t in term], "w": grams.unit(row, term, uses, weight, len(part))})

    return packed.select("key", "ids", "tf").mapInPandas(run, "key bigint, term string, w double")


def topic_pipeline(k: int = 6, iterations: int = 40, least: int = 2, most_share: float = 0.8, most_terms: int = 8000, seed: int = 42) -> Pipeline:
    """Topic model over ``(content)``: words and pairs, counted, LDA.

    EM reads every text in each iteration; online batches, also those of size 1.0, are drawn with replacement and leave some out.
    Its priors are those of the reference, ``1 / k``, plus the one by which EM's differ from variational Bayes.
    """
    return Pipeline(stages=[
        Tokenizer(inputCol="content", outputCol="words"), NGram(n=2, inputCol="words", outputCol="pairs"),
        SQLTransformer(statement="SELECT *, concat(words, pairs) AS terms FROM __THIS__"),
        CountVectorizer(inputCol="terms", outputCol="counts", minDF=least, maxDF=most_share, vocabSize=most_terms),
        LDA(featuresCol="counts", k=k, maxIter=iterations, seed=seed, optimizer="em", docConcentration=[1 + 1 / k], topicConcentration=1 + 1 / k, topicDistributionCol="topics"),
    ])


def topic_fit(df: DataFrame, content: Column, **options: int) -> PipelineModel:
    """Model over texts prepared for topics; rows of fewer than three words are left out of the fit."""
    return _topic_fit(store(df.select(text.topic_text(content).alias("words")), "zstd"), **options)


def _topic_fit(rows: DataFrame, **options: int) -> PipelineModel:
    """As ``topic_fit``, of prepared texts ``words``: MLlib's stages, fitted by counts and EM over packed texts."""
    *first, counter, lda = topic_pipeline(**options).getStages()
    rows = rows.select(F.xxhash64("words").alias("key"), "words").where(F.size(F.split("words", " ")) >= 3)
    known = grams.counted(rows).where((F.col("df") >= counter.getMinDF()) & (F.col("df") <= counter.getMaxDF() * rows.count()))
    words = [r["term"] for r in known.orderBy(F.desc("uses"), "term").limit(counter.getVocabSize()).collect()]
    if not words:
        raise ValueError("no term is in enough and not in too many texts")
    k, text_, topic = lda.getK(), lda.getDocConcentration()[0], lda.getTopicConcentration()
    table = topics.fit(grams.packed(rows, words), len(words), k, lda.getMaxIter(), text_, topic, lda.getSeed())
    counted = counter._copyValues(CountVectorizerModel.from_vocabulary(words, counter.getInputCol(), counter.getOutputCol()))
    spark = rows.sparkSession
    # MLlib has no way to name a model's table but this one, that of its own loader
    local = spark._jvm.org.apache.spark.mllib.clustering.LocalLDAModel(_py2java(spark.sparkContext, OldMatrix(len(words), k, table.ravel())), _py2java(spark.sparkContext, OldVectors.dense([text_] * k)), topic, 100.0)
    return PipelineModel([*first, counted, lda._copyValues(LocalLDAModel(spark._jvm.org.apache.spark.ml.clustering.LocalLDAModel(lda.uid, len(words), local, spark._jsparkSession)))])


def topic_infer(model: PipelineModel, df: DataFrame, key: str, content: Column, names: dict[int, str] = {}) -> DataFrame:
    """``(key, topic_id, tema, confianza_tema)``; a topic without name is called by its number."""
    return _topic_infer(model, df.select(F.col(key).alias("key"), text.topic_text(content).alias("words")), names)


def _topic_infer(model: PipelineModel, rows: DataFrame, names: dict[int, str] = {}) -> DataFrame:
    """As ``topic_infer``, of prepared texts ``(key, words)``."""
    counter, lda = model.stages[-2:]
    got = grams.packed(rows, counter.vocabulary)
    got = topics.infer(got, lda.topicsMatrix().toArray().T, lda.estimatedDocConcentration().toArray(), dict(got.dtypes)["key"]).withColumnRenamed("topics", "t")
    number = numbers.argmax(F.col("t"))
    name = F.concat(F.lit("Tema "), number.cast("string"))
    if names:
        name = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), number), name)
    return got.select("key", number.alias("topic_id"), name.alias("tema"), F.array_max("t").alias("confianza_tema"))


def topic_fit_infer(df: DataFrame, key: str, content: Column, names: dict[int, str] = {}, **options: int) -> DataFrame:
    """``topic_infer`` by the model that ``topic_fit`` makes of the same texts, which are prepared once."""
    rows = store(df.select(F.col(key).alias("key"), text.topic_text(content).alias("words")), "zstd")
    return _topic_infer(_topic_fit(rows, **options), rows, names)


def topic_words(model: PipelineModel, most: int = 15) -> DataFrame:
    """``(topic_id, rank, term, weight)`` of the heaviest terms of each topic."""
    words = model.stages[-2].vocabulary
    rows = model.stages[-1].describeTopics(most).select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "x"))
    spark = rows.sparkSession
    table = spark.createDataFrame(list(enumerate(words)), "i int, term string")
    return rows.join(F.broadcast(table), rows["x.termIndices"] == table["i"]).select(F.col("topic").alias("topic_id"), (F.col("rank") + 1).alias("rank"), "term", F.col("x.termWeights").alias("weight"))


def topic_report(model: PipelineModel, df: DataFrame, key: str, content: Column) -> DataFrame:
    """``(topic_id, documents, perplexity)``; the perplexity is the model's over all rows."""
    rows = model.transform(df.select(F.col(key).alias("key"), text.topic_text(content).alias("content")))
    bound = model.stages[-1].logPerplexity(rows)
    return topic_infer(model, df, key, content).groupBy("topic_id").agg(F.count("*").alias("documents")).withColumn("perplexity", F.exp(F.lit(bound)))


def save_pipeline(model: PipelineModel, path: str) -> None:
    """Store a fitted pipeline; an earlier one at the path is replaced."""
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_bayes(known: DataFrame, theta: DataFrame, prior: DataFrame, path: str) -> None:
    """Store vocabulary, term probabilities and class priors as tables."""
    for name, df in (("vocabulary", known), ("theta", theta), ("prior", prior)):
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def load_bayes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(vocabulary, theta, prior)`` as stored."""
    known, theta, prior = (spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in ("vocabulary", "theta", "prior"))
    return known, theta, prior


def score_with(df: DataFrame, content: str, load: Callable[[], Callable[[list[str]], list[tuple[str, float]]]]) -> DataFrame:
    """Add ``modelo_etiqueta, modelo_confianza`` of any scorer; ``load`` runs once per task and gives a function over batches."""
    schema = StructType([StructField("label", StringType()), StructField("confidence", DoubleType())])

    @F.pandas_udf(schema)
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        run = load()
        for s in parts:
            yield pd.DataFrame(run(s.fillna("").tolist()), columns=["label", "confidence"])

    return df.withColumn("__s", score(F.col(content))).withColumns({"modelo_etiqueta": F.col("__s.label"), "modelo_confianza": F.col("__s.confidence")}).drop("__s")


def consolidate(df: DataFrame, first: str, second: str) -> DataFrame:
    """Add the consolidated label (``first`` if there is one), which model it is from, whether both agree, and its tone.

    Agreement is null where one is missing, the tone null for unknown labels.
    """
    label = F.coalesce(F.col(first), F.col(second))
    tone = numbers.lookup(label, numbers.TONES, F.lit(None).cast("string"))
    source = F.when(F.col(first).isNotNull(), first).when(F.col(second).isNotNull(), second)
    return df.withColumns({"etiqueta_consolidada": label, "modelo_seleccionado": source, "coincidencia_modelos": F.col(first) == F.col(second), "tono_consolidado": tone})
