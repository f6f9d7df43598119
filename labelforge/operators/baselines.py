"""Bag-of-words baselines, TF-IDF weights as a relation and as MLlib vectors, dummies, and training dynamics."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, Normalizer, RegexTokenizer
from pyspark.ml.linalg import Vectors
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelforge.functions.arrays import argmax, softmax
from labelforge.functions.hashing import DEFAULT_SEED, hash_int
from labelforge.functions.text import WORD_PATTERN, word_tokens
from labelforge.operators.attach import attach_small, small_table, with_catalogue
from labelforge.operators.features import Space, feature_column, fit_space, margin_column, width
from labelforge.operators.linear import Blocks, Targets, fit_linear, pack
from labelforge.operators.running import running_totals
from labelforge.operators.stats import class_weights, most_frequent
from labelforge.session import cut_lineage

MAX_ITER = 1000  # fixed value: iteration cap of the logistic regression
TOLERANCE = 1e-4
#: An iteration has a task a core, but tasks of as many rows at least and not many more bytes than these.
ROWS_A_TASK, BYTES_A_TASK = 2048, 1 << 26
#: Letters of texts, and rows of terms, of a task of the weights' relation, about: the number of tasks grows with the table.
LETTERS_A_TASK, TERMS_A_TASK = 1 << 23, 1 << 21
VOCABULARY = (1 << 31) - 1  # no cut


def tfidf_weights(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term, tf, df, weight): smoothed idf ln((1+n)/(1+df))+1, rows scaled to length 1."""
    # texts are dealt out by key once, so that their words are counted where they are, written once, and weighted there
    n, letters = df.agg(F.count(F.lit(1)), F.sum(F.length(text))).first()
    # a word and the sign after it are three letters at least
    parts = max(math.ceil((letters or 0) / min(LETTERS_A_TASK, 3 * TERMS_A_TASK)), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    texts = df.select(key, text, F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("__part")).repartitionById(parts, "__part")
    words = texts.select("__part", key, F.explode(word_tokens(text)).alias("term"))
    tf = cut_lineage(words.groupBy("__part", key, "term").agg(F.count(F.lit(1)).alias("tf")), placed=True)
    idf = F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1
    weighted = _with_frequency(tf, parts, n, tf.count() / TERMS_A_TASK).withColumn("w", F.col("tf") * idf)
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(key, "__part")))
    return weighted.select(key, "term", "tf", "df", (F.col("w") / length).alias("weight"))


def _dealt(df: DataFrame, tasks: float, key: str) -> DataFrame:
    """Rows dealt out by ``key`` to ``tasks`` partitions, or the session's number if that is more: a task holds no more of a larger table."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(math.ceil(tasks), key) if tasks > usual else df.repartition(key) if tasks <= 1 else df.repartition(usual, key)


def _with_frequency(tf: DataFrame, parts: int, n: int, tasks: float, share: float = 1e-3) -> DataFrame:
    """Add the document frequencies to term rows, which stay in their ``parts`` partitions, dealt out by ``__part``.

    A term is counted in each part first, so that even one in all documents has no more than ``parts`` rows when its counts
    meet. Only the sums go back, and a term without one is in one document. Terms in more than ``share`` of the documents are
    at most (terms per document) / share, whatever the corpus: they are broadcast after a check.
    """
    here = _dealt(tf.groupBy("__part", "term").agg(F.count(F.lit(1)).alias("here")), tasks, "term")
    sums = cut_lineage(here.select("__part", "term", F.sum("here").over(W.partitionBy("term")).alias("df")).filter("df > 1"))
    often = F.col("df") > n * share
    common = small_table(sums.filter(often).select("term", F.col("df").alias("often")).distinct())
    back = (sums if common is None else sums.filter(~often)).repartitionById(parts, "__part")
    found = tf.join(back, ["term", "__part"], "left")
    if common is not None:
        found = found.join(F.broadcast(common), "term", "left").withColumn("df", F.coalesce("df", "often")).drop("often")
    return found.withColumn("df", F.coalesce("df", F.lit(1).cast("bigint")))


def fit_tfidf(df: DataFrame, text: str, out: str, vocabulary: int = VOCABULARY) -> PipelineModel:
    """The same weights as a vector column. What reaches the driver is the vocabulary of the train table, which ``truncate``
    bounds; ``vocabulary`` cuts it to the most frequent terms if a caller asks for it."""
    raw, words, counts, scaled = f"{out}_raw", f"{out}_words", f"{out}_counts", f"{out}_scaled"
    tokenizer = RegexTokenizer(inputCol=raw, outputCol=words, pattern=WORD_PATTERN, gaps=False)
    tokens = tokenizer.transform(with_text(df, text, raw))
    counter = CountVectorizer(inputCol=words, outputCol=counts, vocabSize=vocabulary).fit(tokens)
    idf = IDF(inputCol=counts, outputCol=scaled).fit(counter.transform(tokens)).idf.toArray() + 1.0
    return PipelineModel([
        tokenizer, counter, ElementwiseProduct(inputCol=counts, outputCol=scaled, scalingVec=Vectors.dense(idf)),
        Normalizer(inputCol=scaled, outputCol=out, p=2.0),
    ])


def with_text(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the text the tokenizer works on; null is empty."""
    return df.withColumn(name, F.coalesce(text, F.lit("")))


@dataclass
class Baseline:
    """A fitted baseline: features, weights and label names."""

    spaces: list[Space]
    weights: np.ndarray
    labels: list[str]

    def predict(self, df: DataFrame, name: str = "y_pred") -> DataFrame:
        """Add the predicted label as text; of equally likely ones the first."""
        kept = [F.col(f"`{c}`") for c in df.columns]
        scored = df.select(*kept, margin_column(df.sparkSession, self.spaces, self.weights).alias("__m"))
        return scored.select(*kept, F.get(F.array(*map(F.lit, self.labels)), argmax("__m")).alias(name))


def fit_baseline(
    train: DataFrame, label: str = "label", text: str = "text", query: str | None = None, query_kind: str = "tfidf",
    max_iter: int = MAX_ITER, tolerance: float = TOLERANCE,
) -> Baseline:
    """Balanced multinomial logistic regression on the text, with an optional query.

    ``query_kind``: ``tfidf`` (own vocabulary) or ``onehot`` (a query that no train row has counts for nothing). Rows without
    a label are not learned from. The penalty equals that of an unscaled loss with C = 1: balanced weights sum to n, so that
    the strength is 1/n.
    """
    named = train.withColumn("__y", F.col(label).cast("string")).filter("__y is not null")
    named = named.select("__y", *[F.col(c) for c in dict.fromkeys([text, *([query] if query else [])])]).persist(StorageLevel.MEMORY_AND_DISK)
    counts = class_weights(named, "__y").select("__y", "weight").orderBy("__y").collect()  # one row per class
    labels, rows = [r["__y"] for r in counts], named.count()
    spaces = [fit_space(named, text, rows)]
    if query is not None:
        spaces.append(fit_space(named, query, rows, whole=query_kind == "onehot"))
    place = F.array_position(F.array(*map(F.lit, labels)), F.col("__y")) - 1 if labels else F.lit(0)
    balanced = np.array([float(r["weight"]) for r in counts])
    weights = _fit(named, spaces, F.array(place.cast("int")), Targets(len(labels), True, balanced, balanced), rows, max_iter, tolerance)
    return Baseline(spaces, weights, labels)


def _fit(named: DataFrame, spaces: Sequence[Space], y: Column, targets: Targets, rows: int, max_iter: int, tolerance: float) -> np.ndarray:
    """Weights of the persisted rows, which are let go."""
    x, alone = feature_column(named.sparkSession, spaces), np.concatenate([s.alone for s in spaces])
    blocks = pack(named.select(y.alias("y"), x.alias("x")).select("x.i", "x.v", "y"), targets.classes, alone)
    named.unpersist()
    try:
        return fit_linear(_few_tasks(blocks, rows), width(spaces), targets, rows, 1.0 / max(rows, 1), max_iter, tolerance)
    finally:
        blocks.drop()


def _few_tasks(blocks: Blocks, rows: int) -> Blocks:
    """The blocks in few tasks: an iteration over few rows is mostly the start of its tasks, and each sends a gradient."""
    cores = blocks.spark.sparkContext.defaultParallelism
    return blocks.deal(max(1, min(rows // ROWS_A_TASK, max(cores, blocks.held // BYTES_A_TASK))))


def predict_multilabel(
    train: DataFrame, test: DataFrame, key: str, labels: Sequence[str] | None = None, label: str = "label",
    text: str = "text", max_iter: int = MAX_ITER, tolerance: float = TOLERANCE,
) -> DataFrame:
    """(key, y_pred list): balanced binary regressions of all train labels over shared TF-IDF features, in one fit.

    One matrix of weights holds all labels, and one pass over the rows gives all their gradients; the objectives are those of
    single fits, added up. A label that all or no rows have is answered without a fit. Repeated rows of ``test`` are answered
    one by one; a null list has no labels.
    """
    lists = train.select(text, F.coalesce(F.array_distinct(label), F.array().cast("array<string>")).alias("__l")).persist(StorageLevel.MEMORY_AND_DISK)
    names = lists.select(F.explode("__l").alias("name")) if labels is None else train.sparkSession.createDataFrame([(x,) for x in labels], "name string")
    seen = lists.select(F.explode("__l").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("ones"))
    # the vocabulary of labels, which a row of the weights holds anyway
    known = names.distinct().join(seen, "name", "left").fillna(0, ["ones"]).orderBy("name").collect()
    n = lists.count()
    always = F.array(*[F.lit(r["name"]) for r in known if r["ones"] == n]).cast("array<string>")
    fitted = {r["name"]: r["ones"] for r in known if 0 < r["ones"] < n}
    if not fitted:
        lists.unpersist()
        return test.select(key, always.alias("y_pred"))
    every = F.array(*map(F.lit, fitted)).cast("array<string>")
    place = F.transform(F.array_intersect("__l", every), lambda x: (F.array_position(every, x) - 1).cast("int"))
    ones = np.array(list(fitted.values()), float)
    spaces = [fit_space(lists, text, n)]
    weights = _fit(lists, spaces, place, Targets(len(fitted), False, n / (2 * ones), n / (2 * (n - ones))), n, max_iter, tolerance)
    scored = test.select(key, margin_column(test.sparkSession, spaces, weights).alias("__m"))
    hits = F.transform(F.filter(F.arrays_zip(every.alias("name"), F.col("__m").alias("m")), lambda x: x["m"] > 0), lambda x: x["name"])
    return scored.select(key, F.array_sort(F.concat(hits, always)).alias("y_pred"))


def majority_multilabel_dummy(train: DataFrame, test: DataFrame, label: str = "label") -> DataFrame:
    """Add ``y_pred``: the labels that more than half of the train rows have, for every test row. Null lists are empty."""
    half = train.agg((F.count(F.lit(1)) / 2).alias("__half"))
    counts = train.select(F.explode(F.array_distinct(label)).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    often = counts.crossJoin(F.broadcast(half)).filter("n > __half")
    # a row has few labels on average, and so few labels are in more than half of the rows
    names = often.agg(F.array_sort(F.collect_list("name")).alias("y_pred"))
    return test.crossJoin(F.broadcast(names))


def uniform_multilabel_dummy(train: DataFrame, test: DataFrame, key: str, label: str = "label", seed: int | str = DEFAULT_SEED) -> DataFrame:
    """(key, y_pred list): each train label by a hash of key and label, with probability one half; labels that all or no train
    rows have keep to that."""
    counts = train.select(F.explode(F.array_distinct(label)).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    total = train.agg(F.count(F.lit(1)).alias("__total"))  # one row
    known = cut_lineage(counts.crossJoin(F.broadcast(total)).select("name", (F.col("n") == F.col("__total")).alias("always")))
    drawn = with_catalogue(test.select(key), known.select("name"), "name")
    drawn = attach_small(drawn, known, ["name"], "inner").filter(F.col("always") | (hash_int(key, "name", seed=seed) % 2 == 0))
    lists = drawn.groupBy(key).agg(F.array_sort(F.collect_list("name")).alias("y_pred"))  # at most the label vocabulary
    return test.select(key).join(lists, key, "left").select(key, F.coalesce("y_pred", F.array().cast("array<string>")).alias("y_pred"))


def majority_dummy(train: DataFrame, test: DataFrame, label: str = "label") -> DataFrame:
    """Always the most frequent train label."""
    return test.crossJoin(F.broadcast(most_frequent(train, label).withColumnRenamed("mode", "y_pred")))


def uniform_dummy(train: DataFrame, test: DataFrame, key: str, label: str = "label", seed: int | str = DEFAULT_SEED) -> DataFrame:
    """A train label by hash, all alike likely."""
    known = train.select(F.col(label).alias("y_pred")).filter(F.col("y_pred").isNotNull()).distinct()
    known = cut_lineage(running_totals(known.withColumn("__one", F.lit(1)), ["y_pred"], __place="__one")).drop("__one")
    drawn = test.withColumn("__place", F.pmod(hash_int(key, seed=seed), F.lit(max(1, known.count()))) + 1)
    return attach_small(drawn, known, ["__place"]).drop("__place")


def cartography(epochs: DataFrame, key: str, logits: str = "logits", label: str = "label") -> DataFrame:
    """Per example over its epochs: mean and population deviation of the gold probability, share of right answers."""
    p = F.get(softmax(logits), F.col(label))
    right = (argmax(logits) == F.col(label)).cast("double")
    return epochs.groupBy(key).agg(
        F.avg(p).alias("mean_probs"), F.stddev_pop(p).alias("variability"), F.avg(right).alias("correctness")
    )
