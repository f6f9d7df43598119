"""Sizes, label distributions, noise, weights and chance levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPLITS = ("train", "test", "dev")
Z_975 = 1.959963984540054  # fixed value: the 0.975 quantile of the normal distribution


def sizes(df: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Rows per dataset and split, and the total per dataset and over all datasets (dataset null)."""
    counts = [F.count_if(F.col("split") == s).alias(s) for s in SPLITS]
    return df.rollup(dataset).agg(*counts, F.count(F.lit(1)).alias("total"))


def sizes_and_longest(df: DataFrame, dataset: str = "dataset", tokens: str = "token_counts") -> DataFrame:
    """Rows per split and the largest token count over all splits."""
    counts = [F.count_if(F.col("split") == s).alias(s) for s in SPLITS]
    return df.groupBy(dataset).agg(*counts, F.max(tokens).alias("max_tokens"))


def label_shares(df: DataFrame, label: str = "label") -> DataFrame:
    """Share of every label in every split; labels absent from a split have 0 there."""
    counts = df.groupBy(label).agg(*[F.count_if(F.col("split") == s).alias(s) for s in SPLITS])
    total = W.partitionBy(F.lit(1))
    return counts.select(
        label,
        *[F.coalesce(F.col(s) / F.nullif(F.sum(s).over(total), F.lit(0)), F.lit(0.0)).alias(s) for s in SPLITS],
    )


def chance_f1(shares: DataFrame, label: str = "label") -> DataFrame:
    """Expected macro F1 of uniform guessing, and macro F1 of always naming the largest train label."""
    k = F.count(F.lit(1)).over(W.partitionBy(F.lit(1)))
    wide = shares.withColumn("__k", k)
    # Ties for the largest train label go to the smallest name.
    wide = wide.withColumn("__rank", F.rank().over(W.partitionBy(F.lit(1)).orderBy(label)))
    top = F.max_by("test", F.struct(F.col("train"), -F.col("__rank")))
    d = F.col("test")
    out = wide.agg(
        (F.sum(2 * d / (d * F.col("__k") + 1)) / F.max("__k")).alias("uniform"), top.alias("d"), F.max("__k").alias("k")
    )
    return out.select("uniform", (2 * F.col("d") / (1 + F.col("d")) / F.col("k")).alias("majority"))


def imbalance(df: DataFrame, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Largest over smallest class count."""
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg((F.max("n") / F.min("n")).alias("imbalance"), F.count(F.lit(1)).alias("n_labels"))


def imbalance_multilabel(df: DataFrame, labels: str = "label") -> DataFrame:
    """As :func:`imbalance`, over exploded label lists (an empty list is a null class)."""
    return imbalance(df.select(F.explode_outer(labels).alias("label")))


def noise_report(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Percent of rows not English, not clean, noise, and word salad."""
    percent = lambda cond: F.bround(F.avg(F.when(cond, 1.0).otherwise(0.0)) * 100, 2)
    return df.groupBy(*by).agg(
        percent(~F.col("language").eqNullSafe(F.lit("en"))).alias("not_english"),
        percent(~F.col("gibberish").eqNullSafe(F.lit("clean"))).alias("not_clean"),
        percent(F.col("gibberish") == "noise").alias("noise"),
        percent(F.col("gibberish") == "word salad").alias("word_salad"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Count and share per value."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("__total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select(column, "n", (F.col("n") / F.col("__total")).alias("share"))


def labels_by_year(df: DataFrame, date: str = "Date", label: str = "label") -> DataFrame:
    """Share of every label in a year, and the running sum of the shares in label order.

    Absent (year, label) cells do not appear; the running sum over the others is the same.
    """
    counts = df.groupBy(F.year(date).alias("year"), label).agg(F.count(F.lit(1)).alias("n"))
    year = W.partitionBy("year")
    shares = counts.withColumn("share", F.col("n") / F.sum("n").over(year))
    upto = year.orderBy(label).rowsBetween(W.unboundedPreceding, W.currentRow)
    return shares.withColumn("cumulative", F.sum("share").over(upto))


def peak_years(shares: DataFrame, label: str = "label") -> DataFrame:
    """The year in which a label has its largest share (earliest on a tie), and the middle of its band there."""
    best = F.struct("share", (-F.col("year")).alias("y"))
    out = shares.groupBy(label).agg(F.max_by(F.struct("year", "share", "cumulative"), best).alias("p"))
    return out.select(label, "p.year", "p.share", (F.col("p.cumulative") - F.col("p.share") / 2).alias("middle"))


def page_flags(df: DataFrame, keys: Sequence[str], query: str = "query") -> DataFrame:
    """1 where any row of the page has a query."""
    return df.groupBy(*keys).agg(F.bool_or(F.col(query).isNotNull()).cast("int").alias("label"))


def page_detection(df: DataFrame, keys: Sequence[str], y: str = "y", more_than: int = 1) -> DataFrame:
    """1 where more than ``more_than`` sentences of the page are positive."""
    return df.groupBy(*keys).agg((F.sum(y) > more_than).cast("int").alias("detected"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight n / (K n_k), and the same scaled to sum 1."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    all_ = W.partitionBy(F.lit(1))
    weighted = counts.withColumn(
        "weight", F.sum("n").over(all_) / (F.count(F.lit(1)).over(all_) * F.col("n"))
    )
    return weighted.withColumn("normalised", F.col("weight") / F.sum("weight").over(all_))


def multilabel_weights(df: DataFrame, labels: str = "label", classes: Sequence[str] | None = None) -> DataFrame:
    """Inverse frequency over the smallest non-zero inverse frequency; classes never seen have 0."""
    counts = df.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    weights = counts.withColumn("weight", F.max("n").over(W.partitionBy(F.lit(1))) / F.col("n"))
    if classes is None:
        return weights
    known = df.sparkSession.createDataFrame([(c,) for c in classes], "label string")
    return known.join(weights, "label", "left").fillna(0, ["n", "weight"])


def most_frequent(df: DataFrame, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Most frequent label, smallest on a tie. Counted first: ``mode`` alone would hold all values of a group."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col(label).alias("v")))
    return counts.groupBy(*by).agg(best.alias("b")).select(*by, F.col("b.v").alias("mode"))


def mean_interval(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, sample standard deviation, standard error and 95 % normal interval."""
    stats = df.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n")
    )
    sem = F.col("std") / F.sqrt("n")
    return stats.select(
        *by, "mean", "std", "n", sem.alias("sem"), (F.col("mean") - Z_975 * sem).alias("lower"),
        (F.col("mean") + Z_975 * sem).alias("upper"),
    )


def token_usage(responses: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Calls and tokens of response records."""
    use = "response.body.usage."
    return responses.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"), F.sum(use + "prompt_tokens").alias("prompt_tokens"),
        F.sum(use + "completion_tokens").alias("completion_tokens"), F.sum(use + "total_tokens").alias("total_tokens"),
    )
