"""Mean reciprocal rank of the gold query among all candidate queries, and its baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelforge.functions.hashing import DEFAULT_SEED, hash_int
from labelforge.operators.attach import attach_small, with_catalogue
from labelforge.operators.metrics import CONFIDENCE, N_DRAWS, _interval, drawn_counts
from labelforge.operators.running import running_totals


def score_grid(examples: DataFrame, queries: DataFrame) -> DataFrame:
    """Every example with every candidate query: a Cartesian product by meaning (see :func:`with_catalogue`)."""
    return with_catalogue(examples, queries.select(F.col("query").alias("candidate")), "candidate")


def gold_ranks(scored: DataFrame, key: str, gold: str = "query") -> DataFrame:
    """(key, rank) of the gold query by (label desc, score desc, name), the score of a label-0 answer flipped.

    The rank is the number of candidates that are at least as good, counted while they are scanned: the gold query's place
    is found first, one row per example, and meets the candidates where they are. Counts are added up before the shuffle.
    """
    score = F.when(F.col("label") == 0, 1 - F.col("score")).otherwise(F.col("score"))
    place = F.struct((-F.col("label")).alias("l"), (-score).alias("s"), F.col("candidate").alias("c"))
    golds = scored.filter(F.col("candidate") == F.col(gold)).groupBy(key).agg(F.max(place).alias("gold_place")).filter("gold_place is not null")
    met = attach_small(scored.select(key, place.alias("place")), golds, [key], "inner")
    return met.groupBy(key).agg(F.count_if(F.col("place") <= F.col("gold_place")).cast("bigint").alias("rank"))


def mean_reciprocal_rank(ranks: DataFrame) -> DataFrame:
    """Mean of 1/rank over positive ranks."""
    return ranks.agg(
        F.avg(F.when(F.col("rank") > 0, 1 / F.col("rank"))).alias("mrr"), F.count_if(F.col("rank") > 0).alias("n")
    )


def frequency_ranks(train: DataFrame, test: DataFrame, key: str, query: str = "query") -> DataFrame:
    """(key, rank): place of the row's query in the train frequency order; queries train never saw have no row."""
    counts = train.groupBy(query).agg(F.count(F.lit(1)).alias("n"))
    order = running_totals(counts.withColumn("__one", F.lit(1)), [F.desc("n"), query], rank="__one")
    return attach_small(test, order.select(query, "rank"), [query], "inner").select(key, "rank")


def random_ranks(test: DataFrame, key: str, query: str = "query", seed: int | str = DEFAULT_SEED) -> DataFrame:
    """(key, rank): uniform over 1..number of distinct queries."""
    k = test.agg(F.count_distinct(query).alias("k"))
    return test.crossJoin(F.broadcast(k)).select(key, (F.pmod(hash_int(key, seed=seed), F.col("k")) + 1).alias("rank"))


def bootstrap_mrr(
    ranks: DataFrame, draws: int = N_DRAWS, confidence: float = CONFIDENCE, seed: int | str = DEFAULT_SEED,
) -> DataFrame:
    """Percentile interval of the mean reciprocal rank, from the histogram of ranks (see ``bootstrap_f1``)."""
    histogram = ranks.groupBy("rank").agg(F.count(F.lit(1)).alias("n"))
    joined = drawn_counts(histogram, ["rank"], draws, seed).filter("rank > 0")
    scores = joined.groupBy("draw").agg((F.sum(F.col("n") / F.col("rank")) / F.sum("n")).alias("mrr"))
    return _interval(scores, "mrr", confidence)
