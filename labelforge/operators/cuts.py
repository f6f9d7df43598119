"""Exact rank cuts inside groups, without sorting a group in one task.

"The first k rows of every label in shuffled order" is what all splits and samples need. Ranking with
``row_number() over (partition by label)`` sorts a label in one task, and one label may hold a third of the
table. Here the rows are counted per (group, bucket), where a bucket is a prefix of the uniform hash (after an
optional leading order column such as a date). Running totals over these counts name the one bucket per cut in
which rank k lies; only its rows are ranked, and the row found there becomes a threshold. Rows are then compared
with the thresholds of their group: no row of the big table is shuffled, and the cut is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelforge.functions.hashing import DEFAULT_SEED, hash_hex
from labelforge.operators.attach import attach_small, null_safe_join, small_table

Ranks = Mapping[str, Callable[[Column], Column]]


def order_key(key: str, lead: str | None = None, seed: int | str = DEFAULT_SEED) -> Column:
    """(lead, hash, key): a total order when ``key`` is unique."""
    parts = [F.col(lead).alias("lead")] if lead else []
    return F.struct(*parts, hash_hex(key, seed=seed).alias("h"), F.col(key).alias("k"))


def group_counts(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """Rows per group; combined map-side, so that a hot group costs one row per task."""
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))


def rank_thresholds(
    df: DataFrame,
    group: Sequence[str],
    key: str,
    ranks: Ranks | DataFrame,
    lead: str | None = None,
    seed: int | str = DEFAULT_SEED,
    prefix: int | None = None,
) -> DataFrame:
    """One row per group with, for every named rank k, the order key of its k-th row (null for k = 0).

    ``ranks`` maps names to functions of the group size, or is a small table with ``group`` and one bigint
    column per name.
    """
    prefix = prefix or (2 if lead else 4)
    slim = df.select(*group, order_key(key, lead, seed).alias("__o"))
    bucket = [F.col("__o.lead").alias("__lead")] if lead else []
    bucket.append(F.substring(F.col("__o.h"), 1, prefix).alias("__p"))
    slim = slim.select("*", *bucket)
    bucket_cols = (["__lead"] if lead else []) + ["__p"]

    hist = slim.groupBy(*group, *bucket_cols).agg(F.count(F.lit(1)).alias("n"))
    inside = W.partitionBy(*group)
    upto = inside.orderBy(*bucket_cols).rowsBetween(W.unboundedPreceding, W.currentRow)
    cum = hist.withColumn("hi", F.sum("n").over(upto))
    if isinstance(ranks, DataFrame):
        names = [c for c in ranks.columns if c not in group]
        local = small_table(ranks)
        cum = null_safe_join(cum, ranks if local is None else F.broadcast(local), group, "inner")
    else:
        names = list(ranks)
        cum = cum.withColumn("__n", F.sum("n").over(inside))
        for name, rank_of in ranks.items():
            cum = cum.withColumn(name, rank_of(F.col("__n")).cast("bigint"))
    cuts = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("k")) for n in names])).alias("c")
    boundary = (
        cum.select(*group, *bucket_cols, "n", "hi", cuts)
        .filter((F.col("c.k") > F.col("hi") - F.col("n")) & (F.col("c.k") <= F.col("hi")))
        .select(*group, *bucket_cols, F.col("c.name").alias("__name"), (F.col("c.k") - F.col("hi") + F.col("n")).alias("__r"))
    )
    local = small_table(boundary)
    boundary = F.broadcast(local) if local is not None else boundary
    ranked = null_safe_join(slim, boundary, [*group, *bucket_cols], "inner").withColumn(
        "__rn", F.row_number().over(W.partitionBy(*group, "__name").orderBy("__o"))
    )
    hits = ranked.filter(F.col("__rn") == F.col("__r"))
    return hits.groupBy(*group).agg(
        *[F.max(F.when(F.col("__name") == n, F.col("__o"))).alias(n) for n in names]
    )


def with_cuts(
    df: DataFrame,
    group: Sequence[str],
    key: str,
    ranks: Ranks | DataFrame,
    lead: str | None = None,
    seed: int | str = DEFAULT_SEED,
) -> tuple[DataFrame, list[str]]:
    """``df`` with one boolean column ``__le_<name>`` per cut: is the row's rank in its group at most k?"""
    if not group:
        out, flags = with_cuts(df.withColumn("__all", F.lit(1)), ["__all"], key, ranks, lead, seed)
        return out.drop("__all"), flags
    names = [c for c in ranks.columns if c not in group] if isinstance(ranks, DataFrame) else list(ranks)
    thresholds = rank_thresholds(df, group, key, ranks, lead, seed)
    joined = attach_small(df, thresholds, group)
    order = order_key(key, lead, seed)
    flags = [f"__le_{n}" for n in names]
    for name, flag in zip(names, flags):
        joined = joined.withColumn(flag, F.coalesce(order <= F.col(name), F.lit(False)))
    return joined.drop(*names), flags


def take_ranked(
    df: DataFrame,
    group: Sequence[str],
    key: str,
    k: Callable[[Column], Column] | DataFrame,
    lead: str | None = None,
    seed: int | str = DEFAULT_SEED,
) -> DataFrame:
    """The first k rows of every group in hash order."""
    ranks = k if isinstance(k, DataFrame) else {"__cut": k}
    out, flags = with_cuts(df, group, key, ranks, lead, seed)
    return out.filter(F.col(flags[0])).drop(*flags)
