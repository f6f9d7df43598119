"""Joining a big table with a small one whose size is checked, not assumed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_SMALL_ROWS = 200_000
MAX_SMALL_BYTES = 64 << 20
SALTS = 64
#: Keys that a join spreads, at most, and the share of the rows from which a key is spread.
HEAVY_KEYS, HEAVY_SHARE = 1000, 1e-3


def small_table(df: DataFrame, max_rows: int = MAX_SMALL_ROWS) -> DataFrame | None:
    """``df`` as a local relation when it has at most ``max_rows`` rows, else ``None``.

    Only ``max_rows + 1`` rows can ever reach the driver. A local relation is not computed again by the plans
    that use it, and its size is known to the optimizer.
    """
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows or table.nbytes > MAX_SMALL_BYTES:
        return None
    return df.sparkSession.createDataFrame(table, schema=df.schema)


def attach_small(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "left",
    max_rows: int = MAX_SMALL_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Join ``small`` (one row per ``on`` key, null keys match null keys) to ``big``.

    Below the bound this is a broadcast join: ``big`` is not shuffled. Above it, see :func:`spread_join`.
    """
    local = small_table(small, max_rows)
    if local is not None:
        return null_safe_join(big, F.broadcast(local), on, how)
    return spread_join(big, small, on, how, salts)


def spread_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left", salts: int = SALTS) -> DataFrame:
    """Shuffle join of ``small`` (few rows per ``on`` key) to ``big``, whose hot keys are spread over ``salts`` tasks.

    A sketch of bounded size over ``big`` names its most frequent keys in a first pass; only their rows of ``small`` are
    copied. A key that the sketch misses or overrates costs balance, never rows.
    """
    heavy = frequent_keys(big, on)
    if not heavy:
        return null_safe_join(big, small, on, how)
    hot = lambda df: F.xxhash64(*[F.col(c) for c in on]).isin(heavy)
    row = F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(salts)).cast("int")
    spread = big.withColumn("__salt", F.when(hot(big), row).otherwise(0))
    last = F.when(hot(small), salts - 1).otherwise(0)
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), last)))
    return null_safe_join(spread, copies, [*on, "__salt"], how).drop("__salt")


def frequent_keys(df: DataFrame, on: Sequence[str], most: int = HEAVY_KEYS, share: float = HEAVY_SHARE) -> list[int]:
    """Hashes of the keys that make up at least ``share`` of the rows, ``most`` of them at most, by a sketch."""
    keys = df.select(F.xxhash64(*[F.col(c) for c in on]).alias("h"))
    found = keys.agg(F.expr(f"approx_top_k(h, {most}, {10 * most})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    return [k["item"] for k in found["top"] if k["count"] >= max(2, share * found["n"])]


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match null keys; key columns are kept once, from the left side."""
    renamed = right.select(
        *[F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in right.columns]
    )
    cond: Column | None = None
    for c in on:
        term = F.col(c).eqNullSafe(F.col(f"__r_{c}"))
        cond = term if cond is None else cond & term
    if cond is None:
        cond = F.lit(True)
    joined = left.join(renamed, cond, how)
    if how in ("full", "outer", "full_outer", "right"):
        for c in on:
            joined = joined.withColumn(c, F.coalesce(F.col(c), F.col(f"__r_{c}")))
    return joined.drop(*[f"__r_{c}" for c in on])


def with_catalogue(df: DataFrame, values: DataFrame, name: str, together: int = MAX_SMALL_ROWS, salts: int = SALTS) -> DataFrame:
    """Every row of ``df`` with every distinct value of the one column ``name`` of ``values``: a Cartesian product by meaning.

    Up to ``together`` values are one array, whose size is checked and which is exploded in place: ``df`` is not shuffled. More
    of them are cut into parts of about so many, which rows meet by the part's number, spread over ``salts`` tasks a part.
    """
    distinct = values.filter(F.col(name).isNotNull()).distinct()
    local = small_table(distinct, together)
    if local is not None:
        one = local.agg(F.array_sort(F.collect_list(name)).alias("__all"))
        return df.drop(name).crossJoin(F.broadcast(one)).withColumn(name, F.explode("__all")).drop("__all")
    parts = -(-distinct.count() // max(1, together // 2))
    part = F.pmod(F.xxhash64(name), F.lit(parts)).cast("int").alias("__part")
    lists = distinct.select(part, name).groupBy("__part").agg(F.collect_list(name).alias("__all"))  # about ``together`` / 2 each
    lists = lists.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = df.drop(name).withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if c != name]), F.lit(salts)).cast("int"))
    rows = rows.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return rows.join(lists, ["__part", "__salt"]).withColumn(name, F.explode("__all")).drop("__part", "__salt", "__all")
