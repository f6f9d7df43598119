"""Running totals over a whole table in a named order, without a window that holds the table in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelforge.session import cut_lineage


def running_totals(df: DataFrame, order: Sequence[str | Column], **totals: str) -> DataFrame:
    """``df`` with a column per entry of ``totals`` (name = column): its sum over the rows up to and including each.

    Rows are dealt into ranges of ``order``, which must be a total order, and the ranges are written. Totals inside a range are
    a window over that range; what the ranges before it hold is one row per range, which the driver adds up. A range holds
    about as many rows as any other, whatever the values.
    """
    parts = cut_lineage(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sums = parts.groupBy("__part").agg(*[F.sum(c).alias(n) for n, c in totals.items()]).orderBy("__part").collect()  # a row per range
    before, offsets = dict.fromkeys(totals, 0), []
    for row in sums:
        offsets.append((row["__part"], *before.values()))
        before = {n: before[n] + (row[n] or 0) for n in totals}
    schema = "__p int, " + ", ".join(f"`__o_{n}` bigint" for n in totals)
    known = F.broadcast(df.sparkSession.createDataFrame(offsets, schema))
    inside = W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    upto = parts.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"__i_{n}") for n, c in totals.items()])
    joined = upto.join(known, F.col("__part") == F.col("__p"))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(f"__o_{n}") + F.col(f"__i_{n}")).cast("bigint").alias(n) for n in totals])
