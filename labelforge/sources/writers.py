"""Writers and the merge rules of small keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Columns of the result log.
LOG_COLUMNS = [
    "dataset_name", "model_type", "performance", "performance_type", "n_labels", "seed", "f1_upper", "f1_lower", "n_epoch",
    "precision", "recall", "weighted_f1", "accuracy",
]


def write_splits(df: DataFrame, path: str, dataset: str | None = None, mode: str = "overwrite") -> None:
    """Parquet partitioned by dataset and split. A hot split is written by many tasks: rows are not gathered by split.

    ``overwrite`` replaces the datasets and splits that ``df`` has rows of, and leaves all others under ``path``.
    """
    table = df if dataset is None else df.withColumn("dataset", F.lit(dataset))
    writer = table.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("dataset", "split").parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite") -> None:
    """CSV with a header; arrays and structs are written as JSON text."""
    complex_ = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "struct", "map")]
    for c in complex_:
        df = df.withColumn(c, F.to_json(c))
    df.write.mode(mode).option("header", True).option("sep", sep).option("escape", '"').csv(path)


def write_json_lines(df: DataFrame, path: str, value: str = "value", mode: str = "overwrite") -> None:
    """One ready JSON text per line."""
    df.select(value).write.mode(mode).text(path)


def write_if_absent(df: DataFrame, path: str) -> None:
    """JSON unless the target exists: human annotations are never overwritten."""
    df.write.mode("ignore").json(path)


def insert_only(existing: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(merged table, clashes): keys that exist keep their value, and the new rows for them are reported."""
    known = existing.select(key)
    fresh = new.join(known, key, "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True), new.join(known, key, "left_semi")


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Last write wins per key (also the merge of two keyed objects)."""
    return new.unionByName(existing.join(new.select(key), key, "left_anti"), allowMissingColumns=True)


def append_log(rows: DataFrame, path: str) -> None:
    """Add result rows."""
    rows.select(*LOG_COLUMNS).write.mode("append").parquet(path)


def remaining(todo: DataFrame, log: DataFrame, seed: int | None = None) -> DataFrame:
    """Datasets still to run: not in the log for this seed (``None``: for any seed)."""
    done = log if seed is None else log.filter(F.col("seed") == seed)
    return todo.join(done.select("dataset_name").distinct(), "dataset_name", "left_anti")
