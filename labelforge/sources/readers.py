"""Readers with declared schemas. Renaming and column choice happen in the scan, not after it."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"
N_QUESTIONS = 9  # fixed value: raw files hold one of the columns "Question 0" .. "Question 8"


def _struct(schema: T.StructType | str) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _pick(df: DataFrame, columns: Mapping[str, str] | None) -> DataFrame:
    return df if columns is None else df.select(*[F.col(f"`{old}`").alias(new) for old, new in columns.items()])


def read_csv(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str, columns: Mapping[str, str] | None = None,
    sep: str = ",", encoding: str = "UTF-8", multi_line: bool = True,
) -> DataFrame:
    """CSV with a header and quoted line breaks; ``columns`` maps file names to table names.

    A file with quoted line breaks can only be read by one task. ``multi_line=False`` splits large files, for files whose
    values hold no line breaks.
    """
    reader = spark.read.schema(_struct(schema)).option("header", True).option("multiLine", multi_line)
    reader = reader.option("escape", '"').option("sep", sep).option("encoding", encoding)
    return _pick(reader.csv(path), columns)


def read_tsv(spark: SparkSession, path: str | list[str], schema: T.StructType | str, columns: Mapping[str, str] | None = None) -> DataFrame:
    """Tab-separated values; a list of paths is their union."""
    return read_csv(spark, path, schema, columns, sep="\t")


def read_json_lines(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """JSON lines with a declared, possibly nested schema."""
    return spark.read.schema(_struct(schema)).json(path)


def read_tolerant_json_lines(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects with file name and text): bad lines are reported, not fatal."""
    return split_json_lines(spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("file")), schema)


def split_json_lines(lines: DataFrame, schema: T.StructType | str, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Parse a text column as JSON; (good rows with the parsed columns, rejected rows).

    Blank lines are neither.
    """
    struct = _struct(schema).add(CORRUPT, T.StringType())
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = lines.filter(F.length(F.trim(value)) > 0).withColumn("__j", F.from_json(value, struct, options))
    bad = F.col("__j").isNull() | F.col(f"__j.{CORRUPT}").isNotNull()
    rest = [c for c in lines.columns if c != value]
    good = parsed.filter(~bad).select(*rest, "__j.*").drop(CORRUPT)
    return good, parsed.filter(bad).select(*lines.columns)


def read_splits(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    """A table partitioned by dataset and split; other datasets are never listed or read."""
    df = spark.read.parquet(path)
    return df if dataset is None else df.filter(F.col("dataset") == dataset)


def read_split_files(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """One parquet file or folder per split to one table with a ``split`` column."""
    parts = [spark.read.parquet(p).withColumn("split", F.lit(s)) for s, p in paths.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_question_files(spark: SparkSession, path: str | list[str], encoding: str = "ISO-8859-1") -> DataFrame:
    """(text, label, Year, Company Name) from raw files of which each has one ``Question i`` column; label = i.

    Files have different headers: the first question column a file has decides its label. The headers of all files are read
    in one job, and the files of one header by one read with its columns as schema. A header with a line break in a name
    is read by the CSV reader itself.
    """
    paths = [path] if isinstance(path, str) else list(path)
    groups: dict[str, list[str]] = {}
    for row in file_headers(spark, paths).collect():  # one row per file
        groups.setdefault(row["header"], []).append(unquote(row["file"]))
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding)
    parts = []
    for header, files in sorted(groups.items()):
        if header.count('"') % 2:
            parts += [question_rows(reader.csv(f)) for f in files]
            continue
        names = next(csv.reader([header]))
        once = [n if n not in names[:i] else f"{n}{i}" for i, n in enumerate(names)]
        schema = T.StructType([T.StructField(n or f"_c{i}", T.StringType()) for i, n in enumerate(once)])
        parts.append(question_rows(reader.schema(schema).csv(files)))
    return reduce(lambda a, b: a.unionByName(b), parts)


def file_headers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, header): the first line of every file, from one job. Lines of a file's first block are numbered in their order."""
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value"
    )
    first = lines.filter("block = 0").groupBy("file").agg(F.min_by("value", "line").alias("header"))
    return first.select("file", F.regexp_replace("header", "^\ufeff|\r$", "").alias("header"))


def question_rows(raw: DataFrame) -> DataFrame:
    """The label from which question column is there."""
    present = [i for i in range(N_QUESTIONS) if f"Question {i}" in raw.columns]
    if not present:
        raise ValueError("no question column")
    i = present[0]
    return raw.select(
        F.col(f"`Question {i}`").cast("string").alias("text"), F.lit(i).alias("label"), F.col("Year").cast("int").alias("Year"),
        F.col("`Company Name`").cast("string").alias("Company Name"),
    )


def merged_question_rows(raw: DataFrame) -> DataFrame:
    """As :func:`question_rows` for a table in which all questions are columns: the first one filled decides."""
    present = [i for i in range(N_QUESTIONS) if f"Question {i}" in raw.columns]
    cols = [F.col(f"`Question {i}`") for i in present]
    label = F.coalesce(*[F.when(c.isNotNull(), F.lit(i)) for i, c in zip(present, cols)])
    return raw.select(F.coalesce(*cols).alias("text"), label.alias("label"), "Year", "Company Name")


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """All parquet reports of a folder in one table, with the file each row came from."""
    return spark.read.parquet(folder).withColumn("file_name", F.col("_metadata.file_name"))


def unseen_files(listing: DataFrame, done: DataFrame, file_name: str = "file_name") -> DataFrame:
    """Files whose output does not exist yet."""
    return listing.join(done.select(file_name).distinct(), file_name, "left_anti")


def unwrap_json(df: DataFrame, value: str, schema: str) -> DataFrame:
    """A JSON document that is itself a string inside JSON: parse the string, then what it holds."""
    inner = F.get_json_object(F.concat(F.lit('{"x":'), F.col(value), F.lit("}")), "$.x")
    return df.withColumn(value, F.from_json(inner, schema))
