"""The corpus pipeline: toxic documents go, one of each group of near copies stays, benchmark text goes, sources are mixed, ids are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labelforge.llm import decontaminate, mixing, simhash, tokens, toxicity
from labelforge.llm.common import new_folder, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7; the classifier learns from all labels of the documents it is given."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the row with the smallest id; of rows that repeat that id, one."""
    return simhash.keep_one(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: a document comes as often as it is drawn."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token ids in files; one row per document in them."""
    return tokens.read(spark, tokens.write(docs, tokens.public_tokenizer()))


STAGES = [("toxicity", toxic), ("simhash", near_copies), ("decontamination", benchmark_free), ("mixing", mixed), ("token_ids", token_ids)]

#: Models, random draws and a tokenizer: no SQL states the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = new_folder(spark, f"pipeline-{k}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
