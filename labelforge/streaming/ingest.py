"""Score only the report files that are new, with the same operators as in batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from labelforge.functions.text import clean_text, count_tokens
from labelforge.operators.cleaning import narrative_paragraphs

PARAGRAPH_SCHEMA = "page_number int, filename string, type string, text string, word_count int"


def paragraph_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """New report files of a folder as they appear."""
    return spark.readStream.schema(PARAGRAPH_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def prepare(paragraphs: DataFrame) -> DataFrame:
    """Narrative paragraphs with cleaned text and token count; stateless, for batch and stream."""
    kept = narrative_paragraphs(paragraphs)
    return kept.withColumn("clean_text", clean_text("text")).withColumn("token_counts", count_tokens("clean_text"))


def process_new_files(
    spark: SparkSession, folder: str, out: str, checkpoint: str, score: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Process what is there and not yet done, then stop. The checkpoint knows which files are done."""
    ready = prepare(paragraph_stream(spark, folder))
    scored = score(ready) if score is not None else ready
    return (
        scored.withColumn("processed_at", F.current_timestamp())
        .writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
