"""Cleaning, measuring and filtering of labelled text, and label mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.functions.text import MAX_TOKENS, MIN_PARAGRAPH_WORDS, MIN_TOKENS, clean_text, count_tokens, last_part
from labelforge.operators.attach import attach_small

# 5-way stance to 3-way stance.
RELAXED_STANCE = {
    "strongly_supporting": "supporting",
    "supporting": "supporting",
    "no_position_or_mixed_position": "no_position",
    "not_supporting": "not_supporting",
    "opposing": "not_supporting",
}


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column behind a one-row generator.

    A filter on a projected column is pushed below the projection, where the expression is evaluated again for every
    mention. Nothing is pushed through a generator that makes the column.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``clean_text`` and ``token_counts``."""
    return computed_once(computed_once(df, "clean_text", clean_text(text)), "token_counts", count_tokens("clean_text"))


def length_filter(df: DataFrame, low: int = MIN_TOKENS, high: int = MAX_TOKENS, drop: bool = True) -> DataFrame:
    """Keep ``low <= token_counts < high``; then ``clean_text`` takes the place of ``text``."""
    kept = df.filter((F.col("token_counts") >= low) & (F.col("token_counts") < high))
    if not drop:
        return kept
    return kept.drop("token_counts", "language", "gibberish", "text").withColumnRenamed("clean_text", "text")


def narrative_paragraphs(df: DataFrame, min_words: int = MIN_PARAGRAPH_WORDS) -> DataFrame:
    """Running text of at least ``min_words`` words, four columns."""
    kept = df.filter((F.col("type") == "NarrativeText") & (F.col("word_count") >= min_words))
    return kept.select("page_number", "filename", "type", "text")


def drop_null(df: DataFrame, *columns: str) -> DataFrame:
    """Rows where all named columns are present."""
    return df.dropna(subset=list(columns))


def drop_technical(df: DataFrame, *columns: str) -> DataFrame:
    """Drop columns that may or may not be there."""
    return df.drop(*(columns or ("__index_level_0__",)))


def map_values(
    df: DataFrame, column: str, mapping: DataFrame, name: str | None = None, mode: str = "lenient"
) -> DataFrame:
    """Replace ``column`` by the ``value`` of ``mapping(key, value)``.

    ``lenient``: unmapped becomes null. ``identity``: unmapped stays. ``strict``: unmapped fails the job.
    """
    name = name or column
    pairs = mapping.select(F.col("key").alias(column), F.col("value").alias("__value"), F.lit(True).alias("__hit"))
    joined = attach_small(df, pairs, [column])
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    if mode == "identity":
        value = F.when(hit, F.col("__value")).otherwise(F.col(column))
    elif mode == "strict":
        failure = F.raise_error(F.concat(F.lit("unmapped value: "), F.coalesce(F.col(column).cast("string"), F.lit("null"))))
        value = F.when(hit, F.col("__value")).otherwise(failure.cast("string"))
    else:
        value = F.col("__value")
    return joined.withColumn(name, value).drop("__value", "__hit")


def map_by_last_part(df: DataFrame, column: str, mapping: DataFrame, name: str) -> DataFrame:
    """Map through a label table on the lower-cased last comma part of both sides."""
    keyed = mapping.select(last_part("key").alias("key"), "value")
    return map_values(df.withColumn("__last", last_part(column)), "__last", keyed, name).drop("__last")


def class_names(df: DataFrame, column: str, names: list[str], name: str = "label") -> DataFrame:
    """Integer class to its name."""
    return df.withColumn(name, F.get(F.array(*[F.lit(n) for n in names]), F.col(column)))


def relax_stance(df: DataFrame, stance: str = "stance") -> DataFrame:
    """5-way stance column to 3-way."""
    table = F.create_map(*[F.lit(x) for pair in RELAXED_STANCE.items() for x in pair])
    return df.withColumn(stance, table[F.col(stance)])


def relax_nested_stance(df: DataFrame, evidences: str = "evidences") -> DataFrame:
    """5-way stance to 3-way inside the evidence list."""
    table = F.create_map(*[F.lit(x) for pair in RELAXED_STANCE.items() for x in pair])
    return df.withColumn(evidences, F.transform(evidences, lambda e: e.withField("stance", table[e["stance"]])))
