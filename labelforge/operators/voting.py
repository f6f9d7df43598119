"""Consensus of annotators, votes of several classifiers, and cascades of classifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.functions.arrays import majority_vote
from labelforge.operators.attach import attach_small


def consensus(df: DataFrame, votes: Sequence[str], name: str = "label") -> DataFrame:
    """Most frequent vote over the annotator columns, nulls ignored, smallest on a tie; inside the row."""
    return df.withColumn(name, majority_vote(F.array(*votes)))


def agreed_rows(first: DataFrame, second: DataFrame, on: str, label: str = "label") -> DataFrame:
    """Rows two annotators labelled alike."""
    other = second.select(on, F.col(label).alias("__other"))
    return first.join(other, on).filter(F.col(label) == F.col("__other")).drop("__other")


def claim_verdict(df: DataFrame, keys: Sequence[str], label: str = "label", name: str = "verdict") -> DataFrame:
    """Claim label from its evidence labels."""
    has = lambda v: F.coalesce(F.bool_or(F.col(label) == v), F.lit(False))
    verdict = (
        F.when(has("SUPPORTS") & has("REFUTES"), "DISPUTED")
        .when(has("SUPPORTS"), "SUPPORTS")
        .when(has("REFUTES"), "REFUTES")
        .otherwise("NOT_ENOUGH_INFO")
    )
    return df.groupBy(*keys).agg(verdict.alias(name))


def check_tasks(tasks: Sequence[str], allowed: Sequence[str]) -> None:
    """Refuse task names outside the allowed list."""
    unknown = [t for t in tasks if t not in allowed]
    if unknown:
        raise ValueError(f"tasks {unknown} are not among {list(allowed)}")


def positive_flags(predictions: DataFrame, positives: DataFrame, label: str = "y_pred") -> DataFrame:
    """Add ``is_positive``: does the prediction equal the positive label of its task? ``positives(task, positive)``."""
    joined = attach_small(predictions, positives, ["task"])
    hit = F.coalesce(F.col(label).cast("string") == F.col("positive"), F.lit(False))
    return joined.withColumn("is_positive", hit).drop("positive")


def vote(predictions: DataFrame, key: str, mode: str = "majority", flag: str = "is_positive", name: str = "vote") -> DataFrame:
    """Votes of several classifiers per text. ``majority``: strictly more yes than no; ``any``; ``list`` by task."""
    if mode == "majority":
        value = F.count_if(F.col(flag)) > F.count_if(~F.col(flag))
    elif mode == "any":
        value = F.bool_or(flag)
    elif mode == "list":
        value = F.transform(F.array_sort(F.collect_list(F.struct("task", F.col(flag).alias("v")))), lambda x: x["v"])
    else:
        raise ValueError(f"unknown mode {mode!r}: majority, any or list")
    return predictions.groupBy(key).agg(value.alias(name))


def stance_vote(predictions: DataFrame, key: str, stances: DataFrame, mode: str = "majority") -> DataFrame:
    """Stance of several classifiers per text. ``stances(task, y_pred, stance)`` maps to Support, Denies, Neutral.

    ``majority`` is the most frequent stance, ``any`` whether some classifier takes a side; a tie is Neutral.
    """
    mapped = attach_small(predictions, stances, ["task", "y_pred"])
    s, d, n = (F.count_if(F.col("stance") == x) for x in ("Support", "Denies", "Neutral"))
    if mode == "any":
        return mapped.groupBy(key).agg(((s + d) > 0).alias("stance"))
    best = F.when((s > d) & (s > n), "Support").when((d > s) & (d > n), "Denies").otherwise("Neutral")
    return mapped.groupBy(key).agg(best.alias("stance"))


def majority_of(among: Column, flag: str = "is_positive") -> Column:
    """Strictly more yes than no among some rows of a group; null where there are none."""
    yes, no = F.count_if(among & F.col(flag)), F.count_if(among & ~F.col(flag))
    return F.when(yes + no > 0, yes > no)


def stance_of(among: Column, stance: str = "stance") -> Column:
    """The most frequent stance among some rows of a group, Neutral on a tie; null where there are none."""
    s, d, n = (F.count_if(among & (F.col(stance) == x)) for x in ("Support", "Denies", "Neutral"))
    best = F.when((s > d) & (s > n), "Support").when((d > s) & (d > n), "Denies").otherwise("Neutral")
    return F.when(F.count_if(among) > 0, best)


def label_columns(predictions: DataFrame, key: str, tasks: Sequence[str], readable: DataFrame | None = None) -> DataFrame:
    """One column per task with its label, readable where ``readable(task, y_pred, value)`` knows it."""
    check_tasks(tasks, tasks)
    labelled = predictions
    if readable is not None:
        labelled = attach_small(predictions, readable, ["task", "y_pred"]).withColumn(
            "y_pred", F.coalesce("value", "y_pred")
        )
    return labelled.groupBy(key).pivot("task", list(tasks)).agg(F.first("y_pred"))


def cascade(
    pages: DataFrame, key: str, is_page: str, queries: str, stance: DataFrame
) -> DataFrame:
    """Page -> queries -> stance.

    Pages whose flag is false keep null queries and stances. The others get their query list, and per query the
    stance of ``stance(key, query, stance)``, in query order. A page without queries gets two empty lists.
    """
    hit = pages.filter(F.col(is_page)).select(key, F.explode(queries).alias("query"))
    both = hit.join(stance, [key, "query"], "left")
    packed = both.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("query", "stance"))).alias("__p"))
    none = F.array().cast("array<string>")
    side = lambda f: F.when(F.col(is_page), F.coalesce(F.transform("__p", lambda x: x[f]), none))
    return (
        pages.select(key, is_page).join(packed, key, "left")
        .select(key, F.col(is_page).cast("int").alias("label"), side("query").alias("queries"), side("stance").alias("stances"))
    )


def cascade_triplets(cascaded: DataFrame, document: str, page: str) -> DataFrame:
    """Flat (document_id, page, query, stance) rows of a cascade result, for nesting and scoring."""
    pairs = F.explode(F.arrays_zip("queries", "stances")).alias("z")
    return cascaded.select(F.col(document).alias("document_id"), F.col(page).alias("page"), pairs).select(
        "document_id", "page", F.col("z.queries").alias("query"), F.col("z.stances").alias("stance")
    )


def constant_prediction(documents: DataFrame, query: str, stance: str, pages: Sequence[int]) -> DataFrame:
    """The same evidence for every document: the most-frequent baseline."""
    one = F.struct(F.lit(query).alias("query"), F.lit(stance).alias("stance"), F.array(*[F.lit(p) for p in pages]).alias("page_indices"))
    return documents.select("document_id").distinct().withColumn("evidences", F.array(one))
