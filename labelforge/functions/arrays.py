"""Array arithmetic for logits, votes and label lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax(logits: Column | str) -> Column:
    """Probabilities from logits, shifted by the largest one so that ``exp`` cannot overflow."""
    x = F.col(logits) if isinstance(logits, str) else logits
    top = F.array_max(x)
    powers = F.transform(x, lambda v: F.exp(v - top))
    total = F.aggregate(powers, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(powers, lambda v: v / total)


def argmax(values: Column | str) -> Column:
    """0-based position of the first largest value."""
    x = F.col(values) if isinstance(values, str) else values
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def sigmoid_flags(logits: Column | str, threshold: float = 0.5) -> Column:
    """1 where the sigmoid of a logit is over the threshold."""
    x = F.col(logits) if isinstance(logits, str) else logits
    return F.transform(x, lambda v: (1 / (1 + F.exp(-v)) > threshold).cast("int"))


def true_label_probability(logits: Column | str, label_index: Column | str) -> Column:
    """Softmax probability of the gold label."""
    idx = F.col(label_index) if isinstance(label_index, str) else label_index
    return F.get(softmax(logits), idx)


def majority_vote(votes: Column | str) -> Column:
    """Most frequent non-null vote, smallest on a tie; stays inside the row."""
    v = F.array_sort(F.array_compact(F.col(votes) if isinstance(votes, str) else votes))
    # Sorted distinct candidates, folded with a strict comparison, keep the smallest of the tied ones.
    best = F.aggregate(
        F.array_distinct(v),
        F.struct(F.lit(None).cast("string").alias("vote"), F.lit(0).alias("n")),
        lambda acc, cand: F.when(
            F.size(F.filter(v, lambda x: x == cand)) > acc["n"],
            F.struct(cand.alias("vote"), F.size(F.filter(v, lambda x: x == cand)).alias("n")),
        ).otherwise(acc),
    )
    return best["vote"]
