"""Bag-of-words features for the linear models, made from 64-bit hashes of terms in the task that reads the text.

A term is known by its hash alone: the driver and the tasks hold 16 bytes a term of the train rows, and no words. Two terms
of one hash would share a feature, which a billion terms do with a chance of about 3 in 100.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.functions.text import word_tokens
from labelforge.operators.linear import flat, row_margins, row_pieces
from labelforge.session import ship


@dataclass
class Space:
    """The features of one column: its terms' hashes in ascending order, and their weights.

    ``whole``: the value itself is the only term (one-hot; null is a value); else its words, weighted by smoothed idf
    ln((1+n)/(1+df))+1. A row's values in a space have length 1. Terms that no train row had are left out. ``alone``: is it in one
    train row only?
    """

    column: str
    whole: bool
    terms: np.ndarray
    idf: np.ndarray
    alone: np.ndarray


def term_hashes(column: str, whole: bool) -> Column:
    """The hashes of a row's terms, repeats included; a null text has none."""
    if whole:
        return F.array(F.xxhash64(F.col(column).cast("string")))
    return F.transform(word_tokens(F.coalesce(F.col(column), F.lit(""))), lambda w: F.xxhash64(w))


def fit_space(train: DataFrame, column: str, n: int, whole: bool = False) -> Space:
    """Terms of the ``n`` train rows, counted by documents; what reaches the driver is two numbers a term."""
    hashes = train.select(F.explode(F.array_distinct(term_hashes(column, whole))).alias("h"))
    counts = hashes.groupBy("h").agg(F.count(F.lit(1)).alias("df")).toArrow()
    h, df = (counts[c].to_numpy() for c in ("h", "df"))
    order = np.argsort(h)
    idf = np.ones(len(h)) if whole else np.log((1 + n) / (1 + df[order])) + 1
    return Space(column, whole, h[order], idf, df[order] == 1)


def width(spaces: Sequence[Space]) -> int:
    """Number of features."""
    return sum(len(s.terms) for s in spaces)


def weigh(columns: Sequence[pa.Array], spaces: Sequence[Space]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, values, and how many of them each row has, from one column of hashes a space."""
    rows, first, found = len(columns[0]), 0, []
    for column, space in zip(columns, spaces, strict=True):
        h, sizes = flat(column)
        many = len(space.terms)
        at = np.minimum(np.searchsorted(space.terms, h), max(many - 1, 0))
        known = space.terms[at] == h if many else np.zeros(len(h), bool)
        cell, tf = np.unique(np.repeat(np.arange(rows), sizes)[known] * max(many, 1) + at[known], return_counts=True)
        row, at = np.divmod(cell, max(many, 1))
        v = tf * space.idf[at] if many else tf.astype(float)
        length = np.sqrt(np.bincount(row, v * v, minlength=rows))
        found.append((row, at + first, v / length[row]))
        first += many
    row, i, v = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.argsort(row, kind="stable")
    return i[order].astype(np.int32), v[order], np.bincount(row, minlength=rows)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values))


def _in_pieces(columns: Sequence[pa.Array]):
    """The columns of hashes in runs of rows of a bounded number of terms."""
    sizes = sum(np.diff(c.offsets.to_numpy()) for c in columns)
    for a, b in row_pieces(sizes, len(columns)):
        yield [c.slice(a, b - a) for c in columns]


def feature_column(spark: SparkSession, spaces: Sequence[Space]) -> Column:
    """Struct of the feature numbers ``i`` and values ``v`` of a row; only hashes go to Python."""
    ship(spark)
    shared, make, pieces, lists = spark.sparkContext.broadcast(list(spaces)), weigh, _in_pieces, _lists

    def features(*columns):
        done = [make(part, shared.value) for part in pieces(columns)]
        i, v, n = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int32), np.zeros(0), np.zeros(0, int))
        return pa.StructArray.from_arrays([lists(i, n), lists(v, n)], names=["i", "v"])

    return F.arrow_udf(features, "i array<int>, v array<double>")(*[term_hashes(s.column, s.whole) for s in spaces])


def margin_column(spark: SparkSession, spaces: Sequence[Space], weights: np.ndarray) -> Column:
    """Margins of all classes of a row; terms and weights, as large as the model, go to every task once."""
    ship(spark)
    shared, make, pieces, lists, margins, runs = spark.sparkContext.broadcast((list(spaces), weights)), weigh, _in_pieces, _lists, row_margins, row_pieces

    def scored(*columns):
        known, w = shared.value
        out = [np.zeros((0, w.shape[1]))]
        for part in pieces(columns):
            i, v, n = make(part, known)
            ends = np.concatenate([[0], np.cumsum(n)])
            out += [margins(i[ends[a] : ends[b]], v[ends[a] : ends[b]], n[a:b], w) for a, b in runs(n, w.shape[1])]
        all_rows = np.concatenate(out)
        return lists(all_rows.reshape(-1), np.full(len(all_rows), w.shape[1]))

    return F.arrow_udf(scored, "array<double>")(*[term_hashes(s.column, s.whole) for s in spaces])
