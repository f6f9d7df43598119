"""Approximate nearest neighbours by a hash-prefix forest.

Every tree writes a vector as a long string of symbols, each the largest coordinate (and its sign) under a random rotation
of its own: close vectors share long prefixes. A tree is its strings in sorted order, so that the vectors under a prefix are a
run of the array. A query descends to its longest prefixes, and all trees ascend together, a symbol at a time, until the
runs hold enough candidates; those are compared by their exact distance. A query enters each tree by several strings: its
largest coordinates of the first rotation each begin one.

On the cluster, a tree is cut at a short prefix (``depth`` symbols, so that the runs above would hold more than enough for any
query). What shares it lies together, in pieces of bounded size that a query visits one and all. Pieces return, by prefix
length, how many vectors match and the nearest of them; each query then picks its level from the sums.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelforge.llm.common import ship, written
from labelforge.operators.attach import attach_small

TREES, PROBES, SYMBOLS = 20, 3, 4
#: Matches at which a query stops to ascend: so many, and this share of all vectors, at least.
ENOUGH, SHARE = 8192, 0.16
#: Vectors of a piece.
PIECE = 8192
SEED = 20_240


class Strings:
    """The hash strings of a tree: rotations drawn from the seed, so that every task has the same."""

    def __init__(self, width: int, tree: int, symbols: int = SYMBOLS, seed: int = SEED):
        rng = np.random.default_rng([seed, tree])
        self.rotations = [np.linalg.qr(rng.normal(size=(width, width)))[0] for _ in range(symbols)]

    def of(self, x: np.ndarray, probes: int = 1) -> np.ndarray:
        """[vector, probe, place] symbols: probe p begins with the p-th largest coordinate."""
        out = np.zeros((len(x), probes, len(self.rotations)), np.int64)
        for place, rotation in enumerate(self.rotations):
            y = x @ rotation
            if place == 0 and probes > 1:
                order = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :probes]
                order = np.pad(order, ((0, 0), (0, probes - order.shape[1])), mode="edge")
            else:
                order = np.argmax(np.abs(y), axis=1)[:, None].repeat(probes, 1)
            out[:, :, place] = 2 * order + (np.take_along_axis(y, order, 1) > 0)
        return out


def packed(symbols: np.ndarray, width: int, length: int | None = None) -> np.ndarray:
    """Strings (last axis) as numbers in the order of the strings; only the first ``length`` symbols."""
    base, out = 2 * width, np.zeros(symbols.shape[:-1], np.int64)
    for place in range(symbols.shape[-1] if length is None else length):
        out = out * base + symbols[..., place]
    return out


def usable(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """vec_id and v (of the given precision, float or double) of the vectors that take part, and their width.

    Left out: null ids, null and empty vectors, zero vectors, null and non-finite components, and vectors of another width
    than the most frequent one (of equally frequent ones, the larger).
    """
    v = F.col(vector) if dict(vectors.dtypes)[vector] == "array<float>" else F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.filter(fine)
    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if top is None:
        return rows, 0
    return rows.filter(F.size("v") == top["d"]), top["d"]


def _routed(rows: DataFrame, trees: int, probes: int, depth: int, width: int, symbols: int) -> DataFrame:
    """One row per vector, tree and probe: its string, and the prefix by which it finds its place."""
    narrow = "float" if dict(rows.dtypes)["v"] == "array<float>" else "double"
    kind = f"vec_id long, v array<{narrow}>, tree int, prefix long, string long"

    def run(batches):
        made = [Strings(width, t, symbols) for t in range(trees)]
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
            for tree, strings in enumerate(made):
                s = strings.of(x, probes)
                for p in range(s.shape[1]):
                    yield pd.DataFrame({"vec_id": pdf["vec_id"], "v": pdf["v"], "tree": np.int32(tree), "prefix": packed(s[:, p], width, depth), "string": packed(s[:, p], width)})

    return rows.mapInPandas(run, kind)


def nearest(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest rows of ``x`` to ``q`` but for the id ``own``: ids and exact distances, ties to smaller ids."""
    square = ((x - q) ** 2).sum(1)
    keep = np.flatnonzero(ids != own)
    if len(keep) > k:
        keep = keep[square[keep] <= np.partition(square[keep], k - 1)[k - 1]]
        keep = keep[np.lexsort((ids[keep], square[keep]))[:k]]
    return ids[keep], np.sqrt(square[keep])


def _piece(width: int, depth: int, symbols: int, k: int):
    """Candidates of one piece: for every query and prefix length, how many vectors match so far and the nearest of them."""
    base = 2 * width

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            order = np.argsort(left["string"].to_numpy(), kind="stable")
            strings, ids = left["string"].to_numpy()[order], left["vec_id"].to_numpy()[order]
            x = np.stack(left["v"].to_numpy()).astype(np.float64)[order]
            for own, v, string in zip(right["vec_id"], right["v"], right["string"], strict=True):
                q, seen = np.asarray(v, np.float64), (0, 0)
                low = high = None
                for level in range(symbols, depth - 1, -1):
                    part = base ** (symbols - level)
                    prefix = int(string) // part
                    a, b = np.searchsorted(strings, [prefix * part, (prefix + 1) * part])
                    new = np.r_[a : a if low is None else low, b if high is None else high : b] if low is not None else np.arange(a, b)
                    low, high = a, b
                    if len(new):
                        got, far = nearest(x[new], ids[new], q, own, k)
                        rows += [(own, level, len(new) if i == 0 else 0, g, d) for i, (g, d) in enumerate(zip(got.tolist(), far.tolist(), strict=True))]
        return pd.DataFrame(rows, columns=["query_id", "level", "n", "vec_id", "d"]).astype({"query_id": "int64", "level": "int32", "n": "int64", "vec_id": "int64", "d": "float64"})

    return run


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    key: str = "vec_id",
    vector: str = "embedding",
    trees: int = TREES,
    probes: int = PROBES,
    symbols: int = SYMBOLS,
    enough: int = ENOUGH,
    piece: int = PIECE,
    share: float = SHARE,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` its ``k`` nearest found rows of ``vectors`` but itself.

    Score is the Euclidean distance in double precision. ``enough`` matches, and ``share`` of all vectors, are where a query
    stops to ascend, no cap: all vectors of its level are compared. A query for which the forest, where it is cut, has fewer
    matches or fewer than ``k`` vectors ascends further, a symbol at a time, at last to the root, and there meets every vector.
    See :func:`usable` for rows that take no part. Rows that repeat an id and vector count once; an id with
    several vectors has several. Fewer vectors than ``k``: all of them. Empty tables: no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    data, width = usable(vectors, key, vector)
    asked, _ = usable(queries, key, vector)
    schema = "query_id long, rank int, vec_id long, score double"
    if not width:
        return spark.createDataFrame([], schema)
    data = written(data.distinct(), "vectors")
    asked = written(asked.filter(F.size("v") == width).distinct(), "queries")
    n = data.count()
    enough = max(enough, math.ceil(share * n))
    symbols = min(symbols, int(62 / math.log2(2 * width)))
    # the shortest prefixes that still hold more than enough for a query, all trees together
    depth = min(symbols, max(0, math.floor(math.log(max(1.0, n * trees * probes / enough), 2 * width))))
    if n > enough:
        depth = max(1, depth)
    done: list[DataFrame] = []
    rest = asked
    while True:
        matches, found = _level(data, rest, trees if depth else 1, probes if depth else 1, depth, width, symbols, k, enough, piece)
        if not depth:
            done.append(found)
            break
        found = written(found, "neighbours")
        full = found.groupBy("query_id").agg(F.count_distinct("vec_id").alias("got")).filter(F.col("got") >= min(k, n - 1))
        full = written(full.join(matches.filter(F.col("n") >= enough), "query_id").select("query_id"), "full")
        done.append(found.join(full, "query_id", "left_semi"))
        rest = written(rest.join(full, F.col("vec_id") == F.col("query_id"), "left_anti"), "rest")
        if rest.isEmpty():
            break
        depth -= 1
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return _exact(found, data, asked, k)


def _level(data, asked, trees, probes, depth, width, symbols, k, enough, piece) -> tuple[DataFrame, DataFrame]:
    """Matches (query_id, n) of all trees and candidates (query_id, vec_id, d) of the forest cut at ``depth``."""
    placed = _routed(data, trees, 1, depth, width, symbols)
    sizes = placed.groupBy("tree", "prefix").agg(F.count("*").alias("n")) if depth else data.agg(F.count("*").alias("n")).select(F.lit(0).alias("tree"), F.lit(0).cast("long").alias("prefix"), "n")
    sizes = written(sizes.select("tree", "prefix", F.ceil(F.col("n") / piece).cast("int").alias("pieces")), "pieces")
    placed = attach_small(placed, sizes, ["tree", "prefix"], "inner").withColumn("piece", F.pmod(F.xxhash64("vec_id"), F.col("pieces")).cast("int"))
    coming = attach_small(_routed(asked, trees, probes, depth, width, symbols), sizes, ["tree", "prefix"], "inner")
    coming = coming.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    keys = ["tree", "prefix", "piece"]
    got = placed.groupBy(*keys).cogroup(coming.groupBy(*keys)).applyInPandas(_piece(width, depth, symbols, k), "query_id long, level int, n long, vec_id long, d double")
    got = written(got, "matches")
    # all trees ascend together: the longest prefix length at which a query has enough
    sums = got.groupBy("query_id", "level").agg(F.sum("n").alias("n"))
    upto = sums.withColumn("upto", F.expr("sum(n) over (partition by query_id order by level desc)"))
    level = upto.groupBy("query_id").agg(F.coalesce(F.max(F.when(F.col("upto") >= enough, F.col("level"))), F.min("level")).alias("from"))
    near = got.join(level, "query_id").filter(F.col("level") >= F.col("from")).select("query_id", "vec_id", "d").distinct()
    return got.groupBy("query_id").agg(F.sum("n").alias("n")), near


def _exact(found: DataFrame, data: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The first ``k`` by exact distance; only what may be among them is measured again."""
    rank = F.expr("row_number() over (partition by query_id order by d, vec_id)")
    kth = found.withColumn("r", rank).filter(F.col("r") == k).select("query_id", F.col("d").alias("kth"))
    near = found.join(kth, "query_id", "left").filter(F.col("kth").isNull() | (F.col("d") <= F.col("kth") * (1 + 1e-9))).select("query_id", "vec_id").distinct()
    near = near.join(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id").join(data, "vec_id")
    square = F.aggregate(F.zip_with("q", "v", lambda a, b: F.pow(a.cast("double") - b.cast("double"), 2.0)), F.lit(0.0), lambda s, x: s + x)
    near = near.select("query_id", "vec_id", F.sqrt(square).alias("score"))
    near = near.withColumn("rank", F.expr("row_number() over (partition by query_id order by score, vec_id)").cast("int"))
    return near.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
