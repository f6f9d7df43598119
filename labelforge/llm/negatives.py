"""Hard-negative mining with segment summaries.

A vector is cut into segments, and each segment's mean and deviation are stored (scaled by the root of its length). For two
vectors, the products of the means add up to the part of their inner product that the means explain, and by Cauchy-Schwarz
the rest is at most the sum of the products of the deviations. So ``means - deviations <= inner product <= means +
deviations``, and segments of segments narrow it. A pair that can't reach a place among the best of its range goes at the
first level that shows it; only what is left after the finest level is multiplied out.

Components are whole numbers, so that scores are exact and ties are ties. On the cluster, vectors with their summaries are
written once. Tasks scan them in chunks of bounded size and read the anchors block by block from the shared folder: no
vector is shuffled to be compared, and only the best few of each chunk, anchor and range travel.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelforge.llm.common import new_folder, ship

#: Segments of each level, coarse to fine; each level cuts the segments of the one before.
LEVELS = (1, 8, 32)
#: Components of the vectors a task holds at once; rows and anchors compared at a time.
CHUNK, ROWS, BLOCK = 1 << 22, 2048, 2048
#: Share of pairs below which the next level looks at single pairs.
SPARSE = 0.1
#: Float32 summaries are wrong by less than this share of the lengths' product.
SLACK = 1e-5
#: Scores beyond this are held at it, components at 2**62.
MOST = 1 << 60


def segment_bounds(width: int, segments: int) -> np.ndarray:
    """Where the segments of a vector begin, and its end; no segment is empty."""
    segments = min(width, segments)
    return np.arange(segments + 1) * width // segments


def summaries(v: np.ndarray, levels: tuple[int, ...] = LEVELS) -> np.ndarray:
    """For each row of ``v`` and level: the means of all segments, then their deviations, times the root of the length."""
    out = []
    for segments in levels:
        cuts = segment_bounds(v.shape[1], segments)
        length = np.diff(cuts)
        mean = np.add.reduceat(v, cuts[:-1], axis=1) / length
        rest = v - np.repeat(mean, length, axis=1)
        out += [mean * np.sqrt(length), np.sqrt(np.add.reduceat(rest * rest, cuts[:-1], axis=1))]
    return np.concatenate(out, axis=1)


@dataclass
class Vectors:
    """Vectors with ids, labels and stored summaries."""

    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray
    summary: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, width: int) -> Vectors:
        """From columns vec_id, label, v and s."""
        named = {name: batch.column(name) for name in ("vec_id", "label", "v", "s")}
        v, s = (np.frombuffer(b"".join(named[c].to_pylist()), kind).reshape(batch.num_rows, -1).astype(np.float64) for c, kind in (("v", "<f8"), ("s", "<f4")))
        return cls(named["vec_id"].to_numpy(), named["label"].to_numpy(), v[:, :width], s)

    def rows(self, at: slice | np.ndarray) -> Vectors:
        return Vectors(self.ids[at], self.labels[at], self.v[at], self.summary[at])

    def levels(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Means and deviations of each level."""
        begin = 0
        for segments in LEVELS:
            n = len(segment_bounds(self.v.shape[1], segments)) - 1
            yield self.summary[:, begin : begin + n], self.summary[:, begin + n : begin + 2 * n]
            begin += 2 * n


def within(a: Vectors, b: Vectors, alive: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Pairs (i, j) of ``alive`` whose inner product may lie in [low[i], high[i]], and how many each level left."""
    left = [int(alive.sum())]
    slack = SLACK * np.linalg.norm(a.v, axis=1) * np.max(np.linalg.norm(b.v, axis=1), initial=0.0) + SLACK
    low, high = low - slack, high + slack
    i = j = None
    for (am, ad), (bm, bd) in zip(a.levels(), b.levels(), strict=True):
        if i is None and left[-1] < SPARSE * alive.size:
            i, j = np.nonzero(alive)
        if i is None:
            mid, spread = am @ bm.T, ad @ bd.T
            alive = alive & (mid + spread >= low[:, None]) & (mid - spread <= high[:, None])
            left.append(int(alive.sum()))
        else:
            mid, spread = np.einsum("ij,ij->i", am[i], bm[j]), np.einsum("ij,ij->i", ad[i], bd[j])
            keep = (mid + spread >= low[i]) & (mid - spread <= high[i])
            i, j = i[keep], j[keep]
            left.append(len(i))
    if i is None:
        i, j = np.nonzero(alive)
    return i, j, left


def products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The exact inner products of rows i of ``a`` and j of ``b``."""
    if np.max(np.abs(a), initial=0.0) * np.max(np.abs(b), initial=0.0) * a.shape[1] < 1 << 53:
        if len(i) > SPARSE * len(a) * len(b):
            return (a @ b.T)[i, j].astype(np.int64)
        return np.einsum("ij,ij->i", a[i], b[j]).astype(np.int64)
    whole = [sum(int(x) * int(y) for x, y in zip(a[p], b[q], strict=True)) for p, q in zip(i.tolist(), j.tolist(), strict=True)]
    return np.array([max(-MOST, min(MOST, x)) for x in whole], np.int64)


def first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``k`` best rows of each group (higher scores, then smaller ids), and their ranks from 0."""
    order = np.lexsort((ids, -score, group))
    sorted_group = group[order]
    rank = np.arange(len(order)) - np.searchsorted(sorted_group, sorted_group)
    return order[rank < k], rank[rank < k]


def best_in_ranges(a: Vectors, rows: Vectors, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For anchor i and range t the ``k`` best ``rows`` of the same (or another) label with low[i, t] <= score <= high[i, t].

    Returns i * ranges + t, the id and the score. Rows are taken in order of their ids, so that one which only equals the
    k-th best found can't replace it.
    """
    ranges = low.shape[1]
    rows = rows.rows(np.argsort(rows.ids, kind="stable"))
    least = low.copy()
    place, ids, score = (np.zeros(0, np.int64) for _ in range(3))
    for begin in range(0, len(rows.ids), ROWS):
        part = rows.rows(slice(begin, begin + ROWS))
        alive = ((a.labels[:, None] == part.labels) == same) & (a.ids[:, None] != part.ids)
        i, j, _ = within(a, part, alive, least.min(axis=1), high.max(axis=1))
        n = products(a.v, part.v, i, j)
        new = [(i[ok] * ranges + t, part.ids[j[ok]], n[ok]) for t in range(ranges) for ok in [(n >= least[i, t]) & (n <= high[i, t])]]
        place, ids, score = (np.concatenate([old, *more]) for old, more in zip((place, ids, score), zip(*new, strict=True), strict=True))
        keep, rank = first(place, score, ids, k)
        place, ids, score = place[keep], ids[keep], score[keep]
        full = rank == k - 1
        least.reshape(-1)[place[full]] = score[full] + 1
    return place, ids, score


def stored(vectors: DataFrame, key: str, vector: str, label: str, scale: float) -> tuple[DataFrame | None, int]:
    """vec_id, label, v (whole numbers) and s (summaries) of the vectors that take part, written; and their width."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), v.alias("v"))
    rows = rows.filter("vec_id is not null and label is not null and size(v) > 0")
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if top is None:
        return None, 0
    width = top["d"]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, width)
                with np.errstate(over="ignore"):
                    x = np.clip(np.floor(scale * x), -float(1 << 62), float(1 << 62))
                s = summaries(x).astype("<f4")
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r.tobytes() for r in m], pa.binary()) for m in (x.astype("<f8"), s))], names=["vec_id", "label", "v", "s"])

    made = rows.filter(F.size("v") == width).mapInArrow(run, "vec_id long, label long, v binary, s binary")
    once = made.groupBy("vec_id").agg(F.min(F.struct("label", "v", "s")).alias("r")).select("vec_id", "r.*")
    path = new_folder(vectors.sparkSession, "summaries")
    once.write.parquet(path)
    return vectors.sparkSession.read.schema(once.schema).parquet(path), width


def _scan(rows: DataFrame, anchors: DataFrame, width: int, same: bool, k: int) -> DataFrame:
    """anchor_id, target, vec_id, score: the ``k`` best rows of each anchor's ranges (low, high, target: lists)."""
    path = new_folder(rows.sparkSession, "anchors")
    anchors.write.parquet(path)
    room = max(ROWS, CHUNK // width)
    names = ["anchor_id", "target", "vec_id", "score"]

    def run(batches):
        held, n = [], 0

        def compared():
            chunk = Vectors.of(pa.Table.from_batches(held).combine_chunks().to_batches()[0], width)
            fs, root = pafs.FileSystem.from_uri(path)
            for block in pads.dataset(root, filesystem=fs, format="parquet").to_batches(batch_size=BLOCK):
                if block.num_rows:
                    a = Vectors.of(block, width)
                    low, high, target = (_lists(block.column(c), fill) for c, fill in (("low", MOST + 1), ("high", -MOST - 1), ("target", 0)))
                    place, ids, score = best_in_ranges(a, chunk, low, high, same, k)
                    i, t = np.divmod(place, low.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (a.ids[i], target[i, t], ids, score)], names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, room):
                piece = batch.slice(at, room)
                if n and n + piece.num_rows > room:
                    yield from compared()
                    held, n = [], 0
                held.append(piece)
                n += piece.num_rows
        if n:
            yield from compared()

    found = rows.mapInArrow(run, "anchor_id long, target long, vec_id long, score long")
    rank = F.expr("row_number() over (partition by anchor_id, target order by score desc, vec_id)").cast("int")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _lists(column: pa.Array, fill: int) -> np.ndarray:
    """Lists of whole numbers as the rows of a matrix, at least one wide, filled up with ``fill``."""
    lists = column.to_pylist()
    out = np.full((len(lists), max([1, *map(len, lists)])), fill, np.int64)
    for row, values in zip(out, lists, strict=True):
        row[: len(values)] = values
    return out


def mine(
    vectors: DataFrame,
    anchors: str = "vec_id % 100 = 0",
    positives: int = 5,
    negatives: int = 5,
    share: tuple[int, int] = (4, 5),
    scale: float = 256.0,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: the hard negatives of each positive.

    Components become ``floor(scale * x)``; a score is the inner product of two such vectors. The positives of a row that
    meets ``anchors`` (a condition on vec_id and label) are its ``positives`` best other rows of the same label. Hard negatives
    are the ``negatives`` best rows of other labels whose score is at least ``share`` (a fraction) of the positive's and at
    most the positive's, so that a positive below zero has none. Ties go to smaller ids.

    No part take rows with a null id or label, null and empty vectors, null and non-finite components, and vectors of another
    width than the most frequent one (of equally frequent ones, the larger). Rows that repeat an id are one row: the one
    with the least label, then vector. Fewer rows than asked for: all. Empty tables: no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows, width = stored(vectors, key, vector, label, scale)
    if rows is None:
        return spark.createDataFrame([], schema)
    asked = rows.filter(anchors)
    one = F.array(F.lit(0).cast("long"))
    every = asked.withColumn("low", F.array(F.lit(-MOST))).withColumn("high", F.array(F.lit(MOST))).withColumn("target", one)
    near = _scan(rows, every, width, True, positives).select("anchor_id", F.col("vec_id").alias("target"), F.col("score").alias("high"))
    path = new_folder(spark, "positives")
    near.write.parquet(path)
    near = spark.read.schema(near.schema).parquet(path)
    up, down = share
    ranges = near.withColumn("low", F.expr(f"({up} * high + {down - 1}) div {down}")).groupBy("anchor_id").agg(*[F.collect_list(c).alias(c) for c in ("low", "high", "target")])  # ``positives`` each
    asked = asked.join(ranges, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id")
    hard = _scan(rows, asked, width, False, negatives)
    scores = near.select("anchor_id", "target", F.col("high").alias("positive_score"))
    return hard.join(scores, ["anchor_id", "target"]).select(
        "anchor_id", F.col("target").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
