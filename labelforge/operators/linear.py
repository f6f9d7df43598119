"""Regularised linear models over sparse rows: all classes or labels in one pass per iteration.

The rows are written once, in blocks that tasks read without conversion. An iteration sends out the matrix of weights and sums the tasks'
gradients, of which a task sends what isn't zero; a sum has the size of the model, features x classes, whatever the number of
rows. L-BFGS runs on the sums. Weights are fitted in the scale of the features, which is what the penalty means, and so need
few iterations. Features that only one row has are fitted as one: from a start at zero, each has its share of one weight.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.session import checkpoint_folder, ship

MEMORY = 6  # pairs of steps that L-BFGS remembers, in single precision
CELLS = 1 << 22  # products of a task at once
SLICE = 1 << 18  # numbers of a piece of the gradient
TOGETHER = 16  # tasks whose gradients are summed at once; more are summed in two steps
#: A block of rows: its features; places among them and values of the entries; entries a row; classes, and how many a row has.
BLOCK = {"f": "<i4", "i": "<i4", "v": "<f8", "n": "<i4", "y": "<i4", "ny": "<i4"}
#: The features that only one row has, the one that stands for them, and their shares of it.
LONE = {"lone": "<i4", "rep": "<i4", "share": "<f8"}
BLOCK_CLASSES = 16  # a block is cut as if there were so many classes at least, so that a task's tables of it stay small


@dataclass
class Targets:
    """What is fitted: one class a row (softmax) or any labels a row (a sigmoid each), and the weights of rows with and without."""

    classes: int
    one: bool
    positive: np.ndarray
    negative: np.ndarray


def sparse_parts(vector: str) -> tuple[Column, Column]:
    """Indices and values of an ML vector column, by its printed form; a dense vector has all indices."""
    shown = F.from_json(F.to_json(F.struct(F.col(vector).alias("x"))), "x struct<indices:array<int>,values:array<double>>")
    values = shown["x"]["values"]
    every = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.size(values) - 1)).otherwise(F.array().cast("array<int>"))
    return F.coalesce(shown["x"]["indices"], every), values


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All entries of a list column, and how many each row has."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def row_pieces(sizes: np.ndarray, classes: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose entries x classes stay near ``CELLS``."""
    begin, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        held += n * classes
        if held >= CELLS:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(sizes):
        yield begin, len(sizes)


def row_margins(i: np.ndarray, v: np.ndarray, sizes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """[row, class]; the last row of ``weights`` is the constant's."""
    out = np.repeat(weights[-1:], len(sizes), axis=0)
    some = sizes > 0
    if some.any():
        starts = (np.cumsum(sizes) - sizes)[some]
        out[some] += np.add.reduceat(v[:, None] * weights[i], starts, axis=0)
    return out


def loss_and_slope(margins: np.ndarray, hit: np.ndarray, targets: Targets) -> tuple[float, np.ndarray]:
    """Summed loss and its derivative by the margins; ``hit`` is 1 where a row has the class."""
    if targets.one:
        top = margins.max(axis=1, keepdims=True)
        powers = np.exp(margins - top)
        total = powers.sum(axis=1, keepdims=True)
        w = (hit * targets.positive).sum(axis=1, keepdims=True)
        return float((w * (np.log(total) + top - (hit * margins).sum(axis=1, keepdims=True))).sum()), w * (powers / total - hit)
    w = np.where(hit == 1, targets.positive, targets.negative)
    return float((w * (np.logaddexp(0, margins) - hit * margins)).sum()), w * (1 / (1 + np.exp(-np.clip(margins, -700, 700))) - hit)


@dataclass
class Blocks:
    """Rows in blocks of files in the checkpoint folder."""

    spark: SparkSession
    folder: str
    parts: list[tuple[str, list[int]]]  # files, and bytes of their blocks
    alone: np.ndarray | None
    lone: dict[str, np.ndarray]
    tasks: list[dict[str, list[int]]] = field(default_factory=list)

    @property
    def held(self) -> int:
        """Bytes."""
        return sum(sum(sizes) for _, sizes in self.parts)

    def deal(self, tasks: int) -> Blocks:
        """The blocks dealt out, the largest first, each to the task with least; a task has its blocks by file."""
        every = sorted((-size, path, k) for path, sizes in self.parts for k, size in enumerate(sizes))
        self.tasks = [{} for _ in range(max(1, min(tasks, len(every))))]
        least = [(0, t) for t in range(len(self.tasks))]
        for size, path, k in every:
            so_far, t = least[0]
            self.tasks[t].setdefault(path, []).append(k)
            heapq.heapreplace(least, (so_far - size, t))
        return self

    def drop(self) -> None:
        """Remove the files."""
        fs, root = pafs.FileSystem.from_uri(self.folder)
        if fs.get_file_info(root).type == pafs.FileType.Directory:
            fs.delete_dir(root)


def pack(rows: DataFrame, classes: int, alone: np.ndarray | None = None) -> Blocks:
    """Rows (i, v, y) written in blocks, for now a task for each of their files.

    ``alone`` marks the features that only one row has. The first of a row stands for all of them, with the length of their values.
    """
    spark = rows.sparkSession
    ship(spark)
    folder, work = f"{checkpoint_folder(spark)}/rows-{uuid.uuid4().hex}", _blocks
    shared = spark.sparkContext.broadcast(alone)

    def run(batches):
        name = f"part-{TaskContext.get().partitionId()}-{uuid.uuid4().hex}"  # another one for another attempt
        sizes, lone = work(batches, classes, shared.value, folder, name)
        if sizes:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([sizes], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in lone)], names=["part", "sizes", *LONE])

    # the files that succeeded
    found = rows.select("i", "v", "y").mapInArrow(run, "part string, sizes array<long>, lone binary, rep binary, share binary").collect()
    shared.destroy()
    found.sort(key=lambda r: int(r["part"].split("-")[1]))
    lone = {c: np.frombuffer(b"".join(r[c] for r in found), t) for c, t in LONE.items()}
    return Blocks(spark, folder, [(r["part"], r["sizes"]) for r in found], alone, lone).deal(len(found))


def _blocks(batches: Iterator[pa.RecordBatch], classes: int, alone: np.ndarray | None, folder: str, name: str) -> tuple[list[int], list[bytes]]:
    """Write a task's rows to a file, if it has any; the sizes of its blocks, and its lone features."""
    fs, root = pafs.FileSystem.from_uri(folder)
    sizes, found, sink = [], [[] for _ in LONE], None
    for batch in batches:
        (i, ni), (v, _), (y, ny) = (flat(batch.column(c)) for c in range(3))
        ei, ey = np.concatenate([[0], np.cumsum(ni)]), np.concatenate([[0], np.cumsum(ny)])
        for a, b in row_pieces(ni, max(classes, BLOCK_CLASSES)):
            at, entries, each, *lone = _merged(i[ei[a] : ei[b]], v[ei[a] : ei[b]], ni[a:b], alone)
            f, at = np.unique(at, return_inverse=True)
            block = (f, at, entries, each, y[ey[a] : ey[b]], ny[a:b])
            block = pa.RecordBatch.from_arrays([pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in zip(block, BLOCK.values(), strict=True)], names=[*BLOCK])
            if sink is None:
                fs.create_dir(root, recursive=True)
                sink = fs.open_output_stream(f"{root}/{name}")
                file = pa.ipc.new_file(sink, block.schema)
            file.write_batch(block)
            sizes.append(block.nbytes)
            for all_of, x, t in zip(found, lone, LONE.values(), strict=True):
                all_of.append(x.astype(t).tobytes())
    if sink is not None:
        file.close()
        sink.close()
    return sizes, [b"".join(x) for x in found]


def _read(folder: str, parts: dict[str, list[int]]) -> Iterator[list[np.ndarray]]:
    """The blocks of a task."""
    fs, root = pafs.FileSystem.from_uri(folder)
    for name, places in parts.items():
        with fs.open_input_file(f"{root}/{name}") as source:
            file = pa.ipc.open_file(source)
            for k in places:
                yield [np.frombuffer(x[0].as_buffer(), t) for x, t in zip(file.get_batch(k).columns, BLOCK.values(), strict=True)]


def _merged(at: np.ndarray, v: np.ndarray, sizes: np.ndarray, alone: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """Entries, values and sizes of the rows with one entry for all lone features of a row; these, what stands for each, and its share."""
    if alone is None:
        return at, v, sizes, at[:0], at[:0], v[:0]
    single, row = alone[at], np.repeat(np.arange(len(sizes)), sizes)
    where = np.flatnonzero(single)
    r = row[where]
    first = np.diff(r, prepend=-1) > 0
    length = np.sqrt(np.bincount(r, v[where] ** 2, minlength=len(sizes)))
    rep, share = at[where][first][np.cumsum(first) - 1], v[where] / length[r]
    v, stay = v.copy(), ~single
    v[where[first]], stay[where[first]] = length[r[first]], True
    return at[stay], v[stay], np.bincount(row[stay], minlength=len(sizes)), at[where], rep, share


def _task(blocks: Iterator[list[np.ndarray]], weights: np.ndarray, targets: Targets, place: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """Loss and gradient of a task's blocks; ``place`` has the weights' rows of the features."""
    loss, slope = 0.0, np.zeros_like(weights)
    for f, at, v, n, y, ny in blocks:
        f, at, rows = f if place is None else place[f], at.astype(np.intp), len(n)
        hit = np.zeros((rows, targets.classes))
        hit[np.repeat(np.arange(rows), ny), y] = 1
        some = n > 0
        starts = (np.cumsum(n) - n)[some]
        margins = np.repeat(weights[-1:], rows, axis=0)
        if len(starts):
            for k in range(targets.classes):
                margins[some, k] += np.add.reduceat(v * weights[f, k][at], starts)
        more, d = loss_and_slope(margins, hit, targets)
        loss += more
        for k in range(targets.classes):
            slope[f, k] += np.bincount(at, v * np.repeat(d[:, k], n), minlength=len(f))
        slope[-1] += d.sum(axis=0)
    return loss, slope


def _sent(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Places and numbers of what isn't zero, where that is shorter; else all numbers."""
    at = np.flatnonzero(numbers)
    return (at.astype("<i4").tobytes(), numbers[at].tobytes()) if 3 * len(at) < 2 * len(numbers) else (b"", numbers.tobytes())


def _add(total: np.ndarray, at, numbers) -> None:
    """Add what :func:`_sent` made."""
    g = np.frombuffer(numbers, "<f8")
    if len(g) == len(total):
        total += g
    else:
        total[np.frombuffer(at, "<i4")] += g


def _evaluate(rows: DataFrame | Blocks, weights: np.ndarray, targets: Targets, place: Broadcast | None = None) -> tuple[float, np.ndarray]:
    """Loss and gradient over all rows."""
    if isinstance(rows, DataFrame):
        blocks = pack(rows, targets.classes)
        try:
            return _evaluate(blocks, weights, targets)
        finally:
            blocks.drop()
    spark, folder, dealt = rows.spark, rows.folder, rows.tasks
    shared = spark.sparkContext.broadcast(weights)
    cells, piece, work, read, sent, add = weights.size, SLICE, _task, _read, _sent, _add

    def run(batches):
        for batch in batches:
            for task in batch.column(0).to_pylist():
                loss, slope = work(read(folder, dealt[task]), shared.value, targets, None if place is None else place.value)
                flat = slope.reshape(-1)
                cuts = list(range(0, cells, piece))
                at, g = zip(*[sent(flat[c : c + piece]) for c in cuts], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(cuts, pa.int64()), pa.array([task] * len(cuts), pa.int32()), pa.array([loss if c == 0 else 0.0 for c in cuts]), pa.array(at, pa.binary()), pa.array(g, pa.binary())], names=["slice", "task", "loss", "at", "g"])

    schema, tasks = "slice long, task int, loss double, at binary, g binary", len(dealt)
    parts = spark.range(0, tasks, 1, tasks).mapInArrow(run, schema)

    def added(table: pa.Table) -> pa.Table:
        table = table.sort_by("task")  # sums of one order, whatever arrives first
        begin = table["slice"][0].as_py()
        total = np.zeros(min(piece, cells - begin))
        for at, g in zip(table["at"], table["g"], strict=True):
            add(total, at.as_buffer(), g.as_buffer())
        at, g = sent(total)
        arrow = pa.schema([("slice", pa.int64()), ("task", pa.int32()), ("loss", pa.float64()), ("at", pa.binary()), ("g", pa.binary())])
        return pa.table({"slice": [begin], "task": [table["task"][0].as_py()], "loss": [float(np.sum(table["loss"].to_numpy()))], "at": [at], "g": [g]}, schema=arrow)

    # the driver gets one gradient; of many tasks, first by the square root of the tasks, then all
    if tasks > TOGETHER:
        parts = parts.withColumn("part", F.pmod("task", F.lit(TOGETHER))).groupBy("slice", "part").applyInArrow(added, schema)
    if tasks > 1:
        parts = parts.groupBy("slice").applyInArrow(added, schema)
    loss, slope = 0.0, np.zeros(cells)
    for batch in parts.toArrow().to_batches():
        for begin, more, at, g in zip(*(batch[c] for c in ("slice", "loss", "at", "g")), strict=True):
            loss += more.as_py()
            add(slope[begin.as_py() : begin.as_py() + piece], at.as_buffer(), g.as_buffer())
    shared.destroy()
    return loss, slope.reshape(weights.shape)


def fit_linear(rows: DataFrame | Blocks, width: int, targets: Targets, n: int, penalty: float, max_iter: int, tolerance: float) -> np.ndarray:
    """Weights [feature and, last, constant; class] that minimise the mean loss and ``penalty`` / 2 x their squares.

    ``rows``: i (feature numbers), v (values), y (numbers of the row's classes), ``n`` of them, or their blocks. The constant has
    no penalty. Done when no part of the gradient exceeds ``tolerance``, or after ``max_iter`` iterations. The gradients of a row's
    lone features are their shares of one number, and so are their weights and steps: the model on the way has one weight for them,
    and every product and length is that of the whole one.
    """
    if isinstance(rows, DataFrame):
        blocks = pack(rows, targets.classes)
        try:
            return fit_linear(blocks, width, targets, n, penalty, max_iter, tolerance)
        finally:
            blocks.drop()
    n, stay, (lone, rep, share) = max(n, 1), np.ones(width, bool), rows.lone.values()
    if rows.alone is not None:
        stay = ~rows.alone
        stay[rep] = True
    place = np.cumsum(stay, dtype=np.int32) - 1
    where = None if stay.all() else rows.spark.sparkContext.broadcast(place)
    # largest share and sum of shares of what a weight stands for
    most, sums = np.ones((int(stay.sum()) + 1, 1)), np.ones((int(stay.sum()) + 1, 1))
    most[place[rep]], sums[place[rep]] = 0, 0
    np.maximum.at(most[:, 0], place[rep], share)
    np.add.at(sums[:, 0], place[rep], share)

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        loss, slope = _evaluate(rows, w, targets, where)
        slope /= n
        slope[:-1] += penalty * w[:-1]
        return loss / n + penalty / 2 * float((w[:-1] ** 2).sum()), slope

    w = np.zeros((len(most), targets.classes))
    now, slope = value(w)
    known: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(max_iter):
        if np.max(np.abs(slope) * most) <= tolerance:
            break
        step, first = -_direction(slope, known), not known
        if float((step * slope).sum()) >= 0:
            known, step = [], -slope
        size, descent = (1.0 / max(1e-12, float((np.abs(slope) * sums).sum())) if first else 1.0), float((step * slope).sum())
        while True:
            new, changed = value(w + size * step)
            if new <= now + 1e-4 * size * descent or size < 1e-10:
                break
            size /= 2
        if new >= now:
            break
        step *= size
        w += step
        s, y = step.astype(np.float32), (changed - slope).astype(np.float32)
        if float((s * y).sum(dtype=float)) > 1e-12:
            known = [*known[-MEMORY + 1 :], (s, y)]
        now, slope = new, changed
    if where is not None:
        where.destroy()
    out = np.zeros((width + 1, targets.classes))
    out[:-1][stay], out[-1] = w[:-1], w[-1]
    out[lone] = w[place[rep]] * share[:, None]
    return out


def _direction(slope: np.ndarray, known: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The remembered curvature's inverse times the gradient (two loops)."""
    q, used = slope.copy(), []
    for s, y in reversed(known):
        rho = 1 / float((s * y).sum())
        a = rho * float((s * q).sum())
        q -= a * y
        used.append((rho, a, s, y))
    if known:
        s, y = known[-1]
        q *= float((s * y).sum()) / float((y * y).sum())
    for rho, a, s, y in reversed(used):
        q += (a - rho * float((y * q).sum())) * s
    return q
