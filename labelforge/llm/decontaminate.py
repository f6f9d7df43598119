"""Benchmark decontamination: Wu-Manber search for many strings, over words.

The strings are windows of consecutive words of benchmark items. A position of the text is the last word of a window;
its block is its last two words. The shift table says how far the next window that could match is; where it says 0, the
block's hash bucket holds the strings that end in it, and comparing the words confirms an occurrence.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelforge.llm.common import free_name, ship, slices

WINDOW = 10
#: Bytes of benchmark text that one pass over the documents searches for; a larger benchmark takes more passes.
PASS_BYTES = 32 << 20

_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else 32 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256)
)


def words_of(data: bytes | None) -> list[bytes]:
    """ASCII letters in lower case; words are runs of ASCII letters, digits and signs beyond ASCII. Null: none."""
    return data.translate(_WORD_BYTES).split() if data else []


def windows_of(words: list[bytes], size: int) -> Iterator[tuple[bytes, ...]]:
    """All runs of ``size`` words; an item of fewer, but not none, is one window."""
    for i in range(max(1, len(words) - size + 1) if words else 0):
        yield tuple(words[i : i + size])


class WuManber:
    """Shift tables and suffix buckets, one pair for each window length."""

    def __init__(self, items: list[tuple[str, bytes | None]], size: int = WINDOW):
        strings: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
        for item, data in items:
            for window in windows_of(words_of(data), size):
                strings[len(window)][window].add(item)
        self.tables = []
        for m, found in sorted(strings.items()):
            block = min(2, m)
            shift: dict[tuple[bytes, ...], int] = {}
            bucket: dict[tuple[bytes, ...], list] = defaultdict(list)
            for window, ids in sorted(found.items()):
                for end in range(block, m + 1):
                    key = window[end - block : end]
                    shift[key] = min(shift.get(key, m), m - end)
                bucket[window[m - block :]].append((list(window), sorted(ids)))
            self.tables.append((m, block, m - block + 1, shift, dict(bucket)))

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Places [from, to) of all occurrences, and the items they belong to."""
        places, items = [], set()
        n = len(words)
        for m, block, most, shift, bucket in self.tables:
            i = m - 1
            while i < n:
                key = (words[i - 1], words[i]) if block == 2 else (words[i],)
                step = shift.get(key, most)
                if step:
                    i += step
                    continue
                start = i - m + 1
                for window, ids in bucket.get(key, ()):
                    if words[start : i + 1] == window:
                        places.append((start, i + 1))
                        items.update(ids)
                i += 1
        return places, items


def covered(places: list[tuple[int, int]]) -> int:
    """Number of words inside any of the places."""
    total, upto = 0, 0
    for a, b in sorted(places):
        if b > upto:
            total += b - max(a, upto)
            upto = b
    return total


def _passes(benchmark: DataFrame, most: int) -> list[list[tuple[str, bytes | None]]]:
    """Items in groups of at most ``most`` bytes of text (or one item), from one pass over the benchmark."""
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string").cast("binary"))
    groups, room = [[]], most
    for item, data in rows.orderBy("item_id", "text").toLocalIterator():
        if item is None or not data:
            continue
        if len(data) > room and groups[-1]:
            groups.append([])
            room = most
        groups[-1].append((item, bytes(data)))
        room -= len(data)
    return groups


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", size: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items (long), items (the item ids), items_sha256 and contaminated.

    The documents are read once per group of items of ``pass_bytes`` and never shuffled; each pass adds its places to a
    column of the row, so that a benchmark of any size gives whole results with bounded tables.

    Null and empty texts have no words and no hits. Items with a null id or without words match nothing; items of equal
    text are all reported. Repeated documents each get their row. Columns of ``docs`` that have the name of a result are
    replaced. Empty tables give no rows, or rows without hits.
    """
    spark = docs.sparkSession
    ship(spark)
    results = ("n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in results and c != text])
    if text.lower() in results:
        raise ValueError(f"the text column can't be named {text}")
    state = free_name(docs, "__found")
    out = docs.withColumn(state, F.array().cast("array<string>"))
    for items in _passes(benchmark, pass_bytes):
        tables = spark.sparkContext.broadcast(WuManber(items, size))
        out = _search_pass(out, text, state, tables)
    return _digest(out, text, state)


def _search_pass(docs: DataFrame, text: str, state: str, tables) -> DataFrame:
    """One more pass: places and items found so far are in ``state`` as "from:to" and "=item"."""
    schema, place = docs.schema, docs.columns.index(state)
    at = docs.columns.index(text)

    def run(batches):
        machine = tables.value
        for batch in slices(batches):
            had, data = batch.column(place).to_pylist(), batch.column(at).cast(pa.binary()).to_pylist()
            for k, x in enumerate(data):
                places, items = machine.search(words_of(x)) if x else ([], ())
                if places:
                    had[k] = [*(had[k] or []), *(f"{a}:{b}" for a, b in places), *(f"={i}" for i in items)]
            yield batch.set_column(place, batch.schema.field(place).name, pa.array(had, batch.schema.field(place).type))

    return docs.mapInArrow(run, schema)


def _digest(docs: DataFrame, text: str, state: str) -> DataFrame:
    """The result columns from the state."""

    columns = docs.columns
    at, place = columns.index(text), columns.index(state)
    keep = [i for i in range(len(columns)) if i != place]

    added = T.StructType.fromDDL("n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean")
    schema = T.StructType([docs.schema.fields[i] for i in keep] + added.fields)
    names = schema.names

    def run(batches):
        for batch in slices(batches):
            rows = []
            for data, found in zip(batch.column(at).cast(pa.binary()).to_pylist(), batch.column(place).to_pylist(), strict=True):
                items = sorted({x[1:] for x in found or () if x[0] == "="})
                places = [tuple(map(int, x.split(":"))) for x in found or () if x[0] != "="]
                hit = covered(places)
                rows.append((len(words_of(data)), hit, len(items), items, hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0))
            made = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *(pa.array(list(m), k) for m, k in zip(made, kinds, strict=True))], names=names)

    return docs.mapInArrow(run, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", size: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The documents without any window of the benchmark, with all their columns, whatever their names.

    Each group of items is one filter over the rows as they are: texts go through a task once, and nothing is added.
    """
    spark, at = docs.sparkSession, docs.columns.index(text)
    ship(spark)

    def without(tables):
        def run(batches):
            for batch in slices(batches):
                data = batch.column(at).cast(pa.binary()).to_pylist()
                yield batch.filter(pa.array([not (x and tables.value.search(words_of(x))[0]) for x in data], pa.bool_()))

        return run

    out = docs
    for items in _passes(benchmark, pass_bytes):
        out = out.mapInArrow(without(spark.sparkContext.broadcast(WuManber(items, size))), docs.schema)
    return out
