"""SimHash near-duplicates with covering locality-sensitive hashing.

Fingerprints that differ in at most ``radius`` bits share their value under at least one of 2^(radius+1)-1 structured masks:
every bit position has a non-zero vector of radius+1 bits, every non-zero vector v makes the mask of the positions whose
vector has odd overlap with v. The positions of up to ``radius`` differing bits leave a v that is orthogonal to all of
their vectors, and its mask looks at none of them. So no pair within the radius is missed, by construction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.llm.common import free_name, give_back, slices, texts, written

BITS, SEED = 64, 42
#: Members of a bucket that are compared with each other in one task; a larger bucket is split by further masks.
BUCKET = 1024
#: Times that a larger bucket is split by further masks before it is compared block by block.
SPLITS = 2


def fingerprint(data: bytes | None, words: int = 4) -> int:
    """The 64-bit SimHash of all runs of ``words`` words, repeats included; 0 without words."""
    parts = data.lower().split() if data else []
    if not parts:
        return 0
    text = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(text, SEED)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(size + 1) - 1
    begins = (ends - size)[: len(parts) - words + 1].tolist()
    ends = ends[words - 1 :].tolist()
    count, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for k in range(0, len(begins), 1 << 14):
        hashes = np.array([digest(text[a:b], SEED) for a, b in zip(begins[k : k + (1 << 14)], ends[k : k + (1 << 14)], strict=True)], "<u8")
        count += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(begins), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed bigint) of every row."""

    def run(batches):
        for batch in slices(batches):
            made = np.array([fingerprint(x, words) for x in batch.column(1).to_pylist()], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], names=["doc_id", "fp"])
        give_back()

    return texts(docs, key, text).mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int) -> list[int]:
    """The masks whose tables miss no pair within ``radius``."""
    top = (1 << (radius + 1)) - 1
    vectors = [1 + i % top for i in range(BITS)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, top + 1)]


def _split(mask: int, radius: int) -> list[int]:
    """``mask`` with one of radius+1 disjoint parts of the other bits each: a pair within the radius agrees on one of them."""
    rest = [i for i in range(BITS) if not mask >> i & 1]
    return [mask | sum(1 << i for i in rest[k :: radius + 1]) for k in range(radius + 1)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def spanning_links(values: np.ndarray, radius: int, left: int | None = None) -> Iterator[tuple[int, int]]:
    """Links that connect what pairs within ``radius`` connect: at most one less than there are values.

    With ``left``, only pairs of the first ``left`` values with the others count.
    """
    n = len(values)
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(n - 1 if left is None else left):
        start = i + 1 if left is None else left
        for j in np.flatnonzero(np.bitwise_count(values[start:] ^ values[i]) <= radius) + start:
            a, b = find(i), find(int(j))
            if a != b:
                parent[a] = b
                yield int(values[i]), int(values[j])


def _compare(lists: DataFrame, radius: int) -> DataFrame:
    """Links inside each row's list of fingerprints; ``other``, where given, holds the second block."""

    def run(batches):
        for batch in batches:
            a, b = [], []
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values = np.array(sorted(x) + sorted(y or []), np.int64).view(np.uint64)
                for p, q in spanning_links(values, radius, len(x) if y else None):
                    a.append(p)
                    b.append(q)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(v, np.uint64).view(np.int64)) for v in (a, b)], names=["a", "b"])
        give_back()

    return lists.mapInArrow(run, "a long, b long")


def links(distinct: DataFrame, radius: int = 4, bucket: int = BUCKET, splits: int = SPLITS) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` whose connected components are those of all pairs within ``radius``.

    Each table's buckets are counted first. Buckets of two are a pair, those of up to ``bucket`` members are compared in
    one task. Larger ones are dealt out again under finer masks (the same guarantee, by pigeonhole on the bits not yet
    used), and what is still large after ``splits`` times is compared block by block, each pair of blocks by itself: no
    task holds a whole large bucket, and no pair is dropped.
    """
    if radius < 1:
        return distinct.sparkSession.createDataFrame([], "a long, b long")
    masks = covering_masks(radius)
    rows = distinct.select("fp", F.explode(F.array(*[F.lit(i) for i in range(len(masks))])).alias("t"))
    found: list[DataFrame] = []
    for depth in range(splits + 1):
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.element_at(F.array(*[F.lit(_signed(m)) for m in masks]), F.col("t") + 1)))
        size = rows.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1")
        size = written(size, "buckets")
        near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
        found.append(size.filter((F.col("n") == 2) & near).select("a", "b"))
        many = size.filter("n > 2").select("t", "key", "n")
        kept = rows.join(many, ["t", "key"])
        lists = kept.filter(F.col("n") <= bucket).groupBy("t", "key").agg(F.collect_list("fp").alias("x"))
        found.append(_compare(lists.select("x", F.array().cast("array<long>").alias("y")), radius))
        large = many.filter(F.col("n") > bucket)
        if large.isEmpty():
            break
        rows = rows.join(large, ["t", "key"])
        if depth < splits:
            rows = rows.select("fp", F.explode(F.array(*[F.col("t") * (radius + 1) + i for i in range(radius + 1)])).alias("t"))
            masks = [m for mask in masks for m in _split(mask, radius)]
        else:
            found.append(_blocks(rows, radius, bucket))
    out = found[0]
    for df in found[1:]:
        out = out.union(df)
    return written(out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")


def _blocks(rows: DataFrame, radius: int, bucket: int) -> DataFrame:
    """Large buckets in blocks of about ``bucket``/2 members by hash; every pair of blocks of a bucket is compared once."""
    blocks = F.ceil(F.col("n") * 2 / bucket).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    lists = rows.groupBy("t", "key", "blocks", "block").agg(F.collect_list("fp").alias("x"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    wide = lists.select("t", "key", "block", "x", F.explode(every).alias("with")).select(
        "t", "key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "x"
    )
    pairs = wide.groupBy("t", "key", "i", "j").agg(F.min_by("x", "block").alias("x"), F.max_by("x", "block").alias("y"))
    return _compare(pairs.select("x", F.when(F.col("i") != F.col("j"), F.col("y")).otherwise(F.array().cast("array<long>")).alias("y")), radius)


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of every node of ``edges`` (a, b), by alternating star contractions.

    Each round is two aggregations over the edges, written to the shared folder; the number of rounds grows with the
    logarithm of the longest path.
    """
    edges = edges.filter("a <> b").select("a", "b")
    was = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a")
        edges = written(
            small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(),
            "stars",
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == was:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        was = now


def groups(docs: DataFrame, words: int = 4, radius: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that links reach, itself included) of every row.

    Exact copies have one fingerprint and are one node, whatever their number. Texts without words (null, empty, white
    space) have fingerprint 0 and are linked like any other. Rows with a null id are answered and take part, but a null
    is no component id unless a component has no other. Repeated rows each get an answer. No rows: no answer.
    """
    rows = written(fingerprints(docs, words, key, text), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(nodes.select("fp"), radius))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    member = named.join(least, "root").select("fp", "component_id")
    return rows.join(member, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column | str) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, words: int = 4, radius: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of near copies, with all its columns: the one with the smallest id.

    Rows that repeat an id are one document, of which one row stays. A row with a null id is known by its text and stays
    only where its group has no id. Texts are shuffled once, to meet the ids that stay.
    """
    spare = free_name(docs, "__id")
    beyond = F.lit(1 << 62) + F.xxhash64(F.col(text).cast("string")).bitwiseAND(F.lit((1 << 62) - 1))
    known = docs.withColumn(spare, F.coalesce(F.col(key).cast("long"), beyond))
    found = groups(known.select(spare, text), words, radius, spare, text)
    kept = found.filter("doc_id = component_id").groupBy(F.col("doc_id").alias(spare)).agg(F.count("*").alias("n"))
    kept = written(kept, "kept")
    once = known.join(kept.filter("n = 1").select(spare), spare, "left_semi")
    again = known.join(kept.filter("n > 1").select(spare), spare, "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    again = again.groupBy(spare).agg(F.min_by(row, F.xxhash64(F.col(text).cast("string"))).alias("row"))
    return once.select(*[F.col(f"`{c}`") for c in docs.columns]).union(again.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))
