"""Document fingerprints from prefix polynomial hashes.

``prefix[i]`` is the sum of ``c[j] * B**j`` over the first i code points, modulo a prime. A span's hash is a difference of two
prefixes, lifted to a common power, so that equal spans have equal hashes wherever they stand: any two spans are compared in
constant time, and the longest common extension of two places is found by binary search. Two primes make 62 bits.

A fingerprint is the hash of the whole text and a sketch of all its spans of ``SPAN`` code points: the hashes are dealt to
``SLOTS`` slots, and each keeps its least value. The share of equal slots estimates the likeness (Jaccard) of the two sets of
spans. A text shorter than a span is one span.

On the cluster, texts are sorted by id in ranges, in one shuffle, and streamed: each meets the next one in its task. Only the
first and the last text of each range are kept, to meet their neighbours afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelforge.llm.common import slices, texts, written

#: Primes below 2**31 (the first is 2**31 - 1) and the bases of the powers.
PRIMES, BASES = (2_147_483_647, 2_147_483_629), (1_000_003, 69_069)
#: Code points of a span, slots of a sketch, hex digits of a slot.
SPAN, SLOTS, DIGITS = 24, 128, 3
#: Code points whose prefixes are made at once in a sketch; texts compared at once have about ``TOGETHER``.
CHUNK, TOGETHER = 1 << 15, 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


def code_points(text: str) -> np.ndarray:
    """The numbers of the code points, from 1, so that leading zeros count."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") + np.uint32(1)


class Powers:
    """``B**i`` modulo a prime for as many i as were asked for."""

    def __init__(self, base: int, prime: int):
        self.base, self.prime = base, prime
        self.known = np.ones(1, np.int64)

    def upto(self, n: int) -> np.ndarray:
        """The first ``n``."""
        while len(self.known) < n:
            step = pow(self.base, len(self.known), self.prime)
            self.known = np.concatenate([self.known, self.known * step % self.prime])
        return self.known[:n]


POWERS = [Powers(b, p) for b, p in zip(BASES, PRIMES, strict=True)]


class Prefixes:
    """Prefix hashes of a text: equality of any spans, and longest common extensions."""

    def __init__(self, text: str):
        codes = code_points(text)
        self.n = len(codes)
        self.sums = []
        for powers in POWERS:
            terms = codes.astype(np.int64) * powers.upto(self.n) % powers.prime
            self.sums.append(np.concatenate([[0], np.cumsum(terms) % powers.prime]))

    def span(self, begin: int, end: int, top: int) -> tuple[int, ...]:
        """The hash of a span, lifted to the power ``top`` (at least ``begin``, the same for spans to be compared)."""
        return tuple(int(s[end] - s[begin]) % p.prime * int(p.upto(top - begin + 1)[top - begin]) % p.prime for s, p in zip(self.sums, POWERS, strict=True))

    def equal(self, begin: int, other: Prefixes, at: int, length: int) -> bool:
        """Whether ``length`` code points from ``begin`` equal those of ``other`` from ``at``."""
        if begin + length > self.n or at + length > other.n:
            return False
        top = max(begin, at)
        return self.span(begin, begin + length, top) == other.span(at, at + length, top)

    def extension(self, begin: int, other: Prefixes, at: int) -> int:
        """The number of code points from ``begin`` and, in ``other``, from ``at`` that are equal: by binary search."""
        low, high = 0, min(self.n - begin, other.n - at)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(begin, other, at, middle):
                low = middle
            else:
                high = middle - 1
        return low


def whole(codes: np.ndarray) -> int:
    """The 62-bit hash of a whole text, in chunks."""
    out = 0
    for powers in POWERS:
        total = 0
        table = powers.upto(CHUNK)
        for at in range(0, len(codes), CHUNK):
            part = codes[at : at + CHUNK].astype(np.int64)
            total = (total + int((part * table[: len(part)] % powers.prime).sum()) * pow(powers.base, at, powers.prime)) % powers.prime
        out = out << 31 | total
    return out


def _folded(x: np.ndarray) -> np.ndarray:
    """Below 2**62 to a residue modulo 2**31 - 1."""
    x = (x & PRIMES[0]) + (x >> 31)
    x = (x & PRIMES[0]) + (x >> 31)
    return np.where(x >= PRIMES[0], x - PRIMES[0], x)


def span_hashes(codes: np.ndarray, span: int = SPAN) -> Iterator[tuple[int, np.ndarray]]:
    """Hashes of all spans, chunk by chunk: where the chunk begins, and the hash of the span at each place of it."""
    powers = POWERS[0].upto(CHUNK + span)
    for at in range(0, len(codes) - span + 1, CHUNK):
        part = codes[at : at + CHUNK + span - 1].astype(np.int64)
        sums = np.concatenate([[0], np.cumsum(_folded(part * powers[: len(part)]))])
        n = len(part) - span + 1
        # lifted to the chunk's last power, whatever the place
        yield at, _folded(_folded(sums[span:] - sums[:-span]) * powers[CHUNK : CHUNK - n : -1])


def sketches(items: list[np.ndarray], span: int = SPAN, slots: int = SLOTS) -> np.ndarray:
    """[text, slot] the least value of each slot, from 1, 0 where none; of the code points of each text."""
    top = np.uint64(1 << 32)
    least = np.full(len(items) * slots, top, np.uint64)

    def deal(text: np.ndarray | int, hashes: np.ndarray) -> None:
        mixed = hashes.astype(np.uint64) * MIX
        np.minimum.at(least, text * slots + (mixed >> np.uint64(32)).astype(np.int64) % slots, mixed >> np.uint64(40))

    sizes = np.array([len(x) for x in items], np.int64)
    if len(items):
        # all texts in a row; spans that reach over an end are left out
        ends = np.cumsum(sizes)
        for at, hashes in span_hashes(np.concatenate(items), span):
            place = np.arange(at, at + len(hashes))
            owner = np.searchsorted(ends, place, side="right")
            fits = ends[owner] - place >= span
            deal(owner[fits], hashes[fits])
        for i in np.flatnonzero((sizes > 0) & (sizes < span)).tolist():
            deal(np.array([i]), np.array([whole(items[i])]))
    return np.where(least == top, 0, 1 + (least % np.uint64(16**DIGITS - 1)).astype(np.int64)).reshape(len(items), slots)


def written_out(code: int, sketch: np.ndarray) -> str:
    """A fingerprint: 16 hex digits of the whole text, then ``DIGITS`` for each slot."""
    return f"{code:016x}" + "".join([f"{x:0{DIGITS}x}" for x in sketch.tolist()])


def parsed(fingerprint: str) -> np.ndarray:
    """The sketch of a fingerprint."""
    body = fingerprint[16:]
    return np.array([int(body[i : i + DIGITS], 16) for i in range(0, len(body), DIGITS)], np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal slots of two sketches (last axis), of those that either fills; 1 where neither fills any."""
    some = ((a > 0) | (b > 0)).sum(axis=-1)
    return np.where(some == 0, 1.0, ((a == b) & (a > 0)).sum(axis=-1) / np.maximum(some, 1))


def fingerprints_of(items: list[str]) -> tuple[list[str], np.ndarray]:
    """Fingerprints and sketches of texts."""
    codes = [code_points(x) for x in items]
    made = sketches(codes)
    return [written_out(whole(c), s) for c, s in zip(codes, made, strict=True)], made


def edited(text: str, following: str) -> str:
    """``text`` whose second half is the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _answers(pairs: list[tuple[str, str]], made: list[tuple[str, np.ndarray]], following: list[tuple[str, np.ndarray]]) -> list[tuple]:
    """n_chars .. near_next of each text with the next one, whose fingerprints are known."""
    changed = [edited(a, b) for a, b in pairs]
    names, sketch = fingerprints_of(changed)
    mine, theirs = (np.stack([s for _, s in f]) for f in (made, following))
    near = likeness(mine, sketch).tolist(), likeness(mine, theirs).tolist()
    hashes = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in changed]
    # half the bytes while they wait in the table
    return [(len(a), bytes.fromhex(h), bytes.fromhex(f), bytes.fromhex(e), *n) for (a, _), h, (f, _), e, *n in zip(pairs, hashes, made, names, *near, strict=True)]


FOUND = "kind string, part int, doc_id long, text binary, copies long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
NAMES = [p.split()[0] for p in FOUND.split(", ")]
KINDS = [pa.string(), pa.int32(), pa.int64(), pa.binary(), *[pa.int64()] * 2, *[pa.binary()] * 3, *[pa.float64()] * 2]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], names=NAMES)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows (doc_id, tie, text) in lists of about ``TOGETHER`` bytes; repeated rows in a run are one, with their number."""
    out, size = [], 0
    for batch in slices(batches):
        for doc, tie, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = str(data, "utf-8", "replace")
            if out and out[-1][:3] == [doc, tie, text]:
                out[-1][3] += 1
                continue
            if size > TOGETHER and len(out) > 1:
                yield out[:-1]
                out, size = out[-1:], 0
            out.append([doc, tie, text, 1])
            size += len(data)
    if out:
        yield out


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers of all rows of a range but the last; its first and last text."""
    context = TaskContext.get()
    part, last, known = context.partitionId() if context else 0, None, None
    for rows in _together(batches):
        made = list(zip(*fingerprints_of([r[2] for r in rows]), strict=True))
        if last is None:
            yield _batch([("first", part, rows[0][0], rows[0][2].encode("utf-8", "surrogatepass"), 1, *[None] * 6)])
        else:
            rows, made = [last, *rows], [known, *made]
        if len(rows) > 1:
            found = _answers([(a[2], b[2]) for a, b in zip(rows, rows[1:], strict=False)], made[:-1], made[1:])
            yield _batch([("row", part, r[0], None, r[3], *f) for r, f in zip(rows, found, strict=False)])
        last, known = rows[-1], made[-1]
    if last is not None:
        yield _batch([("last", part, last[0], last[2].encode("utf-8", "surrogatepass"), last[3], *[None] * 6)])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers for the last text of each range with the first of the next."""
    for batch in slices(batches, 1):
        for doc, copies, *pair in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = (str(x, "utf-8", "replace") for x in pair)
            one, two = zip(*fingerprints_of([a, b]), strict=True)
            yield _batch([("row", None, doc, None, copies, *f) for f in _answers([(a, b)], [one], [two])])


def compare_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of ``docs``.

    The next document is that with the next smaller id; after the last comes the first. The edited text has the second half of
    its code points (rounded down) replaced by as many first ones of the next document, or by all it has. ``near_edited`` and
    ``near_next`` are the :func:`likeness` of the text's fingerprint to those of the edited and the next text.

    Null texts are empty; empty texts are like each other (1) and like no other (0). Rows with a null id stand last. Rows of one
    id stand in order of their texts' hashes. Rows that repeat id and text are one document, and each gets its answer; a
    single document is its own next. Empty tables give no rows. Bytes that are no UTF-8 are replaced. Other columns are not read.
    """
    rows = texts(docs, key, text).select("doc_id", F.coalesce("data", F.lit(b"")).alias("data")).select("doc_id", F.xxhash64("data").alias("tie"), "data")
    order = [F.desc_nulls_last("doc_id"), "tie"]
    found = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_stream, FOUND), "fingerprints")
    parts = sorted(r["part"] for r in found.filter("kind = 'first'").select("part").collect())  # one row per range
    following = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, after int")
    first = found.filter("kind = 'first'").select(F.col("part").alias("after"), F.col("text").alias("next"))
    ends = found.filter("kind = 'last'").select("part", "doc_id", "copies", "text").join(following, "part").join(first, "after")
    both = found.filter("kind = 'row'").union(ends.select("doc_id", "copies", "text", "next").mapInArrow(_ends, FOUND))
    answers = [F.lower(F.hex(c)).alias(c) if kind == "binary" else F.col(c) for c, kind in both.dtypes[5:]]
    return both.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc_id", *answers)
