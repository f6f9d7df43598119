"""Token-ID / binary output: whole texts as ids of a public tokenizer, in range-coded files, and their reader.

A file is a run of segments, each readable by itself: magic, length of the header, header (zlib), blocks. The header lists the
documents (id, number of ids), the alphabet with its frequencies, and of every block its bytes and the checksum of its ids.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelforge.llm import rangecoder
from labelforge.llm.common import give_back, new_folder, texts

MAGIC = b"LFIDS1\r\n"
END_ID = 0
#: Ids of a segment, which bounds the memory of writer and reader. A longer document goes over several segments.
SEGMENT = 1 << 22
#: Bytes of pieces and their ids that a worker remembers, and of texts that it encodes at a time.
REMEMBERED, TOGETHER = 16 << 20, 9 << 20
#: Rows that the JVM hands over at a time: with whole texts it would hold many megabytes beside its heap.
ROWS = 500
#: New pieces that are encoded as one string, and strings at a time.
PIECES, STRINGS = 100, 100


class Encoder:
    """Ids of whole texts. Pieces between single blanks are encoded once and remembered, the last ones longest; other texts go in whole.

    The tokenizer's pattern always cuts before a blank that stands alone between two signs that aren't white space, and the
    blank goes with what follows. So the ids of " piece" don't depend on its neighbours, many new pieces can be encoded as
    one string, and the ids that begin with a blank say where each piece begins. A piece that is empty or has white space
    at an end is odd, and a text that holds one is encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        words = self.tokenizer.get_vocab(with_added_tokens=True)
        self.begins = np.zeros(max(words.values()) + 1, bool)
        self.begins[[i for w, i in words.items() if w.startswith("\u0120")]] = True
        self.forget()

    def forget(self) -> None:
        """The known pieces and, in the same order, the ids of " piece" for each; odd pieces have none."""
        self.pieces, self.ids = pa.array([], pa.string()), _lists([], [])

    def whole(self, items: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(items, add_special_tokens=False)]

    def learn(self, new: pa.StringArray) -> None:
        """Remember the ids of " piece" for each."""
        plain = pc.and_(pc.equal(pc.utf8_trim_whitespace(new), new), pc.greater(pc.binary_length(new), 0)).to_numpy(zero_copy_only=False)
        items, parts, sizes = new.filter(pa.array(plain)), [], []
        for k in range(0, len(items), PIECES * STRINGS):
            group = items[k : k + PIECES * STRINGS].to_pylist()
            made = self.whole([" " + " ".join(group[i : i + PIECES]) for i in range(0, len(group), PIECES)])
            ids = np.fromiter(chain.from_iterable(made), np.uint32)
            at = np.flatnonzero(self.begins[ids])
            if len(at) == len(group) and at[0] == 0:
                parts.append(ids)
                sizes.append(np.diff(np.append(at, len(ids))))
            else:  # a tokenizer of another pattern
                made = self.whole([" " + p for p in group])
                parts.append(np.fromiter(chain.from_iterable(made), np.uint32))
                sizes.append(np.array(list(map(len, made))))
        counts = np.zeros(len(new), np.int64)
        counts[plain] = np.concatenate([np.zeros(0, np.int64), *sizes])
        self.pieces, self.ids = pa.concat_arrays([self.pieces, new]), pa.concat_arrays([self.ids, _lists(counts, np.concatenate([np.zeros(0, np.uint32), *parts]))])

    def places(self, pieces: pa.StringArray) -> np.ndarray:
        """The place of each piece among the known ones; new ones are learned first."""
        coded = pieces.dictionary_encode()
        found = pc.index_in(coded.dictionary, value_set=self.pieces).fill_null(-1).to_numpy()
        new = found < 0
        if new.any():
            found = found.copy()
            found[new] = len(self.pieces) + np.arange(new.sum())
            self.learn(coded.dictionary.filter(pa.array(new)))
        return found[coded.indices.to_numpy()]

    def encode(self, items: list[str | None] | pa.StringArray) -> list[np.ndarray]:
        """Ids of each text; null is empty."""
        items = items if isinstance(items, pa.Array) else pa.array(items, pa.string())
        if not len(items):
            return []
        cut = pc.split_pattern(items.fill_null(""), " ")
        begins = cut.offsets.to_numpy()
        begins, counts, flat = begins[:-1] - begins[0], np.diff(begins), cut.flatten()
        is_head = np.zeros(len(flat), bool)
        is_head[begins] = True
        heads = flat.take(pa.array(begins))
        place = np.empty(len(flat), np.int32)
        place[~is_head] = self.places(flat.filter(pa.array(~is_head)))
        place[begins] = len(self.pieces) + np.arange(len(items))
        first = self.whole(heads.to_pylist())
        known = pa.concat_arrays([self.ids, _lists(list(map(len, first)), np.fromiter(chain.from_iterable(first), np.uint32))])
        found = known.take(pa.array(place))
        upto = found.offsets.to_numpy()
        ids, upto = found.flatten().to_numpy(), upto - upto[0]
        odd = (counts > 1) & pc.not_equal(pc.utf8_rtrim_whitespace(heads), heads).to_numpy(zero_copy_only=False)
        odd[np.searchsorted(begins, np.flatnonzero((np.diff(upto) == 0) & ~is_head), side="right") - 1] = True
        out = [ids[a:b] for a, b in zip(upto[begins].tolist(), upto[begins + counts].tolist(), strict=True)]
        again = np.flatnonzero(odd)
        for i, x in zip(again.tolist(), self.whole(items.take(pa.array(again)).to_pylist()), strict=True):
            out[i] = np.array(x, np.uint32)
        if self.pieces.nbytes + self.ids.nbytes > REMEMBERED:
            last = np.unique(place[~is_head])
            self.pieces, self.ids = self.pieces.take(pa.array(last)), self.ids.take(pa.array(last))
            if self.pieces.nbytes + self.ids.nbytes > REMEMBERED:
                self.forget()
        return out


def _lists(sizes, ids) -> pa.ListArray:
    """Lists of these sizes, end to end."""
    upto = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=upto[1:])
    return pa.ListArray.from_arrays(pa.array(upto), pa.array(ids, pa.uint32()))


def _few(data: pa.Array, most: int = TOGETHER) -> Iterator[pa.StringArray]:
    """Texts of a batch in slices of about equal size, of ``most`` bytes or one longer text at most, as strings."""
    upto = np.cumsum(pc.binary_length(data).to_numpy())
    parts = -(-int(upto[-1]) // most) if len(data) else 0
    place = (upto - 1) * parts // max(1, int(upto[-1])) if parts else upto
    edges = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(data)]
    for a, b in zip(edges, edges[1:], strict=False):
        part = data[a:b]
        try:
            yield part.cast(pa.string())
        except pa.ArrowInvalid:  # not UTF-8
            yield pa.array([str(x, "utf-8", "replace") for x in part.to_pylist()], pa.string())


def _gathered(batches: Iterator[pa.RecordBatch], least: int = TOGETHER) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts (columns 0 and 2) of several batches, up to ``least`` bytes and the batch that goes beyond."""
    some, size = [], 0
    for batch in batches:
        some.append((batch.column(0), batch.column(2)))
        size += batch.nbytes
        if size >= least:
            yield tuple(map(pa.concat_arrays, zip(*some, strict=True)))
            some, size = [], 0
    if some:
        yield tuple(map(pa.concat_arrays, zip(*some, strict=True)))


@contextmanager
def _conf(spark, key: str, value: int) -> Iterator[None]:
    """The setting while a job runs, then the one before."""
    before = spark.conf.get(key)
    spark.conf.set(key, str(value))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def pack_segment(docs: list[int | None], lengths: list[int], ids: np.ndarray, block: int = rangecoder.BLOCK) -> bytes:
    """One segment. lengths: ids that each document has here (a document that goes on has its id in the next one again)."""
    counts = np.zeros(int(ids.max()) + 1 if len(ids) else 0, np.int64)  # as long as the vocabulary
    for k in range(0, len(ids), 1 << 20):
        counts += np.bincount(ids[k : k + (1 << 20)], minlength=len(counts))
    alphabet = np.flatnonzero(counts)
    freq = rangecoder.order0(counts[alphabet]) if len(ids) else np.zeros(0, np.int64)
    place, x = np.zeros(len(counts), np.uint32), np.empty(len(ids), np.uint32)
    place[alphabet] = np.arange(len(alphabet), dtype=np.uint32)
    for k in range(0, len(ids), 1 << 20):
        x[k : k + (1 << 20)] = place[ids[k : k + (1 << 20)]]
    blocks, sums = rangecoder.encode(x, freq, block)
    arrays = [
        np.array([d or 0 for d in docs], "<i8"), np.array([d is None for d in docs], "<i8"), np.array(lengths, "<i8"),
        alphabet.astype("<i8"), freq.astype("<i8"), np.array(list(map(len, blocks)), "<i8"), sums.astype("<i8"), np.array([block, len(ids)], "<i8"),
    ]
    raw = struct.pack(f"<{len(arrays)}q", *map(len, arrays)) + b"".join(a.tobytes() for a in arrays)
    header = zlib.compress(raw, 6)
    return MAGIC + struct.pack("<qqI", len(header), sum(map(len, blocks)), zlib.crc32(header)) + header + b"".join(blocks)


HEAD = len(MAGIC) + 20


def read_segments(stream, size: int) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """Documents, lengths and ids of each segment of an open file of ``size`` bytes. Damage raises ValueError."""
    at = 0
    while at < size:
        head = stream.read_at(HEAD, at)
        if len(head) < HEAD or head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"no segment at byte {at}")
        n, body, crc = struct.unpack("<qqI", head[len(MAGIC) :])
        header = stream.read_at(n, at + HEAD)
        if len(header) < n or zlib.crc32(header) != crc:
            raise ValueError(f"damaged header at byte {at}")
        raw = zlib.decompress(header)
        counts = struct.unpack("<8q", raw[:64])
        arrays = np.split(np.frombuffer(raw[64:], "<i8"), np.cumsum(counts)[:-1])
        docs, none, lengths, alphabet, freq, sizes, sums, (block, total) = arrays
        data = stream.read_at(body, at + HEAD + n)
        ends = np.cumsum(sizes).tolist()
        blocks = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        places = rangecoder.decode(blocks, rangecoder._lanes_of(int(total), int(block)), freq)
        ids = alphabet[np.concatenate(places)] if places else np.zeros(0, np.int64)
        if len(ids) != total or not np.array_equal(rangecoder.checksums(places_joined(places), int(block)), sums.astype(np.uint32)):
            raise ValueError(f"checksum of a block at byte {at}")
        yield [None if z else int(d) for d, z in zip(docs, none, strict=True)], lengths, ids.astype("<u4")
        at += HEAD + n + body


def places_joined(places: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(places) if places else np.zeros(0, np.int64)


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = END_ID, key: str = "doc_id", text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """Write all texts in ascending id order to files in ``folder`` (default: a new one in the shared folder).

    Returns the manifest: part, path, bytes, n_docs, n_ids, one row per file, in order of ``part``. Each file holds a range of
    ids, nulls first; rows of equal id stand in order of their texts' hashes. A null or empty text has only the end id. A
    task that runs again writes a file of its own; the manifest names those of the tasks that succeeded.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "ids")
    rows = texts(docs, key, text).select("doc_id", F.xxhash64("data").alias("tie"), F.coalesce("data", F.lit(b"")).alias("data"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches):
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        path = f"part-{part:06d}-{context.taskAttemptId() if context else 0}.ids"
        encoder, n_docs, n_ids, size = None, 0, 0, 0
        names, lengths, parts, held, end = [], [], [], 0, np.array([end_id], np.uint32)
        with fs.open_output_stream(f"{root}/{path}") as sink:

            def flush():
                nonlocal names, lengths, parts, held, size
                if names:
                    ids, parts = np.concatenate(parts), []
                    data = pack_segment(names, lengths, ids)
                    sink.write(data)
                    size += len(data)
                    names, lengths, held = [], [], 0

            for keys, data in _gathered(batches):
                encoder = encoder or _encoder(tokenizer)
                keys = iter(keys.to_pylist())
                for few in _few(data):
                    made = encoder.encode(few)
                    sizes = [len(x) + 1 for x in made]
                    flat, begin, at = np.concatenate([np.zeros(0, np.uint32), *(y for x in made for y in (x, end))]), 0, 0
                    del made
                    for n in sizes:
                        doc = next(keys)
                        n_docs += 1
                        n_ids += n
                        while n:
                            here = min(n, segment - held)
                            n, held, at = n - here, held + here, at + here
                            names.append(doc)
                            lengths.append(here if not n else -here)  # below 0: it goes on
                            if held == segment:
                                parts.append(flat[begin:at])
                                begin = at
                                flush()
                    parts.append(flat[begin:])
                    del flat
            flush()
        data = few = None
        give_back()
        if n_docs:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part]), "path": [f"{folder}/{path}"], "bytes": pa.array([size]), "n_docs": pa.array([n_docs]), "n_ids": pa.array([n_ids])})
        else:
            fs.delete_file(f"{root}/{path}")

    schema = "part long, path string, bytes long, n_docs long, n_ids long"
    with _conf(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", ROWS):
        made = rows.mapInArrow(run, schema).toArrow()  # one row per file
    return spark.createDataFrame(made, schema).orderBy("part") if made.num_rows else spark.createDataFrame([], schema)


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One tokenizer for all tasks of a worker, which remembers pieces from one task to the next."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def read(spark, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens (end id included), ids_crc32 and, asked for, ids, from the files alone."""
    files = manifest.orderBy("part").collect()  # one row per file
    bases, total = [], 0
    for f in files:
        bases.append((f["path"], f["bytes"], total))
        total += f["n_ids"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    names = [p.split()[0] for p in schema.split(", ")]
    if not bases:
        return spark.createDataFrame([], schema)

    def run(batches):
        for batch in batches:
            for path, size, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, root = pafs.FileSystem.from_uri(path)
                crc, n, kept = 0, 0, []
                with fs.open_input_file(root) as stream:
                    for docs, lengths, ids in read_segments(stream, size):
                        rows, begin = [], 0
                        for doc, length in zip(docs, lengths.tolist(), strict=True):
                            piece = ids[begin : begin + abs(length)]
                            begin += abs(length)
                            crc, n = zlib.crc32(piece.tobytes(), crc), n + len(piece)
                            if with_ids:
                                kept.append(piece)
                            if length > 0:
                                rows.append((doc, at, n, crc, np.concatenate(kept).tolist()) if with_ids else (doc, at, n, crc))
                                at, crc, n, kept = at + n, 0, 0, []
                        if rows:
                            made = list(zip(*rows, strict=True))
                            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64() if i < 4 else pa.list_(pa.int64())) for i, c in enumerate(made)], names=names)
        give_back()

    rows = spark.createDataFrame(bases, "path string, bytes long, base long")
    return rows.repartition(len(bases), "path").mapInArrow(run, schema)


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)
