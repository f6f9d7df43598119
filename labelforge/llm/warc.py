"""WARC archives packed in ZIP files: a writer, and a reader that finds members and records by the directories alone.

An archive holds ``archive/data.warc.gz`` (records, each a gzip member of its own) and ``indexes/index.cdx`` (offset, length
and id of each record), both stored, not deflated. The reader takes the tail of the file, follows the end record (or the
ZIP64 one) to the central directory, finds where a stored member's bytes begin, and reads any record by its range: no
member is extracted, and a task holds one record at a time besides the index.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.llm.common import new_folder, ship, slices

#: Payloads below this many bytes are never revisits.
LEAST_REVISIT = 100
#: Bytes of records of an archive, at which the next one begins.
ARCHIVE_BYTES = 16 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


# --- records -------------------------------------------------------------------------------------------------------


def pack_record(page_id: int | None, url: str | None, kind: str, refers_to: int | None, payload: bytes, digest: str) -> bytes:
    """One WARC/1.1 record as a gzip member; a revisit has the headers of the response it refers to and no payload."""
    block = _HTTP + (payload if kind == "response" else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c.isprintable() else "%" + c.encode("utf-8", "replace").hex() for c in url))
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n", 4, mtime=0)


def parse_record(member: bytes) -> dict:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest and payload; ValueError where the record doesn't hold what it says."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if not first.startswith("WARC/1.") or len(block) != int(fields["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    payload = block.partition(b"\r\n\r\n")[2]
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload) != int(fields["WARC-Payload-Length"]) or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("payload and digest differ")
    page, refers = (fields.get(k, "").removeprefix("<urn:page:").removesuffix(">") for k in ("WARC-Record-ID", "WARC-Refers-To"))
    return {
        "page_id": int(page) if page else None, "url": fields.get("WARC-Target-URI"), "record_type": kind, "refers_to": int(refers) if refers else None,
        "payload_bytes": int(fields["WARC-Payload-Length"]), "payload_digest": digest, "payload": payload if kind == "response" else None,
    }


# --- ZIP -----------------------------------------------------------------------------------------------------------


def members(stream, size: int) -> dict[str, tuple[int, int]]:
    """Of each stored member, where its bytes begin and how many they are, from the central directory; ZIP64 where it is used.

    ``stream`` has ``read_at(n, offset)``. A file that is no ZIP archive raises ValueError.
    """
    tail_at = max(0, size - 65_557)
    tail = stream.read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, at = struct.unpack("<H", tail[end + 10 : end + 12])[0], *struct.unpack("<II", tail[end + 12 : end + 20])
    if count == 0xFFFF or length == 0xFFFFFFFF or at == 0xFFFFFFFF:
        locator = stream.read_at(20, tail_at + end - 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        record = stream.read_at(56, struct.unpack("<Q", locator[8:16])[0])
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        count, length, at = struct.unpack("<QQQ", record[32:56])
    directory, found, p = stream.read_at(length, at), {}, 0
    for _ in range(count):
        if directory[p : p + 4] != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        method, packed, plain = struct.unpack("<H", directory[p + 10 : p + 12])[0], *struct.unpack("<II", directory[p + 20 : p + 28])
        n_name, n_extra, n_note = struct.unpack("<HHH", directory[p + 28 : p + 34])
        local = struct.unpack("<I", directory[p + 42 : p + 46])[0]
        name = directory[p + 46 : p + 46 + n_name].decode()
        extra = directory[p + 46 + n_name : p + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack("<HH", extra[:4])
            if kind == 1:
                wide, q = extra[4 : 4 + n], 0
                for which in ("plain", "packed", "local"):
                    if {"plain": plain, "packed": packed, "local": local}[which] == 0xFFFFFFFF:
                        value = struct.unpack("<Q", wide[q : q + 8])[0]
                        q += 8
                        plain, packed, local = value if which == "plain" else plain, value if which == "packed" else packed, value if which == "local" else local
            extra = extra[4 + n :]
        p += 46 + n_name + n_extra + n_note
        if method == 0:
            header = stream.read_at(30, local)
            n_name, n_extra = struct.unpack("<HH", header[26:30])
            found[name] = local + 30 + n_name + n_extra, packed
    return found


def read_index(stream, where: dict[str, tuple[int, int]]) -> list[tuple[int, int]]:
    """Offset and length of every record."""
    at, n = where[INDEX]
    return [(int(a), int(b)) for a, b, *_ in (x.split(" ") for x in stream.read_at(n, at).decode().splitlines())]


def read_records(stream, size: int) -> Iterator[dict]:
    """All records of an archive, each by its range."""
    where = members(stream, size)
    begin, n = where[DATA]
    for at, length in read_index(stream, where):
        if at + length > n:
            raise ValueError("the index points beyond the member")
        yield parse_record(stream.read_at(length, begin + at))


class _Archive:
    """Records that become one ZIP file."""

    def __init__(self):
        self.data, self.index = io.BytesIO(), []

    def add(self, record: bytes, page_id: int | None) -> None:
        self.index.append(f"{self.data.tell()} {len(record)} {'' if page_id is None else page_id}\n")
        self.data.write(record)

    def bytes(self) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as packed:
            for name, content in ((DATA, self.data.getbuffer()), (INDEX, "".join(self.index).encode())):
                with packed.open(zipfile.ZipInfo(name), "w", force_zip64=True) as member:
                    member.write(content)
        return out.getvalue()


# --- tables --------------------------------------------------------------------------------------------------------


def decide(pages: DataFrame, key: str = "page_id", html: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, digest and bytes of each distinct pair, with record_type and refers_to.

    Of pages with equal payloads of at least ``least`` bytes the smallest id responds. Rows that repeat it respond too; a
    null id responds only where no other id has the payload.
    """
    payload = F.coalesce(F.col(html).cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    rows = rows.distinct()
    first = rows.filter(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = (F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))) & (F.col("bytes") >= least)
    return rows.join(first, "digest", "left").select(
        "page_id", "digest", "bytes", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to")
    )


def write(pages: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url", html: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row to archives in ``folder`` (default: a new one in the shared folder); returns the manifest (path, bytes, records).

    Null html is the empty payload. Only revisits meet their decision in a join of narrow rows; the pages themselves move once, with
    theirs. A task that runs again writes archives of its own, and the manifest names those of the tasks that succeeded.
    """
    spark = pages.sparkSession
    ship(spark)
    folder = folder or new_folder(spark, "warc")
    payload = F.coalesce(F.col(html).cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest")
    )
    again = decide(pages, key, html).filter("record_type = 'revisit'").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "refers_to")
    rows = rows.join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    rows = rows.select("page_id", "url", "payload", "digest", "refers_to")

    def run(batches):
        context = TaskContext.get()
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        stem = f"pages-{context.stageId()}-{context.partitionId()}-{context.taskAttemptId()}"
        archive, made = _Archive(), []

        def close():
            nonlocal archive
            if archive.index:
                data, name = archive.bytes(), f"{stem}-{len(made)}.wacz"
                with fs.open_output_stream(f"{root}/{name}") as sink:
                    sink.write(data)
                made.append((f"{folder}/{name}", len(data), len(archive.index)))
                archive = _Archive()

        for batch in slices(batches):
            for page, link, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                archive.add(pack_record(page, link, "response" if refers is None else "revisit", refers, payload, digest), page)
                if archive.data.tell() >= archive_bytes:
                    close()
        close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*made, strict=True)], names=["path", "bytes", "records"])

    schema = "path string, bytes long, records long"
    got = rows.mapInArrow(run, schema).toArrow()  # one row per archive
    return spark.createDataFrame(got, schema) if got.num_rows else spark.createDataFrame([], schema)


def read(spark: SparkSession, manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest (and payload; null in revisits) of every record of the archives."""
    ship(spark)
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + (", payload binary" if with_payload else "")
    kinds = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
    names = [p.split()[0] for p in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, root = pafs.FileSystem.from_uri(path)
                rows = []
                with fs.open_input_file(root) as stream:
                    for record in read_records(stream, size):
                        rows.append([record[n] for n in names])
                        if len(rows) == 500:
                            yield _batch(rows, names, kinds)
                            rows = []
                if rows:
                    yield _batch(rows, names, kinds)

    files = manifest.count()
    return manifest.select("path", "bytes").repartition(max(1, files), "path").mapInArrow(run, schema)


def _batch(rows: list[list], names: list[str], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds.get(n, pa.string())) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)
