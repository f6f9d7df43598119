"""What the operators of this subpackage share: tables, the shared folder, and Arrow batches of texts as bytes."""

from __future__ import annotations

import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session: they needn't have it installed."""
    context = spark.sparkContext
    if not hasattr(context, "_labelforge"):
        base = Path(tempfile.mkdtemp(prefix="labelforge-code-"))
        root = Path(__file__).resolve().parents[1]
        name = shutil.make_archive(str(base / root.name), "zip", root.parent, root.name)
        context.addPyFile(name)
        context._labelforge = name


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A local session that names none gets a temporary one; a cluster without one is an error, because no other
    folder is known to be shared.
    """
    ship(spark)
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="labelforge-")
    spark.sparkContext.setCheckpointDir(made)
    return f"file://{made}"


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, by: Sequence[str] = ()) -> DataFrame:
    """``df`` written to the shared folder and read again: what follows doesn't recompute it, nor loses it with an executor.

    A filter on the columns ``by`` reads only the folders of its values.
    """
    path = new_folder(df.sparkSession, what)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_of(key: Column | str) -> Column:
    """Unsigned crc32 of an id as text; the empty text stands for a null id."""
    return F.crc32(F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit("")).cast("binary"))


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, or it with underscores in front, so that no column (in any case) of ``df`` has the name."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = "_" + wish
    return wish


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Id and text as UTF-8 bytes, no other column."""
    ship(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("data"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows, so that Python objects exist for few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def give_back() -> None:
    """Return what a task no longer needs to the system: its Python worker lives on, beside the JVM and other workers."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps what it freed
    if trim:
        trim(0)


def append_columns(docs: DataFrame, text: str, schema: str, per_batch: Callable[[list[bytes | None]], list[pa.Array]]) -> DataFrame:
    """``docs`` with the columns of ``schema`` ("name type, ..."), which ``per_batch`` makes from the texts of a batch.

    One pass without a shuffle; the rows keep all their columns, and repeated rows each get their own values. A
    column of ``docs`` that has the name of a new one must be renamed by the caller (see :func:`free_name`).
    """
    ship(docs.sparkSession)
    wide = docs if dict(docs.dtypes)[text] == "string" else docs.withColumn(text, F.col(text).cast("string"))
    at, docs = docs.columns.index(text), wide
    out = T.StructType(docs.schema.fields + T.StructType.fromDDL(schema).fields)
    names = [f.name for f in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = per_batch(batch.column(at).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=names)
        give_back()

    return wide.mapInArrow(run, out)
