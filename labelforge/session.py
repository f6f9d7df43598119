"""Session helpers: a local session for tests and benches, and fault-tolerant lineage cuts."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str, cpus: int | str = 8, **conf: str) -> SparkSession:
    """A session for one machine. On a cluster the caller brings their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def cut_lineage(df: DataFrame, placed: bool = False) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there.

    The folder is the one the session names in ``spark.checkpoint.dir``, so that it lies on storage every
    executor can read and a lost executor costs no recomputation. Only a local session without it gets one of
    its own; a cluster without it is an error.

    ``placed``: what reads the rows knows by which key they were dealt out, and need not shuffle them by it again. An adaptive
    plan does not tell that of its rows, so that the writing plan is fixed before it runs.
    """
    checkpoint_folder(df.sparkSession)
    if not placed:
        return df.checkpoint(eager=True)
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    adaptive = conf.get(name)
    conf.set(name, "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        conf.set(name, adaptive)


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of :func:`cut_lineage`."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="labelforge-ckpt-"))
    return context.getCheckpointDir()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, for functions that tasks import: they needn't have it installed."""
    context = spark.sparkContext
    if not hasattr(context, "_labelforge"):
        base = Path(tempfile.mkdtemp(prefix="labelforge-code-"))
        root = Path(__file__).resolve().parent
        name = shutil.make_archive(str(base / root.name), "zip", root.parent, root.name)
        context.addPyFile(name)
        context._labelforge = name
