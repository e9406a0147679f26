"""Session construction and lineage cuts.

Lineage is cut with ``checkpoint()`` only, into the folder named by
``spark.checkpoint.dir``; a folder of our own is chosen solely where that
setting is absent and the session runs on this machine alone (tests). On a
cluster without the setting an error is raised.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "graphloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, Arrow)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; created locally only if none is configured."""
    sc = spark.sparkContext
    now = sc.getCheckpointDir()
    if now:
        return now
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="graphloom-ckpt-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` with its lineage cut through reliable storage; survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


_STAGED: list[tuple[SparkSession, str]] = []


def stage(df: DataFrame) -> DataFrame:
    """``df`` written to a table in the checkpoint folder and read again.

    For loops: unlike a checkpoint, the table's size estimate starts afresh, so
    it does not multiply with every join of every round. The tables are removed by
    :func:`unstage`, at the end of :func:`staging`, or when the process ends.
    """
    spark = df.sparkSession
    if not _STAGED:
        atexit.register(_remove_staged)
    path = f"{ensure_checkpoint_dir(spark)}/staged-{uuid.uuid4().hex}"
    _STAGED.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(df: DataFrame) -> None:
    """Removes the table behind a staged DataFrame that nothing lazy reads any more; others are left alone."""
    path = getattr(df, "_staged_at", None)
    for entry in [e for e in _STAGED if e[1] == path]:
        _STAGED.remove(entry)
        _remove(*entry)


@contextmanager
def staging() -> Iterator[None]:
    """Removes at its end what was staged inside; for work whose results are written by then."""
    before = len(_STAGED)
    try:
        yield
    finally:
        while len(_STAGED) > before:
            _remove(*_STAGED.pop())


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove_staged() -> None:
    try:
        while _STAGED:
            _remove(*_STAGED.pop())
    except Exception:  # the session is gone, and with it the way to the folder
        pass


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the workers, once per context, wherever the driver found it."""
    sc = spark.sparkContext
    if getattr(sc, "_graphloom_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="graphloom-"), "graphloom.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(home):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("graphloom", os.path.relpath(full, home)))
    sc.addPyFile(archive)
    sc._graphloom_shipped = True
