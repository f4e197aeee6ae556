"""Session defaults and the shared working folder used by eager operators."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

_OWN_ROOT: str | None = None
_RUNS: dict[str, str] = {}  # shared folder to the folder of this run in it


def build_session(app: str = "terrascope", master: str | None = None, **conf) -> SparkSession:
    """A session with the defaults the library is tested with.

    Joins carry no broadcast hints: Spark broadcasts a side only when its measured size is under
    `spark.sql.autoBroadcastJoinThreshold`, and AQE splits skewed shuffle partitions otherwise.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach: `spark.checkpoint.dir`, else the context's checkpoint folder.

    Where neither is set, a local session gets a private folder; any other session is an error, as its executors
    would write to disks of their own.
    """
    global _OWN_ROOT
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not is_local(spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _OWN_ROOT is None:
        _OWN_ROOT = tempfile.mkdtemp(prefix="terrascope-")
        atexit.register(shutil.rmtree, _OWN_ROOT, ignore_errors=True)
    return _OWN_ROOT


def is_local(master: str) -> bool:
    """Whether the driver is the only executor."""
    return master == "local" or master.startswith("local[")


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds, in any file system."""
    fs, target = _file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []


def data_files(spark: SparkSession, path: str) -> list[str]:
    """The data files under a path or pattern, in order; hidden ones are left out."""
    fs, target = _file_system(spark, path)
    found = []
    for status in fs.globStatus(target) or []:
        inner = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
        found += [s.getPath().toString() for s in inner if s.isFile() and s.getPath().getName()[0] not in "._"]
    return sorted(found)


def remove_folder(spark: SparkSession, path: str) -> bool:
    fs, target = _file_system(spark, path)
    return fs.exists(target) and fs.delete(target, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path nobody has written to yet, inside the shared folder. It is removed when the session's JVM ends."""
    root = shared_root(spark)
    if root not in _RUNS:
        _RUNS[root] = f"{root}/terrascope/run-{uuid.uuid4().hex}"
        fs, target = _file_system(spark, _RUNS[root])
        fs.mkdirs(target)
        fs.deleteOnExit(target)
    return f"{_RUNS[root]}/{name}-{uuid.uuid4().hex}"


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is run inside has its shuffle files removed at its end; else they stay until the driver collects garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, for libraries that do not know Spark's default one."""
    fs, target = _file_system(spark, path)
    full = fs.makeQualified(target).toString()
    return "file://" + full[len("file:"):] if full.startswith("file:/") and not full.startswith("file:///") else full


def checkpointed(df):
    """Cut the lineage through reliable storage, so that lost executors do not change the result."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(f"{shared_root(spark)}/checkpoints")
    return df.checkpoint(eager=True)
