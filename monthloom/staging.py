"""Materialised intermediate tables.

Staged tables are ordinary Parquet folders below the shared directory that the
cluster names in ``spark.checkpoint.dir``. They cut lineage, survive executor
loss, keep column pruning, and give Catalyst an exact file size, so that it
broadcasts a staged side only when that size is below its own threshold.
"""
from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_FOLDER = "monthloom-staging"
_local_roots: dict[str, str] = {}
_open = threading.local()


def shared_root(spark: SparkSession) -> str:
    """Directory for staged tables; only a local master may fall back to a private one."""
    configured = spark.conf.get(_SETTING, None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError(f"Set {_SETTING} to a directory that all executors share.")
    app = context.applicationId
    if app not in _local_roots:
        root = tempfile.mkdtemp(prefix="monthloom-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        _local_roots[app] = f"file://{root}"
    return _local_roots[app]


def stage_path(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    path = f"{shared_root(spark)}/{_FOLDER}/{app}/{label}-{uuid.uuid4().hex}"
    for paths in getattr(_open, "scopes", [])[-1:]:
        paths.append(path)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a scan of the written table."""
    path = stage_path(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path)
    # The schema is known, so no footer-reading job is needed.
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def publish(spark: SparkSession, source: str, path: str) -> None:
    """Rename a finished folder to ``path``, in place of what is there."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    a, b = hadoop.Path(source), hadoop.Path(path)
    system = a.getFileSystem(spark._jsc.hadoopConfiguration())
    system.delete(b, True)
    if not system.rename(a, b):
        raise RuntimeError(f"{source} could not be renamed to {path}.")


def discard(table: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    files = table.inputFiles()
    if files:
        folder = files[0].rsplit("/", 1)[0]
        if f"/{_FOLDER}/" not in folder:
            raise ValueError(f"{folder} is not a staged table.")
        delete_path(table.sparkSession, folder)


@contextmanager
def staging_scope(spark: SparkSession) -> Iterator[None]:
    """Delete what is staged inside when it ends, also by an error.

    For jobs that write their results: no table that they return may still read what they staged.
    """
    scopes = _open.__dict__.setdefault("scopes", [])
    scopes.append([])
    try:
        yield
    finally:
        for path in scopes.pop():
            delete_path(spark, path)


@contextmanager
def staged_paths() -> Iterator[list[str]]:
    """Collect the paths of what is staged inside, for ``free`` to delete when nothing reads it."""
    scopes = _open.__dict__.setdefault("scopes", [])
    scopes.append([])
    try:
        yield scopes[-1]
    finally:
        scopes.pop()


def free(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        delete_path(spark, path)


def frees_staged(job: Callable) -> Callable:
    """Run a job, whose first argument is a table, in a staging scope of its own."""
    @functools.wraps(job)
    def run(first: DataFrame, *args, **kwargs):
        with staging_scope(first.sparkSession):
            return job(first, *args, **kwargs)

    return run


def release_staged(spark: SparkSession) -> None:
    """Drop every table this application has staged."""
    app = spark.sparkContext.applicationId
    delete_path(spark, f"{shared_root(spark)}/{_FOLDER}/{app}")
