"""Binary files in the shared folder, by whatever file system its address names."""
from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from monthloom.shipping import ship_package
from monthloom.staging import stage_path


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir`` for files that tasks write."""
    path = stage_path(spark, label)
    return f"file://{path}" if path.startswith("/") else path


def locate(address: str) -> tuple[fs.FileSystem, str]:
    if address.startswith("file:/") and not address.startswith("file://"):
        address = "file://" + address[len("file:"):]
    return fs.FileSystem.from_uri(address)


class TaskFile:
    """One file of a task attempt. Its name is unique, so a repeated or speculative attempt never
    touches a file that another attempt's rows name; an attempt that fails leaves an unnamed file."""

    def __init__(self, folder: str, stem: str, suffix: str):
        self.name = f"{stem}-{uuid.uuid4().hex}{suffix}"
        system, path = locate(folder)
        system.create_dir(path, recursive=True)
        self._sink = system.open_output_stream(f"{path}/{self.name}", compression=None)
        self.size = 0

    def write(self, data: bytes) -> int:
        at = self.size
        self._sink.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        self._sink.close()


def write_file(folder: str, stem: str, suffix: str, data: bytes) -> str:
    f = TaskFile(folder, stem, suffix)
    f.write(data)
    f.close()
    return f.name


def open_file(folder: str, name: str):
    system, path = locate(folder)
    return system.open_input_file(f"{path}/{name}")


def scan_partitions(df: DataFrame) -> int:
    """Number of partitions that Spark reads ``df`` in; it follows the size of the input."""
    return max(1, df.rdd.getNumPartitions())


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
