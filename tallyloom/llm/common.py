"""What the operators of this folder share: table reading, written intermediate tables, hash keys."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.session import ensure_checkpoint_dir


PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    find_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def find_package(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever the driver was started from."""
    known = spark.sparkContext.environment
    paths = [path for path in known.get("PYTHONPATH", "").split(os.pathsep) if path]
    if PACKAGE_ROOT not in paths:
        known["PYTHONPATH"] = os.pathsep.join([*paths, PACKAGE_ROOT])


class Scratch:
    """Intermediate tables in the shared checkpoint folder.

    A table that is kept here is written once and read back, so its lineage ends there and a lost
    executor costs no more than the tasks that were running. The folder goes with the session, or
    earlier by `drop`, once nothing reads from it any more.
    """

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        find_package(spark)
        self.spark = spark
        self.folder = f"{spark.sparkContext.getCheckpointDir()}/llm-{uuid.uuid4().hex}"
        self._count = 0
        path, files = self._files()
        files.deleteOnExit(path)

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame) -> DataFrame:
        self._count += 1
        path = f"{self.folder}/{self._count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        path, files = self._files()
        files.delete(path, True)


def hash62(*columns: Column) -> Column:
    """A hash as a long that is never negative and leaves room for arithmetic."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 2)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the table does not have yet, whatever the case of its letters."""
    taken = {name.lower() for name in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted
