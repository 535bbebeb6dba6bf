"""Writes. A table is never overwritten in place: a replace job writes a new snapshot folder."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

# Columns by which reports and look-ups choose rows; their values are folders of a snapshot.
PARTITIONED_BY = {"daily_schedules": ["date"], "monthly_payments": ["year", "month"]}

MARKER = "_COMPLETE"


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def is_complete(spark: SparkSession, folder: str) -> bool:
    path, files = _path(spark, f"{folder}/{MARKER}")
    return files.exists(path)


def write_snapshot(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Write every table below a new folder; an existing one is an error, so inputs stay whole.

    A marker file is written last. Without it the folder is what a failed write left behind, and
    readers refuse it.
    """
    spark = None
    for name, frame in tables.items():
        spark = frame.sparkSession
        writer = frame.write.mode("errorifexists")
        if name in PARTITIONED_BY:
            keys = PARTITIONED_BY[name]
            # one task writes a few folders instead of every task all of them
            writer = frame.repartition(*keys).write.mode("errorifexists").partitionBy(*keys)
        writer.parquet(f"{folder}/{name}")
    if spark is not None:
        mark_complete(spark, folder)


def mark_complete(spark: SparkSession, folder: str) -> None:
    create_empty(spark, f"{folder}/{MARKER}")


def create_empty(spark: SparkSession, name: str) -> None:
    path, files = _path(spark, name)
    files.create(path).close()


def _names_in(spark: SparkSession, folder: str, folders: bool) -> list[str]:
    path, files = _path(spark, folder)
    if not files.exists(path):
        return []
    return [s.getPath().getName() for s in files.listStatus(path) if s.isDirectory() == folders]


def folders_in(spark: SparkSession, folder: str) -> list[str]:
    return _names_in(spark, folder, True)


def files_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files in a folder, checksums of the local file system aside."""
    return [name for name in _names_in(spark, folder, False) if not name.endswith(".crc")]


def write_searchable(table: DataFrame, path: str) -> None:
    """Parquet with a bloom filter on every text column: a search for one value skips the row groups
    that cannot hold it."""
    writer = table.write.mode("errorifexists")
    for name, kind in table.dtypes:
        if kind == "string":
            writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
    writer.parquet(path)


def write_export(export: DataFrame, path: str, form: str = "csv") -> None:
    """Write an export with its headings; ``form`` is ``csv`` or ``parquet``."""
    if form == "csv":
        export.write.mode("errorifexists").csv(path, header=True)
    elif form == "parquet":
        export.write.mode("errorifexists").parquet(path)
    else:
        raise ValueError(f"unknown export form: {form}")
