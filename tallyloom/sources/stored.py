"""Domain tables kept as Parquet snapshots: one folder per table below one snapshot folder."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from tallyloom.sources.lazy import LazyTables
from tallyloom.sources.schemas import TABLE_SCHEMAS
from tallyloom.sources.sinks import is_complete


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a snapshot, its columns in the declared order."""
    found = spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{folder}/{name}")
    declared = spark.createDataFrame([], TABLE_SCHEMAS[name]).columns
    return found.select(*[f"`{column}`" for column in declared])


class StoredTables(LazyTables):
    """All domain tables of one complete snapshot folder."""

    def __init__(self, spark: SparkSession, folder: str):
        if not is_complete(spark, folder):
            raise FileNotFoundError(f"no complete snapshot: {folder}")
        super().__init__(
            {name: partial(read_table, spark, folder, name) for name in TABLE_SCHEMAS}
        )


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLE_SCHEMAS[name])
