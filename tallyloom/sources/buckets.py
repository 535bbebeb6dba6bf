"""Tables kept in buckets of a key, so that a change writes the buckets it touches and no others.

A snapshot is a folder with a manifest: for every table and bucket, the folder that holds its rows,
which may belong to an earlier snapshot. Nothing is ever written in place. A snapshot counts once
its marker file is there; what a failed job leaves behind is not looked at, and the snapshot before
it stays readable throughout.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources.lazy import LazyTables
from tallyloom.sources.schemas import TABLE_SCHEMAS
from tallyloom.sources.sinks import folders_in, is_complete, mark_complete

# Fixed for the life of a set of snapshots; a bucket that outgrows one task is split when written.
BUCKETS = 256

# Tables written at the same time.
WRITERS = 4

MANIFEST_SCHEMA = "table string, bucket int, folder string, buckets int"

Manifest = dict[tuple[str, int], str]


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("bigint")), F.lit(buckets)).cast("int")


def _write_table(table: DataFrame, key: str, buckets: int, folder: str) -> None:
    """A folder per bucket. Small buckets share a task, large ones are dealt to several."""
    placed = table.withColumn("bucket", bucket_of(F.col(key), buckets))
    placed.hint("rebalance", F.col("bucket")).write.mode("errorifexists").partitionBy("bucket").parquet(folder)


def _write_tables(tables: Mapping[str, DataFrame], keys: Mapping[str, str], buckets: int, folder: str) -> None:
    """Tables do not depend on each other; small ones leave room for the jobs of others."""

    def write(table: str) -> None:
        _write_table(tables[table], keys[table], buckets, f"{folder}/{table}")

    with ThreadPoolExecutor(WRITERS) as pool:
        list(pool.map(write, tables))


def _commit(spark: SparkSession, root: str, name: str, manifest: Manifest, buckets: int) -> None:
    rows = [(table, bucket, folder, buckets) for (table, bucket), folder in sorted(manifest.items())]
    rows.append(("", -1, "", buckets))  # says how many buckets there are even if all are empty
    frame = spark.createDataFrame(rows, MANIFEST_SCHEMA).coalesce(1)
    frame.write.mode("errorifexists").parquet(f"{root}/{name}/manifest")
    mark_complete(spark, f"{root}/{name}")


def _written(spark: SparkSession, root: str, name: str, tables: Iterable[str]) -> Manifest:
    found = {}
    for table in tables:
        for folder in folders_in(spark, f"{root}/{name}/{table}"):
            if folder.startswith("bucket="):
                found[table, int(folder.removeprefix("bucket="))] = f"{name}/{table}/{folder}"
    return found


def write_buckets(
    tables: Mapping[str, DataFrame], keys: Mapping[str, str], root: str, name: str, buckets: int = BUCKETS
) -> None:
    """The first snapshot: every table whole, dealt by its key in ``keys``."""
    if tables:
        spark = tables[next(iter(tables))].sparkSession
        _write_tables(tables, keys, buckets, f"{root}/{name}")
        _commit(spark, root, name, _written(spark, root, name, tables), buckets)


class BucketedTables(LazyTables):
    """The tables of one complete snapshot. The manifest is one row per table and bucket."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        if not is_complete(spark, f"{root}/{name}"):
            raise FileNotFoundError(f"no complete snapshot: {root}/{name}")
        rows = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{root}/{name}/manifest").collect()
        self.spark, self.root, self.name = spark, root, name
        self.buckets = rows[0].buckets
        self.manifest: Manifest = {(r.table, r.bucket): r.folder for r in rows if r.table}
        super().__init__(self._builders_for(None))

    def _builders_for(self, numbers: frozenset[int] | None) -> dict:
        return {table: partial(self._read, table, numbers) for table in TABLE_SCHEMAS}

    def _read(self, table: str, numbers: frozenset[int] | None) -> DataFrame:
        folders = [
            f"{self.root}/{folder}"
            for (name, bucket), folder in self.manifest.items()
            if name == table and (numbers is None or bucket in numbers)
        ]
        empty = self.spark.createDataFrame([], TABLE_SCHEMAS[table])
        if not folders:
            return empty
        found = self.spark.read.schema(TABLE_SCHEMAS[table]).parquet(*folders)
        return found.select(*[f"`{column}`" for column in empty.columns])

    def touched(self, ids: DataFrame, key: str) -> frozenset[int]:
        """The buckets of some keys; never more numbers than there are buckets."""
        numbers = ids.select(bucket_of(F.col(key), self.buckets).alias("bucket")).distinct()
        return frozenset(row.bucket for row in numbers.collect())

    def only(self, numbers: frozenset[int]) -> LazyTables:
        """The tables with the rows of these buckets; no other file is read."""
        return LazyTables(self._builders_for(numbers))

    def write_changed(
        self, changed: Mapping[str, DataFrame], keys: Mapping[str, str], numbers: frozenset[int], name: str
    ) -> None:
        """A new snapshot in which these buckets hold ``changed``, and all others what they held."""
        _write_tables(changed, keys, self.buckets, f"{self.root}/{name}")
        written = _written(self.spark, self.root, name, changed)
        if strange := {bucket for _, bucket in written} - numbers:
            raise ValueError(f"rows of buckets that were not to change: {sorted(strange)}")
        kept = {
            place: folder
            for place, folder in self.manifest.items()
            if place[0] not in changed or place[1] not in numbers
        }
        _commit(self.spark, self.root, name, kept | written, self.buckets)
