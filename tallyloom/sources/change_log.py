"""A log of changes that holds every batch once, however often its job runs.

An attempt writes the rows of a batch into a folder of its own and then, in one step, an empty marker
file that names batch and attempt. Readers take the marked attempts, one per batch. A job that was
killed before its marker left rows that nobody reads; one that runs again after it writes nothing.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from tallyloom.sources.sinks import create_empty, files_in

MARKERS = "_committed"


def _attempts(spark: SparkSession, path: str) -> dict[str, str]:
    """Committed batches, each with one attempt: of two that ran at once, the same for every reader."""
    found: dict[str, str] = {}
    for marker in sorted(files_in(spark, f"{path}/{MARKERS}")):
        batch, _, attempt = marker.rpartition("=")
        if batch:
            found.setdefault(batch, attempt)
    return found


def append_change_log(changes: DataFrame, path: str, batch: str) -> bool:
    """Adds the rows of a batch unless that batch is in the log already; whether it did.

    ``batch`` names what the job works on (a delivery, a day), not the run: a repeated run has the
    same. An empty batch counts as added, too.
    """
    if not re.fullmatch(r"[\w.-]+", batch):
        raise ValueError(f"a batch is named by letters, digits, '_', '.' and '-': {batch!r}")
    spark = changes.sparkSession
    if batch in _attempts(spark, path):
        return False
    attempt = uuid.uuid4().hex
    changes.write.mode("errorifexists").parquet(f"{path}/{batch}/{attempt}")
    create_empty(spark, f"{path}/{MARKERS}/{batch}={attempt}")
    return True


def read_change_log(spark: SparkSession, path: str, schema: str, batches: list[str] | None = None) -> DataFrame:
    """The rows of all committed batches, or of those named that are committed."""
    attempts = _attempts(spark, path)
    wanted = attempts if batches is None else [batch for batch in dict.fromkeys(batches) if batch in attempts]
    folders = [f"{path}/{batch}/{attempts[batch]}" for batch in wanted]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders)


def committed_batches(spark: SparkSession, path: str) -> list[str]:
    return sorted(_attempts(spark, path))
