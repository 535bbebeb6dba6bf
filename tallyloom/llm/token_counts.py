"""Token counts with a digest cache.

The cache is a stored table (text_digest, tokenizer_digest, n_tokens). Texts are looked up by the
digest of their content and of the tokenizer file; only distinct misses are encoded, and appended
to the cache. Nothing but digests is shuffled for the look-up. Where digests are missed, the texts are
read again and found by their digest, of equal texts of a task one; no place in the input is used.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import Scratch
from tallyloom.llm.tokens import loaded

MOST_SEEN = 1_000_000
CACHE_SCHEMA = "text_digest binary, tokenizer_digest string, n_tokens bigint"


def tokenizer_digest(tokenizer_file: str) -> str:
    """The version of a tokenizer is the content of its file."""
    with open(tokenizer_file, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def read_cache(spark: SparkSession, folder: str) -> DataFrame:
    """The cache; a folder that does not exist yet is an empty one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(folder)


def count_tokens(
    documents: DataFrame,
    cache_folder: str,
    scratch: Scratch,
    tokenizer_file: str,
    ranks_file: str | None = None,
    pattern: str | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens. Null counts as the empty text.

    The input is read twice and must give the same texts, in any order. Content is looked up byte for
    byte (a normal form would change counts). Repeated rows and null or repeated ids keep their rows; a
    text that the second read no longer gives has a null count. Two runs that append to one cache at the same time may store
    a count twice; the look-up reads it once.
    """
    spark = documents.sparkSession
    version = tokenizer_digest(tokenizer_file)
    texts = documents.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).withColumn("text_digest", F.unhex(F.sha2("text", 256)))
    wanted = scratch.keep(
        texts.select("doc_id", "text_digest", F.octet_length("text").cast("long").alias("n_bytes"))
    )
    stored = read_cache(spark, cache_folder).filter(F.col("tokenizer_digest") == version)
    missed = scratch.keep(
        wanted.select("text_digest")
        .distinct()
        .join(stored.select("text_digest"), "text_digest", "left_anti")
    )
    if not missed.isEmpty():
        # one plan at every size: a join that broadcasts small inputs would grow in a leap
        once = texts.select("text_digest", "text").mapInArrow(_first_of_task, "text_digest binary, text string")
        chosen = once.join(missed.hint("merge"), "text_digest", "left_semi")
        encoded = chosen.groupBy("text_digest").agg(F.first("text").alias("text"))
        encoded = encoded.mapInArrow(
            _counter(tokenizer_file, ranks_file, pattern), "text_digest binary, n_tokens bigint"
        )
        encoded.select("text_digest", F.lit(version).alias("tokenizer_digest"), "n_tokens").write.mode(
            "append"
        ).parquet(cache_folder)
    counts = scratch.keep(
        read_cache(spark, cache_folder)
        .filter(F.col("tokenizer_digest") == version)
        .groupBy("text_digest")
        .agg(F.max("n_tokens").alias("n_tokens"))
    )
    # both sides are stored tables, so a partition that a frequent text fills is split while it runs
    return wanted.join(counts, "text_digest", "left").select("doc_id", "n_bytes", "n_tokens")


def _first_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves copies out, so a frequent text is moved once a task; what slips through does no harm."""
    seen: set[bytes] = set()
    for batch in batches:
        if len(seen) > MOST_SEEN:
            seen.clear()
        new = []
        for digest in batch.column("text_digest").to_pylist():
            new.append(digest not in seen)
            seen.add(digest)
        yield batch if all(new) else batch.filter(pa.array(new, pa.bool_()))


def _counter(tokenizer_file: str, ranks_file: str | None, pattern: str | None):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = loaded(tokenizer_file, ranks_file, pattern).encode
        for batch in batches:
            numbers = [len(encode(text.as_py())) // 4 for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("text_digest"), pa.array(numbers, pa.int64())],
                names=["text_digest", "n_tokens"],
            )

    return count
