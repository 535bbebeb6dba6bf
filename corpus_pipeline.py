"""From raw documents to packed training sequences.

Each stage takes the session, the documents that its predecessor kept, and the folder of the given
tables. Its result is written as Parquet before the next stage starts, which therefore may remove
the tables that the one before it has kept in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import decontamination, exact_dedup, jaccard_join, packing, quality
from tallyloom.llm.common import Scratch, free_name, read_table
from tallyloom.llm.queries import END_ID, SEQUENCE_TOKENS, tokenizer

REJECT_FROM = 0.7

_finished: dict[str, Scratch] = {}


def _scratch(spark: SparkSession) -> Scratch:
    """A new scratch for this stage; the previous stage's result is written, so its own can go."""
    application = spark.sparkContext.applicationId
    if application in _finished:
        _finished.pop(application).drop()
    _finished[application] = Scratch(spark)
    return _finished[application]


def _rows_of(docs: DataFrame, numbered: DataFrame, row: str, kept: DataFrame) -> DataFrame:
    return numbered.join(kept.select(F.col("row").alias(row)), row, "left_semi").select(*docs.columns)


def _numbered(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """Rows get a number and are written with it: a place in the input may differ in every read."""
    row = free_name(docs, "row_number")
    return scratch.keep(docs.withColumn(row, F.monotonically_increasing_id())), row


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. Nulls and empty texts stay."""
    model = quality.train(docs, _scratch(spark))
    return docs.filter(model.score(F.col("text")) < REJECT_FROM)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null counts as empty), the row with the largest id."""
    scratch = _scratch(spark)
    numbered, row = _numbered(docs, scratch)
    found = exact_dedup.exact_duplicates(numbered, scratch, row=row)
    return _rows_of(docs, numbered, row, found.filter("kept"))


def keep_dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the row with the smallest id; what has no words stays."""
    scratch = _scratch(spark)
    numbered, row = _numbered(docs, scratch)
    found = jaccard_join.similar_components(numbered, scratch, doc_id=row)
    groups = scratch.keep(found.select(F.col("doc_id").alias(row), F.col("component_id").alias("group")))
    best = (
        numbered.select("doc_id", row)
        .join(groups, row)
        .groupBy("group")
        .agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(row).alias("row"))).alias("best"))
    )
    return _rows_of(docs, numbered, row, best.select("best.row"))


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item to the threshold. Null and empty texts stay, repeated rows
    stay or go together; with an empty benchmark all stay, of an empty table nothing."""
    benchmark = read_table(spark, sf_dir, "benchmark")
    return decontamination.without_contaminated(docs, benchmark, scratch=_scratch(spark))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their places in sequences. A null or empty text is one piece
    of the end id, repeated rows are packed each, an empty table gives no piece."""
    return packing.pack(docs, _scratch(spark), SEQUENCE_TOKENS, END_ID, **tokenizer())


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", keep_distinct),
    ("n-gram Jaccard join", keep_dissimilar),
    ("benchmark decontamination", keep_uncontaminated),
    ("best-fit packing", pack_sequences),
]

# A trained classifier has no SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = read_table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        store = Scratch(spark)
        docs = store.keep(stage(spark, docs, sf_dir))
        if written:
            written.drop()
        written = store
    return STAGES[-1][1](spark, docs, sf_dir)
