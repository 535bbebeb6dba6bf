from __future__ import annotations

import hashlib
import os

import pytest
import test_jaccard_join as near
from pyspark.sql import functions as F
from test_decontamination import naive_tiles

import corpus_pipeline
from tallyloom.llm import decontamination, quality
from tallyloom.llm.common import Scratch, read_table
from tallyloom.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are missing")


def stages(spark, docs):
    """Each stage's documents, written and read again, the last one's pieces at the end."""
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = Scratch(spark).keep(stage(spark, docs, FOLDER))
        out.append(docs)
    return out


def test_stages_equal_brute_force(spark):
    documents = read_table(spark, FOLDER, "documents")
    good, distinct, dissimilar, clean, pieces = stages(spark, documents)

    model = quality.train(documents, Scratch(spark))
    kept = documents.filter(model.score(F.col("text")) < corpus_pipeline.REJECT_FROM)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(good) == ids(kept)

    texts = {r.doc_id: r.text or "" for r in good.collect()}
    last = {text: number for number, text in sorted(texts.items())}
    assert ids(distinct) == set(last.values())

    rows = [(n, texts[n]) for n in sorted(ids(distinct))]
    assert ids(dissimilar) == {number for number, _, root in near.brute(rows) if number == root}

    items = [decontamination.word_hashes(r.text.lower()).tolist() for r in read_table(spark, FOLDER, "benchmark").collect()]
    left = set()
    for number in ids(dissimilar):
        words = decontamination.word_hashes(texts[number].lower()).tolist()
        runs = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        covered = [
            sum(t[2] for t in naive_tiles(words, item, 5)) >= 0.5 * len(item)
            for item in items
            if any(tuple(item[i : i + 5]) in runs for i in range(len(item) - 4))
        ]
        if not any(covered):
            left.add(number)
    assert ids(clean) == left

    assert {r.doc_id for r in pieces.collect()} == left
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").isEmpty()
    for stage in (good, distinct, dissimilar, clean):
        assert stage.schema == documents.schema
        assert all(r.text == texts.get(r.doc_id, r.text) for r in stage.collect())
    assert corpus_pipeline.run(spark, FOLDER).count() == pieces.count()


def test_stages_on_nulls_repeats_and_clashing_names(spark):
    columns = "doc_id bigint, text string, row_number bigint, ROW string, score double"
    rows = [
        (1, None, 1, "a", 0.5), (2, "", 1, None, None), (None, "some words of a text here", 2, "b", 1.0),
        (3, "some words of a text here", 2, "b", 1.0), (3, "some words of a text here", 2, "b", 1.0),
        (3, "other words under the same number", 3, "c", None), (4, "long " * 9000, 4, "d", 2.0),
    ]
    for given in (rows, []):
        docs = spark.createDataFrame(given, columns)
        path = f"{Scratch(spark).folder}/given"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        for name, stage in corpus_pipeline.STAGES:
            result = stage(spark, docs, FOLDER)
            assert result.count() <= len(given) or name == "best-fit packing"
            if name != "best-fit packing":
                assert result.columns == docs.columns
        assert stages(spark, docs)[-1].count() >= min(1, len(given))
    distinct = {(r.doc_id, r.text) for r in corpus_pipeline.keep_distinct(spark, spark.read.parquet(path), FOLDER).collect()}
    assert distinct == set()


def test_repeated_rows_leave_one(spark):
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (5, None), (6, "")]
    path = f"{Scratch(spark).folder}/given"
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    kept = sorted((r.doc_id, r.text) for r in corpus_pipeline.keep_distinct(spark, docs, FOLDER).collect())
    assert kept == [(3, "a b c d e f"), (6, "")]
    kept = sorted(str(r.doc_id) for r in corpus_pipeline.keep_dissimilar(spark, docs, FOLDER).collect())
    assert kept == ["3", "5", "6"]


@pytest.mark.parametrize("stage", [corpus_pipeline.keep_distinct, corpus_pipeline.keep_dissimilar])
def test_places_that_change_between_reads(spark, stage):
    """Before the result is read, files are split and ordered otherwise."""
    rows = [(i, " ".join(f"w{i % 20}x{n}" for n in range(i % 20 + 5))) for i in range(60)]
    path = f"{Scratch(spark).folder}/given"
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6).write.parquet(path)
    kept = stage(spark, spark.read.parquet(path), FOLDER)
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "1")
    try:
        got = kept.collect()
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    first = 40 if stage is corpus_pipeline.keep_distinct else 0
    assert sorted((r.doc_id, r.text) for r in got) == rows[first : first + 20]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_equal_sql(spark, name):
    from compare import duckdb_over, duckdb_rows, spark_rows

    assert spark_rows(QUERIES[name](spark, FOLDER)) == duckdb_rows(duckdb_over(FOLDER), ORACLE_SQL[name])


def test_digest_queries_on_given_tables(spark):
    documents = {r.doc_id: r.text or "" for r in read_table(spark, FOLDER, "documents").collect()}
    sharded = QUERIES["op1_sharding"](spark, FOLDER).collect()
    assert {r.doc_id for r in sharded} == set(documents) and len(sharded) == len(documents)
    import zlib

    assert all(r.text_crc32 == zlib.crc32(documents[r.doc_id].encode()) for r in sharded)
    assert all(r.size == len(documents[r.doc_id].encode()) + 8 for r in sharded)
    hashes = {r.doc_id: r.text_sha256 for r in QUERIES["op6_exact_dedup"](spark, FOLDER).collect()}
    assert hashes == {n: hashlib.sha256(t.encode()).hexdigest() for n, t in documents.items()}
