from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import quality
from tallyloom.llm.common import read_table
from tallyloom.llm.quality import ABSTAIN, BAD, GOOD, HEURISTICS, classify, estimate, train

FOLDER = "/root/testdata/sf0.01"


def code(votes):
    return sum(vote * 3**n for n, vote in enumerate(votes))


def test_estimate_finds_bad_patterns_and_ignores_abstentions():
    good = [GOOD] * HEURISTICS
    one_bad = [BAD, *good[1:]]
    two_bad = [GOOD, BAD, BAD, *good[3:]]
    silent = [ABSTAIN] * HEURISTICS
    found = estimate({code(good): 900, code(one_bad): 40, code(two_bad): 40, code(silent): 20})
    assert found[code(good)] < 0.05 and found[code(silent)] < 0.3
    assert found[code(one_bad)] > 0.9 and found[code(two_bad)] > 0.9
    assert estimate({}) == {}


def test_measures_of_one_slice():
    texts = [b"a a A b\nx\nx\n", b"", b"!!! ***", b"a"]
    offsets = np.cumsum([0, *map(len, texts)])
    m = quality.measure(np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert m.n_words.tolist() == [6, 0, 2, 1]
    assert m.repeated_words.tolist() == [3, 0, 0, 0]
    assert m.distinct_words.tolist() == [3, 0, 2, 1]
    assert m.n_lines.tolist() == [3, 0, 1, 1] and m.distinct_lines.tolist() == [2, 0, 1, 1]
    assert m.kinds.sum(1).tolist() == [len(t) for t in texts]


def test_every_row_has_a_score(documents, scratch):
    prose = "The quick brown fox jumps over the lazy dog and runs far away into the dark wood. "
    rows = [(i, prose * (1 + i % 3) + f"number {i} is here") for i in range(40)]
    rows += [(100 + i, "BUY!! " * 30 + "*** $$$ ") for i in range(10)]
    rows += [(200, None), (201, ""), (None, prose), (0, prose), (0, prose), (202, "é" * 5000)]
    got = classify(documents(rows), scratch).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.kept == (r.score < 0.7) for r in got)
    assert all(r.kept for r in got if r.doc_id is not None and r.doc_id < 40)
    assert not any(r.kept for r in got if r.doc_id is not None and 100 <= r.doc_id < 110)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are missing")
def test_scores_do_not_depend_on_files_or_order(spark, scratch):
    table = read_table(spark, FOLDER, "documents")
    found = []
    for number in (1, 7, 30):
        cut = scratch.keep(table.repartition(number, F.xxhash64("doc_id", F.lit(number))))
        found.append({r.doc_id: (r.score, r.kept) for r in classify(cut, scratch).collect()})
    assert len(found[0]) == table.count()
    assert found[0] == found[1] == found[2]


def test_a_text_that_repeats_is_one_of_the_sample(documents, scratch):
    """A third of all rows are one text: it neither fills nor empties the sample."""
    prose = "The quick brown fox jumps over the lazy dog and runs far away into the dark wood. "
    rows = [(i, prose + f"number {i} is here and then some {i * 7}") for i in range(60)]
    rows += [(100 + i, f"BUY!! WIN{i}!! " * 30 + "*** $$$ ") for i in range(15)]
    once = train(documents(rows + [(900, prose)]), scratch)
    often = train(documents(rows + [(900 + i, prose) for i in range(40)]), scratch)
    table = documents(rows)
    for model in (once, often):
        kept = {r.doc_id: r.score < 0.7 for r in table.select("doc_id", model.score(F.col("text")).alias("score")).collect()}
        assert all(kept[i] == (i < 100) for i in kept)


def test_features_of_many_short_texts_are_made_in_parts(monkeypatch):
    import pyarrow as pa

    made = []

    def one(data, offsets):
        made.append(len(offsets) - 1)
        return quality._features(data, offsets)

    texts = pa.array([f"text {i} of it" for i in range(1000)] + ["", None])
    whole = quality._by_slice(texts, (quality.DIMENSIONS,), np.float32, one)
    assert max(made) <= quality.ROWS_AT_ONCE and sum(made) == 1002
    single = [quality._by_slice(texts[i : i + 1], (quality.DIMENSIONS,), np.float32, quality._features)[0] for i in (0, 300, 999, 1000, 1001)]
    assert (whole[[0, 300, 999, 1000, 1001]] == np.array(single)).all()


def test_empty_table(documents, scratch):
    assert classify(documents([]), scratch).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are missing")
def test_accuracy_against_labels_never_seen(spark, scratch):
    documents = read_table(spark, FOLDER, "documents")
    model = train(documents, scratch)
    labelled = documents.join(read_table(spark, FOLDER, "labels"), "doc_id")
    scored = labelled.select("quality", (model.score(F.col("text")) < 0.7).alias("kept"))
    counts = {(r.quality, r.kept): r["count"] for r in scored.groupBy("quality", "kept").count().collect()}
    bad = counts.get((0, False), 0) / (counts.get((0, False), 0) + counts.get((0, True), 0))
    good = counts.get((1, True), 0) / (counts.get((1, True), 0) + counts.get((1, False), 0))
    assert bad > 0.9 and good > 0.995
