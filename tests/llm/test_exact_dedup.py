from __future__ import annotations

import hashlib
import random

import pytest

from tallyloom.llm import exact_dedup
from tallyloom.llm.exact_dedup import exact_duplicates


def brute(rows):
    groups = {}
    for number, text in rows:
        groups.setdefault(text or "", []).append(number)
    out = []
    for number, text in rows:
        ids = groups[text or ""]
        known = [i for i in ids if i is not None]
        out.append(
            (number, max(known) if known else None, len(ids), hashlib.sha256((text or "").encode()).hexdigest())
        )
    return sorted(out, key=str)


def check(rows, frame, scratch, block_bytes):
    got = exact_duplicates(frame, scratch, block_bytes=block_bytes).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in kept)


@pytest.mark.parametrize("block_bytes", [1, 4, 8192])
def test_equals_brute_force(documents, scratch, block_bytes):
    rnd = random.Random(block_bytes)
    texts = ["", "a", "é", "ab", "ba", "aab", "abab", "abba", "A", " a", "a\n", "abc" * 9, "abc" * 9 + "d", "日本語" * 5]
    rows = [(i, rnd.choice([*texts, None])) for i in range(120)]
    rows += [(None, "a"), (None, "only null id"), (7, "a"), (7, "a"), (7, "b")]
    check(rows, documents(rows), scratch, block_bytes)


def test_hot_blocks_are_named_in_parts(documents, scratch, monkeypatch):
    monkeypatch.setattr(exact_dedup, "PART_ROWS", 5)
    rows = [(i, "the same long text" if i % 3 else f"text {i}") for i in range(90)]
    check(rows, documents(rows), scratch, 4)


def test_parts_do_not_grow_with_the_table(spark, scratch, monkeypatch):
    monkeypatch.setattr(exact_dedup, "PART_ROWS", 50)
    kept, keep = [], scratch.keep

    def recording(frame):
        kept.append(keep(frame))
        return kept[-1]

    monkeypatch.setattr(scratch, "keep", recording)
    table = spark.range(12_000).selectExpr("id AS doc_id", "if(id % 3 = 0, concat('t', id), repeat('same ', 5)) AS text")
    got = exact_duplicates(table, scratch, block_bytes=8)
    assert got.filter("group_size = 8000").count() == 8000 and got.filter("kept").count() == 4001
    levels = [frame for frame in kept if "of_part" in frame.columns]
    for frame in levels:
        assert frame.groupBy("name").count().agg({"count": "max"}).first()[0] < 2 * 50
    # occurrences, their parts, and the parts of these: 24,000 -> 480 -> 10
    assert len(levels) >= 3


def test_long_text_among_short_ones(documents, scratch):
    long = "a passage that repeats, " * 20_000
    rows = [(1, long), (2, long + "x"), (3, long), (4, "short"), (5, None)]
    check(rows, documents(rows), scratch, 8192)


def test_empty_table(documents, scratch):
    assert exact_duplicates(documents([]), scratch).count() == 0
