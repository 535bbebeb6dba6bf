from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyloom.llm.common import Scratch
from tallyloom.llm.packing import best_fit_plan, pack
from tallyloom.llm.queries import tokenizer
from tallyloom.llm.token_counts import count_tokens, read_cache
from tallyloom.llm.tokens import TokenIds

TEXTS = [
    "", " ", "  a", "a ", "a  b", "it's 's don't '''s", "<|endoftext|>", "a <|endoftext|> b", "日本語 テスト word",
    "x y z 　", "á ß ſ ĸ ½ ²", "\r\n \r\n", "emoji 😀 😀x", "\x85 x", "١٢٣ ab١", "é ", "word " * 300,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_ids_are_those_of_the_library(library):
    encoder = TokenIds(**tokenizer())
    rnd = random.Random(3)
    signs = list(" \n\t'sdtmrevlLAé1²½ª.,!<|>_日 \x85́😀")
    drawn = ["".join(rnd.choices(signs, k=rnd.randint(0, 40))) for _ in range(3000)]
    vocabulary = [library.decode([n]) for n in range(0, 50257, 7)]
    for text in [*TEXTS, *drawn, *vocabulary]:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids_of(library, text), repr(text)


def test_counts_and_cache(spark, documents, scratch, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(99, None), (None, "a "), (1, "a "), (1, "a ")]
    folder = f"{scratch.folder}/cache"
    got = count_tokens(documents(rows), folder, scratch, **tokenizer()).collect()
    wanted = [(i, len((t or "").encode()), len(ids_of(library, t))) for i, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(wanted, key=str)
    stored = read_cache(spark, folder)
    assert stored.count() == len({t or "" for _, t in rows})
    # a second run encodes only what is new
    again = count_tokens(documents([*rows, (100, "new")]), folder, scratch, **tokenizer())
    assert again.count() == len(rows) + 1
    assert read_cache(spark, folder).count() == stored.count() + 1
    assert count_tokens(documents([]), folder, scratch, **tokenizer()).count() == 0


def test_places_that_change_between_reads(spark, scratch, library):
    """After the first written table, files are split and ordered otherwise."""

    class Moving(Scratch):
        def keep(self, df):
            kept = super().keep(df)
            self.spark.conf.set("spark.sql.leafNodeDefaultParallelism", "1")
            return kept

    rows = [(i, f"text number {i % 40} " * (i % 7 + 1)) for i in range(80)]
    path = f"{scratch.folder}/given"
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6).write.parquet(path)
    try:
        got = count_tokens(spark.read.parquet(path), f"{path}-cache", Moving(spark), **tokenizer()).collect()
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert sorted(map(tuple, got)) == [(i, len(t), len(ids_of(library, t))) for i, t in rows]
    assert read_cache(spark, f"{path}-cache").count() == len({t for _, t in rows})


def test_packed_pieces(documents, scratch, library):
    rows = [(i, t) for i, t in enumerate(TEXTS * 4)] + [(99, None), (None, "a "), (1, "a "), (1, "a ")]
    got = pack(documents(rows), scratch, 16, 0, **tokenizer(), cell_rows=3).collect()
    wanted = []
    for number, text in rows:
        ids = [*ids_of(library, text), 0]
        bounds = sorted({0, *range(len(ids), 0, -16)})
        for piece, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            crc = zlib.crc32(np.array(ids[a:b], "<u4").tobytes())
            wanted.append((number, piece, a, b - a, crc))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(wanted, key=str)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 16
    assert pack(documents([]), scratch, 16, 0, **tokenizer()).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit_decreasing(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([5, 17, 64])
    histogram = {rnd.randint(1, capacity): rnd.choice([1, 2, 3, 50, 333]) for _ in range(20)}
    plan = best_fit_plan(histogram, capacity)
    used = {}
    for length, count in histogram.items():
        rows = plan[length]
        for rank in range(count):
            row = rows[np.searchsorted(rows[:, 0], rank, side="right") - 1]
            turn, item = divmod(rank - row[0], row[2])
            used.setdefault(int(row[1] + turn), []).append((int(row[3] + item * length), length))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    rooms = []  # one document after the other into the fullest sequence that takes it
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fitting = [r for r in rooms if r >= length]
            if fitting:
                rooms.remove(min(fitting))
                rooms.append(min(fitting) - length)
            else:
                rooms.append(capacity - length)
    assert len(used) == len(rooms)


