from __future__ import annotations

import random

import numpy as np
import pytest

from tallyloom.llm.decontamination import contaminated, tile, without_contaminated

ITEM = "one two three four five six seven eight nine ten eleven twelve"


def naive_tiles(text, item, least):
    """The longest common free run, the first in the text, again and again."""
    marked = [False] * len(text), [False] * len(item)
    total = []
    while True:
        best = (0, 0, 0)
        for a in range(len(text)):
            for b in range(len(item)):
                n = 0
                while (
                    a + n < len(text) and b + n < len(item) and text[a + n] == item[b + n]
                    and not marked[0][a + n] and not marked[1][b + n]
                ):
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        n, a, b = best
        if n < least:
            return total
        total.append((a, b, n))
        marked[0][a : a + n] = [True] * n
        marked[1][b : b + n] = [True] * n


@pytest.mark.parametrize("seed", range(30))
def test_tiles_equal_brute_force(seed):
    rnd = random.Random(seed)
    letters = rnd.choice([2, 3, 5])
    text = [rnd.randrange(letters) for _ in range(rnd.randint(0, 40))]
    item = [rnd.randrange(letters) for _ in range(rnd.randint(0, 25))]
    got = tile(np.array(text, np.uint64), np.array(item, np.uint64), 3)
    assert got == naive_tiles(text, item, 3)


def check(rows, items, spark, documents, **more):
    benchmark = spark.createDataFrame(items, "item_id bigint, text string, doc_id string")
    got = contaminated(documents(rows), benchmark, **more)
    left = without_contaminated(documents(rows), benchmark, **more)
    return sorted((str(r.doc_id), str(r.item_id), r.covered, r.n_tiles) for r in got.collect()), left


@pytest.mark.parametrize("block_words", [1, 1_000_000])
def test_exact_reordered_and_partial(spark, documents, block_words):
    words = ITEM.split()
    reordered = " ".join([*words[6:], "and", *words[:6]])
    rows = [
        (1, f"before {ITEM.upper()} after"),
        (2, f"x {reordered} y"),
        (3, "a " + " ".join(words[:5]) + " b"),
        (4, "nothing of it"),
        (5, None),
        (6, ""),
        (None, ITEM),
        (7, ITEM),
        (7, ITEM),
        (8, " ".join(words[:5]) + " x " + " ".join(words[:5])),  # each word of the item counts once
    ]
    items = [(1, ITEM, "z"), (2, "not here", "z"), (3, None, "z"), (4, "", None), (5, "!?", "z")]
    got, left = check(rows, items, spark, documents, block_words=block_words)
    assert got == [("1", "1", 12, 1), ("2", "1", 12, 2), ("7", "1", 12, 1), ("7", "1", 12, 1), ("None", "1", 12, 1)]
    assert sorted(str(r.doc_id) for r in left.collect()) == ["3", "4", "5", "6", "8"]
    assert left.columns == documents(rows).columns


@pytest.mark.parametrize("block_words", [1, 6, 1_000_000])
def test_short_items_are_found_whole(spark, documents, block_words):
    rows = [
        (1, "the Answer"),
        (2, "so forty-two is it"),
        (3, "forty and two"),
        (4, "w x y z"),
        (5, "x y z w"),
        (6, ITEM),
        (7, None),
        (8, "forty two forty two"),
    ]
    items = [(1, "answer", "z"), (2, "forty two", "z"), (3, "w x y z", "z"), (4, ITEM, "z"), (4, "answer!", "z")]
    got, left = check(rows, items, spark, documents, block_words=block_words)
    assert got == [
        ("1", "1", 1, 1), ("1", "4", 1, 1), ("2", "2", 2, 1), ("4", "3", 4, 1), ("6", "4", 12, 1), ("8", "2", 2, 1),
    ]
    assert sorted(r.doc_id for r in left.collect()) == [3, 5, 7]


def test_very_long_text(spark, documents):
    filler = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, f"{filler} {ITEM} {filler}"), (2, filler)]
    got, left = check(rows, [(1, ITEM, "z")], spark, documents)
    assert got == [("1", "1", 12, 1)] and [r.doc_id for r in left.collect()] == [2]


def test_a_block_is_taken_back_before_the_next(spark, documents, monkeypatch):
    alive, most = [], []
    broadcast = spark.sparkContext.broadcast

    def sent(value):
        found = broadcast(value)
        alive.append(found)
        most.append(len(alive))
        destroy = found.destroy
        found.destroy = lambda *given: (alive.remove(found), destroy(*given))
        return found

    monkeypatch.setattr(spark.sparkContext, "broadcast", sent)
    items = [(i, f"a{i} b{i} c{i} d{i} e{i} f{i}", "z") for i in range(5)]
    rows = [(i, f"x {items[i][1]} y") for i in range(5)] + [(9, "clean")]
    got, left = check(rows, items, spark, documents, block_words=6)
    assert len(got) == 5 and [r.doc_id for r in left.collect()] == [9]
    assert max(most) <= 2  # the last one of each call stays


def test_empty_tables(spark, documents):
    got, left = check([(1, ITEM)], [], spark, documents)
    assert got == [] and left.count() == 1
    got, left = check([], [(1, ITEM, "z")], spark, documents)
    assert got == [] and left.count() == 0


def test_random_texts_equal_brute_force(spark, documents):
    rnd = random.Random(9)
    items = [(i, " ".join(rnd.choices("abcdefgh", k=12)), "z") for i in range(4)]
    short = [(10 + i, " ".join(rnd.choices("abcdefgh", k=i)), "z") for i in (1, 2, 3)]
    rows = []
    for i in range(40):
        words = rnd.choices("abcdefgh", k=30)
        item = rnd.choice(items)[1].split()
        a = rnd.randint(0, 11)
        words[5:5] = item[a:]
        words[20:20] = item[:a]
        rows.append((i, " ".join(words)))
    got, _ = check(rows, items + short, spark, documents, least=3, threshold=0.4)
    wanted = []
    for i, text in rows:
        for number, item, _ in items + short:
            size = len(item.split())
            tiles = naive_tiles(text.split(), item.split(), min(3, size))
            covered = sum(t[2] for t in tiles)
            if covered >= 0.4 * size:
                wanted.append((str(i), str(number), covered, len(tiles)))
    assert got == sorted(wanted)
