from __future__ import annotations

import random
import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from tallyloom.llm import jaccard_join
from tallyloom.llm.components import connected_components
from tallyloom.llm.jaccard_join import count_vector, similar_components, survivors

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    sets = [shingles(text) for _, text in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                parent[find(i)] = find(j)
    smallest = {}
    for i, (number, _) in enumerate(rows):
        if number is not None:
            root = find(i)
            smallest[root] = min(number, smallest.get(root, number))
    return sorted(
        ((n, len(s), smallest.get(find(i)) if s else n) for i, ((n, _), s) in enumerate(zip(rows, sets, strict=True))),
        key=str,
    )


def near_copies(seed, families=6, members=12):
    rnd = random.Random(seed)
    rows, number = [], 0
    for _ in range(families):
        base = [rnd.choice("abcdefghij") * rnd.randint(1, 3) for _ in range(rnd.randint(8, 60))]
        for _ in range(members):
            words = list(base)
            for _ in range(rnd.randint(0, 3)):
                words[rnd.randrange(len(words))] = rnd.choice("xyz")
            if rnd.random() < 0.3:
                words = words[rnd.randint(0, 6) :]
            rows.append((number, rnd.choice([" ", "\n", "\t "]).join(words)))
            number += 1
    rnd.shuffle(rows)
    return rows


def run(documents, scratch, rows):
    got = similar_components(documents(rows), scratch).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(documents, scratch, seed):
    rows = near_copies(seed)
    assert run(documents, scratch, rows) == brute(rows)


def test_long_lists_are_cut_without_loss(documents, scratch, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LIST_ROWS", 5)
    rows = near_copies(3, families=3, members=25)
    assert run(documents, scratch, rows) == brute(rows)


def test_edges_of_the_domain(documents, scratch):
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "One  TWO"), (6, "one two three four"),
        (7, "É a b c d"), (8, "é a b c d"), (9, "a b c d e"), (9, "a b c d e"), (None, "a b c d e"),
        (10, "word " * 20_000), (11, "word " * 20_001), (None, "only null"), (12, "x y z"),
    ]
    assert run(documents, scratch, rows) == brute(rows)
    assert run(documents, scratch, []) == []


def test_bound_never_loses_a_link():
    rnd = np.random.default_rng(1)
    sets = []
    for _ in range(40):
        base = np.unique(rnd.integers(0, 1 << 62, rnd.integers(1, 300), np.uint64))
        sets += [base, np.unique(rnd.permutation(base)[: max(1, int(len(base) * rnd.uniform(0.7, 1)))])]
    pairs = survivors([count_vector(s) for s in sets], [len(s) for s in sets], range(len(sets)), [0] * len(sets), False)
    let_through = {frozenset(p) for p in pairs}
    links = 0
    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(np.intersect1d(a, sets[j]))
            if 100 * shared >= 75 * (len(a) + len(sets[j]) - shared):
                links += 1
                assert frozenset((i, j)) in let_through
    assert links > 20


@pytest.mark.parametrize("per_task", [10, 200_000])
def test_components(spark, scratch, per_task):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), scratch, per_task).collect()))
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert got == {n: find(n) for n in parent}


def test_vectors_bound_counts_they_cannot_hold():
    same = np.arange(40, dtype=np.uint64) << np.uint64(26)  # one group of sixteen
    few = np.unique(np.concatenate([same[:20], np.arange(1 << 21, 3 << 21, 1 << 20, dtype=np.uint64)]))
    for width in (16, 32):
        assert jaccard_join.folded(count_vector(np.sort(same))[:32], width).max() >= 40
    assert jaccard_join.folded(count_vector(few), 16).sum() >= len(few)


def test_nul_is_part_of_a_word(documents, scratch):
    rows = [(1, "a b c d e f"), (2, "a\0b c d e f"), (3, "\0"), (4, "")]
    got = {r.doc_id: r.n_shingles for r in similar_components(documents(rows), scratch).collect()}
    assert got == {1: 2, 2: 1, 3: 1, 4: 0}


@pytest.mark.parametrize("texts_of", [3, 70_000])
def test_orders_are_those_of_plain_sorts(texts_of):
    rnd = np.random.default_rng(3)
    texts = np.sort(rnd.integers(0, texts_of, 5000))
    hashes = rnd.integers(0, 900, 5000).astype(np.uint64)
    order = jaccard_join._by_text(hashes, texts)
    plain = np.lexsort((hashes, texts))
    assert (hashes[order] == hashes[plain]).all() and (texts[order] == texts[plain]).all()
    hashes, texts = jaccard_join._distinct(hashes, texts)
    frequency = rnd.integers(0, 4, 1 << jaccard_join.GROUP_BITS)
    for counts in (frequency, frequency << 40):  # counts beyond the packed keys too
        plain = np.lexsort((hashes, counts[hashes.astype(np.int64)], texts))
        rarest = jaccard_join._rarest_first(hashes, texts, counts)
        assert (rarest[0] == hashes[plain]).all() and (rarest[1] == texts[plain]).all()
    assert not len(jaccard_join._rarest_first(hashes[:0], texts[:0], frequency)[0])


@pytest.mark.parametrize("most", [15, 200, 1 << 24])
def test_tree_joined_with_itself_finds_what_its_points_reach(most):
    """Counts that fit into layers, that do not, and unknown ones."""
    rnd = np.random.default_rng(most)
    base = rnd.integers(0, 3, (12, 32)).astype(np.float32)
    points = np.repeat(base, 12, axis=0) + (rnd.random((144, 32)) < 0.1)
    points[rnd.random(144) < 0.3, 5] = most
    sizes = np.minimum(points, 40).sum(1).astype(np.int64)
    order = np.argsort(sizes, kind="stable")
    points, sizes = points[order], sizes[order]
    tree = jaccard_join.RTree(points, sizes)
    bounds = tree.join()
    found = 0
    for number in range(len(points)):
        at, shared = tree.reach(points[number], sizes[number], np.arange(len(points)) < number)
        assert (np.flatnonzero(bounds[number, :number] >= 0) == at).all()
        # beyond 2^24, which stands for an unknown count, floats round
        assert np.allclose(bounds[number, at], shared, 1e-6) and (bounds[number, at] == bounds[at, number]).all()
        found += len(at)
    assert found > 144


@pytest.mark.parametrize("sides", [[0], [1, 2]])
def test_joined_and_searched_trees_agree(monkeypatch, sides):
    rnd = np.random.default_rng(5)
    sets = []
    for _ in range(30):
        base = np.unique(rnd.integers(0, 1 << 62, rnd.integers(2, 200), np.uint64))
        sets += [np.unique(rnd.permutation(base)[: max(1, int(len(base) * rnd.uniform(0.8, 1)))]) for _ in range(4)]
    roots = rnd.integers(0, 90, len(sets)).tolist()
    given = [count_vector(s) for s in sets], [len(s) for s in sets], roots, [sides[i % len(sides)] for i in range(len(sets))]
    joined = [survivors(*given, spanning) for spanning in (False, True)]
    monkeypatch.setattr(jaccard_join, "MOST_JOINED", 0)
    searched = [survivors(*given, spanning) for spanning in (False, True)]
    assert {frozenset(p) for p in joined[0]} == {frozenset(p) for p in searched[0]}

    def parts(pairs):
        of = list(range(len(sets)))
        for one, two in pairs:
            of = [of[one] if part == of[two] else part for part in of]
        return {frozenset(i for i, part in enumerate(of) if part == p) for p in of}

    assert parts(joined[1]) == parts(joined[0]) and len(joined[1]) <= len(joined[0])


def test_words_are_taken_of_wanted_texts_only(monkeypatch):
    taken = []
    real = jaccard_join.shingle_sets
    monkeypatch.setattr(jaccard_join, "shingle_sets", lambda data, offsets: taken.append(len(data)) or real(data, offsets))
    rows = pa.RecordBatch.from_pydict({"text": ["a b c d e f", "g h", None, "A b c d e f", "g h"], "digest": [1, 2, 3, 4, 2]})
    wanted = SimpleNamespace(value=np.array([2, 4, 9]))
    made = pa.Table.from_batches(jaccard_join._of_classes(wanted, 0, np.ndarray.tobytes)([rows]))
    assert [len(m) // 8 for m in made["made"].to_pylist()] == [1, 2]
    assert sum(taken) == len("g hA b c d e fg h")
    assert sum(taken) < sum(len(t or "") for t in rows["text"].to_pylist())


@pytest.mark.parametrize("most_sent", [0, 4_000_000])
def test_classes_sent_or_joined(documents, scratch, monkeypatch, most_sent):
    """Digests of texts choose what is read again, whether they are sent to the tasks or not."""
    monkeypatch.setattr(jaccard_join, "MOST_SENT", most_sent)
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [(9, base), (4, base.upper()), (7, base + " more"), (3, base + " more"), (1, "none of these"), (2, None)]
    assert run(documents, scratch, rows) == brute(rows)
