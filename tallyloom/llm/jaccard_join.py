"""N-gram Jaccard join with count vectors in R-trees.

A document is the set of its distinct shingles. Documents with the same set are one class. Shingles are
hashed into groups, and a set's counts by group are a point; two sets share at most the sum over the
groups of the smaller count. That bound is used twice:

* Over the whole corpus with very many groups, ordered from rare to frequent by the counts of all
  documents. If two sets link, they share a shingle among the first `n - ceil(3n / 4) + 1` of each in
  that order, because the counts of what comes later cannot add up to a link. So the classes that have
  such a shingle in common form a list, and all links lie inside lists.
* Inside a list, with as many groups as its sets need, the points are packed into an R-tree. A box
  whose summed minima with a point stay below what a link needs is passed over with all its points.
  Only pairs that survive have their sets fetched and compared.

Only components are asked for, so large groups of near copies never come to all their pairs: first
every list gives a spanning forest of its surviving pairs, the largest bounds first. The components
of the pairs that link are nearly complete; lists that still hold more than one of them give all
surviving pairs between components. What is not looked at is connected already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import Scratch
from tallyloom.llm.components import connected_components
from tallyloom.llm.words import BASE, mix, slices, table, words

SHINGLE = 5
SPACES = (9, 10, 11, 12, 13, 32)
WORD_BYTES = table([b for b in range(256) if b not in SPACES])
GROUP_BITS = 20
PIECE = 1 << 12
LIST_ROWS = 2000
MOST_SENT = 4_000_000
FANOUT = 16
MOST_GROUPS = 1 << 16
MOST_COUNT = 15  # counts are kept in four bits
MOST_JOINED = 512  # points of a tree whose bounds are kept as a matrix
MOST_LAYERS = 64  # counts that are laid out as layers
CELL_NUMBERS = 1 << 24  # counts that one cell unpacks at most; more points get fewer groups


def shingle_sets(data: np.ndarray, offsets: np.ndarray):
    """Hashes of all shingles of the texts of a slice, and the text of each; not yet distinct."""
    found = words(data, offsets, WORD_BYTES)
    sizes = np.diff(found.first)
    total = len(found.hashes)
    hashes = np.zeros(0, np.uint64)
    text_of = np.repeat(np.arange(len(sizes)), sizes)
    long = np.zeros(0, np.int64)
    if total >= SHINGLE:
        summed = np.zeros(total - SHINGLE + 1, np.uint64)
        for place in range(SHINGLE):
            summed = summed * BASE + found.hashes[place : place + len(summed)]
        whole = text_of[SHINGLE - 1 :] == text_of[: len(summed)]
        hashes, long = mix(summed[whole]), text_of[: len(summed)][whole]
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    if len(short):
        summed = np.zeros(len(short), np.uint64)
        for place in range(SHINGLE - 1):
            there = sizes[short] > place
            summed[there] = summed[there] * BASE + found.hashes[found.first[short][there] + place]
        # the number of words keeps these apart from shingles of full length
        hashes = np.concatenate([hashes, mix(mix(summed) + sizes[short].astype(np.uint64))])
        long = np.concatenate([long, short])
    return hashes, long


def _by_text(values: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """The order by text, value: numbers of 16 bits are sorted by counting, which takes a fraction of the time."""
    if not len(texts) or texts.max() >= 1 << 16:
        return np.lexsort((values, texts))
    order = np.argsort(values)
    return order[np.argsort(texts[order].astype(np.uint16), kind="stable")]


def _distinct(hashes: np.ndarray, texts: np.ndarray):
    """Distinct (text, hash) sorted by text, hash."""
    order = _by_text(hashes, texts)
    hashes, texts = hashes[order], texts[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (texts[1:] != texts[:-1])
    return hashes[new], texts[new]


def _per_text(values: np.ndarray, texts: np.ndarray, number: int) -> np.ndarray:
    """Sums modulo 2^64."""
    sums = np.zeros(number, np.uint64)
    if len(values):
        starts = np.flatnonzero(np.concatenate([[True], texts[1:] != texts[:-1]]))
        sums[texts[starts]] = np.add.reduceat(values, starts)
    return sums


def _class_ids(hashes, texts, number, seed):
    """Two sums over the mixed hashes of each set; equal sets have equal ids."""
    first = _per_text(mix(hashes + np.uint64(seed)), texts, number)
    second = _per_text(mix(hashes ^ mix(np.array([seed + 1], np.uint64))), texts, number)
    return first.view(np.int64), second.view(np.int64)


SETS = "doc_id bigint, digest bigint, n int, class bigint, proof bigint, piece int, counts binary"


def _describe(seed: int):
    """A row per document (n, class), and at the end of a task its counts of all groups, in pieces."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << GROUP_BITS, np.int64)
        for batch in batches:
            for row, data, offsets in slices(batch.column("text")):
                number = len(offsets) - 1
                hashes, texts = _distinct(*shingle_sets(data, offsets))
                groups = (hashes & np.uint64((1 << GROUP_BITS) - 1)).astype(np.int64)
                np.add.at(counts, groups, 1)
                classes, proofs = _class_ids(hashes, texts, number, seed)
                none = pa.nulls(number, pa.int32()), pa.nulls(number, pa.binary())
                yield _batch(
                    [
                        batch.column("doc_id").slice(row, number),
                        batch.column("digest").slice(row, number),
                        pa.array(np.bincount(texts, minlength=number).astype(np.int32)),
                        pa.array(classes),
                        pa.array(proofs),
                        *none,
                    ],
                    SETS,
                )
        pieces = counts.reshape(-1, PIECE)
        used = np.flatnonzero(pieces.any(1))
        empty = [pa.nulls(len(used), k) for k in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())]
        rows = pa.array([pieces[p].tobytes() for p in used], pa.binary())
        yield _batch([*empty, pa.array(used.astype(np.int32)), rows], SETS)

    return describe


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    names = [part.split()[0] for part in schema.split(", ")]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _add_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, counts in zip(batch.column("piece"), batch.column("counts"), strict=True):
            more = np.frombuffer(counts.as_py(), np.int64)
            sums[piece.as_py()] = sums.get(piece.as_py(), 0) + more
    yield _batch(
        [pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())],
        "piece int, counts binary",
    )


ENTRIES = "shingle bigint, part int, class bigint, n int"


def _rarest_first(hashes: np.ndarray, texts: np.ndarray, frequency: np.ndarray):
    """What is sorted by text, hash in the order of text, frequency of the group, hash."""
    of_group = frequency[(hashes & np.uint64((1 << GROUP_BITS) - 1)).astype(np.int64)]
    if len(hashes) < 1 << 24 and of_group.max(initial=0) < 1 << 39:
        order = _by_text(of_group << 24 | np.arange(len(hashes)), texts)
    else:
        order = np.lexsort((hashes, of_group, texts))
    return hashes[order], texts[order]


def _entries(counted, seed: int, part_rows: int):
    """The rarest shingles of every class, once per task; frequent ones are dealt to parts."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = counted.value
        seen: set[int] = set()
        for batch in batches:
            for _, data, offsets in slices(batch.column("text")):
                number = len(offsets) - 1
                hashes, texts = _distinct(*shingle_sets(data, offsets))
                classes, _ = _class_ids(hashes, texts, number, seed)
                hashes, texts = _rarest_first(hashes, texts, frequency)
                sizes = np.bincount(texts, minlength=number)
                ends = np.cumsum(sizes)
                rank = np.arange(len(hashes)) - (ends - sizes)[texts]
                fresh = np.zeros(number, bool)
                for text, name in enumerate(classes.tolist()):
                    if name not in seen:
                        seen.add(name)
                        fresh[text] = True
                kept = (rank < (sizes - (3 * sizes + 3) // 4 + 1)[texts]) & fresh[texts]
                hashes, texts = hashes[kept], texts[kept]
                of_group = frequency[(hashes & np.uint64((1 << GROUP_BITS) - 1)).astype(np.int64)]
                parts = mix(classes[texts].view(np.uint64)) % (of_group // part_rows + 1).astype(np.uint64)
                parts = np.where(of_group < part_rows, -1, parts.astype(np.int64))  # -1: all in one
                yield _batch(
                    [
                        pa.array(hashes.view(np.int64)),
                        pa.array(parts.astype(np.int32)),
                        pa.array(classes[texts]),
                        pa.array(sizes[texts].astype(np.int32)),
                    ],
                    ENTRIES,
                )

    return entries


def _of_classes(wanted, seed: int, make):
    """`make` of the sorted set of each class, once per task; of texts with the wanted digests only, if given."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            if wanted is not None:
                batch = batch.filter(pa.array(np.isin(batch.column("digest").to_numpy(), wanted.value)))
            for _, data, offsets in slices(batch.column("text")):
                number = len(offsets) - 1
                hashes, texts = _distinct(*shingle_sets(data, offsets))
                classes, _ = _class_ids(hashes, texts, number, seed)
                ends = np.cumsum(np.bincount(texts, minlength=number))
                chosen = []
                for text, name in enumerate(classes.tolist()):
                    if name not in seen:
                        seen.add(name)
                        chosen.append(text)
                begins = np.concatenate([[0], ends])
                yield _batch(
                    [
                        pa.array(classes[chosen], pa.int64()),
                        pa.array([make(hashes[begins[t] : begins[t + 1]]) for t in chosen], pa.binary()),
                    ],
                    "class bigint, made binary",
                )

    return rows


def count_vector(hashes: np.ndarray) -> bytes:
    """Counts by group, about as many groups as hashes; a power of two, so that vectors can be folded."""
    width = min(MOST_GROUPS, max(16, 1 << (len(hashes) - 1).bit_length()))
    groups = (hashes >> np.uint64(GROUP_BITS) & np.uint64(width - 1)).astype(np.int64)
    counts = np.minimum(np.bincount(groups, minlength=width), MOST_COUNT).astype(np.uint8)
    return (counts[0::2] << 4 | counts[1::2]).tobytes()


# the two counts of each byte
COUNTS_OF = np.array([[c if c < MOST_COUNT else 1 << 24 for c in divmod(b, 16)] for b in range(256)], np.float32)


def folded(vector: bytes, width: int) -> np.ndarray:
    """Counts over fewer groups, as floats: these are exact up to 2^24, which stands for a count that
    is not known any more and bounds nothing."""
    return COUNTS_OF[np.frombuffer(vector, np.uint8)].reshape(-1, width).sum(0)


def _width(least: int, rows: int) -> int:
    """About `least` groups, a power of two, if all points of the cell then fit."""
    wanted = max(16, 1 << (max(least, 1) - 1).bit_length())
    fitting = 1 << max(4, (CELL_NUMBERS // rows).bit_length() - 1)
    return min(MOST_GROUPS, wanted, fitting)


class RTree:
    """Points (counts by group) packed by size into boxes of FANOUT, level over level.

    A box keeps the largest count of each group and the smallest size. Sizes of a tree's points are
    in order.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.levels = [(points, sizes)]
        self.ones = np.ones(points.shape[1], np.float32)
        while len(self.levels[-1][0]) > FANOUT:
            below, least = self.levels[-1]
            starts = np.arange(0, len(below), FANOUT)
            self.levels.append((np.maximum.reduceat(below, starts), np.minimum.reduceat(least, starts)))

    def reach(self, point: np.ndarray, size: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the `wanted` points (a mask) those that may link with this one by the bound of summed
        minima, and their bounds."""
        at = np.arange(len(self.levels[-1][0]))
        for number in range(len(self.levels) - 1, -1, -1):
            points, sizes = self.levels[number]
            at = at[at < len(points)]
            if number == 0:
                at = at[wanted[at]]
            shared = np.minimum(points[at], point) @ self.ones
            # shared >= 3/4 of the union, so >= 3/7 of both sizes, and >= 3/4 of this size
            near = (7 * shared >= 3 * (size + sizes[at])) & (4 * shared >= 3 * size)
            at, shared = at[near], shared[near]
            if number:
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        return at, shared


    def join(self) -> np.ndarray:
        """The tree joined with itself: the bounds of all pairs of points, -1 where they cannot link."""
        points, sizes = self.levels[0]
        bounds = np.full((len(points), len(points)), -1, np.float32)
        if len(self.levels) == 1:
            bounds[:] = summed_minima(points, points)
        else:
            boxes, least = self.levels[1]
            leaf_of = np.arange(len(points)) // FANOUT
            for leaf, near in enumerate(_may_link(summed_minima(boxes, boxes), least)):
                own = np.flatnonzero(leaf_of == leaf)
                at = np.flatnonzero(near[leaf_of] & (leaf_of >= leaf))
                shared = summed_minima(points[own], points[at])
                bounds[np.ix_(own, at)] = shared
                bounds[np.ix_(at, own)] = shared.T
        return np.where(_may_link(bounds, sizes), bounds, -1)


def _may_link(shared: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Shared must be >= 3/4 of the union, so >= 3/7 of both sizes, and >= 3/4 of either."""
    one, two = sizes[:, None], sizes[None, :]
    return (7 * shared >= 3 * (one + two)) & (4 * shared >= 3 * np.maximum(one, two))


def summed_minima(some: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Of every two rows. The smaller of two counts is the number of layers that both reach."""
    top = int(min(some.max(), others.max()))
    if top > MOST_LAYERS:
        ones = np.ones(some.shape[1], np.float32)
        return np.stack([np.minimum(others, row) @ ones for row in some])
    total = np.zeros((len(some), len(others)), np.float32)
    for layer in range(1, top + 1):
        total += (some >= layer).astype(np.float32) @ (others >= layer).astype(np.float32).T
    return total


def _spanning(bounds: np.ndarray) -> list[tuple[int, int]]:
    """A forest of the pairs with a bound: the point with the largest bound to those taken comes next."""
    bound, by = np.full(len(bounds), -1.0, np.float32), np.zeros(len(bounds), np.int64)
    found = []
    for _ in range(len(bounds)):
        number = int(bound.argmax())
        if bound[number] >= 0:
            found.append((number, int(by[number])))
        bound[number] = -2
        bounds[:, number] = -3  # taken
        closer = bounds[number] > bound
        bound[closer], by[closer] = bounds[number][closer], number
    return found


def survivors(vectors, sizes, roots, sides, spanning: bool) -> list[tuple[int, int]]:
    """Pairs of a list that the bound lets through, of different roots.

    `sides` are 0, or 1 and 2 where only pairs across the two are wanted. With `spanning`, a forest
    of them that connects all they connect, made of the largest bounds.
    """
    order = np.argsort(sizes, kind="stable")
    ordered = np.asarray(sizes)[order]
    # no pair across a gap of more than a quarter can link
    gaps = np.flatnonzero(4 * ordered[:-1] < 3 * ordered[1:]) + 1
    found = []
    for own in np.split(order, gaps):
        if len(own) < 2:
            continue
        # a forest is verified whatever the bound lets through, so a quarter of the groups will do
        width = _width(int(sizes[own[0]]) // (4 if spanning else 1), len(own))
        points = np.stack([folded(vectors[i], width) for i in own])
        own_sizes = np.array([sizes[i] for i in own])
        own_roots = np.array([roots[i] for i in own])
        own_sides = np.array([sides[i] for i in own])
        tree = RTree(points, own_sizes)
        if len(own) <= MOST_JOINED:
            apart = own_roots[:, None] != own_roots
            across = (own_sides == 0) | (own_sides[:, None] != own_sides)
            bounds = np.where(apart & across, tree.join(), -1)
            pairs = _spanning(bounds) if spanning else np.argwhere(np.triu(bounds >= 0, 1))
            found += [(int(own[one]), int(own[two])) for one, two in pairs]
            continue

        def partners(number, among, points=points, tree=tree, sizes=own_sizes, roots=own_roots, sides=own_sides):
            wanted = among & (roots != roots[number]) & ((sides == 0) | (sides != sides[number]))
            return tree.reach(points[number], sizes[number], wanted)

        waiting = np.ones(len(own), bool)
        if not spanning:
            for number in range(len(own) - 1, -1, -1):
                waiting[number] = False
                found += [(int(own[number]), int(own[other])) for other in partners(number, waiting)[0]]
            continue
        # the member with the largest bound to those taken comes next
        bound, by = np.full(len(own), -1.0, np.float32), np.zeros(len(own), np.int64)
        for _ in range(len(own)):
            number = int(np.where(waiting, bound, -2).argmax())
            if bound[number] >= 0:
                found.append((int(own[number]), int(own[by[number]])))
            waiting[number] = False
            near, shared = partners(number, waiting)
            closer = shared > bound[near]
            bound[near[closer]], by[near[closer]] = shared[closer], number
    return found


def _surviving(members: DataFrame, points: DataFrame, spanning: bool) -> DataFrame:
    """Distinct pairs (a, b) of classes. members: list, cell, side, class, n, root."""

    def open_list(rows: pa.Table) -> pa.Table:
        pairs = survivors(*[rows[c].to_pylist() for c in ("made", "n", "root", "side")], spanning)
        names = rows["class"].to_numpy()
        first, second = (np.array([names[p[k]] for p in pairs], np.int64) for k in (0, 1))
        return pa.table({"a": np.minimum(first, second), "b": np.maximum(first, second)})

    return (
        members.join(points, "class")
        .groupBy("list", "cell")
        .applyInArrow(open_list, "a bigint, b bigint")
        .distinct()
    )


def _verified(pairs: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs whose sets link."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for one, two in zip(batch.column("one"), batch.column("two"), strict=True):
                first = np.frombuffer(one.as_py(), np.uint64)
                second = np.frombuffer(two.as_py(), np.uint64)
                shared = len(np.intersect1d(first, second, assume_unique=True))
                kept.append(100 * shared >= 75 * (len(first) + len(second) - shared))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).filter(pa.array(kept, pa.bool_())) for c in ("a", "b")], names=["a", "b"]
            )

    ones = sets.select(F.col("class").alias("a"), F.col("made").alias("one"))
    twos = sets.select(F.col("class").alias("b"), F.col("made").alias("two"))
    both = pairs.join(ones, "a").join(twos, "b").select("a", "b", "one", "two")
    return scratch.keep(both.mapInArrow(compare, "a bigint, b bigint"))


def _made(texts: DataFrame, classes: DataFrame, seed: int, make, scratch: Scratch) -> DataFrame:
    """class and made, for the given classes and, where digests clash, some more.

    classes: class, and the digest of one of its texts. If they are few enough, the digests are sent to
    the tasks, which then take the words of these texts only.
    """
    out = "class bigint, made binary"
    classes = scratch.keep(classes)
    number = classes.count()
    if number <= MOST_SENT:
        digests = np.fromiter((r[0] for r in classes.select("digest").toLocalIterator()), np.int64, number)
        shared = texts.sparkSession.sparkContext.broadcast(np.unique(digests))
        found = texts.select("text", F.xxhash64("text").alias("digest")).mapInArrow(_of_classes(shared, seed, make), out)
    else:
        found = texts.select("text").mapInArrow(_of_classes(None, seed, make), out)
        found = found.join(classes, "class", "left_semi")
    return scratch.keep(found.groupBy("class").agg(F.first("made").alias("made")))


def similar_components(
    documents: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Words are separated by ASCII white space, A-Z count as a-z. Fewer than five words are one
    shingle; null, empty and blank texts have none and link with nothing. Two documents link at a
    Jaccard similarity of 0.75 or more; a component has the smallest id of its documents, nulls
    aside. Repeated rows and ids keep their rows. The input is read four times.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    seed = 0
    while True:
        described = texts.withColumn("digest", F.xxhash64("text")).mapInArrow(_describe(seed), SETS)
        described = scratch.keep(described)
        named = described.filter("piece IS NULL").select("doc_id", "digest", "n", "class", "proof")
        classes = scratch.keep(
            named.groupBy("class").agg(
                F.min("digest").alias("digest"),
                ((F.min("proof") != F.max("proof")) | (F.min("n") != F.max("n"))).alias("differ"),
            )
        )
        if classes.filter("differ").isEmpty():
            break
        seed += 2  # two different sets with one class id: name the classes anew
    frequency = np.zeros((1 << GROUP_BITS) // PIECE * PIECE, np.int64)
    pieces = described.filter("piece IS NOT NULL").select("piece", "counts").repartition("piece")
    for piece, counts in pieces.mapInArrow(_add_pieces, "piece int, counts binary").collect():
        frequency[piece * PIECE : (piece + 1) * PIECE] = np.frombuffer(counts, np.int64)  # 8 MB in all
    counted = spark.sparkContext.broadcast(frequency)

    by_size = "(PARTITION BY shingle, part ORDER BY n, class)"
    entries = texts.select("text").mapInArrow(_entries(counted, seed, 5 * LIST_ROWS), ENTRIES)
    # a class stays in a list if its neighbours by size are of another class and not too far off;
    # lists in parts keep all
    shared = scratch.keep(
        entries.selectExpr(
            "shingle AS list",
            "part",
            "class",
            "n",
            f"lag(class) OVER {by_size} AS smaller",
            f"lag(n) OVER {by_size} AS smaller_n",
            f"lead(class) OVER {by_size} AS larger",
            f"lead(n) OVER {by_size} AS larger_n",
        )
        .filter(
            "part >= 0 OR smaller <> class AND 4L * smaller_n >= 3L * n"
            " OR larger <> class AND 4L * n >= 3L * larger_n"
        )
        .select("list", "class", "n")
        .distinct()
    )
    lists = shared.groupBy("list").agg(
        F.count(F.lit(1)).alias("rows"), F.min("n").alias("least"), F.max("n").alias("most")
    )
    # two sets of which one is much smaller do not link
    lists = lists.filter("rows > 2 OR rows = 2 AND 4 * least >= 3 * most").select("list")
    members = scratch.keep(shared.join(scratch.keep(lists), "list"))
    classes = classes.select("class", "digest")
    points = _made(texts, classes.join(members, "class", "left_semi"), seed, count_vector, scratch)

    opened = _cells(members.withColumn("root", F.col("class")), scratch)
    pairs = scratch.keep(_surviving(opened, points, True))
    either = pairs.select(F.explode(F.array("a", "b")).alias("class"))
    sets = _made(texts, classes.join(either, "class", "left_semi"), seed, np.ndarray.tobytes, scratch)
    links = _verified(pairs, sets, scratch)
    # a class without any survivor is done
    members = scratch.keep(members.join(sets.select("class"), "class", "left_semi"))
    roots = connected_components(links, scratch)
    linked = scratch.keep(
        members.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn(
            "root", F.coalesce("root", "class")
        )
    )
    several = (
        linked.groupBy("list")
        .agg(F.min("root").alias("low"), F.max("root").alias("high"))
        .filter("low <> high")
        .select("list")
    )
    left = scratch.keep(linked.join(scratch.keep(several), "list").select("list", "class", "n", "root"))
    pairs = scratch.keep(_surviving(_cells(left, scratch), points, False))
    links = links.union(_verified(pairs, sets, scratch))
    roots = connected_components(links, scratch)

    rooted = scratch.keep(
        named.join(roots.withColumnRenamed("node", "class"), "class", "left").select(
            "doc_id", "n", F.when(F.col("n") > 0, F.coalesce("root", "class")).alias("root")
        )
    )
    smallest = scratch.keep(
        rooted.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    )
    return rooted.join(smallest, "root", "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def _cells(members: DataFrame, scratch: Scratch) -> DataFrame:
    """Lists as cells of bounded size: list, cell, side, class, n, root.

    Lists of the same classes are one. Longer ones are cut into blocks, and every two blocks make a
    cell, so no pair is lost.
    """
    sizes = members.groupBy("list").agg(
        F.count(F.lit(1)).alias("rows"),
        F.bit_xor(F.xxhash64("class")).alias("mark"),
        F.bit_xor(F.xxhash64("class", F.lit(1))).alias("other_mark"),
    )
    chosen = sizes.groupBy("rows", "mark", "other_mark").agg(F.min("list").alias("list"))
    chosen = scratch.keep(chosen.select("list", F.ceil(F.col("rows") / LIST_ROWS).alias("blocks")))
    block = F.pmod(F.xxhash64("class"), F.col("blocks"))
    pairs = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda other: F.struct(
            (F.least("block", other) * F.col("blocks") + F.greatest("block", other)).alias("cell"),
            F.when(F.col("block") == other, 0).when(F.col("block") < other, 1).otherwise(2).alias("side"),
        ),
    )
    return (
        members.join(chosen, "list")
        .withColumn("block", block)
        .select("list", "class", "n", "root", F.explode(pairs).alias("at"))
        .select("list", "at.cell", "at.side", "class", "n", "root")
    )
