"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are word sequences (letters, digits and all beyond ASCII, in lower case).
Runs of `least` words that an item and a text share are the seeds; a shorter item is one seed itself. Where the item's words under seeds
could reach the threshold, the pair is tiled: the longest run of words that is free in both is found by
running Karp-Rabin hashes and marked, again and again, until no run as long as a seed is left. Coverage is
the share of the item's words under tiles, so a passage is found with its sentences in any order.

The items are the query set: they are taken in blocks of bounded size, each of which is sent to the
tasks and held against all texts. The texts are never shuffled. What a block gives is written before the
next one is sent, so a worker holds one block at a time and the driver two.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import Scratch
from tallyloom.llm.words import BASE, INVERSE, mix, powers_of, runs, slices, table, words

WORD_BYTES = table([b for b in range(256) if chr(b).isalnum() and b < 128 or b >= 128])
FILTER_BITS = 22
FOUND = "array<struct<item_id: bigint, covered: int, n_words: int, n_tiles: int>>"


def word_hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return words(data, np.array([0, len(data)]), WORD_BYTES).hashes


class Seeds:
    """The runs of one length of the items of a block, sorted."""

    def __init__(self, items: list[tuple[int, np.ndarray]], length: int):
        self.length = length
        hashes = [_runs_of(own, length) for _, own in items]
        sizes = [len(runs) for runs in hashes]
        seeds = np.concatenate(hashes)
        owners = np.repeat(np.array([number for number, _ in items], np.int32), sizes)
        places = np.concatenate([np.arange(size, dtype=np.int32) for size in sizes])
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owners, self.places = seeds[order], owners[order], places[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.seeds & np.uint64((1 << FILTER_BITS) - 1)] = True

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the runs are seeds."""
        possible = np.flatnonzero(self.filter[hashes & np.uint64((1 << FILTER_BITS) - 1)])
        if not len(possible):
            return possible
        place = np.minimum(np.searchsorted(self.seeds, hashes[possible]), len(self.seeds) - 1)
        return possible[self.seeds[place] == hashes[possible]]


@dataclass
class Items:
    """A block of benchmark items, none of them without words, with their seeds by length."""

    ids: list
    words: list[np.ndarray]
    least: int

    def __post_init__(self):
        by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
        for number, own in enumerate(self.words):
            by_length.setdefault(min(self.least, len(own)), []).append((number, own))
        self.seeds = [Seeds(items, length) for length, items in sorted(by_length.items())]

    def candidates(self, seeds: Seeds, found: np.ndarray, threshold: float) -> list[int]:
        """Items whose words under the given seeds reach the threshold."""
        first = np.searchsorted(seeds.seeds, found, side="left")
        last = np.searchsorted(seeds.seeds, found, side="right")
        rows = np.concatenate([np.arange(a, b) for a, b in zip(first, last, strict=True)])
        reached = []
        for item in np.unique(seeds.owners[rows]):
            size = len(self.words[item])
            under = np.zeros(size + 1, np.int64)
            own = seeds.places[rows[seeds.owners[rows] == item]]
            np.add.at(under, own, 1)
            np.add.at(under, own + seeds.length, -1)
            if (np.cumsum(under)[:size] > 0).sum() >= threshold * size:
                reached.append(int(item))
        return reached


def _runs_of(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the runs of one text, as `runs` makes them for many."""
    number = len(hashes) - length + 1
    if number < 1:
        return np.zeros(0, np.uint64)
    summed = np.zeros(number, np.uint64)
    for place in range(length):
        summed = summed * BASE + hashes[place : place + number]
    return mix(summed)


class _Side:
    """Words of one side with running hashes and marks."""

    def __init__(self, hashes: np.ndarray):
        self.words = hashes
        powers = powers_of(BASE, len(hashes) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers[:-1], dtype=np.uint64)])
        self.inverse = powers_of(INVERSE, len(hashes) + 1)
        self.marked = np.zeros(len(hashes), bool)

    def free_runs(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and place of every run of this length without a marked word."""
        marks = np.concatenate([[0], np.cumsum(self.marked)])
        places = np.flatnonzero(marks[length:] == marks[: len(marks) - length])
        return (self.sums[places + length] - self.sums[places]) * self.inverse[places], places


def tile(text: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in the text, place in the item, words), the longest first.

    Of equally long ones, the first in the text is taken, with the first place of the item. Equal
    running hashes are checked word by word.
    """
    a, b = _Side(text), _Side(item)
    tiles = []
    longest = min(len(text), len(item))
    while longest >= least:
        low, high = least - 1, longest  # the length of the longest common free run lies here
        while low < high:
            middle = (low + high + 1) // 2
            if np.isin(b.free_runs(middle)[0], a.free_runs(middle)[0]).any():
                low = middle
            else:
                high = middle - 1
        longest = low
        if longest < least:
            break
        hashes, places = b.free_runs(longest)
        of_item: dict[int, list[int]] = {}
        for value, place in zip(hashes.tolist(), places.tolist(), strict=True):
            of_item.setdefault(value, []).append(place)
        hashes, places = a.free_runs(longest)
        common = np.isin(hashes, np.array(list(of_item), np.uint64))
        for value, place in zip(hashes[common].tolist(), places[common].tolist(), strict=True):
            if a.marked[place : place + longest].any():
                continue
            for other in of_item[value]:
                if not b.marked[other : other + longest].any() and np.array_equal(
                    text[place : place + longest], item[other : other + longest]
                ):
                    a.marked[place : place + longest] = True
                    b.marked[other : other + longest] = True
                    tiles.append((place, other, longest))
                    break
            if all(b.marked[other : other + longest].any() for own in of_item.values() for other in own):
                break
        longest -= 1
    return tiles


def item_blocks(items: DataFrame, item_id: str, text: str, least: int, block_words: int) -> Iterator[Items]:
    """The benchmark in blocks of at most `block_words` words (or one longer item)."""
    ids, found, size = [], [], 0
    rows = items.select(F.col(item_id).cast("long"), F.lower(F.coalesce(F.col(text), F.lit(""))))
    for number, content in rows.toLocalIterator():
        own = word_hashes(content)
        if not len(own):
            continue
        if ids and size + len(own) > block_words:
            yield Items(ids, found, least)
            ids, found, size = [], [], 0
        ids.append(number)
        found.append(own)
        size += len(own)
    if ids:
        yield Items(ids, found, least)


def overlaps(block: Broadcast, text: Column, threshold: float) -> Column:
    """A column with the items of a block that each text covers to the threshold or more."""

    @F.arrow_udf(FOUND)
    def find(column: pa.Array) -> pa.Array:
        items = block.value
        out: list[list[dict]] = [[] for _ in range(len(column))]
        for row, data, offsets in slices(column):
            found = words(data, offsets, WORD_BYTES)
            for seeds in items.seeds:
                hashes, places = runs(found, seeds.length)
                hits = seeds.hits(hashes)
                of_text = np.searchsorted(found.first, places[hits], side="right") - 1
                for number in np.unique(of_text):
                    shared = np.unique(hashes[hits[of_text == number]])
                    own = found.hashes[found.first[number] : found.first[number + 1]]
                    for item in items.candidates(seeds, shared, threshold):
                        tiles = tile(own, items.words[item], seeds.length)
                        size, covered = len(items.words[item]), sum(t[2] for t in tiles)
                        if covered >= threshold * size:
                            out[row + number].append(
                                {
                                    "item_id": items.ids[item],
                                    "covered": covered,
                                    "n_words": size,
                                    "n_tiles": len(tiles),
                                }
                            )
        kind = pa.list_(
            pa.struct(
                [("item_id", pa.int64()), ("covered", pa.int32()), ("n_words", pa.int32()), ("n_tiles", pa.int32())]
            )
        )
        return pa.array(out, kind)

    return find(text)


def sent_blocks(
    benchmark: DataFrame, item_id: str, text: str, least: int, block_words: int
) -> Iterator[tuple[Broadcast, bool]]:
    """Each block on all tasks, and whether it is the last one. Any other is taken back from the tasks
    when the next one is asked for, so what is made of it must be written by then."""
    blocks = item_blocks(benchmark, item_id, text, least, block_words)
    block = next(blocks, None)
    while block is not None:
        following = next(blocks, None)
        sent = benchmark.sparkSession.sparkContext.broadcast(block)
        yield sent, following is None
        if following is not None:
            sent.destroy()
        block = following


def contaminated(
    documents: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    least: int = 5,
    threshold: float = 0.5,
    block_words: int = 1_000_000,
    scratch: Scratch | None = None,
) -> DataFrame:
    """A row for every text and item whose coverage reaches the threshold.

    doc_id, item_id, covered (words of the item under tiles), n_words (of the item), n_tiles, coverage.
    An item of fewer than `least` words is matched by a text that holds it whole. Null texts and texts or
    items without words match nothing; an empty benchmark or table gives no rows; repeated rows on either
    side give their rows again. Other columns, whatever their names, are not read.
    """
    scratch = scratch or Scratch(documents.sparkSession)
    out = documents.sparkSession.createDataFrame(
        [], "doc_id long, item_id long, covered int, n_words int, n_tiles int"
    )
    narrow = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.lower(text).alias("text"))
    for block, last in sent_blocks(benchmark, item_id, item_text, least, block_words):
        hit = narrow.select("doc_id", overlaps(block, F.col("text"), threshold).alias("found"))
        rows = hit.select("doc_id", F.explode("found").alias("found")).select("doc_id", "found.*")
        out = out.union(rows if last else scratch.keep(rows))
    return out.withColumn("coverage", F.col("covered") / F.col("n_words"))


def without_contaminated(
    documents: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    least: int = 5,
    threshold: float = 0.5,
    block_words: int = 1_000_000,
    scratch: Scratch | None = None,
) -> DataFrame:
    """The rows, with all their columns, whose text covers no item to the threshold.

    No row is moved or joined. Null texts, texts without words and, with an empty benchmark, all rows
    stay; repeated rows stay or go together.
    """
    scratch = scratch or Scratch(documents.sparkSession)
    kept = documents
    for block, last in sent_blocks(benchmark, item_id, item_text, least, block_words):
        kept = kept.filter(F.size(overlaps(block, F.lower(text), threshold)) == 0)
        if not last:
            kept = scratch.keep(kept)
    return kept
