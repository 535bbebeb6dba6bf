"""License scans: winnowed fingerprints pick candidates, banded alignment reports what matched.

Templates are a small fixed set. Hashes of every few words are winnowed: of any WINDOW hashes in a row,
the smallest is kept, on both sides, so a run of GRAM + WINDOW - 1 equal words always shares a
fingerprint. A template of which so long a run need not be left at the least coverage has all its runs
indexed instead, of GRAM words or as few as must be left. An inverted index from fingerprint to places
in templates gives, for every text, the templates and the shifts at which they may lie. Each such
stretch is aligned inside a band around its shifts, again on both sides of every place found, and
reported with the share of the template's words that matched, and with its span.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.words import runs, slices, table, words

WORD_BYTES = table([b for b in range(256) if chr(b).isalnum() and b < 128 or b >= 128])
GRAM = 3
WINDOW = 3
MATCH, MISMATCH, GAP = 2, -1, -1
SPANS = (
    "doc_id bigint, license string, start_char bigint, end_char bigint, matched int, "
    "template_words int, coverage double"
)


def winnow(hashes: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Which hashes are the smallest of a window inside their text; of a shorter text, all."""
    number = len(hashes)
    chosen = np.zeros(number, bool)
    if not number:
        return chosen
    sizes = np.bincount(texts)
    chosen |= sizes[texts] < WINDOW
    if number >= WINDOW:
        rows = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW)
        least = rows.min(1)
        whole = texts[WINDOW - 1 :] == texts[: number - WINDOW + 1]
        for place in range(WINDOW):
            chosen[place : place + len(rows)] |= whole & (rows[:, place] == least)
    return chosen


class Index:
    """Fingerprints of all templates: (run length, winnowed) to hash to (template, word)."""

    def __init__(self, templates: dict[str, str], least_coverage: float = 0.8):
        self.names = list(templates)
        self.words = []
        self.needed = []
        self.places: dict[tuple[int, bool], dict[int, list[tuple[int, int]]]] = {}
        for number, name in enumerate(self.names):
            data = np.frombuffer(templates[name].encode(), np.uint8)
            found = words(data, np.array([0, len(data)]), WORD_BYTES)
            self.words.append(found.hashes)
            size = len(found.hashes)
            needed = max(1, ceil(least_coverage * size - 1e-9))
            self.needed.append(needed)
            # words missing or replaced cut the needed ones into pieces, the longest of which has `run` words
            run = ceil(needed / (size - needed + 1))
            winnowed = run >= GRAM + WINDOW - 1
            kind = (min(GRAM, run), winnowed)
            hashes, firsts = runs(found, kind[0])
            chosen = winnow(hashes, np.zeros(len(hashes), np.int64)) if winnowed else np.ones(len(hashes), bool)
            for at in np.flatnonzero(chosen):
                own = self.places.setdefault(kind, {})
                own.setdefault(int(hashes[at]), []).append((number, int(firsts[at])))
        self.hashes = {kind: np.array(sorted(own), np.uint64) for kind, own in self.places.items()}


def align(template: np.ndarray, text: np.ndarray, low: int, high: int):
    """Best local alignment with low <= place in text - place in template <= high.

    Returns (matched words, first word, end word in the text, shift of the first word), or None without
    a match. Ties take the alignment that ends first.
    """
    size, width = len(template), high - low + 1
    scores = np.zeros((size + 1, width + 2), np.int64)  # with a border on both sides
    steps = np.arange(width)
    best, at = 0, None
    for row in range(1, size + 1):
        places = low + row - 1 + steps
        inside = (places >= 0) & (places < len(text))
        equal = np.zeros(width, bool)
        equal[inside] = text[places[inside]] == template[row - 1]
        score = scores[row - 1, 1:-1] + np.where(equal, MATCH, MISMATCH)
        score = np.maximum(score, scores[row - 1, 2:] + GAP)  # a template word is missing
        score = np.maximum(np.where(inside, score, 0), 0)
        score = np.maximum.accumulate(score - GAP * steps) + GAP * steps  # additional words in the text
        scores[row, 1:-1] = np.where(inside, score, 0)
        if scores[row].max() > best:
            best, at = int(scores[row].max()), (row, int(scores[row].argmax()))
    if at is None:
        return None
    row, cell = at
    matched, end, first, shift = 0, None, None, None
    while row > 0 and scores[row, cell] > 0:
        place = low + row - 1 + cell - 1
        equal = text[place] == template[row - 1]
        if scores[row, cell] == scores[row - 1, cell] + (MATCH if equal else MISMATCH):
            if equal:
                matched, first, shift = matched + 1, place, place - row + 1
                end = place + 1 if end is None else end
            row -= 1
        elif scores[row, cell] == scores[row - 1, cell + 1] + GAP:
            row, cell = row - 1, cell + 1
        else:
            cell -= 1
    return matched, first, end, shift


def _stretches(shifts: set[int], gap: int) -> Iterator[tuple[int, int]]:
    """Groups shifts that lie no more than `gap` apart."""
    shifts = sorted(shifts)
    first = last = shifts[0]
    for shift in shifts[1:]:
        if shift - last > gap:
            yield first, last
            first = shift
        last = shift
    yield first, last


def spans_of(hashes, index: Index, hits, band: int):
    """(template, matched, first word, end word) of one text; hits are (place, template, word)."""
    found = []
    by_template: dict[int, set[int]] = {}
    for place, number, word in hits:
        by_template.setdefault(number, set()).add(place - word)
    for number in sorted(by_template):
        template, needed = index.words[number], index.needed[number]
        size = len(template)
        reach = band + size // 10
        taken: list[tuple[int, int]] = []
        for first, last in _stretches(by_template[number], reach):
            # a long chain of shifts is aligned in windows; what begins late is left to the next one
            for low in range(first - reach, last + 1, 2 * reach + size):
                high = min(low + 4 * reach + size, last + reach)
                later = low + 3 * reach + size if low + 2 * reach + size <= last else high + 1
                parts = _free(max(0, low), min(len(hashes), high + size), taken)
                while parts:
                    begin, end = parts.pop()
                    own = hashes[begin:end]
                    if np.isin(template, own).sum() < needed:
                        continue
                    result = align(template, own, max(low - begin, 1 - size), min(high - begin, len(own) - 1))
                    if not result or 2 * result[0] < needed:
                        continue
                    matched, at, stop, shift = result
                    if matched >= needed and begin + shift < later:
                        found.append((number, matched, begin + at, begin + stop))
                        taken.append((begin + at, begin + stop))
                    parts += [(begin, begin + at), (begin + stop, end)]
    return found


def _free(begin: int, end: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What is left of a range of words without the taken spans."""
    parts = []
    for first, stop in sorted(span for span in taken if span[1] > begin and span[0] < end):
        parts.append((begin, first))
        begin = stop
    return [(a, b) for a, b in [*parts, (begin, end)] if a < b]


def scan_licenses(
    documents: DataFrame,
    templates: dict[str, str],
    doc_id: str = "doc_id",
    text: str = "text",
    band: int = 8,
    least_coverage: float = 0.8,
) -> DataFrame:
    """A row for every place of a text that covers a template to `least_coverage` or more.

    doc_id, license, start_char and end_char (code points, end exclusive), matched and template_words,
    coverage. The templates go to the tasks with the code: a fixed small set. Places of one template do
    not overlap; the best alignment is taken first. A place inside the band is sure to be a candidate if words are only
    missing or replaced; with words between them, if a run of two (short templates) or three words is
    left. Null and empty texts have no rows; repeated rows give theirs again.
    """
    index = Index(templates, least_coverage)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            ids = batch.column("doc_id")
            for row, data, offsets in slices(batch.column("text")):
                found = words(data, offsets, WORD_BYTES)
                hits_of: dict[int, list[tuple[int, int, int]]] = {}
                for (length, winnowed), known in index.hashes.items():
                    hashes, places = runs(found, length)
                    texts = np.searchsorted(found.first, places, side="right") - 1
                    kept = np.flatnonzero(winnow(hashes, texts)) if winnowed else np.arange(len(hashes))
                    at = np.minimum(np.searchsorted(known, hashes[kept]), len(known) - 1)
                    for k in kept[known[at] == hashes[kept]]:
                        place = int(places[k] - found.first[texts[k]])
                        hits_of.setdefault(int(texts[k]), []).extend(
                            (place, owner, word)
                            for owner, word in index.places[length, winnowed][int(hashes[k])]
                        )
                for number, hits in sorted(hits_of.items()):
                    base = found.first[number]
                    own = found.hashes[base : found.first[number + 1]]
                    content = data[offsets[number] : offsets[number + 1]].tobytes()
                    for owner, matched, first, end in spans_of(own, index, hits, band):
                        start = found.starts[base + first] - offsets[number]
                        stop = found.ends[base + end - 1] - offsets[number]
                        size = len(index.words[owner])
                        rows.append(
                            (
                                ids[row + int(number)].as_py(),
                                index.names[owner],
                                len(content[:start].decode()),
                                len(content[:stop].decode()),
                                matched,
                                size,
                                matched / size,
                            )
                        )
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=[part.split()[0] for part in SPANS.split(", ")],
            )

    narrow = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(scan, SPANS)
