"""Words of many texts at once, on the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIXES = [np.uint64(m) for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


@dataclass
class Words:
    """Words of the texts of one slice: hash, first byte, end; the words of text i are first[i]:first[i+1]."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def table(kept: bytes | range | list[int], lower: bool = True) -> np.ndarray:
    """For each byte its value inside a word (A-Z as a-z if `lower`), or 0 for a separator.

    Byte 0 inside a word is 256.
    """
    values = np.zeros(256, np.uint64)
    for byte in kept:
        values[byte] = byte or 256
    if lower:
        for byte in range(ord("A"), ord("Z") + 1):
            if values[byte]:
                values[byte] = byte + 32
    return values


def slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cuts a text column into (first row, bytes, offsets) of about SLICE_BYTES; a text is never cut.

    Null is an empty text.
    """
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    content = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(bounds, bounds[row] + SLICE_BYTES, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, content[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row]
        row = end


def mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * _MIXES[0]
    values = (values ^ (values >> np.uint64(27))) * _MIXES[1]
    return values ^ (values >> np.uint64(31))


_powers = {}


def powers_of(base: np.uint64, number: int) -> np.ndarray:
    known = _powers.get(int(base))
    if known is None or len(known) < number:
        known = np.full(max(number, SLICE_BYTES) + 1, base, np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        _powers[int(base)] = known
    return known[:number]


def words(data: np.ndarray, offsets: np.ndarray, values: np.ndarray) -> Words:
    """Hashes are of the word's bytes only, so equal words have equal hashes in every text."""
    coded = values[data]
    inside = coded != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = inside[edges]
    finishes = inside.copy()
    finishes[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    finishes[last] = inside[last]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(finishes) + 1
    if len(starts):
        coded *= powers_of(BASE, len(coded))
        sums = np.add.reduceat(coded, starts)
        hashes = mix(sums * powers_of(INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64))
    else:
        hashes = np.zeros(0, np.uint64)
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets))


def runs(found: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for every run of `length` words inside one text: hashes, and the number of the first word."""
    total = len(found.hashes)
    if total < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    summed = np.zeros(total - length + 1, np.uint64)
    for place in range(length):
        summed = summed * BASE + found.hashes[place : place + len(summed)]
    # the text of word i ends at first[text of i + 1]
    text_of = np.searchsorted(found.first, np.arange(len(summed)), side="right")
    whole = np.flatnonzero(np.arange(len(summed)) + length <= found.first[np.minimum(text_of, len(found.first) - 1)])
    return mix(summed[whole]), whole
