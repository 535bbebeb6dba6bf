"""Quality classifier from weak labels.

Overlapping heuristics each call a text bad or good, or abstain. Their accuracies are estimated by
expectation-maximisation over the counts of all vote patterns of the corpus (at most 3 to the number
of heuristics, so they fit the driver at any size), without true labels. The posterior of a pattern
then labels the texts of a bounded sample, on which a linear scorer over hashed features is trained.
The scorer decides about every text, from the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import Scratch, hash62
from tallyloom.llm.words import mix, slices, table, words

GOOD, BAD, ABSTAIN = 0, 1, 2
DIMENSIONS = 2048
GRAM = 4
SPACES = [9, 10, 11, 12, 13, 32]
WORD_BYTES = table([b for b in range(256) if b not in SPACES])
LINE_BYTES = table([b for b in range(256) if b not in (10, 13)], lower=False)
MARKS = {mark: n for n, mark in enumerate(".,!|'\"?;:-()", start=6)}


def _classes() -> np.ndarray:
    """0 symbols, 1 lower case and beyond ASCII, 2 capitals, 3 digits, 4 blanks, 5 line breaks, marks."""
    kinds = np.zeros(256, np.uint8)
    kinds[128:] = 1
    for byte in range(128):
        letter = chr(byte)
        if letter in MARKS:
            kinds[byte] = min(MARKS[letter], 15)
        elif letter.islower():
            kinds[byte] = 1
        elif letter.isupper():
            kinds[byte] = 2
        elif letter.isdigit():
            kinds[byte] = 3
        elif byte in (10, 13):
            kinds[byte] = 5
        elif byte in SPACES:
            kinds[byte] = 4
    return kinds


CLASSES = _classes()


@dataclass
class Measures:
    """Figures of the texts of one slice."""

    kinds: np.ndarray  # text x byte class
    n_words: np.ndarray
    repeated_words: np.ndarray  # words equal to the word before them
    distinct_words: np.ndarray
    n_lines: np.ndarray
    distinct_lines: np.ndarray


def _distinct(found, number: int) -> np.ndarray:
    text = np.repeat(np.arange(number), np.diff(found.first))
    order = np.lexsort((found.hashes, text))
    hashes, text = found.hashes[order], text[order]
    new = np.ones(len(text), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return np.bincount(text[new], minlength=number)


def measure(data: np.ndarray, offsets: np.ndarray) -> Measures:
    number = len(offsets) - 1
    text = np.repeat(np.arange(number, dtype=np.int64), np.diff(offsets))
    kinds = np.bincount(text * 16 + CLASSES[data], minlength=number * 16).reshape(number, 16)
    found = words(data, offsets, WORD_BYTES)
    same = np.zeros(len(found.hashes), np.int64)
    same[1:] = found.hashes[1:] == found.hashes[:-1]
    same[found.first[:-1][np.diff(found.first) > 0]] = 0
    counted = np.concatenate([[0], np.cumsum(same)])
    lines = words(data, offsets, LINE_BYTES)
    return Measures(
        kinds,
        np.diff(found.first),
        counted[found.first[1:]] - counted[found.first[:-1]],
        _distinct(found, number),
        np.diff(lines.first),
        _distinct(lines, number),
    )


def _vote(value: np.ndarray, good_below: float, bad_above: float, heard: np.ndarray) -> np.ndarray:
    votes = np.full(len(value), ABSTAIN)
    votes[value < good_below] = GOOD
    votes[value > bad_above] = BAD
    votes[~heard] = ABSTAIN
    return votes


def heuristics(m: Measures) -> np.ndarray:
    """Votes, text x heuristic. Each looks at one trait and abstains on texts too short for it."""
    with np.errstate(divide="ignore", invalid="ignore"):
        letters = m.kinds[:, 1] + m.kinds[:, 2]
        shown = m.kinds.sum(1) - m.kinds[:, 4] - m.kinds[:, 5]
        return np.stack(
            [
                _vote(m.kinds[:, 0] / shown, 0.02, 0.08, shown >= 20),  # symbols
                _vote(m.kinds[:, 2] / letters, 0.2, 0.4, letters >= 20),  # capitals
                _vote(m.kinds[:, MARKS["!"]] / m.n_words, 0.02, 0.15, m.n_words >= 5),  # shouting
                _vote(m.kinds[:, MARKS["|"]] / m.n_words, 0.02, 0.15, m.n_words >= 5),  # tables
                _vote(m.repeated_words / m.n_words, 0.02, 0.15, m.n_words >= 5),  # stutter
                _vote(1 - m.distinct_words / m.n_words, 0.5, 0.75, (m.n_words >= 40) & (m.n_words < 2000)),
                _vote(1 - m.distinct_lines / m.n_lines, 0.1, 0.4, m.n_lines >= 4),  # repeated lines
                _vote(m.n_lines / m.n_words, 0.25, 0.45, m.n_lines >= 5),  # short lines
            ],
            axis=1,
        )


HEURISTICS = 8


# Texts whose features are held at once, as rows of DIMENSIONS numbers.
ROWS_AT_ONCE = 256


def _by_slice(column: pa.Array, width: tuple, kind, one) -> np.ndarray:
    out = np.zeros((len(column), *width), kind)
    for row, data, offsets in slices(column):
        for first in range(0, len(offsets) - 1, ROWS_AT_ONCE):
            part = offsets[first : first + ROWS_AT_ONCE + 1]
            out[row + first : row + first + len(part) - 1] = one(data[part[0] : part[-1]], part - part[0])
    return out


def _codes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return heuristics(measure(data, offsets)) @ (3 ** np.arange(HEURISTICS))


def _features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Roots of shares of hashed runs of byte classes, and of repeated words and lines."""
    number = len(offsets) - 1
    m = measure(data, offsets)
    grams = np.zeros(max(0, len(data) - GRAM + 1), np.int64)
    for place in range(GRAM):
        grams = grams * 16 + CLASSES[data[place : place + len(grams)]]
    text = np.repeat(np.arange(number, dtype=np.int64), np.diff(offsets))[: len(grams)]
    inside = np.arange(len(grams)) + GRAM <= offsets[1:][text]
    bins = _BINS[grams[inside]]
    counts = np.bincount(text[inside] * DIMENSIONS + bins, minlength=number * DIMENSIONS)
    counts = counts.reshape(number, DIMENSIONS).astype(np.float32)
    values = np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))
    whole = np.maximum(1, m.n_words)
    for place, share in (
        (_named(1), m.repeated_words / whole),
        (_named(2), 1 - m.distinct_words / whole),
        (_named(3), 1 - m.distinct_lines / np.maximum(1, m.n_lines)),
    ):
        values[:, place] += np.sqrt(np.maximum(0, share))
    return values


_BINS = (mix(np.arange(16**GRAM, dtype=np.uint64)) % np.uint64(DIMENSIONS)).astype(np.int64)


def _named(number: int) -> int:
    return int(mix(np.array([10**9 + number], np.uint64))[0] % np.uint64(DIMENSIONS))


def _votes_column(text: Column) -> Column:
    @F.arrow_udf("int")
    def votes(column: pa.Array) -> pa.Array:
        return pa.array(_by_slice(column, (), np.int32, _codes))

    return votes(text)


def estimate(patterns: dict[int, int], rounds: int = 100, most_false_alarms: float = 0.0005) -> dict[int, float]:
    """P(bad) of each vote pattern, by expectation-maximisation over its counts.

    Every heuristic has, for good and for bad texts, its own rate of calling a text bad; abstaining
    says nothing. The heuristics look for defects of different kinds, so most bad texts are bad to
    one or two of them only, and two free classes would settle on any other contrast in the corpus.
    Therefore the rate of false alarms may be estimated up to `most_false_alarms` only. It starts
    from the belief that a text which any heuristic calls bad probably is.
    """
    codes = np.array(sorted(patterns), np.int64)
    if not len(codes):
        return {}
    counts = np.array([patterns[int(c)] for c in codes], float)
    votes = codes[:, None] // 3 ** np.arange(HEURISTICS) % 3
    called_bad, heard = votes == BAD, votes != ABSTAIN
    bad = np.where(called_bad.any(1), 0.9, 0.02)
    for _ in range(rounds):
        logs = []
        for weight, bounds in (
            (counts * (1 - bad), (1e-6, most_false_alarms)),
            (counts * bad, (2 * most_false_alarms, 1 - 1e-6)),
        ):
            share = (weight.sum() + 1) / (counts.sum() + 2)
            rate = ((weight @ called_bad) + 0.1) / ((weight @ heard) + 0.2)
            rate = np.clip(rate, *bounds)
            logs.append(np.log(share) + called_bad @ np.log(rate) + (heard & ~called_bad) @ np.log(1 - rate))
        bad = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
    return dict(zip(codes.tolist(), bad.tolist(), strict=True))


def fit_scorer(values: np.ndarray, target: np.ndarray, steps: int = 150, penalty: float = 1e-4) -> np.ndarray:
    """Weights of a logistic scorer (the last is the constant), by accelerated gradient steps."""
    values = np.hstack([values.astype(np.float32), np.ones((len(values), 1), np.float32)])
    weights = np.zeros(values.shape[1], np.float32)
    ahead, pace = weights.copy(), 1.0
    rate = 4.0 / max(1e-9, float((values**2).sum(1).mean()))
    for _ in range(steps):
        guess = 1 / (1 + np.exp(-np.clip(values @ ahead, -30, 30)))
        step = ahead - rate * (values.T @ (guess - target) / max(1, len(target)) + penalty * ahead)
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = step + (pace - 1) / faster * (step - weights)
        weights, pace = step, faster
    return weights


@dataclass
class QualityModel:
    """Posteriors of vote patterns, and the scorer's weights."""

    posteriors: dict[int, float]
    weights: np.ndarray

    def score(self, text: Column) -> Column:
        """P(bad), from the whole text; a null text is an empty one."""
        weights = self.weights  # DIMENSIONS + 1 numbers

        def one(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
            # each row is summed by itself, so that its neighbours do not move the last digits
            total = (_features(data, offsets) * weights[:-1]).sum(1, dtype=np.float64) + weights[-1]
            return 1 / (1 + np.exp(-np.clip(total, -30, 30)))

        @F.arrow_udf("double")
        def score(column: pa.Array) -> pa.Array:
            return pa.array(_by_slice(column, (), np.float64, one))

        return score(text)


def train(documents: DataFrame, scratch: Scratch, text: str = "text", sample_rows: int = 4000) -> QualityModel:
    """Estimates the heuristics on all texts and trains the scorer on `sample_rows` distinct ones.

    The sample are the texts with the smallest digests, so it depends on the texts only, neither on
    their order and files nor on how often one repeats; there are fewer if the table has fewer. An
    empty table gives a scorer that keeps everything.
    """
    read = documents.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    # counted by digest in every task before the shuffle
    voted = scratch.keep(
        read.select(hash62("text").alias("digest"), _votes_column(F.col("text")).alias("votes"))
        .groupBy("digest", "votes")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    # at most 3 ** HEURISTICS patterns
    patterns = {row[0]: row[1] for row in voted.groupBy("votes").agg(F.sum("rows")).collect()}
    posteriors = estimate(patterns)
    if not patterns:
        weights = np.zeros(DIMENSIONS + 1, np.float32)
        weights[-1] = -30
        return QualityModel(posteriors, weights)
    # sample_rows longs
    last = voted.select("digest").distinct().orderBy("digest").limit(sample_rows).agg(F.max("digest")).first()[0]

    @F.arrow_udf("binary")
    def features(column: pa.Array) -> pa.Array:
        rows = _by_slice(column, (DIMENSIONS,), np.float16, _features)
        return pa.array([row.tobytes() for row in rows], pa.binary())

    def fit(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values("digest", kind="stable")
        target = sample["votes"].map(posteriors).to_numpy(np.float32)
        values = np.frombuffer(b"".join(sample["features"]), np.float16).reshape(len(sample), DIMENSIONS)
        return pd.DataFrame({"weights": [fit_scorer(values, target).tolist()]})

    # of equal texts one stays in each task, and then one in all
    chosen = (
        read.withColumn("digest", hash62("text"))
        .filter(F.col("digest") <= last)
        .groupBy("digest")
        .agg(F.min("text").alias("text"))
        .select(
            "digest", _votes_column(F.col("text")).alias("votes"), features(F.col("text")).alias("features")
        )
    )
    fitted = chosen.groupBy(F.lit(0).alias("all")).applyInPandas(fit, "weights array<float>").first()
    return QualityModel(posteriors, np.array(fitted[0], np.float32))


def classify(
    documents: DataFrame,
    scratch: Scratch,
    doc_id: str = "doc_id",
    text: str = "text",
    sample_rows: int = 4000,
    reject_from: float = 0.7,
) -> DataFrame:
    """One row per document: doc_id, score (P(bad)) and kept. Repeated rows keep their rows, a null text
    counts as empty; equal texts have equal scores, however the table is cut into files."""
    model = train(documents, scratch, text, sample_rows)
    return documents.select(F.col(doc_id).alias("doc_id"), model.score(F.col(text)).alias("score")).withColumn(
        "kept", F.col("score") < reject_from
    )
