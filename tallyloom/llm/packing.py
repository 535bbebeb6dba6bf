"""Best-fit packing planned on the histogram of lengths.

Documents are encoded once; what is stored of them is a narrow table of pieces. Its histogram has at
most one row for each possible length, so the whole best-fit plan is made on counts, not on documents:
which ranks of a length go to which sequences, at which offset. Pieces are then ranked within their
length and take the planned place of their rank.
"""

from __future__ import annotations

import os
import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import Scratch
from tallyloom.llm.tokens import loaded

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PLACED = PIECES + ", sequence_id bigint, offset bigint"
MOST_CELLS = 65_536


def cut_pieces(
    documents: DataFrame,
    capacity: int,
    end_id: int,
    tokenizer_file: str,
    ranks_file: str | None = None,
    pattern: str | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pieces of at most `capacity` ids of every document, its ids being followed by `end_id`.

    Only longer documents are cut; the first piece takes what is over, the others are full. Null
    counts as the empty text, which is the end id alone.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = loaded(tokenizer_file, ranks_file, pattern).encode
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for number, content in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                ids = encoder(content.as_py() or "") + end
                total = len(ids) // 4
                start = 0
                length = (total - 1) % capacity + 1
                piece = 0
                while start < total:
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    rows.append((number.as_py(), piece, start, length, crc))
                    start, length, piece = start + length, capacity, piece + 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    narrow = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(encode, PIECES)


def best_fit_plan(histogram: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """For every length, rows (first rank, first sequence, step in sequences, items of a sequence, offset).

    Lengths are placed in decreasing order, each into the fullest open sequences that still take
    it. Open sequences are runs of consecutive numbers with the same room, so a placement handles a
    whole run; the plan's size depends on the capacity, not on the number of documents.
    """
    runs: dict[int, list[tuple[int, int]]] = {}  # room -> runs of sequences (first, how many)
    rooms: list[int] = []  # rooms that have runs, in order
    plan: dict[int, list[tuple[int, int, int, int]]] = {}
    opened = 0

    def put(room: int, first: int, number: int) -> None:
        if room not in runs:
            runs[room] = []
            insort(rooms, room)
        runs[room].append((first, number))

    for length in sorted(histogram, reverse=True):
        left, rank, rows = histogram[length], 0, []
        at = 0
        while left:
            while at < len(rooms) and rooms[at] < length:
                at += 1
            if at == len(rooms):
                break
            room = rooms[at]
            first, number = runs[room].pop()
            fit = room // length  # the same length goes on fitting best into the sequence it went to
            whole = min(number, left // fit)
            if whole:
                rows.append((rank, first, fit, capacity - room))
                rank, left = rank + whole * fit, left - whole * fit
                if room - fit * length:
                    put(room - fit * length, first, whole)
            rest = first + whole
            over = number - whole
            if over and left:
                rows.append((rank, rest, left, capacity - room))
                if room - left * length:
                    put(room - left * length, rest, 1)
                rank, rest, over, left = rank + left, rest + 1, over - 1, 0
            if over:
                runs[room].append((rest, over))
            if not runs[room]:
                del runs[room]
                rooms.remove(room)
            at = 0
        if left:
            fit = capacity // length
            whole, rest = divmod(left, fit)
            if whole:
                rows.append((rank, opened, fit, 0))
                if capacity - fit * length:
                    put(capacity - fit * length, opened, whole)
                opened, rank = opened + whole, rank + whole * fit
            if rest:
                rows.append((rank, opened, rest, 0))
                put(capacity - rest * length, opened, 1)
                opened += 1
        plan[length] = np.array(rows, np.int64)
    return plan


def pack(
    documents: DataFrame,
    scratch: Scratch,
    capacity: int,
    end_id: int,
    tokenizer_file: str,
    ranks_file: str | None = None,
    pattern: str | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    cell_rows: int = 1000,
) -> DataFrame:
    """Every piece with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Offsets are gapless from 0 in every sequence. Repeated rows and null or repeated ids keep their
    pieces. Ranks are counted in cells of a length, so a frequent length does not fill one task.
    """
    pieces = cut_pieces(documents, capacity, end_id, tokenizer_file, ranks_file, pattern, doc_id, text)
    pieces = scratch.keep(pieces.withColumn("row", F.monotonically_increasing_id()))
    # at most one row for each length up to the capacity
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    plan = best_fit_plan(histogram, capacity)
    cells = {length: min(MOST_CELLS, -(-rows // cell_rows)) for length, rows in histogram.items()}
    many = {length: number for length, number in cells.items() if number > 1}
    number = F.lit(1)
    if many:
        listed = F.create_map(*[F.lit(x).cast("long") for pair in many.items() for x in pair])
        number = F.coalesce(F.element_at(listed, F.col("length")), F.lit(1))
    celled = scratch.keep(pieces.withColumn("cell", F.pmod(F.xxhash64("row"), number)))
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        celled.groupBy("length", "cell")
        .agg(F.count(F.lit(1)).alias("rows"))
        .select("length", "cell", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    )
    within = Window.partitionBy("length", "cell").orderBy("row")
    ranked = (
        celled.withColumn("place", F.row_number().over(within))
        .join(offsets, ["length", "cell"])
        .withColumn("rank", F.col("before") + F.col("place") - 1)
        .select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    )
    planned = documents.sparkSession.sparkContext.broadcast(plan)  # bounded by the capacity

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows_of = planned.value
        for batch in batches:
            sequence = np.zeros(len(batch), np.int64)
            offset = np.zeros(len(batch), np.int64)
            lengths, ranks = batch["length"].to_numpy(), batch["rank"].to_numpy()
            for length in np.unique(lengths):
                own = lengths == length
                rows = rows_of[int(length)]
                row = rows[np.searchsorted(rows[:, 0], ranks[own], side="right") - 1]
                turn, item = np.divmod(ranks[own] - row[:, 0], row[:, 2])
                sequence[own] = row[:, 1] + turn
                offset[own] = row[:, 3] + item * length
            yield batch.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    return ranked.mapInPandas(place, PLACED)
