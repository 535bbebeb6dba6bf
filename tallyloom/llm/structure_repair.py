"""Conversation structure repair by dynamic programming over a grammar.

Rows get a fault symbol each, conversations become strings of symbols, and the cheapest edits that
give the role pattern `(s?(ua)+)?` are found once per distinct string, by min-plus matrices of
Re-Pair rules (`repair_grammar`). Rows are ordered by one range exchange, so a conversation may lie
in several tasks; it is cut into pieces of bounded length, whose matrices are folded in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import repair_grammar as grammar
from tallyloom.llm.common import Scratch

BLANKS = "\t\n\x0b\x0c\r "
ENDINGS = (".", "!", "?")
LEGAL = {"su", "ua", "au"}
ROLE_OF = {"u": "user", "a": "assistant"}

# Rows of a piece; symbols that one grammar covers.
PIECE_ROWS = 2_000
GRAMMAR_SYMBOLS = 200_000
# Characters of role and text that order rows of one turn before their digests do.
HEAD = 32

ORDER = ["conv_id", "turn", "role_head", "text_head", "digest"]
PIECE_COLUMNS = (
    "conv_id bigint, part int, seq bigint, symbols string, digests array<binary>, blank bigint, "
    "duplicate bigint, truncated bigint, illegal bigint, first_initial string, last_initial string, "
    "first_turn bigint, last_turn bigint, turns bigint"
)
PIECES = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("part", pa.int32()),
        ("seq", pa.int64()),
        ("symbols", pa.string()),
        ("digests", pa.list_(pa.binary())),
        *[(name, pa.int64()) for name in ("blank", "duplicate", "truncated", "illegal")],
        ("first_initial", pa.string()),
        ("last_initial", pa.string()),
        *[(name, pa.int64()) for name in ("first_turn", "last_turn", "turns")],
    ]
)


@dataclass(frozen=True)
class Repair:
    """`report`: a row per conversation; `rows`: what the repaired conversations hold, in the order
    of (part, seq, place) within a conversation."""

    report: DataFrame
    rows: DataFrame


def _digest(role: Column, text: Column) -> Column:
    length = F.octet_length(role).cast("string")
    return F.unhex(F.sha2(F.concat(length, F.lit(":"), role, text).cast("binary"), 256))


def _whole_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with nulls as one blank, and the digest of role and text."""
    role, text = (F.coalesce(name, F.lit(" ")) for name in ("role", "text"))
    plain = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"))
    return plain.withColumn("digest", _digest(F.col("role"), F.col("text")))


def _narrow_rows(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows without their texts, equal ones once with their number, each with its fault symbol."""
    body = F.rtrim("text", F.lit(BLANKS))
    initial = F.left("role", F.lit(1))
    sound = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    symbol = F.when(F.right(body, F.lit(1)).isin(*ENDINGS), sound).otherwise(F.upper(sound))
    copies = (
        rows.select(
            "conv_id",
            "turn",
            F.left("role", F.lit(HEAD)).alias("role_head"),
            F.left("text", F.lit(HEAD)).alias("text_head"),
            "digest",
            initial.alias("initial"),
            F.when(body != "", symbol).alias("symbol"),  # NULL: blank
        )
        .groupBy(*ORDER, "initial", "symbol")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    # seen first in its lowest turn, a null turn being the lowest
    lowest = F.min(F.struct(F.col("turn").isNotNull().alias("has_turn"), F.col("turn").alias("turn"))).alias("lowest")
    firsts = copies.groupBy(F.col("conv_id").alias("its_conv"), F.col("digest").alias("its_digest")).agg(lowest)
    same = F.col("conv_id").eqNullSafe(F.col("its_conv")) & (F.col("digest") == F.col("its_digest"))
    is_first = F.col("turn").eqNullSafe(F.col("lowest.turn")).alias("is_first")
    return scratch.keep(copies.join(firsts, same).select(*ORDER, "initial", "symbol", "copies", is_first))


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order to pieces, many to a batch."""
    found, held = [], 0
    for piece in _cut(batches, TaskContext.get().partitionId()):
        found.append(piece)
        held += len(piece["symbols"]) + 50
        if held > 20 * PIECE_ROWS:
            yield pa.RecordBatch.from_pylist(found, PIECES)
            found, held = [], 0
    if found:
        yield pa.RecordBatch.from_pylist(found, PIECES)


def _cut(batches: Iterable[pa.RecordBatch], part: int) -> Iterator[dict]:
    """A conversation, or what of it lies together in this task, in stretches of PIECE_ROWS rows."""
    names = ("conv_id", "turn", "digest", "initial", "symbol", "copies", "is_first")
    rows = chain.from_iterable(
        zip(*[batch.column(name).to_pylist() for name in names], strict=True) for batch in batches
    )
    piece, seq = None, 0
    for conv_id, turn, digest, initial, symbol, copies, is_first in rows:
        while copies:
            if piece is None or piece["conv_id"] != conv_id or len(piece["symbols"]) >= PIECE_ROWS:
                if piece is not None:
                    yield piece
                piece, seq = _opened(conv_id, part, seq, initial), seq + 1
            taken = _take(piece, turn, digest, initial, symbol, copies, is_first)
            copies, is_first = copies - taken, False
    if piece is not None:
        yield piece


def _opened(conv_id, part, seq, initial) -> dict:
    return {
        "conv_id": conv_id,
        "part": part,
        "seq": seq,
        "symbols": "",
        "digests": [],
        "blank": 0,
        "duplicate": 0,
        "truncated": 0,
        "illegal": 0,
        "first_initial": initial,
        "last_initial": None,
        "first_turn": None,
        "last_turn": None,
        "turns": 0,
    }


def _take(piece, turn, digest, initial, symbol, copies, is_first) -> int:
    """Adds a row, or as many of its further copies as the piece has room for; how many."""
    if symbol is not None and is_first:
        number, letter = 1, symbol
        piece["digests"].append(digest)
        piece["truncated"] += symbol.isupper()
    else:
        number, letter = min(copies, PIECE_ROWS - len(piece["symbols"])), "d"
        piece["blank" if symbol is None else "duplicate"] += number
    if piece["last_initial"] is not None:
        piece["illegal"] += piece["last_initial"] + initial not in LEGAL
    piece["illegal"] += (number - 1) * (initial + initial not in LEGAL)
    piece["symbols"] += letter * number
    piece["last_initial"] = initial
    if turn is not None:
        if piece["first_turn"] is None:
            piece["first_turn"] = turn
        piece["turns"] += turn != piece["last_turn"]
        piece["last_turn"] = turn
    return number


MATRIX_COLUMNS = "symbols string, costs array<bigint>, audits array<string>"


def _matrices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct strings to matrices, as many strings at a time as one grammar covers."""
    strings, held = [], 0
    for batch in batches:
        for symbols in batch.column(0).to_pylist():
            strings.append(symbols)
            held += len(symbols)
            if held >= GRAMMAR_SYMBOLS:
                yield _matrix_rows(strings)
                strings, held = [], 0
    if strings:
        yield _matrix_rows(strings)


def _matrix_rows(strings: list[str]) -> pa.RecordBatch:
    found = grammar.matrices(strings)
    costs = [[cell and cell[0] for cell in matrix] for matrix in found]
    audits = [[cell and cell[1].flat() for cell in matrix] for matrix in found]
    return pa.RecordBatch.from_pydict(
        {
            "symbols": pa.array(strings, pa.string()),
            "costs": pa.array(costs, pa.list_(pa.int64())),
            "audits": pa.array(audits, pa.list_(pa.string())),
        }
    )


SUMS = ("blank", "duplicate", "truncated", "illegal")
FOLDED_COLUMNS = (
    "conv_id bigint, part int, seq bigint, state int, edits string, is_last boolean, gaps bigint, "
    "blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
)
FOLDED = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("part", pa.int32()),
        ("seq", pa.int64()),
        ("state", pa.int32()),
        ("edits", pa.string()),
        ("is_last", pa.bool_()),
        *[(name, pa.int64()) for name in ("gaps", *SUMS, "cost")],
        ("audit", pa.string()),
    ]
)


def _folded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order, with their matrices, to the edits of each piece and the conversation's sums
    beside the last one."""
    rows = chain.from_iterable(batch.to_pylist() for batch in batches)
    found, held = [], 0
    for conv_id, own in groupby(rows, key=lambda row: row["conv_id"]):
        fold, places = grammar.Fold(), []
        sums, before, first_turn, last_turn, turns = dict.fromkeys(SUMS, 0), None, None, None, 0
        for piece in own:
            fold.add([None if c is None else (c, a) for c, a in zip(piece["costs"], piece["audits"], strict=True)])
            places.append((piece["part"], piece["seq"]))
            for name in SUMS:
                sums[name] += piece[name]
            if before is not None:
                sums["illegal"] += before + piece["first_initial"] not in LEGAL
            before = piece["last_initial"]
            if piece["first_turn"] is not None:
                first_turn = piece["first_turn"] if first_turn is None else first_turn
                turns += piece["turns"] - (piece["first_turn"] == last_turn)
                last_turn = piece["last_turn"]
        cost, audits = fold.result()
        gaps = 0 if first_turn is None else last_turn - first_turn + 1 - turns
        for (part, seq), (state, text) in zip(places, audits, strict=True):
            found.append({"conv_id": conv_id, "part": part, "seq": seq, "state": state, "edits": text, "is_last": False})
            held += len(text) + 50
        audit = "".join(text for _, text in audits)
        found[-1] |= {"is_last": True, "gaps": gaps, **sums, "cost": cost, "audit": audit}
        if held > 1_000_000:
            yield pa.RecordBatch.from_pylist(found, FOLDED)
            found, held = [], 0
    if found:
        yield pa.RecordBatch.from_pylist(found, FOLDED)


EDIT_COLUMNS = "conv_id bigint, part int, seq bigint, place int, digest binary, new_role string"
EDITS = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("part", pa.int32()),
        ("seq", pa.int64()),
        ("place", pa.int32()),
        ("digest", pa.binary()),
        ("new_role", pa.string()),
    ]
)


def _left_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with their edits to the rows they leave; inserted ones have no digest."""
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            found = []
            for piece in batch.slice(start, 500).to_pylist():
                symbols, digests = piece["symbols"], iter(piece["digests"])
                row_digests = [None if symbol == "d" else next(digests) for symbol in symbols]
                key = (piece["conv_id"], piece["part"], piece["seq"])
                for place, (edit, row, role) in enumerate(grammar.edits(piece["edits"], piece["state"], symbols)):
                    if edit != "D":
                        digest = None if row is None else row_digests[row]
                        found.append((*key, place, digest, ROLE_OF.get(role)))
            columns = list(zip(*found, strict=True)) if found else [[] for _ in EDITS]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, EDITS, strict=True)], schema=EDITS
            )


def repair(conversations: DataFrame, scratch: Scratch) -> Repair:
    """Faults, cheapest edits and repaired rows of every conversation.

    Columns read: conv_id, turn, role, text; others may exist. Rows of a conversation are taken by
    turn (nulls first), rows of one turn by role and text (by their first 32 characters, then by
    digest). The first fault of a row counts: blank (no character other than white space),
    duplicate (role and text seen earlier in the conversation), truncated (its last such character
    is none of `.!?`). Edits: keep costs 0, giving the role user or assistant 2, deleting 3 (must
    be for blank and duplicate rows), inserting an empty row of either role 2; a truncated row that
    stays adds 1. The edits give initials of roles that match `(s?(ua)+)?`; of equal costs the
    ASCII-least string of the edits' initials (D, I, K, R) is taken.

    `report` has conv_id, gaps (turns missing between lowest and highest), blank, duplicate,
    truncated, illegal (neighbours whose initials are not su, ua or au), cost and audit. `rows` has
    conv_id, part, seq, place, role and text. Null roles and texts are one blank; an empty role has
    no initial and cannot be kept. A null conv_id is a conversation; null turns are no turns for
    `gaps`. Repeated rows are duplicates. An empty table gives empty results.

    Only texts of different rows are shuffled, once to their edits and once into order; all else
    works on digests. Rows and pieces are dealt by range, so a conversation or a turn of any size
    is spread; its audit is one value of the report and is put together by one task.
    """
    rows = _whole_rows(conversations)
    narrow = _narrow_rows(rows, scratch)
    ordered = narrow.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    pieces = scratch.keep(ordered.mapInArrow(_pieces, PIECE_COLUMNS))
    matrices = pieces.select("symbols").distinct().mapInArrow(_matrices, MATRIX_COLUMNS)
    in_order = (
        pieces.drop("digests")
        .join(matrices, "symbols")
        .drop("symbols")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "part", "seq")
    )
    folded = scratch.keep(in_order.mapInArrow(_folded, FOLDED_COLUMNS))
    report = folded.filter("is_last").select("conv_id", "gaps", *SUMS, "cost", "audit")
    left = (
        pieces.select("conv_id", "part", "seq", "symbols", "digests")
        .join(folded.select("part", "seq", "state", "edits"), ["part", "seq"])
        .select("conv_id", "part", "seq", "symbols", "digests", "state", "edits")
        .mapInArrow(_left_rows, EDIT_COLUMNS)
    )
    left = scratch.keep(left)
    # a digest stands for one role and text, so any of its rows will do
    texts = rows.groupBy(F.col("conv_id").alias("its_conv"), F.col("digest").alias("its_digest")).agg(
        F.first(F.struct("role", "text")).alias("own")
    )
    same = F.col("conv_id").eqNullSafe(F.col("its_conv")) & (F.col("digest") == F.col("its_digest"))
    place = ["conv_id", "part", "seq", "place"]
    stayed = left.filter("digest IS NOT NULL").join(texts, same).select(
        *place, F.coalesce("new_role", "own.role").alias("role"), F.col("own.text").alias("text")
    )
    inserted = left.filter("digest IS NULL").select(*place, F.col("new_role").alias("role"), F.lit("").alias("text"))
    return Repair(report, stayed.unionByName(inserted))


def text_digests(rows: DataFrame) -> DataFrame:
    """conv_id and sha256 (lowercase hex) of the `role:text` lines of each repaired conversation,
    read in order and never held together."""
    order = ["conv_id", "part", "seq", "place"]
    line = F.concat("role", F.lit(":"), "text").alias("line")
    in_order = rows.select(*order, line).repartition("conv_id").sortWithinPartitions(*order)
    return in_order.select("conv_id", "line").mapInArrow(_hashed, "conv_id bigint, sha256 string")


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = chain.from_iterable(
        zip(batch.column(0).to_pylist(), (line.as_py() for line in batch.column(1)), strict=True) for batch in batches
    )
    ids, digests = [], []
    for conv_id, own in groupby(rows, key=lambda row: row[0]):
        state, joint = hashlib.sha256(), b""
        for _, line in own:
            state.update(joint + line.encode())
            joint = b"\n"
        ids.append(conv_id)
        digests.append(state.hexdigest())
        if len(ids) >= 10_000:
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array(ids, pa.int64()), "sha256": digests})
            ids, digests = [], []
    if ids:
        yield pa.RecordBatch.from_pydict({"conv_id": pa.array(ids, pa.int64()), "sha256": digests})
