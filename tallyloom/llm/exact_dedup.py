"""Exact duplicates by deterministic block naming.

Every text is cut into blocks of a fixed number of bytes. Equal blocks are brought together by
sorting and get one integer name, the smallest number of their occurrences, so that different blocks
never share a name and no hash decides about equality. Then adjacent names are paired and the pairs
named the same way, level by level, until every document has one name. Documents with the same
name at the same level are equal, byte for byte.

The occurrences of a frequent block are dealt to parts of about a fixed number of rows. Every part gets
a name; the parts, a thousandth as many rows, are then blocks to be named themselves, in the same way,
until no block is frequent.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import Scratch

PART_ROWS = 1000
# Frequent blocks that are sent to all tasks, as pairs of longs. Beyond a thousand times a million
# occurrences the limit of a part grows, so that no more can be frequent.
MOST_HOT = 1_000_000


def name_documents(
    documents: DataFrame,
    scratch: Scratch,
    doc_id: str = "doc_id",
    text: str = "text",
    row: str | None = None,
    block_bytes: int = 8192,
) -> DataFrame:
    """One row per document: doc_id, row, sha, level and name; equal (level, name): equal texts.

    `row` names a column of unique longs, else rows are numbered by their place. Null counts as the empty text, which is one empty block. Repeated rows, null and repeated ids
    are kept, each with its own row. Other columns are not read. The input is read twice; it must
    give the same rows in the same order when a task runs again, as files do.
    """
    blocks = (
        documents.select(
            F.col(doc_id).alias("doc_id"),
            F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary")).alias("bytes"),
            (F.col(row) if row else F.monotonically_increasing_id()).alias("row"),
        )
        .select(
            "doc_id",
            "row",
            F.unhex(F.sha2("bytes", 256)).alias("sha"),
            F.greatest(F.lit(1), F.ceil(F.length("bytes") / block_bytes)).cast("int").alias("size"),
            "bytes",
        )
        .withColumn(
            "blocks",
            F.expr(
                f"transform(sequence(0, size - 1),"
                f" i -> substring(bytes, i * {block_bytes} + 1, {block_bytes}))"
            ),
        )
        .select("doc_id", "row", "sha", "size", F.posexplode("blocks").alias("place", "content"))
    )
    named = _with_names(blocks, scratch)
    finished = [named.filter("size = 1").select("doc_id", "row", "sha", F.lit(0).alias("level"), "name")]
    waiting = named.filter("size > 1")
    level = 0
    while not waiting.isEmpty():
        level += 1
        pairs = (
            waiting.groupBy("row")
            .agg(
                F.first("doc_id").alias("doc_id"),
                F.first("sha").alias("sha"),
                # as long as the document has blocks
                F.array_sort(F.collect_list(F.struct("place", "name"))).alias("names"),
            )
            .withColumn("size", F.ceil(F.size("names") / 2).cast("int"))
            .select(
                "doc_id",
                "row",
                "sha",
                "size",
                F.posexplode(
                    F.expr(
                        "transform(sequence(0, size - 1), i -> named_struct('left', names[2 * i].name,"
                        " 'right', get(names, 2 * i + 1).name))"
                    )
                ).alias("place", "content"),
            )
        )
        # written first, as the numbers of the occurrences must not change any more
        named = _with_names(scratch.keep(pairs), scratch)
        finished.append(
            named.filter("size = 1").select("doc_id", "row", "sha", F.lit(level).alias("level"), "name")
        )
        waiting = named.filter("size > 1")
    return reduce(DataFrame.union, finished)


def _with_names(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Replaces `content` by `name`, a long; equal contents get equal names, others never do."""
    numbered = rows.withColumn("number", F.monotonically_increasing_id())
    named = _named(numbered, scratch)
    return named.drop("number")


def _named(numbered: DataFrame, scratch: Scratch) -> DataFrame:
    """The same for rows with a `number` of their own, which it keeps; a name is one of the numbers."""
    digests = numbered.groupBy(F.xxhash64("content").alias("digest")).agg(F.count(F.lit(1)).alias("rows"))
    digests = scratch.keep(digests)
    total, most = digests.agg(F.sum("rows"), F.max("rows")).first()
    most_rows = max(PART_ROWS, (total or 0) // MOST_HOT)
    # at most MOST_HOT digests can be above it: a bounded broadcast
    hot = digests.filter(F.col("rows") > most_rows).select(
        "digest", F.ceil(F.col("rows") / most_rows).alias("parts")
    )
    dealt = (
        numbered.withColumn("digest", F.xxhash64("content"))
        .join(F.broadcast(hot), "digest", "left")
        .withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("number"), "parts")))
    )
    same = Window.partitionBy("content", "part")
    others = [name for name in numbered.columns if name != "content"]
    by_part = scratch.keep(
        dealt.withColumn("name", F.min("number").over(same)).select(
            *others,
            "name",
            F.when(F.col("part").isNotNull() & (F.col("name") == F.col("number")), F.col("content"))
            .alias("of_part"),
        )
    )
    if (most or 0) <= most_rows:
        return by_part.drop("of_part")
    # one row for each part of a frequent block, numbered by the part's name
    parts = by_part.filter("of_part IS NOT NULL").select(
        F.col("name").alias("number"), F.col("of_part").alias("content")
    )
    unified = _named(parts, scratch).select(F.col("number").alias("name"), F.col("name").alias("one"))
    # stored on both sides, and no part has many more rows than the limit
    return (
        by_part.drop("of_part")
        .join(unified.filter("one <> name"), "name", "left")
        .withColumn("name", F.coalesce("one", "name"))
        .drop("one")
    )


def exact_duplicates(
    documents: DataFrame,
    scratch: Scratch,
    doc_id: str = "doc_id",
    text: str = "text",
    row: str | None = None,
    block_bytes: int = 8192,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, row.

    Of equal texts the row with the largest id stays (a null id is below all others); of rows
    that repeat text and id, exactly one.
    """
    named = scratch.keep(name_documents(documents, scratch, doc_id, text, row, block_bytes))
    groups = scratch.keep(
        named.groupBy("level", "name").agg(
            F.max(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size")
        )
    )
    # both sides are stored tables, so a partition that a large group fills is split while it runs
    return named.join(groups, ["level", "name"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("best.row") == F.col("row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "row",
    )
