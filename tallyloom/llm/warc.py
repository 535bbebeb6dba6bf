"""WARC archives, index first.

Writing puts every record as a gzip member of its own into archives of bounded size and gives an
index with a row per record: archive, offset, length, URL and digest. Reading takes any selection
of the index, sorts it by place, joins byte ranges that lie close together into one read each, and
cuts the records out of what was read. A payload that several pages share is written once, as the
response of the page with the largest id; the others are revisit records that refer to it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values of the WARC 1.1 format
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

WARC_DATE = "2024-01-01T00:00:00Z"
ARCHIVE_BYTES = 1_000_000_000
READ_BYTES = 8_000_000
GAP_BYTES = 64_000
# compressed bytes of the records that one reading task gets
TASK_BYTES = 16_000_000
# decompressed bytes after which a reader hands its records on
HELD_BYTES = 16_000_000

INDEX = pa.schema(
    [
        ("archive", pa.string()),
        ("offset", pa.int64()),
        ("length", pa.int64()),
        ("url", pa.string()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("page_id", pa.int64()),
    ]
)
INDEX_COLUMNS = (
    "archive string, offset bigint, length bigint, url string, payload_digest string, "
    "record_type string, page_id bigint"
)
RECORD_COLUMNS = (
    "record_id string, record_type string, page_id bigint, url string, refers_to_id string, "
    "payload_bytes bigint, payload_digest string, declared_digest string, payload string"
)


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """What is to be written: a row per page, with its payload if it is a response.

    Payloads are equal when their bytes are. Of pages with equal payloads of at least `least_bytes`
    that with the largest page_id (then the largest url; nulls are smallest) is the response. Of
    repeated rows one is the response. Only one copy of a payload is shuffled per task that read
    it; revisits move without payloads.
    """
    payload = F.coalesce("html", F.lit(""))
    known = pages.select("page_id", "url", payload.alias("payload")).withColumns(
        {
            "payload_bytes": F.octet_length("payload").cast("bigint"),
            "key": F.sha2(F.col("payload").cast("binary"), 256),
            "sha1": F.sha1(F.col("payload").cast("binary")),
        }
    )
    shared = known.filter(F.col("payload_bytes") >= least_bytes)
    top = F.max(F.struct("page_id", "url")).alias("top")
    responses = shared.groupBy("key", "sha1", "payload_bytes").agg(top, F.first("payload").alias("payload"))
    tops = shared.groupBy("key").agg(top)
    copies = shared.groupBy("page_id", "url", "key", "sha1", "payload_bytes").agg(F.count(F.lit(1)).alias("copies"))
    is_top = F.col("page_id").eqNullSafe(F.col("top.page_id")) & F.col("url").eqNullSafe(F.col("top.url"))
    revisits = (
        copies.join(tops, "key")
        .withColumn("others", F.col("copies") - F.when(is_top, 1).otherwise(0))
        .filter(F.col("others") > 0)
        .select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("others"))).alias("copy"))
    )
    nothing = F.lit(None).cast("string")
    columns = ["page_id", "url", "payload", "payload_bytes", "sha1", "copy", "refers_page", "refers_url"]
    whole = responses.select(
        F.col("top.page_id").alias("page_id"),
        F.col("top.url").alias("url"),
        "payload",
        "payload_bytes",
        "sha1",
        F.lit(0).cast("bigint").alias("copy"),
        F.lit(None).cast("bigint").alias("refers_page"),
        nothing.alias("refers_url"),
    )
    referring = revisits.select(
        "page_id",
        "url",
        nothing.alias("payload"),
        "payload_bytes",
        "sha1",
        "copy",
        F.col("top.page_id").alias("refers_page"),
        F.col("top.url").alias("refers_url"),
    )
    small = known.filter(F.col("payload_bytes") < least_bytes).select(
        "page_id",
        "url",
        "payload",
        "payload_bytes",
        "sha1",
        (-1 - F.monotonically_increasing_id()).alias("copy"),
        F.lit(None).cast("bigint").alias("refers_page"),
        nothing.alias("refers_url"),
    )
    found = whole.unionByName(referring)
    return (found.unionByName(small) if least_bytes > 0 else found).select(columns)


def write_archives(
    pages: DataFrame,
    folder: str,
    least_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
    date: str = WARC_DATE,
) -> DataFrame:
    """Write a record per row of `pages` (page_id, url, html) below `folder`; the index, stored.

    A null html is an empty payload, a null url or page_id a field that the record lacks. Every
    task writes archives under names of its own and a new one after `archive_bytes`, so a task that
    is run again leaves a file that the index does not name. The index is written by Spark and is
    complete or absent. No page gives no archive and an empty index. `folder` is one that pyarrow
    can write on the executors (a shared folder, hdfs, s3, gs). Other columns are not read.
    """
    spark, place = pages.sparkSession, f"{folder}/index"
    written = records(pages, least_bytes).mapInArrow(_writer(_uri(folder), archive_bytes, date), INDEX_COLUMNS)
    written.write.parquet(place)
    return spark.read.schema(INDEX_COLUMNS).parquet(place)


def _uri(folder: str) -> str:
    if folder.startswith("/"):
        return f"file://{folder}"
    return re.sub(r"^file:/(?!//)", "file:///", folder)


def _base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _record_id(page_id: int | None, url: str | None, sha1: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, repr((page_id, url, sha1, copy)))}>"


def _field_text(text: str) -> str:
    """A field holds one line: control characters and blanks are written as percent codes."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def encode(row: dict, date: str) -> bytes:
    """The record of one row of `records`, not compressed."""
    is_response = row["payload"] is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n"
    block = http.encode() + (row["payload"].encode() if is_response else b"")
    fields = [
        ("WARC-Type", "response" if is_response else "revisit"),
        ("WARC-Record-ID", _record_id(row["page_id"], row["url"], row["sha1"], row["copy"])),
        ("WARC-Date", date),
        ("WARC-Target-URI", row["url"] and _field_text(row["url"])),
        ("WARC-Payload-Digest", f"sha1:{_base32(row['sha1'])}"),
        ("Page-Id", row["page_id"]),
    ]
    if not is_response:
        fields += [
            ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Refers-To", _record_id(row["refers_page"], row["refers_url"], row["sha1"], 0)),
            ("WARC-Refers-To-Target-URI", row["refers_url"] and _field_text(row["refers_url"])),
        ]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    lines = [f"{name}: {value}".encode() for name, value in fields if value is not None]
    return b"\r\n".join([VERSION, *lines, b"", block, b"", b""])


def decode(record: bytes) -> dict:
    """What a record says, with its payload read and measured anew if it has one."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != VERSION.decode():
        raise ValueError(f"no WARC record: {version[:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"a record of another length than {size}")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    is_response = fields["WARC-Type"] == "response"
    if is_response:
        length, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    else:
        length, digest = None, None
    declared = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if is_response and declared != length:
        raise ValueError(f"a payload of {length} bytes instead of {declared}")
    page_id = fields.get("Page-Id")
    return {
        "record_id": fields["WARC-Record-ID"],
        "record_type": fields["WARC-Type"],
        "page_id": None if page_id is None else int(page_id),
        "url": fields.get("WARC-Target-URI"),
        "refers_to_id": fields.get("WARC-Refers-To"),
        "payload_bytes": length,
        "payload_digest": digest,
        "declared_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "payload": payload.decode() if is_response else None,
    }


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows of a batch, a few at a time: payloads may be long."""
    for start in range(0, batch.num_rows, 256):
        yield from batch.slice(start, 256).to_pylist()


def _writer(folder: str, archive_bytes: int, date: str):
    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        out, name, offset = None, "", 0
        try:
            for batch in batches:
                entries = []
                for row in _rows(batch):
                    if out is None or offset >= archive_bytes:
                        if out is not None:
                            out.close()
                        files.create_dir(root, recursive=True)
                        name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{root}/{name}", compression=None)
                    member = gzip.compress(encode(row, date), 6, mtime=0)
                    out.write(member)
                    entries.append(
                        {
                            "archive": f"{folder}/{name}",
                            "offset": offset,
                            "length": len(member),
                            "url": row["url"],
                            "payload_digest": _base32(row["sha1"]),
                            "record_type": "revisit" if row["payload"] is None else "response",
                            "page_id": row["page_id"],
                        }
                    )
                    offset += len(member)
                yield pa.RecordBatch.from_pylist(entries, INDEX)
        finally:
            if out is not None:
                out.close()

    return of


def close_ranges(
    places: Iterable[tuple[str, int, int]], gap: int, most: int
) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Sorted places (archive, offset, length) as reads: archive, start, stop and the places in it.

    A place joins a read if at most `gap` bytes lie between and the read stays within `most` bytes;
    a longer place is a read by itself. Memory is that of one read.
    """
    archive, start, stop, inside = None, 0, 0, []
    for name, offset, length in places:
        end = offset + length
        if inside and name == archive and offset - stop <= gap and max(stop, end) - start <= most:
            stop = max(stop, end)
        else:
            if inside:
                yield archive, start, stop, inside
            archive, start, stop, inside = name, offset, end, []
        inside.append((offset, length))
    if inside:
        yield archive, start, stop, inside


def read_records(index: DataFrame, gap: int = GAP_BYTES, most: int = READ_BYTES, payloads: bool = True) -> DataFrame:
    """The records that the rows of `index` (archive, offset, length) name; repeated rows each.

    Payload bytes and digest of a response are measured on what was read; a record that cannot be
    read whole is an error. Revisits have neither, see `resolve`. Without `payloads` the texts stay
    in the task. An empty index gives no rows. The number of tasks follows the bytes to be read, not
    the size of the index.
    """
    places = index.select("archive", "offset", "length")
    total = places.agg(F.sum("length")).first()[0] or 0
    tasks = 1 + total // TASK_BYTES
    placed = places.repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset")
    return placed.mapInArrow(_reader(gap, most, payloads), RECORD_COLUMNS)


def _reader(gap: int, most: int, payloads: bool):
    shape = pa.schema(
        [
            (column.split()[0], pa.int64() if column.endswith("bigint") else pa.string())
            for column in RECORD_COLUMNS.split(", ")
        ]
    )

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = chain.from_iterable(zip(*[c.to_pylist() for c in batch.columns], strict=True) for batch in batches)
        opened, source, found, held = None, None, [], 0
        try:
            for archive, start, stop, inside in close_ranges(places, gap, most):
                if archive != opened:
                    if source is not None:
                        source.close()
                    files, path = fs.FileSystem.from_uri(archive)
                    opened, source = archive, files.open_input_file(path)
                run = source.read_at(stop - start, start)
                for offset, length in inside:
                    raw = gzip.decompress(run[offset - start : offset - start + length])
                    record = decode(raw)
                    if not payloads:
                        record["payload"] = None
                    found.append(record)
                    held += len(raw) if payloads else 1_000
                    if held > HELD_BYTES:
                        yield pa.RecordBatch.from_pylist(found, shape)
                        found, held = [], 0
            if found:
                yield pa.RecordBatch.from_pylist(found, shape)
        finally:
            if source is not None:
                source.close()

    return of


def resolve(read: DataFrame) -> DataFrame:
    """Read records with bytes and digest of the whole payload, and the page that a revisit refers to.

    A revisit takes both from the response it refers to. One whose response is not among the
    records keeps its declared digest and has neither bytes nor page. Every record is read once
    (`read` is a stored table or cheap to compute twice).
    """
    targets = read.filter("record_type = 'response'").select(
        F.col("record_id").alias("target_id"),
        F.col("page_id").alias("target_page"),
        F.col("payload_bytes").alias("target_bytes"),
        F.col("payload_digest").alias("target_digest"),
    )
    own = read.filter("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("bigint"))
    revisits = read.filter("record_type <> 'response'").join(
        targets, F.col("refers_to_id") == F.col("target_id"), "left"
    )
    resolved = revisits.select(
        *[c for c in read.columns if c not in ("payload_bytes", "payload_digest")],
        F.col("target_bytes").alias("payload_bytes"),
        F.coalesce("target_digest", "declared_digest").alias("payload_digest"),
        F.col("target_page").alias("refers_to"),
    )
    return own.unionByName(resolved)
