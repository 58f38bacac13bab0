"""WARC archives with one gzip member per record, and a splittable reader.

Writing: of pages with equal payloads the one with the smallest id is a ``response``, the
others are ``revisit`` records that carry headers only and name it. The digests are
compared in a narrow aggregate; pages then move once, by id, into archives.

Reading: an archive is cut into byte ranges, a task each. A task scans its range for the gzip
magic, takes each place as a candidate and decodes its first bytes; it is a record only if
they inflate to a WARC header, of any length, with a record id and a length. A task owns the records
that start inside its range and reads on past the end for the last one. After an owned record
the next one is looked for right behind it, so payload bytes are scanned only at the start
of a range. So every record is read once, however the ranges fall.

A null html is an empty payload. Rows with a null page_id are written as responses, are never
referred to and come back with a null id. Repeated rows (same id, same payload) are one
record each: responses if theirs is the smallest id of the payload, else revisits. A null url becomes ``urn:none``; control characters and blanks in urls are
percent-encoded. An empty table gives no archive and no row. Further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import written
from leafmill.llm.files import make_folder, opened

MAGIC = b"\x1f\x8b\x08"
HEAD_BYTES = 1 << 16  # inflated at a time while the end of a record's headers is looked for
BLOCK = 1 << 18
ARCHIVE_BYTES = 1 << 30  # of payload per archive
SPLIT_BYTES = 16 << 20
DATE = "1970-01-01T00:00:00Z"  # the tables have no fetch time
PAGE = "urn:page:"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(
    page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int = 6
) -> bytes:
    """One gzip member."""
    target = "".join(
        c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode())
        for c in url or "urn:none"
    )
    name = "none" if page_id is None else str(page_id)
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{PAGE}{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
    ]
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{PAGE}{refers_to}>",
        ]
    lines += [
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        "",
        "",
    ]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    whole = "\r\n".join(lines).encode("utf-8", "replace") + block + b"\r\n\r\n"
    return packer.compress(whole) + packer.flush()


def write_archives(
    pages: DataFrame,
    folder: str,
    min_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
    level: int = 6,
) -> DataFrame:
    """Write archives and return their manifest (name, size).

    Payloads smaller than ``min_bytes`` are responses always.
    """
    make_folder(folder)
    rows = pages.select(
        F.col("page_id").cast("long"),
        F.col("url").cast("string"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    digests = rows.select("page_id", F.sha1("html").alias("sha"), F.octet_length("html").alias("n"))
    digests = digests.filter((F.col("n") >= min_bytes) & F.col("page_id").isNotNull())
    first = (
        digests.groupBy("sha")
        .agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
        .filter("first < last")
    )
    again = written(
        digests.join(first, "sha")
        .filter("page_id != first")
        .select("page_id", "sha", F.col("first").alias("refers_to"))
        .distinct(),
        "revisits",
    )
    size = rows.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    cores = rows.sparkSession.sparkContext.defaultParallelism
    archives = max(cores, -(-size // archive_bytes))
    placed = (
        rows.withColumn("sha", F.sha1("html"))
        .join(again, ["page_id", "sha"], "left")
        .select("page_id", "url", "html", "refers_to")
        .repartition(int(archives), F.xxhash64("page_id", "url"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, size = f"pages-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for row in batch.slice(at, 64).to_pylist():
                    if out is None:
                        system, place = opened(f"{folder}/{name}")
                        out = system.open_output_stream(place, compression=None)
                    member = record(
                        row["page_id"], row["url"], row["html"].encode(), row["refers_to"], level
                    )
                    out.write(member)
                    size += len(member)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"name": [name], "size": [size]})

    return written(placed.mapInArrow(run, "name string, size long"), "archives")


def _header(head: bytes) -> dict[str, str] | None:
    """Fields of a WARC header, names in lower case; None if it isn't a whole one."""
    end = head.find(b"\r\n\r\n")
    if end < 0 or not head.startswith(b"WARC/1."):
        return None
    fields: dict[str, str] = {}
    for line in head[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isdigit() or "warc-record-id" not in fields:
        return None
    return fields | {"": str(end + 4)}


class _Range:
    """Forward reading of a file with a window that moves on."""

    def __init__(self, file, start: int, size: int) -> None:
        self.file, self.at, self.size, self.window = file, start, size, b""

    def ensure(self, n: int) -> bytes:
        """The window, with at least ``n`` bytes unless the file ends."""
        while len(self.window) < n and self.at + len(self.window) < self.size:
            want = min(max(BLOCK, n - len(self.window)), self.size - self.at - len(self.window))
            got = self.file.read_at(want, self.at + len(self.window))
            if not got:
                break
            self.window += got
        return self.window

    def skip(self, n: int) -> None:
        self.window, self.at = self.window[n:], self.at + n


def _valid_head(view: _Range) -> dict[str, str] | None:
    """Header of the record if a member of one starts here, however long the header is."""
    inflate, head, rest, fed = zlib.decompressobj(31), bytearray(), b"", 0
    start = b"WARC/1."
    try:
        while not inflate.eof:
            if not rest:
                rest = view.ensure(fed + HEAD_BYTES)[fed : fed + HEAD_BYTES]
                fed += len(rest)
            ended = not rest
            seen = max(0, len(head) - 3)
            head += inflate.decompress(rest, HEAD_BYTES)
            rest = inflate.unconsumed_tail
            if head[: len(start)] != start[: len(head)]:
                return None
            if head.find(b"\r\n\r\n", seen) >= 0:
                return _header(bytes(head))
            if ended and len(head) <= seen + 3:
                return None
    except zlib.error:
        pass
    return None


def records(file, start: int, end: int, size: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of the records that start in [start, end)."""
    view = _Range(file, start, size)
    while view.at < end:
        window = view.ensure(BLOCK)
        if len(window) < len(MAGIC):
            return
        found = window.find(MAGIC)
        if found < 0:
            view.skip(max(1, len(window) - len(MAGIC) + 1))
            continue
        if found:
            view.skip(found)
            continue
        fields = _valid_head(view)
        if fields is None:
            view.skip(1)
            continue
        offset = view.at
        inflate = zlib.decompressobj(31)
        parts = []
        while not inflate.eof:
            window = view.ensure(1)
            if not window:
                raise ValueError(f"the record at {offset} ends early")
            parts.append(inflate.decompress(window))
            view.skip(len(window) - len(inflate.unused_data))
        whole = b"".join(parts)
        head = int(fields[""])
        yield offset, fields, whole[head : head + int(fields["content-length"])]


def read_archives(
    spark: SparkSession, manifest: DataFrame, folder: str, split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """(archive, offset, page_id, url, record_type, refers_to, payload_digest, payload_bytes,
    payload) of every record; the payload of a revisit is null."""
    splits = manifest.filter("size > 0").select(
        "name",
        "size",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes)))
        .alias("start"),
    )
    tasks = max(1, splits.count())
    schema = pa.schema(
        [
            ("archive", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()),
            ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
            ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
            ("payload", pa.binary()),
        ]
    )

    def page(urn: str | None) -> int | None:
        number = (urn or "").strip("<>").removeprefix(PAGE)
        return int(number) if number.lstrip("-").isdigit() else None

    def parsed(archive: str, offset: int, fields: dict[str, str], block: bytes) -> dict:
        head, _, payload = block.partition(b"\r\n\r\n")
        length = None
        for line in head.split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length":
                length = int(value)
        revisit = fields["warc-type"] == "revisit"
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        if not revisit:
            length, digest = len(payload), payload_digest(payload)
        return {
            "archive": archive,
            "offset": offset,
            "page_id": page(fields["warc-record-id"]),
            "url": fields.get("warc-target-uri"),
            "record_type": fields["warc-type"],
            "refers_to": page(fields.get("warc-refers-to")),
            "payload_digest": digest,
            "payload_bytes": length,
            "payload": None if revisit else payload,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for split in batch.to_pylist():
                system, place = opened(f"{folder}/{split['name']}")
                end = min(split["start"] + split_bytes, split["size"])
                with system.open_input_file(place) as file:
                    held, size = [], 0
                    for found in records(file, split["start"], end, split["size"]):
                        held.append(parsed(split["name"], *found))
                        size += len(found[2])
                        if size > BLOCK * 16 or len(held) >= 1024:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)

    return splits.repartition(tasks, "name", "start").mapInArrow(
        run,
        "archive string, offset long, page_id long, url string, record_type string, "
        "refers_to long, payload_digest string, payload_bytes long, payload binary",
    )
