"""Shared folder tables and byte-level word hashing used inside tasks.

Words are runs of bytes other than 0x20 and 0x09-0x0D. These bytes never occur inside a
multi-byte UTF-8 character, so working on bytes gives the same words as working on
characters. Hashes are 64 bits wide; at a billion distinct words a collision anywhere is a matter
of percents. Words of LONG_WORD bytes or more, which could be built so that a running polynomial
modulo 2**64 does not tell them apart, are hashed by BLAKE2.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

WORD = r"[^\x20\x09-\x0D]+"

# Bytes worked on at a time, so that temporary arrays stay small however long a text is.
WINDOW = 1 << 20
LONG_WORD = 256


# --- shared folder -----------------------------------------------------------------------


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


class Scratch:
    """Parquet tables in the shared folder that live as long as the ``with`` block."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error: object) -> None:
        remove(self.spark, self.folder)

    def table(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")


def written(df: DataFrame, name: str) -> DataFrame:
    """A table in the shared folder that the caller's lazy result goes on reading.

    Unlike a checkpoint it has a size that the planner knows.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that this library has written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# --- byte-level words --------------------------------------------------------------------

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32

_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_LOWER_BYTE = _BYTE.copy()
_LOWER_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, WINDOW + 1)
        for at, base in enumerate((_BASE, _INVERSE)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _powers[at] = np.multiply.accumulate(step)
    return _powers[0], _powers[1]


def span_hashes(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False
) -> np.ndarray:
    """A 64-bit hash of each byte span: differences of one running polynomial, BLAKE2 for
    long ones."""
    power, inverse = _power_tables(len(data) + 1)
    running = np.zeros(len(data) + 1, np.uint64)
    table = _LOWER_BYTE if lower else _BYTE
    np.cumsum(table[data] * power[: len(data)], out=running[1:])
    sums = (running[ends] - running[starts]) * inverse[starts]
    out = mix(sums + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts >= LONG_WORD):
        word = data[starts[i] : ends[i]]
        word = (_FOLD[word] if lower else word).tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return out


def spans(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of ``data``; no word crosses an offset in ``edges``."""
    space = SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[edges] = True
    before = np.ones(len(data), bool)
    before[1:] = space[:-1]
    after = np.ones(len(data), bool)
    after[:-1] = space[1:]
    starts = np.flatnonzero(~space & (before | cut[:-1]))
    ends = np.flatnonzero(~space & (after | cut[1:])) + 1
    return starts, ends


def windows(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about WINDOW bytes that end between rows or at a blank, never in a word."""
    at, n = 0, len(data)
    while at < n:
        end = min(at + WINDOW, n)
        if end < n:
            edge = int(offsets[np.searchsorted(offsets, end, side="right") - 1])
            if edge > at:
                end = edge
            else:
                inside = SPACE[data[at:end]]
                if inside.any():
                    end = at + len(inside) - int(np.argmax(inside[::-1]))
                else:
                    stop = int(offsets[np.searchsorted(offsets, end, side="left")])
                    rest = SPACE[data[end:stop]]
                    end = end + int(np.argmax(rest)) if rest.any() else stop
        yield at, end
        at = end


def word_hashes(
    data: np.ndarray,
    offsets: np.ndarray,
    lower: bool = True,
    endings: list[np.ndarray] | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the number of words of every row.

    ``endings`` gets the last two bytes of the words (A-Z lower-cased) as numbers.
    """
    found: list[np.ndarray] = []
    rows: list[np.ndarray] = []
    for a, b in windows(data, offsets):
        part = data[a:b]
        first, last = np.searchsorted(offsets, [a, b])
        starts, ends = spans(part, offsets[first:last] - a)
        found.append(span_hashes(part, starts, ends, lower))
        if endings is not None:
            last = _FOLD[part[ends - 1]].astype(np.uint16)
            before = np.where(ends - starts > 1, _FOLD[part[ends - 2]], 0).astype(np.uint16)
            endings.append(before << np.uint16(8) | last)
        rows.append(np.searchsorted(offsets, starts + a, side="right") - 1)
    count = np.zeros(len(offsets) - 1, np.int64)
    for r in rows:
        if len(r):
            part = np.bincount(r - r[0])
            count[r[0] : r[0] + len(part)] += part
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), count


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offset of each row; null counts as empty."""
    column = pc.fill_null(column, "")
    wide = column.cast(pa.large_string())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    raw = wide.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = 4 * WINDOW) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with at most ``limit`` bytes of text, one row at least."""
    column = batch.column(text)
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        base = total[at] - size[at]
        end = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


def int64_lists(values: np.ndarray, width: int) -> pa.ListArray:
    """Rows of a matrix as list<int64>."""
    flat = np.ascontiguousarray(values).reshape(-1).view(np.int64)
    offsets = np.arange(0, len(flat) + 1, width, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
