"""Token ids in flat binary files.

A data set is a folder of parts, each covering a range of ids:

* ``part-K.ids``: the token ids one after another as little-endian unsigned integers, two
  bytes wide if the vocabulary fits, else four;
* ``part-K.idx``: for each document its id and its start among the tokens of the whole data
  set, both as 64-bit little-endian integers, then one row (document count, end).

Texts are shuffled by ranges of the id and sorted in them, so parts follow one another in
ascending order. Tasks write the ids and report their number of tokens; the prefix sums of
these numbers over the parts are the bases from which the offsets are written. Part names
hold a random piece made per attempt, and only parts in the manifest count, so a task that
ran twice does no harm.

Encoding is remembered per piece between blanks and line feeds, at which the tokenizers of
this kind always split; a full stop or comma that ends a piece behind a Latin letter or digit is
a piece of its own, as they split there too. Pieces are found on the bytes of many rows at
once and numbered by Arrow's dictionary encoding, so Python sees each distinct piece of a
slice once; ids are gathered by number. The library encodes a piece when it is first met,
words of Latin letters many at a time. At most CACHE pieces are kept, then the memory is emptied.
``whole=True`` encodes whole texts for tokenizers that don't split there.

A null text counts as empty: its ids are just the end id. Rows with a null id come first,
rows that share one stand next to each other in order of their text. An empty table gives
no parts. Further columns are ignored.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.llm.common import slices, text_buffer, written
from leafmill.llm.files import make_folder, mapped, opened

CACHE = 1_000_000
PART_BYTES = 64 << 20
SLICE = 4 << 20  # bytes of text encoded at a time
_JOINED = 500  # words given to the library in one text
_NO_ID = -(1 << 63)  # stands for a null id in the index
# Letters that neither compose with what follows nor change their kind in lower case.
_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_tokenizers: dict[str, object] = {}
_memories: dict[str, Memory] = {}


def tokenizer(path: str):
    if path not in _tokenizers:
        # tasks already fill the cores
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def id_bytes(path: str) -> int:
    return 2 if tokenizer(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def piece_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces in the UTF-8 bytes of some rows."""
    n = len(data)
    gap = np.ones(n + 2, bool)  # of the byte before, at its own place
    gap[1:-1] = (data == 0x20) | (data == 0x0A)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    plain = np.zeros(256, bool)
    plain[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
    behind = np.zeros(n, bool)
    behind[1:] = plain[data[:-1]]
    latin = (data[1:-1] >= 0x80) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7) & (data[:-2] == 0xC3)
    behind[2:] |= latin
    stop = np.zeros(n + 1, bool)
    stop[:-1] = ((data == 0x2E) | (data == 0x2C)) & behind & ~first[:-1] & (gap[2:] | first[1:])
    inside = ~gap[1:-1]
    starts = np.flatnonzero(inside & (gap[:-2] | first[:-1] | stop[:-1]))
    ends = np.flatnonzero(inside & (gap[2:] | first[1:] | stop[1:])) + 1
    return starts, ends


class Memory:
    """Ids of the pieces met so far: a number for each piece, and one flat array of ids."""

    def __init__(self, path: str) -> None:
        self.model = tokenizer(path)
        # ids that can only be the last of a word, where the model has such
        suffix = getattr(self.model.model, "end_of_word_suffix", None)
        vocab = self.model.get_vocab(with_added_tokens=True) if suffix else {}
        self.last = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.last[[i for token, i in vocab.items() if suffix and token.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 16, np.int64)  # one more than there are pieces
        self.used = 0

    def numbers(self, pieces: list[bytes]) -> np.ndarray:
        found = list(map(self.number.get, pieces))
        new = [w for w, n in zip(pieces, found, strict=True) if n is None]
        if new:
            if len(self.number) + len(new) > CACHE:
                self.forget()
                new = pieces
            if self.last.any():
                words = list(filter(_WORD.fullmatch, map(bytes.decode, new)))
                self._learn_words(words)
                new = [w for w in new if w not in self.number]
            self._learn(new)
            found = list(map(self.number.__getitem__, pieces))
        return np.array(found, np.int64)

    def _learn_words(self, words: list[str]) -> None:
        """Words between line feeds; each ends with its own kind of id."""
        texts = ["\n".join(words[i : i + _JOINED]) for i in range(0, len(words), _JOINED)]
        found = self.model.encode_batch_fast(texts, add_special_tokens=False)
        for at, e in zip(range(0, len(words), _JOINED), found, strict=True):
            some = words[at : at + _JOINED]
            ids = np.array(e.ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            # else they are learned one by one
            if len(ends) == len(some) and ends[-1] == len(ids):
                self._add([w.encode() for w in some], ids, np.diff(ends, prepend=0))

    def _learn(self, pieces: list[bytes]) -> None:
        for at in range(0, len(pieces), 20_000):
            some = pieces[at : at + 20_000]
            texts = [w.decode() for w in some]
            found = [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]
            flat = np.array([i for ids in found for i in ids], np.uint32)
            self._add(some, flat, np.array([len(ids) for ids in found], np.int64))

    def _add(self, pieces: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        known = len(self.number)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while known + len(pieces) >= len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[known + 1 : known + 1 + len(pieces)] = self.used + np.cumsum(sizes)
        self.used += len(ids)
        self.number.update(zip(pieces, range(known, known + len(pieces)), strict=True))


def encode(
    texts: pa.Array, path: str, width: int, end_id: int, whole: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows one after another, each row's followed by ``end_id``, and their numbers."""
    kind = f"<u{width}"
    if whole:
        rows = [t or "" for t in texts.to_pylist()]
        found = tokenizer(path).encode_batch(rows, add_special_tokens=False)
        ids = [[*e.ids, end_id] for e in found]
        flat = np.array([i for row in ids for i in row], kind)
        return flat, np.array([len(row) for row in ids], np.int64)
    if path not in _memories:
        _memories[path] = Memory(path)
    memory = _memories[path]
    data, offsets = text_buffer(texts)
    starts, ends = piece_bounds(data, offsets)
    # pieces and the gaps between them in turn, so that the bytes stay where they are
    bounds = np.stack([starts, ends], axis=1).reshape(-1)
    row = np.searchsorted(offsets, starts, side="right") - 1
    sizes = np.zeros(len(texts), np.int64)
    if not len(starts):
        return np.full(len(texts), end_id, kind), sizes + 1
    held = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)]
    ).dictionary_encode()
    index = held.indices.to_numpy()[::2]
    number = np.zeros(len(held.dictionary), np.int64)
    number[index] = 1
    used = np.flatnonzero(number)
    number[used] = memory.numbers(held.dictionary.take(pa.array(used)).to_pylist())
    piece = number[index]
    start = memory.start[piece]
    length = memory.start[piece + 1] - start
    np.add.at(sizes, row, length)
    before = np.cumsum(length) - length
    flat = memory.ids[np.arange(length.sum()) + np.repeat(start - before, length)]
    return np.insert(flat, np.cumsum(sizes), end_id).astype(kind), sizes + 1


def _written_parts(folder: str, path: str, width: int, end_id: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file, counts, ids, part = uuid.uuid4().hex, None, [], [], 0
        for batch in batches:
            for piece in slices(batch, "text", SLICE):
                if file is None:
                    part = piece.column("part")[0].as_py()
                    system, place = opened(f"{folder}/{name}.ids")
                    file = system.open_output_stream(place, compression=None)
                flat, sizes = encode(piece.column("text"), path, width, end_id, whole)
                file.write(flat.tobytes())
                counts.append(sizes)
                ids.append(piece.column("doc_id").fill_null(_NO_ID).to_numpy())
        if file is not None:
            file.close()
            sizes = np.concatenate(counts)
            local = np.concatenate([np.concatenate(ids), sizes]).astype("<i8")
            with system.open_output_stream(f"{place[:-4]}.len", compression=None) as out:
                out.write(local.tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([name]),
                    pa.array([len(sizes)], pa.int64()),
                    pa.array([int(sizes.sum())], pa.int64()),
                ],
                names=["part", "name", "n_docs", "n_tokens"],
            )

    return run


def _indexed(folder: str):
    """Write the offsets of each part from its base."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with mapped(f"{folder}/{row['name']}.len") as raw:
                    ids, sizes = np.frombuffer(raw, "<i8").copy().reshape(2, -1)
                index = np.zeros((len(ids) + 1, 2), "<i8")
                index[:-1, 0] = ids
                index[-1, 0] = len(ids)
                index[0, 1] = row["base"]
                np.cumsum(sizes, out=index[1:, 1])
                index[1:, 1] += row["base"]
                system, place = opened(f"{folder}/{row['name']}-{uuid.uuid4().hex}.idx")
                with system.open_output_stream(place, compression=None) as out:
                    out.write(index.tobytes())
                row["index"] = place.rsplit("/", 1)[1]
                yield pa.RecordBatch.from_pylist([row], schema=_MANIFEST)

    return run


_MANIFEST = pa.schema(
    [
        ("part", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()),
        ("n_tokens", pa.int64()), ("base", pa.int64()), ("index", pa.string()),
    ]
)


def write_ids(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    end_id: int = 1,
    part_bytes: int = PART_BYTES,
    whole: bool = False,
) -> DataFrame:
    """Write the data set and return its manifest, a row per part."""
    make_folder(folder)
    width = id_bytes(tokenizer_path)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size, count = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-(size or 0) // part_bytes), min(count, cores))
    placed = (
        rows.repartitionByRange(int(parts), "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .withColumn("part", F.spark_partition_id())
    )
    sizes = written(
        placed.mapInArrow(
            _written_parts(folder, tokenizer_path, width, end_id, whole),
            "part int, name string, n_docs long, n_tokens long",
        ),
        "token-parts",
    )
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    based = sizes.withColumn("base", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))
    return written(
        based.repartition(int(parts), "part").mapInArrow(
            _indexed(folder),
            "part int, name string, n_docs long, n_tokens long, base long, index string",
        ),
        "token-manifest",
    )


def read_ids(manifest: DataFrame, folder: str, width: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone.

    A task maps one part's files into memory and walks over its documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with (
                    mapped(f"{folder}/{row['index']}") as raw_index,
                    mapped(f"{folder}/{row['name']}.ids") as raw,
                ):
                    index = np.frombuffer(raw_index, "<i8").copy().reshape(-1, 2)
                    base, n = int(index[0, 1]), len(index) - 1
                    for at in range(0, n, 4096):
                        own = index[at : min(at + 4096, n) + 1, 1]
                        crcs = []
                        for a, b in zip(own[:-1] - base, own[1:] - base, strict=True):
                            ids = np.frombuffer(raw[a * width : b * width], f"<u{width}")
                            crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                            del ids
                        keys = index[at : at + len(crcs), 0]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(keys, mask=keys == _NO_ID),
                                pa.array(own[:-1]),
                                pa.array(np.diff(own)),
                                pa.array(crcs, pa.int64()),
                            ],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    return (
        manifest.select("part", "name", "index")
        .repartition(max(1, manifest.count()), "part")
        .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
    )
