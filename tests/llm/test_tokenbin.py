import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from leafmill.llm import tokenbin

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "<|startoftext|> a<|endoftext|>b", "x\x1cy\x85z w", "İstanbul ΣΑΣ'S don't ’s 12 3½",
    "\t\ttab\r\ncr  double", "😀👍🏽 مرحبا", "<|endoftext|> b\n<|endoftext|>\nc", None, "", "   ",
    "é ́a", "日本語 テキスト", "a" * 5000,
]


def reference(texts, path=PATH):
    model = Tokenizer.from_file(path)
    return [
        [*e.ids, 1] for e in model.encode_batch([t or "" for t in texts], add_special_tokens=False)
    ]


@pytest.mark.parametrize("part_bytes", [3_000, 1 << 30])
def test_round_trip(spark, documents, tmp_path, part_bytes):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    rows += [(10_000 + i, t) for i, t in enumerate(ODD)] + [(-5, "minus")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    folder = str(tmp_path / "ids")
    manifest = tokenbin.write_ids(df, folder, PATH, part_bytes=part_bytes)
    width = tokenbin.id_bytes(PATH)
    assert width == 2
    got = sorted(map(tuple, tokenbin.read_ids(manifest, folder, width).collect()))
    want, at = [], 0
    rows.sort()
    for (i, _), ids in zip(rows, reference([t for _, t in rows]), strict=True):
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    # the parts' files, one after another, are the whole stream
    parts = sorted(manifest.collect(), key=lambda r: r.part)
    stream = np.concatenate([np.fromfile(f"{folder}/{p.name}.ids", "<u2") for p in parts])
    assert stream.tolist() == [x for ids in reference([t for _, t in rows]) for x in ids]


@pytest.mark.parametrize("cache", [3, 1 << 20])
def test_pieces_give_the_ids_of_whole_texts(monkeypatch, cache):
    monkeypatch.setattr(tokenbin, "CACHE", cache)
    monkeypatch.setattr(tokenbin, "_memories", {})
    monkeypatch.setattr(tokenbin, "_JOINED", 7)
    draw = random.Random(3)
    texts = [*ODD, "one two three four", "five six", "a.\n.b", "x×. y÷,", "ü. end."] * 2
    texts += ["".join(draw.choices("aZéÿ×.,  \n9'sİ<|>😀́", k=draw.randint(0, 12))) for _ in range(3000)]
    column = pa.array(texts)
    for at in (0, 40):
        flat, sizes = tokenbin.encode(column[at:], PATH, 2, 1)
        whole, whole_sizes = tokenbin.encode(column[at:], PATH, 2, 1, whole=True)
        assert (flat == whole).all() and (sizes == whole_sizes).all() and sizes.sum() == len(flat)


def test_tokenizers_without_word_endings_learn_piece_by_piece(monkeypatch):
    monkeypatch.setattr(tokenbin, "_memories", {})
    column = pa.array(["one two", None, "three, four."])
    memory = tokenbin._memories[PATH] = tokenbin.Memory(PATH)
    memory.last[:] = False
    got = tokenbin.encode(column, PATH, 2, 1)
    assert all((a == b).all() for a, b in zip(got, tokenbin.encode(column, PATH, 2, 1, whole=True), strict=True))


def test_edges(spark, edge_docs, tmp_path):
    folder = str(tmp_path / "edge")
    manifest = tokenbin.write_ids(edge_docs, folder, PATH)
    rows = tokenbin.read_ids(manifest, folder, 2).collect()
    assert len(rows) == 12 and sorted(r.start for r in rows)[0] == 0
    by_start = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in by_start][:2] == [None, None]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(by_start, by_start[1:]))
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4, 5)} == {1}
    none = tokenbin.write_ids(edge_docs.limit(0), str(tmp_path / "none"), PATH)
    assert tokenbin.read_ids(none, str(tmp_path / "none"), 2).count() == 0
