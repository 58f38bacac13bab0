import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from leafmill.llm import infill, queries
from leafmill.llm.common import text_buffer

ODD = [
    None, "", "a", "é", "ab", "a1b", "1", "😀", "😀😀a", "Straße — ça va", "日本語 abc", "\n\t x",
    "é", "z" * 1000, "é" * 999 + "Z", "a😀" * 400, "x<P>y", "<S>", "a<M", "<P", "[\\]^_`{|}~@",
    "\x00\x7f\u0080߿ࠀ￿\U00010000\U0010ffff", "AZaz", "@[`{",
]


def brute(doc_id, text, percent=90, spm=20):
    """The rule on a list of units."""
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    name = "" if doc_id is None else str(doc_id)
    digest = hashlib.sha256(f"1:{name}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= percent:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        out = ("spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}")
    else:
        out = ("psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}")
    return doc_id, len(units), *out


def rows_of(draw, n):
    letters = "aZ<>PSM \n1é日😀́"
    return [(i, "".join(draw.choices(letters, k=draw.randint(0, 40)))) for i in range(n)]


def test_matches_a_list_of_units(spark):
    rows = rows_of(random.Random(3), 3000) + [(-i - 1, t) for i, t in enumerate(ODD)]
    rows += [(None, "some text here"), (7, "twice"), (7, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for percent, spm in ((90, 20), (100, 50), (100, 0), (0, 100)):
        made = infill.fill_in_middle(docs, percent, spm)
        got = made.withColumn("text", infill.restored(F.col("form"), F.col("output"))).collect()
        assert all(r.text == r.output for r in got if r.form == "plain")
        want = sorted(map(str, (brute(i, t, percent, spm) for i, t in rows)))
        assert sorted(str(tuple(r)[:-1]) for r in got) == want
        assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(i), t or "") for i, t in rows)


def test_every_cut_of_every_unit():
    texts = [t or "" for t in ODD]
    data, offsets = text_buffer(pa.array(texts))
    for k in range(12):
        h = np.full(len(texts), k)
        n, one, two, first, _ = infill.cuts(data, offsets, h, np.zeros_like(h))
        for i, t in enumerate(texts):
            units = re.findall("[A-Za-z]+|[^A-Za-z]", t)
            want = "".join(units[: k % (len(units) + 1)])
            assert n[i] == len(units)
            assert data[offsets[i] : two[i]].tobytes().decode() == want and one[i] == offsets[i]
            assert first[i] == 0


def test_pieces_do_not_change_results(spark, monkeypatch):
    rows = rows_of(random.Random(5), 400)
    table = pa.RecordBatch.from_pydict(
        {"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]}
        | {f"h{k}": [hash((k, i)) % 2**32 for i, _ in rows] for k in range(1, 5)}
    )
    whole = list(infill._transformed(90, 20)(iter([table])))
    monkeypatch.setattr(infill, "PIECE", 1)
    monkeypatch.setattr(infill, "_WORDS", 2)
    single = list(infill._transformed(90, 20)(iter([table])))
    assert len(single) > len(whole)
    assert pa.Table.from_batches(single).to_pylist() == pa.Table.from_batches(whole).to_pylist()


def test_edges(spark, edge_docs):
    rows = edge_docs.select("doc_id", "text").collect()
    got = infill.fill_in_middle(edge_docs).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(brute(r.doc_id, r.text)) for r in rows)
    assert infill.fill_in_middle(edge_docs.limit(0)).count() == 0


def test_query_matches_its_sql(spark, same_as_sql):
    same_as_sql(queries.op11_swar_infill, queries.OP11_SQL, "documents")
