import re

import numpy as np
from pyspark.sql import functions as F

from leafmill.llm import decontam, queries


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def planted(spark):
    draw = np.random.default_rng(6)
    items = [[f"t{draw.integers(400)}" for _ in range(n)] for n in (14, 20, 30, 45, 5)]
    rows = []
    for d in range(80):
        text = [f"t{draw.integers(400)}" for _ in range(60)]
        piece = list(items[d % 5])
        for at in draw.choice(len(piece), d // 10, replace=len(piece) < 8):
            piece[at] = "other"
        if d % 3:
            text[20:20] = piece[: len(piece) if d % 2 else len(piece) - 1]
        rows.append((d, ", ".join(text).title()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(
        [(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string"
    )
    return docs, bench, rows, items


def test_matches_brute_force_on_both_plans(spark):
    docs, bench, rows, items = planted(spark)
    want = {
        (d, i) for d, t in rows for i, item in enumerate(items) if windowed(words(t), item)
    }
    for bound in (decontam.BROADCAST_SEEDS, 0):
        found = decontam.overlaps(docs, bench, broadcast_seeds=bound).collect()
        assert {(r.doc_id, r.item_id) for r in found} == want
    assert 20 < len(want) < 60


def test_any_two_substitutions_in_twelve_tokens_leave_a_seed(spark):
    item = [f"i{k}" for k in range(12)]
    rows = []
    for a in range(12):
        for b in range(a + 1, 12):
            text = ["x"] * 5 + [w if k not in (a, b) else "sub" for k, w in enumerate(item)]
            rows.append((a * 12 + b, " ".join([*text, "y", "y"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    found = decontam.overlaps(docs, bench, min_tokens=6, min_share=0.5)
    assert found.count() == len(rows)


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(decontam, "PIECE", 64)
    item = [f"i{k}" for k in range(40)]
    rows = [
        (p, " ".join([f"f{j}" for j in range(p)] + item + [f"g{j}" for j in range(300)]))
        for p in range(0, 200, 7)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    found = decontam.overlaps(docs, bench).collect()
    assert {(r.doc_id, r.doc_start, r.n_tokens, r.n_equal) for r in found} == {
        (p, p, 40, 40) for p, _ in rows
    }


def test_query_finds_whole_passages_and_no_more(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    bench = [words(r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    whole = {
        r.doc_id for r in docs
        if any(" ".join(b) in " ".join(words(r.text)) for b in bench)
    }
    found = queries.op10_spaced_seed_decontamination(spark, d)
    assert {r.doc_id for r in found.collect()} == whole
    assert not re.search("Python|Pandas|Arrow", found._jdf.queryExecution().toString())


def test_edges(spark, edge_docs):
    bench = spark.createDataFrame(
        [(1, None), (2, ""), (3, "brown fox"), (None, "the quick"),
         (4, "the quick brown fox jumps over the lazy dog and runs far away"),
         (4, "the quick brown fox jumps over the lazy dog and runs far away")],
        "item_id long, text string",
    )
    found = decontam.overlaps(edge_docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 4), (2, 4), (9, 4)}
    kept = decontam.clean_documents(edge_docs, bench)
    assert kept.columns == edge_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted("3 4 5 6 None None 7 8".split())
    assert decontam.overlaps(edge_docs.limit(0), bench).count() == 0
    assert decontam.overlaps(edge_docs, bench.limit(0)).count() == 0
    assert decontam.clean_documents(edge_docs, bench.limit(0)).count() == edge_docs.count()


def test_repeated_ids_give_a_pair_once(spark):
    text = " ".join(f"i{k}" for k in range(20))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, text), (7, text)], "item_id long, text string")
    found = decontam.overlaps(docs, bench)
    assert found.count() == 2 and found.agg(F.max("n_overlaps")).first()[0] == 1


def windowed(doc, item):
    """Some seeded diagonal holds an aligned window of MIN_TOKENS pairs or more with enough equal."""
    for shift in range(-len(item), len(doc)):
        flags = [doc[i + shift] == x for i, x in enumerate(item) if 0 <= i + shift < len(doc)]
        seeded = any(
            all(i + k < len(flags) and flags[i + k] for k, b in enumerate(m) if b == "1")
            for m in decontam.MASKS for i in range(len(flags))
        )
        if seeded and any(
            sum(flags[a:b]) >= decontam.MIN_SHARE * (b - a)
            for a in range(len(flags))
            for b in range(a + min(decontam.MIN_TOKENS, len(item)), len(flags) + 1)
        ):
            return True
    return False


def test_any_window_that_meets_the_limits_counts(spark):
    draw = np.random.default_rng(8)
    items = [[f"i{n}x{k}" for k in range(n)] for n in (12, 13, 15, 20, 33)]
    rows = []
    for d in range(240):
        number = d % 5
        piece = list(items[number])
        for at in draw.choice(len(piece), min(1 + d // 30, len(piece) // 3), replace=False):
            piece[at] = "sub"
        text = [f"f{k}" for k in range(d % 7)] + piece + ["g"] * (d % 3)
        rows.append((d, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(
        [(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string"
    )
    want = {(d, i) for d, t in rows for i, x in enumerate(items) if windowed(t.split(), x)}
    assert 60 < len(want) < 230
    for bound in (decontam.BROADCAST_SEEDS, 0):
        found = decontam.overlaps(docs, bench, broadcast_seeds=bound).collect()
        assert {(r.doc_id, r.item_id) for r in found} == want
        for r in found:
            doc, item = rows[r.doc_id][1].split(), items[r.item_id]
            pairs = zip(doc[r.doc_start : r.doc_end], item[r.item_start :], strict=False)
            assert r.doc_end - r.doc_start == r.n_tokens >= decontam.MIN_TOKENS
            assert sum(x == y for x, y in pairs) == r.n_equal >= decontam.MIN_SHARE * r.n_tokens


def test_two_substitutions_anywhere_in_fifteen_tokens(spark):
    item = [f"i{k}" for k in range(15)]
    rows = [
        (a * 15 + b, " ".join("sub" if k in (a, b) else w for k, w in enumerate(item)))
        for a in range(15) for b in range(a + 1, 15)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    assert decontam.overlaps(docs, bench).count() == len(rows) == 105


def test_short_and_long_items_are_found_whole(spark):
    items = [[f"i{n}x{k}" for k in range(n)] for n in (5, 6, 8, 11, 300)]
    rows = [(i, " ".join(["a", "b", *x, "c"])) for i, x in enumerate(items)]
    rows += [(10 + i, " ".join(["a", *x[:-1], "c"])) for i, x in enumerate(items[:4])]
    far = ["sub" if k in (2, 150) else w for k, w in enumerate(items[4])]
    rows.append((20, " ".join(["a"] * 5000 + far)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(
        [(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string"
    )
    for bound in (decontam.BROADCAST_SEEDS, 0):
        found = decontam.overlaps(docs, bench, broadcast_seeds=bound).collect()
        assert {(r.doc_id, r.item_id, r.doc_start, r.doc_end, r.n_equal) for r in found} == {
            (1, 1, 2, 8, 6), (2, 2, 2, 10, 8), (3, 3, 2, 13, 11), (4, 4, 2, 302, 300),
            (12, 2, 1, 9, 7), (13, 3, 1, 12, 10), (20, 4, 5000, 5300, 298),
        }
