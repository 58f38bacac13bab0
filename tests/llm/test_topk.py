import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill.llm import queries, topk

SCHEMA = "vec_id long, vec array<long>"


def brute(rows, queries_, k):
    """All products, sorted."""
    asked = {(i, tuple(v)) for i, v in queries_ if i is not None and v is not None}
    out = []
    for q, v in asked:
        scored = [
            (-sum(a * b for a, b in zip(v, w, strict=False)), i)
            for i, w in rows if i is not None and w is not None and i != q
        ]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def search(spark, rows, asked, k=5, **sizes):
    out = topk.top_k(
        spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(asked, SCHEMA), k, **sizes
    )
    return sorted(map(tuple, out.collect()))


@pytest.mark.parametrize("sizes", [{}, {"query_rows": 7, "candidate_rows": 60}])
def test_matches_brute_force(spark, sizes):
    draw = random.Random(1)
    rows = [(i, [draw.choice([0, 0, 1, -2, 3]) for _ in range(6)]) for i in range(400)]
    asked = [r for r in rows if r[0] % 9 == 0]
    assert search(spark, rows, asked, **sizes) == brute(rows, asked, 5)


def test_ties_repeats_lengths_and_missing_values(spark):
    rows = [(i, [1, 1]) for i in range(30)] + [(3, [1, 1]), (40, []), (41, [5]), (42, [0, 0, 9]), (None, [9, 9])]
    rows += [(50, None), (51, [0, 0])]
    asked = [(0, [1, 1]), (0, [1, 1]), (40, []), (42, [0, 0, 9]), (None, [1, 1]), (60, [-1, 0])]
    assert search(spark, rows, asked) == brute(rows, asked, 5)
    # fewer candidates than asked for
    assert search(spark, rows[:3], [(0, [1, 1])], k=9) == [(0, 1, 1, 2), (0, 2, 2, 2)]
    assert search(spark, [], asked) == [] and search(spark, rows, []) == []
    # one id with two vectors is asked for twice
    two = search(spark, rows, [(0, [1, 0]), (0, [0, 1])], k=1)
    assert two == [(0, 1, 41, 5), (0, 1, 1, 1)] or sorted(two) == [(0, 1, 1, 1), (0, 1, 41, 5)]


def test_large_values_stay_exact(spark):
    big = 1 << 29
    rows = [(1, [big, 1]), (2, [big, 2]), (3, [-big, 0])]
    assert search(spark, rows, [(9, [big, 1])]) == brute(rows, [(9, [big, 1])], 5)
    huge = topk.Postings(pa.array([[1 << 40]]))
    with pytest.raises(OverflowError):
        topk._scores(huge, huge, 0, 1)


def test_batches_and_groups_do_not_change_results(spark, monkeypatch):
    draw = np.random.default_rng(2)
    lists = draw.integers(-9, 9, (300, 16)) * (draw.random((300, 16)) < 0.3)
    table = lambda ids: pa.RecordBatch.from_pydict(
        {"id": ids, "copy": ids, "vec": [lists[i].tolist() for i in ids]}
    )
    seen = []
    for batch, group in ((4096, 64), (7, 3)):
        monkeypatch.setattr(topk, "BATCH", batch)
        monkeypatch.setattr(topk, "GROUP", group)
        cell = topk.Cell(5)
        cell.add_queries(table(list(range(0, 300, 11))))
        cell.add_candidates(table(list(range(150))))
        cell.add_candidates(table(list(range(150, 300))))
        seen.append(cell.result().to_pylist())
    assert seen[0] == seen[1]
    scores = lists @ lists.T
    np.fill_diagonal(scores, -(10**6))
    assert {r["score"] for r in seen[0] if r["query_id"] == 22} == set(np.sort(scores[22])[-5:].tolist())


def test_unusable_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [nan, 1.0]), (2, [inf, 1.0]), (3, [None, 1.0]), (4, None), (50, [0.1, -0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    kept = df.filter(topk.usable(F.col("embedding")))
    vectors = kept.select("vec_id", topk.quantised(F.col("embedding")).alias("vec"))
    assert sorted((r.vec_id, r.vec) for r in vectors.collect()) == [(0, [256, 128]), (50, [25, -26])]
    found = topk.top_k(vectors, vectors.filter("vec_id % 50 = 0")).collect()
    assert sorted((r.query_id, r.vec_id, r.score) for r in found) == [
        (0, 50, 256 * 25 - 26 * 128), (50, 0, 256 * 25 - 26 * 128)]


def test_query_matches_its_sql(spark, same_as_sql):
    same_as_sql(queries.op12_exact_top_k, queries.OP12_SQL, "embeddings")
