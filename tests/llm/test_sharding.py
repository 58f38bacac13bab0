import random

import pytest
from pyspark.sql import functions as F

from leafmill.llm import sharding


def test_flow_moves_the_fewest_bytes():
    draw = random.Random(4)
    for _ in range(60):
        n, m = draw.randint(1, 9), draw.randint(1, 9)
        sizes = [draw.choice([0, draw.randint(1, 1000)]) for _ in range(n)]
        room = sharding.equal_capacities(sum(sizes) + draw.randint(0, 50), m)
        draw.shuffle(room)
        flow = sharding.min_cost_flow(sizes, room)
        for i, s in enumerate(sizes):
            assert sum(v for (a, _), v in flow.items() if a == i) == s
        for j, c in enumerate(room):
            assert sum(v for (_, b), v in flow.items() if b == j) <= c
        stay = sum(min(s, room[i]) for i, s in enumerate(sizes) if i < m)
        assert sum(v for (a, b), v in flow.items() if a != b) == sum(sizes) - stay


def test_flow_with_costs_matches_brute_force():
    draw = random.Random(8)
    for _ in range(30):
        sizes = [draw.randint(0, 3) for _ in range(3)]
        room = [draw.randint(1, 4) for _ in range(3)]
        if sum(sizes) > sum(room):
            continue
        cost = [[draw.randint(0, 5) for _ in range(3)] for _ in range(3)]
        flow = sharding.min_cost_flow(sizes, room, cost)
        units = [i for i, s in enumerate(sizes) for _ in range(s)]
        best = {tuple(room): 0}
        for i in units:
            step = {}
            for left, spent in best.items():
                for j in range(3):
                    if left[j]:
                        key = tuple(x - (k == j) for k, x in enumerate(left))
                        step[key] = min(step.get(key, 10**9), spent + cost[i][j])
            best = step
        assert sum(cost[i][j] * v for (i, j), v in flow.items()) == min(best.values())


def _shards(spark, docs, tmp_path, old=5, new=8):
    path = str(tmp_path / "shards")
    before = F.pmod(F.xxhash64("doc_id"), F.lit(old)).cast("int")
    flow = sharding.reshard(docs, before, old, new, path, file_bytes=20_000)
    rows = sharding.read_shards(docs, path)
    return flow, rows.withColumn("was", before)


def test_rows_come_back_whole_in_equal_shards(spark, documents, tmp_path):
    flow, rows = _shards(spark, documents, tmp_path)
    back = rows.select(documents.columns)
    assert back.exceptAll(documents).count() == 0 and documents.exceptAll(back).count() == 0
    size = sharding.row_size(F.col("text"))
    shards = rows.groupBy("shard").agg(
        F.sum(size).alias("bytes"), F.count("*").alias("n"), F.max("slot").alias("top"),
        F.count_distinct("slot").alias("slots"),
    ).collect()
    mean = sum(r.bytes for r in shards) / 8
    assert len(shards) == 8 and all(abs(r.bytes - mean) < 3000 for r in shards)
    assert all(r.n == r.slots == r.top + 1 for r in shards)
    moved = rows.filter("was != shard").agg(F.sum(size)).first()[0]
    planned = sum(v for (i, j), v in flow.items() if i != j)
    assert abs(moved - planned) < 0.05 * planned


def test_unchanged_shards_are_not_rewritten(spark, documents, tmp_path):
    four = documents.withColumn("at", F.lit(0)).limit(0)
    for i in range(4):
        four = four.union(documents.limit(40).withColumn("at", F.lit(i)))
    size = four.filter("at = 0").agg(F.sum(sharding.row_size(F.col("text")))).first()[0]
    path = str(tmp_path / "new")
    sharding.reshard(four, F.col("at"), 4, [size, size, size, size // 2, size], path, "old")
    shards = {r.shard for r in spark.read.parquet(path).select("shard").distinct().collect()}
    assert shards == {3, 4}


def test_edges(spark, edge_docs, tmp_path):
    _, rows = _shards(spark, edge_docs, tmp_path, 3, 4)
    assert rows.count() == 12 and rows.filter("slot is null or shard is null").count() == 0
    assert set(edge_docs.columns) <= set(rows.columns)
    flow, none = _shards(spark, edge_docs.limit(0), tmp_path / "none", 3, 4)
    assert flow == {} and none.count() == 0


def test_columns_of_any_name_come_back(spark, edge_docs, tmp_path):
    _, rows = _shards(spark, edge_docs, tmp_path, 3, 4)
    own = [c for c in edge_docs.columns if c not in ("shard", "slot")]
    back = rows.select(own)
    assert back.exceptAll(edge_docs.select(own)).count() == 0 and back.count() == 12


def test_old_shards_out_of_range_are_refused(spark, documents, tmp_path):
    for number in (-1, 4):
        old = F.when(F.col("doc_id") % 2 == 0, number).otherwise(F.col("doc_id") % 4)
        with pytest.raises(ValueError, match="0 to 3"):
            sharding.reshard(documents, old, 4, 8, str(tmp_path / f"bad{number}"))
        assert not (tmp_path / f"bad{number}").exists()
