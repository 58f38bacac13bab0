import re

import corpus_pipeline
from pyspark.sql import functions as F

from leafmill.llm import decontam

from test_neardup import brute

SF = "/root/testdata/sf0.001"


def test_stages_do_what_they_are_for(spark, documents, tmp_path):
    """Each stage against a plain version over its own input."""
    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "sharding":
            assert out.columns == documents.columns
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        seen[name] = (
            {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.text for r in out.collect()}
        )
        docs = out
    before, after = seen["language"]
    assert set(after) == {i for i, t in before.items() if re.search(r"[^\W\d_]", t or "")}
    before, after = seen["near_duplicates"]
    assert set(after) == {i for i, (_, c) in brute(list(before.items()), 5).items() if i == c}
    before, after = seen["decontamination"]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    held = {i for i, t in before.items() if any(plain(x) in plain(t) for x in items)}
    assert set(after) == set(before) - held
    before, after = seen["mixing"]
    assert set(after) < set(before) and len(after) > 0.5 * len(before)
    before, after = seen["sharding"]
    assert after == before
    for b, a in seen.values():
        assert all(b[i] == t for i, t in a.items())  # whole texts throughout
    size = docs.groupBy("shard").agg(F.sum("size").alias("s"), F.max("slot").alias("m"), F.count("*").alias("n"))
    assert all(r.m == r.n - 1 for r in size.collect())
    assert decontam.MIN_TOKENS <= 13


def test_stages_take_odd_rows(spark, edge_docs):
    docs = edge_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    rows = docs.collect()
    assert {r.doc_id for r in rows} <= {1, 7, 8, None} and rows


def test_stages_take_no_rows(spark, documents):
    docs = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
