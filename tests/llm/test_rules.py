import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from leafmill.llm import queries, rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {
        i + j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(8)
    }
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)), len(hit),
    )


def test_counts_match_brute_force(spark, documents, edge_docs):
    extra = [(900, "a b c d e f g h\n" * 3), (901, "x" * 50), (902, "é # ü\n\n \n# é\nx\n x\nx")]
    df = documents.select("doc_id", "text").union(
        spark.createDataFrame(extra, "doc_id long, text string")
    ).union(edge_docs.select("doc_id", "text"))
    want = sorted((str(r.doc_id), *brute(r.text)) for r in df.collect())
    got = rules.statistics(df).select("doc_id", *rules.COUNTS[:5]).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == want


def test_counts_do_not_depend_on_windows(spark, documents, monkeypatch):
    import pyarrow as pa

    from leafmill.llm import common

    batch = pa.RecordBatch.from_pandas(documents.select("doc_id", "text").limit(30).toPandas())
    whole = next(rules._statistics([batch]))
    monkeypatch.setattr(common, "WINDOW", 97)
    assert next(rules._statistics([batch])).to_pydict() == whole.to_pydict()


def test_learns_planted_conjunctions():
    draw = np.random.default_rng(1)
    table = {n: draw.random(6000) for n in rules.features()}
    bad = (table["symbol_share"] > 0.7) & (table["digit_share"] <= 0.4)
    bad |= table["dup_line_share"] > 0.9
    found = rules.learn(table, ~bad, np.arange(6000))
    test = {n: draw.random(4000) for n in rules.features()}
    want = ~(((test["symbol_share"] > 0.7) & (test["digit_share"] <= 0.4)) | (test["dup_line_share"] > 0.9))
    verdict = np.full(4000, found.default)
    open_ = np.ones(4000, bool)
    for rule in found.rules:
        hit = rule.covers(test) & open_
        verdict[hit] = rule.keep
        open_ &= ~hit
    assert (verdict == want).mean() > 0.97


def test_noise_teaches_no_rule():
    draw = np.random.default_rng(3)
    table = {n: draw.random(3000) for n in rules.features()}
    found = rules.learn(table, draw.random(3000) < 0.85, np.arange(3000))
    verdict = np.full(3000, found.default)
    for rule in reversed(found.rules):
        verdict[rule.covers(table)] = rule.keep
    assert found.default and verdict.mean() > 0.9


def test_query_separates_quality_on_labels(spark):
    d = "/root/testdata/sf0.01"
    rows = queries.op4_decision_list_quality(spark, d)
    labels = spark.read.parquet(f"{d}/labels.parquet")
    hit = F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int"))
    # short texts fail the base rules whatever their label
    assert rows.filter("n_words >= 20").join(labels, "doc_id").agg(hit).first()[0] > 0.97
    assert rows.filter("base_failed and kept").count() == 0


def test_edges(spark, edge_docs):
    stats = rules.statistics(edge_docs)
    assert stats.count() == 12 and rules.statistics(edge_docs.limit(0)).count() == 0
    labels = spark.createDataFrame(
        [(1, 1), (7, 0), (None, 1), (8, None)], "doc_id long, quality int"
    )
    learned = rules.fit(stats, labels)
    kept = stats.select(~rules.base_failed() & learned.column()).collect()
    assert len(kept) == 12 and all(r[0] is not None for r in kept)
    assert rules.fit(stats, labels.limit(0)) == rules.DecisionList((), True)
    one = spark.createDataFrame([(7, 0)], "doc_id long, quality int")
    assert rules.fit(stats, one).default in (True, False)
