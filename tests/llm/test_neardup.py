import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import common, neardup

LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, k):
    """(doc_id -> n_shingles, component) by comparing all pairs and joining sets."""
    sets = {i: shingle_set(t, k) for i, t in rows}
    groups = {i: {i} for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and 100 * both >= 80 * len(sets[a] | sets[b]) and groups[a] is not groups[b]:
            union = groups[a] | groups[b]
            for x in union:
                groups[x] = union
    return {i: (len(sets[i]), min(groups[i])) for i in sets}


def found(df, k):
    rows = neardup.near_duplicates(df, k).collect()
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}, rows


@pytest.mark.parametrize("k", [4, 5])
def test_matches_brute_force(spark, documents, k):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got, listed = found(documents, k)
    assert got == brute(rows, k)
    assert all(r.kept == (r.doc_id == r.component_id) for r in listed)


def test_large_groups_and_chains(spark):
    """A chain whose ends are not alike, a star of near misses, and copies."""
    draw = np.random.default_rng(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(30):  # each is near the next one only
        words = list(base)
        for j in range(i):
            words[(4 * j) % 120] = f"c{j}"
        rows.append((1000 - i, " ".join(words)))
    other = [f"v{i}" for i in range(150)]
    for i in range(80):  # pairwise around the threshold
        words = list(other)
        for j in draw.choice(150, 4, replace=False):
            words[j] = f"u{i}_{j}"
        rows.append((2000 + i, " ".join(words)))
    rows += [(3000 + i, "the same few words in all of these rows") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert found(df, 4)[0] == brute(rows, 4)


def test_small_blocks_give_the_same(spark, documents, monkeypatch):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 300)
    extra = [(5000 + i, rows[3][1] + f" tail{i} x{i}") for i in range(12)]
    df = documents.select("doc_id", "text").union(
        spark.createDataFrame(extra, "doc_id long, text string")
    )
    assert found(df, 4)[0] == brute(rows + extra, 4)


def test_odd_sketch_estimates_high_similarities(spark):
    draw = np.random.default_rng(5)
    for j in (0.95, 0.85, 0.8, 0.7):
        both = draw.integers(0, 2**63, 4000, dtype=np.uint64)
        own = int(4000 * (1 - j) / (2 * j))
        a, b = (
            np.concatenate([both, draw.integers(0, 2**63, own, dtype=np.uint64)]) for _ in "ab"
        )
        sketch = neardup.odd_sketch(np.array([neardup.minhash(a), neardup.minhash(b)]))
        df = spark.createDataFrame(
            [tuple(s.view(np.int64).tolist() for s in sketch)], "a array<long>, b array<long>"
        )
        estimate = df.select(neardup.sketch_similarity(F.col("a"), F.col("b"))).first()[0]
        assert abs(estimate - j) < 0.12


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    roots = neardup.components(edges).collect()
    assert len(roots) == 300 and {r.root for r in roots} == {0}


def test_edges(spark, edge_docs):
    got, rows = found(edge_docs, 5)
    assert len(rows) == 12
    assert got[1] == (12, 1) and got[2] == (12, 1) and got[9] == (12, 1)
    assert got[3] == (0, 3) and got[4] == (0, 4) and got[5] == (0, 5) and got[8][1] == 8
    lost = [r for r in rows if r.doc_id is None]
    assert len(lost) == 2 and all(r.component_id is None and r.kept for r in lost)
    assert found(edge_docs.limit(0), 5)[1] == []
    kept = neardup.keep_one_of_each(edge_docs)
    assert kept.columns == edge_docs.columns
    assert {r.doc_id for r in kept.collect()} == {1, 3, 4, 5, 6, 7, 8, None}


def test_words_that_a_polynomial_cannot_tell_apart():
    for n in (1024, 2048, 4096):
        order = [bin(i).count("1") & 1 for i in range(n)]
        pair = ["".join("ab"[b ^ flip] for b in order) for flip in (0, 1)]
        raw = np.frombuffer(" ".join(pair).encode(), np.uint8)
        hashes, count = common.word_hashes(raw, np.array([0, len(raw)]))
        assert count.tolist() == [2] and hashes[0] != hashes[1]
        upper = np.frombuffer(pair[0].upper().encode(), np.uint8)
        assert common.word_hashes(upper, np.array([0, n]))[0][0] == hashes[0]
