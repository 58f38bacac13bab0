import itertools
import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from leafmill.llm import hmm, language

LOWER = {c: c + 32 for c in range(65, 91)}


def tiny_model(seed=0, states=3, symbols=4):
    draw = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return hmm.Model(
        norm(draw.random(states), 0), norm(draw.random((states, states)), 1),
        norm(draw.random((symbols, states)), 0),
    )


def all_paths(seq, model):
    states = range(len(model.start))
    for path in itertools.product(states, repeat=len(seq)):
        p = model.start[path[0]] * model.emit[seq[0], path[0]]
        for t in range(1, len(seq)):
            p *= model.move[path[t - 1], path[t]] * model.emit[seq[t], path[t]]
        yield path, p


SEQS = [np.array(s, "<u2") for s in ([0], [1, 2, 3, 0], [3, 3, 0], [2, 1, 2, 1, 0], [1, 0])]


def test_forward_is_exact():
    model = tiny_model()
    got = hmm.log_likelihood(SEQS, model)
    want = [math.log(sum(p for _, p in all_paths(s, model))) for s in SEQS]
    assert np.allclose(got, want)


def test_expected_counts_match_all_paths():
    model = tiny_model(1)
    start, moves, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((4, 3))
    for s in SEQS:
        paths = list(all_paths(s, model))
        total = sum(p for _, p in paths)
        for path, p in paths:
            start[path[0]] += p / total
            for t, state in enumerate(path):
                emits[s[t], state] += p / total
                if t:
                    moves[path[t - 1], state] += p / total
    got = hmm.expected_counts(SEQS, model)
    for a, b in zip(got, (start, moves, emits), strict=True):
        assert np.allclose(a, b, atol=1e-4)


def test_reestimation_raises_the_likelihood():
    draw = np.random.default_rng(4)
    seqs = [
        np.append(draw.integers(1, 3, 30) + 2 * (k % 2), 0).astype("<u2") for k in range(40)
    ]
    model, last = tiny_model(2, 3, 5), -np.inf
    for _ in range(12):
        now = hmm.log_likelihood(seqs, model).sum()
        assert now >= last - 1e-3
        last = now
        start, moves, emits = (x + 1e-6 for x in hmm.expected_counts(seqs, model))
        model = hmm.Model(
            start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0)
        )


def test_long_sequences_do_not_underflow():
    seq = np.append(np.random.default_rng(0).integers(1, 4, 100_000), 0).astype("<u2")
    assert np.isfinite(hmm.log_likelihood([seq], tiny_model())).all()


def test_base_scores_and_counts_match_brute_force(spark, documents, edge_docs):
    docs = documents.select("doc_id", "text").union(edge_docs.select("doc_id", "text"))
    rows = hmm.score(docs, language.held_out(F.col("doc_id"), 5, 1)).collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    import zlib

    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    count = Counter(w for i, t in texts if not out(i) for w in [*words(t), None])
    n, v = sum(count.values()), len(count)
    want = []
    for i, t in texts:
        tokens = [*words(t), None]
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        want.append((str(i), out(i), len(tokens), sum(count[w] > 0 for w in tokens), n, round(base, 4)))
    got = [
        (str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4))
        for r in rows
    ]
    assert sorted(got) == sorted(want)
    assert all(np.isfinite(r.score) and r.score < 0 for r in rows)


def test_beats_the_unigram_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = hmm.score(docs, language.held_out(F.col("doc_id"), 5, 1)).filter("held_out")
    r = rows.agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert r[0] > r[1] + 0.15 * r[2]


def test_probabilities_of_one_word_texts_sum_to_one(spark, monkeypatch):
    """Over all known words and the unseen rest, the model is a distribution."""
    monkeypatch.setattr(hmm, "HEAD", 5)
    monkeypatch.setattr(hmm, "KNOWN", 8)
    text = "a b c d e f g h i j k a b c d e f a b c a b a"
    rows = [(i, text) for i in range(30)]
    one = [(1000 + i, w) for i, w in enumerate([*sorted(set(text.split())), ""])]
    docs = spark.createDataFrame(rows + one, "doc_id long, text string")
    model_rows = hmm.score(docs, F.col("doc_id") >= 1000, states=2).filter("doc_id >= 1000")
    first = {r.doc_id: 10**r.score for r in model_rows.collect()}
    # what a first word and the end after it take is at most one, and not much less here
    assert 0 < sum(first.values()) <= 1.0001


def test_empty_and_untrained(spark, edge_docs):
    nothing = hmm.score(edge_docs.limit(0), F.lit(False))
    assert nothing.count() == 0
    untrained = hmm.score(edge_docs, F.lit(True)).collect()
    assert len(untrained) == 12 and all(r.train_tokens == 0 and r.n_known == 0 for r in untrained)
    assert all(np.isfinite(r.score) for r in untrained)
