import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill.llm import language


def test_codewords_are_distinct_and_far_apart():
    for n in (1, 2, 3, 4, 7, 20, 100):
        code = language.codewords(n)
        assert code.shape[0] == n
        apart = [(a != b).sum() for a, b in itertools.combinations(code, 2)]
        if n > 7:
            assert min(apart) >= 5
        elif n > 1:
            assert min(apart) == 1 << (n - 2)


def test_one_wrong_bit_is_corrected():
    model = language.Model(["a", "b", "c", "d"], np.ones((4, language.BUCKETS)))
    for k in range(4):
        margins = model.code[k].astype(float)
        for bit in range(model.code.shape[1]):
            hurt = margins.copy()
            hurt[bit] *= -1
            best, _ = model.decode(hurt[None])
            assert best[0] == k


def test_a_point_between_two_codewords_is_ambiguous():
    model = language.Model(["a", "b"], np.ones((2, language.BUCKETS)))
    best, score = model.decode(np.zeros((1, 1)))
    assert best[0] == 0 and score[0] < language.AMBIGUOUS


def test_held_out_accuracy(spark, documents):
    out = language.held_out(F.col("doc_id"), 4, 2)
    model = language.fit(documents.filter(~out))
    found = language.identify(documents, model).join(documents, "doc_id").filter(out)
    wrong = found.filter("lang != lang_pred").count()
    assert found.count() > 30 and wrong == 0


def test_labels_do_not_reach_the_prediction(spark, documents):
    model = language.fit(documents)
    swapped = documents.withColumn("lang", F.lit("en")).withColumn("source", F.lit(None))
    a = language.identify(documents, model).orderBy("doc_id").collect()
    assert a == language.identify(swapped, model).orderBy("doc_id").collect()


def test_grams_do_not_depend_on_neighbours_or_windows(monkeypatch, documents):
    model = language.fit(documents)
    texts = ["Straße — ça va", "", None, "ñandú " * 50, "x", "日本語 テキスト"]
    alone = [model.margins(pa.RecordBatch.from_pydict({"text": [t or ""]}))[0][0] for t in texts]
    together = model.margins(pa.RecordBatch.from_pydict({"text": texts}))[0]
    assert (np.array(alone) == together).all()
    for window in (1, 2, 3, 7, 50):
        monkeypatch.setattr(language, "GRAM_WINDOW", window)
        assert (model.margins(pa.RecordBatch.from_pydict({"text": texts}))[0] == together).all()


def plain_grams(text):
    """Letter n-grams by slicing the text with each run of other characters as one blank."""
    table = language.letter_table()
    letters = "".join(chr(table[ord(c)]) for c in text)
    plain = re.sub(" +", " ", letters).lstrip(" ")
    return [plain[i : i + n] for n in (1, 2, 3) for i in range(len(plain) - n + 1)]


def plain_bucket(gram):
    hashed = 0
    for order, char in enumerate(gram):
        hashed = (hashed + ord(char) + order) * 0x9E3779B97F4A7C15 % 2**64
    return hashed >> (65 - language.BUCKETS.bit_length())


@pytest.mark.parametrize("window", [1, 5, 1 << 17])
def test_grams_equal_a_plain_count(monkeypatch, window):
    monkeypatch.setattr(language, "GRAM_WINDOW", window)
    texts = ["Straße — ça va?", "", " a", "ab  cd. ", "日本語 x", "Ö1ö", "--", "x" * 40]
    got = [Counter() for _ in texts]
    for bucket, row in language._grams(pa.RecordBatch.from_pydict({"text": texts})):
        for b, r in zip(bucket.tolist(), row.tolist(), strict=True):
            got[r][b] += 1
    assert got == [Counter(map(plain_bucket, plain_grams(t))) for t in texts]


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(language, "MAX_LANGUAGES", 2)
    rows = spark.createDataFrame([("a b", "x"), ("c d", "y"), ("e f", "z")], "text string, lang string")
    with pytest.raises(ValueError):
        language.fit(rows)


def test_edges(spark, edge_docs):
    rows = language.identify(edge_docs, language.fit(edge_docs)).collect()
    assert len(rows) == 12
    pred = {r.doc_id: r for r in rows}
    assert all(pred[i].lang_pred == "und" and pred[i].score == 0 for i in (3, 4, 5, 6))
    assert pred[8].lang_pred == "de" and pred[7].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in rows)
    none = edge_docs.withColumn("lang", F.lit(None).cast("string"))
    assert language.fit(none) is None
    assert {r.lang_pred for r in language.identify(edge_docs, None).collect()} == {"und"}
    assert language.identify(edge_docs.limit(0), None).count() == 0
    kept = language.keep_identified(edge_docs, language.fit(edge_docs))
    assert kept.columns == edge_docs.columns and kept.filter("doc_id in (3, 4, 5, 6)").count() == 0
