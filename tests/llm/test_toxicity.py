import random

from pyspark.sql import functions as F

from leafmill.llm import language, toxicity


def test_folding():
    fold = toxicity.folded
    assert fold("1D10T!") == fold("idiot ") == " idiot  "
    assert fold("іdіоt") == fold("ｉｄｉｏｔ") == fold("ïdîôt") == fold("idiot")
    assert fold("l0$er") == fold("loser") == fold("1oser")
    assert fold(None) == "  " and len(fold("ab c")) == 6


def test_weights_exceptions_and_longest_term():
    machine = toxicity.automaton({" trash ": 3.0, " tras": 1.0, " idiot ": 2.0}, ["trash can"])
    weight = toxicity.weight_of
    assert weight("Trash, idiot", machine) == (5.0, 2)
    assert weight("the trash can is full of trash", machine) == (3.0, 7)
    folded = toxicity.automaton({toxicity.folded("tras")[:-1]: 1.0}, [])
    assert weight("trashy talk", folded)[0] == 1.0
    assert weight("", machine) == (0.0, 0) and weight("trash", None) == (0.0, 1)


def test_held_out_scores_follow_the_labels(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    out = language.held_out(F.col("doc_id"), 3, 1)
    model = toxicity.fit(docs, labels.filter(~out))
    rows = toxicity.score(docs, model).join(labels, "doc_id").filter(out)
    hits = {(r.toxic, r.predicted): r["count"] for r in rows.groupBy("toxic", "predicted").count().collect()}
    precision = hits[1, 1] / (hits[1, 1] + hits.get((0, 1), 0))
    recall = hits[1, 1] / (hits[1, 1] + hits.get((1, 0), 0))
    assert precision > 0.95 and recall > 0.6
    words = {t.strip() for t in model.lexicon}
    assert {"idiot", "moron", "scum"} <= words


def test_learning_does_not_depend_on_partitions(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    models = [
        toxicity.fit(docs.repartition(n, key), labels) for n, key in ((1, "lang"), (7, "doc_id"))
    ]
    assert models[0].lexicon == models[1].lexicon and models[0].curve == list(models[1].curve)


def naive_weight(text, lexicon, exceptions):
    """Every term at every place of the folded text."""
    plain = toxicity.folded(text)
    held = [" " + " ".join(toxicity.folded(e).split()) + " " for e in exceptions]
    # the blank behind a phrase is the one in front of the next word
    excused = [(i, i + len(e) - 1) for e in held for i in range(len(plain)) if plain.startswith(e, i)]
    total = 0.0
    for i in range(len(plain)):
        hits = [w for t, w in lexicon.items() if plain.startswith(t, i)]
        if hits and max(hits) > 0 and not any(a <= i < b for a, b in excused):
            total += max(hits)
    return total, len(plain.split())


def test_matches_a_naive_matcher_on_random_texts():
    draw = random.Random(2)
    words = ["trash", "can", "bin", "idi0t", "1diot", "scum", "pond", "fine", "trashy", "Тrash", "a", "çan"]
    lexicon = {" trash ": 3.0, " tras": 1.5, toxicity.folded("idiot"): 2.0, " scum ": 4.0, " pon": 0.5}
    machine = toxicity.automaton(lexicon, toxicity.EXCEPTIONS)
    for _ in range(500):
        text = "".join(draw.choice(words) + draw.choice([" ", ", ", "\n", ""]) for _ in range(draw.randint(0, 12)))
        got = toxicity.weight_of(text, machine)
        want = naive_weight(text, lexicon, toxicity.EXCEPTIONS)
        assert got[1] == want[1] and abs(got[0] - want[0]) < 1e-9, text


def test_disguised_words_score_alike(spark):
    toxic = [(i, f"you idiot number{i} of the day", 1) for i in range(40)]
    clean = [(100 + i, f"a fine number{i} of the day", 0) for i in range(60)]
    docs = spark.createDataFrame(toxic + clean, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    test = ["you idiot there now ok", "you 1d10t there now ok", "you іdіоt there now ok", "kind"]
    rows = spark.createDataFrame(list(enumerate(test)), "doc_id long, text string")
    got = [r.score for r in toxicity.score(rows, model).orderBy("doc_id").collect()]
    assert got[0] == got[1] == got[2] > 0.7 > got[3]


def test_edges(spark, edge_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(edge_docs, none)
    rows = toxicity.score(edge_docs, model).collect()
    assert len(rows) == 12 and all(r.score < 0.01 and r.predicted == 0 for r in rows)
    labels = spark.createDataFrame(
        [(1, 1), (2, 0), (8, 0), (3, 1), (None, 1), (9, None)], "doc_id long, toxic int"
    )
    model = toxicity.fit(edge_docs, labels, extra={"fox": 4.0})
    rows = toxicity.score(edge_docs, model).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(edge_docs.limit(0), model).count() == 0
    only = toxicity.fit(edge_docs, labels.filter("toxic = 1"))
    assert all(r.predicted == 1 for r in toxicity.score(edge_docs, only).collect())
