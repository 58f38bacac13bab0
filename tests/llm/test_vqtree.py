import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import queries, vqtree


def lloyd(vectors, parts, entries, rounds):
    """Exhaustive rounds over all rows (already in the order of their ids)."""
    n, width = vectors.shape
    x = vectors.reshape(n, parts, width // parts)
    books = x[:entries].transpose(1, 0, 2).copy()

    def nearest():
        gaps = x[:, :, None, :] - books[None]
        return (gaps * gaps).sum(axis=3)

    for _ in range(rounds):
        code = nearest().argmin(axis=2)
        for p in range(parts):
            for k in range(books.shape[1]):
                own = x[code[:, p] == k, p]
                if len(own):
                    books[p, k] = [int(s) // len(own) for s in own.sum(axis=0)]
    d = nearest()
    return d.argmin(axis=2), d.min(axis=2).sum(axis=1), books


def some_points(kind, rows=700, width=8):
    draw = np.random.default_rng(len(kind))
    return {
        "normal": lambda: draw.normal(0, 40, (rows, width)).astype(int),
        "lattice": lambda: draw.integers(0, 3, (rows, width)),
        "copies": lambda: np.repeat(draw.integers(-50, 50, (9, width)), rows // 9 + 1, axis=0)[:rows],
        "clusters": lambda: draw.integers(-900, 900, (12, width))[draw.integers(0, 12, rows)]
        + draw.integers(-3, 4, (rows, width)),
        "far": lambda: draw.integers(-(1 << 21), 1 << 21, (rows, width)),
    }[kind]()


KINDS = ["normal", "lattice", "copies", "clusters", "far"]


@pytest.mark.parametrize("kind", KINDS)
def test_tree_covers_separates_and_keeps_every_point(kind):
    x = some_points(kind).reshape(-1, 2, 4).transpose(1, 0, 2)
    tree = vqtree.build(x)
    flat = x.reshape(-1, 4)
    assert sorted(tree.order) == list(range(len(flat))) and (flat[tree.order] == tree.points).all()
    for v in range(len(tree.start)):
        inside = tree.points[tree.start[v] : tree.end[v]].astype(np.int64)
        gap = ((inside - tree.points[tree.centre[v]]) ** 2).sum(axis=1)
        assert gap.max() == tree.radius[v] and tree.start[v] <= tree.centre[v] < tree.end[v]
        if tree.child[v] < 0:
            assert len(inside) <= vqtree.LEAF or tree.radius[v] == 0
            continue
        kids = np.arange(tree.child[v], tree.last[v])
        assert tree.start[kids[0]] == tree.start[v] and tree.end[kids[-1]] == tree.end[v]
        assert (tree.start[kids[1:]] == tree.end[kids[:-1]]).all()
        cover = 4.0 ** np.ceil(np.log2(tree.radius[v]) / 2 - 1)
        middles = tree.points[tree.centre[kids]].astype(np.int64)
        apart = ((middles[:, None] - middles[None]) ** 2).sum(axis=2)
        np.fill_diagonal(apart, np.iinfo(np.int64).max)
        assert apart.min() > cover and tree.radius[kids].max() <= cover


@pytest.mark.parametrize("kind", KINDS)
def test_walk_equals_exhaustive_assignment(kind):
    vectors = some_points(kind)
    x = vectors.reshape(-1, 2, 4).transpose(1, 0, 2)
    tree = vqtree.build(x)
    code, error, _ = lloyd(vectors, 2, 20, 0)
    books = x[:, :20].copy()
    walk = vqtree.Walk(tree, books)
    found = np.empty(x.shape[0] * x.shape[1], np.int64)
    found[tree.order] = walk.codes()
    assert (found.reshape(2, -1).T == code).all()
    total, count = walk.sums(books.shape)
    for p in range(2):
        for k in range(20):
            own = x[p][code[:, p] == k]
            assert count[p, k] == len(own) and (total[p, k] == own.sum(axis=0)).all()
    if kind == "copies":
        assert not len(walk.places)


def test_whole_clusters_go_with_their_subtree():
    draw = np.random.default_rng(4)
    centres = draw.integers(-900, 900, (12, 4))
    x = (centres[draw.integers(0, 12, 2000)] + draw.integers(-3, 4, (2000, 4)))[None]
    walk = vqtree.Walk(vqtree.build(x), centres[None])
    assert not len(walk.places) and len(walk.nodes) < 200


@pytest.mark.parametrize("block_rows", [64, 1 << 14])
def test_matches_exhaustive_rounds(spark, block_rows):
    vectors = some_points("normal", 500, 16)
    vectors[100:300] = vectors[7]
    ids = np.random.default_rng(0).permutation(500) * 3 - 200
    rows = [(int(i), (v / 256).tolist(), int(i) % 4 or None) for i, v in zip(ids, vectors, strict=True)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    codes, books = vqtree.compress(df, parts=4, entries=16, rounds=2, block_rows=block_rows)
    got = {r.vec_id: r for r in vqtree.with_label_error(codes).collect()}
    order = np.argsort(ids)
    code, error, want = lloyd(vectors[order], 4, 16, 2)
    assert (books == want).all()
    label = {}
    for i, e in zip(ids[order], error, strict=True):
        label[i % 4] = label.get(i % 4, 0) + int(e)
    for i, c, e in zip(ids[order], code, error, strict=True):
        r = got.pop(int(i))
        assert r.code == "".join(f"{k:02x}" for k in c) and r.error == e and r.label_error == label[i % 4]
    assert not got


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (5, [1.0, 2.0], 1), (5, [1.0, 2.0], 1), (5, [0.5, 2.0], 2), (None, [3.0, 4.0], None), (7, None, 1),
        (8, [nan, 1.0], 1), (9, [1.0, -inf], 1), (10, [None, 1.0], 1), (11, [-0.001, 3.0], None),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df = df.withColumns({n: F.lit("x") for n in ("vec", "code", "error", "_salt", "_label", "_none", "label_error")})
    codes, books = vqtree.compress(df, parts=2)
    got = vqtree.with_label_error(codes).collect()
    assert len(got) == 5 and books.shape == (2, 2, 1)
    assert {r.label_error for r in got if r.label is None} == {sum(r.error for r in got if r.label is None)}
    none, books = vqtree.compress(df.limit(0))
    assert none.count() == 0 and books is None
    only_bad, books = vqtree.compress(df.filter("vec_id between 7 and 10"))
    assert only_bad.count() == 0 and books is None
    with pytest.raises(ValueError, match="share one length"):
        vqtree.compress(df, parts=16)
    with pytest.raises(ValueError, match="no row has an id"):
        vqtree.compress(df.filter("vec_id is null"), parts=2)


def test_query_matches_its_sql(spark, same_as_sql):
    same_as_sql(queries.op13_cover_tree_codes, queries.OP13_SQL, "embeddings")
