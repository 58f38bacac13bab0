"""The asset store over several runs, failed and competing ones among them."""

import os

import pytest
from pyspark.sql import functions as F

from leafmill.plans import pages as plans
from leafmill.plans.options import Options
from leafmill.sinks.asset_store import AssetStore


def docs_of(spark, *names):
    text = " ".join(f"![x](https://i/{n}.png)" for n in names)
    return spark.createDataFrame([(1, text), (2, text + " ![m](https://i/missing.png)")], "page_id bigint, markdown string")


@pytest.fixture
def assets(spark):
    rows = [(f"https://i/{n}.png", "image/png", bytearray(n.encode() * 3)) for n in "abcd"]
    rows += [("https://i/t.png", "text/html", bytearray(b"no")), ("https://i/a.png", "image/webp", bytearray(b"other"))]
    return spark.createDataFrame(rows, "url string, content_type string, bytes binary")


def held(store):
    return {r.url: bytes(r.bytes) for r in store.table().collect()}


def test_a_second_run_writes_nothing(spark, assets, tmp_path):
    store = AssetStore(spark, str(tmp_path))
    assert held(store) == {} and store.snapshot() == (0, [])
    assert store.add(docs_of(spark, "a", "b", "t"), assets) == 2
    assert held(store) == {"https://i/a.png": b"aaa", "https://i/b.png": b"bbb"}
    before = sorted(os.listdir(tmp_path / "data")), store.snapshot()
    assert store.add(docs_of(spark, "a", "b"), assets) == 0
    assert (sorted(os.listdir(tmp_path / "data")), store.snapshot()) == before
    assert store.add(docs_of(spark, "b", "c"), assets) == 1
    assert set(held(store)) == {f"https://i/{n}.png" for n in "abc"} and store.table().count() == 3
    listed = store.manifest(docs_of(spark, "c", "d")).collect()
    assert [(r.url, r.size) for r in listed] == [("https://i/c.png", 3)]
    assert AssetStore(spark, str(tmp_path)).snapshot()[0] == 2


def test_a_failed_run_leaves_no_half_row(spark, assets, tmp_path):
    store = AssetStore(spark, str(tmp_path))
    store.add(docs_of(spark, "a"), assets)
    broken = assets.repartition(3).withColumn(
        "bytes", F.when(F.col("url").contains("c.png"), F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("bytes")))
    with pytest.raises(Exception, match="lost"):
        store.add(docs_of(spark, "b", "c", "d"), broken)
    assert set(held(store)) == {"https://i/a.png"} and store.remove_unlisted() == 0
    # a run that died before its snapshot
    assets.write.parquet(str(tmp_path / "data" / "run=dead"))
    assert set(held(store)) == {"https://i/a.png"} and store.remove_unlisted() == 1


def test_competing_runs_store_a_payload_once(spark, assets, tmp_path, monkeypatch):
    store, other = AssetStore(spark, str(tmp_path)), AssetStore(spark, str(tmp_path))
    commit, late = store._commit, []

    def overtaken(number, runs):
        if not late:
            late.append(other.add(docs_of(spark, "a", "c"), assets))
        return commit(number, runs)

    monkeypatch.setattr(store, "_commit", overtaken)
    assert store.add(docs_of(spark, "a", "b"), assets) == 1 and late == [2]
    assert store.table().count() == 3 and len(os.listdir(tmp_path / "data")) == 2


def test_runs_download_what_their_pages_show(spark, assets, tmp_path):
    html = '<p>words <img src="https://i/a.png" alt="x"></p>'
    pages = spark.createDataFrame([(1, "https://h.example/", html)], "page_id bigint, url string, html string")
    store = AssetStore(spark, str(tmp_path))
    out = plans.run_mode(pages, Options(raw=True, download_images=True), assets, store).first()
    assert "![x](https://i/a.png)" in out.markdown and set(held(store)) == {"https://i/a.png"}
    options = Options(raw=True, download_images=True, embed_images=True)
    assert "data:image/png" in plans.run_mode(pages, options, assets, store).first().markdown
    with pytest.raises(ValueError):
        plans.run_mode(pages, Options(raw=True, download_images=True), assets)
    seeds = spark.createDataFrame([(1, "https://h.example/")], "seed_id int, url string")
    other = AssetStore(spark, str(tmp_path / "crawl"))
    plans.crawl_and_run(pages, seeds, Options(raw=True, download_images=True), assets, store=other)
    assert set(held(other)) == {"https://i/a.png"}
