"""Files that jobs write: complete, once, and listed."""

import hashlib
import os

import pyarrow as pa
import pyarrow.parquet  # noqa: F401
import pytest
from pyspark.sql import functions as F

from leafmill.operators.convert import to_markdown
from leafmill.sinks import artifacts, files
from leafmill.sources.pages import read_html_files


def on_disk(folder):
    return {
        os.path.relpath(os.path.join(at, f), folder): open(os.path.join(at, f), "rb").read()
        for at, _, names in os.walk(folder) for f in names if f[0] not in "._" and f != "listing.parquet"
    }


def test_every_row_becomes_one_listed_file(spark, tmp_path):
    rows = [(f"f{i}.txt", f"text é {i}" if i % 7 else None) for i in range(200)]
    table = spark.createDataFrame(rows, "name string, content string").repartition(5)
    run = files.write_files(table, str(tmp_path), files_per_folder=13)
    held = on_disk(tmp_path / run)
    listed = {r.file: r for r in files.written_files(spark, str(tmp_path), run).collect()}
    assert set(held) == set(listed) and len(held) == 200
    for file, data in held.items():
        r = listed[file]
        assert (r.size, r.md5) == (len(data), hashlib.md5(data).hexdigest())
        assert data == (dict(rows)[r.name] or "").encode()
    folders = {}
    for file in held:
        folders[os.path.dirname(file)] = folders.get(os.path.dirname(file), 0) + 1
    assert max(folders.values()) <= 13
    summary = files.run_summary(str(tmp_path), run)
    assert summary["files"] == 200 and summary["bytes"] == sum(map(len, held.values()))
    back = {r.name: bytes(r.content) for r in files.read_files(spark, str(tmp_path), run).collect()}
    assert back == {n: (c or "").encode() for n, c in rows}
    assert files.repeated_names(files.written_files(spark, str(tmp_path), run)).count() == 0


def test_a_task_that_runs_twice_leaves_no_double(tmp_path):
    writer = files.FileWriter({"path": str(tmp_path), "run": "r"})
    batch = pa.RecordBatch.from_pydict({"name": ["a.md", "b/c.md"], "content": [b"1", b"22"]})
    lost, kept = writer.write(iter([batch])), writer.write(iter([batch]))
    with pytest.raises(RuntimeError):
        writer.write(broken(batch))
    assert len(os.listdir(tmp_path / "r")) == 3
    writer.commit([kept, None])
    assert sorted(os.listdir(tmp_path / "r")) == sorted(["_run.json", kept.folder])
    assert set(on_disk(tmp_path / "r")) == {f"{kept.folder}/000000/a.md", f"{kept.folder}/000000/b/c.md"}
    assert files.run_summary(str(tmp_path), "r") == {"parts": [kept.folder], "files": 2, "bytes": 3}
    assert lost.folder != kept.folder


def broken(batch):
    yield batch
    raise RuntimeError("lost")


def test_a_failed_run_leaves_nothing(spark, tmp_path):
    bad = spark.range(40).select(
        F.when(F.col("id") == 39, "../out").otherwise(F.concat(F.lit("n"), "id")).alias("name"),
        F.lit("x").alias("content"))
    with pytest.raises(Exception, match="not a relative file name"):
        files.write_files(bad.repartition(4), str(tmp_path), run="bad")
    assert not (tmp_path / "bad").exists() and not (tmp_path / "out").exists()
    for name in ("/abs", "", "a//b", "a/../../b", "."):
        writer = files.FileWriter({"path": str(tmp_path), "run": "r"})
        with pytest.raises(ValueError):
            writer.write(iter([pa.RecordBatch.from_pydict({"name": [name], "content": [b""]})]))


def test_runs_stand_beside_each_other(spark, tmp_path):
    table = spark.createDataFrame([("a", bytearray(b"\x00\xff"))], "name string, content binary")
    one, two = (files.write_files(table, str(tmp_path)) for _ in range(2))
    assert one != two and sorted(os.listdir(tmp_path)) == sorted([one, two])
    assert bytes(files.read_files(spark, str(tmp_path), two).first().content) == b"\x00\xff"
    none = files.write_files(table.limit(0), str(tmp_path))
    assert files.written_files(spark, str(tmp_path), none).count() == 0
    assert files.read_files(spark, str(tmp_path), none).count() == 0
    assert files.run_summary(str(tmp_path), none)["files"] == 0


def test_archives_and_html_files_come_back(spark, tmp_path):
    pages = spark.createDataFrame(
        [("p1", "# One", "", bytearray(b"PNG"), None, "{}"), ("p2", "two", "refs", None, bytearray(b"PDF"), None)],
        "slug string, markdown string, references string, screenshot binary, pdf binary, json string")
    run = files.write_files(artifacts.archive_files(artifacts.archive_artifacts(pages)), str(tmp_path))
    back = {r.name: bytes(r.content) for r in files.read_files(spark, str(tmp_path), run).collect()}
    assert back == {
        "p1/article.md": b"# One", "p1/screenshot.png": b"PNG", "p1/metadata.json": b"{}",
        "p2/article.md": b"two", "p2/references.md": b"refs", "p2/article.pdf": b"PDF"}
    html = spark.createDataFrame([("a.html", "<h1>A</h1>"), ("b.html", "<p>é")], "name string, content string")
    run = files.write_files(html, str(tmp_path))
    got = to_markdown(read_html_files(spark, f"{tmp_path}/{run}"), strip_boilerplate=False, key="path")
    assert {r.path.rsplit("/", 1)[1]: r.markdown for r in got.collect()} == {"a.html": "# A", "b.html": "é"}


def test_a_run_is_read_by_its_listing(spark, tmp_path):
    rows = [("_a.html", "<p>a"), (".b.html", "<p>b"), ("c d%20é#.HTM", "<p>c"), ("e.txt", "e"), ("f.html", None)]
    table = spark.createDataFrame(rows, "name string, content string").repartition(3)
    run = files.write_files(table, str(tmp_path))
    found = files.read_files(spark, str(tmp_path), run)
    # no scan of the files themselves, whose statuses would all lie on the driver
    assert {os.path.basename(f) for f in found.inputFiles()} == {"listing.parquet"}
    assert {r.name: bytes(r.content) for r in found.collect()} == {n: (c or "").encode() for n, c in rows}
    pages = read_html_files(spark, str(tmp_path), run)
    assert {os.path.basename(f) for f in pages.inputFiles()} == {"listing.parquet"}
    assert {os.path.basename(r.path): r.html for r in pages.collect()} == dict(rows[:3])
    gone = found.first().file
    os.remove(tmp_path / run / gone)
    with pytest.raises(Exception, match="No such file"):
        found.collect()


def test_contents_come_in_small_batches(tmp_path):
    texts = [b"x" * (1 << 20)] * 40
    writer = files.FileWriter({"path": str(tmp_path), "run": "r"})
    part = writer.write(iter([pa.RecordBatch.from_pydict({"name": [f"{i}.md" for i in range(40)], "content": texts})]))
    listing = pa.parquet.read_table(tmp_path / "r" / part.folder / "listing.parquet").to_batches()
    made = list(files._contents(str(tmp_path / "r"))(iter(listing)))
    assert [len(b) for b in made[:5]] == [8] * 5 and sum(map(len, made)) == 40
    assert pa.Table.from_batches(made).column("content").to_pylist() == texts
