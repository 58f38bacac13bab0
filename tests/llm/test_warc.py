import gzip
import io
import random

import pytest
from pyspark.sql import functions as F

from leafmill.llm import warc


def expected(rows):
    first = {}
    for i, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, html in rows:
        payload = (html or "").encode()
        again = i is not None and first[html or ""] != i
        out.append((
            i, len(payload), warc.payload_digest(payload), "revisit" if again else "response",
            first[html or ""] if again else None,
        ))
    return sorted(out, key=str)


def read(spark, df, folder, **options):
    manifest = warc.write_archives(df, folder)
    rows = warc.read_archives(spark, manifest, folder, **options)
    return rows.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    ), rows


@pytest.mark.parametrize("split", [37, 1000, 1 << 24])
def test_round_trip_with_any_split(spark, tmp_path, split):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(12)
    extra = [
        (100, "http://a b/\r\nX: y", "same"), (101, None, "same"), (99, "http://ü", "same"),
        (102, "u", None), (103, "u", ""), (None, "u", "same"), (104, "u", "WARC/1.1\r\n\r\n" * 40),
    ]
    df = pages.select("page_id", "url", "html").union(
        spark.createDataFrame(extra, "page_id long, url string, html string")
    )
    want = expected([(r.page_id, r.html) for r in df.collect()])
    got, rows = read(spark, df, str(tmp_path / "w"), split_bytes=split)
    assert sorted(map(tuple, got.collect()), key=str) == want
    texts = {r.page_id: r.payload for r in rows.filter("record_type = 'response'").collect()}
    assert bytes(texts[99]) == b"same" and bytes(texts[102]) == b""


def test_archives_are_plain_gzip_of_warc(spark, tmp_path):
    df = spark.createDataFrame(
        [(i, f"http://h/{i}", f"<p>{i % 3}") for i in range(9)],
        "page_id long, url string, html string",
    )
    manifest = warc.write_archives(df, str(tmp_path)).collect()
    whole = b"".join(gzip.open(tmp_path / r.name).read() for r in manifest)
    assert whole.count(b"WARC/1.1\r\n") == 9 and whole.count(b"WARC-Type: revisit") == 6


class _File(io.BytesIO):
    def read_at(self, n, at):
        return self.getvalue()[at : at + n]


def test_ranges_own_each_record_once_despite_false_magic():
    draw = random.Random(2)
    noise = bytes(draw.randrange(256) for _ in range(3000))
    members = [
        warc.record(i, "http://x", warc.MAGIC * 5 + noise[: draw.randrange(3000)] + warc.MAGIC, None, level)
        for i, level in enumerate([0, 6, 0, 9, 0, 1])
    ]
    data = b"".join(members)
    starts = [sum(map(len, members[:i])) for i in range(6)]
    for size in (1, 50, 777, 10**6):
        found = [
            offset
            for at in range(0, len(data), size)
            for offset, _, _ in warc.records(_File(data), at, min(at + size, len(data)), len(data))
        ] if size > 1 else starts
        assert found == starts


def test_large_payload_and_truncated_member():
    big = random.Random(3).randbytes(3 * warc.BLOCK)
    member = warc.record(1, "u", big, None)
    ((_, _, block),) = warc.records(_File(member), 0, len(member), len(member))
    assert block.endswith(big)
    with pytest.raises(ValueError):
        list(warc.records(_File(member[:-9]), 0, len(member) - 9, len(member) - 9))


def test_edges(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert read(spark, empty, str(tmp_path / "a"))[0].count() == 0
    rows = [(1, "u", "x", 5), (1, "u", "x", 5), (2, "u", "x", 6), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, sha int")
    df = df.withColumn("refers_to", F.lit("clash")).withColumn("payload", F.lit(1))
    got = read(spark, df, str(tmp_path / "b"))[0].collect()
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in got)
    assert kinds == [
        ("1", "response", None), ("1", "response", None), ("2", "revisit", 1),
        ("None", "response", None),
    ]


def test_repeats_of_a_page_that_is_not_the_first_are_not_multiplied(spark, tmp_path):
    rows = [(1, "u", "x")] + [(2, "u", "x")] * 3 + [(3, "v", "y")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = read(spark, df, str(tmp_path / "w"))[0].collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == [
        (1, "response", None), (2, "revisit", 1), (2, "revisit", 1), (2, "revisit", 1),
        (3, "response", None), (3, "response", None),
    ]


def test_headers_of_any_length_are_read(spark, tmp_path):
    draw = random.Random(4)
    noise = "".join(chr(draw.randrange(33, 127)) for _ in range(400_000))
    urls = ["u", "data:" + "a" * 65_536, "data:" + " " * 70_000, noise, noise[:65_300], "v"]
    rows = [(i, url, f"<p>{i // 2}") for i, url in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for split in (50_000, 1 << 24):
        folder = str(tmp_path / f"w{split}")
        manifest = warc.write_archives(df, folder)
        got = warc.read_archives(spark, manifest, folder, split_bytes=split).collect()
        assert {(r.page_id, r.url) for r in got} == {
            (i, url.replace(" ", "%20")) for i, url in enumerate(urls)
        }
        assert len(got) == len(urls)


def test_header_that_never_ends_is_no_record():
    import zlib

    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    member = packer.compress(b"WARC/1.1\r\nA: " + b"a" * 300_000) + packer.flush()
    good = warc.record(1, "u", b"x", None)
    data = member + good + member[:-20]
    found = list(warc.records(_File(data), 0, len(data), len(data)))
    assert [offset for offset, _, _ in found] == [len(member)]
