"""Inputs derived from the given tables, the same way in Spark and in SQL.

The given pages have no external links, dates, images or links to each other, and the
given documents no markdown. Whole tables and whole texts are used throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.sources.pages import read_pages


# The character 日 in double-byte charsets.
DAY = {"Shift_JIS": "93FA", "GBK": "C8D5", "Big5": "A4E9", "EUC-KR": "ECED"}

# A session may ask for so many partitions, for tables that are one split; off by default.
PARTITIONS = "spark.leafmill.readPartitions"


def _partitions(spark: SparkSession) -> int | None:
    asked = spark.conf.get(PARTITIONS, None)
    return int(asked) if asked else None


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pages(spark, f"{sf_dir}/pages.parquet", _partitions(spark))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, asked = spark.read.parquet(f"{sf_dir}/documents.parquet"), _partitions(spark)
    return docs.repartition(asked, "doc_id") if asked else docs


def _text(*parts: str | Column) -> Column:
    return F.concat(
        *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    )


def rich_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole given pages; each article begins with a heading, lists, a quote, code, a table,
    an image and a header that is to be stripped."""
    i = F.col("page_id")
    rich = _text(
        "<header><p>Site ", i, "</p></header><h2>Notes ", i, "</h2><ul><li>one ", i,
        '</li><li><a href="/n/', i % 9, '">two</a><ul><li>deep<li>deeper</ul></li></ul>',
        '<ol start="', i % 4, '"><li>three</li><li><em>four</em></li></ol><blockquote><p>Quoted ', i,
        "</p></blockquote><pre><code>x = ", i, "\n  y_z</code></pre><table><tr><th>k</th><th>v</th></tr>",
        "<tr><td>id</td><td>", i, '</td></tr></table><p><img src="https://img.example/', i,
        '.png" alt="pic"> <strong>bold</strong> <a href="/n/', i % 9, '">again</a></p>',
    )
    with_rich = F.replace("html", F.lit("<article>"), F.concat(F.lit("<article>"), rich))
    return pages(spark, sf_dir).select("page_id", "url", with_rich.alias("html"))


RICH_PAGES = r"""rich_pages AS (
  SELECT page_id, url, replace(html, '<article>', '<article><header><p>Site ' || page_id ||
    '</p></header><h2>Notes ' || page_id || '</h2><ul><li>one ' || page_id || '</li><li><a href="/n/' ||
    (page_id % 9) || '">two</a><ul><li>deep<li>deeper</ul></li></ul><ol start="' || (page_id % 4) ||
    '"><li>three</li><li><em>four</em></li></ol><blockquote><p>Quoted ' || page_id ||
    '</p></blockquote><pre><code>x = ' || page_id || E'
  y_z</code></pre><table><tr><th>k</th><th>v</th></tr>' ||
    '<tr><td>id</td><td>' || page_id || '</td></tr></table><p><img src="https://img.example/' || page_id ||
    '.png" alt="pic"> <strong>bold</strong> <a href="/n/' || (page_id % 9) || '">again</a></p>') AS html
  FROM pages)"""


# --- pages that have moved: page k of the site k mod 9 times, and for 8 in a circle --------


def _moves() -> Column:
    return F.floor(F.col("page_id") / 7) % 9


def moved(site: DataFrame) -> DataFrame:
    """The site's pages under the addresses they have moved to."""
    again = F.when((_moves() > 0) & (_moves() < 8), _text(F.col("url"), "/at/", _moves()))
    return site.withColumn("url", F.coalesce(again, F.col("url"))).filter(_moves() < 8)


def moves(site: DataFrame) -> DataFrame:
    """(url, to_url): the hops of each page; targets are paths."""
    path = F.concat(F.lit("/p/"), F.floor(F.col("page_id") / 7).cast("string"))
    hops = site.select(
        F.col("url").alias("start"), path.alias("path"), _moves().alias("n"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.lit(8).cast("long"))).alias("k"),
    ).filter("k <= n")
    return hops.select(
        F.when(F.col("k") == 1, F.col("start")).otherwise(_text(F.col("start"), "/at/", F.col("k") - 1)).alias("url"),
        F.when(F.col("k") == 8, F.col("path")).otherwise(_text(F.col("path"), "/at/", F.col("k"))).alias("to_url"),
    )


def _site_links(i: Column, k: Column) -> Column:
    return _text(
        '<a href="/p/', 2 * k + 1, '">l</a><a href="/p/', 2 * k + 2, '/?q=1#x">r</a>',
        '<a href="#top">t</a><a href="mailto:a@b.c">m</a><a href="/f.pdf">f</a>',
        '<a href="/p/', 2 * k + 1, '#again">l</a>',
        '<a href="https://ext', i % 5, '.example/">e</a>',
        '<a href="https://ext', i % 3, '.example/x">e</a>',
        '<a href="https://ext9.example/y">e</a><a href="ftp://s', i % 7, '.example/z">z</a>',
    )


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven hosts whose pages form a binary tree; every eleventh one is missing."""
    i = F.col("page_id")
    k = F.floor(i / 7)
    return pages(spark, sf_dir).select(
        "page_id",
        _text("https://s", i % 7, ".example/p/", k).alias("url"),
        F.concat(_site_links(i, k), F.col("html")).alias("html"),
        F.when(k % 11 == 10, 404).otherwise(200).alias("status"),
    )


_SITE_LINKS = """'<a href="/p/' || (2 * (page_id // 7) + 1) || '">l</a><a href="/p/' ||
    (2 * (page_id // 7) + 2) || '/?q=1#x">r</a>' ||
    '<a href="#top">t</a><a href="mailto:a@b.c">m</a><a href="/f.pdf">f</a>' ||
    '<a href="/p/' || (2 * (page_id // 7) + 1) || '#again">l</a>' ||
    '<a href="https://ext' || (page_id % 5) || '.example/">e</a>' ||
    '<a href="https://ext' || (page_id % 3) || '.example/x">e</a>' ||
    '<a href="https://ext9.example/y">e</a><a href="ftp://s' || (page_id % 7) ||
    '.example/z">z</a>'"""

SITE_PAGES = f"""site_pages AS (
  SELECT page_id, 'https://s' || (page_id % 7) || '.example/p/' || (page_id // 7) AS url,
    {_SITE_LINKS} || html AS html,
    CASE WHEN (page_id // 7) % 11 = 10 THEN 404 ELSE 200 END AS status
  FROM pages)"""


def mirrored_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The site with its whole pages, dates on most, and a mirror of every page beside it.

    A mirror shows the same page under another address and with another navigation.
    """
    i = F.col("page_id")
    k = F.floor(i / 7)
    day = F.lpad((i % 28 + 1).cast("string"), 2, "0")
    date = F.when(i % 5 != 0, _text('<meta name="date" content="2024-01-', day, '">')).otherwise("")
    to_mirror = _text('<a href="/m/', k, '">m</a>')
    status = F.when(k % 11 == 10, 404).otherwise(200)
    both = F.array(
        F.struct(
            i.alias("page_id"),
            _text("https://s", i % 7, ".example/p/", k).alias("url"),
            F.concat(date, F.lit("<nav>"), _site_links(i, k), to_mirror, F.lit("</nav>"), F.col("html")).alias("html"),
            status.alias("status"),
        ),
        F.struct(
            (-1 - i).alias("page_id"),
            _text("https://s", i % 7, ".example/m/", k).alias("url"),
            F.concat(date, F.lit("<nav>mirror</nav>"), F.col("html")).alias("html"),
            status.alias("status"),
        ),
    )
    return pages(spark, sf_dir).select(F.inline(both))


MIRRORED_SITE = f"""dated_pages AS (
  SELECT *, CASE WHEN page_id % 5 <> 0 THEN '<meta name="date" content="2024-01-' ||
    lpad((page_id % 28 + 1)::VARCHAR, 2, '0') || '">' ELSE '' END AS date_tag,
    CASE WHEN (page_id // 7) % 11 = 10 THEN 404 ELSE 200 END AS status
  FROM pages),
site_pages AS (
  SELECT page_id, 'https://s' || (page_id % 7) || '.example/p/' || (page_id // 7) AS url,
    date_tag || '<nav>' || {_SITE_LINKS} || '<a href="/m/' || (page_id // 7) || '">m</a></nav>' || html AS html, status
  FROM dated_pages
  UNION ALL
  SELECT -1 - page_id, 'https://s' || (page_id % 7) || '.example/m/' || (page_id // 7),
    date_tag || '<nav>mirror</nav>' || html, status
  FROM dated_pages)"""


def seeds(site: DataFrame) -> DataFrame:
    """The home page of every host."""
    return site.filter(F.col("url").endswith("/p/0")).select(
        F.col("page_id").alias("seed_id"), "url"
    )


def meta_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with dates in different places, meta tags, images and frames."""
    i = F.col("page_id")
    day = F.lpad((i % 28 + 1).cast("string"), 2, "0")
    dated = (
        F.when(i % 6 == 0, _text('<meta name="date" content="2024-01-', day, '">'))
        .when(
            i % 6 == 1,
            _text('<meta property="article:published_time" content="2024-03-', day,
                  'T23:30:00-08:00">'),
        )
        .when(i % 6 == 2, _text('<time datetime="2024-05-', day, '">x</time>'))
        .when(i % 6 == 3, _text("<p>March ", i % 28 + 1, ", 2024 on</p>"))
        .when(i % 6 == 4, _text("<p>2024-02-30, then ", i % 28 + 1, " april 2023</p>"))
        .otherwise("")
    )

    def every(n: int, rest: int, *parts: str | Column) -> Column:
        return F.when(i % n == rest, _text(*parts)).otherwise("")

    extras = F.concat(
        every(4, 0, '<meta property="og:title" content="T &amp; ', i, '">'),
        every(3, 0, '<link rel="canonical" href="https://c.example/', i, '">'),
        every(2, 0, '<img src="a.png"><IMG src="b.png">'),
        every(5, 0, '<iframe src="v"></iframe><video></video>'),
        every(7, 0, '<meta name="author" content=""><meta property="author" content="A', i, '">'),
        every(7, 1, '<meta property="article:author" content="B', i, '">'),
        every(5, 1, '<meta name="description" content="D', i, '">'),
        every(5, 2, '<meta property="og:image" content="I', i, '">'),
        every(5, 3, '<meta property="og:type" content="article">'),
        every(5, 4, '<meta property="og:site_name" content="S">'),
        F.lit('<a href="https://ext.example/a">e</a><a href="http://two.example">e</a>'),
        F.lit('<a href="https://ext.example/b">e</a><a href="tel:1">t</a>'),
    )
    return pages(spark, sf_dir).select(
        "page_id", "url", F.concat(dated, extras, F.col("html")).alias("html")
    )


META_PAGES = """meta_pages AS (
  SELECT page_id, url,
    CASE page_id % 6
      WHEN 0 THEN '<meta name="date" content="2024-01-' || day || '">'
      WHEN 1 THEN '<meta property="article:published_time" content="2024-03-' || day ||
        'T23:30:00-08:00">'
      WHEN 2 THEN '<time datetime="2024-05-' || day || '">x</time>'
      WHEN 3 THEN '<p>March ' || (page_id % 28 + 1) || ', 2024 on</p>'
      WHEN 4 THEN '<p>2024-02-30, then ' || (page_id % 28 + 1) || ' april 2023</p>'
      ELSE '' END ||
    CASE WHEN page_id % 4 = 0 THEN '<meta property="og:title" content="T &amp; ' || page_id || '">' ELSE '' END ||
    CASE WHEN page_id % 3 = 0 THEN '<link rel="canonical" href="https://c.example/' || page_id || '">' ELSE '' END ||
    CASE WHEN page_id % 2 = 0 THEN '<img src="a.png"><IMG src="b.png">' ELSE '' END ||
    CASE WHEN page_id % 5 = 0 THEN '<iframe src="v"></iframe><video></video>' ELSE '' END ||
    CASE WHEN page_id % 7 = 0 THEN '<meta name="author" content=""><meta property="author" content="A' || page_id || '">' ELSE '' END ||
    CASE WHEN page_id % 7 = 1 THEN '<meta property="article:author" content="B' || page_id || '">' ELSE '' END ||
    CASE WHEN page_id % 5 = 1 THEN '<meta name="description" content="D' || page_id || '">' ELSE '' END ||
    CASE WHEN page_id % 5 = 2 THEN '<meta property="og:image" content="I' || page_id || '">' ELSE '' END ||
    CASE WHEN page_id % 5 = 3 THEN '<meta property="og:type" content="article">' ELSE '' END ||
    CASE WHEN page_id % 5 = 4 THEN '<meta property="og:site_name" content="S">' ELSE '' END ||
    '<a href="https://ext.example/a">e</a><a href="http://two.example">e</a>' ||
    '<a href="https://ext.example/b">e</a><a href="tel:1">t</a>' || html AS html
  FROM (SELECT *, lpad((page_id % 28 + 1)::VARCHAR, 2, '0') AS day FROM pages))"""


def md_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dressed up as converted markdown."""
    i = F.col("doc_id")
    image = F.floor(i / 4)
    return documents(spark, sf_dir).select(
        "doc_id",
        _text("https://d.example/", i % 3, "/doc-", i, "?v=1").alias("url"),
        _text(
            "##\nBig\nfat title\n", F.col("text"), "\n\n\n\n\n\nSee [a", i,
            "](https://x.example/", i % 5, ") and [b](https://y.example/d) ![i](https://img.example/",
            image, ".jpg) [s](#h) ![](e.png) [](https://z.example)[](https://x.example/", i % 5,
            ") [![n](https://img.example/", image + 1, ".jpg)](https://n.example) ![r](local.png)  \n"
            "[c](https://x.example/", i % 5, ")  \n\n",
        ).alias("markdown"),
    )


MD_DOCS = r"""md_docs AS (
  SELECT doc_id, 'https://d.example/' || (doc_id % 3) || '/doc-' || doc_id || '?v=1' AS url,
    E'##\nBig\nfat title\n' || text || E'\n\n\n\n\n\nSee [a' || doc_id ||
    '](https://x.example/' || (doc_id % 5) || ') and [b](https://y.example/d) ![i](https://img.example/' ||
    (doc_id // 4) || '.jpg) [s](#h) ![](e.png) [](https://z.example)[](https://x.example/' || (doc_id % 5) ||
    ') [![n](https://img.example/' || (doc_id // 4 + 1) || E'.jpg)](https://n.example) ![r](local.png)  \n' ||
    '[c](https://x.example/' || (doc_id % 5) || E')  \n\n' AS markdown
  FROM documents)"""


def image_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored payload for every document, a third of them no images."""
    i = F.col("doc_id")
    return documents(spark, sf_dir).select(
        _text("https://img.example/", i, ".jpg").alias("url"),
        F.when(i % 3 == 0, "image/png")
        .when(i % 3 == 1, "text/html")
        .otherwise("application/octet-stream")
        .alias("content_type"),
        F.encode("text", "UTF-8").alias("bytes"),
    )


IMAGE_ASSETS = """image_assets AS (
  SELECT 'https://img.example/' || doc_id || '.jpg' AS url,
    CASE doc_id % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'text/html'
      ELSE 'application/octet-stream' END AS content_type,
    encode(text) AS bytes
  FROM documents)"""
