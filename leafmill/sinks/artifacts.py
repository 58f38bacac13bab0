"""Writers. Every one is a distributed table write; nothing passes the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import urls

# --- fixed values: artefact names, in the order they are listed ----------------
ARTIFACTS = ("article.md", "references.md", "screenshot.png", "article.pdf", "metadata.json")
# ------------------------------------------------------------------------------

# Folders of a written table, whatever the number of pages and hosts.
BUCKETS = 256


def with_unique_slug(pages: DataFrame, filename: str | None = None) -> DataFrame:
    """Adds ``slug``; pages that would share one get the md5 of their URL as suffix.

    ``filename`` takes the place of the slug that is made of the URL.

    Slugs drop the query and are cut, so clashes are real. They are counted with a
    map-side combine and only the clashing slugs are joined back.
    """
    own = urls.slug(F.col("url")) if filename is None else F.lit(filename)
    named = pages.withColumn("slug", own)
    clashes = (
        named.groupBy("slug")
        .agg(F.count("*").alias("_n"))
        .filter(F.col("_n") > 1)
        .select("slug", F.lit(True).alias("_clash"))
    )
    suffix = F.md5(F.col("url"))
    return (
        named.join(clashes, "slug", "left")
        .withColumn(
            "slug",
            F.when(F.col("_clash"), F.concat_ws("_", "slug", suffix)).otherwise(F.col("slug")),
        )
        .drop("_clash")
    )


def write_table(df: DataFrame, path: str, *partition_by: str, mode: str = "overwrite") -> None:
    """Parquet, one folder per partition value.

    The rebalance hint lets adaptive execution merge small and split large partitions,
    so a host with a third of all pages gives many files instead of one huge task.
    """
    out = df.hint("rebalance", *partition_by) if partition_by else df.hint("rebalance")
    out.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_markdown(docs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Markdown table (slug, url, markdown, netloc) in a fixed number of host buckets.

    Rows of a file are sorted by host, so a reader that wants one host skips the rest.
    """
    hosts = docs.withColumn("netloc", urls.netloc(F.col("url")))
    _write_buckets(hosts, path, "netloc", mode)


def markdown_files(docs: DataFrame) -> DataFrame:
    """(name, content): ``{slug}.md`` and, where there are references, ``{slug}_refs.md``."""
    files = F.array(
        F.struct(F.concat(F.col("slug"), F.lit(".md")).alias("name"), F.col("markdown").alias("content")),
        F.struct(
            F.concat(F.col("slug"), F.lit("_refs.md")).alias("name"),
            F.nullif(F.col("references"), F.lit("")).alias("content"),
        ),
    )
    return docs.select(F.inline(F.filter(files, lambda f: f["content"].isNotNull())))


def metadata_name() -> Column:
    return F.concat(F.col("slug"), F.lit("_meta.json"))


def metadata_files(records: DataFrame) -> DataFrame:
    """(name, content): ``{slug}_meta.json``."""
    return records.select(metadata_name().alias("name"), F.col("json").alias("content"))


def write_text_files(files: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Table (name, content) in a fixed number of buckets, sorted by name in each file."""
    _write_buckets(files.select("name", "content"), path, "name", mode)


def _write_buckets(df: DataFrame, path: str, key: str, mode: str) -> None:
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
    placed = df.withColumn("bucket", bucket).hint("rebalance", "bucket")
    placed.sortWithinPartitions("bucket", key).write.mode(mode).partitionBy("bucket").parquet(path)


def archive_artifacts(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(slug, <keep>, artifact, ord, text, bytes): one row per artefact a page has.

    ``pages``: slug, markdown, references, screenshot, pdf, json. The markdown is
    always there; the rest only if it is neither null nor empty. Images and PDF bytes
    pass through unchanged.
    """
    no_text, no_bytes = F.lit(None).cast("string"), F.lit(None).cast("binary")

    def row(i: int, text: Column, payload: Column, present: Column) -> Column:
        return F.struct(
            F.lit(ARTIFACTS[i]).alias("artifact"),
            F.lit(i).alias("ord"),
            text.alias("text"),
            payload.alias("bytes"),
            present.alias("present"),
        )

    def filled(c: str) -> Column:
        return F.coalesce(F.octet_length(c) > 0, F.lit(False))

    rows = F.array(
        row(0, F.coalesce("markdown", F.lit("")), no_bytes, F.lit(True)),
        row(1, F.col("references"), no_bytes, filled("references")),
        row(2, no_text, F.col("screenshot"), filled("screenshot")),
        row(3, no_text, F.col("pdf"), filled("pdf")),
        row(4, F.col("json"), no_bytes, filled("json")),
    )
    return pages.select("slug", *keep, F.inline(F.filter(rows, lambda r: r["present"]))).drop("present")


def archive_files(artifacts: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(<keep>, name, content) of archive rows: a folder per page, ``{slug}/article.md`` and so on."""
    return artifacts.select(
        *keep,
        F.concat_ws("/", "slug", "artifact").alias("name"),
        F.coalesce(F.encode("text", "UTF-8"), F.col("bytes")).alias("content"),
    )


def archive_manifest(artifacts: DataFrame) -> DataFrame:
    """(slug, files): artefact names of each page in their fixed order."""
    listed = artifacts.groupBy("slug").agg(
        F.array_sort(F.collect_list(F.struct("ord", "artifact"))).alias("files")
    )
    return listed.select("slug", F.transform("files", lambda f: f["artifact"]).alias("files"))


def write_archive(artifacts: DataFrame, path: str, mode: str = "overwrite") -> None:
    write_table(artifacts.drop("ord"), path, "artifact", mode=mode)


def payload_files(
    pages: DataFrame, column: str, extension: str, keep: tuple[str, ...] = ()
) -> DataFrame:
    """(<keep>, name, bytes) of the pages that have a screenshot or PDF."""
    return pages.filter(F.octet_length(column) > 0).select(
        *keep, F.concat(F.col("slug"), F.lit(extension)).alias("name"), F.col(column).alias("bytes")
    )


