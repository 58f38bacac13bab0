"""Images referenced in markdown, joined to a table of stored payloads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import images


def image_refs(docs: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, pos, url) of each page's distinct web images, by first appearance."""
    distinct = F.array_distinct(images.image_urls(F.col("markdown")))
    return docs.select(key, F.posexplode(distinct).alias("pos", "url"))


# References to one URL that share a copy of its payload in the join.
REFS_PER_SALT = 1000


def usable_assets(assets: DataFrame, max_bytes: int = images.MAX_IMAGE_BYTES) -> DataFrame:
    """Payloads that are images and within the size limit."""
    return assets.filter(images.is_usable_image(F.col("content_type"), F.col("bytes"), max_bytes))


def rejected_assets(assets: DataFrame, max_bytes: int = images.MAX_IMAGE_BYTES) -> DataFrame:
    """(url, content_type, size, reason) of the payloads ``usable_assets`` leaves out."""
    usable = images.is_usable_image(F.col("content_type"), F.col("bytes"), max_bytes)
    size = F.octet_length("bytes")
    reason = F.when(F.col("bytes").isNull(), "empty").when(size > max_bytes, "size")
    return assets.filter(~F.coalesce(usable, F.lit(False))).select(
        "url", "content_type", size.alias("size"), reason.otherwise("type").alias("reason")
    )


def join_payloads(refs: DataFrame, payloads: DataFrame, key: str = "page_id") -> DataFrame:
    """``refs`` (key, pos, url) with the columns of ``payloads`` of that url.

    References to a URL are counted, and a URL that many pages share is spread over as
    many salts as it has thousands of references, on both sides of the join.
    """
    salts = refs.groupBy("url").agg(
        F.ceil(F.count("*") / REFS_PER_SALT).cast("int").alias("_salts")
    )
    every = F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))
    copies = payloads.join(salts, "url").withColumn("_salt", every).drop("_salts")
    salted = refs.join(salts, "url").withColumn(
        "_salt", F.pmod(F.xxhash64(key), F.col("_salts")).cast("int")
    )
    return salted.drop("_salts").join(copies, ["url", "_salt"]).drop("_salt")


def embed_images(
    docs: DataFrame,
    assets: DataFrame,
    key: str = "page_id",
    columns: tuple[str, ...] = ("markdown",),
    on_used: Callable[[DataFrame], DataFrame] = lambda used: used,
) -> DataFrame:
    """Image URLs replaced by data URIs in ``columns``; unknown images stay links.

    Payloads are encoded once and joined by ``join_payloads``. ``on_used`` may watch the images
    in use (url, size, data_uri), each once.
    """
    refs = image_refs(docs, key)
    encoded = usable_assets(assets).select(
        "url",
        F.octet_length("bytes").alias("size"),
        images.data_uri(F.col("content_type"), F.col("bytes")).alias("data_uri"),
    )
    used = on_used(encoded.join(refs.select("url").distinct(), "url", "left_semi"))
    entries = (
        join_payloads(refs, used.drop("size"), key)
        .select(key, F.struct("pos", "url", "data_uri").alias("entry"))
        .groupBy(key)
        .agg(F.array_sort(F.collect_list("entry")).alias("_entries"))
    )
    joined = docs.join(entries, key, "left")
    embedded = {
        c: F.when(F.col("_entries").isNull(), F.col(c)).otherwise(
            images.embed_images(F.col(c), F.col("_entries"))
        )
        for c in columns
    }
    return joined.withColumns(embedded).drop("_entries")


def image_manifest(
    docs: DataFrame, assets: DataFrame, existing: DataFrame | None = None, key: str = "page_id"
) -> DataFrame:
    """(url, file_key, size, is_new) of the images to keep locally.

    URLs listed in ``existing`` (url, file_key, size) are taken from there and their
    payload is not looked up again.
    """
    wanted = image_refs(docs, key).select("url").distinct()
    known = None
    if existing is not None:
        known = existing.join(wanted, "url", "left_semi").select(
            "url", "file_key", "size", F.lit(False).alias("is_new")
        )
        wanted = wanted.join(existing, "url", "left_anti")
    fetched = wanted.join(usable_assets(assets), "url").select(
        "url",
        images.image_file_key(F.col("url")).alias("file_key"),
        F.octet_length("bytes").cast("bigint").alias("size"),
        F.lit(True).alias("is_new"),
    )
    return fetched if known is None else known.unionByName(fetched)


def image_totals(manifest: DataFrame) -> DataFrame:
    return manifest.agg(
        F.count("*").alias("images"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")
    )
