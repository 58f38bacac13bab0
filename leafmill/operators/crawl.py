"""Breadth-first crawl over a table of stored pages, many seeds at once.

The driver loops over levels (ten at most); every level is a handful of joins on
well-spread keys. Nothing is ever grouped by seed alone, as one seed may own most of
the rows: discovery groups by (seed, URL) and ranking by (seed, block of parents).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.functions import urls
from leafmill.operators.links import extract_links
from leafmill.operators.redirects import without_fragment
from leafmill.session import Buckets, cut_lineage

# --- fixed values -----------------------------------------------------------
DEFAULT_DEPTH, MAX_DEPTH = 1, 10
DEFAULT_MAX_PAGES = 10
FIRST_ERROR_STATUS = 400
# ----------------------------------------------------------------------------

# Rows of this many parents are ranked in one window group.
_PARENTS_PER_GROUP = 1024


def page_index(pages: DataFrame) -> DataFrame:
    """(page_id, url, norm_url, status) without the html; status 200 if not stored."""
    status = F.col("status") if "status" in pages.columns else F.lit(200)
    return pages.select(
        "page_id", "url", urls.normalise(F.col("url")).alias("norm_url"), status.alias("status")
    )


def lookup_tables(
    index: DataFrame, redirects: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Stored page per exact URL and per page identity.

    Several stored pages may share a key; the lowest page_id stands for them. The
    minimum is combined map-side, so a key that many pages share does no harm.
    ``redirects`` (url, final_url) adds the pages that requests for other addresses end at;
    an address under which a page is stored needs none.
    """
    page = F.struct("page_id", "url", "status")
    exact = index.groupBy(F.col("url").alias("_url")).agg(F.min(page).alias("_exact"))
    similar = index.groupBy(F.col("norm_url").alias("_norm")).agg(F.min(page).alias("_similar"))
    if redirects is None:
        return exact, similar
    sent = redirects.filter("final_url is not null").select(
        "url", F.col("final_url"), urls.normalise(F.col("final_url")).alias("final_norm")
    )
    ends = look_up(sent, (exact, similar), "final_url", "final_norm")
    ends = ends.filter(F.col("page").isNotNull()).select(
        "url", urls.normalise(F.col("url")).alias("norm_url"), "page"
    )

    def extended(own: DataFrame, key: str, value: str, name: str) -> DataFrame:
        added = ends.groupBy(F.col(name).alias(key)).agg(F.min("page").alias(value))
        return own.unionByName(added.join(own.select(key), key, "left_anti"))

    return extended(exact, "_url", "_exact", "url"), extended(similar, "_norm", "_similar", "norm_url")


def look_up(
    wanted: DataFrame, tables: tuple[DataFrame, DataFrame], url: str, norm_url: str
) -> DataFrame:
    """Adds ``page``: the stored page of that exact URL, else of that identity.

    The fragment of a URL is never sent and plays no part.
    """
    exact, similar = tables
    return (
        wanted.withColumn("_sent", without_fragment(F.col(url)))
        .join(exact, F.col("_sent") == F.col("_url"), "left")
        .join(similar, F.col(norm_url) == F.col("_norm"), "left")
        .withColumn("page", F.coalesce("_exact", "_similar"))
        .drop("_sent", "_url", "_exact", "_norm", "_similar")
    )


def rank_level(found: DataFrame, frontier: DataFrame, max_pages: int | None) -> DataFrame:
    """Crawl rank by (parent's rank, link position), continuing after the frontier.

    Rows are numbered inside blocks of parents and shifted by the running size of the
    blocks before, so even a seed that owns most rows is spread over many groups.
    """
    blocks = found.withColumn("_block", F.floor(F.col("parent_rank") / _PARENTS_PER_GROUP))
    sizes = blocks.groupBy("seed_id", "_block").agg(F.count("*").alias("_size"))
    reached = frontier.groupBy("seed_id").agg(F.max("crawl_rank").alias("_reached"))
    earlier = (
        W.partitionBy("seed_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    )
    offsets = (
        sizes.join(reached, "seed_id")
        .withColumn(
            "_offset", F.col("_reached") + F.coalesce(F.sum("_size").over(earlier), F.lit(0))
        )
        .filter(F.lit(True) if max_pages is None else F.col("_offset") < max_pages)
        .select("seed_id", "_block", "_offset")
    )
    within = W.partitionBy("seed_id", "_block").orderBy("parent_rank", "pos")
    ranked = blocks.join(offsets, ["seed_id", "_block"]).withColumn(
        "crawl_rank", F.col("_offset") + F.row_number().over(within)
    )
    if max_pages is not None:
        ranked = ranked.filter(F.col("crawl_rank") <= max_pages)
    return ranked.drop("_block", "_offset")


def missing_seeds(
    pages: DataFrame, seeds: DataFrame, redirects: DataFrame | None = None
) -> DataFrame:
    """Seeds (seed_id, url) of which no page is stored; a crawl cannot start there."""
    wanted = seeds.select(
        "seed_id", F.col("url").alias("seed_url"), urls.normalise(F.col("url")).alias("norm_url")
    )
    tables = lookup_tables(page_index(pages), redirects)
    found = look_up(wanted, tables, "seed_url", "norm_url")
    return found.filter(F.col("page").isNull()).select("seed_id", F.col("seed_url").alias("url"))


def deep_crawl(
    pages: DataFrame,
    seeds: DataFrame,
    max_pages: int | None = DEFAULT_MAX_PAGES,
    depth: int = DEFAULT_DEPTH,
    url_pattern: str | None = None,
    redirects: DataFrame | None = None,
) -> DataFrame:
    """(seed_id, crawl_rank, level, parent_url, requested_url, url, norm_url, page_id) per visit.

    ``requested_url`` is the address of the link (or seed), ``norm_url`` its identity, ``url`` that
    of the page that came back.

    ``pages``: page_id, url, html and optionally status. ``seeds``: seed_id, url. A
    crawl stays on its seed's host. The seed is kept whatever its status; a URL that
    is not stored or answered with an error stays visited and is not entered. The
    pattern filters discovered URLs, never the seed. ``max_pages=None`` sets no limit.
    Seeds without a stored page give no row; ``missing_seeds`` lists them. ``redirects`` (url,
    final_url, as ``resolve_redirects`` gives them) lead requests to stored pages of other
    addresses, also on other hosts; a page that two addresses lead to is visited under both.
    The host that a crawl stays on, that is asks for pages of, is the one in its seed's address.
    """
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be between 1 and {MAX_DEPTH}")
    if max_pages is not None and max_pages < 1:
        raise ValueError("max_pages must be at least 1")

    # Links are taken from the pages in the scan, where the html ends; only narrow rows
    # meet the seeds' hosts, and the edges are exchanged once, by the page they start from.
    hosts = seeds.select(urls.netloc(F.col("url")).alias("host")).distinct()
    held = hosts
    if redirects is not None:
        asked = redirects.withColumn("host", urls.netloc(F.col("url")))
        redirects = asked.join(hosts, "host", "left_semi").drop("host")
        held = hosts.union(redirects.select(urls.netloc(F.col("final_url")))).distinct()
    index = page_index(pages).withColumn("host", urls.netloc(F.col("url")))
    exact, similar = lookup_tables(index.join(held, "host", "left_semi"), redirects)
    # A page that a redirect led to may lie on another host and link back.
    edges = extract_links(pages, url_pattern=url_pattern, any_host=redirects is not None).select(
        "page_id", "pos", "abs_url", "norm_url", urls.netloc(F.col("abs_url")).alias("host")
    )
    # Every level joins these: they are hashed once and stay where they lie.
    with Buckets(pages.sparkSession) as store:
        tables = store.table(exact, "exact", "_url"), store.table(similar, "similar", "_norm")
        links = store.table(edges.join(hosts, "host", "left_semi"), "links", "page_id", "host")
        return _levels(seeds, tables, links, max_pages, depth)


def _levels(
    seeds: DataFrame,
    tables: tuple[DataFrame, DataFrame],
    links: DataFrame,
    max_pages: int | None,
    depth: int,
) -> DataFrame:
    """The visits of all levels; each level is written down before the next."""
    start = seeds.select(
        "seed_id",
        "url",
        urls.normalise(F.col("url")).alias("norm_url"),
        urls.netloc(F.col("url")).alias("host"),
    )
    frontier = cut_lineage(
        look_up(start.withColumnRenamed("url", "seed_url"), tables, "seed_url", "norm_url")
        .filter(F.col("page").isNotNull())
        .select(
            "seed_id",
            F.lit(1).cast("bigint").alias("crawl_rank"),
            F.lit(0).alias("level"),
            F.lit(None).cast("string").alias("parent_url"),
            F.col("seed_url").alias("requested_url"),
            F.col("page.url").alias("url"),
            "norm_url",
            F.col("page.page_id").alias("page_id"),
            "host",
        )
    )
    visited = frontier.select("seed_id", "norm_url")
    result = frontier
    for level in range(1, depth + 1):
        discovered = (
            frontier.select(
                "seed_id", "page_id", F.col("crawl_rank").alias("parent_rank"),
                F.col("url").alias("parent_url"), "host",
            )
            .join(links, ["page_id", "host"])
            .groupBy("seed_id", "norm_url")
            .agg(F.min(F.struct("parent_rank", "pos", "abs_url", "parent_url", "host")).alias("first"))
            .join(visited, ["seed_id", "norm_url"], "left_anti")
            .select("seed_id", "norm_url", "first.*")
        )
        # Failed look-ups stay in: their URL counts as visited.
        tried = cut_lineage(look_up(discovered, tables, "abs_url", "norm_url"))
        visited = visited.unionByName(tried.select("seed_id", "norm_url"))
        found = tried.filter(F.col("page.status") < FIRST_ERROR_STATUS)
        frontier = cut_lineage(
            rank_level(found, frontier, max_pages).select(
                "seed_id",
                "crawl_rank",
                F.lit(level).alias("level"),
                "parent_url",
                F.col("abs_url").alias("requested_url"),
                F.col("page.url").alias("url"),
                "norm_url",
                F.col("page.page_id").alias("page_id"),
                "host",
            )
        )
        if frontier.isEmpty():
            break
        result = result.unionByName(frontier)
    return result.drop("host")
