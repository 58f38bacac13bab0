"""Same-site page links, in document order and without repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import markup, urls
from leafmill.functions.text import let


def page_hrefs(html: Column) -> Column:
    """array<struct<pos, href>> of all anchors that have an href."""
    anchors = F.transform(
        markup.open_tags(html, "a"), lambda t: markup.attribute(t, "href")
    )
    return F.transform(
        F.filter(anchors, lambda h: h.isNotNull()),
        lambda h, i: F.struct(i.alias("pos"), h.alias("href")),
    )


def page_links(
    html: Column, url: Column, base_domain: Column | None, url_pattern: str | None = None
) -> Column:
    """array<struct<pos, href, abs_url, norm_url>> of the links a crawl may follow.

    ``base_domain`` None takes links to any host.

    The cheap prefix test runs before URL resolution. Repeats are found by sorting
    on the normalised URL, so a page with many links costs n log n and the whole
    job stays map-only.
    """
    followable = F.filter(page_hrefs(html), lambda a: urls.is_followable_href(a["href"]))
    absolute = F.transform(
        followable,
        lambda a: F.struct(
            a["pos"].alias("pos"),
            a["href"].alias("href"),
            urls.resolve(url, a["href"]).alias("abs_url"),
        ),
    )
    on_site = F.filter(
        absolute,
        lambda a: (F.lit(True) if base_domain is None else urls.netloc(a["abs_url"]) == base_domain)
        & urls.is_page_scheme(a["abs_url"])
        & urls.is_page_path(a["abs_url"]),
    )
    keyed = F.array_sort(
        F.transform(
            on_site,
            lambda a: F.struct(
                urls.normalise(a["abs_url"]).alias("norm_url"),
                a["pos"].alias("pos"),
                a["href"].alias("href"),
                a["abs_url"].alias("abs_url"),
            ),
        )
    )
    first_seen = let(
        keyed,
        lambda s: F.filter(
            s, lambda a, i: (i == 0) | (F.get(s, i - 1)["norm_url"] != a["norm_url"])
        ),
    )
    in_order = F.array_sort(
        F.transform(
            first_seen,
            lambda a: F.struct(
                a["pos"].alias("pos"),
                a["href"].alias("href"),
                a["abs_url"].alias("abs_url"),
                a["norm_url"].alias("norm_url"),
            ),
        )
    )
    if url_pattern is None:
        return in_order
    return F.filter(in_order, lambda a: urls.matches_glob(a["abs_url"], url_pattern))


def extract_links(
    pages: DataFrame,
    base_domain: Column | None = None,
    url_pattern: str | None = None,
    key: str = "page_id",
    any_host: bool = False,
) -> DataFrame:
    """One row per distinct same-site link: (key, pos, href, abs_url, norm_url)."""
    domain = urls.netloc(F.col("url")) if base_domain is None else base_domain
    if any_host:
        domain = None
    links = page_links(F.col("html"), F.col("url"), domain, url_pattern)
    return pages.select(key, F.inline(links))


def all_links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Every anchor with its raw target: (key, url, pos, href, netloc)."""
    rows = pages.select(key, "url", F.inline(page_hrefs(F.col("html"))))
    return rows.withColumn("netloc", urls.netloc(F.col("href")))
