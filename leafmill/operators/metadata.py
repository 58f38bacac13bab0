"""One metadata record per page, computed without a shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import dates, markup, urls
from leafmill.functions.text import first_of, let, non_empty, word_count

# --- fixed values -----------------------------------------------------------
WORDS_PER_MINUTE = 238
TOP_DOMAINS = 10
FIELDS = (
    "url", "title", "description", "author", "published_date", "word_count",
    "reading_time_minutes", "internal_link_count", "external_link_count",
    "top_external_domains", "image_count", "video_count", "canonical_url",
    "og_image", "og_type", "og_site_name",
)
# ----------------------------------------------------------------------------


# Lookups a record needs, resolved together so that the plan holds one expression.
_KEYS = (
    "og:title", "og:description", "description", "author", "article:author",
    "og:image", "og:type", "og:site_name", *dates.DATE_META_KEYS,
)


def meta_entries(tags: Column) -> Column:
    """array<struct<name, property, content>> of the meta tags."""
    return F.transform(
        markup.named(tags, "meta"),
        lambda t: F.struct(
            markup.attribute(t, "name").alias("name"),
            markup.attribute(t, "property").alias("property"),
            markup.attribute(t, "content").alias("content"),
        ),
    )


def meta_values(entries: Column, keys: Sequence[str]) -> Column:
    """Per key: content of the first tag with that name, else with that property.

    Only the first tag of each kind counts; an empty content is as good as none.
    """

    def first(field: str, key: Column) -> Column:
        return markup.first_value(F.filter(entries, lambda m: m[field] == key))["content"]

    return F.transform(
        F.array(*[F.lit(k) for k in keys]),
        lambda k: F.coalesce(non_empty(first("name", k)), non_empty(first("property", k))),
    )


def canonical_href(tags: Column) -> Column:
    """href of the first link tag whose rel list holds 'canonical'."""
    found = F.filter(
        markup.named(tags, "link"),
        lambda t: markup.attribute(t, "rel").rlike(r"(?:^|\s)canonical(?:\s|$)"),
    )
    return F.coalesce(markup.attribute(markup.first_value(found), "href"), F.lit(""))


def first_time(tags: Column) -> Column:
    """datetime of the first time tag that has one."""
    values = F.transform(
        markup.named(tags, "time"), lambda t: markup.attribute(t, "datetime")
    )
    return markup.first_value(F.filter(values, lambda v: v.isNotNull()))


def publication_date(meta_dates: Column, time: Column, text: Column) -> Column:
    """First metadata value that parses, then the time tag, then the leading text."""
    given = F.filter(F.array_append(meta_dates, time), lambda v: v.isNotNull())
    candidates = F.transform(given, dates.meta_date)
    return F.coalesce(
        markup.first_value(F.filter(candidates, lambda d: d.isNotNull())),
        dates.date_in_text(F.left(text, F.lit(dates.TEXT_PREFIX))),
    )


def reading_time(words: Column) -> Column:
    """Whole minutes, halves to even, at least one."""
    return F.greatest(F.lit(1), F.bround(words / F.lit(float(WORDS_PER_MINUTE)))).cast("bigint")


def top_values(values: Column, k: int) -> Column:
    """The k most frequent values, ties by first appearance.

    Sorting puts equal values side by side; a run's length is the distance to the
    next run's start. n log n for any number of distinct values.
    """
    ordered = F.array_sort(
        F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("pos")))
    )

    def count(s: Column) -> Column:
        placed = F.transform(
            s, lambda x, i: F.struct(x["v"].alias("v"), x["pos"].alias("pos"), i.alias("at"))
        )
        starts = F.filter(
            placed, lambda x: (x["at"] == 0) | (F.get(s, x["at"] - 1)["v"] != x["v"])
        )
        runs = let(
            starts,
            lambda st: F.zip_with(
                st,
                F.slice(st, F.lit(2), F.size(st)),
                lambda a, b: F.struct(
                    (a["at"] - F.coalesce(b["at"], F.size(s))).alias("less"),
                    a["pos"].alias("pos"),
                    a["v"].alias("v"),
                ),
            ),
        )
        return F.transform(F.slice(F.array_sort(runs), 1, k), lambda r: r["v"])

    return let(ordered, count)


def scan_pages(pages: DataFrame, key: str = "page_id", keep: Sequence[str] = ()) -> DataFrame:
    """Per page: the tags of interest, meta values, link hosts and visible text, and ``keep``.

    Kept as separate projections: each array is computed once per row and then
    referenced many times. The html is read twice, once for tags, once for text.
    """
    html = F.col("html")
    tags = pages.select(
        key,
        "url",
        *keep,
        markup.open_tags(
            html, "a", "meta", "link", "time", "img", "video", "iframe", with_title=True
        ).alias("tags"),
        markup.visible_text(html).alias("text"),
    )
    return tags.select(
        "*",
        meta_values(meta_entries(F.col("tags")), _KEYS).alias("meta"),
        F.transform(
            F.filter(
                F.transform(
                    markup.named(F.col("tags"), "a"), lambda a: markup.attribute(a, "href")
                ),
                urls.is_followable_href,
            ),
            urls.netloc,
        ).alias("netlocs"),
        urls.netloc(F.col("url")).alias("page_netloc"),
        word_count(F.col("text")).alias("word_count"),
    )


def _meta(key: str) -> Column:
    return F.get(F.col("meta"), F.lit(_KEYS.index(key)))


def _published() -> Column:
    first = _KEYS.index(dates.DATE_META_KEYS[0])
    return publication_date(
        F.slice("meta", first + 1, len(dates.DATE_META_KEYS)),
        first_time(F.col("tags")),
        F.col("text"),
    )


def with_publication_date(
    pages: DataFrame, key: str = "page_id", keep: Sequence[str] = ()
) -> DataFrame:
    """(key, url, published_date, <keep>) only; the rest of the record is not computed."""
    scanned = scan_pages(pages, key, keep)
    return scanned.select(key, "url", _published().alias("published_date"), *keep)


def extract_metadata(
    pages: DataFrame, key: str = "page_id", keep: Sequence[str] = ()
) -> DataFrame:
    """The page key, the 16 metadata fields, and the columns named in ``keep``."""
    s = scan_pages(pages, key, keep).withColumn(
        "external",
        F.filter("netlocs", lambda n: (n != "") & (n != F.col("page_netloc"))),
    )
    tags = F.col("tags")
    external = F.size("external").cast("bigint")
    return s.select(
        key,
        "url",
        first_of(_meta("og:title"), markup.title_text(tags)).alias("title"),
        first_of(_meta("og:description"), _meta("description")).alias("description"),
        first_of(_meta("author"), _meta("article:author")).alias("author"),
        _published().alias("published_date"),
        "word_count",
        reading_time(F.col("word_count")).alias("reading_time_minutes"),
        (F.size("netlocs") - F.size("external")).cast("bigint").alias("internal_link_count"),
        external.alias("external_link_count"),
        top_values(F.col("external"), TOP_DOMAINS).alias("top_external_domains"),
        F.size(markup.named(tags, "img")).cast("bigint").alias("image_count"),
        F.size(markup.named(tags, "video", "iframe")).cast("bigint").alias("video_count"),
        canonical_href(tags).alias("canonical_url"),
        first_of(_meta("og:image")).alias("og_image"),
        first_of(_meta("og:type")).alias("og_type"),
        first_of(_meta("og:site_name")).alias("og_site_name"),
        *keep,
    )


def _json_value(value: Column) -> Column:
    boxed = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return F.substr(boxed, F.lit(2), F.length(boxed) - 2)


def metadata_json(record: DataFrame) -> Column:
    """The record as JSON with two-space indent, nulls kept, field order fixed."""
    domains = F.when(F.size("top_external_domains") == 0, "[]").otherwise(
        F.concat(
            F.lit("[\n    "),
            F.array_join(F.transform("top_external_domains", _json_value), ",\n    "),
            F.lit("\n  ]"),
        )
    )
    lines = [
        F.concat(
            F.lit(f'  "{f}": '),
            domains if f == "top_external_domains" else _json_value(record[f]),
        )
        for f in FIELDS
    ]
    return F.concat(F.lit("{\n"), F.concat_ws(",\n", *lines), F.lit("\n}"))
