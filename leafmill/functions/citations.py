"""Inline links to numbered citations, without leaving the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.text import interleave, is_blank, let

# --- fixed values -----------------------------------------------------------
LINK = r"(?<!!)\[([^\]]*)\]\(([^)]+)\)"
REFERENCES_TITLE = "## References"
# ----------------------------------------------------------------------------


def link_urls(markdown: Column) -> Column:
    """URLs of all links in document order, in-page anchors left out."""
    return F.filter(
        F.regexp_extract_all(markdown, F.lit(LINK), F.lit(2)),
        lambda u: ~u.startswith("#"),
    )


def cited_urls(markdown: Column) -> Column:
    """Distinct link URLs; the position is the citation number."""
    return F.array_distinct(link_urls(markdown))


def _binary_search(ordered: Column, url: Column) -> Column:
    """Number paired with ``url`` in an array of (url, number) sorted by url."""
    start = F.struct(F.lit(0).alias("lo"), F.size(ordered).alias("hi"))

    def step(range_: Column, _: Column) -> Column:
        mid = F.floor((range_["lo"] + range_["hi"]) / 2).cast("int")
        below = F.get(ordered, mid)["url"] < url
        return (
            F.when(range_["lo"] >= range_["hi"], range_)
            .when(below, F.struct((mid + 1).alias("lo"), range_["hi"].alias("hi")))
            .otherwise(F.struct(range_["lo"].alias("lo"), mid.alias("hi")))
        )

    found = F.aggregate(F.sequence(F.lit(1), F.lit(31)), start, step)
    return F.get(ordered, found["lo"])["n"]


def _cite(markdown: Column, number_of) -> Column:
    def render(match: Column) -> Column:
        text = F.regexp_extract(match, LINK, 1)
        url = F.regexp_extract(match, LINK, 2)
        mark = F.concat(F.lit("["), number_of(url).cast("string"), F.lit("]"))
        return (
            F.when(url.startswith("#"), match)
            .when(is_blank(text), mark)
            .otherwise(F.concat(text, F.lit(" "), mark))
        )

    return interleave(markdown, LINK, render)


def cite(markdown: Column, urls: Column) -> Column:
    """Text with every link replaced by its citation number in ``urls``.

    The numbers are sorted by URL once and found by halving, n log n for every page.
    """
    ordered = F.array_sort(
        F.transform(urls, lambda u, i: F.struct(u.alias("url"), (i + 1).alias("n")))
    )
    searched = let(
        ordered, lambda o: _cite(markdown, lambda u: _binary_search(o, u))
    )
    return F.when(F.size(urls) == 0, markdown).otherwise(searched)


def references(urls: Column) -> Column:
    """References block, '' when there are no links."""
    lines = F.transform(
        urls, lambda u, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), u)
    )
    return F.when(F.size(urls) == 0, "").otherwise(
        F.concat(F.lit(f"\n{REFERENCES_TITLE}\n\n"), F.array_join(lines, "\n"))
    )


def add_citations(markdown: Column) -> Column:
    """Struct of cited text, references block and the numbered URLs."""
    text = F.coalesce(markdown, F.lit(""))
    return let(
        cited_urls(text),
        lambda urls: F.struct(
            cite(text, urls).alias("markdown"),
            references(urls).alias("references"),
            urls.alias("urls"),
        ),
    )


def with_references(markdown: Column, refs: Column) -> Column:
    """One text for output without files."""
    return F.when(refs != "", F.concat(markdown, F.lit("\n"), refs)).otherwise(markdown)
