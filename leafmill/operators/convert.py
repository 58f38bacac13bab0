"""Pages to markdown: one shuffle on the page key, the rest is local to a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import inline
from leafmill.functions.grid import span_grid
from leafmill.functions.markdown import tidy_output
from leafmill.functions.text import let
from leafmill.operators import blocks as b
from leafmill.operators.content import (
    TEXT_SUMS,
    content_flags,
    mark_main_content,
    with_text_sums,
)
from leafmill.operators.selector import select_elements


def _lines(text: Column, prefix: Column) -> Column:
    """Every line but the first starts with ``prefix``."""
    return F.when(
        F.contains(text, F.lit("\n")) & (prefix != ""),
        F.replace(text, F.lit("\n"), F.concat(F.lit("\n"), prefix)),
    ).otherwise(text)


def _piece() -> Column:
    """What the page text needs to know of one block."""
    in_list = F.col("list_depth") > 0
    in_cell = (F.col("table_depth") > 0) & (F.col("cell_no") > 0)
    rule = F.when(F.col("text") == "", "---").otherwise(
        F.concat(F.lit("---\n\n"), F.col("text"))
    )
    return F.struct(
        "pos",
        F.when(b.is_open("hr"), rule).otherwise(F.col("text")).alias("text"),
        "heading",
        "heading_no",
        F.when(in_list, F.col("item_no")).otherwise(0).alias("item"),
        F.coalesce("bullet", F.lit("")).alias("bullet"),
        F.col("list_depth").alias("lists"),
        F.when(in_list, F.col("list_no")).otherwise(0).alias("list"),
        F.col("quote_depth").alias("quotes"),
        b.is_open("pre").alias("pre"),
        F.when(in_cell, F.col("table_no")).otherwise(0).alias("table"),
        F.when(in_cell, F.col("row_no")).otherwise(0).alias("row"),
        F.when(in_cell, F.col("cell_no")).otherwise(0).alias("cell"),
        b.is_open(*b.CELLS).alias("cell_start"),
        "colspan",
        "rowspan",
    )


def _shown() -> Column:
    """Blocks with text, and those that leave a trace without any."""
    return (
        (F.col("text") != "")
        | b.is_open("hr")
        | (F.col("bullet") != "")
        | (b.is_open(*b.CELLS) & (F.col("table_depth") > 0))
    )


def _render(c: Column, prev: Column, nxt: Column, spans: Column) -> Column:
    """Separator, prefix and text of piece ``c`` between its neighbours.

    ``spans``: the empty cells around its cell where its page has cells that span others.
    """
    before = F.coalesce(spans["before"], F.lit(0))
    after = F.coalesce(spans["after"], F.lit(0))
    width = F.coalesce(spans["width"], c["cell"].cast("int"))
    first = prev.isNull()
    in_row = c["table"] > 0
    same_row = in_row & (prev["table"] == c["table"]) & (prev["row"] == c["row"])
    same_table = in_row & (prev["table"] == c["table"])
    row_ends = in_row & (
        nxt.isNull() | (nxt["table"] != c["table"]) | (nxt["row"] != c["row"])
    )
    same_heading = (c["heading"] > 0) & (prev["heading_no"] == c["heading_no"]) & (
        prev["heading"] > 0
    )
    is_item = c["bullet"] != ""
    after_bare_item = (prev["bullet"] != "") & (prev["text"] == "") & (prev["item"] == c["item"])
    in_same_list = (c["list"] > 0) & (prev["list"] == c["list"])
    bare_item_ends = is_item & (c["text"] == "") & (
        nxt.isNull() | (nxt["item"] != c["item"]) | (nxt["bullet"] != "")
    )

    quote = F.repeat(F.lit("> "), F.greatest(c["quotes"], F.lit(0)).cast("int"))
    shared_quote = F.repeat(
        F.lit("> "), F.least(c["quotes"], prev["quotes"]).cast("int")
    )
    indent = F.repeat(F.lit("  "), F.greatest(c["lists"] - 1, F.lit(0)).cast("int"))
    hanging = F.repeat(F.lit("  "), c["lists"].cast("int"))

    paragraph_break = F.when(
        F.least(c["quotes"], prev["quotes"]) > 0,
        F.concat(F.lit("\n"), F.rtrim(shared_quote), F.lit("\n")),
    ).otherwise("\n\n")
    separator = (
        F.when(first, "")
        .when(same_row & c["cell_start"], F.repeat(F.lit(" | "), before + 1))
        .when(same_row, F.when(prev["text"] == "", "").otherwise(" "))
        .when(same_table, "\n")
        .when(same_heading, " ")
        .when(after_bare_item & ~is_item, "")
        .when(is_item & in_same_list, "\n")
        .otherwise(paragraph_break)
    )
    one_line = F.replace(c["text"], F.lit("\n"), F.lit(" "))
    cell = F.replace(one_line, F.lit("|"), F.lit("\\|"))
    fenced = F.concat(F.lit("```\n"), c["text"], F.lit("\n```"))
    prefix = F.concat(quote, indent)
    row = F.concat(
        F.when(same_row, "").otherwise(
            F.concat(quote, F.lit("| "), F.repeat(F.lit(" | "), before))
        ),
        cell,
        F.when(row_ends, F.concat(F.repeat(F.lit(" | "), after), F.lit(" |"))).otherwise(""),
        F.when(
            row_ends & (c["row"] <= 1),
            F.concat(
                F.lit("\n"), quote, F.lit("|"), F.repeat(F.lit(" --- |"), width)
            ),
        ).otherwise(""),
    )
    body = (
        F.when(in_row, row)
        .when(same_heading, one_line)
        .when(
            c["heading"] > 0,
            F.concat(
                F.when(after_bare_item, "").otherwise(prefix),
                c["bullet"],
                F.repeat(F.lit("#"), c["heading"]),
                F.lit(" "),
                one_line,
            ),
        )
        .when(bare_item_ends, F.concat(prefix, F.rtrim(c["bullet"])))
        .when(
            is_item,
            F.concat(prefix, c["bullet"], _lines(c["text"], F.concat(quote, hanging))),
        )
        .otherwise(
            let(
                F.when(c["pre"], fenced).otherwise(c["text"]),
                lambda t: F.concat(
                    F.when(after_bare_item, "").otherwise(F.concat(quote, hanging)),
                    _lines(t, F.concat(quote, hanging)),
                ),
            )
        )
    )
    return F.concat(separator, body)


def assemble(
    blocks: DataFrame, key: str = "page_id", first: tuple[str, ...] = ("url",)
) -> DataFrame:
    """(key, <first>, markdown) from the kept blocks; every page gives a row."""
    pages = blocks.groupBy(key).agg(
        *[F.max(c).alias(c) for c in first],
        F.collect_list(F.when(_shown(), _piece())).alias("pieces"),
    )
    text = let(
        F.array_sort("pieces"),
        lambda p: let(
            span_grid(p),
            lambda g: F.array_join(
                F.transform(
                    p,
                    lambda c, i: _render(
                        c, F.when(i > 0, F.get(p, i - 1)), F.get(p, i + 1), F.get(g, i)
                    ),
                ),
                "",
            ),
        ),
    )
    joined = pages.select(key, *first, text.alias("text"))
    return joined.select(key, *first, tidy_output(inline.close_links(F.col("text"))).alias("markdown"))


def to_markdown(
    pages: DataFrame,
    strip_boilerplate: bool = True,
    selector: str | None = None,
    key: str = "page_id",
    escape: bool = True,
    carry: tuple[str, ...] = (),
    strip_subtrees: bool = True,
) -> DataFrame:
    """(key, url, <carry>, markdown) of each page.

    A selector that matches takes the place of main-content extraction, and stripping
    then looks inside the match only; pages it does not match fall back to it (or to
    the whole page when that is off). Blank html gives ''. Subtrees of navigation, footer,
    header and aside do not appear unless ``strip_subtrees`` is off, as for local files. ``key`` must be unique (``sources.pages.repeated_keys``
    tells): rows that share one are taken for one page. ``carry`` names further columns of
    the page, which travel on its first row.
    """
    first = ("url", *carry)
    if selector is not None:
        pages = select_elements(pages, selector)
    split = b.split_blocks(
        pages,
        key,
        escape,
        content_flags() if strip_boilerplate else None,
        carried=() if selector is None else ("matched",),
        first=first,
    )
    nested = b.with_nesting(split, key)
    if strip_subtrees:
        nested = b.drop_stripped_blocks(nested)
    if strip_boilerplate:
        nested = mark_main_content(
            b.with_levels(with_text_sums(nested, key), key, at_end=TEXT_SUMS),
            key,
            prune=selector is None,
        )
        if selector is not None:
            nested = nested.withColumn("kept", F.col("kept") | F.col("matched"))
    else:
        nested = b.with_levels(nested, key).withColumn("kept", F.lit(True))
    kept = nested.filter(F.col("kept") | (F.col("pos") == 0)).withColumn(
        "text", F.when(F.col("kept"), F.col("text")).otherwise("")
    )
    return assemble(kept, key, first)
