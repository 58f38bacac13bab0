"""HTML pages as rows of blocks, with the nesting each block sits in.

A block row starts at one block-level tag and holds the inline content up to the
next one, already turned into marked text. Rows are far fewer than tokens, and the
shuffle that follows carries only text: scripts, styles, attributes and tags are gone.

Nesting comes from running sums over (page, position), so no tree is built. Only
containers count towards depth; p, li, td and headings end where the next block
starts, as HTML lets them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.functions import grid, inline, markup
from leafmill.functions.markup import ANY_TAG, ATTRS, DECLARATION, SKIPPED
from leafmill.operators.tokens import STRIPPED_TAGS, clamped_depth

# --- fixed values: HTML element classes ---------------------------------------
LISTS = ("ul", "ol")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
CONTAINERS = (
    "div", "section", "article", "main", "nav", "header", "footer", "aside", "form",
    "fieldset", "figure", "details", "dl", "blockquote", "table", *LISTS,
)
LEAVES = (
    "html", "head", "title", "body", "p", "pre", "hr", "li", "dt", "dd", "caption",
    "thead", "tbody", "tfoot", "tr", "td", "th", "figcaption", "address", "center",
    "legend", "summary", "option", *HEADINGS,
)
CELLS = ("td", "th")
# ------------------------------------------------------------------------------

_NAMES = "|".join((*CONTAINERS, *LEAVES))
_STARTS_BLOCK = rf"</?(?i:{_NAMES})(?=[\s/>])"
_ONE_TAG = rf"</?[A-Za-z](?:{ATTRS}>|[^>]*+(?:>|\z))"
_BLOCK_TAG = rf"{_STARTS_BLOCK}(?:{ATTRS}>|[^>]*+(?:>|\z))"
_INLINE = rf"[^<]++|{SKIPPED}|(?!{_STARTS_BLOCK})(?:{ANY_TAG}|{DECLARATION}|<)"
BLOCK = rf"{_BLOCK_TAG}(?:{_INLINE})*+|(?:{_INLINE})++"


def split_blocks(
    pages: DataFrame,
    key: str = "page_id",
    escape: bool = True,
    flags: dict[str, Column] | None = None,
    carried: tuple[str, ...] = (),
    first: tuple[str, ...] = ("url",),
) -> DataFrame:
    """(key, <carried>, <first>, pos, tag, is_close, start, colspan, rowspan, text,
    <flags>), one row per block.

    ``carried`` columns travel on all rows of a page, those of ``first`` on the first one only. ``flags`` are expressions over
    the block's tag (column ``block_tag``), computed here so that the tag itself need
    not be shuffled. A page without content keeps one empty row.
    """
    rows = pages.select(
        key,
        *carried,
        *first,
        F.posexplode_outer(
            F.regexp_extract_all(F.col("html"), F.lit(BLOCK), F.lit(0))
        ).alias("pos", "block"),
    )
    block = F.coalesce(F.col("block"), F.lit(""))
    named = rows.select(
        key,
        *carried,
        *[F.when(F.coalesce(F.col("pos"), F.lit(0)) == 0, F.col(c)).alias(c) for c in first],
        F.coalesce(F.col("pos"), F.lit(0)).alias("pos"),
        markup.tag_name(block).alias("_name"),
        block.alias("block"),
    )
    is_block = F.col("_name").isin(*CONTAINERS, *LEAVES)
    cut = named.select(
        key,
        *carried,
        *first,
        "pos",
        F.when(is_block, F.col("_name")).otherwise("").alias("tag"),
        F.when(is_block, F.regexp_extract("block", rf"^{_ONE_TAG}", 0)).otherwise("").alias(
            "block_tag"
        ),
        "block",
    ).select(
        key, *carried, *first, "pos", "tag", "block_tag",
        F.substr("block", F.length("block_tag") + 1).alias("body"),
    )
    body = F.col("body")
    is_close = F.col("block_tag").startswith("</")
    text = (
        F.when(F.col("tag") == "title", "")
        .when((F.col("tag") == "pre") & ~is_close, inline.preformatted_text(body))
        .otherwise(inline.close_emphasis(inline.marked_text(body, escape)))
    )
    start = F.when(
        F.col("tag") == "ol",
        markup.attribute(F.col("block_tag"), "start").try_cast("int"),
    )
    cell = F.col("tag").isin(*CELLS) & ~is_close
    spans = {"colspan": grid.colspan, "rowspan": grid.rowspan}
    return cut.select(
        key,
        *carried,
        *first,
        "pos",
        "tag",
        is_close.alias("is_close"),
        start.alias("start"),
        *[
            F.when(cell, read(markup.attribute(F.col("block_tag"), name))).otherwise(1).alias(name)
            for name, read in spans.items()
        ],
        text.alias("text"),
        *[expr.alias(name) for name, expr in (flags or {}).items()],
    )


def is_open(*tags: str) -> Column:
    return F.col("tag").isin(*tags) & ~F.col("is_close")


def _step(*tags: str) -> Column:
    return F.when(F.col("tag").isin(*tags), F.when(F.col("is_close"), -1).otherwise(1)).otherwise(0)


def with_nesting(blocks: DataFrame, key: str = "page_id") -> DataFrame:
    """Adds the running state of a page at each block.

    One exchange and one sort on (page, position) serve all the windows below.
    Depths: ``strip_depth``, ``depth`` (containers), ``list_depth``, ``quote_depth``,
    ``table_depth``. Ordinals: ``heading_no``/``heading``, ``item_no``, ``list_no`` of
    outermost lists, ``table_no``, ``row_no`` in its table, ``cell_no`` in its row.
    """
    running = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    nests = {
        "strip_depth": STRIPPED_TAGS,
        "depth": CONTAINERS,
        "list_depth": LISTS,
        "quote_depth": ("blockquote",),
        "table_depth": ("table",),
    }
    level = F.when(
        F.col("tag").isin(*HEADINGS),
        F.when(F.col("is_close"), 0).otherwise(F.substring("tag", 2, 1).cast("int")),
    )
    # Any other container or paragraph tag in between leaves the heading open, as a
    # heading may wrap its words in containers.
    counted = blocks.select(
        "*",
        *[F.sum(_step(*tags)).over(running).alias(f"_{n}") for n, tags in nests.items()],
        F.coalesce(F.last(level, ignorenulls=True).over(running), F.lit(0)).alias("heading"),
        F.count_if(is_open(*HEADINGS)).over(running).alias("heading_no"),
        F.count_if(is_open("li")).over(running).alias("item_no"),
        F.count_if(is_open("table")).over(running).alias("table_no"),
        F.count_if(is_open("tr")).over(running).alias("_rows"),
        F.count_if(is_open(*CELLS)).over(running).alias("_cells"),
    )
    lowest = counted.select(
        "*",
        *[F.min(f"_{n}").over(running).alias(f"_low_{n}") for n in nests],
        F.last(F.when(is_open("table"), F.col("_rows")), ignorenulls=True)
        .over(running)
        .alias("_rows_before"),
        F.last(F.when(is_open("tr"), F.col("_cells")), ignorenulls=True)
        .over(running)
        .alias("_cells_before"),
    )
    kept = [c for c in counted.columns if not c.startswith("_")]
    deep = lowest.select(
        *kept,
        *[clamped_depth(F.col(f"_{n}"), F.col(f"_low_{n}")).alias(n) for n in nests],
        (F.col("_rows") - F.coalesce("_rows_before", F.lit(0))).alias("row_no"),
        (F.col("_cells") - F.coalesce("_cells_before", F.lit(0))).alias("cell_no"),
    )
    outermost = is_open(*LISTS) & (F.col("list_depth") == 1)
    return deep.withColumn("list_no", F.count_if(outermost).over(running))


def drop_stripped_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks outside navigation, footer, header and aside.

    The first row of a page always stays, emptied if need be: it stands for the page.
    """
    outside = F.col("strip_depth") == 0
    return blocks.filter(outside | (F.col("pos") == 0)).withColumn(
        "text", F.when(outside, F.col("text")).otherwise("")
    )


def with_levels(blocks: DataFrame, key: str = "page_id", at_end: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``level``: depth of a container at both its tags, of a list at its items.

    Rows that share (page, level) are the boundaries of sibling containers in order,
    so an opener's end is simply the next boundary. All other rows get level -1.
    Adds ``end`` for openers, a struct of the end's position and the columns named
    in ``at_end`` (null: open to the end of the page), and ``bullet`` for list items.
    """
    container = F.col("tag").isin(*CONTAINERS)
    level = (
        F.when(container & ~F.col("is_close"), F.col("depth"))
        .when(container, F.col("depth") + 1)
        .when(is_open("li") & (F.col("list_depth") > 0), F.col("depth"))
        .otherwise(-1)
    )
    leveled = blocks.withColumn("level", level).withColumn(
        "_bound", F.when(container, F.struct("pos", *at_end))
    )
    by_level = W.partitionBy(key, "level").orderBy("pos")
    running = by_level.rowsBetween(W.unboundedPreceding, 0)
    ordered = leveled.select(
        "*",
        F.expr(
            f"lead(_bound) ignore nulls over (partition by {key}, level order by pos)"
        ).alias("_next_bound"),
        F.count_if(F.col("tag") == "li").over(running).alias("_items"),
    )
    opener = F.when(
        is_open(*LISTS),
        F.struct("tag", F.coalesce("start", F.lit(1)).alias("start"), "_items"),
    )
    listed = ordered.withColumn("_list", F.last(opener, ignorenulls=True).over(running))
    number = F.col("_items") - F.col("_list._items") + F.col("_list.start") - 1
    bullet = F.when(
        is_open("li"),
        F.when(
            F.col("_list.tag") == "ol", F.concat(number.cast("string"), F.lit(". "))
        ).otherwise("- "),
    )
    return listed.select(
        *leveled.columns[:-1],
        F.when(container & ~F.col("is_close"), F.col("_next_bound")).alias("end"),
        bullet.alias("bullet"),
    )
