"""The element tree of a page, malformed or not, by a stack machine over its tags.

Which element a token lies in depends on all tags before it: a start tag may end open
elements (a ``p`` ends where the next block starts, an ``li`` at the next item), an end tag ends
everything opened since its own start tag, and one that would reach across an element of a
higher rank (``</b>`` across a ``div``) is ignored. That is a fold with a stack for state, which
Spark's expressions can only carry by copying it at every step; so the names of a page's tags,
nothing else of it, go through an Arrow function. Texts and attributes stay in the JVM.

An element deeper than MAX_DEPTH holds nothing; what follows it lies in its parent. Null html
has no tokens. The functions are shipped with the tasks, so workers need not have this package.
"""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.functions import markup
from leafmill.operators.tokens import STRIPPED_TAGS

# --- fixed values: HTML element classes ---------------------------------------
MAX_DEPTH = 512
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
# An end tag does not reach across an open element of a higher rank.
RANKS = (
    "p pre h1 h2 h3 h4 h5 h6 li dt dd figcaption legend summary option optgroup",
    "address article aside blockquote center details div dl fieldset figure footer form header"
    " main menu nav ol section select ul",
    "caption td th",
    "tr",
    "thead tbody tfoot",
    "table",
    "head body",
    "html",
)
HEADINGS = "h1 h2 h3 h4 h5 h6"
ENDS_P = (
    "address article aside blockquote center details div dl fieldset figcaption figure footer"
    f" form {HEADINGS} header hr main menu nav ol p pre section table ul li dt dd"
)
# Start tag, the open elements it ends, and those beyond which it does not look.
IMPLIED_ENDS = (
    ("li", "li p", "ul ol menu table"),
    ("dt dd", "dt dd p", "dl table"),
    (HEADINGS, f"{HEADINGS} p", "div section article blockquote ul ol li dd td th table"),
    ("td th", "td th", "tr table"),
    ("tr", "tr td th", "table"),
    ("thead tbody tfoot", "thead tbody tfoot tr td th caption", "table"),
    ("option", "option", "select"),
    ("optgroup", "option optgroup", "select"),
    ("body", "head", "html"),
)
P_BARRIER = "td th caption table li dd div section article blockquote"
# ------------------------------------------------------------------------------

RANK = {name: rank for rank, names in enumerate(RANKS, 1) for name in names.split()}
_ENDS = {name: (frozenset(("p",)), frozenset(P_BARRIER.split())) for name in ENDS_P.split()} | {
    name: (frozenset(closed.split()), frozenset(barrier.split()))
    for names, closed, barrier in IMPLIED_ENDS
    for name in names.split()
}


def structure(marks: list[str]) -> tuple[list[int], list[int | None]]:
    """Parent of every token and end of every element.

    ``marks``: '' for a token that is no tag, else the tag's name, with a slash in front for an
    end tag. The parent is the place of the innermost element that holds the token, -1 for
    none; an end tag lies in the element that it ends. An element goes from its start tag up to, not
    including, its end.
    """
    parent, end = [-1] * len(marks), [None] * len(marks)
    names: list[str] = []
    places: list[int] = []

    def close(down_to: int, at: int) -> None:
        for place in places[down_to:]:
            end[place] = at
        del names[down_to:], places[down_to:]

    for i, mark in enumerate(marks):
        if mark.startswith("/"):
            name, depth = mark[1:], len(names) - 1
            rank = RANK.get(name, 0)
            while depth >= 0 and names[depth] != name and RANK.get(names[depth], 0) <= rank:
                depth -= 1
            if depth >= 0 and names[depth] == name:
                parent[i] = places[depth]
                close(depth + 1, i)
                close(depth, i + 1)
                continue
        elif mark in _ENDS:
            closed, barrier = _ENDS[mark]
            cut, depth = None, len(names) - 1
            while depth >= 0 and names[depth] not in barrier:
                if names[depth] in closed:
                    cut = depth
                depth -= 1
            if cut is not None:
                close(cut, i)
        parent[i] = places[-1] if places else -1
        if mark and not mark.startswith("/"):
            if mark in VOID or len(names) >= MAX_DEPTH:
                end[i] = i + 1
            else:
                names.append(mark)
                places.append(i)
    close(0, len(marks))
    return parent, end


def _tree_of(marks: pa.Array) -> pa.Array:
    found = [structure(m or []) for m in marks.to_pylist()]
    ints = pa.list_(pa.int32())
    return pa.StructArray.from_arrays(
        [pa.array([p for p, _ in found], ints), pa.array([e for _, e in found], ints)],
        names=["parent", "end"],
    )


def marks(tokens: Column) -> Column:
    """What the stack machine needs to know of each token."""

    def mark(t: Column) -> Column:
        slash = F.when(t.startswith("</"), "/").otherwise("")
        named = F.concat(slash, markup.tag_name(t))
        return F.when(t.startswith("<") & (markup.token_kind(t) == "tag"), named).otherwise("")

    return F.transform(tokens, mark)


def tree_tokens(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, pos, kind, tag, is_close, raw, parent, end), one row per token; no shuffle."""
    tree = F.arrow_udf(_tree_of, "struct<parent: array<int>, end: array<int>>")
    split = pages.select(key, markup.tokens(F.col("html")).alias("raw"))
    marked = split.select(key, "raw", marks(F.col("raw")).alias("mark"))
    built = marked.select(key, "raw", "mark", tree(F.col("mark")).alias("tree"))
    rows = built.select(
        key,
        F.posexplode(
            F.arrays_zip("raw", "mark", F.col("tree.parent").alias("parent"), F.col("tree.end").alias("end"))
        ).alias("pos", "t"),
    ).select(key, "pos", "t.*")
    return rows.select(
        key,
        "pos",
        markup.token_kind(F.col("raw")).alias("kind"),
        F.ltrim(F.col("mark"), F.lit("/")).alias("tag"),
        F.col("mark").startswith("/").alias("is_close"),
        "raw",
        "parent",
        "end",
    )


def with_inside(rows: DataFrame, opener: Column, name: str, key: str = "page_id") -> DataFrame:
    """Adds ``name``: whether a token lies in an element whose start tag meets ``opener``.

    Elements are intervals of positions, so a token is in one if the furthest end of those
    that have started lies behind it: one running maximum per page.
    """
    started = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    reach = F.max(F.when(opener & ~F.col("is_close"), F.col("end"))).over(started)
    return rows.withColumn(name, F.coalesce(reach > F.col("pos"), F.lit(False)))


def drop_stripped(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """Tokens outside navigation, footer, header, aside, script and style."""
    stripped = F.col("tag").isin(*STRIPPED_TAGS)
    inside = with_inside(rows, stripped, "_inside", key)
    stray = stripped & F.col("is_close")
    return inside.filter(~F.col("_inside") & ~stray & (F.col("kind") != "raw")).drop("_inside")


# The functions travel with the tasks in place of this module's name.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
