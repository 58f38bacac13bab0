"""Cells that span rows and columns, laid out on a grid.

A cell takes the first free columns of its row; one that spans rows keeps its columns occupied in
the rows below. That is carried from cell to cell, in a fold over a page's pieces which works in
chunks, so that what it has put out is not copied at every step. Pages without a span skip it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.text import let

# --- fixed values: limits of the HTML standard ---------------------------------------
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534
# ------------------------------------------------------------------------------

_CHUNK = 512


def colspan(value: Column) -> Column:
    """Columns of a cell from its attribute; 1 if it is missing or makes no sense."""
    n = value.try_cast("int")
    return F.when(n >= 1, F.least(n, F.lit(MAX_COLSPAN))).otherwise(1)


def rowspan(value: Column) -> Column:
    """Rows of a cell from its attribute; 0 stands for all that follow."""
    n = value.try_cast("int")
    return F.when(n == 0, MAX_ROWSPAN).when(n >= 1, F.least(n, F.lit(MAX_ROWSPAN))).otherwise(1)


def _zero() -> list[Column]:
    none = F.array().cast("array<int>")
    return [
        *[F.lit(0).alias(n) for n in ("table", "row", "col", "span")],
        none.alias("held"),
        F.struct(*[F.lit(0).alias(n) for n in ("before", "after", "width")]).alias("cell"),
    ]


def _place(s: Column, c: Column) -> Column:
    """The state after cell ``c``: ``held`` has the rows each column is still taken for."""
    same_table = s["table"] == c["table"]
    same_row = same_table & (s["row"] == c["row"])
    none = F.array().cast("array<int>")
    held = F.when(
        same_table,
        F.transform(s["held"], lambda x: F.greatest(x - (c["row"] - s["row"]), F.lit(0)).cast("int")),
    ).otherwise(none)
    col = F.when(same_row, s["col"]).otherwise(0)

    def at_first_free(h: Column) -> Column:
        rest = F.slice(h, col + 1, F.size(h))
        free = F.array_position(F.transform(rest, lambda x: x > 0), F.lit(False)).cast("int")
        skipped = F.when(free == 0, F.size(rest)).otherwise(free - 1)
        return let(skipped, lambda k: put(h, k))

    def put(h: Column, skipped: Column) -> Column:
        at = col + skipped
        taken = F.concat(
            F.slice(h, F.lit(1), at),
            # a cell that reaches over a taken column shares it
            F.transform(
                F.sequence(F.lit(0), c["colspan"] - 1),
                lambda k: F.greatest(c["rowspan"], F.coalesce(F.get(h, at + k), F.lit(0))).cast("int"),
            ),
            F.slice(h, at + c["colspan"] + 1, F.size(h)),
        )
        return let(taken, lambda t: state(t, at, skipped))

    def state(t: Column, at: Column, skipped: Column) -> Column:
        end = at + c["colspan"]
        last = F.array_max(F.transform(t, lambda x, k: F.when(x > 0, k + 1).otherwise(0)))
        beyond = F.greatest(last - end, F.lit(0))
        before = skipped + F.when(same_row, s["span"] - 1).otherwise(0)
        return F.struct(
            c["table"].cast("int").alias("table"),
            c["row"].cast("int").alias("row"),
            end.cast("int").alias("col"),
            c["colspan"].cast("int").alias("span"),
            t.alias("held"),
            F.struct(
                before.cast("int").alias("before"),
                (c["colspan"] - 1 + beyond).cast("int").alias("after"),
                (end + beyond).cast("int").alias("width"),
            ).alias("cell"),
        )

    return let(held, at_first_free)


def span_grid(pieces: Column) -> Column:
    """array<struct<before, after, width>>, an entry per piece; null without a span.

    ``before``: empty cells in front of the piece's cell, ``after``: those that would end its
    row behind it, ``width``: columns of the grid up to there.
    """

    def step(s: Column, c: Column) -> Column:
        starts = c["cell_start"] & (c["table"] > 0)
        now = F.struct(*[s[n].alias(n) for n in ("table", "row", "col", "span", "held", "cell")])
        moved = F.when(starts, _place(s, c)).otherwise(now)
        return let(
            moved,
            lambda m: F.struct(
                *[m[n].alias(n) for n in ("table", "row", "col", "span", "held", "cell")],
                F.concat(s["out"], F.array(m["cell"])).alias("out"),
            ),
        )

    no_cells = F.slice(F.array(_zero()[-1]), F.lit(1), F.lit(0)).alias("out")

    def by_chunk(s: Column, chunk: Column) -> Column:
        names = ("table", "row", "col", "span", "held", "cell")
        begin = F.struct(*[s[n].alias(n) for n in names], no_cells)
        return let(
            F.aggregate(chunk, begin, step),
            lambda e: F.struct(
                *[e[n].alias(n) for n in names], F.concat(s["out"], e["out"]).alias("out")
            ),
        )

    chunks = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(pieces), F.lit(1)), F.lit(_CHUNK)),
        lambda a: F.slice(pieces, a, F.lit(_CHUNK)),
    )
    spans = F.exists(pieces, lambda c: (c["colspan"] > 1) | (c["rowspan"] > 1))
    return F.when(spans, F.aggregate(chunks, F.struct(*_zero(), no_cells), by_chunk)["out"])
