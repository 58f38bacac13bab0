"""Main content of a page: container scoring after the published Arc90 heuristic.

Each paragraph scores by length and commas; its container earns the full score, the
next one out half of it, then a quarter, and so on. With weights of 2^-depth those
sums are differences of one running sum at a container's two ends, so scoring every
container of every page needs no tree and no join, only the windows that conversion
uses anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.functions import inline, markup
from leafmill.operators.blocks import CONTAINERS, HEADINGS, is_open

# --- fixed values: published heuristic ----------------------------------------
UNLIKELY = (
    "combx|comment|community|disqus|extra|foot|header|menu|remark|rss|shoutbox|"
    "sidebar|sponsor|ad-break|agegate|pagination|pager|popup|tweet|twitter"
)
MAYBE = "and|article|body|column|main|shadow"
POSITIVE = (
    "article|body|content|entry|hentry|main|page|pagination|post|text|blog|story"
)
NEGATIVE = (
    "combx|comment|com-|contact|foot|footer|footnote|masthead|media|meta|outbrain|"
    "promo|related|scroll|shoutbox|sidebar|sponsor|shopping|tags|tool|widget"
)
CLASS_WEIGHT = 25
TAG_BONUS = {
    "div": 5, "article": 10, "section": 5, "blockquote": 3,
    "form": -3, "ul": -3, "ol": -3, "dl": -3,
}
MIN_PARAGRAPH = 25
SIBLING_SHARE, SIBLING_FLOOR = 0.2, 10.0
LONG_SIBLING, SIBLING_LINK_DENSITY = 80, 0.25
# ------------------------------------------------------------------------------

TEXT_SUMS = ("score_sum", "seen_sum", "linked_sum")
_PAGE_END = 2**31 - 1


def content_flags() -> dict[str, Column]:
    """Class and id hints of a container's tag, to be computed before the shuffle."""
    opens = F.col("tag").isin(*CONTAINERS) & ~F.col("block_tag").startswith("</")
    hinted = opens & F.col("block_tag").rlike(r"(?i)[\s/](?:class|id)\s*=")

    def lowered(name: str) -> Column:
        return F.coalesce(F.lower(markup.attribute(F.col("block_tag"), name)), F.lit(""))

    names = F.concat_ws(" ", lowered("class"), lowered("id"))

    def weigh(c: Column) -> Column:
        return F.when(c.rlike(POSITIVE), CLASS_WEIGHT).otherwise(0) - F.when(
            c.rlike(NEGATIVE), CLASS_WEIGHT
        ).otherwise(0)

    return {
        "unlikely": F.when(hinted, names.rlike(UNLIKELY) & ~names.rlike(MAYBE)).otherwise(False),
        "class_weight": F.when(hinted, weigh(lowered("class")) + weigh(lowered("id"))).otherwise(0),
    }


def with_text_sums(blocks: DataFrame, key: str = "page_id") -> DataFrame:
    """Adds each block's visible and linked length, its score, and the sums before it."""
    measured = blocks.select(
        "*",
        inline.text_length(F.col("text")).alias("seen"),
        inline.link_text_length(F.col("text")).alias("linked"),
    )
    commas = F.length("text") - F.length(F.replace("text", F.lit(","), F.lit("")))
    paragraph = (
        (F.col("seen") >= MIN_PARAGRAPH)
        & (F.col("heading") == 0)
        & ~F.col("tag").isin("li", *HEADINGS)
    )
    score = F.when(
        paragraph, 2 + commas + F.least(F.col("seen") / 100, F.lit(3.0))
    ).otherwise(0.0)
    scored = measured.withColumn("weight", score * F.pow(F.lit(2.0), -F.col("depth")))
    before = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    sums = {"score_sum": "weight", "seen_sum": "seen", "linked_sum": "linked"}
    return scored.select(
        "*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for n, c in sums.items()]
    )


def _fraction_linked(linked: Column, seen: Column) -> Column:
    return F.when(seen > 0, linked / seen).otherwise(0.0)


def mark_main_content(blocks: DataFrame, key: str = "page_id", prune: bool = True) -> DataFrame:
    """Adds ``kept``: block lies in the best container or in a sibling worth keeping.

    ``prune`` drops what is outside the best container's parent before the last sort.
    """
    page = W.partitionBy(key)
    totals = blocks.select(
        "*",
        F.max(F.col("score_sum") + F.col("weight")).over(page).alias("_score"),
        F.max(F.col("seen_sum") + F.col("seen")).over(page).alias("_seen"),
        F.max(F.col("linked_sum") + F.col("linked")).over(page).alias("_linked"),
    )
    # An opener without an end runs to the end of the page.
    opener = F.col("tag").isin(*CONTAINERS) & ~F.col("is_close")
    earned = F.coalesce("end.score_sum", "_score") - F.col("score_sum")
    seen = F.coalesce("end.seen_sum", "_seen") - F.col("seen_sum")
    linked = F.coalesce("end.linked_sum", "_linked") - F.col("linked_sum")
    bonus = F.lit(0)
    for tag, points in TAG_BONUS.items():
        bonus = F.when(F.col("tag") == tag, points).otherwise(bonus)
    score = (earned * F.pow(F.lit(2.0), F.col("level")) + bonus + F.col("class_weight")) * (
        1 - _fraction_linked(linked, seen)
    )
    candidates = totals.withColumn(
        "_own",
        F.when(
            opener & ~F.col("unlikely") & (earned > 0),
            F.struct(
                score.alias("score"),
                F.col("pos").alias("start"),
                F.coalesce("end.pos", F.lit(_PAGE_END)).alias("stop"),
                F.col("level").alias("level"),
            ),
        ),
    )
    body_score = F.col("_score") * (1 - _fraction_linked(F.col("_linked"), F.col("_seen")))
    body = F.struct(
        body_score.alias("score"),
        F.lit(-1).alias("start"),
        F.lit(_PAGE_END).alias("stop"),
        F.lit(0).alias("level"),
    )
    top = F.max("_own").over(page)
    best = candidates.withColumn(
        "_best", F.when(top["score"] > body_score, top).otherwise(body)
    )
    around = (
        opener
        & (F.col("level") == F.col("_best.level") - 1)
        & (F.col("pos") < F.col("_best.start"))
    )
    # The last container opened one level out before the best one is its parent.
    outer = F.max(
        F.when(
            around,
            F.struct(
                F.col("pos").alias("start"),
                F.coalesce("end.pos", F.lit(_PAGE_END)).alias("stop"),
            ),
        )
    ).over(page)
    parent = best.withColumn("_parent", outer)
    in_parent = (F.col("_best.level") <= 1) | (
        (F.col("pos") >= F.col("_parent.start")) & (F.col("pos") < F.col("_parent.stop"))
    )
    near = parent.filter(in_parent | (F.col("pos") == 0)) if prune else parent

    running = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    sibling = F.last(
        F.when(opener & (F.col("level") == F.col("_best.level")), F.struct("_own")),
        ignorenulls=True,
    ).over(running)["_own"]
    dropped = F.max(
        F.when(F.col("unlikely") & opener, F.coalesce("end.pos", F.lit(_PAGE_END)))
    ).over(running)
    placed = near.withColumn("_sibling", sibling).withColumn("_dropped", dropped)

    def inside(c: str) -> Column:
        return (F.col("pos") >= F.col(f"{c}.start")) & (F.col("pos") < F.col(f"{c}.stop"))

    floor = F.greatest(F.lit(SIBLING_FLOOR), F.col("_best.score") * SIBLING_SHARE)
    density = _fraction_linked(F.col("linked"), F.col("seen"))
    good_paragraph = (
        is_open("p")
        & (F.col("depth") == F.col("_best.level") - 1)
        & F.when(F.col("seen") > LONG_SIBLING, density < SIBLING_LINK_DENSITY).otherwise(
            (F.col("linked") == 0) & F.col("text").rlike(r"\.(?: |\z)")
        )
    )
    kept = inside("_best") | (
        in_parent & ((inside("_sibling") & (F.col("_sibling.score") >= floor)) | good_paragraph)
    )
    wanted = F.coalesce(kept, F.lit(False)) & (
        F.col("pos") >= F.coalesce("_dropped", F.lit(-1))
    )
    helpers = [c for c in placed.columns if c.startswith("_")]
    return placed.withColumn("kept", wanted).drop(*helpers)
