"""HTML pages as rows of lexical tokens, and nesting depth over them.

Elements and their ends on malformed pages are in ``operators.tree``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.functions import markup

# Elements whose whole subtree never reaches the markdown (script and style are
# single tokens already).
STRIPPED_TAGS = ("nav", "footer", "header", "aside")


def tokenise(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per token: (key, pos, kind, tag, is_close, raw).

    Map-only: the html column ends here and is not carried further.
    """
    exploded = pages.select(key, F.posexplode(markup.tokens(F.col("html"))).alias("pos", "raw"))
    kind = markup.token_kind(F.col("raw"))
    return exploded.select(
        key,
        "pos",
        kind.alias("kind"),
        F.when(F.col("raw").rlike("^</?[A-Za-z]"), markup.tag_name(F.col("raw")))
        .otherwise("")
        .alias("tag"),
        F.col("raw").startswith("</").alias("is_close"),
        "raw",
    )


def clamped_depth(running: Column, lowest: Column) -> Column:
    """Depth from a running +1/-1 sum, closing tags without an opener ignored."""
    return running - F.least(F.lit(0), lowest)


def with_depth(
    tokens: DataFrame, tags: Sequence[str] = STRIPPED_TAGS, key: str = "page_id"
) -> DataFrame:
    """Adds ``depth``: how many elements named in ``tags`` are open at each token.

    One exchange on the page key; both windows share its sort.
    """
    by_pos = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    counted = (F.col("kind") == "tag") & F.col("tag").isin(*tags)
    step = F.when(counted, F.when(F.col("is_close"), -1).otherwise(1)).otherwise(0)
    running = tokens.withColumn("_sum", F.sum(step).over(by_pos))
    return (
        running.withColumn("_low", F.min("_sum").over(by_pos))
        .withColumn("depth", clamped_depth(F.col("_sum"), F.col("_low")).cast("int"))
        .drop("_sum", "_low")
    )
