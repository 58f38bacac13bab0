"""Requested and final addresses: chains of redirects resolved by pointer jumping.

A table of hops (url, to_url) says where a request for ``url`` was sent on to. Every step replaces
each target by the target's own target, so a chain of n hops takes log2(n) joins, and as many
are made as the limit of hops needs, whatever the table's size. Addresses are compared
without their fragment, which is never sent. An address with several stored hops follows the
smallest target. A chain that leads into a loop or is longer than the limit has no final address;
a request for it fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import urls
from leafmill.session import cut_lineage

# --- fixed values -----------------------------------------------------------
MAX_REDIRECTS = 5
# ----------------------------------------------------------------------------


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"#[\s\S]*+\z", "")


def resolve_redirects(hops: DataFrame, max_hops: int = MAX_REDIRECTS) -> DataFrame:
    """(url, final_url, hops, error) of every address that is sent on.

    ``hops``: url, to_url; a target may be relative to its address. ``error`` is 'too many'
    where there is no final address, else null.
    """
    if max_hops < 1:
        raise ValueError("max_hops must be at least 1")
    url = without_fragment(F.col("url"))
    pairs = hops.filter("url is not null and to_url is not null").select(
        url.alias("url"), without_fragment(urls.resolve(F.col("url"), F.col("to_url"))).alias("to")
    )
    first = cut_lineage(
        pairs.groupBy("url").agg(F.min("to").alias("to")).withColumn("hops", F.lit(1).cast("long"))
    )
    # After k steps a target lies 2**k hops on, or at the end of its chain.
    chains, reach = first, 1
    while reach <= max_hops:
        onward = chains.select(
            F.col("url").alias("to"), F.col("to").alias("_to"), F.col("hops").alias("_hops")
        )
        chains = cut_lineage(
            chains.join(onward, "to", "left").select(
                "url",
                F.coalesce("_to", "to").alias("to"),
                (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"),
            )
        )
        reach *= 2
    # A target that is itself sent on lies beyond the limit or on a loop.
    open_ = first.select(F.col("url").alias("to"), F.lit(True).alias("_open"))
    ended = chains.join(open_, "to", "left")
    final = F.col("_open").isNull() & (F.col("hops") <= max_hops)
    return ended.select(
        "url",
        F.when(final, F.col("to")).alias("final_url"),
        F.when(final, F.col("hops")).alias("hops"),
        F.when(~final, "too many").alias("error"),
    )
