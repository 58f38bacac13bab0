"""First-seen selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key.

    ``row_number() = 1`` makes Spark keep one row per key on the map side before the
    shuffle, so a key that most rows share reaches the reducer once per map task.
    """
    first = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", first).filter(F.col("_n") == 1).drop("_n")


def fingerprint(markdown: Column) -> Column:
    return F.sha2(markdown, 256)


def dedupe_by_content(
    pages: DataFrame, order: Sequence[str | Column], within: Sequence[str] = ()
) -> DataFrame:
    """Pages whose ``markdown`` was not seen earlier (in the same crawl)."""
    marked = pages.withColumn("_fingerprint", fingerprint(F.col("markdown")))
    return keep_first(marked, [*within, "_fingerprint"], order).drop("_fingerprint")
