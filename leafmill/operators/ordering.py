"""Sorting by publication date and limits, for one result set or one per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.session import cut_lineage


def date_order(descending: bool = True, undated: str = "last") -> list[Column]:
    """Sort keys: date, then URL in the same direction.

    ``undated='last'`` is the documented order; ``'first'`` puts pages without a date
    ahead in both directions.
    """
    if undated not in ("first", "last"):
        raise ValueError("undated must be 'first' or 'last'")
    date, url = F.col("published_date"), F.col("url")
    if descending:
        by_date = date.desc_nulls_last() if undated == "last" else date.desc_nulls_first()
        return [by_date, url.desc()]
    by_date = date.asc_nulls_last() if undated == "last" else date.asc_nulls_first()
    return [by_date, url.asc()]


def sort_by_date(results: DataFrame, descending: bool = True, undated: str = "last") -> DataFrame:
    return results.orderBy(*date_order(descending, undated))


def limit_results(
    results: DataFrame, order: Sequence[Column], limit: int | None
) -> DataFrame:
    """First ``limit`` rows in ``order``; 0 or None keeps all."""
    return limit_per_group(results.withColumn("_all", F.lit(0)), ["_all"], order, limit).drop("_all")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Row number per key in ``order``, without one task per key.

    Rows are range-partitioned by (key, order), numbered inside each piece and shifted
    by the size of the key's earlier pieces. The pieces are written down first, since
    their bounds are sampled and must not change between the two uses.
    """
    pieces = cut_lineage(
        df.repartitionByRange(*[F.col(k) for k in keys], *order)
        .sortWithinPartitions(*[F.col(k) for k in keys], *order)
        .withColumn("_piece", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id())
    )
    sizes = pieces.groupBy(*keys, "_piece").agg(F.count("*").alias("_size"))
    earlier = W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, "_piece", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset")
    )
    inside = W.partitionBy(*keys, "_piece").orderBy("_at")
    return (
        pieces.join(offsets, [*keys, "_piece"])
        .withColumn(name, F.col("_offset") + F.row_number().over(inside))
        .drop("_piece", "_at", "_offset")
    )


# Up to this limit every task of a window keeps its own first rows and no more are exchanged
# (Spark's WindowGroupLimit has the same bound by default).
FEW_ROWS = 1000


def limit_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int | None
) -> DataFrame:
    """First ``limit`` rows of each key; 0 or None keeps all.

    For few rows a window that is limited on the map side; a key's rows from all tasks are then
    few too. Many rows are numbered by range, so that no task gets all of a key.
    """
    if not limit:
        return df
    if limit > FEW_ROWS:
        return numbered(df, keys, order, "_n").filter(F.col("_n") <= limit).drop("_n")
    first = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", first).filter(F.col("_n") <= limit).drop("_n")
