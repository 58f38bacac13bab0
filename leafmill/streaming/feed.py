"""Row-local jobs over a feed of pages that arrives as files.

Metadata, links and citations need nothing beyond one page, so the batch functions run
unchanged on a stream, without state or watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.operators.metadata import extract_metadata
from leafmill.sources.pages import PAGE_SCHEMA


def page_stream(spark: SparkSession, folder: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """Page tables dropped into ``folder`` as a streaming DataFrame."""
    return (
        spark.readStream.schema(PAGE_SCHEMA)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .parquet(folder)
    )


def metadata_stream(spark: SparkSession, folder: str) -> DataFrame:
    return extract_metadata(page_stream(spark, folder).select("page_id", "url", "html"))
