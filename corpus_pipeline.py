"""Documents to training shards in five stages, one operator each.

1. ``language``: documents whose language is not told, or not without ambiguity, go.
2. ``near_duplicates``: one document of each group of near copies stays (five-word
   shingles, similarity 0.8).
3. ``decontamination``: documents that overlap a benchmark item go.
4. ``mixing``: sources are brought to their target weights; of each leaf whole documents are
   taken up to its budget, none twice.
5. ``sharding``: what is left moves from 32 old shards into 40 of equal size with the fewest
   bytes moved, is written there and read back with its shard and slot.

Each stage works on all rows of the one before. A classifier cannot be written in SQL, so
there is no SQL for the whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import decontam, language, mixing, neardup, queries, sharding
from leafmill.llm.common import shared_folder

MIX_SHARE = 0.9
# Rows go to Python workers in batches of so many bytes: with long documents the batches of several
# workers, on both sides, would else take a good part of an executor.
ARROW_BYTES = 8 << 20
ORACLE_SQL = None


def _bound_batches(spark: SparkSession) -> None:
    """For the session's further queries; results do not depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bound_batches(spark)
    return language.keep_identified(docs, language.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bound_batches(spark)
    return neardup.keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # whole rows go through as one column: the mix's own columns replace none of them
    whole = docs.select("doc_id", "text", "lang", "source", F.struct(docs.columns).alias("whole"))
    mixed = mixing.mix(
        whole, queries.mix_levels(), queries.MIX_WEIGHTS, budget_share=MIX_SHARE, max_epochs=1
    )
    return mixed.select("whole.*")


def reshard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    sharding.reshard(docs, queries.old_shard(), queries.OLD_SHARDS, queries.SHARDS, path)
    return sharding.read_shards(docs, path).withColumn("size", sharding.row_size(F.col("text")))


STAGES = [
    ("language", identify_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", reshard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what a stage returns is written down before the next."""
    queries.find_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
