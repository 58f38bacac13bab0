"""Session settings the jobs rely on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings for a cluster session; pass them to the builder or to spark-submit.
# Partition counts are left to adaptive execution, which starts from
# spark.sql.adaptive.coalescePartitions.initialPartitionNum and merges downwards.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that spark.checkpoint.dir names."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return folder.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """This application's folder in the shared one; ``remove_written`` deletes it."""
    return f"{shared_folder(spark)}/leafmill-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """A Parquet table in the shared folder that later branches read instead of the plan.

    Unlike a checkpoint its columns are read one by one and its size is known to the planner.
    It stays until :func:`remove_written`, as the caller's lazy result may go on reading it.
    """
    path = f"{run_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Buckets:
    """Tables of the shared folder that are hashed on a key, for the ``with`` block they serve.

    A join on that key leaves such a table where it lies, however often it is joined: only the
    other side is exchanged. There is a file per bucket, sorted by the key. The number of buckets
    is that of the session's shuffle partitions unless given.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None) -> None:
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._tables: list[str] = []

    def __enter__(self) -> Buckets:
        return self

    def table(self, df: DataFrame, name: str, *key: str) -> DataFrame:
        table = f"leafmill_{name}_{uuid.uuid4().hex}"
        self._tables.append(table)
        (
            df.repartition(self.buckets, *key)
            .write.bucketBy(self.buckets, *key)
            .sortBy(*key)
            .option("path", f"{run_folder(self.spark)}/{table}")
            .saveAsTable(table)
        )
        return self.spark.table(table)

    def __exit__(self, *error: object) -> None:
        for table in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            _remove(self.spark, f"{run_folder(self.spark)}/{table}")


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def remove_written(spark: SparkSession) -> None:
    """Delete this application's written tables, once its results have been stored."""
    _remove(spark, run_folder(spark))
