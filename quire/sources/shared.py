"""Written intermediate tables, and joins that spread hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a key that one task joins, at least; keys that are spread, at most.
TASK_ROWS, SPREAD_KEYS = 512, 10_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named, a local master gets one of its own; a cluster must name it."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quire-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


class Cut:
    """A table written to the shared folder and read back: what follows doesn't know how it was made, and a lost executor costs a re-read."""

    def __init__(self, df: DataFrame, name: str) -> None:
        spark = df.sparkSession
        self.path, self.spark = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", spark
        schema = df.schema
        df.write.parquet(self.path)
        self.table = spark.read.schema(schema).parquet(self.path)

    def drop(self) -> None:
        """Removes the files; nothing may read the table any more."""
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def spread_join(rows: DataFrame, table: DataFrame, key: str, by: Column, total: int | None = None) -> DataFrame:
    """rows joined with table on key, however many rows have one key.

    Rows of a hot key are dealt by a hash of `by` to as many tasks as they need,
    and the table's rows of that key are repeated for each. Only the hot keys, at
    most SPREAD_KEYS of them, are broadcast. rows should be a written table (of
    `total` rows, if that is known), as its keys are counted first.
    """
    bar = max(TASK_ROWS, (rows.count() if total is None else total) // SPREAD_KEYS)
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > bar).select(key, F.ceil(F.col("_n") / bar).cast("int").alias("_tasks"))
    hot = F.broadcast(hot)
    left = rows.join(hot, key, "left").withColumn("_task", F.pmod(F.xxhash64(by), F.coalesce("_tasks", F.lit(1))).cast("int")).drop("_tasks")
    right = table.join(hot, key, "left").withColumn("_task", F.explode(F.sequence(F.lit(0), F.coalesce("_tasks", F.lit(1)) - 1))).drop("_tasks")
    return left.join(right, [key, "_task"]).drop("_task")
