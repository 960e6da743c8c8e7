"""Session helpers shared by the operators: table access and lineage cuts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word contract: blank and the control characters 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named, a local master gets one of its own; a cluster must name it."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        named = sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quire-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    Lineage ends there, so a lost executor costs a re-read and not a
    recomputation, and what follows sees one fixed set of rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._quire_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Remove the files of a table made by cut() that nothing reads any more."""
    path = getattr(df, "_quire_path", None)
    if path:
        jvm, jsc = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


def n_words(text) -> F.Column:
    """Number of words as a column expression; null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(df: DataFrame, group: list[str], order: list, out: str, slice_rows: int = 20_000) -> DataFrame:
    """Gapless numbers from 0 within each group, without one task per group.

    A group is dealt to as many slices as its size asks for; slice offsets are
    running sums over a small table of counts, and only the rows of a slice
    meet in one task. `order` must end in a total order of distinct rows; equal
    rows are interchangeable.
    """
    total = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", F.greatest(F.lit(1), F.ceil(F.col("_n") / slice_rows)).cast("int"))
    dealt = df.join(total.select(*group, "_k"), group).withColumn("_slice", F.when(F.col("_k") == 1, 0).otherwise(F.pmod(F.xxhash64(*order), F.col("_k"))).cast("int"))
    from pyspark.sql import Window

    counts = dealt.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.withColumn("_before", F.sum("_c").over(Window.partitionBy(*group).orderBy("_slice")) - F.col("_c")).drop("_c")
    rank = F.row_number().over(Window.partitionBy(*group, "_slice").orderBy(*order)) - 1
    return dealt.join(before, [*group, "_slice"]).withColumn(out, (F.col("_before") + rank).cast("long")).drop("_k", "_slice", "_before")


#: A key with more rows than this may be hot; at most so many keys are handed to all tasks.
HOT_ROWS, HOT_KEYS = 512, 10_000


def looked_up(rows: DataFrame, found: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """rows joined with found, which has one row for each key and in `n` the number of rows that have it.

    Rows of hot keys meet what is found in a broadcast join and stay where they
    are, so no task gathers a key. A key is hot above total / HOT_KEYS rows, where
    total is the number of rows: HOT_KEYS keys at most. The others are joined as
    they come. Both tables should be written ones, as each is read twice.
    """
    bar = max(HOT_ROWS, total // HOT_KEYS)
    hot = F.broadcast(found.where(F.col(n) > bar))
    cold = rows.join(F.broadcast(found.where(F.col(n) > bar).select(key)), key, "left_anti").join(found.where(F.col(n) <= bar), key)
    return rows.join(hot, key).unionByName(cold)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A mapInArrow function that gives its memory back when a partition is done.

    Python workers wait for later stages with all that their allocators keep;
    several of them share an executor's memory with its JVM.
    """

    def lean_run(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            del batches
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return lean_run
