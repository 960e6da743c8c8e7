"""Where converted documents go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import columns as C


def plan_outputs(docs: DataFrame, out: str | None = None, path: str = "path", many: bool = True) -> DataFrame:
    """Adds `target`: null for standard output, else a file.

    `out` is '-', a file, or a folder (ending in '/', or when there are many
    inputs). Without it, many inputs go to files beside them and one goes to
    standard output.
    """
    if out == "-" or (out is None and not many):
        return docs.withColumn("target", F.lit(None).cast("string"))
    if out is None:
        return docs.withColumn("target", F.concat(F.regexp_replace(F.col(path), r"(?<=[^/])\.[^./]*$", ""), F.lit(".md")))
    if many or out.endswith("/"):
        return docs.withColumn("target", F.concat(F.lit(out.rstrip("/") + "/"), C.output_name(path)))
    return docs.withColumn("target", F.lit(out))


def write_table(converted: DataFrame, path: str, force: bool = False) -> None:
    """Converted documents as Parquet; an existing table is only replaced with `force`."""
    converted.write.mode("overwrite" if force else "errorifexists").parquet(path)


def write_markdown(converted: DataFrame, force: bool = False) -> None:
    """One file for each `target`, through Hadoop's file systems, so a path means the same from everywhere.

    A file that exists with another text is an error without `force`. Each goes to
    a temporary name first, so writing again after a failure gives the same files.
    Documents stream through the driver, a partition at a time; write_table is the
    way for very many.
    """
    sc = converted.sparkSession.sparkContext
    jvm, conf = sc._jvm, sc._jsc.hadoopConfiguration()
    rows = converted.where(F.col("target").isNotNull() & F.col("markdown").isNotNull()).select("target", F.encode("markdown", "utf-8").alias("bytes"))
    for row in rows.toLocalIterator():
        target, data = jvm.org.apache.hadoop.fs.Path(row["target"]), bytes(row["bytes"])
        fs = target.getFileSystem(conf)
        if fs.exists(target) and not force and not _holds(jvm, fs, target, data):
            raise FileExistsError(f"Output file already exists: {row['target']}. Use force to overwrite.")
        part = jvm.org.apache.hadoop.fs.Path(target.getParent() or jvm.org.apache.hadoop.fs.Path("."), f".{target.getName()}.part")
        out = fs.create(part, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        fs.delete(target, False)
        if not fs.rename(part, target):
            raise OSError(f"could not write {row['target']}")


def _holds(jvm: object, fs: object, path: object, data: bytes) -> bool:
    if fs.getFileStatus(path).getLen() != len(data):
        return False
    stream = fs.open(path)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)) == data
    finally:
        stream.close()
