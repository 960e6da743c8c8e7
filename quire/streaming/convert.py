"""Conversion of documents as they arrive. Documents are independent, so the stream keeps no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators.convert import convert


def read_stream(spark: SparkSession, folder: str, files_at_once: int = 1000) -> DataFrame:
    """path, content of the files of a folder, as they come."""
    found = spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", files_at_once).text(folder)
    return found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def convert_stream(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Converts what is there and ends; a later call goes on behind it. Files are converted exactly once."""
    found = convert(read_stream(spark, folder)).drop("content")
    return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
