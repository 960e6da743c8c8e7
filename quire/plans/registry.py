"""Queries by name, each with the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import convert as K

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows become documents, dealt to all cores before anything is made of them."""
    return K.spread(table(spark, sf_dir, name))


def tex(*parts: str | Column) -> Column:
    """Strings as they are, columns as their text."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def gathered(rows: DataFrame, key: str, order: str | list[str], part: Column, sep: str = "") -> DataFrame:
    """One text for each key from its rows' parts in order.

    The keys are dealt to a number of parts that stays: what adapts to bytes
    makes a few more parts than cores, and Python's work then takes two rounds.
    """
    order = [order] if isinstance(order, str) else order
    rows = rows.select(F.col(key), *order, part.alias("_part")).repartition(K.python_parts(rows.sparkSession), key)
    parts = F.sort_array(F.collect_list(F.struct(*order, "_part")))
    return rows.groupBy(key).agg(parts.alias("_parts")).select(key, F.array_join(F.transform("_parts", lambda p: p["_part"]), sep).alias("content"))
