"""Small helpers that several operators share."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, materialize

__all__ = ["at_most_broadcast", "bounded_sample", "discard", "documents", "materialize", "read_table", "row_key", "text_of"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def text_of(col: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Key of a document row: rows that agree in id and text are one document."""
    return F.xxhash64(F.col(doc_id), F.lit("|"), F.col(text))


def bounded_sample(df: DataFrame, limit: int, *by: str) -> list:
    """At most ``limit`` rows on the driver, the first in a hash order of the columns ``by``:
    the same rows come back whatever the partitioning.  For fitting only."""
    return df.orderBy(F.xxhash64(*by), *by).limit(limit).collect()


def at_most_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` (already written out) with a broadcast hint if it has at most ``max_rows`` rows;
    above that the planner joins by shuffle."""
    return F.broadcast(df) if df.count() <= max_rows else df
