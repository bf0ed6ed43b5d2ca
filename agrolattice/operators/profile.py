"""A3: table quality profile in one pass.

All null counts come from a single aggregate (one scan, partial aggregation); the wide
one-row result is turned into one row per column with ``stack``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_profile(df: DataFrame, name: str = "dataset") -> DataFrame:
    """Per column: total rows, nulls and null percentage (2 decimals; 0 for an empty table)."""
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("_rows")]
    aggs += [F.sum(F.col(c).isNull().cast("bigint")).alias(f"_n{i}") for i, c in enumerate(cols)]
    wide = df.agg(*aggs)
    pairs = ", ".join(f"'{c.replace(chr(39), chr(39) * 2)}', {i}, `_n{i}`" for i, c in enumerate(cols))
    long = wide.selectExpr("_rows", f"stack({len(cols)}, {pairs}) AS (column_name, column_pos, n_nulls)")
    return long.select(
        F.lit(name).alias("dataset"), "column_name", F.col("column_pos").cast("int").alias("column_pos"),
        F.col("_rows").cast("bigint").alias("n_rows"),
        F.coalesce(F.col("n_nulls"), F.lit(0)).cast("bigint").alias("n_nulls"),
        F.when(F.col("_rows") > 0, F.round(100.0 * F.col("n_nulls") / F.col("_rows"), 2))
        .otherwise(F.lit(0.0)).alias("null_pct"))


def table_profile(df: DataFrame) -> DataFrame:
    """One row: rows, cells, nulls, null_share (of all cells) and duplicates (rows that repeat
    an earlier one).  Rows are told apart by a 256-bit digest of all columns, counted with a partial
    aggregate, so that a row that a third of the table repeats is no hot key; an empty table
    has a null share of 0."""
    nulls = sum((F.col(f"`{c}`").isNull().cast("long") for c in df.columns), F.lit(0).cast("long"))
    whole = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)])), 256)
    found = df.select(nulls.alias("_nulls"), whole.alias("_digest")).groupBy("_digest").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_nulls").alias("_nulls"))
    cells = F.col("rows") * len(df.columns)
    total = found.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("_nulls"), F.lit(0)).alias("nulls"),
                      F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))
    return total.select("rows", cells.alias("cells"), "nulls", F.when(cells > 0, F.col("nulls") / cells).otherwise(0.0).alias("null_share"), "duplicates")
