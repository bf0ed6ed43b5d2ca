"""Top-N rows per group without a single-task hot group.

``row_number().over(partitionBy(group))`` sends a whole group to one task.  Here the
group is first split into ``buckets`` by a hash of its unique tie-break columns; each
(group, bucket) keeps its own top N (exact: the group's top N is contained in the union of
the buckets' top N), then a second window ranks at most ``buckets * N`` rows per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n_per_group(df: DataFrame, group_cols: list[str], order: list[Column], n: int,
                    tiebreak: list[str], buckets: int = 32, rank_col: str = "rank") -> DataFrame:
    """Keep the first ``n`` rows of every group under ``order`` (which must end with a unique
    tie-break); adds ``rank_col`` (1..n)."""
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in tiebreak]), F.lit(buckets))
    staged = df.withColumn("_salt", salt)
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order)
    staged = staged.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= n)
    w2 = Window.partitionBy(*group_cols).orderBy(*order)
    return (staged.withColumn(rank_col, F.row_number().over(w2)).where(F.col(rank_col) <= n)
            .drop("_salt", "_r1"))


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """Global top N - ``orderBy().limit()`` plans as TakeOrderedAndProject (a bounded
    heap per task, no global sort)."""
    return df.orderBy(*order).limit(n)
