"""Mean imputation.

A per-group mean is a ``groupBy`` (partial aggregation, hot groups are cheap) joined back
on the group key.  Few groups would send the whole wide side to a few tasks, so the group
table is written out and its size measured: it is broadcast when small, and joined by a
(skew-split) shuffle otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..session import small_side


def numeric_columns(df: DataFrame, exclude: tuple = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in exclude]


def group_mean_impute(df: DataFrame, group_col: str, columns: list[str] | None = None) -> DataFrame:
    """``c := coalesce(c, mean(c) within group)`` for every numeric column.

    Rows whose group key is null keep their nulls (pandas transform semantics).
    """
    cols = columns if columns is not None else numeric_columns(df, exclude=(group_col,))
    means = (df.filter(F.col(group_col).isNotNull()).groupBy(group_col)
             .agg(*[F.avg(c).alias(f"_mean_{c}") for c in cols]))
    return with_means(df, means, group_col, cols)


def with_means(df: DataFrame, means: DataFrame, group_col: str, cols: list[str]) -> DataFrame:
    """``df`` with the nulls of ``cols`` filled by ``_mean_<column>`` of ``means``, one row a group."""
    joined = df.join(small_side(means, "group-means"), on=group_col, how="left")
    return joined.select(
        *[(F.coalesce(F.col(c), F.col(f"_mean_{c}")).alias(c) if c in cols else F.col(c)) for c in df.columns])


def global_mean_impute(df: DataFrame, col: str) -> DataFrame:
    """Fill nulls of ``col`` with its overall mean (one-row aggregate, broadcast)."""
    mean = df.agg(F.avg(col).alias("_gm")).withColumn("_one", F.lit(1))
    return (df.withColumn("_one", F.lit(1)).join(F.broadcast(mean), "_one", "left")
            .withColumn(col, F.coalesce(F.col(col), F.col("_gm"))).drop("_gm", "_one"))
