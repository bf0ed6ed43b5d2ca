"""De-duplication and duplicate counting.

Keep-first by key is written as an aggregate, not a window: ``min`` over a struct whose
fields are (is_null(c1), c1, is_null(c2), c2, ...) picks the row that sorts first on all
columns with nulls last.  ``min`` combines map-side, so a key that holds a third of all
rows is reduced in every task before the shuffle instead of landing in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedup_keep_first(df: DataFrame, key: str, order_cols: list[str] | None = None,
                     prefer: str = "first") -> DataFrame:
    """One row per ``key``: the lexicographically first on ``order_cols`` (default: all
    columns in table order), nulls last.  ``prefer='filled'`` first ranks rows by their
    count of non-null cells, descending (the behaviour the original comment describes).
    Rows with a null key are kept as one group, like pandas ``drop_duplicates``."""
    cols = order_cols or df.columns
    fields = []
    if prefer == "filled":
        filled = sum(F.col(c).isNotNull().cast("int") for c in df.columns)
        fields.append((-filled).alias("_filled"))
    for i, c in enumerate(cols):
        fields += [F.col(c).isNull().alias(f"_n{i}"), F.col(c).alias(f"_v{i}")]
    rest = [c for c in df.columns if c not in cols]
    for j, c in enumerate(rest):  # carried along (never decide the order)
        fields.append(F.col(c).alias(f"_r{j}"))
    best = df.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(*fields)).alias("_best"))
    out = []
    for c in df.columns:
        if c in cols:
            out.append(F.col(f"_best._v{cols.index(c)}").alias(c))
        else:
            out.append(F.col(f"_best._r{rest.index(c)}").alias(c))
    return best.select(*out)


def duplicate_report(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows, distinct rows and whole-row duplicates (rows beyond the first copy)."""
    cols = cols or df.columns
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_c"))
    return g.agg(F.sum("_c").cast("bigint").alias("n_rows"),
                 F.count(F.lit(1)).cast("bigint").alias("n_distinct"),
                 F.sum(F.col("_c") - 1).cast("bigint").alias("n_duplicates"))
