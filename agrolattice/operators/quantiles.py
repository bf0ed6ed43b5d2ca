"""Exact per-group quantiles without gathering a group in one task.

Spark's ``percentile`` keeps a value -> count map per group in one task's memory, which a
hot group with many distinct values can exhaust.  Here the order statistics are found by
position instead:

1. the non-null values are counted by (group, value) - a partial aggregate, so repeated
   values collapse before anything is shuffled - and the distinct ones range-partitioned and
   sorted by (group, value); range partitioning splits a hot group over many tasks.  The
   result is checkpointed with its partition's number, so the ranges are stable;
2. running counts inside a (partition, group) and a small aggregate per block give each
   value's range of ranks: a window over the blocks of a group (one row per partition)
   gives the offsets;
3. for each quantile ``p`` the two ranks around ``h = (n - 1) p`` are located in their
   block, and a join on (partition, group) with the rank range fetches exactly those values;
4. ``q = x_lo + (h - floor(h)) * (x_hi - x_lo)`` (linear interpolation, as numpy, DuckDB's
   ``quantile_cont`` and Spark's ``percentile``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def exact_quantiles(df: DataFrame, group_cols: list[str], value_col: str, probs: list[float],
                    num_partitions: int | None = None) -> DataFrame:
    """One row per group: ``n`` and ``q0, q1, ...`` for ``probs`` (null values ignored)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    parts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = df.select(*group_cols, F.col(value_col).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    values = base.groupBy(*group_cols, "_v").agg(F.count(F.lit(1)).alias("_c"))
    ordered = (values.repartitionByRange(parts, *group_cols, "_v").withColumn("_pid", F.spark_partition_id())
               .checkpoint(eager=True))
    run = Window.partitionBy("_pid", *group_cols).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    rows = ordered.withColumn("_upto", F.sum("_c").over(run))
    blocks = rows.groupBy("_pid", *group_cols).agg(F.sum("_c").alias("_c"))
    w = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_off", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    totals = blocks.groupBy(*group_cols).agg(F.sum("_c").alias("n"))
    qs = F.array(*[F.struct(F.lit(i).alias("qi"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    need = (totals.withColumn("_q", F.explode(qs))
            .withColumn("_h", (F.col("n") - 1) * F.col("_q.p"))
            .withColumn("_lo", F.floor("_h")).withColumn("_hi", F.ceil("_h"))
            .withColumn("_side", F.explode(F.array(F.lit(0), F.lit(1))))
            .withColumn("_rank", F.when(F.col("_side") == 0, F.col("_lo")).otherwise(F.col("_hi"))))
    b = blocks.select(*[F.col(c).alias("_b" + c) for c in blocks.columns])
    cond = (F.col("_rank") >= F.col("_b_off")) & (F.col("_rank") < F.col("_b_off") + F.col("_b_c"))
    for g in group_cols:
        cond = cond & F.col(g).eqNullSafe(F.col("_b" + g))
    located = need.join(b, cond).select(
        *group_cols, "n", F.col("_q.qi").alias("qi"), "_h", "_lo", "_side", F.col("_b_pid").alias("_pid"),
        (F.col("_rank") - F.col("_b_off")).alias("_idx"))
    r = rows.select(*[F.col(g).alias("_r" + g) for g in group_cols], F.col("_pid").alias("_rpid"),
                    F.col("_upto"), (F.col("_upto") - F.col("_c")).alias("_from"), "_v")
    cond2 = (F.col("_pid") == F.col("_rpid")) & (F.col("_idx") >= F.col("_from")) & (F.col("_idx") < F.col("_upto"))
    for g in group_cols:
        cond2 = cond2 & F.col(g).eqNullSafe(F.col("_r" + g))
    vals = located.join(r, cond2)
    per_q = vals.groupBy(*group_cols, "n", "qi").agg(
        F.first("_h").alias("_h"), F.first("_lo").alias("_lo"),
        F.max(F.when(F.col("_side") == 0, F.col("_v"))).alias("_xlo"),
        F.max(F.when(F.col("_side") == 1, F.col("_v"))).alias("_xhi"))
    per_q = per_q.withColumn("q", F.col("_xlo") + (F.col("_h") - F.col("_lo")) * (F.col("_xhi") - F.col("_xlo")))
    return per_q.groupBy(*group_cols, "n").agg(
        *[F.max(F.when(F.col("qi") == i, F.col("q"))).alias(f"q{i}") for i in range(len(probs))])
