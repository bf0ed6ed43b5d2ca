"""Per-group linear gap fill by row position, then back-fill and forward-fill.

Semantics (pandas ``interpolate('linear').bfill().ffill()`` inside each group): rows are
ordered; a null between two known values takes ``v0 + (v1-v0)*(p-p0)/(p1-p0)`` where p is
the row position; nulls before the first known value take the first one, nulls after the
last take the last one; a group without any value stays null.

Scale design: a plain ``Window.partitionBy(group)`` puts a whole group in one task, and a
hot group (a third of all rows) would serialise the job.  Rows are instead split into
*chunks* - contiguous slices of the whole order (group, order columns, tie-break), cut by a range
partitioning to a target row count - and the scan runs in two levels:

1. inside each chunk (window partitioned by group + chunk): local position, previous and
   next known value (two growing frames, one per direction, both O(n log n));
2. per group and chunk one summary row (count, first and last known value); a window over the
   summaries of a group (rows / target rows: small even for a hot group) gives the chunk's
   row offset and the known values carried in from earlier / later chunks;
3. summaries join back on (group, chunk).  The row side keeps the hash partitioning of
   step 1, so only the small summary side is shuffled again.

Cost: the summary branch re-reads and re-shuffles the projected input once (Spark does not
reuse the exchange across the two branches); every shuffle is keyed by (group, chunk), so
a window holds one chunk of a group: about the target rows, as the cuts come from a sample.  Ranges
are written out once before the windows; a table within the target is not cut at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys where null equals null; the keys come from the left."""
    named = right.select(*[F.col(c).alias(f"_key_{c}") if c in keys else F.col(c) for c in right.columns])
    on = [left[c].eqNullSafe(named[f"_key_{c}"]) for c in keys]
    return left.join(named, on, "left").drop(*[f"_key_{c}" for c in keys])


def auto_chunks(df: DataFrame, group_cols: list[str], order_cols: list[str], target_rows: int) -> DataFrame:
    """Add ``_chunk``: the ranges of (groups, order) into which a range partitioning of about
    ``target_rows`` rows a part cuts the rows.

    The ranges are cut along the whole order, its unique tie-break included, so a burst of rows
    at one instant is cut like any others.  The parts come from a sample, so the rows are written
    out with their range: a lost task must not meet other cuts.  A table of at most
    ``target_rows`` rows is one range, without a shuffle or a write.
    """
    n_chunks = -(-df.count() // target_rows)
    if n_chunks <= 1:
        return df.withColumn("_chunk", F.lit(0))
    ranged = df.repartitionByRange(n_chunks, *group_cols, *order_cols).withColumn("_chunk", F.spark_partition_id())
    return materialize(ranged, "gap_ranges")


def gap_fill_linear(df: DataFrame, group_cols: list[str], order_cols: list[str], measures: list[str],
                    chunk: Column | None = None, target_rows: int = 1_000_000) -> DataFrame:
    """Fill ``measures`` of ``df``; returns all input columns with measures replaced.

    ``order_cols`` must give a total order inside a group (add a unique tie-break).
    Chunks: by default balanced ranges of about ``target_rows`` rows (``auto_chunks``);
    an explicit ``chunk`` Column must be non-decreasing along the order.
    """
    ck = "_chunk"
    rows = df.withColumn(ck, chunk) if chunk is not None else auto_chunks(df, group_cols, order_cols, target_rows)
    part = group_cols + [ck]
    asc = [F.col(c).asc() for c in order_cols]
    desc = [F.col(c).desc() for c in order_cols]
    w_fwd = Window.partitionBy(*part).orderBy(*asc).rowsBetween(Window.unboundedPreceding, 0)
    w_bwd = Window.partitionBy(*part).orderBy(*desc).rowsBetween(Window.unboundedPreceding, 0)

    rows = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*part).orderBy(*asc)))
    # primitive columns only (no structs): the windows stay simple and the summary runs as a
    # hash aggregate
    local = {}
    for m in measures:
        known_pos = F.when(F.col(m).isNotNull(), F.col("_rn"))
        local[f"_pp_{m}"] = F.last(known_pos, ignorenulls=True).over(w_fwd)
        local[f"_pv_{m}"] = F.last(F.col(m), ignorenulls=True).over(w_fwd)
        local[f"_np_{m}"] = F.last(known_pos, ignorenulls=True).over(w_bwd)
        local[f"_nv_{m}"] = F.last(F.col(m), ignorenulls=True).over(w_bwd)
    rows = rows.withColumns(local)

    # level 2: one summary row per (group, chunk), from the same windowed rows
    aggs = [F.count(F.lit(1)).alias("_n")]
    for m in measures:
        known_pos = F.when(F.col(m).isNotNull(), F.col("_rn"))
        aggs += [F.min(known_pos).alias(f"_fp_{m}"), F.min_by(F.col(m), known_pos).alias(f"_fv_{m}"),
                 F.max(known_pos).alias(f"_lp_{m}"), F.max_by(F.col(m), known_pos).alias(f"_lv_{m}")]
    summ = rows.groupBy(*part).agg(*aggs)
    w_c = Window.partitionBy(*group_cols).orderBy(ck)
    before = w_c.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*group_cols).orderBy(F.col(ck).desc()).rowsBetween(Window.unboundedPreceding, -1)
    summ = summ.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    carried = {}
    for m in measures:
        carried[f"_ipp_{m}"] = F.last(F.col("_off") + F.col(f"_lp_{m}"), ignorenulls=True).over(before)
        carried[f"_ipv_{m}"] = F.last(F.col(f"_lv_{m}"), ignorenulls=True).over(before)
        carried[f"_inp_{m}"] = F.last(F.col("_off") + F.col(f"_fp_{m}"), ignorenulls=True).over(after)
        carried[f"_inv_{m}"] = F.last(F.col(f"_fv_{m}"), ignorenulls=True).over(after)
    summ = summ.withColumns(carried).select(*part, "_off", *carried.keys())

    out = _null_safe(rows, summ, part)
    pos = F.col("_off") + F.col("_rn")
    filled = {}
    no_group = F.greatest(*[F.col(c).isNull() for c in group_cols], F.lit(False))
    for m in measures:
        prev_p = F.coalesce(F.col("_off") + F.col(f"_pp_{m}"), F.col(f"_ipp_{m}"))
        prev_v = F.coalesce(F.col(f"_pv_{m}"), F.col(f"_ipv_{m}"))
        next_p = F.coalesce(F.col("_off") + F.col(f"_np_{m}"), F.col(f"_inp_{m}"))
        next_v = F.coalesce(F.col(f"_nv_{m}"), F.col(f"_inv_{m}"))
        filled[m] = (F.when(F.col(m).isNotNull(), F.col(m))
                     .when(prev_p.isNotNull() & next_p.isNotNull(),
                           prev_v + (next_v - prev_v) * (pos - prev_p) / (next_p - prev_p))
                     .when(prev_p.isNotNull(), prev_v)
                     .otherwise(next_v))
        # rows without a group are no series: like the original, they come out null
        filled[m] = F.when(no_group, F.lit(None)).otherwise(filled[m])
    keep = [c for c in df.columns]
    return out.withColumns(filled).select(*keep)
