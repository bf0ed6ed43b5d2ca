"""Physically impossible and outlying yields.

Per-crop quartiles are exact order statistics found by position (``operators/quantiles``),
so no crop is gathered in one task, and join back on crop.
A row is flagged when its yield lies outside the 1.5 IQR fence of its crop, or when the
reported yield disagrees with production / area by more than ``tolerance`` t/ha.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outlier_fence(prod: DataFrame, crop: str = "cultivo", value: str = "rendimiento_ton_ha",
                  tolerance: float = 0.5, method: str = "sort") -> DataFrame:
    """``method``: 'sort' (exact order statistics, default), 'count_map' (Spark ``percentile``)
    or 'approx' (``percentile_approx``)."""
    from .quantiles import exact_quantiles
    v = F.col(value)
    if method == "sort":
        fences = exact_quantiles(prod, [crop], value, [0.25, 0.75]).select(
            crop, F.col("q0").alias("_a"), F.col("q1").alias("_b"))
    else:
        q = (F.percentile_approx(v, [0.25, 0.75], 10000) if method == "approx"
             else F.percentile(v, F.array(F.lit(0.25), F.lit(0.75))))
        fences = prod.groupBy(crop).agg(q.alias("_q")).select(crop, F.col("_q")[0].alias("_a"),
                                                              F.col("_q")[1].alias("_b"))
    fences = fences.select(crop, (F.col("_a") - 1.5 * (F.col("_b") - F.col("_a"))).alias("lower_fence"),
                           (F.col("_b") + 1.5 * (F.col("_b") - F.col("_a"))).alias("upper_fence"))
    j = prod.join(fences, crop, "left")
    implied = F.when(F.col("hectareas_sembradas") > 0, F.col("produccion_obtenida_ton") / F.col("hectareas_sembradas"))
    return j.withColumns({
        "is_outlier": (v < F.col("lower_fence")) | (v > F.col("upper_fence")),
        "is_inconsistent": F.coalesce(F.abs(implied - v) > tolerance, F.lit(False)),
    })
