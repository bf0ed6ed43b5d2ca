"""Crop economics for every (parcel, crop) and the crop ranking per parcel.

Yield (pluggable predictor, default base x stress) x zone factor (department, else national),
price from the latest market rows completed with the base table (W4, J14), credit rate of
the department (A26) with the producer subsidy (F14), then column arithmetic (F13) and the
12-month cash flow (F15) as an array of structs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.agronomy import is_subsidised, py_round, subsidised_rate, trunc_int
from ..operators.calibration import crop_price_table, rate_table, with_rate, with_zone_factor, zone_yields
from ..params import CREDIT_SHARE, CROPS, MONTHS_SHORT, OTHER_CROP_ECONOMICS
from .planner import base_stress_predictor, with_crop_params


def crop_economics(requests: DataFrame, production: DataFrame, prices: DataFrame, credit: DataFrame,
                   predictor=None, price_tiebreak: tuple = ("l_orderkey", "l_linenumber")) -> DataFrame:
    """Requests need: cultivo, ph_suelo, altitud_m, pendiente_pct, materia_organica_pct, textura,
    temp_media_c, precipitacion_anual_mm, area_ha, departamento, municipio, producer_type."""
    predictor = predictor or base_stress_predictor()
    df = with_crop_params(requests)
    df = df.withColumn("_y0", predictor(F.col("temp_media_c"), F.col("precipitacion_anual_mm")))
    df = with_zone_factor(df, zone_yields(production), "economics", out="zone_factor")
    price = crop_price_table(prices, tiebreak=price_tiebreak).select(
        F.col("cultivo").alias("_pc"), "precio_kg", "canasta_pct", "demanda_tendencia")
    df = df.join(price, F.col("cultivo") == F.col("_pc"), "left").drop("_pc")
    df = with_rate(df, rate_table(credit), out="_rate0")
    y = F.col("_y0") * F.col("zone_factor")
    prod = y * F.col("area_ha")
    price_kg = F.coalesce(F.col("precio_kg"), F.lit(OTHER_CROP_ECONOMICS[0]))
    # stress factors go by the normalised crop name, cost and cycle by the exact one
    exact = F.col("cultivo") == F.col("cp_crop")
    cost_ha = F.coalesce(F.when(exact, F.col("cp_cost_ha")), F.lit(OTHER_CROP_ECONOMICS[3]))
    df = df.withColumns({
        "_yield": y, "_prod": prod, "_price": price_kg,
        "_cost": cost_ha * F.col("area_ha"),
        "_revenue": prod * 1000 * price_kg,
        "_rate": subsidised_rate(F.col("_rate0"), F.col("producer_type")),
        "_cycle": F.coalesce(F.when(exact, F.col("cp_cycle_months")), F.lit(OTHER_CROP_ECONOMICS[4])),
    })
    df = df.withColumns({"_net": F.col("_revenue") - F.col("_cost"), "_credit": F.col("_cost") * CREDIT_SHARE})
    df = df.withColumn("_interest", F.col("_credit") * (F.col("_rate") / 100))
    out = {
        "yield_ton_ha": py_round(F.col("_yield"), 2),
        "total_production_ton": py_round(F.col("_prod"), 2),
        "precio_kg_cop": trunc_int(F.col("_price")),
        "gross_revenue": trunc_int(F.col("_revenue")),
        "total_cost": trunc_int(F.col("_cost")),
        "net_profit": trunc_int(F.col("_net")),
        "net_profit_after_interest": trunc_int(F.col("_net") - F.col("_interest")),
        "margin_pct": py_round(F.when(F.col("_revenue") > 0, F.col("_net") / F.col("_revenue") * 100)
                               .otherwise(F.lit(0.0)), 1),
        "roi_pct": py_round(F.when(F.col("_cost") > 0, F.col("_net") / F.col("_cost") * 100).otherwise(F.lit(0.0)), 1),
        "recommended_credit": trunc_int(F.col("_credit")),
        "annual_interest": trunc_int(F.col("_interest")),
        "interest_rate": py_round(F.col("_rate"), 2),
        "tasa_credito_pct": py_round(F.col("_rate"), 2),
        "canasta_pct": F.coalesce(F.col("canasta_pct"), F.lit(OTHER_CROP_ECONOMICS[1])),
        "demanda_trend": F.coalesce(F.col("demanda_tendencia"), F.lit(OTHER_CROP_ECONOMICS[2])),
        "zone_factor": py_round(F.col("zone_factor"), 2),
        "lec_finagro_activo": is_subsidised(F.col("producer_type")),
        "monthly_cash_flow": cash_flow(),
        "crop_ord": F.coalesce(F.col("cp_crop_ord"), F.lit(len(CROPS))),
    }
    df = df.withColumns(out)
    keep = [c for c in requests.columns] + [c for c in out if c not in requests.columns]
    return df.select(*keep)


def cash_flow():
    """12 months; revenue split over the harvest months ([cycle-1] if cycle <= 6 else
    months 6 and 12), cost and interest spread evenly; each figure rounded half-even."""
    names = F.array(*[F.lit(m) for m in MONTHS_SHORT])
    cyc = F.col("_cycle")
    n_harvest = F.when(cyc <= 6, F.lit(1)).otherwise(F.lit(2))

    def month(i):
        harvest = F.when(cyc <= 6, i == cyc - 1).otherwise((i == 5) | (i == 11))
        income = F.when(harvest, F.col("_revenue") / n_harvest).otherwise(F.lit(0.0))
        cost = F.col("_cost") / 12
        interest = F.col("_interest") / 12
        return F.struct(names[i].alias("mes"), py_round(income).alias("ingresos"), py_round(cost).alias("costos"),
                        py_round(interest).alias("intereses"), py_round(income - cost - interest).alias("neto"))
    return F.transform(F.sequence(F.lit(0), F.lit(11)), month)


def compare_all_crops(requests: DataFrame, production: DataFrame, prices: DataFrame, credit: DataFrame,
                      request_key: str = "parcel_id", **kw) -> DataFrame:
    """E5: economics of all five crops for each request, ranked by net profit (T6; ties keep
    crop order).  The 5x expansion is a generator on each row (no join)."""
    expanded = (requests.drop("cultivo")
                .withColumn("cultivo", F.explode(F.array(*[F.lit(c) for c in CROPS]))))
    eco = crop_economics(expanded, production, prices, credit, **kw)
    w = Window.partitionBy(request_key).orderBy(F.col("net_profit").desc(), F.col("crop_ord").asc())
    return eco.withColumn("profit_rank", F.row_number().over(w))
