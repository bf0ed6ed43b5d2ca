"""Herd economics, cash flow and compliance for a whole table of herds.

Region calibration (A28): mean slope and organic matter of the soils, milk yield and
vaccination of the livestock inventory, credit rate - each at the herd's municipality,
department or national level (no fallback between levels, as in the original), with
constants when the level has no rows.  Then F20-F24 as column arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.agronomy import carrying_capacity, is_subsidised, py_round, subsidised_rate, trunc_int
from ..operators.calibration import _join_level, _levels, request_level
from ..session import small_side
from ..params import CREDIT_SHARE, LIVESTOCK, LIVESTOCK_ALERTS, LIVESTOCK_DEFAULT_RATE, MONTHS_SHORT
from .planner import _t

L = LIVESTOCK


def livestock_calibration(soils: DataFrame, inventory: DataFrame, credit: DataFrame,
                          milk_mode: str = "per_head") -> tuple:
    """Three level tables.  ``milk_mode='per_head'`` (quirk Q4 decided): litres per day over
    cattle head count; ``'literal'`` keeps the original mean of the litres column."""
    s = _levels(soils, [], [F.avg("pendiente_pct").alias("slope"), F.avg("materia_organica_pct").alias("om"),
                            F.count(F.lit(1)).alias("n")])
    if milk_mode == "per_head":
        milk = F.sum("produccion_leche_litros_dia") / F.sum(
            F.when(F.col("produccion_leche_litros_dia").isNotNull(), F.col("poblacion_bovina")))
    else:
        milk = F.avg("produccion_leche_litros_dia")
    i = _levels(inventory, [], [milk.alias("milk"), F.avg("vacunacion_fiebre_aftosa_pct").alias("vac"),
                                F.count(F.lit(1)).alias("n")])
    c = _levels(credit, [], [F.avg("tasa_interes_promedio").alias("rate"), F.count(F.lit(1)).alias("n")])
    return s, i, c


def livestock_economics(herds: DataFrame, soils: DataFrame, inventory: DataFrame, credit: DataFrame,
                        milk_mode: str = "per_head") -> DataFrame:
    s, i, c = livestock_calibration(soils, inventory, credit, milk_mode)
    lvl, d, m = request_level(F.col("departamento"), F.col("municipio"))
    df = _join_level(herds, small_side(s, "soil-levels"), lvl, d, m, [], "ls")
    df = _join_level(df, small_side(i, "inventory-levels"), lvl, d, m, [], "li")
    df = _join_level(df, small_side(c, "credit-levels"), lvl, d, m, [], "lc")
    cattle = F.col("species") == "Bovino"
    purpose = F.col("purpose")
    milk_p = purpose.isin("Leche", "Doble Propósito")
    meat_p = purpose.isin("Carne", "Doble Propósito")
    dual = purpose == "Doble Propósito"
    herd, area = F.col("herd_size"), F.col("farm_area")
    df = df.withColumns({
        "_slope": F.coalesce(F.col("lsslope"), F.lit(L["slope_default"])),
        "_om": F.coalesce(F.col("lsom"), F.lit(L["om_default"])),
        "_milk": F.coalesce(F.col("limilk"), F.lit(L["milk_per_head_default"])),
        "_vac": F.coalesce(F.col("livac"), F.lit(L["vaccination_default"])),
        "_rate0": F.coalesce(F.col("lcrate"), F.lit(LIVESTOCK_DEFAULT_RATE)),
    })
    cap = carrying_capacity(cattle, F.col("_slope"), F.col("_om"))
    milk_day = F.when(cattle & milk_p, herd * L["milking_share"] * F.col("_milk")
                      * F.when(dual, F.lit(L["dual_milk_factor"])).otherwise(F.lit(1.0))).otherwise(F.lit(0.0))
    sold_cattle = F.greatest(F.lit(1), trunc_int(herd * L["meat_share"] *
                                                 F.when(dual, F.lit(L["dual_meat_factor"])).otherwise(F.lit(1.0))))
    meat_kg = (F.when(cattle & meat_p, sold_cattle * L["cattle_kg"])
               .when(~cattle, trunc_int(herd * L["pig_turnover"]) * L["pig_kg"]).otherwise(F.lit(0.0)))
    milk_rev = milk_day * L["milk_days"] * L["milk_price"]
    meat_rev = F.when(cattle, meat_kg * L["cattle_price"]).otherwise(meat_kg * L["pig_price"])
    df = df.withColumns({"_cap": cap, "_milk_day": milk_day, "_meat_kg": meat_kg,
                         "_revenue": F.when(cattle, F.when(milk_p, milk_rev).otherwise(F.lit(0.0))
                                            + F.when(meat_p, meat_rev).otherwise(F.lit(0.0))).otherwise(meat_rev),
                         "_rate": subsidised_rate(F.col("_rate0"), F.col("producer_type"))})
    df = df.withColumns({
        "_cost": herd * F.when(cattle, F.lit(L["cost_head_cattle"])).otherwise(F.lit(L["cost_head_pigs"])),
        "_invest": herd * F.when(cattle, F.lit(L["invest_head_cattle"])).otherwise(F.lit(L["invest_head_pigs"])),
    })
    df = df.withColumn("_credit", F.col("_invest") * CREDIT_SHARE)
    df = df.withColumn("_interest", F.col("_credit") * (F.col("_rate") / 100.0))
    df = df.withColumn("_net", F.col("_revenue") - F.col("_cost") - F.col("_interest"))
    status, alerts = livestock_alerts(cattle, herd, area, F.col("_cap"), F.col("_slope"), F.col("_vac"))
    out = {
        "carrying_capacity_ha": py_round(F.col("_cap"), 2),
        "max_animals_allowed": trunc_int(F.col("_cap") * area),
        "milk_prod_liters_day": py_round(F.col("_milk_day"), 1),
        "meat_sold_kg_year": py_round(F.col("_meat_kg"), 1),
        "gross_revenue": trunc_int(F.col("_revenue")),
        "total_operating_costs": trunc_int(F.col("_cost")),
        "capital_investment": trunc_int(F.col("_invest")),
        "recommended_credit": trunc_int(F.col("_credit")),
        "annual_interest_payment": trunc_int(F.col("_interest")),
        "net_profit": trunc_int(F.col("_net")),
        "margin_pct": py_round(F.when(F.col("_revenue") > 0, F.col("_net") / F.col("_revenue") * 100.0)
                               .otherwise(F.lit(0.0)), 1),
        "roi_pct": py_round(F.when(F.col("_invest") > 0, F.col("_net") / F.col("_invest") * 100.0)
                            .otherwise(F.lit(0.0)), 1),
        "alerts": alerts, "compliance": status,
        "monthly_cash_flow": livestock_cash_flow(cattle, milk_p, dual),
        "interest_rate": py_round(F.col("_rate"), 2),
        "tasa_credito_pct": py_round(F.col("_rate"), 2),
        "lec_finagro_activo": is_subsidised(F.col("producer_type")),
    }
    return df.withColumns(out).select(*herds.columns, *out.keys())


def livestock_alerts(cattle, herd, area, cap, slope, vac):
    """alert texts and status (Crítico > Condicionado > Conforme)."""
    A = LIVESTOCK_ALERTS
    density = F.when(area > 0, herd / area).otherwise(F.lit(0.0))
    max_animals = trunc_int(cap * area).cast("string")
    over = cattle & (density > cap)
    near = cattle & ~over & (density > cap * 0.8)
    pig_crit = ~cattle & (density > L["pig_density_max"])
    vac_low = vac < L["vaccination_min"]
    vac_s = py_round(vac, 2).cast("string")
    alerts = F.array_compact(F.array(
        F.when(over, _t(A["overgrazing"], herd=herd.cast("string"), max=max_animals))
        .when(near, _t(A["near_limit"], density=py_round(density, 2).cast("string")))
        .when(cattle, F.lit(A["sustainable"])),
        F.when(cattle & (slope > 15.0), F.lit(A["slope"])),
        F.when(pig_crit, F.lit(A["pig_density"])),
        F.when(vac_low, _t(A["vaccination_low"], rate=vac_s)).otherwise(_t(A["vaccination_ok"], rate=vac_s))))
    status = (F.when(over | pig_crit | vac_low, "Crítico")
              .when(near | (cattle & (slope > 15.0)), "Condicionado").otherwise("Conforme"))
    return status, alerts


def livestock_cash_flow(cattle, milk_p, dual):
    """milk income every month (30 days), meat income in months 6 and 12 (quirk kept:
    12 x 30 days of milk exceed the 305-day annual figure)."""
    names = F.array(*[F.lit(m) for m in MONTHS_SHORT])

    def month(i):
        half = (i == 5) | (i == 11)
        milk_month = F.col("_milk_day") * L["cash_flow_days"] * L["milk_price"]
        meat_rest = (F.col("_revenue") - F.col("_milk_day") * L["milk_days"] * L["milk_price"]) / 2
        income = (F.when(cattle & milk_p, milk_month + F.when(dual & half, meat_rest).otherwise(F.lit(0.0)))
                  .when(half, F.col("_revenue") / 2).otherwise(F.lit(0.0)))
        cost = F.col("_cost") / 12
        interest = F.col("_interest") / 12
        return F.struct(names[i].alias("mes"), py_round(income).alias("ingresos"), py_round(cost).alias("costos"),
                        py_round(interest).alias("intereses"), py_round(income - cost - interest).alias("neto"))
    return F.transform(F.sequence(F.lit(0), F.lit(11)), month)
