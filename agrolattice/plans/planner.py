"""Sowing-month planner for a whole table of parcels.

Per parcel: the region's monthly climate profile (A27) and zone yield factor (A25) are
joined once; the twelve sowing months are then computed *inside the row* as arrays
(``transform`` over 0..11 with the circular 4-month window, W7), so the 12x expansion
(J12) never shuffles, and the best month (W8) is an ``array_max`` over (yield, -month)
structs.  Yields come from a pluggable Column predictor; the default is the crop's base
yield under the physiological stress factors (F3), which SQL can check exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.agronomy import crop_norm, crop_rules, py_round, stressed_yield
from ..operators.calibration import (climate_calibration, request_level, with_climate_calibration,
                                     with_zone_factor, zone_yields)
from ..params import (DEFAULT_DATA_SOURCE, DRY_SOWING_MONTHS, EXPLANATION, EXPLANATION_FACTORS,
                      MONTHS_LONG, OTHER_CROP_ECONOMICS, crop_params_df)

PARAM_COLS = ["ph_min", "ph_max", "ph_sigma", "temp_min", "temp_max", "temp_sigma", "alt_min", "alt_max",
              "alt_sigma", "base_yield", "price_kg", "basket_pct", "demand_trend", "cost_ha", "cycle_months",
              "crop_ord"]


def with_crop_params(df: DataFrame, crop: str = "cultivo", prefix: str = "cp_") -> DataFrame:
    """Attach the crop-parameter row of the normalised crop (broadcast, 5 rows)."""
    p = crop_params_df(df.sparkSession)
    p = p.select(F.col("cultivo").alias(prefix + "crop"), *[F.col(c).alias(prefix + c) for c in PARAM_COLS])
    return df.join(F.broadcast(p), crop_norm(F.col(crop)) == F.col(prefix + "crop"), "left")


def base_stress_predictor(prefix: str = "cp_"):
    """Default yield model: base yield (2.0 for other crops) x stress factors."""
    def predict(temp: Column, rain: Column) -> Column:  # noqa: ARG001 - rain unused by the stress model
        p = {k: F.col(prefix + k) for k in PARAM_COLS}
        base = F.coalesce(F.col(prefix + "base_yield"), F.lit(OTHER_CROP_ECONOMICS[5]))
        return stressed_yield(base, F.col(prefix + "crop").isNotNull(), F.col("ph_suelo"), F.col("altitud_m"),
                              temp, F.col("pendiente_pct"), p)
    return predict


def sowing_plan(parcels: DataFrame, climate: DataFrame | None, production: DataFrame, predictor=None,
                calibration: DataFrame | None = None) -> DataFrame:
    """One row per parcel with ``months`` (12 structs: mes, name, sim_rain, sim_temp, yield),
    best month / yield, zone factor, compliance status and rules, and the explanation.
    ``calibration`` takes the place of the one made from ``climate``."""
    predictor = predictor or base_stress_predictor()
    df = with_climate_calibration(parcels, climate_calibration(climate) if calibration is None else calibration)
    df = with_zone_factor(df, zone_yields(production), "planner", out="zone_yield_factor")
    df = with_crop_params(df)
    temp_base = F.coalesce(F.col("temp_base_calibrated"), F.col("temp_media_c"))
    df = df.withColumn("_tb", temp_base)
    names = F.array(*[F.lit(m) for m in MONTHS_LONG])
    dry = F.array(*[F.lit(m in DRY_SOWING_MONTHS) for m in MONTHS_LONG])

    def month(i):
        fr, td = F.col("rain_fraction"), F.col("temp_diff")
        fsum = fr[i] + fr[(i + 1) % 12] + fr[(i + 2) % 12] + fr[(i + 3) % 12]
        dsum = td[i] + td[(i + 1) % 12] + td[(i + 2) % 12] + td[(i + 3) % 12]
        sim_rain = F.col("precipitacion_anual_mm") * (fsum * 3.0)
        sim_temp = F.col("_tb") + dsum / 4
        y = py_round(predictor(sim_temp, sim_rain) * F.col("zone_yield_factor"), 2)
        return F.struct((i + 1).alias("mes"), names[i].alias("month_name"), sim_rain.alias("sim_rain"),
                        sim_temp.alias("sim_temp"), y.alias("yield"), dry[i].alias("dry"))

    df = df.withColumn("months", F.transform(F.sequence(F.lit(0), F.lit(11)), month))
    best = F.array_max(F.transform("months", lambda s: F.struct(s["yield"].alias("y"), (-s["mes"]).alias("neg"),
                                                                  s["month_name"].alias("name"), s["dry"].alias("dry"))))
    df = df.withColumn("_best", best)
    df = df.withColumn("best_month", F.col("_best.name")).withColumn("best_yield", F.col("_best.y"))
    status, rules = crop_rules(F.col("cultivo"), F.col("ph_suelo"), F.col("altitud_m"), F.col("pendiente_pct"),
                               F.col("_best.dry"), F.col("zone_yield_factor"))
    df = df.withColumn("madr_compliance", status).withColumn("madr_rules", rules)
    df = df.withColumn("data_source", data_source(F.col("has_climate"), F.col("zone_yield_factor_found"),
                                                  F.col("departamento"), F.col("municipio"),
                                                  F.col("zone_yield_factor")))
    df = explanation(df)
    return df.drop("_tb", "_best", *[c for c in df.columns if c.startswith("cp_")])


def data_source(has_climate: Column, has_eva: Column, dept: Column, mun: Column, zone: Column) -> Column:
    where = F.when(mun != "Todos", mun).otherwise(dept)
    clim = F.when(has_climate, F.concat(F.lit("IDEAM calibrado para "), where)).otherwise(F.lit(""))
    eva = F.when(has_eva, F.concat(F.lit(" + EVA zona ("), F.format_string("%.2f", py_round(zone, 2)),
                                   F.lit("x nacional)"))).otherwise(F.lit(""))
    return F.concat(clim, eva)


def _t(template: str, **slots: Column) -> Column:
    """Fill ``{name}`` slots of a fixed template with Columns (concat of pieces)."""
    parts, rest = [], template
    while "{" in rest:
        pre, tail = rest.split("{", 1)
        name, rest = tail.split("}", 1)
        parts += [F.lit(pre), slots[name]]
    parts.append(F.lit(rest))
    return F.concat(*parts)


def explanation(df: DataFrame, model_name: str = "Rendimiento base x factores de estrés fisiológico",
                precision: str = "Modelo determinista, sin ajuste") -> DataFrame:
    """plain-language summary, positive / limiting factors, sources (a struct)."""
    E, X = EXPLANATION, EXPLANATION_FACTORS
    lc = F.lower(F.col("cultivo"))
    ph, alt, slope = F.col("ph_suelo"), F.col("altitud_m"), F.col("pendiente_pct")
    y, m = F.col("best_yield").cast("string"), F.col("best_month")
    alt_s, slope_s = alt.cast("string"), slope.cast("string")
    ph_s = F.format_string("%.1f", py_round(ph, 1))
    cafe = lc.contains("cafe")
    cacao = ~cafe & lc.contains("cacao")
    arroz = ~cafe & ~cacao & lc.contains("arroz")
    intro = (F.when(cafe, F.concat(_t(E["cafe_intro"], y=y, m=m, alt=alt_s),
                                   F.when(ph < 5.0, _t(E["cafe_ph_low"], ph=ph_s))
                                   .when(ph > 6.5, _t(E["cafe_ph_high"], ph=ph_s))
                                   .otherwise(_t(E["cafe_ph_ok"], ph=ph_s))))
             .when(cacao, F.concat(_t(E["cacao_intro"], y=y, m=m, alt=alt_s),
                                   F.when(alt > 1200, F.lit(E["cacao_alt_high"])).otherwise(F.lit(E["cacao_alt_ok"]))))
             .when(arroz, F.concat(_t(E["arroz_intro"], y=y, m=m),
                                   F.when(alt > 1000, _t(E["arroz_alt_high"], alt=alt_s))
                                   .otherwise(F.lit(E["arroz_alt_ok"]))))
             .otherwise(_t(E["other_intro"], y=y, crop=F.col("cultivo"), m=m)))
    dry = F.col("best_month").isin(*DRY_SOWING_MONTHS)
    summary = F.concat(intro, F.when(dry, _t(E["dry"], m=m)).otherwise(_t(E["rainy"], m=m)),
                       F.when(slope > 15, _t(E["slope"], s=slope_s)).otherwise(F.lit("")))
    positives = F.array_compact(F.array(
        F.when(cafe, F.lit(X["cafe_alt"])),
        F.when(cafe & (ph >= 5.0) & (ph <= 6.5), F.lit(X["cafe_ph_ok"])),
        F.when(cacao & (alt <= 1200), F.lit(X["cacao_alt_ok"])),
        F.when(arroz & (alt <= 1000), F.lit(X["arroz_alt_ok"])),
        F.when(~cafe & ~cacao & ~arroz, F.lit(X["other"])),
        F.when(~dry, _t(X["rainy"], m=m)),
        F.when(slope <= 15, _t(X["slope_ok"], s=slope_s))))
    limits = F.array_compact(F.array(
        F.when(cafe & (ph < 5.0), F.lit(X["cafe_ph_low"])).when(cafe & (ph > 6.5), F.lit(X["cafe_ph_high"])),
        F.when(cacao & (alt > 1200), F.lit(X["cacao_alt_high"])),
        F.when(arroz & (alt > 1000), F.lit(X["arroz_alt_high"])),
        F.when(dry, _t(X["dry"], m=m)),
        F.when(slope > 15, _t(X["slope_high"], s=slope_s))))
    src = F.when(F.col("data_source") != "", F.col("data_source")).otherwise(F.lit(DEFAULT_DATA_SOURCE))
    return df.withColumn("xai_explanation", F.struct(
        summary.alias("resumen"), positives.alias("factores_positivos"), limits.alias("factores_limitantes"),
        F.lit(model_name).alias("modelo_base"), F.lit(precision).alias("precision_modelo"),
        src.alias("fuente_datos")))


def sowing_plan_with_model(parcels: DataFrame, climate: DataFrame, production: DataFrame, model,
                           predict, precision: str = "") -> DataFrame:
    """E3 with the MLlib yield ensemble (M12): each sowing month is scored by ``model``
    (``predict(model, df)`` adds ``prediction``), then the stress factors (F3) and the zone
    factor apply.  The 12 months are exploded, scored in one ``transform`` and regrouped per
    parcel (12 rows per group, bounded), then best month, rules and explanation follow.
    ``precision`` is what the explanation says of the model's hold-out accuracy."""
    base = sowing_plan(parcels, climate, production)
    months = base.select("parcel_id", F.explode("months").alias("m"))
    cols = [c for c in parcels.columns if c not in ("temp_media_c", "precipitacion_anual_mm")]
    scored_in = months.join(base.select(*cols, "zone_yield_factor"), "parcel_id").select(
        *cols, "zone_yield_factor", F.col("m.mes").alias("mes"), F.col("m.month_name").alias("month_name"),
        F.col("m.dry").alias("dry"), F.col("m.sim_rain").alias("precipitacion_anual_mm"),
        F.col("m.sim_temp").alias("temp_media_c"), F.col("m.sim_rain").alias("sim_rain"),
        F.col("m.sim_temp").alias("sim_temp"))
    scored = predict(model, with_crop_params(scored_in.withColumn("label", F.lit(0.0))))
    p = {k: F.col("cp_" + k) for k in PARAM_COLS}
    y = stressed_yield(F.col("prediction"), F.col("cp_crop").isNotNull(), F.col("ph_suelo"), F.col("altitud_m"),
                       F.col("temp_media_c"), F.col("pendiente_pct"), p)
    scored = scored.withColumn("yield", py_round(y * F.col("zone_yield_factor"), 2))
    regrouped = scored.groupBy("parcel_id").agg(F.sort_array(F.collect_list(F.struct(
        "mes", "month_name", "sim_rain", "sim_temp", "yield", "dry"))).alias("months_ml"))
    out = base.join(regrouped, "parcel_id").withColumn("months", F.col("months_ml")).drop("months_ml")
    best = F.array_max(F.transform("months", lambda s: F.struct(s["yield"].alias("y"), (-s["mes"]).alias("neg"),
                                                                  s["month_name"].alias("name"), s["dry"].alias("dry"))))
    out = out.withColumn("_best", best).withColumn("best_month", F.col("_best.name")) \
        .withColumn("best_yield", F.col("_best.y"))
    status, rules = crop_rules(F.col("cultivo"), F.col("ph_suelo"), F.col("altitud_m"), F.col("pendiente_pct"),
                               F.col("_best.dry"), F.col("zone_yield_factor"))
    out = out.withColumn("madr_compliance", status).withColumn("madr_rules", rules).drop("xai_explanation")
    return explanation(out, "Ensamble (Random Forest + Gradient Boosting)", precision).drop("_best")
