"""Region calibration tables for request scoring.

A request names a department and a municipality, or "Todos" for either.  Each calibration
is one aggregate with GROUPING SETS over (municipality, department, national) levels, so a
single scan serves every request level; requests join it on (level, keys) with null-safe
equality, and the fallback rules are ``coalesce`` chains over the joined levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import (CROP_DEFAULT_RATE, DEFAULT_RAIN_FRACTION, DEFAULT_TEMP_DIFF, LATEST_PRICE_ROWS,
                      ECON_ZONE_CLAMP, OTHER_CROP_ECONOMICS, PLANNER_ZONE_CLAMP, PRICE_FLOOR_COP, TEMP_BASE_VALID, crop_params_df)
from ..session import small_side
from .topk import top_n_per_group

ALL = "Todos"
LVL_MUN, LVL_DEPT, LVL_NAT = 0, 1, 3


def request_level(dept: Column, mun: Column) -> tuple:
    """(level, dept key, mun key) of a request; "Todos" widens the level."""
    has_d = dept.isNotNull() & (dept != ALL)
    has_m = has_d & mun.isNotNull() & (mun != ALL)
    level = F.when(has_m, LVL_MUN).when(has_d, LVL_DEPT).otherwise(LVL_NAT)
    return level, F.when(has_d, F.lower(dept)), F.when(has_m, F.lower(mun))


def _levels(df: DataFrame, extra: list[str], aggs: list[Column], dept: str = "departamento",
            mun: str = "municipio") -> DataFrame:
    """Aggregate at (extra + dept + mun), (extra + dept) and (extra) in one pass."""
    base = df.withColumn("_d", F.lower(F.col(dept))).withColumn("_m", F.lower(F.col(mun)))
    sets = [extra + ["_d", "_m"], extra + ["_d"], extra]
    cols = extra + ["_d", "_m"]
    # extra keys are never rolled up, so the id is 0 (municipality), 1 (department) or 3 (national)
    g = base.groupingSets(sets, *cols).agg(*aggs, F.grouping_id(*cols).alias("_lvl"))
    return g


def _join_level(req: DataFrame, table: DataFrame, level: Column, d: Column, m: Column, extra: list[str],
                prefix: str) -> DataFrame:
    t = table.select(*[F.col(c).alias(f"{prefix}{c}") for c in table.columns])
    cond = ((F.lit(True) if level is None else (level == F.col(f"{prefix}_lvl")))
            & d.eqNullSafe(F.col(f"{prefix}_d")) & m.eqNullSafe(F.col(f"{prefix}_m")))
    for e in extra:
        cond = cond & (F.col(e) == F.col(f"{prefix}{e}"))
    return req.join(t, cond, "left")


# ---------------------------------------------------------------- A27: monthly climate
def climate_calibration(climate: DataFrame, date_col: str = "fecha", rain: str = "precipitacion_diaria_mm",
                        temp: str = "temperatura_promedio_c") -> DataFrame:
    """Per level and place: 12-slot rain fractions and temperature differences, the usable
    temperature base and whether any climate rows exist (A27, quirk Q9 kept: months without
    data keep the default profile)."""
    df = climate.withColumn("_mes", F.month(F.col(date_col))).where(F.col("_mes").isNotNull())
    monthly = _levels(df, ["_mes"], [
        F.coalesce(F.sum(rain), F.lit(0.0)).alias("_rain"), F.avg(temp).alias("_tmean"),
        F.sum(temp).alias("_tsum"), F.count(temp).alias("_tn"), F.count(F.lit(1)).alias("_rows")])
    return _monthly_profile(monthly)


def calibration_of_sums(sums: DataFrame, month: str = "mes", rain: str = "rain_sum", temp: str = "temp_sum",
                        temp_n: str = "temp_n") -> DataFrame:
    """``climate_calibration`` from sums and counts kept by place and month (a feed's state),
    several rows for one key included: they add up."""
    df = sums.withColumn("_mes", F.col(month)).where(F.col("_mes").isNotNull())
    monthly = _levels(df, ["_mes"], [
        F.coalesce(F.sum(rain), F.lit(0.0)).alias("_rain"), F.sum(temp).alias("_tsum"), F.sum(temp_n).alias("_tn")])
    return _monthly_profile(monthly.withColumn("_tmean", F.when(F.col("_tn") > 0, F.col("_tsum") / F.col("_tn"))))


def _monthly_profile(monthly: DataFrame) -> DataFrame:
    per = monthly.groupBy("_lvl", "_d", "_m").agg(
        F.sum("_rain").alias("_total_rain"), F.try_divide(F.sum("_tsum"), F.sum("_tn")).alias("_temp_real"),
        F.avg("_tmean").alias("_tglobal"),
        *[F.max(F.when(F.col("_mes") == i, F.col("_rain"))).alias(f"_r{i}") for i in range(1, 13)],
        *[F.max(F.when(F.col("_mes") == i, F.col("_tmean"))).alias(f"_t{i}") for i in range(1, 13)],
        *[F.max(F.when(F.col("_mes") == i, F.lit(True))).alias(f"_p{i}") for i in range(1, 13)])
    frac = F.array(*[F.when((F.col("_total_rain") > 0) & F.col(f"_p{i}").isNotNull(),
                            F.col(f"_r{i}") / F.col("_total_rain")).otherwise(F.lit(DEFAULT_RAIN_FRACTION[i - 1]))
                     for i in range(1, 13)])
    diff = F.array(*[F.when(F.col("_tglobal").isNotNull() & F.col(f"_p{i}").isNotNull(),
                            F.col(f"_t{i}") - F.col("_tglobal")).otherwise(F.lit(DEFAULT_TEMP_DIFF[i - 1]))
                     for i in range(1, 13)])
    lo, hi = TEMP_BASE_VALID
    tbase = F.when((F.col("_temp_real") >= lo) & (F.col("_temp_real") <= hi), F.col("_temp_real"))
    return per.select("_lvl", "_d", "_m", frac.alias("rain_fraction"), diff.alias("temp_diff"),
                      tbase.alias("temp_base_calibrated"), F.lit(True).alias("has_climate"))


def with_climate_calibration(req: DataFrame, calib: DataFrame, dept: str = "departamento",
                             mun: str = "municipio") -> DataFrame:
    """Attach the request's level calibration (defaults when the level has no rows)."""
    lvl, d, m = request_level(F.col(dept), F.col(mun))
    j = _join_level(req, small_side(calib, "climate-levels"), lvl, d, m, [], "cc")
    return (j.withColumn("rain_fraction", F.coalesce(F.col("ccrain_fraction"),
                                                     F.array(*[F.lit(x) for x in DEFAULT_RAIN_FRACTION])))
            .withColumn("temp_diff", F.coalesce(F.col("cctemp_diff"), F.array(*[F.lit(x) for x in DEFAULT_TEMP_DIFF])))
            .withColumn("temp_base_calibrated", F.col("cctemp_base_calibrated"))
            .withColumn("has_climate", F.coalesce(F.col("cchas_climate"), F.lit(False)))
            .drop(*[c for c in j.columns if c.startswith("cc")]))


# ---------------------------------------------------------------- A25: zone yield factor
def zone_yields(production: DataFrame, crop: str = "cultivo", value: str = "rendimiento_ton_ha") -> DataFrame:
    """Mean yield per (crop, dept, mun), (crop, dept) and (crop), crop lower-cased."""
    df = production.withColumn("_c", F.lower(F.col(crop)))
    return _levels(df, ["_c"], [F.avg(value).alias("real_avg"), F.count(F.lit(1)).alias("n")])


def with_zone_factor(req: DataFrame, zones: DataFrame, mode: str, crop: str = "cultivo",
                     dept: str = "departamento", mun: str = "municipio", out: str = "zone_factor") -> DataFrame:
    """P4(c) + A25.  ``mode='planner'``: municipality, else its department, clamp 0.5-2.5;
    ``mode='economics'``: department, else national, clamp 0.6-2.0.  No rows -> 1.0."""
    params = crop_params_df(req.sparkSession).select(F.lower("cultivo").alias("_pc"), F.col("base_yield").alias("_nat"))
    lvl, d, m = request_level(F.col(dept), F.col(mun))
    r = req.withColumn("_c", F.lower(F.col(crop))).withColumn("_rl", lvl).withColumn("_rd", d).withColumn("_rm", m)
    # one row per level and place: few keys, so a shuffle would send all requests to a few tasks
    z = small_side(zones.where(F.col("n") > 0), "zones")
    r = _join_level(r, z.where(F.col("_lvl") == LVL_MUN), None, F.col("_rd"), F.col("_rm"), ["_c"], "zm")
    r = _join_level(r, z.where(F.col("_lvl") == LVL_DEPT), None, F.col("_rd"), F.lit(None).cast("string"),
                    ["_c"], "zd")
    r = _join_level(r, z.where(F.col("_lvl") == LVL_NAT), None, F.lit(None).cast("string"),
                    F.lit(None).cast("string"), ["_c"], "zn")
    if mode == "planner":
        lo, hi = PLANNER_ZONE_CLAMP
        real = (F.when(F.col("_rl") == LVL_MUN, F.coalesce(F.col("zmreal_avg"), F.col("zdreal_avg")))
                .when(F.col("_rl") == LVL_DEPT, F.col("zdreal_avg")).otherwise(F.col("znreal_avg")))
        found = (F.when(F.col("_rl") == LVL_MUN, F.col("zmn").isNotNull() | F.col("zdn").isNotNull())
                 .when(F.col("_rl") == LVL_DEPT, F.col("zdn").isNotNull()).otherwise(F.col("znn").isNotNull()))
    else:
        lo, hi = ECON_ZONE_CLAMP
        real = F.when(F.col("_rl") != LVL_NAT, F.coalesce(F.col("zdreal_avg"), F.col("znreal_avg"))) \
            .otherwise(F.col("znreal_avg"))
        found = F.when(F.col("_rl") != LVL_NAT, F.col("zdn").isNotNull() | F.col("znn").isNotNull()) \
            .otherwise(F.col("znn").isNotNull())
    r = r.join(F.broadcast(params), F.col("_c") == F.col("_pc"), "left")
    nat = F.coalesce(F.col("_nat"), F.lit(OTHER_CROP_ECONOMICS[5]))
    factor = F.when(found, F.least(F.greatest(real / nat, F.lit(lo)), F.lit(hi))).otherwise(F.lit(1.0))
    r = r.withColumn(out, factor).withColumn(f"{out}_found", found)
    internal = {"_c", "_rl", "_rd", "_rm", "_pc", "_nat"}
    added = [c for c in r.columns if c not in req.columns and (c in internal or c.startswith(("zm", "zd", "zn")))]
    return r.drop(*added)


# ---------------------------------------------------------------- A26: interest rate
def rate_table(credit: DataFrame, rate: str = "tasa_interes_promedio") -> DataFrame:
    df = credit.withColumn("_d", F.lower(F.col("departamento")))
    g = df.groupingSets([["_d"], []], "_d").agg(F.avg(rate).alias("rate"), F.count(F.lit(1)).alias("n"),
                                              F.grouping_id("_d").alias("_lvl"))
    return g


def with_rate(req: DataFrame, rates: DataFrame, default: float = CROP_DEFAULT_RATE, dept: str = "departamento",
              out: str = "interest_rate") -> DataFrame:
    """Mean credit rate of the request's department (all departments for "Todos"); default
    when no rows."""
    d = F.when(F.col(dept).isNotNull() & (F.col(dept) != ALL), F.lower(F.col(dept)))
    lvl = F.when(d.isNotNull(), 0).otherwise(1)
    t = small_side(rates.select(F.col("_d").alias("_rt_d"), F.col("_lvl").alias("_rt_lvl"), F.col("rate").alias("_rt_rate")), "rates")
    j = req.join(t, (lvl == F.col("_rt_lvl")) & d.eqNullSafe(F.col("_rt_d")), "left")
    return j.withColumn(out, F.coalesce(F.col("_rt_rate"), F.lit(default))).drop("_rt_d", "_rt_lvl", "_rt_rate")


# ---------------------------------------------------------------- W4 + J14: prices
def latest_price_table(prices: DataFrame, n: int = LATEST_PRICE_ROWS, date_col: str = "fecha",
                       crop: str = "cultivo", price: str = "precio_kg_promedio_cop",
                       tiebreak: tuple = ("l_orderkey", "l_linenumber")) -> DataFrame:
    """Mean of the latest ``n`` price rows per crop (rows with a date), floor 100 COP."""
    df = prices.where(F.col(date_col).isNotNull() & F.col(crop).isNotNull())
    order = [F.col(date_col).desc()] + [F.col(c).desc() for c in tiebreak]
    top = top_n_per_group(df, [crop], order, n, list(tiebreak))
    return top.groupBy(crop).agg(F.greatest(F.avg(price), F.lit(PRICE_FLOOR_COP)).alias("live_price_kg"))


def crop_price_table(prices: DataFrame, **kw) -> DataFrame:
    """Base table completed with live prices; crops only seen live get default basket
    and trend (full outer join on crop)."""
    spark = prices.sparkSession
    live = latest_price_table(prices, **kw)
    base = crop_params_df(spark).select("cultivo", "price_kg", "basket_pct", "demand_trend")
    j = base.join(live, "cultivo", "full")
    return j.select("cultivo", F.coalesce("live_price_kg", "price_kg").alias("precio_kg"),
                    F.coalesce("basket_pct", F.lit(OTHER_CROP_ECONOMICS[1])).alias("canasta_pct"),
                    F.coalesce("demand_trend", F.lit(OTHER_CROP_ECONOMICS[2])).alias("demanda_tendencia"))


# ---------------------------------------------------------------- A19: planner defaults
NUMERIC_DEFAULTS = ["altitud_m", "ph_suelo", "pendiente_pct", "materia_organica_pct", "temp_media_c",
                    "precipitacion_anual_mm"]


def hierarchical_defaults(master: DataFrame, requests: DataFrame) -> DataFrame:
    """Parcel defaults for (dept, mun, crop) requests from the master table: means and
    modal texture of the region+crop rows, else of the region rows, else constants; then
    clamped to the input limits.  Region = dept and/or mun (each may be "Todos")."""
    from ..params import PARCEL_LIMITS, PLANNER_DEFAULTS
    df = (master.withColumn("_d", F.lower("departamento")).withColumn("_m", F.lower("municipio"))
          .withColumn("_c", F.lower("cultivo")))
    keys = ["_d", "_m", "_c"]
    sets = [["_d", "_m", "_c"], ["_d", "_c"], ["_m", "_c"], ["_c"], ["_d", "_m"], ["_d"], ["_m"], []]
    # the finest level first, from sums and counts: the eight levels then expand a small table,
    # not the master rows
    fine = df.groupBy(*keys, "textura").agg(
        *[F.sum(c).alias(f"_s_{c}") for c in NUMERIC_DEFAULTS], *[F.count(c).alias(f"_n_{c}") for c in NUMERIC_DEFAULTS],
        F.count(F.lit(1)).alias("_rows"))
    by_texture = fine.groupingSets([[*s, "textura"] for s in sets], *keys, "textura").agg(
        F.sum("_rows").alias("_rows"), *[F.sum(f"_{x}_{c}").alias(f"_{x}_{c}") for x in "sn" for c in NUMERIC_DEFAULTS],
        F.grouping_id(*keys, "textura").alias("_g2"))
    top = F.min(F.when(F.col("textura").isNotNull(), F.struct((-F.col("_rows")).alias("r"), F.col("textura").alias("t"))))
    g = by_texture.groupBy(F.shiftright("_g2", 1).alias("_gid"), *keys).agg(
        *[(F.sum(f"_s_{c}") / F.sum(f"_n_{c}")).alias(c) for c in NUMERIC_DEFAULTS], top["t"].alias("textura"),
        F.sum("_rows").alias("n"))
    g = small_side(g, "defaults")
    r = (requests.withColumn("_rd", F.when(F.col("departamento") != ALL, F.lower("departamento")))
         .withColumn("_rm", F.when(F.col("municipio") != ALL, F.lower("municipio")))
         .withColumn("_rc", F.lower("cultivo")))

    def gid(has_d, has_m, has_c):  # grouping_id bit = 1 when the key is rolled up
        return (0 if has_d else 4) + (0 if has_m else 2) + (0 if has_c else 1)

    rd, rm = F.col("_rd").isNotNull(), F.col("_rm").isNotNull()
    crop_gid = F.when(rd & rm, gid(1, 1, 1)).when(rd, gid(1, 0, 1)).when(rm, gid(0, 1, 1)).otherwise(gid(0, 0, 1))
    reg_gid = F.when(rd & rm, gid(1, 1, 0)).when(rd, gid(1, 0, 0)).when(rm, gid(0, 1, 0)).otherwise(gid(0, 0, 0))
    cols = NUMERIC_DEFAULTS + ["textura", "n"]

    def pick(prefix, gid_col, with_crop):
        t = g.select(*[F.col(c).alias(prefix + c) for c in g.columns])
        cond = ((F.col(prefix + "_gid") == gid_col) & F.col("_rd").eqNullSafe(F.col(prefix + "_d"))
                & F.col("_rm").eqNullSafe(F.col(prefix + "_m")))
        if with_crop:
            cond = cond & (F.col("_rc") == F.col(prefix + "_c"))
        return t, cond

    tc, cc = pick("c_", crop_gid, True)
    tr, cr = pick("r_", reg_gid, False)
    j = r.join(tc, cc, "left").join(tr, cr, "left")
    use_c, use_r = F.col("c_n").isNotNull(), F.col("r_n").isNotNull()
    out = {}
    for c in NUMERIC_DEFAULTS:
        v = F.when(use_c, F.col("c_" + c)).when(use_r, F.col("r_" + c)).otherwise(F.lit(PLANNER_DEFAULTS[c]))
        lo, hi = PARCEL_LIMITS[c]
        if c == "altitud_m":
            v = v.cast("bigint").cast("double")  # int() of the mean, before the clamp
        out["default_" + c] = F.least(F.greatest(v, F.lit(lo)), F.lit(hi))
    out["default_textura"] = (F.when(use_c, F.col("c_textura")).when(use_r, F.col("r_textura"))
                              .otherwise(F.lit(PLANNER_DEFAULTS["textura"])))
    out["default_source"] = F.when(use_c, "region_crop").when(use_r, "region").otherwise("constants")
    j = j.withColumns(out)
    return j.select(*requests.columns, *out.keys())
