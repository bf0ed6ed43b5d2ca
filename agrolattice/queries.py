"""Registered queries: one per operator group, each ``(spark, sf_dir) -> DataFrame``.

Every query reads whole driver tables through the stand-in views, so its work grows with
the scale factor.  Computed columns carry fixed names that the oracle SQL repeats; doubles
are rounded (4 places, money 2) so the engines' summation orders cannot flip a digit.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from .operators.gapfill import gap_fill_linear
from .operators.impute import group_mean_impute
from .operators.rollup import yearly_climate, yearly_prices
from .operators.dedup import dedup_keep_first, duplicate_report
from .operators.profile import column_profile
from .operators import summaries as S
from .plans import catalog as catalog_plan
from .plans import master as master_plan
from .schemas import ENT
from .session import materialize, source_stamp, spread
from .sources import standins as si
from .sources.tables import catalog_quarantine, read_catalog_files, read_csv_table, write_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Gap-fill chunk size of the registered queries: the library's default.
GAPFILL_TARGET_ROWS = 1_000_000


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _run_id(spark: SparkSession, sf_dir: str) -> str:
    """One stream run per application and state of the source: asked for again, it resumes."""
    state = f"{spark.sparkContext.applicationId}|{sf_dir}|{source_stamp(spark, sf_dir)}"
    return hashlib.md5(state.encode()).hexdigest()[:16]


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every floating column (keeps names and order)."""
    def c(name):
        return F.col("`" + name.replace("`", "``") + "`")
    return df.select(*[F.round(c(f.name), places).alias(f.name)
                       if isinstance(f.dataType, (DoubleType, FloatType)) else c(f.name)
                       for f in df.schema.fields])


# ------------------------------------------------------------------ E1: master table
@register("gap_fill")
def q_gap_fill(spark, sf_dir):
    """W1 on station readings (events): 4 measures filled per station."""
    df = si.station_readings(spark, sf_dir)
    out = gap_fill_linear(df, ["departamento", "municipio"], ["fecha", "seq"], master_plan.CLIMATE_MEASURES,
                          target_rows=GAPFILL_TARGET_ROWS)
    return rounded(out.drop("fecha"), 6)


@register("yearly_rollup")
def q_yearly_rollup(spark, sf_dir):
    """W1 + A1 on the daily climate."""
    return rounded(master_plan.filled_yearly_climate(si.climate_daily(spark, sf_dir), ["fecha", "seq"],
                                                     GAPFILL_TARGET_ROWS), 6)


@register("yearly_prices")
def q_yearly_prices(spark, sf_dir):
    """A2: mean price per (year, crop)."""
    return rounded(yearly_prices(si.prices_weekly(spark, sf_dir)))


@register("group_mean_impute")
def q_group_mean_impute(spark, sf_dir):
    """J3 + W2: production with credit, credit gaps filled by the crop mean."""
    prod = si.production(spark, sf_dir).select("l_orderkey", "l_linenumber", "anio", "departamento",
                                               "municipio", "cultivo")
    cred = si.credit(spark, sf_dir)
    joined = prod.join(cred, ["anio", "departamento", "municipio", "cultivo"], "left")
    out = group_mean_impute(joined, "cultivo", master_plan.CREDIT_COLS)
    return rounded(out, 2)


@register("master_join")
def q_master_join(spark, sf_dir):
    """The consolidated master table."""
    m = master_plan.consolidate(
        si.production(spark, sf_dir), si.soils(spark, sf_dir), si.climate_daily(spark, sf_dir),
        si.credit(spark, sf_dir), si.prices_weekly(spark, sf_dir), si.land_security(spark, sf_dir),
        si.livestock(spark, sf_dir), climate_order=["fecha", "seq"], target_rows=GAPFILL_TARGET_ROWS,
        key_cols=("anio", "l_orderkey", "l_linenumber"))
    return rounded(m, 6)


# ------------------------------------------------------------------ E2: dataset catalog
@register("union_by_name")
def q_union_by_name(spark, sf_dir):
    """Two catalog files with different columns, unioned by name."""
    return si.catalog_raw(spark, sf_dir)


@register("dedup_keep_first")
def q_dedup_keep_first(spark, sf_dir):
    """One row per UID, first on all columns with nulls last."""
    return dedup_keep_first(si.catalog_raw(spark, sf_dir), "UID")


@register("coerce_clean")
def q_coerce_clean(spark, sf_dir):
    """P1 + C1-C5 on the de-duplicated catalog."""
    raw = si.catalog_raw(spark, sf_dir)
    return catalog_plan.type_catalog(catalog_plan.keep_columns(dedup_keep_first(raw, "UID")))


@register("geocode")
def q_geocode(spark, sf_dir):
    """E2 end to end; J7 exact municipality + J8 ordered department substring."""
    cat = catalog_plan.clean_catalog(si.catalog_raw(spark, sf_dir))
    return cat.select("UID", ENT + "Departamento", ENT + "Municipio", "latitud", "longitud")


@register("column_profile")
def q_column_profile(spark, sf_dir):
    """A3: nulls per column of the raw catalog."""
    return column_profile(si.catalog_raw(spark, sf_dir), "catalog_raw")


@register("duplicate_rows")
def q_duplicate_rows(spark, sf_dir):
    """Whole-row duplicates of the raw catalog, all columns compared."""
    return duplicate_report(si.catalog_raw(spark, sf_dir))


@register("csv_by_name")
def q_csv_by_name(spark, sf_dir):
    """Supplier rows written as CSV with the columns in another order, one missing and one
    too many, read back by name through the declared schema."""
    path = _scratch(spark, "csv")
    rows = si.read_table(spark, sf_dir, "supplier")
    write_table(rows.select("s_acctbal", "s_name", F.lit("x").alias("other"), "s_suppkey"), path, fmt="csv")
    return rounded(read_csv_table(spark, path, "s_suppkey long, s_name string, s_region string, s_acctbal double"), 2)


@register("catalog_files")
def q_catalog_files(spark, sf_dir):
    """The raw catalog written as two CSV files with different columns beside an empty
    file, read back and unioned by name."""
    raw = si.catalog_raw(spark, sf_dir)
    short = ["UID", "Número de Filas", "alcance_geografico", "es_viable"]
    paths = [_scratch(spark, "catalog") for _ in range(3)]
    write_table(raw.where("Fuente is null").select(*short, "ds_calidad_datos"), paths[0], fmt="csv")
    write_table(raw.where("Fuente is not null").select("Fuente", *reversed(short)), paths[1], fmt="csv")
    spark.createDataFrame([], "value string").coalesce(1).write.text(paths[2])
    return read_catalog_files(spark, paths)


@register("catalog_quarantine")
def q_catalog_quarantine(spark, sf_dir):
    """Catalog files with an empty one beside them, in which rows without a source lack a
    value; the rows that do not fit their header and the files without one."""
    raw = si.catalog_raw(spark, sf_dir)
    paths = [_scratch(spark, "catalog") for _ in range(2)]
    lines = raw.select(F.concat_ws(",", "UID", "Fuente").alias("UID,Fuente"))
    lines.write.option("header", True).option("sep", "\x01").csv(paths[0])
    spark.createDataFrame([], "value string").coalesce(1).write.text(paths[1])
    return catalog_quarantine(spark, paths).select("problem", "record")


# ------------------------------------------------------------------ summaries (A4-A24, T, W6, P6)
def _catalog(spark, sf_dir, written=None):
    """The clean catalog; with ``written``, the name of a table, written once under it."""
    cat = catalog_plan.clean_catalog(si.catalog_raw(spark, sf_dir))
    return materialize(cat, written) if written else cat


@register("region_summary")
def q_region_summary(spark, sf_dir):
    """A5/A6 per department and per municipality (grouping sets)."""
    return S.region_summary(_catalog(spark, sf_dir))


@register("tier_counts")
def q_tier_counts(spark, sf_dir):
    """A4: datasets per map point with the tier."""
    return S.tier_counts(_catalog(spark, sf_dir))


@register("sample_titles")
def q_sample_titles(spark, sf_dir):
    """Five sample titles per department (salted two-stage top-N)."""
    return S.sample_titles(_catalog(spark, sf_dir))


@register("catalog_kpis")
def q_catalog_kpis(spark, sf_dir):
    """A20 + A24 + P7 headline numbers."""
    return rounded(S.catalog_kpis(_catalog(spark, sf_dir)))


@register("scope_counts")
def q_scope_counts(spark, sf_dir):
    """Datasets per geographic scope."""
    return S.count_by(_catalog(spark, sf_dir), "alcance_geografico", "alcance_geografico")


@register("top_sectors")
def q_top_sectors(spark, sf_dir):
    """Top-10 sectors."""
    return S.top_sectors(_catalog(spark, sf_dir))


@register("band_counts")
def q_band_counts(spark, sf_dir):
    """Quality bands."""
    return S.quality_bands(_catalog(spark, sf_dir))


@register("top_scored")
def q_top_scored(spark, sf_dir):
    """Top-15 by relevance + quality."""
    return rounded(S.top_scored(_catalog(spark, sf_dir)))


@register("selector_values")
def q_selector_values(spark, sf_dir):
    """Selectable departments."""
    return S.selector_values(_catalog(spark, sf_dir))


@register("selector_municipalities")
def q_selector_municipalities(spark, sf_dir):
    """Selectable municipalities."""
    return S.selector_values(_catalog(spark, sf_dir), f"{ENT}Municipio")


@register("suitability_hist")
def q_suitability_hist(spark, sf_dir):
    """Soils per (crop, suitability)."""
    return S.suitability_hist(si.soils(spark, sf_dir))


@register("climate_by_dept")
def q_climate_by_dept(spark, sf_dir):
    """Raw climate means per department."""
    return rounded(S.climate_by_dept(si.climate_daily(spark, sf_dir)))


@register("box_stats")
def q_box_stats(spark, sf_dir):
    """Yield box statistics per (crop, department)."""
    return rounded(S.box_stats(si.production(spark, sf_dir)))


@register("yield_kpis")
def q_yield_kpis(spark, sf_dir):
    """A10."""
    return rounded(S.yield_kpis(si.production(spark, sf_dir)))


@register("sown_vs_harvested")
def q_sown_vs_harvested(spark, sf_dir):
    """A11."""
    return rounded(S.sown_vs_harvested(si.production(spark, sf_dir)))


@register("share_of_total")
def q_share_of_total(spark, sf_dir):
    """Credit per crop and share of total."""
    return rounded(S.credit_share(si.credit(spark, sf_dir)))


@register("livestock_means")
def q_livestock_means(spark, sf_dir):
    """A13."""
    return rounded(S.livestock_means(si.livestock(spark, sf_dir)))


@register("ratio_kpis")
def q_ratio_kpis(spark, sf_dir):
    """Land-security KPIs."""
    return rounded(S.land_kpis(si.land_security(spark, sf_dir)))


@register("hectares_table")
def q_hectares_table(spark, sf_dir):
    """A15 (+T1 order: department asc, hectares desc)."""
    t = S.hectares_table(si.production(spark, sf_dir))
    return rounded(t.orderBy(F.col("departamento").asc(), F.col("hectareas_sembradas").desc(),
                             "municipio", "cultivo"))


@register("hectares_by_crop")
def q_hectares_by_crop(spark, sf_dir):
    """A16."""
    return rounded(S.hectares_by_crop(S.hectares_table(si.production(spark, sf_dir))))


@register("index_ranking")
def q_index_ranking(spark, sf_dir):
    """A17 (+T5 order)."""
    return rounded(S.index_ranking(si.land_security(spark, sf_dir)).orderBy("isj_promedio", "departamento"))


@register("funnel")
def q_funnel(spark, sf_dir):
    """A18."""
    return rounded(S.formalisation_funnel(si.land_security(spark, sf_dir)))


# ------------------------------------------------------------------ planner, economics, livestock
from .functions.agronomy import py_round, rule_route, slope_factor, stress_factor, suitability_score  # noqa: E402
from .operators.calibration import climate_calibration, hierarchical_defaults  # noqa: E402
from .plans import economics as econ_plan  # noqa: E402
from .plans import livestock as livestock_plan  # noqa: E402
from .plans import planner as planner_plan  # noqa: E402


def _plan(spark, sf_dir):
    return planner_plan.sowing_plan(si.parcels(spark, sf_dir), si.climate_daily(spark, sf_dir),
                                    si.production(spark, sf_dir))


@register("stress_yield")
def q_stress_yield(spark, sf_dir):
    """Stress factors and the stressed base yield of each parcel."""
    df = planner_plan.with_crop_params(si.parcels(spark, sf_dir))
    p = {k: F.col("cp_" + k) for k in planner_plan.PARAM_COLS}
    pred = planner_plan.base_stress_predictor()(F.col("temp_media_c"), F.col("precipitacion_anual_mm"))
    return rounded(df.select(
        "parcel_id", "cultivo",
        stress_factor(F.col("ph_suelo"), p["ph_min"], p["ph_max"], p["ph_sigma"]).alias("s_ph"),
        stress_factor(F.col("altitud_m"), p["alt_min"], p["alt_max"], p["alt_sigma"]).alias("s_alt"),
        stress_factor(F.col("temp_media_c"), p["temp_min"], p["temp_max"], p["temp_sigma"]).alias("s_temp"),
        slope_factor(F.col("pendiente_pct")).alias("s_slope"), pred.alias("stressed_yield")))


@register("month_calibration")
def q_month_calibration(spark, sf_dir):
    """The 12 rain fractions and temperature offsets per level (0 municipality, 1
    department, 3 national) and place."""
    cal = climate_calibration(si.climate_daily(spark, sf_dir))
    return rounded(cal.select(F.col("_lvl").cast("int").alias("level"), F.col("_d").alias("departamento"), F.col("_m").alias("municipio"),
                              F.posexplode(F.arrays_zip("rain_fraction", "temp_diff")).alias("i", "v"),
                              "temp_base_calibrated")
                   .select("level", "departamento", "municipio", (F.col("i") + 1).alias("mes"),
                           F.col("v.rain_fraction").alias("rain_fraction"), F.col("v.temp_diff").alias("temp_diff"),
                           "temp_base_calibrated"))


@register("cycle_months")
def q_cycle_months(spark, sf_dir):
    """J12 + W7: the 12 simulated sowing months of every parcel (long form)."""
    plan = _plan(spark, sf_dir)
    return rounded(plan.select("parcel_id", F.explode("months").alias("m")).select(
        "parcel_id", "m.mes", "m.month_name", "m.sim_rain", "m.sim_temp", "m.yield"))


@register("best_month")
def q_best_month(spark, sf_dir):
    """Best month, zone factor, compliance (F16) and the explanation (F17) per parcel."""
    plan = _plan(spark, sf_dir)
    return rounded(plan.select(
        "parcel_id", "cultivo", "best_month", "best_yield",
        py_round(F.col("zone_yield_factor"), 2).alias("zone_yield_factor"), "madr_compliance",
        F.array_join("madr_rules", " | ").alias("madr_rules"), "data_source",
        F.col("xai_explanation.resumen").alias("resumen"),
        F.array_join("xai_explanation.factores_positivos", " | ").alias("factores_positivos"),
        F.array_join("xai_explanation.factores_limitantes", " | ").alias("factores_limitantes")))


@register("compliance_rules")
def q_compliance_rules(spark, sf_dir):
    """F16 + F18 + F19: one row per rule with its area and severity, and the plan score."""
    plan = _plan(spark, sf_dir)
    ex = plan.select("parcel_id", "madr_compliance", F.posexplode("madr_rules").alias("rule_pos", "rule"))
    soil, water, registry, severity = rule_route(F.col("rule"))
    return ex.select("parcel_id", "rule_pos", "rule", soil.alias("soil_section"), water.alias("water_section"),
                     registry.alias("registry_section"), severity.alias("severity"),
                     suitability_score(F.col("madr_compliance")).alias("suitability_score"))


def _economics(spark, sf_dir):
    return econ_plan.crop_economics(si.parcels(spark, sf_dir), si.production(spark, sf_dir),
                                    si.prices_weekly(spark, sf_dir), si.credit(spark, sf_dir))


ECON_OUT = ["yield_ton_ha", "total_production_ton", "precio_kg_cop", "gross_revenue", "total_cost", "net_profit",
            "net_profit_after_interest", "margin_pct", "roi_pct", "recommended_credit", "annual_interest",
            "interest_rate", "canasta_pct", "demanda_trend", "zone_factor", "lec_finagro_activo"]


@register("crop_economics")
def q_crop_economics(spark, sf_dir):
    """Economics of each parcel's crop (A25 econ, W4/J14, A26, F13, F14)."""
    return rounded(_economics(spark, sf_dir).select("parcel_id", "cultivo", *ECON_OUT))


@register("cash_flow")
def q_cash_flow(spark, sf_dir):
    """12-month cash flow of each parcel's crop (long form)."""
    eco = _economics(spark, sf_dir)
    return eco.select("parcel_id", F.posexplode("monthly_cash_flow").alias("i", "m")).select(
        "parcel_id", (F.col("i") + 1).alias("month_num"), "m.mes", "m.ingresos", "m.costos", "m.intereses", "m.neto")


@register("crop_rank")
def q_crop_rank(spark, sf_dir):
    """E5 + T6: all five crops per parcel ranked by net profit."""
    eco = econ_plan.compare_all_crops(si.parcels(spark, sf_dir), si.production(spark, sf_dir),
                                      si.prices_weekly(spark, sf_dir), si.credit(spark, sf_dir))
    return rounded(eco.select("parcel_id", "cultivo", "profit_rank", "yield_ton_ha", "gross_revenue",
                              "total_cost", "net_profit", "margin_pct", "roi_pct"))


def _livestock(spark, sf_dir):
    return livestock_plan.livestock_economics(si.herds(spark, sf_dir), si.soils(spark, sf_dir),
                                              si.livestock(spark, sf_dir), si.credit(spark, sf_dir))


LIVE_OUT = ["carrying_capacity_ha", "max_animals_allowed", "milk_prod_liters_day", "meat_sold_kg_year",
            "gross_revenue", "total_operating_costs", "capital_investment", "recommended_credit",
            "annual_interest_payment", "net_profit", "margin_pct", "roi_pct", "interest_rate", "lec_finagro_activo"]


@register("livestock_economics")
def q_livestock_economics(spark, sf_dir):
    """Herd economics with region calibration."""
    return rounded(_livestock(spark, sf_dir).select("herd_id", "species", "purpose", *LIVE_OUT))


@register("livestock_alerts")
def q_livestock_alerts(spark, sf_dir):
    """alerts and status per herd."""
    return _livestock(spark, sf_dir).select("herd_id", "compliance", F.array_join("alerts", " | ").alias("alerts"))


@register("livestock_cash_flow")
def q_livestock_cash_flow(spark, sf_dir):
    """12-month herd cash flow (long form)."""
    lv = _livestock(spark, sf_dir)
    return lv.select("herd_id", F.posexplode("monthly_cash_flow").alias("i", "m")).select(
        "herd_id", (F.col("i") + 1).alias("month_num"), "m.mes", "m.ingresos", "m.costos", "m.intereses", "m.neto")


@register("hierarchical_defaults")
def q_hierarchical_defaults(spark, sf_dir):
    """A19 + P4: planner defaults for (dept, mun, crop) requests from the master table,
    falling back region+crop -> region -> constants; some requests widen to "Todos"."""
    # the master is written once (as E1 does) and read back: both fallback levels read files
    from .session import materialize
    master = materialize(master_plan.consolidate(
        si.production(spark, sf_dir), si.soils(spark, sf_dir), si.climate_daily(spark, sf_dir),
        si.credit(spark, sf_dir), si.prices_weekly(spark, sf_dir), si.land_security(spark, sf_dir),
        si.livestock(spark, sf_dir), climate_order=["fecha", "seq"], target_rows=GAPFILL_TARGET_ROWS, key_cols=("anio", "l_orderkey", "l_linenumber"))
        .select("departamento", "municipio", "cultivo", "textura", "altitud_m", "ph_suelo", "pendiente_pct",
                "materia_organica_pct", "temp_media_c", "precipitacion_anual_mm"), "master_for_defaults")
    k = F.col("parcel_id")
    req = si.parcels(spark, sf_dir).select(
        "parcel_id",
        F.when(k % 7 == 0, F.lit("Todos")).otherwise(F.col("departamento")).alias("departamento"),
        F.when(k % 3 == 0, F.lit("Todos")).otherwise(F.col("municipio")).alias("municipio"),
        F.when(k % 11 == 0, F.lit("Yuca")).otherwise(F.col("cultivo")).alias("cultivo"))
    return rounded(hierarchical_defaults(master, req))


# ------------------------------------------------------------------ text
from .functions import text as T  # noqa: E402
from .plans import documents as docs_plan  # noqa: E402

REGISTRATION_DATE = "2026-05-01"


@register("text_features")
def q_text_features(spark, sf_dir):
    """The 32 viability features of every catalog dataset."""
    cat = T.catalog_features(_catalog(spark, sf_dir))
    return rounded(cat.select("UID", *T.FEATURE_NAMES))


@register("keyword_hits")
def q_keyword_hits(spark, sf_dir):
    """F8: datasets whose title + justification contain each agrarian / low-quality keyword."""
    from .params import AGRO_KEYWORDS, LOW_QUALITY_KEYWORDS
    cat = _catalog(spark, sf_dir)
    full = F.concat(F.lower(F.coalesce("Titulo", F.lit(""))), F.lit(" "),
                    F.lower(F.coalesce("ds_justificacion", F.lit(""))))
    words = [(k, "agro") for k in AGRO_KEYWORDS] + [(k, "low_quality") for k in LOW_QUALITY_KEYWORDS]
    # one conditional count a keyword in one aggregate, then one row a keyword
    counts = cat.select(full.alias("_t")).agg(*[F.count_if(F.col("_t").contains(k)).alias(f"c{i}") for i, (k, _) in enumerate(words)])
    rows = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("keyword"), F.col(f"c{i}").alias("datasets"))
                     for i, (k, kind) in enumerate(words)])
    return counts.select(F.explode(rows).alias("x")).select("x.*").where("datasets > 0")


@register("project_type")
def q_project_type(spark, sf_dir):
    """project type of every dataset by the ordered sector/title rules."""
    cat = _catalog(spark, sf_dir)
    df = cat.select("UID", T.project_type(F.col(f"`{ENT}Sector`"), F.col("Titulo")).alias("project_id"))
    return df.join(T.project_titles(spark), "project_id")


@register("xml_record")
def q_xml_record(spark, sf_dir):
    """F27 + J10: GEL-XML record per catalog dataset, probability from the catalog lookup."""
    cat = _catalog(spark, sf_dir)
    withp = docs_plan.known_probability(cat, cat)
    return withp.select("UID", docs_plan.gel_xml(withp, F.col("known_prob"), F.lit(REGISTRATION_DATE)).alias("xml"))


# ------------------------------------------------------------------ E9: question context
from .plans import context as context_plan  # noqa: E402


@register("entity_topics")
def q_entity_topics(spark, sf_dir):
    """F30 + F31: detected department / municipality / crop and topic flags per question."""
    return context_plan.entities_topics(si.questions(spark, sf_dir)).drop("question")


@register("question_context")
def q_question_context(spark, sf_dir):
    """The retrieval context text of every user question."""
    ctx = context_plan.question_context(
        si.questions(spark, sf_dir), si.prices_weekly(spark, sf_dir), si.production(spark, sf_dir),
        si.soils(spark, sf_dir), si.credit(spark, sf_dir), si.climate_daily(spark, sf_dir),
        si.land_security(spark, sf_dir), si.livestock(spark, sf_dir))
    return ctx.select("conv_id", "turn", "crop_name", "detected_dept", "context")


# ------------------------------------------------------------------ M1: TF-IDF
from .operators.tfidf import tfidf_long  # noqa: E402
from .params import TFIDF_SIZES  # noqa: E402


@register("tfidf_terms")
def q_tfidf_terms(spark, sf_dir):
    """M1: TF-IDF weights of title (50), description (50) and justification (25 terms)."""
    from .session import materialize
    # the clean catalog's text columns are written once; the three vocabularies read files
    cat = materialize(_catalog(spark, sf_dir).select("UID", *TFIDF_SIZES.keys()), "catalog_text")
    parts = [tfidf_long(cat, "UID", col, k).withColumn("field", F.lit(col)) for col, k in TFIDF_SIZES.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rounded(out)


# ------------------------------------------------------------------ models (rows-only checks)
from .plans import models as model_plan  # noqa: E402


@register("table_profile")
def q_table_profile(spark, sf_dir):
    """Null share and repeated rows of the documents' contents (copies occur)."""
    from .operators.profile import table_profile
    return rounded(table_profile(si.read_table(spark, sf_dir, "documents").select("text", "lang", "source")))


@register("stratified_split")
def q_stratified_split(spark, sf_dir):
    """M4, M6: datasets of each class by part, fold of the training part and fold of all rows."""
    return model_plan.split_catalog(_catalog(spark, sf_dir)).groupBy("es_viable", "part", "fold", "fold_all").agg(F.count(F.lit(1)).alias("datasets"))


@register("viability_metrics")
def q_viability_metrics(spark, sf_dir):
    """M1-M8: stacked viability classifier, hold-out metrics."""
    _, _, _, metrics = model_plan.train_viability(_catalog(spark, sf_dir))
    return rounded(metrics)


@register("viability_scores")
def q_viability_scores(spark, sf_dir):
    """M9 + J10: score new dataset requests (benchmark items) and catalog datasets."""
    # training and both sides of the lookup read the clean catalog: it is written once
    cat = _catalog(spark, sf_dir, "catalog")
    feat, bases, meta, _ = model_plan.train_viability(cat)
    bench = si.read_table(spark, sf_dir, "benchmark")
    new = bench.select(F.concat(F.lit("bench-"), F.col("item_id").cast("string")).alias("UID"),
                       F.substring_index("text", "\n", 1).alias("Titulo"), F.col("text").alias("Descripción"))
    for c in cat.columns:
        if c not in new.columns:
            new = new.withColumn(c, F.lit(None).cast(cat.schema[c].dataType))
    reqs = new.select(*cat.columns).unionByName(cat)
    return rounded(model_plan.score_viability(reqs, cat, feat, bases, meta))


@register("importances")
def q_importances(spark, sf_dir):
    """Top-8 features by mean importance over the base models."""
    feat, bases, _, _ = model_plan.train_viability(_catalog(spark, sf_dir))
    return rounded(model_plan.feature_importances(spark, feat, bases))


def _master_for_model(spark, sf_dir):
    m = master_plan.consolidate(
        si.production(spark, sf_dir), si.soils(spark, sf_dir), si.climate_daily(spark, sf_dir),
        si.credit(spark, sf_dir), si.prices_weekly(spark, sf_dir), si.land_security(spark, sf_dir),
        si.livestock(spark, sf_dir), climate_order=["fecha", "seq"], target_rows=GAPFILL_TARGET_ROWS, key_cols=("anio", "l_orderkey", "l_linenumber"))
    return m.withColumn("row_key", F.concat_ws("-", "l_orderkey", "l_linenumber"))


@register("yield_metrics")
def q_yield_metrics(spark, sf_dir):
    """RF + GBT yield ensemble on the master table, hold-out RMSE and R2."""
    _, metrics = model_plan.train_yield(_master_for_model(spark, sf_dir))
    return rounded(metrics)


@register("yield_scores")
def q_yield_scores(spark, sf_dir):
    """Parcels scored by the ensemble, then the physiological stress."""
    model, _ = model_plan.train_yield(_master_for_model(spark, sf_dir))
    parcels = planner_plan.with_crop_params(spread(si.parcels(spark, sf_dir)))
    pred = model_plan.predict_yield(model, parcels.withColumn("label", F.lit(0.0)))
    p = {k: F.col("cp_" + k) for k in planner_plan.PARAM_COLS}
    from .functions.agronomy import stressed_yield
    adj = stressed_yield(F.col("prediction"), F.col("cp_crop").isNotNull(), F.col("ph_suelo"), F.col("altitud_m"),
                         F.col("temp_media_c"), F.col("pendiente_pct"), p)
    return rounded(pred.select("parcel_id", "cultivo", F.col("prediction").alias("ml_yield"), adj.alias("yield_ton_ha")))


# ------------------------------------------------------------------ extensions X1-X3
from .operators.quality import outlier_fence  # noqa: E402
from .streaming import rollups as stream_rollups  # noqa: E402


@register("stream_daily")
def q_stream_daily(spark, sf_dir):
    """Streaming 1-day station roll-up with a 2-day watermark (append: closed windows)."""
    daily = stream_rollups.daily_rollup(stream_rollups.station_stream(spark, sf_dir))
    out = stream_rollups.run_available_now(daily, "stream_daily", run_id=_run_id(spark, sf_dir))
    tz = spark.conf.get("spark.sql.session.timeZone")
    return rounded(out.select(stream_rollups.instant_to_wall(F.col("window.start"), tz).alias("window_start"), "departamento",
                              "municipio", "temp_media_c", "precipitacion_mm", "humedad_media_pct",
                              "brillo_solar_horas"))


@register("moving_average")
def q_moving_average(spark, sf_dir):
    """28-day moving average of prices per crop, sliding every 7 days."""
    w = stream_rollups.price_windows(si.prices_weekly(spark, sf_dir))
    tz = spark.conf.get("spark.sql.session.timeZone")
    return rounded(w.select(stream_rollups.instant_to_wall(F.col("window.start"), tz).alias("window_start"), "cultivo",
                            "moving_avg_price", "n_prices"))


@register("outlier_fence")
def q_outlier_fence(spark, sf_dir):
    """Per-crop IQR fence and production/area consistency flags (flagged rows)."""
    flagged = outlier_fence(si.production(spark, sf_dir))
    return rounded(flagged.where(F.col("is_outlier") | F.col("is_inconsistent")).select(
        "l_orderkey", "l_linenumber", "cultivo", "rendimiento_ton_ha", "lower_fence", "upper_fence",
        "is_outlier", "is_inconsistent"))


# ------------------------------------------------------------------ calibration building blocks on their own
from .operators import calibration as calib  # noqa: E402
from .operators.geocode import gender_indicators  # noqa: E402


@register("latest_n_mean")
def q_latest_n_mean(spark, sf_dir):
    """Mean of the latest 12 prices per crop, floor 100 COP."""
    return rounded(calib.latest_price_table(si.prices_weekly(spark, sf_dir)))


@register("complete_with_base")
def q_complete_with_base(spark, sf_dir):
    """Base crop price table completed with live prices (full join)."""
    return rounded(calib.crop_price_table(si.prices_weekly(spark, sf_dir)))


@register("latest_prices")
def q_latest_prices(spark, sf_dir):
    """Latest five prices per crop and overall (ties by line key)."""
    from .operators.topk import top_n_per_group
    p = si.prices_weekly(spark, sf_dir).where(F.col("fecha").isNotNull())
    order = [F.col("fecha").desc(), F.col("l_orderkey").desc(), F.col("l_linenumber").desc()]
    per = top_n_per_group(p, ["cultivo"], order, 5, ["l_orderkey", "l_linenumber"]).withColumn("scope", F.col("cultivo"))
    allp = top_n_per_group(p.withColumn("_a", F.lit(1)), ["_a"], order, 5, ["l_orderkey", "l_linenumber"]) \
        .drop("_a").withColumn("scope", F.lit("Todos"))
    return rounded(per.unionByName(allp).select("scope", "rank", "cultivo", "l_orderkey", "l_linenumber",
                                                "precio_kg_promedio_cop", "central_abasto"))


@register("zone_factor")
def q_zone_factor(spark, sf_dir):
    """A25 + P4(c): planner (municipality -> department) and economics (department ->
    national) zone factors per parcel."""
    zones = calib.zone_yields(si.production(spark, sf_dir))
    p = si.parcels(spark, sf_dir).select("parcel_id", "cultivo", "departamento", "municipio")
    p = calib.with_zone_factor(p, zones, "planner", out="zone_planner")
    p = calib.with_zone_factor(p, zones, "economics", out="zone_economics")
    return rounded(p.select("parcel_id", "cultivo", "zone_planner", "zone_planner_found", "zone_economics",
                            "zone_economics_found"))


@register("interest_rate")
def q_interest_rate(spark, sf_dir):
    """A26 + F14: department credit rate per parcel and the subsidised rate."""
    from .functions.agronomy import subsidised_rate
    p = si.parcels(spark, sf_dir).select("parcel_id", "departamento", "producer_type")
    p = calib.with_rate(p, calib.rate_table(si.credit(spark, sf_dir)), out="rate")
    return rounded(p.select("parcel_id", "rate", subsidised_rate(F.col("rate"), F.col("producer_type")).alias("rate_final")))


@register("livestock_calibration")
def q_livestock_calibration(spark, sf_dir):
    """Slope, organic matter, milk per head, vaccination and rate at each herd's place."""
    from .operators.calibration import _join_level, request_level
    s_, i_, c_ = livestock_plan.livestock_calibration(si.soils(spark, sf_dir), si.livestock(spark, sf_dir),
                                                      si.credit(spark, sf_dir))
    h = si.herds(spark, sf_dir).select("herd_id", "departamento", "municipio")
    lvl, d, m = request_level(F.col("departamento"), F.col("municipio"))
    h = _join_level(_join_level(_join_level(h, s_, lvl, d, m, [], "ls"), i_, lvl, d, m, [], "li"), c_, lvl, d, m, [], "lc")
    return rounded(h.select("herd_id", F.col("lsslope").alias("slope"), F.col("lsom").alias("om"),
                            F.col("limilk").alias("milk_per_head"), F.col("livac").alias("vaccination"),
                            F.col("lcrate").alias("rate")))


@register("gender_indicators")
def q_gender_indicators(spark, sf_dir):
    """J9 + F25: department indicators (ordered substring rule) and priority-territory flag."""
    cat = _catalog(spark, sf_dir).select("UID", F.col(f"`{ENT}Departamento`").alias("dept"))
    g = gender_indicators(cat, "dept")
    return rounded(g.select("UID", "dept", "ipg_educacion", "mujeres_beneficiarias_pct", "relevo_joven_pct",
                            T.priority_territory(F.col("dept")).alias("priority_territory")))


@register("known_override")
def q_known_override(spark, sf_dir):
    """Catalog lookup for dataset requests - by UID, by title when the UID is blank."""
    cat = _catalog(spark, sf_dir)
    docs = si.read_table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    req = docs.select(
        k.alias("request_id"),
        F.when(k % 3 == 0, F.md5("text")).when(k % 3 == 1, F.lit(""))
        .otherwise(F.lit(None).cast("string")).alias("UID"),
        F.when(k % 2 == 0, F.substring_index("text", "\n", 1)).otherwise(F.lit("sin título")).alias("Titulo"))
    out = docs_plan.known_probability(req, cat)
    return out.select("request_id", "known_prob")


# ------------------------------------------------------------------ documents
@register("proposal_doc")
def q_proposal_doc(spark, sf_dir):
    """F28 (+J9, F12, F25, P8): project proposal per catalog dataset, probability from J10."""
    cat = _catalog(spark, sf_dir)
    withp = docs_plan.known_probability(cat, cat)
    return docs_plan.proposal_markdown(withp, F.col("known_prob")).select("UID", "proposal")


@register("compliance_report")
def q_compliance_report(spark, sf_dir):
    """the compliance report of every parcel's sowing plan."""
    plan = _plan(spark, sf_dir)
    return plan.select("parcel_id", docs_plan.crop_report(plan, F.lit(REGISTRATION_DATE)).alias("report"))


@register("livestock_plan")
def q_livestock_plan(spark, sf_dir):
    """the management plan of every herd."""
    eco = _livestock(spark, sf_dir)
    return eco.select("herd_id", docs_plan.livestock_report(eco, F.lit(REGISTRATION_DATE)).alias("report"))


@register("credit_barrier")
def q_credit_barrier(spark, sf_dir):
    """credit barriers for preferential herd owners, herds placed in catalog departments."""
    h = si.herds(spark, sf_dir)
    h = h.withColumn("departamento", F.coalesce(si.pick(si.CATALOG_DEPTS, F.col("herd_id") % 8), F.lit("Todos")))
    return docs_plan.credit_barriers(h).select("herd_id", "departamento", "producer_type", "barrier", "suggested_line")


# ------------------------------------------------------------------ sinks, persistence, pipeline, filters
from .plans import pipeline as pipeline_plan  # noqa: E402
from .session import ensure_checkpoint_dir  # noqa: E402


def _scratch(spark, name):
    import uuid
    return f"{ensure_checkpoint_dir(spark)}/outputs/{name}-{uuid.uuid4().hex[:10]}"


@register("regional_extract")
def q_regional_extract(spark, sf_dir):
    """The clean catalog written as one CSV extract per department; rows per extract."""
    cat = _catalog(spark, sf_dir).select("UID", "Titulo", F.col(f"`{ENT}Departamento`").alias("dept"))
    return pipeline_plan.extract_by_department(cat, _scratch(spark, "extracts"), "dept")


@register("pipeline_outputs")
def q_pipeline_outputs(spark, sf_dir):
    """S4 + S7: materialise master, yearly climate, yearly prices, livestock and the clean
    catalog as parquet; rows per written table."""
    outs = pipeline_plan.run_pipeline(
        spark, _scratch(spark, "processed"), si.production(spark, sf_dir), si.soils(spark, sf_dir),
        si.climate_daily(spark, sf_dir), si.credit(spark, sf_dir), si.prices_weekly(spark, sf_dir),
        si.land_security(spark, sf_dir), si.livestock(spark, sf_dir), si.catalog_raw(spark, sf_dir),
        climate_order=["fecha", "seq"], target_rows=GAPFILL_TARGET_ROWS, key_cols=("anio", "l_orderkey", "l_linenumber"))
    frames = [df.agg(F.count(F.lit(1)).alias("rows")).withColumn("table_name", F.lit(n)) for n, df in outs.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.select("table_name", "rows")


@register("model_roundtrip")
def q_model_roundtrip(spark, sf_dir):
    """A fitted yield pipeline saved and re-loaded gives the same predictions."""
    master = _master_for_model(spark, sf_dir)
    model, _ = model_plan.train_yield(master)
    path = _scratch(spark, "yield_model")
    pipeline_plan.save_model(spark, model, path)
    again = pipeline_plan.load_model(spark, path)
    data = model_plan.prepare_yield(master)
    # both on one row: the key of a master row need not be unique
    both = model_plan.predict_yield(model, data).withColumnRenamed("prediction", "p1")
    both = model_plan.predict_yield(again, both).withColumnRenamed("prediction", "p2")
    return both.agg(F.count(F.lit(1)).alias("rows"), F.max(F.abs(F.col("p1") - F.col("p2"))).alias("max_abs_diff"))


@register("hybrid_rmse")
def q_hybrid_rmse(spark, sf_dir):
    """Dummy-coded random forest vs boosted trees, hold-out RMSE of both."""
    _, metrics = model_plan.hybrid_models(_master_for_model(spark, sf_dir))
    return rounded(metrics)


@register("region_filter")
def q_region_filter(spark, sf_dir):
    """P3 + P4(a): exact department filter and case-insensitive department filter."""
    cat = _catalog(spark, sf_dir)
    d = F.col(f"`{ENT}Departamento`")
    exact = cat.where(d == "Valle del Cauca").select("UID", F.lit("exact").alias("filter_kind"))
    ci = cat.where(F.lower(d) == "cauca").select("UID", F.lit("case_insensitive").alias("filter_kind"))
    return exact.unionByName(ci)


@register("hectares_display")
def q_hectares_display(spark, sf_dir):
    """P2 + T1: the A15 table with presentation names, department asc / hectares desc."""
    t = S.hectares_table(si.production(spark, sf_dir))
    t = t.withColumnsRenamed({"departamento": "Departamento", "municipio": "Municipio", "cultivo": "Sector (Cultivo)",
                              "hectareas_sembradas": "Ha Sembradas", "produccion_total_ton": "Producción Total (Ton)",
                              "rendimiento_promedio": "Rend. Prom. (Ton/Ha)"})
    return rounded(t.orderBy(F.col("Departamento").asc(), F.col("`Ha Sembradas`").desc()))


@register("explorer_vars")
def q_explorer_vars(spark, sf_dir):
    """The multivariate explorer's pick (x, y, colour, size = credit) from the master."""
    m = master_plan.consolidate(
        si.production(spark, sf_dir), si.soils(spark, sf_dir), si.climate_daily(spark, sf_dir),
        si.credit(spark, sf_dir), si.prices_weekly(spark, sf_dir), si.land_security(spark, sf_dir),
        si.livestock(spark, sf_dir), climate_order=["fecha", "seq"], target_rows=GAPFILL_TARGET_ROWS, key_cols=("anio", "l_orderkey", "l_linenumber"))
    return rounded(m.select("l_orderkey", "l_linenumber", F.col("temp_media_c").alias("x"),
                            F.col("rendimiento_ton_ha").alias("y"), F.col("cultivo").alias("colour"),
                            F.col("monto_creditos_cop").alias("size")))


@register("region_scan")
def q_region_scan(spark, sf_dir):
    """S3: climate laid out by department, then three columns of the first department by name read
    with partition pruning; daily rain totals per month."""
    from .sources.tables import read_region, write_partitioned
    path = _scratch(spark, "climate_by_dept")
    climate = si.climate_daily(spark, sf_dir)
    write_partitioned(climate, path, "departamento")
    first = climate.agg(F.min("departamento")).first()[0]
    df = read_region(spark, path, "departamento", first, ["fecha", "precipitacion_diaria_mm", "temperatura_promedio_c"])
    return rounded(df.groupBy(F.year("fecha").alias("anio"), F.month("fecha").alias("mes")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("precipitacion_diaria_mm").alias("rain")))


# ------------------------------------------------------------------ remaining inventory items
@register("label_distribution")
def q_label_distribution(spark, sf_dir):
    """Class distribution of the viability label."""
    return _catalog(spark, sf_dir).groupBy("es_viable").agg(F.count(F.lit(1)).alias("count"))


@register("preview_rows")
def q_preview_rows(spark, sf_dir):
    """First 15 rows of a table by its key (a top-k report: the limit is the feature)."""
    from .operators.topk import top_n
    prod = si.production(spark, sf_dir)
    return rounded(top_n(prod, [F.col("l_orderkey").asc(), F.col("l_linenumber").asc()], 15))


@register("price_series")
def q_price_series(spark, sf_dir):
    """T4: the price series in date order (ties by line key)."""
    p = si.prices_weekly(spark, sf_dir).where(F.col("fecha").isNotNull())
    return rounded(p.orderBy("fecha", "l_orderkey", "l_linenumber").select(
        F.date_format("fecha", "yyyy-MM-dd").alias("fecha"), "cultivo", "precio_kg_promedio_cop", "l_orderkey",
        "l_linenumber"))


@register("land_table")
def q_land_table(spark, sf_dir):
    """T5: land-security table sorted by the security index, descending."""
    return rounded(si.land_security(spark, sf_dir).orderBy(F.col("indice_seguridad_juridica").desc(), "departamento",
                                                           "municipio"))


@register("fitness_features")
def q_fitness_features(spark, sf_dir):
    """pH / altitude / temperature fitness factors (F1) and the rain deficit against the
    crop's mean annual rain, per master row."""
    m = master_plan.consolidate(
        si.production(spark, sf_dir), si.soils(spark, sf_dir), si.climate_daily(spark, sf_dir),
        si.credit(spark, sf_dir), si.prices_weekly(spark, sf_dir), si.land_security(spark, sf_dir),
        si.livestock(spark, sf_dir), climate_order=["fecha", "seq"], target_rows=GAPFILL_TARGET_ROWS, key_cols=("anio", "l_orderkey", "l_linenumber"))
    m = planner_plan.with_crop_params(m)
    p = {k: F.col("cp_" + k) for k in planner_plan.PARAM_COLS}
    rain_mean = m.groupBy("cultivo").agg(F.avg("precipitacion_anual_mm").alias("_crop_rain"))
    m = m.join(rain_mean, "cultivo", "left")
    return rounded(m.select(
        "l_orderkey", "l_linenumber", "cultivo",
        stress_factor(F.col("ph_suelo"), p["ph_min"], p["ph_max"], p["ph_sigma"]).alias("ph_fitness"),
        stress_factor(F.col("altitud_m"), p["alt_min"], p["alt_max"], p["alt_sigma"]).alias("alt_fitness"),
        stress_factor(F.col("temp_media_c"), p["temp_min"], p["temp_max"], p["temp_sigma"]).alias("temp_fitness"),
        (F.col("_crop_rain") - F.col("precipitacion_anual_mm")).alias("rain_deficit_mm"),
        (F.col("precipitacion_anual_mm") < F.col("_crop_rain")).alias("water_stress_risk")))


@register("best_month_ml")
def q_best_month_ml(spark, sf_dir):
    """E3 + M12: sowing months scored by the MLlib yield ensemble."""
    model, _ = model_plan.train_yield(_master_for_model(spark, sf_dir))
    plan = planner_plan.sowing_plan_with_model(spread(si.parcels(spark, sf_dir)), si.climate_daily(spark, sf_dir),
                                               si.production(spark, sf_dir), model, model_plan.predict_yield)
    return rounded(plan.select("parcel_id", "cultivo", "best_month", "best_yield", "madr_compliance",
                               F.array_join("madr_rules", " | ").alias("madr_rules")))


@register("stream_prices")
def q_stream_prices(spark, sf_dir):
    """X2 (streaming form): price files joined to the static part table, 28-day windows
    sliding 7 days, 14-day watermark, append mode (closed windows only)."""
    from .params import CROPS
    part = si.read_table(spark, sf_dir, "part")
    w = stream_rollups.price_window_stream(stream_rollups.price_stream(spark, sf_dir, part, CROPS))
    out = stream_rollups.run_available_now(w, "stream_prices", run_id=_run_id(spark, sf_dir))
    tz = spark.conf.get("spark.sql.session.timeZone")
    return rounded(out.select(stream_rollups.instant_to_wall(F.col("window.start"), tz).alias("window_start"),
                              "cultivo", "moving_avg_price", "n_prices"))


@register("stream_daily_complete")
def q_stream_daily_complete(spark, sf_dir):
    """X1 in complete mode: every 1-day window per station (no watermark eviction)."""
    readings = stream_rollups.station_stream(spark, sf_dir)
    daily = (readings.groupBy(F.window("ts", "1 day"), "departamento", "municipio")
             .agg(F.avg(stream_rollups.MEASURES[0]).alias("temp_media_c"),
                  F.coalesce(F.sum(stream_rollups.MEASURES[1]), F.lit(0.0)).alias("precipitacion_mm"),
                  F.avg(stream_rollups.MEASURES[2]).alias("humedad_media_pct"),
                  F.coalesce(F.sum(stream_rollups.MEASURES[3]), F.lit(0.0)).alias("brillo_solar_horas")))
    out = stream_rollups.run_complete(daily, "stream_daily_complete", run_id=_run_id(spark, sf_dir))
    tz = spark.conf.get("spark.sql.session.timeZone")
    return rounded(out.select(stream_rollups.instant_to_wall(F.col("window.start"), tz).alias("window_start"),
                              "departamento", "municipio", "temp_media_c", "precipitacion_mm", "humedad_media_pct",
                              "brillo_solar_horas"))


@register("geocode_exact")
def q_geocode_exact(spark, sf_dir):
    """Municipality coordinates by exact (lower, trimmed) key, where one exists."""
    from .params import place_coordinates_df
    cat = _catalog(spark, sf_dir)
    mun = F.col(f"`{ENT}Municipio`")
    coords = place_coordinates_df(spark).select(F.col("place_key").alias("_k"), "lat", "lon")
    keyed = cat.select("UID", mun.alias("municipio"), F.when(mun != "No disponible", F.lower(F.trim(mun))).alias("_k"))
    return keyed.join(coords, "_k").select("UID", "municipio", "lat", "lon")


@register("geocode_contains")
def q_geocode_contains(spark, sf_dir):
    """Department coordinates by ordered either-way substring match on distinct names."""
    from .operators.geocode import lookup, norm
    from .params import PLACE_COORDINATES
    names = _catalog(spark, sf_dir).select(norm(F.col(f"`{ENT}Departamento`")).alias("departamento")).distinct()
    hit = names.withColumn("_hit", lookup(F.col("departamento"), PLACE_COORDINATES, ["lat", "lon"]))
    return hit.where("_hit is not null").select("departamento", "_hit.lat", "_hit.lon")


@register("response_curves")
def q_response_curves(spark, sf_dir):
    """F33 on observed values: each crop's stress factor at every distinct pH, altitude and
    slope of the soils and every distinct daily temperature of the climate table."""
    from .params import CROPS, crop_params_df
    soils, clim = si.soils(spark, sf_dir), si.climate_daily(spark, sf_dir)
    values = (soils.select(F.lit("ph").alias("variable"), F.col("ph_suelo").alias("value"))
              .unionByName(soils.select(F.lit("alt").alias("variable"), F.col("altitud_m").alias("value")))
              .unionByName(soils.select(F.lit("slope").alias("variable"), F.col("pendiente_pct").alias("value")))
              .unionByName(clim.select(F.lit("temp").alias("variable"),
                                       F.col("temperatura_promedio_c").alias("value")))
              .where(F.col("value").isNotNull()).distinct())
    per_crop = values.withColumn("cultivo", F.explode(F.array(*[F.lit(c) for c in CROPS])))
    p = crop_params_df(spark)
    j = per_crop.join(p, "cultivo")
    v, var = F.col("value"), F.col("variable")
    factor = (F.when(var == "ph", stress_factor(v, F.col("ph_min"), F.col("ph_max"), F.col("ph_sigma")))
              .when(var == "alt", stress_factor(v, F.col("alt_min"), F.col("alt_max"), F.col("alt_sigma")))
              .when(var == "temp", stress_factor(v, F.col("temp_min"), F.col("temp_max"), F.col("temp_sigma")))
              .otherwise(slope_factor(v)))
    return rounded(j.select("cultivo", "variable", "value", factor.alias("factor")))


# ------------------------------------------------------------------ X1: feeds
@register("stream_repaired")
def q_stream_repaired(spark, sf_dir):
    """X1 over event files that arrive out of order, two at a time: late rows are kept in their
    own table and merged into the closed days."""
    from .streaming.feeds import ClimateFeed
    landed = _scratch(spark, "events-landed")
    si.read_table(spark, sf_dir, "events").repartition(6, "event_id").write.parquet(landed)
    readings = stream_rollups.station_stream(spark, landed, "*.parquet", max_files_per_trigger=2)
    out = ClimateFeed(spark, "stream_repaired").run(readings).closed_days()
    tz = spark.conf.get("spark.sql.session.timeZone")
    return rounded(out.select(stream_rollups.instant_to_wall(F.col("day"), tz).alias("window_start"), "departamento",
                              "municipio", "temp_media_c", "precipitacion_mm", "humedad_media_pct", "brillo_solar_horas"))


@register("feed_plan")
def q_feed_plan(spark, sf_dir):
    """X1 + E3: sowing plans that follow a climate feed; after each micro-batch the parcels with
    new readings at their level are planned again."""
    from .streaming.feeds import ClimateFeed, MEASURES, Predictions
    landed = _scratch(spark, "climate-landed")
    tz = spark.conf.get("spark.sql.session.timeZone")
    climate = si.climate_daily(spark, sf_dir)
    (climate.select("departamento", "municipio", stream_rollups.wall_to_instant(F.col("fecha"), tz).alias("ts"), *MEASURES)
     .repartition(4).write.parquet(landed))
    schema = spark.read.parquet(landed).schema
    feed = ClimateFeed(spark, "feed_plan")
    production = si.production(spark, sf_dir)
    table = Predictions(feed, si.parcels(spark, sf_dir), lambda r, c: planner_plan.sowing_plan(spread(r), None, production, calibration=c),
                        "parcel_id", ["cultivo", "best_month", "best_yield", "data_source"]).start()
    feed.run(spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(landed), table.update)
    return rounded(table.latest().drop("batch_id"))
