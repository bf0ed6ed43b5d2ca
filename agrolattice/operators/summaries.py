"""Catalog and farm summary tables (all single-pass aggregates)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import NO_DATA
from ..schemas import ENT
from .topk import top_n, top_n_per_group

DEPT, MUN, SECTOR = ENT + "Departamento", ENT + "Municipio", ENT + "Sector"
ROWS = "Número de Filas"


def _with_total(df: DataFrame, value: str, total_alias: str) -> DataFrame:
    """Attach the column total via a one-row aggregate on a constant key (broadcast)."""
    tot = df.agg(F.sum(value).alias(total_alias)).withColumn("_one", F.lit(1))
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(tot), "_one").drop("_one")


# ---------------------------------------------------------------- catalog
def _total(col: str):
    """Sum; of nulls only it is 0."""
    return F.coalesce(F.sum(col), F.lit(0))


def region_summary(cat: DataFrame) -> DataFrame:
    """A5 + A6: datasets, viable datasets and mean rows (truncated) per department and per
    (department, municipality), in one grouping-sets aggregate."""
    g = cat.groupingSets([[DEPT], [DEPT, MUN]], DEPT, MUN).agg(
        F.count("UID").alias("datasets"),
        F.sum(F.col("es_viable").cast("int")).cast("bigint").alias("viables"),
        F.avg(F.col(f"`{ROWS}`")).cast("bigint").alias("mean_rows"),
        F.grouping_id().alias("_gid"))
    return g.select(F.when(F.col("_gid") == 0, "municipio").otherwise("departamento").alias("level"),
                    F.col(f"`{DEPT}`").alias("departamento"),
                    F.when(F.col("_gid") == 0, F.col(f"`{MUN}`")).alias("municipio"),
                    "datasets", "viables", "mean_rows").orderBy(F.desc("datasets"), "level", "departamento", "municipio")


def tier_counts(cat: DataFrame) -> DataFrame:
    """A4: datasets per (department, lat, lon) with the marker tier (>20, >5, else)."""
    g = cat.groupBy(F.col(f"`{DEPT}`").alias("departamento"), "latitud", "longitud").agg(
        F.count(F.lit(1)).alias("total_datasets"))
    return g.withColumn("tier", F.when(F.col("total_datasets") > 20, "blue")
                        .when(F.col("total_datasets") > 5, "orange").otherwise("green"))


def sample_titles(cat: DataFrame, n: int = 5, width: int = 45) -> DataFrame:
    """Up to ``n`` titles per department (first by UID), cut to ``width`` characters."""
    top = top_n_per_group(cat.select(F.col(f"`{DEPT}`").alias("departamento"), "UID", "Titulo"),
                          ["departamento"], [F.col("UID").asc()], n, ["UID"])
    return top.select("departamento", "rank", "UID", F.substring("Titulo", 1, width).alias("title_short"))


def catalog_kpis(cat: DataFrame) -> DataFrame:
    """A20 + A24 + P7: headline numbers of a (filtered) catalog in one aggregate."""
    g = cat.agg(
        F.count(F.lit(1)).alias("total_datasets"),
        F.sum(F.col("es_viable").cast("int")).cast("bigint").alias("viable_datasets"),
        F.sum(F.col(f"`{ROWS}`").cast("bigint")).alias("total_rows"),
        F.mode(F.col(f"`{SECTOR}`"), True).alias("top_sector"),
        F.avg("ds_calidad_datos").alias("avg_quality"),
        F.avg("ds_score_relevancia").alias("avg_relevance"),
        F.avg(F.col("ds_potencial_integracion").cast("double")).alias("_integ"),
        F.sum(((F.col("ds_calidad_datos") > 0) & (F.col("ds_score_relevancia") > 0)).cast("int"))
        .cast("bigint").alias("scatter_points"))
    return g.select(
        "total_datasets", "viable_datasets",
        F.when(F.col("total_datasets") > 0, F.round(100.0 * F.col("viable_datasets") / F.col("total_datasets"), 1))
        .otherwise(0.0).alias("viable_pct"),
        "total_rows",
        F.when(F.col("total_rows") > 1e6, F.concat(F.round(F.col("total_rows") / 1e6, 2).cast("string"), F.lit("M")))
        .otherwise(F.format_number(F.col("total_rows"), 0)).alias("rows_label"),
        F.coalesce(F.col("top_sector"), F.lit(NO_DATA)).alias("top_sector"),
        "avg_quality", "avg_relevance",
        F.coalesce(F.col("_integ") * 100, F.lit(0.0)).alias("pct_integration"), "scatter_points")


def count_by(cat: DataFrame, col: str, alias: str) -> DataFrame:
    """A21 (and any value count): rows per value."""
    return cat.groupBy(F.col(f"`{col}`").alias(alias)).agg(F.count(F.lit(1)).alias("count"))


def top_sectors(cat: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` sectors with most datasets (ties by name)."""
    return top_n(count_by(cat, SECTOR, "sector"), [F.col("count").desc(), F.col("sector").asc()], n)


def quality_bands(cat: DataFrame) -> DataFrame:
    """Datasets per quality band (>=4 high, >=2 medium, else low)."""
    q = F.col("ds_calidad_datos")
    band = F.when(q >= 4, "Alta (4-5)").when(q >= 2, "Media (2-3)").otherwise("Baja (1)")
    return cat.groupBy(band.alias("quality_band")).agg(F.count(F.lit(1)).alias("count"))


def top_scored(cat: DataFrame, n: int = 15) -> DataFrame:
    """Top ``n`` datasets by relevance + quality (ties by UID)."""
    scored = cat.select("UID", "Titulo", F.col(f"`{ENT}Nombre de la Entidad`").alias("entidad"),
                        "ds_score_relevancia", "ds_calidad_datos",
                        (F.col("ds_score_relevancia") + F.col("ds_calidad_datos")).alias("score_total"))
    return top_n(scored, [F.col("score_total").desc(), F.col("UID").asc()], n)


def selector_values(cat: DataFrame, col: str = DEPT) -> DataFrame:
    """Distinct selectable values without null / "No disponible" / "Nacional"."""
    c = F.col(f"`{col}`")
    return (cat.where(c.isNotNull() & ~c.isin(NO_DATA, "Nacional")).select(c.alias("value")).distinct().orderBy("value"))


# ---------------------------------------------------------------- farm tables
def suitability_hist(soils: DataFrame) -> DataFrame:
    """Soil rows per (crop, suitability)."""
    return soils.groupBy("cultivo", "aptitud").agg(F.count(F.lit(1)).alias("count"))


def climate_by_dept(climate: DataFrame) -> DataFrame:
    """Mean temperature and daily rain per department."""
    return climate.groupBy("departamento").agg(F.avg("temperatura_promedio_c").alias("temperatura_promedio_c"),
                                               F.avg("precipitacion_diaria_mm").alias("precipitacion_diaria_mm"))


def box_stats(prod: DataFrame, value: str = "rendimiento_ton_ha", keys: tuple = ("cultivo", "departamento"),
              method: str = "sort", accuracy: int = 10000) -> DataFrame:
    """Quartiles (linear interpolation), min, max and 1.5 IQR whiskers per group.

    ``method='sort'`` (default): exact, by distributed order statistics (no group is gathered
    in one task); ``'count_map'``: Spark's exact ``percentile`` (one value->count map per
    group in memory, fine for groups with few distinct values); ``'approx'``:
    ``percentile_approx`` with bounded memory."""
    from .quantiles import exact_quantiles
    v = F.col(value)
    mm = prod.groupBy(*keys).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n"))
    if method == "sort":
        q = exact_quantiles(prod, list(keys), value, [0.25, 0.5, 0.75]).select(
            *keys, F.col("q0").alias("_q1"), F.col("q1").alias("_q2"), F.col("q2").alias("_q3"))
        g = mm.join(q, list(keys), "left")
        q1, q2, q3 = F.col("_q1"), F.col("_q2"), F.col("_q3")
    else:
        qs = (F.percentile_approx(v, [0.25, 0.5, 0.75], accuracy) if method == "approx"
              else F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))))
        g = prod.groupBy(*keys).agg(qs.alias("_q"), F.min(v).alias("min"), F.max(v).alias("max"),
                                    F.count(v).alias("n"))
        q1, q2, q3 = F.col("_q")[0], F.col("_q")[1], F.col("_q")[2]
    iqr = q3 - q1
    return g.select(*keys, "n", "min", q1.alias("q1"), q2.alias("median"), q3.alias("q3"), "max",
                    F.greatest(F.col("min"), q1 - 1.5 * iqr).alias("lower_fence"),
                    F.least(F.col("max"), q3 + 1.5 * iqr).alias("upper_fence"))


def yield_kpis(prod: DataFrame) -> DataFrame:
    """A10: mean / max / min yield and harvested total (0 when the column is absent)."""
    harvested = _total("hectareas_cosechadas") if "hectareas_cosechadas" in prod.columns else F.lit(0.0)
    return prod.agg(F.avg("rendimiento_ton_ha").alias("yield_mean"), F.max("rendimiento_ton_ha").alias("yield_max"),
                    F.min("rendimiento_ton_ha").alias("yield_min"), harvested.alias("harvested_total"))


def sown_vs_harvested(prod: DataFrame) -> DataFrame:
    """Sown and harvested hectares per crop."""
    return prod.groupBy("cultivo").agg(_total("hectareas_sembradas").alias("hectareas_sembradas"),
                                       _total("hectareas_cosechadas").alias("hectareas_cosechadas"))


def credit_share(credit: DataFrame) -> DataFrame:
    """Credit amount per crop and its share of the total (%)."""
    g = credit.groupBy("cultivo").agg(_total("monto_creditos_cop").alias("monto_creditos_cop"))
    g = _with_total(g, "monto_creditos_cop", "_total")
    return g.select("cultivo", "monto_creditos_cop",
                    F.when(F.col("_total") != 0, 100.0 * F.col("monto_creditos_cop") / F.col("_total"))
                    .alias("share_pct"))


def livestock_means(livestock: DataFrame) -> DataFrame:
    """Mean cattle and pig population per department."""
    return livestock.groupBy("departamento").agg(F.avg("poblacion_bovina").alias("poblacion_bovina"),
                                                 F.avg("poblacion_porcina").alias("poblacion_porcina"))


def land_kpis(land: DataFrame) -> DataFrame:
    """Cadastre / formalised hectares, % formalised, plots and mean security index."""
    g = land.agg(F.coalesce(F.sum("hectareas_catastradas"), F.lit(0.0)).alias("total_catastradas"),
                 F.coalesce(F.sum("hectareas_formalizadas"), F.lit(0.0)).alias("total_formalizadas"),
                 F.coalesce(F.sum("predios_formalizados"), F.lit(0)).cast("bigint").alias("total_predios"),
                 F.avg("indice_seguridad_juridica").alias("isj_promedio"))
    return g.withColumn("pct_formalizado", F.when(F.col("total_catastradas") > 0,
                                                  100.0 * F.col("total_formalizadas") / F.col("total_catastradas")))


def hectares_table(prod: DataFrame) -> DataFrame:
    """Sown hectares, production and mean yield per (department, municipality, crop),
    rounded to 1 / 1 / 2 decimals."""
    return prod.groupBy("departamento", "municipio", "cultivo").agg(
        F.round(_total("hectareas_sembradas"), 1).alias("hectareas_sembradas"),
        F.round(_total("produccion_obtenida_ton"), 1).alias("produccion_total_ton"),
        F.round(F.avg("rendimiento_ton_ha"), 2).alias("rendimiento_promedio"))


def hectares_by_crop(table: DataFrame) -> DataFrame:
    """The A15 table re-aggregated to crop."""
    return table.groupBy("cultivo").agg(_total("hectareas_sembradas").alias("hectareas_sembradas"))


def index_ranking(land: DataFrame) -> DataFrame:
    """Mean security index per department."""
    return land.groupBy("departamento").agg(F.avg("indice_seguridad_juridica").alias("isj_promedio"))


def formalisation_funnel(land: DataFrame) -> DataFrame:
    """Cadastre vs formalised hectares per department."""
    return land.groupBy("departamento").agg(_total("hectareas_catastradas").alias("catastradas"),
                                            _total("hectareas_formalizadas").alias("formalizadas")).orderBy(F.desc("catastradas"))
