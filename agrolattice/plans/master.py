"""Consolidate the farm tables into one master table.

production -(J1)- soils, -(J2)- yearly climate (W1 gap fill, A1), -(J3)- credit,
-(J4)- yearly prices (A2), -(J5)- land security, -(J6)- livestock; then W2 per-crop mean
imputation and C6 category defaults.  Every dimension is pre-aggregated
before its join; the two roll-ups are written out, and broadcast if their measured size is
small.  The other dimensions carry no hint: their stored size decides, and a large one is joined
by a (skew-split) sort-merge join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ..operators.gapfill import gap_fill_linear
from ..operators.impute import numeric_columns, with_means
from ..operators.rollup import yearly_climate, yearly_prices
from ..session import small_side

CLIMATE_MEASURES = ["temperatura_promedio_c", "precipitacion_diaria_mm", "humedad_relativa_pct",
                    "brillo_solar_horas"]
PLACE = ["departamento", "municipio"]
SOIL_COLS = ["aptitud", "ph_suelo", "altitud_m", "materia_organica_pct", "pendiente_pct", "textura",
             "latitud", "longitud"]
CREDIT_COLS = ["monto_creditos_cop", "numero_creditos_aprobados", "tasa_interes_promedio"]
LAND_COLS = ["hectareas_formalizadas", "solicitudes_restitucion_activas", "indice_seguridad_juridica"]
LIVESTOCK_COLS = ["poblacion_bovina", "poblacion_porcina", "produccion_leche_litros_dia",
                  "vacunacion_fiebre_aftosa_pct"]


def filled_yearly_climate(climate: DataFrame, order_cols: list[str] | None = None,
                          target_rows: int = 1_000_000) -> DataFrame:
    order = order_cols or ["fecha"]
    filled = gap_fill_linear(climate, PLACE, order, CLIMATE_MEASURES, target_rows=target_rows)
    return yearly_climate(filled)


def consolidate(production: DataFrame, soils: DataFrame, climate: DataFrame, credit: DataFrame,
                prices: DataFrame, land: DataFrame, livestock: DataFrame,
                climate_order: list[str] | None = None, impute: bool = True,
                key_cols: tuple = ("anio",), target_rows: int = 1_000_000,
                yearly_climate: DataFrame | None = None) -> DataFrame:
    """``key_cols``: numeric identifier columns that are never imputed.  ``yearly_climate`` is
    ``filled_yearly_climate`` if it has been made already."""
    clim_y = filled_yearly_climate(climate, climate_order, target_rows) if yearly_climate is None else yearly_climate
    crop = ["cultivo"]
    # the roll-ups are written out, so that the planner knows their size
    dims = {"soils": soils.select(*PLACE, *crop, *SOIL_COLS), "climate": small_side(clim_y, "yearly-climate"),
            "credit": credit.select("anio", *PLACE, *crop, *CREDIT_COLS), "prices": small_side(yearly_prices(prices), "yearly-prices"),
            "land": land.select(*PLACE, *LAND_COLS), "livestock": livestock.select("anio", *PLACE, *LIVESTOCK_COLS)}
    m = _joined(production, dims)
    if impute:
        m = impute_joined(m, production, dims, numeric_columns(m, exclude=("cultivo",) + tuple(key_cols)))
    return m.fillna({"textura": "Franco", "aptitud": "Media"})


def _joined(rows: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """``rows`` with what the other tables know of their year, place and crop."""
    crop = ["cultivo"]
    m = rows.join(dims["soils"], PLACE + crop, "left")
    m = m.join(dims["climate"], ["anio"] + PLACE, "left")
    m = m.join(dims["credit"], ["anio"] + PLACE + crop, "left")
    m = m.join(dims["prices"], ["anio"] + crop, "left")
    m = m.join(dims["land"], PLACE, "left")
    return m.join(dims["livestock"], ["anio"] + PLACE, "left")


def impute_joined(m: DataFrame, production: DataFrame, dims: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """W2 on the joined rows ``m``: the mean of each crop over all of them, without writing them.

    All rows of one year, place and crop have the same joined values, so the means follow from the
    rows' counts and sums by these keys, joined as the rows are.  Only keys, counts and sums are
    shuffled.
    """
    keys = ["anio", *PLACE, "cultivo"]
    kinds = m.agg(*[F.avg(c).alias(c) for c in columns]).schema
    own = [c for c in columns if c in production.columns and c not in keys]
    total = {c: F.sum(c) if isinstance(production.schema[c].dataType, DecimalType) else F.sum(F.col(c).cast("double")) for c in own}
    sums = production.where("cultivo is not null").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *[total[c].alias(f"_s_{c}") for c in own], *[F.count(c).alias(f"_n_{c}") for c in own])
    sums = _joined(sums, dims)

    def mean(c):
        if c in own:
            value = F.sum(f"_s_{c}") / F.sum(f"_n_{c}")
        else:
            weighed = F.col(c) if isinstance(kinds[c].dataType, DecimalType) else F.col(c).cast("double")
            value = F.sum(weighed * F.col("_n")) / F.sum(F.when(F.col(c).isNotNull(), F.col("_n")))
        # no value at all: no mean
        return F.when(F.sum(f"_n_{c}") > 0 if c in own else F.count(c) > 0, value).cast(kinds[c].dataType).alias(f"_mean_{c}")

    means = sums.groupBy("cultivo").agg(*[mean(c) for c in columns])
    return with_means(m, means, "cultivo", columns)
