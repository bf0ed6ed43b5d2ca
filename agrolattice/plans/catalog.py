"""Clean the dataset catalog.

raw files (S2, U1) -> W3 keep-first per UID -> P1 keep columns -> C1-C5 typing and defaults
-> J7/J8 geocoding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import count_column, fill_text, score_column, synonym_bool, to_bool_default_true
from ..operators.dedup import dedup_keep_first
from ..operators.geocode import geocode
from ..schemas import CATALOG_COLUMNS, ENT


def keep_columns(df: DataFrame, keep: list[str] = CATALOG_COLUMNS) -> DataFrame:
    """The listed columns that exist, in list order."""
    return df.select(*[F.col(f"`{c}`") for c in keep if c in df.columns])


def type_catalog(df: DataFrame) -> DataFrame:
    """C1-C5 on a keep-columns catalog."""
    cols = {}
    if "es_viable" in df.columns:
        cols["es_viable"] = to_bool_default_true(F.col("es_viable"))
    for c in ("Número de Filas", "Número de Columnas"):
        if c in df.columns:
            cols[c] = count_column(F.col(f"`{c}`"))
    if "ds_score_relevancia" in df.columns:
        cols["ds_score_relevancia"] = score_column(F.col("ds_score_relevancia"), 3.0)
    if "ds_calidad_datos" in df.columns:
        cols["ds_calidad_datos"] = score_column(F.col("ds_calidad_datos"), 2.0)
    if "ds_potencial_integracion" in df.columns:
        cols["ds_potencial_integracion"] = synonym_bool(F.col("ds_potencial_integracion"))
    return fill_text(df.withColumns(cols))


def clean_catalog(raw: DataFrame, exact_first: bool = True) -> DataFrame:
    deduped = dedup_keep_first(raw, "UID")
    typed = type_catalog(keep_columns(deduped))
    dept, mun = ENT + "Departamento", ENT + "Municipio"
    if dept not in typed.columns:
        typed = typed.withColumn(dept, F.lit("Nacional"))
    if mun not in typed.columns:
        typed = typed.withColumn(mun, F.lit("No disponible"))
    return geocode(typed, dept, mun, exact_first=exact_first)
