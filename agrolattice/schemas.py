"""Declared schemas of the farm tables and the dataset catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


SOILS = (
    "departamento string, municipio string, cultivo string, latitud double, longitud double, "
    "aptitud string, ph_suelo double, altitud_m double, materia_organica_pct double, "
    "pendiente_pct double, textura string")
CLIMATE = (
    "fecha date, departamento string, municipio string, temperatura_promedio_c double, "
    "precipitacion_diaria_mm double, humedad_relativa_pct double, brillo_solar_horas double")
CREDIT = (
    "anio int, departamento string, municipio string, cultivo string, monto_creditos_cop bigint, "
    "numero_creditos_aprobados int, tasa_interes_promedio double")
PRICES = (
    "fecha date, cultivo string, precio_kg_promedio_cop double, central_abasto string")
LAND = (
    "departamento string, municipio string, hectareas_catastradas double, hectareas_formalizadas double, "
    "predios_formalizados int, solicitudes_restitucion_activas int, conflicto_uso_suelo_pct double, "
    "indice_seguridad_juridica double")
PRODUCTION = (
    "anio int, departamento string, municipio string, cultivo string, hectareas_sembradas double, "
    "produccion_obtenida_ton double, rendimiento_ton_ha double")
LIVESTOCK = (
    "anio int, departamento string, municipio string, poblacion_bovina int, poblacion_porcina int, "
    "produccion_leche_litros_dia double, vacunacion_fiebre_aftosa_pct double")

ENT = "Información de la Entidad: "
# the 26 catalog columns kept by the cleaner, in output order
CATALOG_COLUMNS = [
    "UID", "Titulo", "Descripción", "Número de Filas", "Número de Columnas",
    "alcance_geografico", "es_viable", "ds_encabezados_utiles",
    ENT + "Nombre de la Entidad", ENT + "Sector", ENT + "Orden", ENT + "Departamento", ENT + "Municipio",
    "Categoría", "Etiqueta", "Fecha de última actualización de datos (UTC)", "API", "url",
    "ds_justificacion", "ds_score_relevancia", "ds_calidad_datos", "ds_reto_principal",
    "ds_retos_secundarios", "ds_potencial_integracion", "ds_reto_sugerido", "ds_justificacion_sugerida",
]


def ensure_columns(df: DataFrame, defaults: dict) -> DataFrame:
    """Add each absent column with its default literal."""
    missing = {k: F.lit(v) for k, v in defaults.items() if k not in df.columns}
    return df.withColumns(missing) if missing else df
