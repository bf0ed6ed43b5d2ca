"""A1/A2: calendar roll-ups of the daily climate and weekly price series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def yearly_climate(df: DataFrame, date_col: str = "fecha", keys: tuple = ("departamento", "municipio"),
                   temp: str = "temperatura_promedio_c", rain: str = "precipitacion_diaria_mm",
                   humidity: str = "humedad_relativa_pct", sun: str = "brillo_solar_horas") -> DataFrame:
    """A1: per (year, place): mean temperature, rain total, mean humidity, sunshine total.

    Null keys are dropped first (pandas groupby semantics); a sum over only nulls is 0.
    Partial aggregation runs map-side, so a hot place costs no extra shuffle.
    """
    return (df.dropna(subset=list(keys))
            .groupBy(F.year(date_col).cast("int").alias("anio"), *keys)
            .agg(F.avg(temp).alias("temp_media_c"),
                 F.coalesce(F.sum(rain), F.lit(0.0)).alias("precipitacion_anual_mm"),
                 F.avg(humidity).alias("humedad_media_pct"),
                 F.coalesce(F.sum(sun), F.lit(0.0)).alias("brillo_solar_anual_horas")))


def yearly_prices(df: DataFrame, date_col: str = "fecha", crop: str = "cultivo",
                  price: str = "precio_kg_promedio_cop") -> DataFrame:
    """A2: mean price per (year, crop)."""
    return (df.dropna(subset=[crop])
            .groupBy(F.year(date_col).cast("int").alias("anio"), crop)
            .agg(F.avg(price).alias("precio_kg_anual_promedio_cop")))
