"""Geocoding order, calibration fallbacks and stream-vs-batch parity."""

import os
import tempfile

from pyspark.sql import functions as F

from agrolattice.operators.calibration import climate_calibration, hierarchical_defaults
from agrolattice.operators.geocode import geocode
from agrolattice.params import DEFAULT_RAIN_FRACTION
from agrolattice.streaming.rollups import daily_rollup


def test_geocode_exact_first_and_defaults(spark):
    rows = [("Valle del Cauca", "No disponible"), ("No disponible", "Bogotá"), ("Amazonas", "No disponible"),
            ("Norte de Santander", "Cali")]
    df = spark.createDataFrame(rows, "dept string, mun string")
    got = {(r.dept, r.mun): (r.latitud, r.longitud) for r in geocode(df, "dept", "mun").collect()}
    assert got[("Valle del Cauca", "No disponible")] == (3.45, -76.53)   # exact key beats "cauca"
    assert got[("No disponible", "Bogotá")] == (4.61, -74.08)            # municipality key
    assert got[("Amazonas", "No disponible")] == (4.61, -74.08)          # national default
    assert got[("Norte de Santander", "Cali")] == (7.89, -72.50)
    strict = {(r.dept, r.mun): (r.latitud, r.longitud)
              for r in geocode(df, "dept", "mun", exact_first=False).collect()}
    assert strict[("Valle del Cauca", "No disponible")] == (2.44, -76.61)  # first in list order


def test_climate_calibration_fractions_and_defaults(spark):
    rows = [("D", "M", "2024-01-05", 10.0, 20.0), ("D", "M", "2024-01-20", 30.0, 22.0),
            ("D", "M", "2024-03-01", 60.0, 24.0)]
    df = spark.createDataFrame(rows, "departamento string, municipio string, fecha string, "
                                     "precipitacion_diaria_mm double, temperatura_promedio_c double") \
        .withColumn("fecha", F.to_date("fecha"))
    cal = {r._lvl: r for r in climate_calibration(df).where(F.col("_d") == "d").collect()}
    mun = cal[0]
    assert mun.rain_fraction[0] == 0.4 and mun.rain_fraction[2] == 0.6       # 40 / 100, 60 / 100
    assert mun.rain_fraction[1] == DEFAULT_RAIN_FRACTION[1]                  # month without data keeps default
    assert mun.temp_diff[0] == -1.5 and mun.temp_diff[2] == 1.5              # (21, 24) around their mean 22.5
    assert abs(mun.temp_base_calibrated - 22.0) < 1e-12


def test_hierarchical_defaults_fall_back(spark):
    master = spark.createDataFrame(
        [("A", "X", "Cafe", 1000.0, 5.0, 10.0, 3.0, 20.0, 1500.0, "Franco"),
         ("A", "X", "Cafe", 1500.0, 6.0, 20.0, 4.0, 22.0, 1700.0, "Arcilloso"),
         ("A", "Y", "Maiz", 5000.0, 9.0, 50.0, 20.0, 40.0, 100.0, "Arcilloso")],
        "departamento string, municipio string, cultivo string, altitud_m double, ph_suelo double, "
        "pendiente_pct double, materia_organica_pct double, temp_media_c double, precipitacion_anual_mm double, "
        "textura string")
    req = spark.createDataFrame([(1, "A", "X", "Cafe"), (2, "A", "Y", "Cafe"), (3, "B", "Todos", "Cafe")],
                                "parcel_id int, departamento string, municipio string, cultivo string")
    got = {r.parcel_id: r for r in hierarchical_defaults(master, req).collect()}
    assert got[1].default_source == "region_crop" and got[1].default_altitud_m == 1250.0
    assert got[1].default_textura == "Arcilloso"                             # tie -> smallest value
    assert got[2].default_source == "region" and got[2].default_altitud_m == 3000.0  # clamped
    assert got[2].default_ph_suelo == 8.0 and got[2].default_precipitacion_anual_mm == 500.0
    assert got[3].default_source == "constants" and got[3].default_textura == "Franco"


def test_stream_matches_batch_on_closed_windows(spark):
    d = tempfile.mkdtemp(prefix="agrolattice-stream-")
    src = os.path.join(d, "src")
    rows = [("D", "M", f"2024-01-0{day} 12:00:00", float(day), 1.0, 50.0, 2.0) for day in range(1, 7)]
    schema = ("departamento string, municipio string, ts string, temperatura_promedio_c double, "
              "precipitacion_diaria_mm double, humedad_relativa_pct double, brillo_solar_horas double")
    spark.createDataFrame(rows, schema).withColumn("ts", F.to_timestamp("ts")).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = (daily_rollup(stream).writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", os.path.join(d, "ck")).trigger(availableNow=True).start(os.path.join(d, "out")))
    q.awaitTermination()
    got = sorted((r.window.start.day, r.temp_media_c) for r in spark.read.parquet(os.path.join(d, "out")).collect())
    # watermark = last event (Jan 6 12:00) - 2 days: windows ending by Jan 4 12:00 are closed
    assert got == [(1, 1.0), (2, 2.0), (3, 3.0)]
