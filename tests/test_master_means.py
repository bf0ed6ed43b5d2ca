"""The master's means follow from keys, counts and sums: the joined rows are not written for them."""

from pyspark.sql import functions as F

from agrolattice.operators.impute import group_mean_impute
from agrolattice.plans import master as M


def _tables(spark):
    place = "departamento string, municipio string"
    rows = [(2020, "A", "x", "Cafe", 1.5), (2020, "A", "x", "Cafe", None), (2020, "B", "y", "Cafe", 4.0), (2021, "B", "y", "Maiz", None),
            (None, "A", "x", "Cafe", 7.0), (2020, None, "x", "Cafe", 9.0), (2020, "C", "z", None, None), (2020, "B", "y", "Cafe", 4.0)]
    production = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)],
                                       f"anio int, {place}, cultivo string, rendimiento_ton_ha double, row long")
    # one key twice: its rows come twice, and count twice
    soils = spark.createDataFrame([("A", "x", "Cafe", "Alta", 5.0, 100.0, 1.0, None, "Franco", 1.0, 2.0), ("A", "x", "Cafe", "Baja", 6.0, 300.0, 1.0, 3.0, None, 1.0, 2.0),
                                   ("B", "y", "Maiz", None, 7.0, None, 1.0, 4.0, None, 1.0, 2.0)],
                                  f"{place}, cultivo string, aptitud string, ph_suelo double, altitud_m double, materia_organica_pct double, "
                                  "pendiente_pct double, textura string, latitud double, longitud double")
    climate = spark.createDataFrame([("A", "x", 20.0, 3.0)], f"{place}, t double, r double").select(
        "departamento", "municipio", F.lit("2020-03-01").cast("timestamp").alias("fecha"), F.col("t").alias("temperatura_promedio_c"),
        F.col("r").alias("precipitacion_diaria_mm"), F.lit(None).cast("double").alias("humedad_relativa_pct"), F.col("r").alias("brillo_solar_horas"))
    credit = spark.createDataFrame([(2020, "A", "x", "Cafe", 1000, 3, 8.5), (2020, "B", "y", "Cafe", 3001, None, 9.0)],
                                   f"anio int, {place}, cultivo string, monto_creditos_cop long, numero_creditos_aprobados int, tasa_interes_promedio double")
    prices = spark.createDataFrame([("Cafe", 900.0)], "cultivo string, precio_kg_promedio_cop double").withColumn("fecha", F.lit("2020-05-01").cast("timestamp"))
    land = spark.createDataFrame([("A", "x", 10.0, 2, 50.0)], f"{place}, hectareas_formalizadas double, solicitudes_restitucion_activas int, indice_seguridad_juridica double")
    herd = spark.createDataFrame([(2020, "B", "y", 11, 12, 13.0, 94)], f"anio int, {place}, poblacion_bovina int, poblacion_porcina int, produccion_leche_litros_dia double, vacunacion_fiebre_aftosa_pct int")
    return production, soils, climate, credit, prices, land, herd


def _rows(df):
    return sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()], key=repr)


def test_means_equal_those_of_the_joined_rows(spark, monkeypatch):
    tables = _tables(spark)
    written = []
    plain = M.small_side
    monkeypatch.setattr(M, "small_side", lambda df, name, *a: written.append((name, df.columns)) or plain(df, name, *a))
    got = M.consolidate(*tables, key_cols=("anio", "row"))
    joined = M.consolidate(*tables, impute=False)
    want = group_mean_impute(M.consolidate(*tables, impute=False), "cultivo", M.numeric_columns(joined, exclude=("cultivo", "anio", "row")))
    assert got.columns == want.columns and got.schema.simpleString() == want.schema.simpleString()
    assert _rows(got) == _rows(want) and got.count() == 11
    # what is written has no column of the rows' own
    assert written and not any("rendimiento_ton_ha" in cols for _, cols in written)
    assert not any("joined-master" in f for f in got.inputFiles())
