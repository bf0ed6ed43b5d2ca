"""Hand-computed cases for the planner, livestock and text functions."""

import math

from pyspark.sql import functions as F

from agrolattice.functions.agronomy import slope_factor, stress_factor
from agrolattice.functions.text import word_count, xml_escape
from agrolattice.plans.livestock import livestock_economics


def test_stress_and_slope_factors(spark):
    df = spark.createDataFrame([(4.0, 20.0), (5.5, 40.0), (7.0, 10.0)], "ph double, slope double")
    rows = df.select(stress_factor(F.col("ph"), F.lit(5.2), F.lit(6.3), F.lit(0.6)).alias("s"),
                     slope_factor(F.col("slope")).alias("f")).collect()
    assert math.isclose(rows[0].s, math.exp(-2.0)) and math.isclose(rows[0].f, 0.95)
    assert rows[1].s == 1.0 and math.isclose(rows[1].f, 0.65)
    assert math.isclose(rows[2].s, math.exp(-(0.7 ** 2) / 0.72)) and rows[2].f == 1.0


def test_livestock_defaults_and_subsidy(spark):
    herds = spark.createDataFrame(
        [(1, "Antioquia", "Fredonia", "Bovino", "Leche", 30, 40.0, "Mujer Rural (Línea LEC Preferente)")],
        "herd_id int, departamento string, municipio string, species string, purpose string, herd_size int, "
        "farm_area double, producer_type string")
    empty_soils = spark.createDataFrame([], "departamento string, municipio string, pendiente_pct double, "
                                            "materia_organica_pct double")
    empty_inv = spark.createDataFrame([], "departamento string, municipio string, produccion_leche_litros_dia double, "
                                          "poblacion_bovina int, vacunacion_fiebre_aftosa_pct double")
    empty_credit = spark.createDataFrame([], "departamento string, municipio string, tasa_interes_promedio double")
    r = livestock_economics(herds, empty_soils, empty_inv, empty_credit).first()
    assert r.carrying_capacity_ha == 1.8 and r.max_animals_allowed == 72
    assert r.milk_prod_liters_day == 75.6                       # 30 x 0.6 x 4.2
    assert r.gross_revenue == int(30 * 0.60 * 4.2 * 305 * 2150.0)
    assert r.interest_rate == 10.8 and r.lec_finagro_activo     # 12.8 - 2 for the preferential line
    assert r.compliance == "Conforme" and len(r.monthly_cash_flow) == 12


def test_text_helpers(spark):
    df = spark.createDataFrame([("  a  b\nc ", "a&b<c>\"'"), ("", "")], "t string, x string")
    rows = df.select(word_count(F.col("t")).alias("n"), xml_escape(F.col("x")).alias("e")).collect()
    assert rows[0].n == 3 and rows[1].n == 0
    assert rows[0].e == "a&amp;b&lt;c&gt;&quot;&apos;"
