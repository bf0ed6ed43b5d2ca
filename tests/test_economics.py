"""Hand-computed crop economics (no region data: base price, default rate, zone 1)."""

import math

from agrolattice.plans.economics import compare_all_crops, crop_economics


def _empty(spark):
    prod = spark.createDataFrame([], "cultivo string, departamento string, municipio string, rendimiento_ton_ha double")
    prices = spark.createDataFrame([], "fecha date, cultivo string, precio_kg_promedio_cop double, "
                                       "l_orderkey bigint, l_linenumber int")
    credit = spark.createDataFrame([], "departamento string, tasa_interes_promedio double")
    return prod, prices, credit


def _parcel(spark, crop="Arroz", producer="General"):
    return spark.createDataFrame(
        [(1, crop, 6.0, 500.0, 10.0, 3.0, "Franco", 25.0, 1500.0, 2.0, "Tolima", "Espinal", producer)],
        "parcel_id int, cultivo string, ph_suelo double, altitud_m double, pendiente_pct double, "
        "materia_organica_pct double, textura string, temp_media_c double, precipitacion_anual_mm double, "
        "area_ha double, departamento string, municipio string, producer_type string")


def test_rice_economics_and_cash_flow(spark):
    r = crop_economics(_parcel(spark), *_empty(spark)).first()
    # rice inside all optimal ranges: yield = base 5.5, zone 1, price 2800, cost 5.5M/ha
    assert r.yield_ton_ha == 5.5 and r.zone_factor == 1.0 and r.precio_kg_cop == 2800
    revenue, cost = 5.5 * 2.0 * 1000 * 2800.0, 5500000.0 * 2.0
    assert r.gross_revenue == int(revenue) and r.total_cost == int(cost)
    assert r.net_profit == int(revenue - cost) and r.interest_rate == 12.5
    assert r.annual_interest == int(cost * 0.7 * 0.125)
    assert math.isclose(r.margin_pct, round((revenue - cost) / revenue * 100, 1))
    flows = r.monthly_cash_flow
    assert [f.mes for f in flows][:2] == ["Ene", "Feb"] and len(flows) == 12
    assert [i for i, f in enumerate(flows) if f.ingresos > 0] == [3]          # 4-month cycle -> month index 3
    assert flows[3].ingresos == round(revenue) and flows[0].costos == round(cost / 12)


def test_subsidy_and_ranking(spark):
    r = crop_economics(_parcel(spark, producer="Mujer Rural (Línea LEC Preferente)"), *_empty(spark)).first()
    assert r.interest_rate == 10.5 and r.lec_finagro_activo
    ranked = compare_all_crops(_parcel(spark), *_empty(spark)).orderBy("profit_rank").collect()
    assert [x.profit_rank for x in ranked] == [1, 2, 3, 4, 5]
    assert all(a.net_profit >= b.net_profit for a, b in zip(ranked, ranked[1:]))
    # plantain: 12 t/ha x 2 ha x 1000 x 1800 COP - 4.1M x 2 beats rice (5.5 t/ha x 2800 COP - 5.5M x 2)
    assert ranked[0].cultivo == "Platano" and ranked[0].net_profit == int(12.0 * 2.0 * 1000 * 1800.0 - 4100000.0 * 2.0)
