"""The reference's own test cases (FIXTURES.md request fixtures), run through the batch API."""

import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from agrolattice.plans.documents import gel_xml, proposal_markdown
from agrolattice.plans.planner import sowing_plan
from agrolattice.schemas import ENT

CLIMATE = ("departamento string, municipio string, fecha date, precipitacion_diaria_mm double, "
           "temperatura_promedio_c double")
PRODUCTION = "cultivo string, departamento string, municipio string, rendimiento_ton_ha double"


def test_parcel_cycle_has_twelve_months_rules_and_explanation(spark):
    parcel = spark.createDataFrame(
        [(1, "Cafe", "Franco", 5.8, 1200.0, 12.0, 3.5, 21.0, 1800.0, "Todos", "Todos")],
        "parcel_id int, cultivo string, textura string, ph_suelo double, altitud_m double, pendiente_pct double, "
        "materia_organica_pct double, temp_media_c double, precipitacion_anual_mm double, departamento string, "
        "municipio string")
    plan = sowing_plan(parcel, spark.createDataFrame([], CLIMATE), spark.createDataFrame([], PRODUCTION)).first()
    assert len(plan.months) == 12 and plan.best_yield > 0
    assert plan.best_month in [m.month_name for m in plan.months]
    assert plan.madr_compliance in ("Conforme", "Condicionado", "Crítico") and len(plan.madr_rules) > 0
    x = plan.xai_explanation
    assert x.resumen and x.factores_positivos is not None and x.factores_limitantes is not None
    assert x.fuente_datos == "UPRA Aptitud de Suelos + IDEAM Clima"      # no climate / EVA rows
    # all months share the optimum (temperature 21 +- offsets inside 18-22) -> earliest month wins ties
    assert plan.best_month == "Enero" and plan.best_yield == 1.4


def _request(spark, prob_col="p"):
    cols = {"UID": "abc-123", "Titulo": "Propuesta", "Descripción": "Datos", "Número de Filas": 1500,
            "Número de Columnas": 8, "alcance_geografico": "Municipal", "ds_encabezados_utiles": "fecha, valor",
            ENT + "Nombre de la Entidad": "Alcaldía", ENT + "Sector": "Agricultura", ENT + "Orden": "Territorial",
            ENT + "Departamento": "Todos", ENT + "Municipio": "No disponible", "url": "https://www.datos.gov.co",
            "ds_justificacion": "Mejorar el campo", "ds_score_relevancia": 4.2, "ds_calidad_datos": 4.0}
    return spark.createDataFrame([tuple(cols.values())], ", ".join(
        f"`{k}` {'int' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}"
        for k, v in cols.items()))


def test_proposal_for_a_viable_request(spark):
    doc = proposal_markdown(_request(spark), F.lit(0.885)).first().proposal
    assert doc.startswith("# Propuesta de Innovación Pública:") and "88.5%" in doc
    assert "## 1. Resumen Ejecutivo" in doc and "## 7. Equidad de Género" in doc


def test_xml_record_for_probability_095(spark):
    req = _request(spark).withColumn("ds_score_relevancia", F.lit(4.5))
    xml = req.select(gel_xml(req, F.lit(0.95), F.lit("2026-05-01")).alias("x")).first().x
    assert xml.startswith('<?xml version="1.0" encoding="UTF-8"?>')
    root = ET.fromstring(xml.encode("utf-8"))
    ns = {"gel": "http://www.mintic.gov.co/gel-xml/v2"}
    assert root.find("gel:ActivoId", ns).text == "abc-123"
    assert root.find("gel:EvaluacionViabilidadIA/gel:ProbabilidadViabilidadPct", ns).text == "95.0"
    assert root.find("gel:EvaluacionViabilidadIA/gel:ScoreRelevancia", ns).text == "4.5"
    assert root.find("gel:EvaluacionViabilidadIA/gel:AptoParaProduccion", ns).text == "true"


def test_viability_request_label_and_probabilities(spark):
    from agrolattice.plans.models import score_viability, train_viability
    rows = []
    for i in range(60):
        good = i % 3 != 0
        rows.append((f"u{i}", f"Producción de cultivo {i}" if good else f"prueba demo {i}", "texto " * (i % 7 + 1),
                     5000 + i if good else 100 + i, 15 if good else 4, "nacional" if good else "local", good,
                     "True", "Entidad", "Agricultura" if good else "Otro", "Nacional", "Huila", "Neiva",
                     "https://x", "justificación", 4.5 if good else 2.0, 4.0 if good else 1.0, good))
    cols = ["UID", "Titulo", "Descripción", "Número de Filas", "Número de Columnas", "alcance_geografico", "es_viable",
            "ds_encabezados_utiles", ENT + "Nombre de la Entidad", ENT + "Sector", ENT + "Orden", ENT + "Departamento",
            ENT + "Municipio", "url", "ds_justificacion", "ds_score_relevancia", "ds_calidad_datos",
            "ds_potencial_integracion"]
    types = ["string"] * 3 + ["int"] * 2 + ["string", "boolean"] + ["string"] * 8 + ["double"] * 2 + ["boolean"]
    cat = spark.createDataFrame(rows, ", ".join(f"`{c}` {t}" for c, t in zip(cols, types)))
    feat, bases, meta, metrics = train_viability(cat, n_trees=5, gbt_iter=3, folds=2)
    m = metrics.first()
    assert 0.0 <= m.accuracy <= 1.0 and 0.0 <= m.f1 <= 1.0
    new = cat.limit(0).unionByName(spark.createDataFrame(
        [("", "Nuevo dataset de producción agrícola", "texto", 5000, 15, "nacional", None, "True", "MinTIC",
          "Tecnologías de la Información y Comunicaciones", "Nacional", "Todos", "No disponible", "https://y",
          "", 4.5, 3.0, True)], cat.schema))
    scored = score_viability(new.unionByName(cat.limit(2)), cat, feat, bases, meta).collect()
    for r in scored:
        assert r.prediction in (0, 1) and abs(r.prob_0 + r.prob_1 - 1.0) < 1e-9
    assert [r.from_catalog for r in scored].count(True) == 2                # known datasets use the lookup
    # publish and reload the bundle (M8 / S6): same probabilities
    import tempfile

    from agrolattice.plans.models import load_viability_bundle, save_viability_bundle
    path = tempfile.mkdtemp(prefix="agrolattice-bundle-")
    save_viability_bundle(path, feat, bases, meta, metrics)
    feat2, bases2, meta2, metrics2 = load_viability_bundle(spark, path)
    again = score_viability(new, cat, feat2, bases2, meta2).collect()
    first = score_viability(new, cat, feat, bases, meta).collect()
    assert abs(again[0].prob_1 - first[0].prob_1) < 1e-12 and metrics2.count() == 1
