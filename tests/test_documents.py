"""F27/F28 in the style of the reference tests: headings, banner threshold, XML escaping."""

import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from agrolattice.plans.documents import gel_xml, known_probability, proposal_markdown
from agrolattice.schemas import ENT

COLS = ["UID", "Titulo", "Descripción", "Número de Filas", "Número de Columnas", "alcance_geografico", "es_viable",
        "ds_encabezados_utiles", ENT + "Nombre de la Entidad", ENT + "Sector", ENT + "Orden", ENT + "Departamento",
        ENT + "Municipio", "url", "ds_justificacion", "ds_score_relevancia", "ds_calidad_datos"]


def _catalog(spark):
    rows = [("abc-123", 'Cosecha <café> & "maíz"', "d", 1500, 8, "local", False, "True", "Alcaldía", "Agricultura",
             "Territorial", "Caquetá", "Florencia", "https://x/1", "j", 4.2, 4.0),
            ("def-456", "Salud 2024", "d", 5000, 15, "nacional", True, "False", "MinTIC",
             "Tecnologías de la Información y Comunicaciones", "Nacional", "Huila", "Neiva", "https://x/2", "j", 4.5, 3.0)]
    schema = ", ".join(f"`{c}` {t}" for c, t in zip(COLS, ["string"] * 3 + ["int"] * 2 + ["string", "boolean"]
                                                       + ["string"] * 8 + ["double"] * 2))
    return spark.createDataFrame(rows, schema)


def test_proposal_banner_headings_and_territory(spark):
    cat = _catalog(spark)
    withp = known_probability(cat, cat)
    docs = {r.UID: r.proposal for r in proposal_markdown(withp, F.col("known_prob")).collect()}
    low, high = docs["abc-123"], docs["def-456"]
    assert low.startswith("> [!WARNING]") and "(0.0%)" in low and "baja cantidad de registros (1,500 filas" in low
    assert "escasez de atributos descriptores (8 columnas" in low and "Enfoque Territorial Sostenible" in low
    assert not high.startswith(">") and "probabilidad de viabilidad del 100.0%" in high
    for h in ["## 1. Resumen Ejecutivo", "## 2. Alineación", "## 6. Viabilidad", "## 8. Interoperabilidad"]:
        assert h in low and h in high
    assert "`0.92`" in high and "Iniciar MVP en Huila." in high          # Huila indicators, high viability
    assert "Monitoreo del Sector Agropecuario" in low and "GovTech-Data" in high                 # project types by sector rules


def test_gel_xml_escapes_and_parses(spark):
    cat = _catalog(spark)
    withp = known_probability(cat, cat)
    xmls = {r.UID: r.xml for r in withp.select("UID", gel_xml(withp, F.col("known_prob"), F.lit("2026-05-01"))
                                               .alias("xml")).collect()}
    root = ET.fromstring(xmls["abc-123"].encode("utf-8"))
    ns = {"gel": "http://www.mintic.gov.co/gel-xml/v2"}
    assert root.find("gel:NombreActivo", ns).text == 'Cosecha <café> & "maíz"'
    assert root.find("gel:EvaluacionViabilidadIA/gel:AptoParaProduccion", ns).text == "false"
    assert "&amp;" in xmls["abc-123"] and "&lt;caf" in xmls["abc-123"] and "&quot;" in xmls["abc-123"]
    high = ET.fromstring(xmls["def-456"].encode("utf-8"))
    assert high.find("gel:EvaluacionViabilidadIA/gel:ProbabilidadViabilidadPct", ns).text == "100.0"
