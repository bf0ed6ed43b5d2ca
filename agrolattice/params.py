"""Parameter tables.

FIXED VALUES: every constant in this module must equal the published application's
values for results to agree (crop physiology, prices, costs, month profiles, place
coordinates, indicator tables, keyword lists, text templates).  They are stated as
plain data in their natural order; the code that uses them lives elsewhere.
Each table is tiny and of fixed size, so joining it with ``F.broadcast`` is safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------- FIXED VALUES: crops
CROPS = ["Cafe", "Cacao", "Arroz", "Maiz", "Platano"]

# crop: (ph_min, ph_max, ph_sigma, temp_min, temp_max, temp_sigma, alt_min, alt_max, alt_sigma)
CROP_RANGES = {
    "Cafe": (5.2, 6.3, 0.6, 18.0, 22.0, 3.0, 1100.0, 1900.0, 400.0),
    "Cacao": (6.0, 7.5, 0.8, 22.0, 28.0, 4.0, 0.0, 1000.0, 300.0),
    "Arroz": (5.5, 6.8, 0.7, 20.0, 30.0, 5.0, 0.0, 800.0, 200.0),
    "Maiz": (5.5, 7.0, 0.8, 18.0, 27.0, 5.0, 0.0, 1800.0, 500.0),
    "Platano": (5.5, 7.0, 0.8, 22.0, 30.0, 4.0, 0.0, 1500.0, 400.0),
}

# crop: (price_kg_cop, basket_pct, demand_trend, cost_per_ha_cop, cycle_months, base_yield_t_ha)
CROP_ECONOMICS = {
    "Cafe": (14500.0, 4.2, 1.8, 3800000.0, 12, 1.4),
    "Cacao": (11200.0, 1.8, 3.1, 2200000.0, 12, 0.6),
    "Arroz": (2800.0, 8.7, 0.5, 5500000.0, 4, 5.5),
    "Maiz": (2100.0, 5.3, 2.2, 3200000.0, 4, 3.8),
    "Platano": (1800.0, 6.9, 1.1, 4100000.0, 8, 12.0),
}
# values used for a crop outside the table
OTHER_CROP_ECONOMICS = (2000.0, 2.0, 0.5, 3000000.0, 6, 2.0)
PRICE_FLOOR_COP = 100.0
LATEST_PRICE_ROWS = 12

# zone factor clamps: economics (dept -> national), planner (mun -> dept)
ECON_ZONE_CLAMP = (0.6, 2.0)
PLANNER_ZONE_CLAMP = (0.5, 2.5)

# credit
CREDIT_SHARE = 0.70
CROP_DEFAULT_RATE = 12.5
LIVESTOCK_DEFAULT_RATE = 12.8
SUBSIDY_POINTS = 2.0
SUBSIDY_FLOOR = 1.0
SUBSIDISED_PROFILES = ["Mujer Rural (Línea LEC Preferente)", "Joven Rural (Relevo Generacional < 28 años)"]

# ---------------------------------------------------------------- FIXED VALUES: months
MONTHS_LONG = ["Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio",
               "Julio", "Agosto", "Septiembre", "Octubre", "Noviembre", "Diciembre"]
MONTHS_SHORT = ["Ene", "Feb", "Mar", "Abr", "May", "Jun", "Jul", "Ago", "Sep", "Oct", "Nov", "Dic"]
DEFAULT_RAIN_FRACTION = [0.03, 0.04, 0.08, 0.12, 0.15, 0.07, 0.05, 0.04, 0.09, 0.13, 0.14, 0.06]
DEFAULT_TEMP_DIFF = [-1.0, -0.5, 0.0, 0.5, 1.0, 0.8, 0.5, 0.6, 0.4, 0.0, -0.5, -0.9]
DRY_SOWING_MONTHS = ["Enero", "Febrero", "Agosto", "Diciembre"]
TEMP_BASE_VALID = (10.0, 35.0)

# planner defaults when no region data exists, and parcel input limits
PLANNER_DEFAULTS = {"altitud_m": 1200.0, "ph_suelo": 5.8, "pendiente_pct": 12.0,
                    "materia_organica_pct": 3.5, "temp_media_c": 21.0,
                    "precipitacion_anual_mm": 1800.0, "textura": "Franco"}
PARCEL_LIMITS = {"altitud_m": (0.0, 3000.0), "ph_suelo": (4.0, 8.0), "pendiente_pct": (0.0, 45.0),
                 "materia_organica_pct": (0.0, 10.0), "temp_media_c": (10.0, 35.0),
                 "precipitacion_anual_mm": (500.0, 4000.0)}

# ---------------------------------------------------------------- FIXED VALUES: livestock
LIVESTOCK = {
    "slope_default": 10.0, "om_default": 3.2, "milk_per_head_default": 4.2, "vaccination_default": 97.5,
    "carrying_cattle": 1.8, "carrying_pigs": 15.0,
    "milking_share": 0.60, "milk_days": 305, "milk_price": 2150.0, "dual_milk_factor": 0.8,
    "meat_share": 0.35, "dual_meat_factor": 0.75, "cattle_kg": 420.0, "cattle_price": 8300.0,
    "pig_turnover": 1.6, "pig_kg": 95.0, "pig_price": 9600.0,
    "cost_head_cattle": 920000.0, "cost_head_pigs": 620000.0,
    "invest_head_cattle": 2800000.0, "invest_head_pigs": 750000.0,
    "pig_density_max": 25.0, "vaccination_min": 95.0, "cash_flow_days": 30,
}

# ---------------------------------------------------------------- FIXED VALUES: places
# department / city name -> (lat, lon), in lookup order (first substring hit wins)
PLACE_COORDINATES = [
    ("boyaca", 5.53, -73.36), ("boyacá", 5.53, -73.36), ("casanare", 5.35, -72.40),
    ("caldas", 5.07, -75.52), ("cauca", 2.44, -76.61), ("guaviare", 2.56, -72.64),
    ("huila", 2.92, -75.28), ("valle del cauca", 3.45, -76.53), ("valle", 3.45, -76.53),
    ("norte de santander", 7.89, -72.50), ("risaralda", 4.81, -75.69), ("santander", 7.12, -73.12),
    ("sucre", 9.30, -75.39), ("meta", 4.14, -73.63), ("cordoba", 8.75, -75.88),
    ("córdoba", 8.75, -75.88), ("cundinamarca", 4.71, -74.19), ("tolima", 4.44, -75.24),
    ("antioquia", 6.25, -75.56), ("atlantico", 10.96, -74.79), ("atlántico", 10.96, -74.79),
    ("quindio", 4.53, -75.67), ("quindío", 4.53, -75.67), ("san andres", 12.58, -81.70),
    ("san andrés", 12.58, -81.70), ("bogota", 4.61, -74.08), ("bogotá", 4.61, -74.08),
    ("bogota d.c.", 4.61, -74.08), ("bogotá d.c.", 4.61, -74.08), ("nacional", 4.61, -74.08),
]
DEFAULT_COORDINATES = (4.61, -74.08)

# department -> (education parity index, women beneficiaries %, youth succession %), lookup order
GENDER_STATS = [
    ("Antioquia", 0.94, 38.5, 19.1), ("Boyacá", 0.95, 42.5, 18.2), ("Casanare", 0.91, 31.0, 14.5),
    ("Caldas", 0.93, 37.2, 16.8), ("Cauca", 0.89, 39.4, 17.5), ("Guaviare", 0.86, 29.8, 12.4),
    ("Huila", 0.92, 41.0, 20.3), ("Valle del Cauca", 0.96, 44.1, 21.0),
    ("Norte de Santander", 0.88, 32.5, 13.9), ("Risaralda", 0.94, 39.0, 18.0),
    ("Santander", 0.93, 37.8, 17.2), ("Sucre", 0.90, 33.6, 14.8), ("Meta", 0.91, 35.2, 16.1),
    ("Córdoba", 0.89, 34.0, 15.2), ("Cundinamarca", 0.96, 43.8, 22.4), ("Tolima", 0.92, 36.5, 17.0),
    ("Atlántico", 0.94, 38.0, 18.5), ("Quindío", 0.95, 40.5, 19.8), ("San Andrés", 0.97, 45.2, 20.0),
    ("Bogotá", 0.98, 48.0, 25.0), ("Cesar", 0.87, 30.5, 13.0), ("Nariño", 0.91, 40.2, 16.9),
    ("Caquetá", 0.85, 28.0, 11.5),
]
PRIORITY_TERRITORY_TOKENS = ["caqueta", "caquetá", "guaviare", "amazonas", "putumayo"]

# ---------------------------------------------------------------- FIXED VALUES: text features
AGRO_KEYWORDS = [
    "agricultura", "cosecha", "cultivo", "ganado", "rendimiento",
    "produccion", "producción", "hectarea", "hectárea", "municipio",
    "departamento", "evaluacion", "estadistica", "estadística",
    "agropecuario", "bovino", "porcino", "cafe", "café", "cacao",
    "arroz", "maiz", "maíz", "platano", "plátano", "suelo", "clima",
    "precio", "mercado", "inventario", "pecuario", "siembra",
]
LOW_QUALITY_KEYWORDS = ["borrador", "prueba", "test", "ejemplo", "demo", "temporal"]
TITLE_YEAR_PATTERN = r"\b20\d{2}\b"
TITLE_DEPT_PATTERN = r"antioquia|cundinamarca|boyac|tolima|huila|meta|nari|cauca|cesar|cordoba"
AGRO_SECTOR_PATTERN = r"agricultura|agropecuario|rural|desarrollo rural"
TRUE_TOKENS = ["true", "1", "yes", "si", "sí"]
HEADER_TRUE_TOKENS = ["true", "1", "yes"]
TFIDF_SIZES = {"Titulo": 50, "Descripción": 50, "ds_justificacion": 25}

# the probability cut
APT_PROBABILITY = 0.5

PLATFORM_NAME = "Plataforma de datos abiertos"

# project types in rule order: (id, sector keywords, also match title?, title)
PROJECT_TYPES = [
    (1, ["agricultura", "agropecuario", "rural", "suelo", "clima", "precio", "pecuario"], True,
     PLATFORM_NAME + ": Optimización y Monitoreo del Sector Agropecuario"),
    (2, ["ambiente", "ecolog", "sostenible", "agua", "bosque"], True,
     "EcoClima: Alerta Temprana y Preservación Forestal"),
    (3, ["salud", "protección social"], False, "SaludIntel: Analítica Predictiva de Salud Pública"),
    (4, ["educ", "cultura"], False, "EduIA-Plataforma: Inteligencia para la Retención Educativa"),
    (5, ["transporte", "infraestructura", "vias"], False, "MovilidadIA-Col: Gestión y Flujo Vial Sostenible"),
    (6, [], False, "GovTech-Data: Motor de Analítica Pública Integrada"),
]

# ---------------------------------------------------------------- FIXED VALUES: questions
QUESTION_DEPTS = ["antioquia", "boyaca", "boyacá", "caldas", "cauca", "cesar", "cordoba", "córdoba",
                  "cundinamarca", "huila", "meta", "nariño", "narino", "risaralda", "santander",
                  "sucre", "tolima", "valle"]
QUESTION_MUNS = ["fredonia", "jerico", "jericó", "andes", "espinal", "ibague", "ibagué", "purificacion",
                 "purificación", "pitalito", "garzon", "garzón", "neiva", "granada", "villavicencio",
                 "acacias", "acacías", "cerete", "cereté", "monteria", "montería", "sahagun", "sahagún",
                 "pasto", "ipiales", "tumaco", "tunja", "duitama", "sogamoso", "fusagasuga", "fusagasugá",
                 "girardot", "facatativa", "facatativá", "popayan", "popayán", "quilichao", "miranda",
                 "valledupar", "aguachica"]
QUESTION_CROPS = [("cafe", "Cafe"), ("café", "Cafe"), ("cacao", "Cacao"), ("arroz", "Arroz"),
                  ("maiz", "Maiz"), ("maíz", "Maiz"), ("platano", "Platano"), ("plátano", "Platano")]
TOPIC_WORDS = {
    "price": ["precio", "valor", "costar", "vender", "sipsa", "mercado", "kilo", "tonelada"],
    "credit": ["credito", "crédito", "finagro", "banco", "tasa", "interes", "financiación", "financiar"],
    "legal": ["tierra", "formalizar", "titulo", "título", "escritura", "ant", "catastro",
              "seguridad jurídica", "restitución"],
    "weather": ["clima", "temperatura", "lluvia", "precipitacion", "ideam", "mes", "siembra", "sembrar"],
    "livestock": ["ganado", "vaca", "cerdo", "bovino", "porcino", "poblacion", "aftosa", "ica"],
    "frontier": ["caqueta", "caquetá", "guaviare", "amazonía", "amazonia", "orinoquía", "orinoquia",
                 "putumayo", "sustainability", "sostenible", "deforestacion", "deforestación"],
}

NO_DATA = "No disponible"


# ---------------------------------------------------------------- constant DataFrames
def crop_params_df(spark: SparkSession) -> DataFrame:
    """One row per known crop with physiology + economics, plus a ``crop_ord`` for ties."""
    rows = []
    for i, c in enumerate(CROPS):
        r = CROP_RANGES[c]
        e = CROP_ECONOMICS[c]
        rows.append((c, i) + tuple(float(x) for x in r) + (e[0], e[1], e[2], e[3], int(e[4]), e[5]))
    cols = ["cultivo", "crop_ord", "ph_min", "ph_max", "ph_sigma", "temp_min", "temp_max", "temp_sigma",
            "alt_min", "alt_max", "alt_sigma", "price_kg", "basket_pct", "demand_trend", "cost_ha",
            "cycle_months", "base_yield"]
    return F.broadcast(spark.createDataFrame(rows, cols))


def place_coordinates_df(spark: SparkSession) -> DataFrame:
    rows = [(i, k, la, lo) for i, (k, la, lo) in enumerate(PLACE_COORDINATES)]
    return F.broadcast(spark.createDataFrame(rows, "ord int, place_key string, lat double, lon double"))


# ---------------------------------------------------------------- FIXED VALUES: rule and report texts
CROP_RULES = {
    "cafe_ph_low": "⚠️ Suelo muy ácido para Café (pH < 5.0). Requiere encalado.",
    "cafe_ph_high": "⚠️ Suelo ligeramente alcalino para Café (pH > 6.5).",
    "cafe_alt_low": "⚠️ Altitud baja para Café (< 1000 m). Riesgo de plagas y baja calidad.",
    "cafe_alt_high": "⚠️ Altitud muy alta para Café (> 2000 m). Riesgo de heladas.",
    "cacao_ph_low": "⚠️ Suelo ácido para Cacao (pH < 5.5). Enmiendas recomendadas.",
    "cacao_alt_high": "⚠️ Altitud limitante para Cacao (> 1200 m). Fuera de aptitud UPRA.",
    "arroz_ph": "⚠️ pH fuera de rango para Arroz (5.5–6.5).",
    "arroz_alt_high": "⚠️ Altitud restrictiva para Arroz comercial (> 1000 m).",
    "maiz_alt_high": "📌 UPRA: Use variedades de maíz frío para altitudes > 2000 m.",
    "slope_15": "⚠️ Pendiente alta (> 15%). Requiere siembra en curvas de nivel.",
    "slope_30": "❌ Pendiente crítica (> 30%). Incumple aptitud UPRA para transitorios.",
    "dry_month": "⚠️ Siembra en época seca. Requiere sistema de riego (Decreto 1076 CAR).",
    "rain_month": "✅ Fecha ideal al inicio de lluvias. Cumple circular MADR 2026.",
    "zone_low": "📌 Esta zona produce {pct}% menos que el promedio nacional.",
    "zone_high": "✅ Zona de alta productividad: {pct}% sobre el promedio nacional.",
    "registry": "📌 Registre su predio en el ICA antes de vender la cosecha.",
}
STATUS_OK, STATUS_COND, STATUS_CRIT = "Conforme", "Condicionado", "Crítico"
SUITABILITY_SCORE = {STATUS_OK: 100, STATUS_COND: 60, STATUS_CRIT: 20}

LIVESTOCK_ALERTS = {
    "overgrazing": "❌ SOBREPASTOREO: {herd} bovinos excede capacidad ({max} máx.).",
    "near_limit": "⚠️ CARGA LÍMITE: {density} cab/Ha cerca del máximo ecológico.",
    "sustainable": "✅ CARGA ANIMAL SOSTENIBLE: Hato óptimamente dimensionado.",
    "slope": "⚠️ PENDIENTE (CAR): Implemente silvopastoril para evitar erosión (Decreto 1076).",
    "pig_density": "❌ DENSIDAD PORCINA CRÍTICA: Supera directrices ICA. Riesgo sanitario.",
    "vaccination_low": "❌ ALERTA ICA: Vacunación aftosa {rate}% < 95% requerido.",
    "vaccination_ok": "✅ CONTROL ICA: Vacunación aftosa {rate}% — Óptima.",
}

EXPLANATION = {
    "cafe_intro": ("El modelo de IA predice un rendimiento óptimo de {y} Ton/Ha en el mes de {m}. "
                   "Esto se debe a que la altitud del predio ({alt} m.s.n.m.) es ideal para el café de alta calidad, "
                   "ya que las temperaturas frescas en este rango altitudinal permiten un llenado de grano lento y aromático. "),
    "cafe_ph_low": (" Sin embargo, el pH del suelo de {ph} es demasiado ácido, lo que limita la absorción de fósforo. "
                    "El modelo ajusta la predicción a la baja y la IA sugiere corregirlo mediante encalado."),
    "cafe_ph_high": (" Sin embargo, el pH del suelo de {ph} es un poco alto, lo que podría inducir deficiencias de "
                     "microelementos (hierro, zinc)."),
    "cafe_ph_ok": " El pH del suelo de {ph} es óptimo, facilitando una excelente nutrición de las plantas.",
    "cacao_intro": ("El modelo estima un rendimiento de {y} Ton/Ha sembrando en {m}. "
                    "El cacao prospera mejor bajo los 1200 m.s.n.m. Tu altitud actual de {alt} m.s.n.m. ha sido procesada por el modelo "
                    "de ensamble. "),
    "cacao_alt_high": (" Como tu predio supera la altitud recomendada, la IA ha castigado el rendimiento esperado debido "
                       "al riesgo de bajas temperaturas."),
    "cacao_alt_ok": " Esta altitud es adecuada para mantener las temperaturas cálidas requeridas para el cacao.",
    "arroz_intro": ("El modelo predice {y} Ton/Ha de arroz sembrando en {m}. "
                    "El arroz es altamente sensible a la temperatura y radiación solar. "),
    "arroz_alt_high": " Tu altitud de {alt} m.s.n.m. limita el potencial de este cultivo transitorio térmico.",
    "arroz_alt_ok": " La temperatura promedio en esta altitud baja favorece el metabolismo rápido de la espiga.",
    "other_intro": ("El modelo de IA estima un rendimiento de {y} Ton/Ha para {crop} en {m}. "
                    "Esta proyección se basa en las correlaciones históricas de clima del IDEAM y aptitud de suelos de la UPRA en tu zona. "),
    "dry": (" Ojo: {m} es un mes con baja pluviosidad histórica según el IDEAM. "
            "Por ello, aunque el rendimiento potencial es alto, la predicción asume que cuentas con un sistema de riego "
            "artificial para suplir el déficit de agua (estrés hídrico)."),
    "rainy": (" La recomendación de siembra en {m} aprovecha el pico del régimen bimodal de lluvias del IDEAM. "
              "Esto garantiza una germinación vigorosa y reduce la necesidad de riego externo, mitigando riesgos de sequía."),
    "slope": (" Ten en cuenta que la pendiente del terreno ({s}%) representa un riesgo erosivo moderado-alto. "
              "La IA castiga levemente el rendimiento si no se aplican prácticas de conservación de suelos como barreras "
              "vivas y siembra en curvas de nivel."),
}
EXPLANATION_FACTORS = {
    "cafe_alt": "Altitud ideal para café de alta calidad",
    "cafe_ph_low": "pH muy ácido (limita absorción de fósforo)",
    "cafe_ph_high": "pH ligeramente alto (riesgo de deficiencia de microelementos)",
    "cafe_ph_ok": "pH de suelo óptimo",
    "cacao_alt_high": "Altitud elevada para cacao (>1200m)",
    "cacao_alt_ok": "Altitud adecuada para cacao",
    "arroz_alt_high": "Altitud restrictiva para arroz",
    "arroz_alt_ok": "Altitud baja (favorable para arroz)",
    "other": "Condiciones generales evaluadas",
    "dry": "Época seca en {m} (riesgo de estrés hídrico)",
    "rainy": "Mes de siembra en época de lluvias ({m})",
    "slope_high": "Pendiente del terreno elevada ({s}%)",
    "slope_ok": "Pendiente de terreno baja/segura ({s}%)",
}
DEFAULT_DATA_SOURCE = "UPRA Aptitud de Suelos + IDEAM Clima"

# Name of the platform that issues records and reports: set to your own.

# GEL-XML asset record, {slot} placeholders filled per dataset
GEL_XML_TEMPLATE = """<?xml version="1.0" encoding="UTF-8"?>
<gel:RegistroActivosInformacion
    xmlns:gel="http://www.mintic.gov.co/gel-xml/v2"
    xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"
    xsi:schemaLocation="http://www.mintic.gov.co/gel-xml/v2 gel-xml.xsd">
    <gel:Cabecera>
        <gel:EstandarVersion>2.0</gel:EstandarVersion>
        <gel:FechaRegistro>{fecha}</gel:FechaRegistro>
        <gel:PlataformaOrigen>""" + PLATFORM_NAME + """</gel:PlataformaOrigen>
    </gel:Cabecera>
    <gel:ActivoId>{uid}</gel:ActivoId>
    <gel:NombreActivo>{titulo}</gel:NombreActivo>
    <gel:DescripcionActivo>{descripcion}</gel:DescripcionActivo>
    <gel:EntidadPropietaria>
        <gel:NombreEntidad>{entidad}</gel:NombreEntidad>
        <gel:SectorEntidad>{sector}</gel:SectorEntidad>
        <gel:OrdenAdministrativo>{orden}</gel:OrdenAdministrativo>
        <gel:UbicacionGeografica>
            <gel:Departamento>{departamento}</gel:Departamento>
            <gel:Municipio>{municipio}</gel:Municipio>
        </gel:UbicacionGeografica>
    </gel:EntidadPropietaria>
    <gel:MetadatosTecnicos>
        <gel:TotalRegistros>{filas}</gel:TotalRegistros>
        <gel:TotalVariables>{columnas}</gel:TotalVariables>
        <gel:EnlaceDescarga>{url}</gel:EnlaceDescarga>
    </gel:MetadatosTecnicos>
    <gel:EvaluacionViabilidadIA>
        <gel:ProbabilidadViabilidadPct>{prob_pct}</gel:ProbabilidadViabilidadPct>
        <gel:ScoreRelevancia>{relevancia}</gel:ScoreRelevancia>
        <gel:ScoreCalidadDatos>{calidad}</gel:ScoreCalidadDatos>
        <gel:AptoParaProduccion>{apto}</gel:AptoParaProduccion>
    </gel:EvaluacionViabilidadIA>
</gel:RegistroActivosInformacion>"""

# question-context block texts (headers and line templates)
CONTEXT_TEXT = {
    "price_header": "💰 **Últimos precios de mercado reportados (SIPSA):**",
    "price_line": "- {crop}: Promedio de ${price} COP/kg en la central {central} (Fecha: {fecha})",
    "prod_header": "🌾 **Datos de producción histórica (EVA) para {crop}:**",
    "prod_yield": "- Rendimiento promedio en la zona: {y} Toneladas por Hectárea.",
    "prod_area": "- Hectáreas sembradas históricamente registradas: {ha} Ha.",
    "soil_header": "🌱 **Criterios de Suelo (UPRA) para {crop}:**",
    "soil_apt": "- Aptitud promedio del suelo en la zona: {apt}",
    "soil_ph": "- pH promedio registrado: {ph} | Altitud media: {alt} m.s.n.m.",
    "credit_header": "🏦 **Información de financiamiento rural (FINAGRO):**",
    "credit_amount": "- Monto total aprobado en registros: ${amount} COP.",
    "credit_rate": "- Tasa de interés promedio ponderada de la zona: {rate}% E.A.",
    "weather_header": "🌦️ **Monitoreo meteorológico e histórico (IDEAM):**",
    "weather_temp": "- Temperatura promedio histórica anual: {t} °C.",
    "weather_rain": "- Precipitación promedio acumulada anual estimada: {r} mm.",
    "legal_header": "⚖️ **Estado catastral y formalización de tierras (ANT/UPRA):**",
    "legal_index": "- Índice de Seguridad Jurídica de la Tierra: {isj}%",
    "legal_area": "- Hectáreas catastradas: {cat} Ha | Hectáreas formalizadas: {form} Ha (Porcentaje formalización: {pct}%).",
    "live_header": "🐄 **Cifras del inventario ganadero y sanidad (ICA):**",
    "live_cattle": "- Población bovina promedio por municipio: {b} cabezas.",
    "live_pigs": "- Población porcina promedio: {p} cabezas.",
    "live_vac": "- Cobertura de vacunación aftosa: {v}% (Meta recomendada > 95%).",
    "frontier": [
        "🌳 **Prioridad de Sostenibilidad y Frontera Agrícola (Piloto Piedemonte/Amazonía):**",
        "- Esta zona tiene un alto índice de riesgo de deforestación por expansión agropecuaria no planificada.",
        "- El programa en esta región prioriza la estabilización de la frontera agrícola, protegiendo los Resguardos Indígenas y fomentando la agroforestería (sistemas de cacao y café bajo sombra) y sistemas silvopastoriles para ganadería sostenible.",
        "- Se aplican regulaciones ambientales CAR (Decreto 1076) e incentivos del Gobierno Nacional (PDET) para la sustitución de economías no sostenibles y prevención de la tala de bosques primarios.",
    ],
}
