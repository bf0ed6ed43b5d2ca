"""Independent DuckDB SQL for every registered query (the correctness oracle).

The stand-in views are restated here as CTEs with the same expressions as
``agrolattice/sources/standins.py``; the operators themselves are written the plain SQL way
(single-level windows, correlated joins), not the way the Spark code computes them.
Doubles are rounded like the Spark side; truncating casts use ``trunc`` (DuckDB's cast rounds).
"""

from __future__ import annotations

from agrolattice.sources.standins import FARM_DEPTS, QUESTION_TAILS

MEASURES = ["temperatura_promedio_c", "precipitacion_diaria_mm", "humedad_relativa_pct", "brillo_solar_horas"]


def case_pick(values, idx):
    parts = []
    for i, v in enumerate(values):
        lit = "NULL" if v is None else "'" + v.replace("'", "''") + "'"
        parts.append(f"WHEN {idx} = {i} THEN {lit}")
    return "CASE " + " ".join(parts) + " END"


CROPS = ["Cafe", "Cacao", "Arroz", "Maiz", "Platano"]
CROP_OF_PART = case_pick(CROPS, "p_partkey % 5")

GEO = f"""geo AS (SELECT n_nationkey, n_regionkey, {case_pick(FARM_DEPTS, "n_regionkey % 5")} AS departamento, n_name AS municipio
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""

STATIONS = """stations AS (SELECT 'D' || CAST(user_id % 5 AS VARCHAR) AS departamento,
  'M' || CAST(user_id AS VARCHAR) AS municipio, ts AS fecha, event_id AS seq,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE 10 + value / 20 END AS temperatura_promedio_c,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE value / 10 END AS precipitacion_diaria_mm,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE 60 + value / 25 END AS humedad_relativa_pct,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE value / 50 END AS brillo_solar_horas
  FROM events)"""

CLIMATE = """climate AS (SELECT g.departamento, g.municipio, o.o_orderdate AS fecha, o.o_orderkey AS seq,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 15 + o_totalprice / 50000 END AS temperatura_promedio_c,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice / 1000 END AS precipitacion_diaria_mm,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 60 + o_totalprice / 20000 END AS humedad_relativa_pct,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice / 40000 END AS brillo_solar_horas
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN geo g ON c.c_nationkey = g.n_nationkey)"""

PRICES = f"""prices AS (SELECT l_shipdate AS fecha, {CROP_OF_PART} AS cultivo,
  CASE WHEN l_quantity > 0 THEN l_extendedprice / l_quantity END AS precio_kg_promedio_cop,
  l_returnflag AS central_abasto, l_orderkey, l_linenumber
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

PRODUCTION = f"""production AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS anio, g.departamento, g.municipio,
  {CROP_OF_PART} AS cultivo, l_quantity AS hectareas_sembradas,
  l_quantity * (l_extendedprice / 10000) AS produccion_obtenida_ton,
  l_extendedprice / 10000 AS rendimiento_ton_ha,
  l_quantity * (1 - l_discount) AS hectareas_cosechadas, l_orderkey, l_linenumber
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN geo g ON c_nationkey = g.n_nationkey JOIN part ON l_partkey = p_partkey)"""

SUPPLIER_LINES = f"""slines AS (SELECT l.*, g.*, {CROP_OF_PART} AS crop FROM lineitem l JOIN supplier ON l_suppkey = s_suppkey
  JOIN geo g ON s_nationkey = g.n_nationkey JOIN part ON l_partkey = p_partkey)"""

SOILS = f"""soils AS (SELECT departamento, municipio, cultivo,
  1.0 + n_nationkey / 2 AS latitud, CAST(-70 - n_regionkey AS DOUBLE) AS longitud,
  {case_pick(["Alta", "Media", "Baja", "No Apta"], "n % 4")} AS aptitud,
  4.5 + (sl % 25) / 10 AS ph_suelo, CAST(sp % 3000 AS DOUBLE) AS altitud_m,
  1.5 + (n % 36) / 10 AS materia_organica_pct, (ss % 350) / 10 AS pendiente_pct,
  CASE WHEN n % 5 = 0 THEN NULL ELSE {case_pick(["Franco", "Franco-Arenoso", "Franco-Arcilloso", "Arcilloso"], "so % 4")} END AS textura
  FROM (SELECT departamento, municipio, n_nationkey, n_regionkey, crop AS cultivo, count(*) AS n,
        sum(l_linenumber) AS sl, sum(l_partkey) AS sp, sum(l_suppkey) AS ss, sum(l_orderkey) AS so
        FROM slines GROUP BY ALL) s)"""

CREDIT = """credit AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS anio, departamento, municipio, crop AS cultivo,
  CAST(sum(floor(l_extendedprice)) * 1000 AS BIGINT) AS monto_creditos_cop,
  CAST(count(*) AS INTEGER) AS numero_creditos_aprobados, 8 + avg(l_tax) * 100 AS tasa_interes_promedio
  FROM slines GROUP BY ALL)"""

LAND = """land AS (SELECT *, least(CAST(100 AS DOUBLE), 100 * hectareas_formalizadas / hectareas_catastradas) AS indice_seguridad_juridica
  FROM (SELECT departamento, municipio, sum(abs(c_acctbal)) + 1000 AS hectareas_catastradas,
    sum(CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0.0 END) AS hectareas_formalizadas,
    CAST(count(*) AS INTEGER) AS predios_formalizados,
    CAST(sum(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END) AS INTEGER) AS solicitudes_restitucion_activas,
    100 * CAST(sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS conflicto_uso_suelo_pct
    FROM customer JOIN geo ON c_nationkey = n_nationkey GROUP BY ALL) x)"""

LIVESTOCK = """livestock AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS anio, departamento, municipio,
  CAST(count(*) * 10 AS INTEGER) AS poblacion_bovina,
  CAST(sum(CASE WHEN starts_with(o_orderpriority, '1') THEN 7 ELSE 1 END) AS INTEGER) AS poblacion_porcina,
  avg(o_totalprice) / 1000 AS produccion_leche_litros_dia,
  CAST(90 + count(*) % 10 AS DOUBLE) AS vacunacion_fiebre_aftosa_pct
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN geo ON c_nationkey = n_nationkey GROUP BY ALL)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def gap_fill_ctes(src: str, name: str = "filled") -> str:
    """Plain single-window gap fill over a whole group (the textbook formulation)."""
    win_cols = []
    out_cols = []
    for m in MEASURES:
        win_cols.append(f"""last_value(CASE WHEN {m} IS NOT NULL THEN rn END IGNORE NULLS) OVER wf AS pp_{m},
      last_value({m} IGNORE NULLS) OVER wf AS pv_{m},
      first_value(CASE WHEN {m} IS NOT NULL THEN rn END IGNORE NULLS) OVER wb AS np_{m},
      first_value({m} IGNORE NULLS) OVER wb AS nv_{m}""")
        out_cols.append(f"""CASE WHEN {m} IS NOT NULL THEN {m}
      WHEN pp_{m} IS NOT NULL AND np_{m} IS NOT NULL THEN pv_{m} + (nv_{m} - pv_{m}) * (rn - pp_{m}) / (np_{m} - pp_{m})
      WHEN pp_{m} IS NOT NULL THEN pv_{m} ELSE nv_{m} END AS {m}""")
    return f"""numbered_{name} AS (SELECT *, row_number() OVER (PARTITION BY departamento, municipio ORDER BY fecha, seq) AS rn
  FROM {src}),
 scan_{name} AS (SELECT *, {", ".join(win_cols)}
  FROM numbered_{name}
  WINDOW wf AS (PARTITION BY departamento, municipio ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         wb AS (PARTITION BY departamento, municipio ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 {name} AS (SELECT departamento, municipio, fecha, seq, {", ".join(out_cols)} FROM scan_{name})"""


YEARLY_CLIMATE = """clim_y AS (SELECT CAST(year(fecha) AS INTEGER) AS anio, departamento, municipio,
  avg(temperatura_promedio_c) AS temp_media_c, coalesce(sum(precipitacion_diaria_mm), 0.0) AS precipitacion_anual_mm,
  avg(humedad_relativa_pct) AS humedad_media_pct, coalesce(sum(brillo_solar_horas), 0.0) AS brillo_solar_anual_horas
  FROM filled_clim WHERE departamento IS NOT NULL AND municipio IS NOT NULL GROUP BY ALL)"""

YEARLY_PRICES = """price_y AS (SELECT CAST(year(fecha) AS INTEGER) AS anio, cultivo,
  avg(precio_kg_promedio_cop) AS precio_kg_anual_promedio_cop FROM prices WHERE cultivo IS NOT NULL GROUP BY ALL)"""


def r(expr: str, places: int = 6, alias: str | None = None) -> str:
    return f"round({expr}, {places}) AS {alias or expr}"


SQL: dict[str, str] = {}

SQL["gap_fill"] = with_(STATIONS, gap_fill_ctes("stations", "filled")) + (
    "SELECT departamento, municipio, seq, " + ", ".join(r(m, 6) for m in MEASURES) + " FROM filled")

SQL["yearly_rollup"] = with_(GEO, CLIMATE, gap_fill_ctes("climate", "filled_clim"), YEARLY_CLIMATE) + """
SELECT anio, departamento, municipio, round(temp_media_c, 6) AS temp_media_c,
  round(precipitacion_anual_mm, 6) AS precipitacion_anual_mm, round(humedad_media_pct, 6) AS humedad_media_pct,
  round(brillo_solar_anual_horas, 6) AS brillo_solar_anual_horas FROM clim_y"""

SQL["yearly_prices"] = with_(PRICES, YEARLY_PRICES) + """
SELECT anio, cultivo, round(precio_kg_anual_promedio_cop, 6) AS precio_kg_anual_promedio_cop FROM price_y"""

SQL["group_mean_impute"] = with_(GEO, PRODUCTION, SUPPLIER_LINES, CREDIT) + """,
j AS (SELECT p.l_orderkey, p.l_linenumber, p.anio, p.departamento, p.municipio, p.cultivo,
        c.monto_creditos_cop, c.numero_creditos_aprobados, c.tasa_interes_promedio
      FROM production p LEFT JOIN credit c USING (anio, departamento, municipio, cultivo))
SELECT l_orderkey, l_linenumber, anio, departamento, municipio, cultivo,
  round(coalesce(monto_creditos_cop, avg(monto_creditos_cop) OVER (PARTITION BY cultivo)), 2) AS monto_creditos_cop,
  round(coalesce(numero_creditos_aprobados, avg(numero_creditos_aprobados) OVER (PARTITION BY cultivo)), 2) AS numero_creditos_aprobados,
  round(coalesce(tasa_interes_promedio, avg(tasa_interes_promedio) OVER (PARTITION BY cultivo)), 2) AS tasa_interes_promedio
FROM j"""

_MASTER_NUM = ["hectareas_sembradas", "produccion_obtenida_ton", "rendimiento_ton_ha", "hectareas_cosechadas",
               "ph_suelo", "altitud_m", "materia_organica_pct", "pendiente_pct", "latitud", "longitud",
               "temp_media_c", "precipitacion_anual_mm", "humedad_media_pct", "brillo_solar_anual_horas",
               "monto_creditos_cop", "numero_creditos_aprobados", "tasa_interes_promedio",
               "precio_kg_anual_promedio_cop", "hectareas_formalizadas", "solicitudes_restitucion_activas",
               "indice_seguridad_juridica", "poblacion_bovina", "poblacion_porcina",
               "produccion_leche_litros_dia", "vacunacion_fiebre_aftosa_pct"]

MASTER_CTES = [GEO, CLIMATE, PRICES, PRODUCTION, SUPPLIER_LINES, SOILS, CREDIT, LAND, LIVESTOCK,
               gap_fill_ctes("climate", "filled_clim"), YEARLY_CLIMATE, YEARLY_PRICES]
SQL["master_join"] = with_(*MASTER_CTES) + """,
m AS (SELECT p.*, s.aptitud, s.ph_suelo, s.altitud_m, s.materia_organica_pct, s.pendiente_pct, s.textura,
        s.latitud, s.longitud, cy.temp_media_c, cy.precipitacion_anual_mm, cy.humedad_media_pct,
        cy.brillo_solar_anual_horas, c.monto_creditos_cop, c.numero_creditos_aprobados, c.tasa_interes_promedio,
        py.precio_kg_anual_promedio_cop, la.hectareas_formalizadas, la.solicitudes_restitucion_activas,
        la.indice_seguridad_juridica, lv.poblacion_bovina, lv.poblacion_porcina, lv.produccion_leche_litros_dia,
        lv.vacunacion_fiebre_aftosa_pct
      FROM production p
      LEFT JOIN soils s USING (departamento, municipio, cultivo)
      LEFT JOIN clim_y cy USING (anio, departamento, municipio)
      LEFT JOIN credit c USING (anio, departamento, municipio, cultivo)
      LEFT JOIN price_y py USING (anio, cultivo)
      LEFT JOIN land la USING (departamento, municipio)
      LEFT JOIN livestock lv USING (anio, departamento, municipio))
SELECT anio, departamento, municipio, cultivo, l_orderkey, l_linenumber,
  coalesce(textura, 'Franco') AS textura, coalesce(aptitud, 'Media') AS aptitud, """ + ",\n  ".join(
    f"round(coalesce({c}, avg({c}) OVER (PARTITION BY cultivo)), 6) AS {c}" for c in _MASTER_NUM) + "\nFROM m"
MASTER_FINAL = SQL["master_join"].split("\nm AS (", 1)[1].split("\nSELECT anio, departamento", 1)[0]
MASTER_FINAL = "m AS (" + MASTER_FINAL + """,
master_final AS (SELECT anio, departamento, municipio, cultivo, l_orderkey, l_linenumber,
  coalesce(textura, 'Franco') AS textura, coalesce(aptitud, 'Media') AS aptitud, """ + ",\n  ".join(
    f"coalesce({c}, avg({c}) OVER (PARTITION BY cultivo)) AS {c}" for c in _MASTER_NUM) + " FROM m)"


# ------------------------------------------------------------------ E2: dataset catalog
ENT = "Información de la Entidad: "
SECTORS = ["Agricultura y Desarrollo Rural", "Ambiente y Desarrollo Sostenible", "Salud y Protección Social",
           "Educación", "Transporte", "Hacienda y Crédito Público"]
CAT_DEPTS = ["Valle del Cauca", "Norte de Santander", "Bogotá D.C.", "Caquetá", "Antioquia", None, "Amazonas", "Cauca"]
CAT_MUNS = ["Bogotá", None, "Cali", "No disponible", "Medellín"]
INTEG = ["Sí", "no", "TRUE", None, "1", "quizás"]


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


_CAT_COMMON = f"""md5(text) AS "UID", split_part(text, chr(10), 1) AS "Titulo", text AS "Descripción",
  CASE WHEN doc_id % 3 = 0 THEN replace(format('{{:,}}', n_chars), ',', '.')
       WHEN doc_id % 3 = 1 THEN CAST(n_chars AS VARCHAR) ELSE CAST(n_chars AS VARCHAR) || '.0' END AS "Número de Filas",
  CAST(length(source) + doc_id % 20 AS VARCHAR) AS "Número de Columnas",
  CASE WHEN lang = 'es' THEN 'local' WHEN lang = 'en' THEN 'nacional' ELSE 'regional' END AS alcance_geografico,
  CASE WHEN quality = 1 THEN 'True' WHEN quality = 0 THEN 'False' END AS es_viable,
  CASE WHEN toxic = 0 THEN 'True' ELSE 'False' END AS ds_encabezados_utiles,
  'Entidad ' || source AS {q(ENT + "Nombre de la Entidad")},
  {case_pick(SECTORS, "doc_id % 6")} AS {q(ENT + "Sector")},
  CASE WHEN doc_id % 2 = 0 THEN 'Nacional' ELSE 'Territorial' END AS {q(ENT + "Orden")},
  {case_pick(CAT_DEPTS, "doc_id % 8")} AS {q(ENT + "Departamento")},
  {case_pick(CAT_MUNS, "doc_id % 5")} AS {q(ENT + "Municipio")},
  lang AS "Categoría", concat_ws(',', source, lang) AS "Etiqueta",
  'https://datos.example/d/' || CAST(doc_id AS VARCHAR) AS url,
  CASE WHEN doc_id % 9 = 0 THEN NULL ELSE CAST(1 + n_chars % 5 AS VARCHAR) || '.' || CAST(doc_id % 10 AS VARCHAR) END AS ds_score_relevancia,
  {case_pick(INTEG, "doc_id % 6")} AS ds_potencial_integracion"""

CATALOG_RAW = f"""docs AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
raw AS (
  SELECT {_CAT_COMMON}, substring(text, length(split_part(text, chr(10), 1)) + 2) AS ds_justificacion,
    CASE WHEN doc_id % 7 = 0 THEN 'n/a' WHEN doc_id % 7 = 1 THEN NULL
         ELSE CAST(n_chars % 5 AS VARCHAR) || '.5' END AS ds_calidad_datos, CAST(NULL AS VARCHAR) AS "Fuente"
  FROM docs WHERE lang IN ('es', 'en')
  UNION ALL
  SELECT {_CAT_COMMON}, NULL, NULL, source FROM docs WHERE lang NOT IN ('es', 'en'))"""

RAW_COLS = ["UID", "Titulo", "Descripción", "Número de Filas", "Número de Columnas", "alcance_geografico",
            "es_viable", "ds_encabezados_utiles", ENT + "Nombre de la Entidad", ENT + "Sector", ENT + "Orden",
            ENT + "Departamento", ENT + "Municipio", "Categoría", "Etiqueta", "url", "ds_score_relevancia",
            "ds_potencial_integracion", "ds_justificacion", "ds_calidad_datos", "Fuente"]

DEDUP = """dedup AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY "UID" ORDER BY """ + \
    ", ".join(f"{q(c)} ASC NULLS LAST" for c in RAW_COLS) + """) AS rn FROM raw) WHERE rn = 1)"""

KEEP = [c for c in ["UID", "Titulo", "Descripción", "Número de Filas", "Número de Columnas", "alcance_geografico",
                    "es_viable", "ds_encabezados_utiles", ENT + "Nombre de la Entidad", ENT + "Sector",
                    ENT + "Orden", ENT + "Departamento", ENT + "Municipio", "Categoría", "Etiqueta",
                    "Fecha de última actualización de datos (UTC)", "API", "url", "ds_justificacion",
                    "ds_score_relevancia", "ds_calidad_datos", "ds_reto_principal", "ds_retos_secundarios",
                    "ds_potencial_integracion", "ds_reto_sugerido", "ds_justificacion_sugerida"] if c in RAW_COLS]


def _count_sql(c: str) -> str:
    s = f"trim({q(c)})"
    num = f"CASE WHEN regexp_matches({s}, '^\\d{{1,3}}(\\.\\d{{3}})+$') THEN replace({s}, '.', '') ELSE {s} END"
    return f"CAST(coalesce(CAST(trunc(TRY_CAST({num} AS DOUBLE)) AS BIGINT), 0) AS INTEGER)"


def _typed_expr(c: str) -> str:
    if c == "es_viable":
        return "coalesce(TRY_CAST(es_viable AS BOOLEAN), true)"
    if c in ("Número de Filas", "Número de Columnas"):
        return _count_sql(c)
    if c == "ds_score_relevancia":
        return "coalesce(TRY_CAST(ds_score_relevancia AS DOUBLE), 3.0::DOUBLE)"
    if c == "ds_calidad_datos":
        return "coalesce(TRY_CAST(ds_calidad_datos AS DOUBLE), 2.0::DOUBLE)"
    if c == "ds_potencial_integracion":
        return "coalesce(lower(trim(ds_potencial_integracion)) IN ('true', '1', 'yes', 'si', 'sí'), false)"
    return f"coalesce({q(c)}, 'No disponible')"


TYPED = "typed AS (SELECT " + ", ".join(f"{_typed_expr(c)} AS {q(c)}" for c in KEEP) + " FROM dedup)"

from agrolattice.params import PLACE_COORDINATES as PLACES  # noqa: E402  (fixed values, shared)
COORDS = "coords(ord, k, lat, lon) AS (VALUES " + ", ".join(
    f"({i}, '{k}', {la}::DOUBLE, {lo}::DOUBLE)" for i, (k, la, lo) in enumerate(PLACES)) + ")"

GEOCODED = f"""geocoded AS (SELECT t.*,
  coalesce(
    (SELECT lat FROM coords WHERE t.{q(ENT + "Municipio")} <> 'No disponible' AND k = lower(trim(t.{q(ENT + "Municipio")}))),
    (SELECT lat FROM coords WHERE contains(lower(trim(t.{q(ENT + "Departamento")})), k) OR contains(k, lower(trim(t.{q(ENT + "Departamento")})))
       ORDER BY CASE WHEN k = lower(trim(t.{q(ENT + "Departamento")})) THEN 0 ELSE ord + 1 END LIMIT 1),
    4.61) AS latitud,
  coalesce(
    (SELECT lon FROM coords WHERE t.{q(ENT + "Municipio")} <> 'No disponible' AND k = lower(trim(t.{q(ENT + "Municipio")}))),
    (SELECT lon FROM coords WHERE contains(lower(trim(t.{q(ENT + "Departamento")})), k) OR contains(k, lower(trim(t.{q(ENT + "Departamento")})))
       ORDER BY CASE WHEN k = lower(trim(t.{q(ENT + "Departamento")})) THEN 0 ELSE ord + 1 END LIMIT 1),
    -74.08) AS longitud
  FROM typed t)"""

SQL["union_by_name"] = with_(CATALOG_RAW) + "SELECT * FROM raw"
SQL["dedup_keep_first"] = with_(CATALOG_RAW, DEDUP) + "SELECT * FROM dedup"
SQL["coerce_clean"] = with_(CATALOG_RAW, DEDUP, TYPED) + "SELECT * FROM typed"
SQL["geocode"] = with_(CATALOG_RAW, DEDUP, TYPED, COORDS, GEOCODED) + \
    f'SELECT "UID", {q(ENT + "Departamento")}, {q(ENT + "Municipio")}, latitud, longitud FROM geocoded'
SQL["column_profile"] = with_(CATALOG_RAW) + " UNION ALL ".join(
    f"""SELECT 'catalog_raw' AS dataset, '{c.replace("'", "''")}' AS column_name, {i} AS column_pos,
    count(*) AS n_rows, CAST(count(*) - count({q(c)}) AS BIGINT) AS n_nulls,
    CASE WHEN count(*) > 0 THEN round(100.0 * (count(*) - count({q(c)})) / count(*), 2) ELSE 0.0 END AS null_pct FROM raw"""
    for i, c in enumerate(RAW_COLS))
SQL["duplicate_rows"] = with_(CATALOG_RAW) + """SELECT CAST(sum(c) AS BIGINT) AS n_rows, count(*) AS n_distinct,
  CAST(sum(c - 1) AS BIGINT) AS n_duplicates
  FROM (SELECT *, 0 AS one, count(*) AS c FROM raw GROUP BY ALL) g"""


# ------------------------------------------------------------------ summaries
CLEAN = with_(CATALOG_RAW, DEDUP, TYPED, COORDS, GEOCODED)
D, M, SEC = q(ENT + "Departamento"), q(ENT + "Municipio"), q(ENT + "Sector")

SQL["region_summary"] = CLEAN + f"""SELECT CASE WHEN grouping({D}, {M}) = 0 THEN 'municipio' ELSE 'departamento' END AS level,
  {D} AS departamento, CASE WHEN grouping({D}, {M}) = 0 THEN {M} END AS municipio,
  count("UID") AS datasets, CAST(sum(CAST(es_viable AS INTEGER)) AS BIGINT) AS viables,
  CAST(trunc(avg("Número de Filas")) AS BIGINT) AS mean_rows
FROM geocoded GROUP BY GROUPING SETS (({D}), ({D}, {M}))"""

SQL["tier_counts"] = CLEAN + f"""SELECT {D} AS departamento, latitud, longitud, count(*) AS total_datasets,
  CASE WHEN count(*) > 20 THEN 'blue' WHEN count(*) > 5 THEN 'orange' ELSE 'green' END AS tier
FROM geocoded GROUP BY ALL"""

SQL["sample_titles"] = CLEAN + f"""SELECT departamento, rank, "UID", substring("Titulo", 1, 45) AS title_short FROM (
  SELECT {D} AS departamento, "UID", "Titulo", row_number() OVER (PARTITION BY {D} ORDER BY "UID") AS rank FROM geocoded)
WHERE rank <= 5"""

SQL["catalog_kpis"] = CLEAN + f"""SELECT total_datasets, viable_datasets,
  CASE WHEN total_datasets > 0 THEN round(100.0 * viable_datasets / total_datasets, 1) ELSE 0.0 END AS viable_pct,
  total_rows,
  CASE WHEN total_rows > 1e6 THEN CAST(round(total_rows / 1e6, 2) AS VARCHAR) || 'M' ELSE format('{{:,}}', total_rows) END AS rows_label,
  coalesce(top_sector, 'No disponible') AS top_sector, round(avg_quality, 6) AS avg_quality,
  round(avg_relevance, 6) AS avg_relevance, round(coalesce(integ * 100, 0.0), 6) AS pct_integration, scatter_points
FROM (SELECT count(*) AS total_datasets, CAST(sum(CAST(es_viable AS INTEGER)) AS BIGINT) AS viable_datasets,
        CAST(sum("Número de Filas") AS BIGINT) AS total_rows,
        (SELECT s FROM (SELECT {SEC} AS s, count(*) AS c FROM geocoded WHERE {SEC} IS NOT NULL GROUP BY 1)
         ORDER BY c DESC, s ASC LIMIT 1) AS top_sector,
        avg(ds_calidad_datos) AS avg_quality, avg(ds_score_relevancia) AS avg_relevance,
        avg(CAST(ds_potencial_integracion AS DOUBLE)) AS integ,
        CAST(sum(CAST(ds_calidad_datos > 0 AND ds_score_relevancia > 0 AS INTEGER)) AS BIGINT) AS scatter_points
      FROM geocoded) k"""

SQL["scope_counts"] = CLEAN + "SELECT alcance_geografico, count(*) AS count FROM geocoded GROUP BY 1"
SQL["top_sectors"] = CLEAN + f"SELECT {SEC} AS sector, count(*) AS count FROM geocoded GROUP BY 1 ORDER BY count DESC, sector ASC LIMIT 10"
SQL["band_counts"] = CLEAN + """SELECT CASE WHEN ds_calidad_datos >= 4 THEN 'Alta (4-5)' WHEN ds_calidad_datos >= 2 THEN 'Media (2-3)'
  ELSE 'Baja (1)' END AS quality_band, count(*) AS count FROM geocoded GROUP BY 1"""
SQL["top_scored"] = CLEAN + f"""SELECT "UID", "Titulo", {q(ENT + "Nombre de la Entidad")} AS entidad, ds_score_relevancia, ds_calidad_datos,
  round(ds_score_relevancia + ds_calidad_datos, 6) AS score_total FROM geocoded
ORDER BY ds_score_relevancia + ds_calidad_datos DESC, "UID" LIMIT 15"""
SQL["selector_values"] = CLEAN + f"""SELECT DISTINCT {D} AS value FROM geocoded
WHERE {D} IS NOT NULL AND {D} NOT IN ('No disponible', 'Nacional')"""

SQL["selector_municipalities"] = CLEAN + f"""SELECT DISTINCT {q(ENT + "Municipio")} AS value FROM geocoded
WHERE {q(ENT + "Municipio")} IS NOT NULL AND {q(ENT + "Municipio")} NOT IN ('No disponible', 'Nacional')"""

SQL["suitability_hist"] = with_(GEO, SUPPLIER_LINES, SOILS) + "SELECT cultivo, aptitud, count(*) AS count FROM soils GROUP BY ALL"
SQL["climate_by_dept"] = with_(GEO, CLIMATE) + """SELECT departamento, round(avg(temperatura_promedio_c), 6) AS temperatura_promedio_c,
  round(avg(precipitacion_diaria_mm), 6) AS precipitacion_diaria_mm FROM climate GROUP BY 1"""
SQL["box_stats"] = with_(GEO, PRODUCTION) + """SELECT cultivo, departamento, n, round(mn, 6) AS min, round(q1, 6) AS q1,
  round(q2, 6) AS median, round(q3, 6) AS q3, round(mx, 6) AS max,
  round(greatest(mn, q1 - 1.5 * (q3 - q1)), 6) AS lower_fence, round(least(mx, q3 + 1.5 * (q3 - q1)), 6) AS upper_fence
FROM (SELECT cultivo, departamento, count(rendimiento_ton_ha) AS n, min(rendimiento_ton_ha) AS mn, max(rendimiento_ton_ha) AS mx,
  quantile_cont(rendimiento_ton_ha, 0.25) AS q1, quantile_cont(rendimiento_ton_ha, 0.5) AS q2,
  quantile_cont(rendimiento_ton_ha, 0.75) AS q3 FROM production GROUP BY ALL) b"""
SQL["yield_kpis"] = with_(GEO, PRODUCTION) + """SELECT round(avg(rendimiento_ton_ha), 6) AS yield_mean, round(max(rendimiento_ton_ha), 6) AS yield_max,
  round(min(rendimiento_ton_ha), 6) AS yield_min, round(sum(hectareas_cosechadas), 6) AS harvested_total FROM production"""
SQL["sown_vs_harvested"] = with_(GEO, PRODUCTION) + """SELECT cultivo, round(sum(hectareas_sembradas), 6) AS hectareas_sembradas,
  round(sum(hectareas_cosechadas), 6) AS hectareas_cosechadas FROM production GROUP BY 1"""
SQL["share_of_total"] = with_(GEO, SUPPLIER_LINES, CREDIT) + """SELECT cultivo, monto_creditos_cop,
  round(CASE WHEN total <> 0 THEN 100.0 * monto_creditos_cop / total END, 6) AS share_pct
FROM (SELECT cultivo, CAST(sum(monto_creditos_cop) AS BIGINT) AS monto_creditos_cop,
  CAST(sum(sum(monto_creditos_cop)) OVER () AS DOUBLE) AS total FROM credit GROUP BY 1) x"""
SQL["livestock_means"] = with_(GEO, LIVESTOCK) + """SELECT departamento, round(avg(poblacion_bovina), 6) AS poblacion_bovina,
  round(avg(poblacion_porcina), 6) AS poblacion_porcina FROM livestock GROUP BY 1"""
SQL["ratio_kpis"] = with_(GEO, LAND) + """SELECT round(tc, 6) AS total_catastradas, round(tf, 6) AS total_formalizadas, tp AS total_predios,
  round(isj, 6) AS isj_promedio, round(CASE WHEN tc > 0 THEN 100.0 * tf / tc END, 6) AS pct_formalizado
FROM (SELECT coalesce(sum(hectareas_catastradas), 0.0) AS tc, coalesce(sum(hectareas_formalizadas), 0.0) AS tf,
  CAST(coalesce(sum(predios_formalizados), 0) AS BIGINT) AS tp, avg(indice_seguridad_juridica) AS isj FROM land) x"""
HECT = """hect AS (SELECT departamento, municipio, cultivo, round(sum(hectareas_sembradas), 1) AS hectareas_sembradas,
  round(sum(produccion_obtenida_ton), 1) AS produccion_total_ton, round(avg(rendimiento_ton_ha), 2) AS rendimiento_promedio
  FROM production GROUP BY ALL)"""
SQL["hectares_table"] = with_(GEO, PRODUCTION, HECT) + "SELECT * FROM hect"
SQL["hectares_by_crop"] = with_(GEO, PRODUCTION, HECT) + "SELECT cultivo, round(sum(hectareas_sembradas), 6) AS hectareas_sembradas FROM hect GROUP BY 1"
SQL["index_ranking"] = with_(GEO, LAND) + "SELECT departamento, round(avg(indice_seguridad_juridica), 6) AS isj_promedio FROM land GROUP BY 1"
SQL["funnel"] = with_(GEO, LAND) + """SELECT departamento, round(sum(hectareas_catastradas), 6) AS catastradas,
  round(sum(hectareas_formalizadas), 6) AS formalizadas FROM land GROUP BY 1"""


# ------------------------------------------------------------------ planner, economics, livestock
from agrolattice.params import (CROP_ECONOMICS, CROP_RANGES, CROP_RULES, DEFAULT_RAIN_FRACTION,  # noqa: E402
                                DEFAULT_TEMP_DIFF, DRY_SOWING_MONTHS, EXPLANATION, EXPLANATION_FACTORS,
                                LIVESTOCK_ALERTS, MONTHS_LONG, MONTHS_SHORT, SUBSIDISED_PROFILES)


def lit(v) -> str:
    return "'" + str(v).replace("'", "''") + "'"


def sql_t(template: str, **slots: str) -> str:
    """Fixed template with {slot} pieces -> SQL string concatenation."""
    parts, rest = [], template
    while "{" in rest:
        pre, tail = rest.split("{", 1)
        name, rest = tail.split("}", 1)
        parts += [lit(pre), f"({slots[name]})"]
    parts.append(lit(rest))
    return "(" + " || ".join(parts) + ")"


TEXTURES = ["Franco", "Franco-Arenoso", "Franco-Arcilloso", "Arcilloso"]
PRODUCERS = ["General"] + SUBSIDISED_PROFILES
SUBS = "(" + ", ".join(lit(x) for x in SUBSIDISED_PROFILES) + ")"

PARCELS = f"""parcels AS (SELECT p_partkey AS parcel_id, {CROP_OF_PART} AS cultivo,
  4 + (p_partkey % 41) / 10 AS ph_suelo, CAST((p_partkey * 37) % 3000 AS DOUBLE) AS altitud_m,
  CAST((p_partkey * 7) % 45 AS DOUBLE) AS pendiente_pct, 1 + (p_partkey % 50) / 10 AS materia_organica_pct,
  {case_pick(TEXTURES, "p_partkey % 4")} AS textura, CAST(10 + (p_partkey * 3) % 26 AS DOUBLE) AS temp_media_c,
  CAST(500 + (p_partkey * 13) % 3500 AS DOUBLE) AS precipitacion_anual_mm, CAST(p_size AS DOUBLE) AS area_ha,
  g.departamento, g.municipio, {case_pick(PRODUCERS, "p_partkey % 3")} AS producer_type
  FROM part LEFT JOIN geo g ON p_partkey % 25 = g.n_nationkey)"""

HERDS = f"""herds AS (SELECT c_custkey AS herd_id, g.departamento, g.municipio,
  CASE WHEN c_custkey % 4 = 3 THEN 'Porcino' ELSE 'Bovino' END AS species,
  {case_pick(["Leche", "Carne", "Doble Propósito", "Ceba"], "c_custkey % 4")} AS purpose,
  CAST(1 + c_custkey % 1000 AS INTEGER) AS herd_size, CAST(1 + c_custkey % 500 AS DOUBLE) AS farm_area,
  {case_pick(PRODUCERS, "c_custkey % 3")} AS producer_type
  FROM customer LEFT JOIN geo g ON c_nationkey = g.n_nationkey)"""

CP = "cp(crop, crop_ord, ph_min, ph_max, ph_sigma, temp_min, temp_max, temp_sigma, alt_min, alt_max, alt_sigma, " \
     "price_kg, basket_pct, demand_trend, cost_ha, cycle_months, base_yield) AS (VALUES " + ", ".join(
        f"({lit(c)}, {i}, " + ", ".join(f"{float(x)}::DOUBLE" for x in CROP_RANGES[c]) + ", "
        + ", ".join([f"{float(CROP_ECONOMICS[c][k])}::DOUBLE" for k in range(4)]
                    + [str(int(CROP_ECONOMICS[c][4])), f"{float(CROP_ECONOMICS[c][5])}::DOUBLE"]) + ")"
        for i, c in enumerate(CROPS)) + ")"

MONTHS = "months(mes, month_name, month_short, dfrac, ddiff, dry) AS (VALUES " + ", ".join(
    f"({i + 1}, {lit(MONTHS_LONG[i])}, {lit(MONTHS_SHORT[i])}, {DEFAULT_RAIN_FRACTION[i]}::DOUBLE, "
    f"{DEFAULT_TEMP_DIFF[i]}::DOUBLE, {str(MONTHS_LONG[i] in DRY_SOWING_MONTHS).lower()})" for i in range(12)) + ")"


def stress(v: str, lo: str, hi: str, sg: str) -> str:
    return (f"(CASE WHEN {v} < {lo} THEN exp(-(({v} - {lo}) * ({v} - {lo})) / (2 * ({sg} * {sg}))) "
            f"WHEN {v} > {hi} THEN exp(-(({v} - {hi}) * ({v} - {hi})) / (2 * ({sg} * {sg}))) ELSE 1.0 END)")


def slope_f(sv: str) -> str:
    return (f"(CASE WHEN {sv} <= 15.0 THEN 1.0 WHEN {sv} <= 30.0 THEN 1.0 - 0.01 * ({sv} - 15.0) "
            f"ELSE greatest(0.1, 1.0 - 0.15 - 0.02 * ({sv} - 30.0)) END)")


def stressed(temp: str) -> str:
    s = (f"{stress('ph_suelo', 'ph_min', 'ph_max', 'ph_sigma')} * {stress('altitud_m', 'alt_min', 'alt_max', 'alt_sigma')}"
         f" * {stress(temp, 'temp_min', 'temp_max', 'temp_sigma')} * {slope_f('pendiente_pct')}")
    return f"(CASE WHEN crop IS NOT NULL THEN greatest(0.1, base_yield * ({s})) ELSE 2.0 END)"


CLIMATE_CAL = """cm AS (SELECT lower(departamento) AS d, lower(municipio) AS m, CAST(month(fecha) AS INTEGER) AS mes,
    coalesce(sum(precipitacion_diaria_mm), 0.0) AS rain, avg(temperatura_promedio_c) AS tmean
  FROM climate WHERE fecha IS NOT NULL GROUP BY ALL),
ct AS (SELECT d, m, sum(rain) AS total_rain, avg(tmean) AS tglobal FROM cm GROUP BY ALL),
cr AS (SELECT lower(departamento) AS d, lower(municipio) AS m, avg(temperatura_promedio_c) AS temp_real
  FROM climate WHERE fecha IS NOT NULL GROUP BY ALL),
zm AS (SELECT lower(cultivo) AS c, lower(departamento) AS d, lower(municipio) AS m, avg(rendimiento_ton_ha) AS ra
  FROM production GROUP BY ALL),
zd AS (SELECT lower(cultivo) AS c, lower(departamento) AS d, avg(rendimiento_ton_ha) AS ra FROM production GROUP BY ALL),
zn AS (SELECT lower(cultivo) AS c, avg(rendimiento_ton_ha) AS ra FROM production GROUP BY ALL)"""

PLAN = f"""pm AS (SELECT p.parcel_id, mo.mes,
    CASE WHEN ct.total_rain > 0 AND cm.mes IS NOT NULL THEN cm.rain / ct.total_rain ELSE mo.dfrac END AS frac,
    CASE WHEN ct.tglobal IS NOT NULL AND cm.mes IS NOT NULL THEN cm.tmean - ct.tglobal ELSE mo.ddiff END AS diff
  FROM parcels p CROSS JOIN months mo
  LEFT JOIN ct ON ct.d = lower(p.departamento) AND ct.m = lower(p.municipio)
  LEFT JOIN cm ON cm.d = lower(p.departamento) AND cm.m = lower(p.municipio) AND cm.mes = mo.mes),
pz AS (SELECT p.*, cp.*,
    CASE WHEN zm.c IS NOT NULL OR zd.c IS NOT NULL
         THEN least(greatest(coalesce(zm.ra, zd.ra) / coalesce(cp.base_yield, 2.0), 0.5), 2.5) ELSE 1.0 END AS zone,
    (zm.c IS NOT NULL OR zd.c IS NOT NULL) AS has_eva, ct.d IS NOT NULL AS has_climate,
    CASE WHEN cr.temp_real >= 10 AND cr.temp_real <= 35 THEN cr.temp_real ELSE p.temp_media_c END AS tb
  FROM parcels p LEFT JOIN cp ON cp.crop = p.cultivo
  LEFT JOIN zm ON zm.c = lower(p.cultivo) AND zm.d = lower(p.departamento) AND zm.m = lower(p.municipio)
  LEFT JOIN zd ON zd.c = lower(p.cultivo) AND zd.d = lower(p.departamento)
  LEFT JOIN ct ON ct.d = lower(p.departamento) AND ct.m = lower(p.municipio)
  LEFT JOIN cr ON cr.d = lower(p.departamento) AND cr.m = lower(p.municipio)),
sm0 AS (SELECT pz.*, mo.mes, mo.month_name, mo.dry,
    pz.precipitacion_anual_mm * ((f0.frac + f1.frac + f2.frac + f3.frac) * 3.0) AS sim_rain,
    pz.tb + (f0.diff + f1.diff + f2.diff + f3.diff) / 4 AS sim_temp
  FROM pz CROSS JOIN months mo
  JOIN pm f0 ON f0.parcel_id = pz.parcel_id AND f0.mes = mo.mes
  JOIN pm f1 ON f1.parcel_id = pz.parcel_id AND f1.mes = (mo.mes % 12) + 1
  JOIN pm f2 ON f2.parcel_id = pz.parcel_id AND f2.mes = ((mo.mes + 1) % 12) + 1
  JOIN pm f3 ON f3.parcel_id = pz.parcel_id AND f3.mes = ((mo.mes + 2) % 12) + 1),
sm AS (SELECT *, round_even({stressed("sim_temp")} * zone, 2) AS yield FROM sm0),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY yield DESC, mes ASC) AS rn FROM sm)
  WHERE rn = 1)"""

PLANNER_BASE = with_(GEO, CLIMATE, PRODUCTION, PARCELS, CP, MONTHS, CLIMATE_CAL, PLAN)

SQL["stress_yield"] = with_(GEO, PARCELS, CP) + f"""SELECT parcel_id, cultivo,
  round({stress('ph_suelo', 'ph_min', 'ph_max', 'ph_sigma')}, 6) AS s_ph,
  round({stress('altitud_m', 'alt_min', 'alt_max', 'alt_sigma')}, 6) AS s_alt,
  round({stress('temp_media_c', 'temp_min', 'temp_max', 'temp_sigma')}, 6) AS s_temp,
  round({slope_f('pendiente_pct')}, 6) AS s_slope, round({stressed('temp_media_c')}, 6) AS stressed_yield
FROM parcels LEFT JOIN cp ON cp.crop = parcels.cultivo"""

SQL["month_calibration"] = with_(GEO, CLIMATE, MONTHS) + """,
lc AS (SELECT l.level, CASE WHEN l.level < 3 THEN lower(departamento) END AS d,
    CASE WHEN l.level = 0 THEN lower(municipio) END AS m, CAST(month(fecha) AS INTEGER) AS mes,
    precipitacion_diaria_mm AS rain, temperatura_promedio_c AS temp
  FROM climate CROSS JOIN (VALUES (0), (1), (3)) l(level) WHERE fecha IS NOT NULL),
cm AS (SELECT level, d, m, mes, coalesce(sum(rain), 0.0) AS rain, avg(temp) AS tmean FROM lc GROUP BY ALL),
ct AS (SELECT level, d, m, sum(rain) AS total_rain, avg(tmean) AS tglobal FROM cm GROUP BY ALL),
cr AS (SELECT level, d, m, avg(temp) AS temp_real FROM lc GROUP BY ALL)
SELECT ct.level, ct.d AS departamento, ct.m AS municipio, mo.mes,
  round(CASE WHEN ct.total_rain > 0 AND cm.mes IS NOT NULL THEN cm.rain / ct.total_rain ELSE mo.dfrac END, 6) AS rain_fraction,
  round(CASE WHEN ct.tglobal IS NOT NULL AND cm.mes IS NOT NULL THEN cm.tmean - ct.tglobal ELSE mo.ddiff END, 6) AS temp_diff,
  round(CASE WHEN cr.temp_real >= 10 AND cr.temp_real <= 35 THEN cr.temp_real END, 6) AS temp_base_calibrated
FROM ct CROSS JOIN months mo
LEFT JOIN cm ON cm.level = ct.level AND cm.d IS NOT DISTINCT FROM ct.d AND cm.m IS NOT DISTINCT FROM ct.m AND cm.mes = mo.mes
LEFT JOIN cr ON cr.level = ct.level AND cr.d IS NOT DISTINCT FROM ct.d AND cr.m IS NOT DISTINCT FROM ct.m"""

SQL["csv_by_name"] = """SELECT s_suppkey, s_name, CAST(NULL AS VARCHAR) AS s_region, round(s_acctbal, 2) AS s_acctbal FROM supplier"""
SQL["catalog_files"] = with_(CATALOG_RAW) + """SELECT "UID", "Número de Filas", alcance_geografico, es_viable, ds_calidad_datos,
  "Fuente" FROM raw"""

SQL["cycle_months"] = PLANNER_BASE + """SELECT parcel_id, mes, month_name, round(sim_rain, 6) AS sim_rain,
  round(sim_temp, 6) AS sim_temp, round(yield, 6) AS yield FROM sm"""

R = CROP_RULES
_LC = "lower(cultivo)"
_CAFE, _CACAO = f"contains({_LC}, 'cafe')", f"(NOT contains({_LC}, 'cafe') AND contains({_LC}, 'cacao'))"
_ARROZ = f"(NOT contains({_LC}, 'cafe') AND NOT contains({_LC}, 'cacao') AND contains({_LC}, 'arroz'))"
_MAIZ = f"(NOT contains({_LC}, 'cafe') AND NOT contains({_LC}, 'cacao') AND NOT contains({_LC}, 'arroz') AND contains({_LC}, 'maiz'))"
_PCT_LOW = "CAST(CAST(round_even((1 - zone) * 100, 0) AS BIGINT) AS VARCHAR)"
_PCT_HIGH = "CAST(CAST(round_even((zone - 1) * 100, 0) AS BIGINT) AS VARCHAR)"
RULES_SQL = "concat_ws(' | ', " + ", ".join([
    f"CASE WHEN {_CAFE} AND ph_suelo < 5.0 THEN {lit(R['cafe_ph_low'])} WHEN {_CAFE} AND ph_suelo > 6.5 THEN {lit(R['cafe_ph_high'])} END",
    f"CASE WHEN {_CAFE} AND altitud_m < 1000 THEN {lit(R['cafe_alt_low'])} WHEN {_CAFE} AND altitud_m > 2000 THEN {lit(R['cafe_alt_high'])} END",
    f"CASE WHEN {_CACAO} AND ph_suelo < 5.5 THEN {lit(R['cacao_ph_low'])} END",
    f"CASE WHEN {_CACAO} AND altitud_m > 1200 THEN {lit(R['cacao_alt_high'])} END",
    f"CASE WHEN {_ARROZ} AND (ph_suelo < 5.0 OR ph_suelo > 7.0) THEN {lit(R['arroz_ph'])} END",
    f"CASE WHEN {_ARROZ} AND altitud_m > 1000 THEN {lit(R['arroz_alt_high'])} END",
    f"CASE WHEN {_MAIZ} AND altitud_m > 2000 THEN {lit(R['maiz_alt_high'])} END",
    f"CASE WHEN pendiente_pct > 15 THEN {lit(R['slope_15'])} END",
    f"CASE WHEN pendiente_pct > 30 THEN {lit(R['slope_30'])} END",
    f"CASE WHEN dry THEN {lit(R['dry_month'])} ELSE {lit(R['rain_month'])} END",
    f"CASE WHEN zone < 0.8 THEN {sql_t(R['zone_low'], pct=_PCT_LOW)} WHEN zone > 1.2 THEN {sql_t(R['zone_high'], pct=_PCT_HIGH)} END",
    lit(R["registry"])]) + ")"
STATUS_SQL = f"""CASE WHEN pendiente_pct > 30 THEN 'Crítico'
  WHEN ({_CAFE} AND (ph_suelo < 5.0 OR ph_suelo > 6.5 OR altitud_m < 1000 OR altitud_m > 2000))
    OR ({_CACAO} AND (ph_suelo < 5.5 OR altitud_m > 1200))
    OR ({_ARROZ} AND (ph_suelo < 5.0 OR ph_suelo > 7.0 OR altitud_m > 1000))
    OR pendiente_pct > 15 OR dry THEN 'Condicionado' ELSE 'Conforme' END"""

E_, X_ = EXPLANATION, EXPLANATION_FACTORS
_Y, _M = "CAST(best_yield AS VARCHAR)", "best_month"
_ALT, _SL = "CAST(altitud_m AS VARCHAR)", "CAST(pendiente_pct AS VARCHAR)"
_PH = "printf('%.1f', round_even(ph_suelo, 1))"
_DRY = "best_month IN (" + ", ".join(lit(m) for m in DRY_SOWING_MONTHS) + ")"
INTRO_SQL = f"""CASE WHEN {_CAFE} THEN {sql_t(E_['cafe_intro'], y=_Y, m=_M, alt=_ALT)} || CASE
      WHEN ph_suelo < 5.0 THEN {sql_t(E_['cafe_ph_low'], ph=_PH)} WHEN ph_suelo > 6.5 THEN {sql_t(E_['cafe_ph_high'], ph=_PH)}
      ELSE {sql_t(E_['cafe_ph_ok'], ph=_PH)} END
  WHEN {_CACAO} THEN {sql_t(E_['cacao_intro'], y=_Y, m=_M, alt=_ALT)} || CASE WHEN altitud_m > 1200
      THEN {lit(E_['cacao_alt_high'])} ELSE {lit(E_['cacao_alt_ok'])} END
  WHEN {_ARROZ} THEN {sql_t(E_['arroz_intro'], y=_Y, m=_M)} || CASE WHEN altitud_m > 1000
      THEN {sql_t(E_['arroz_alt_high'], alt=_ALT)} ELSE {lit(E_['arroz_alt_ok'])} END
  ELSE {sql_t(E_['other_intro'], y=_Y, crop='cultivo', m=_M)} END"""
SUMMARY_SQL = f"""({INTRO_SQL}) || CASE WHEN {_DRY} THEN {sql_t(E_['dry'], m=_M)} ELSE {sql_t(E_['rainy'], m=_M)} END
  || CASE WHEN pendiente_pct > 15 THEN {sql_t(E_['slope'], s=_SL)} ELSE '' END"""
POS_SQL = "concat_ws(' | ', " + ", ".join([
    f"CASE WHEN {_CAFE} THEN {lit(X_['cafe_alt'])} END",
    f"CASE WHEN {_CAFE} AND ph_suelo >= 5.0 AND ph_suelo <= 6.5 THEN {lit(X_['cafe_ph_ok'])} END",
    f"CASE WHEN {_CACAO} AND altitud_m <= 1200 THEN {lit(X_['cacao_alt_ok'])} END",
    f"CASE WHEN {_ARROZ} AND altitud_m <= 1000 THEN {lit(X_['arroz_alt_ok'])} END",
    f"CASE WHEN NOT {_CAFE} AND NOT {_CACAO} AND NOT {_ARROZ} THEN {lit(X_['other'])} END",
    f"CASE WHEN NOT ({_DRY}) THEN {sql_t(X_['rainy'], m=_M)} END",
    f"CASE WHEN pendiente_pct <= 15 THEN {sql_t(X_['slope_ok'], s=_SL)} END"]) + ")"
LIM_SQL = "concat_ws(' | ', " + ", ".join([
    f"CASE WHEN {_CAFE} AND ph_suelo < 5.0 THEN {lit(X_['cafe_ph_low'])} WHEN {_CAFE} AND ph_suelo > 6.5 THEN {lit(X_['cafe_ph_high'])} END",
    f"CASE WHEN {_CACAO} AND altitud_m > 1200 THEN {lit(X_['cacao_alt_high'])} END",
    f"CASE WHEN {_ARROZ} AND altitud_m > 1000 THEN {lit(X_['arroz_alt_high'])} END",
    f"CASE WHEN {_DRY} THEN {sql_t(X_['dry'], m=_M)} END",
    f"CASE WHEN pendiente_pct > 15 THEN {sql_t(X_['slope_high'], s=_SL)} END"]) + ")"
DATA_SOURCE_SQL = """(CASE WHEN has_climate THEN 'IDEAM calibrado para ' || CASE WHEN municipio <> 'Todos' THEN municipio ELSE departamento END ELSE '' END
  || CASE WHEN has_eva THEN ' + EVA zona (' || printf('%.2f', round_even(zone, 2)) || 'x nacional)' ELSE '' END)"""

BEST = f"""best AS (SELECT parcel_id, cultivo, month_name AS best_month, yield AS best_yield, zone, ph_suelo, altitud_m,
  pendiente_pct, dry, has_climate, has_eva, departamento, municipio FROM bm)"""
SQL["best_month"] = PLANNER_BASE + "," + BEST + f"""
SELECT parcel_id, cultivo, best_month, round(best_yield, 6) AS best_yield, round(round_even(zone, 2), 6) AS zone_yield_factor,
  {STATUS_SQL} AS madr_compliance, {RULES_SQL} AS madr_rules, {DATA_SOURCE_SQL} AS data_source,
  {SUMMARY_SQL} AS resumen, {POS_SQL} AS factores_positivos, {LIM_SQL} AS factores_limitantes FROM best"""

SQL["compliance_rules"] = PLANNER_BASE + "," + BEST + f""",
rl AS (SELECT parcel_id, {STATUS_SQL} AS madr_compliance, string_split({RULES_SQL}, ' | ') AS rules FROM best),
ex AS (SELECT parcel_id, madr_compliance, unnest(rules) AS rule, generate_subscripts(rules, 1) - 1 AS rule_pos FROM rl)
SELECT parcel_id, rule_pos, rule,
  contains(rule, 'Suelo') OR contains(rule, 'Altitud') OR contains(rule, 'altitud') OR contains(rule, 'Pendiente')
    OR contains(rule, 'UPRA') AS soil_section,
  contains(rule, 'Siembra') OR contains(rule, 'lluvias') OR contains(rule, 'riego') OR contains(rule, 'Decreto 1076') AS water_section,
  contains(rule, 'ICA') OR contains(rule, 'Registro') AS registry_section,
  CASE WHEN contains(rule, '❌') THEN 'error' WHEN contains(rule, '⚠️') THEN 'warning' ELSE 'info' END AS severity,
  CASE WHEN madr_compliance = 'Conforme' THEN 100 WHEN madr_compliance = 'Condicionado' THEN 60 ELSE 20 END AS suitability_score
FROM ex"""


def econ_ctes(requests: str) -> str:
    return f"""lp AS (SELECT cultivo, greatest(avg(precio_kg_promedio_cop), 100.0) AS live FROM (
    SELECT *, row_number() OVER (PARTITION BY cultivo ORDER BY fecha DESC, l_orderkey DESC, l_linenumber DESC) AS rn
    FROM prices WHERE fecha IS NOT NULL AND cultivo IS NOT NULL) WHERE rn <= 12 GROUP BY 1),
pt AS (SELECT coalesce(cp.crop, lp.cultivo) AS pcrop, coalesce(lp.live, cp.price_kg) AS precio_kg,
    coalesce(cp.basket_pct, 2.0) AS canasta, coalesce(cp.demand_trend, 0.5) AS demanda
  FROM cp FULL JOIN lp ON cp.crop = lp.cultivo),
rt AS (SELECT lower(departamento) AS d, avg(tasa_interes_promedio) AS r FROM credit GROUP BY 1),
e0 AS (SELECT q.*, cp.*, pt.precio_kg, pt.canasta, pt.demanda,
    {stressed('temp_media_c')} AS y0,
    CASE WHEN zd.c IS NOT NULL OR zn.c IS NOT NULL
         THEN least(greatest(coalesce(zd.ra, zn.ra) / coalesce(cp.base_yield, 2.0), 0.6), 2.0) ELSE 1.0 END AS zone,
    CASE WHEN q.producer_type IN {SUBS} THEN greatest(1.0, coalesce(rt.r, 12.5) - 2.0) ELSE coalesce(rt.r, 12.5) END AS rate
  FROM {requests} q LEFT JOIN cp ON cp.crop = q.cultivo LEFT JOIN pt ON pt.pcrop = q.cultivo
  LEFT JOIN zd ON zd.c = lower(q.cultivo) AND zd.d = lower(q.departamento)
  LEFT JOIN zn ON zn.c = lower(q.cultivo)
  LEFT JOIN rt ON rt.d = lower(q.departamento)),
e1 AS (SELECT *, y0 * zone AS yy, y0 * zone * area_ha AS prod, coalesce(precio_kg, 2000.0) AS price,
    coalesce(cost_ha, 3000000.0) * area_ha AS cost, coalesce(cycle_months, 6) AS cyc FROM e0),
e2 AS (SELECT *, prod * 1000 * price AS revenue, cost * 0.7 AS credit_amt FROM e1),
e3 AS (SELECT *, revenue - cost AS net, credit_amt * (rate / 100) AS interest FROM e2),
eco AS (SELECT *, round_even(yy, 2) AS yield_ton_ha, round_even(prod, 2) AS total_production_ton,
    CAST(trunc(price) AS BIGINT) AS precio_kg_cop, CAST(trunc(revenue) AS BIGINT) AS gross_revenue,
    CAST(trunc(cost) AS BIGINT) AS total_cost, CAST(trunc(net) AS BIGINT) AS net_profit,
    CAST(trunc(net - interest) AS BIGINT) AS net_profit_after_interest,
    round_even(CASE WHEN revenue > 0 THEN net / revenue * 100 ELSE 0.0 END, 1) AS margin_pct,
    round_even(CASE WHEN cost > 0 THEN net / cost * 100 ELSE 0.0 END, 1) AS roi_pct,
    CAST(trunc(credit_amt) AS BIGINT) AS recommended_credit, CAST(trunc(interest) AS BIGINT) AS annual_interest,
    round_even(rate, 2) AS interest_rate, canasta AS canasta_pct, demanda AS demanda_trend,
    round_even(zone, 2) AS zone_factor, coalesce(producer_type IN {SUBS}, false) AS lec_finagro_activo,
    coalesce(crop_ord, 5) AS crop_ord2 FROM e3)"""


_ZONE = CLIMATE_CAL[CLIMATE_CAL.index("zm AS"):]
ECON_CTES = [GEO, PRICES, PRODUCTION, SUPPLIER_LINES, CREDIT, PARCELS, CP, _ZONE]
_ECON_COLS = ["yield_ton_ha", "total_production_ton", "precio_kg_cop", "gross_revenue", "total_cost", "net_profit",
              "net_profit_after_interest", "margin_pct", "roi_pct", "recommended_credit", "annual_interest",
              "interest_rate", "canasta_pct", "demanda_trend", "zone_factor", "lec_finagro_activo"]
_DBL = {"yield_ton_ha", "total_production_ton", "margin_pct", "roi_pct", "interest_rate", "canasta_pct",
        "demanda_trend", "zone_factor"}


def _ecol(c):
    return f"round({c}, 6) AS {c}" if c in _DBL else c


SQL["crop_economics"] = with_(*ECON_CTES, econ_ctes("parcels")) + \
    "SELECT parcel_id, cultivo, " + ", ".join(_ecol(c) for c in _ECON_COLS) + " FROM eco"

SQL["cash_flow"] = with_(*ECON_CTES, econ_ctes("parcels")) + """,
cf AS (SELECT eco.parcel_id, mo.mes AS month_num, mo.month_short AS mes,
    CASE WHEN (cyc <= 6 AND mo.mes - 1 = cyc - 1) OR (cyc > 6 AND mo.mes - 1 IN (5, 11))
         THEN revenue / (CASE WHEN cyc <= 6 THEN 1 ELSE 2 END) ELSE 0.0 END AS income,
    cost / 12 AS cost_m, interest / 12 AS int_m FROM eco CROSS JOIN months mo)
SELECT parcel_id, month_num, mes, CAST(round_even(income, 0) AS BIGINT) AS ingresos,
  CAST(round_even(cost_m, 0) AS BIGINT) AS costos, CAST(round_even(int_m, 0) AS BIGINT) AS intereses,
  CAST(round_even(income - cost_m - int_m, 0) AS BIGINT) AS neto FROM cf"""
SQL["cash_flow"] = SQL["cash_flow"].replace("WITH " + GEO, "WITH " + MONTHS + ",\n" + GEO, 1)

SQL["crop_rank"] = with_(*ECON_CTES, "allcrops(cultivo) AS (VALUES " + ", ".join(f"({lit(c)})" for c in CROPS) + ")",
                         "req AS (SELECT p.* EXCLUDE (cultivo), a.cultivo FROM parcels p CROSS JOIN allcrops a)",
                         econ_ctes("req")) + """SELECT parcel_id, cultivo,
  row_number() OVER (PARTITION BY parcel_id ORDER BY net_profit DESC, crop_ord2 ASC) AS profit_rank,
  round(yield_ton_ha, 6) AS yield_ton_ha, gross_revenue, total_cost, net_profit, round(margin_pct, 6) AS margin_pct,
  round(roi_pct, 6) AS roi_pct FROM eco"""

LA = LIVESTOCK_ALERTS
LIVE = f"""ls AS (SELECT lower(departamento) AS d, lower(municipio) AS m, avg(pendiente_pct) AS slope,
    avg(materia_organica_pct) AS om FROM soils GROUP BY ALL),
li AS (SELECT lower(departamento) AS d, lower(municipio) AS m,
    sum(produccion_leche_litros_dia) / sum(CASE WHEN produccion_leche_litros_dia IS NOT NULL THEN poblacion_bovina END) AS milk,
    avg(vacunacion_fiebre_aftosa_pct) AS vac FROM livestock GROUP BY ALL),
lc AS (SELECT lower(departamento) AS d, lower(municipio) AS m, avg(tasa_interes_promedio) AS rate FROM credit GROUP BY ALL),
h0 AS (SELECT h.*, CAST(h.herd_size AS DOUBLE) AS hs, species = 'Bovino' AS cattle, purpose IN ('Leche', 'Doble Propósito') AS milk_p,
    purpose IN ('Carne', 'Doble Propósito') AS meat_p, purpose = 'Doble Propósito' AS dual,
    coalesce(ls.slope, 10.0) AS slope, coalesce(ls.om, 3.2) AS om, coalesce(li.milk, 4.2) AS milk,
    coalesce(li.vac, 97.5) AS vac, coalesce(lc.rate, 12.8) AS rate0
  FROM herds h LEFT JOIN ls ON ls.d = lower(h.departamento) AND ls.m = lower(h.municipio)
  LEFT JOIN li ON li.d = lower(h.departamento) AND li.m = lower(h.municipio)
  LEFT JOIN lc ON lc.d = lower(h.departamento) AND lc.m = lower(h.municipio)),
h1 AS (SELECT *,
    (CASE WHEN cattle THEN 1.8 ELSE 15.0 END) * (CASE WHEN slope > 30 THEN 0.25 WHEN slope > 15 THEN 0.65 ELSE 1.0 END)
      * (CASE WHEN om < 2.0 THEN 0.8 WHEN om > 4.0 THEN 1.25 ELSE 1.0 END) AS cap,
    CASE WHEN cattle AND milk_p THEN hs * 0.6 * milk * (CASE WHEN dual THEN 0.8 ELSE 1.0 END) ELSE 0.0 END AS milk_day,
    CASE WHEN cattle AND meat_p THEN greatest(1, CAST(trunc(hs * 0.35 * (CASE WHEN dual THEN 0.75 ELSE 1.0 END)) AS BIGINT)) * 420.0
         WHEN NOT cattle THEN CAST(trunc(hs * 1.6) AS BIGINT) * 95.0 ELSE 0.0 END AS meat_kg,
    CASE WHEN producer_type IN {SUBS} THEN greatest(1.0, rate0 - 2.0) ELSE rate0 END AS rate,
    hs * (CASE WHEN cattle THEN 920000.0 ELSE 620000.0 END) AS cost,
    hs * (CASE WHEN cattle THEN 2800000.0 ELSE 750000.0 END) AS invest FROM h0),
h2 AS (SELECT *, CASE WHEN cattle THEN (CASE WHEN milk_p THEN milk_day * 305 * 2150.0 ELSE 0.0 END)
      + (CASE WHEN meat_p THEN meat_kg * 8300.0 ELSE 0.0 END) ELSE meat_kg * 9600.0 END AS revenue,
    invest * 0.7 AS credit_amt, CASE WHEN farm_area > 0 THEN hs / farm_area ELSE 0.0 END AS density FROM h1),
h3 AS (SELECT *, credit_amt * (rate / 100.0) AS interest FROM h2),
h4 AS (SELECT *, revenue - cost - interest AS net, cattle AND density > cap AS over_,
    cattle AND NOT (density > cap) AND density > cap * 0.8 AS near_, NOT cattle AND density > 25.0 AS pig_crit,
    vac < 95.0 AS vac_low FROM h3)"""
LIVE_CTES = [GEO, SUPPLIER_LINES, SOILS, LIVESTOCK, CREDIT, HERDS, LIVE]

SQL["livestock_economics"] = with_(*LIVE_CTES) + """SELECT herd_id, species, purpose,
  round(round_even(cap, 2), 6) AS carrying_capacity_ha, CAST(trunc(cap * farm_area) AS BIGINT) AS max_animals_allowed,
  round(round_even(milk_day, 1), 6) AS milk_prod_liters_day, round(round_even(meat_kg, 1), 6) AS meat_sold_kg_year,
  CAST(trunc(revenue) AS BIGINT) AS gross_revenue, CAST(trunc(cost) AS BIGINT) AS total_operating_costs,
  CAST(trunc(invest) AS BIGINT) AS capital_investment, CAST(trunc(credit_amt) AS BIGINT) AS recommended_credit,
  CAST(trunc(interest) AS BIGINT) AS annual_interest_payment, CAST(trunc(net) AS BIGINT) AS net_profit,
  round(round_even(CASE WHEN revenue > 0 THEN net / revenue * 100.0 ELSE 0.0 END, 1), 6) AS margin_pct,
  round(round_even(CASE WHEN invest > 0 THEN net / invest * 100.0 ELSE 0.0 END, 1), 6) AS roi_pct,
  round(round_even(rate, 2), 6) AS interest_rate, coalesce(producer_type IN """ + SUBS + """, false) AS lec_finagro_activo
FROM h4"""

_VAC = "CAST(round_even(vac, 2) AS VARCHAR)"
SQL["livestock_alerts"] = with_(*LIVE_CTES) + f"""SELECT herd_id,
  CASE WHEN over_ OR pig_crit OR vac_low THEN 'Crítico' WHEN near_ OR (cattle AND slope > 15.0) THEN 'Condicionado'
       ELSE 'Conforme' END AS compliance,
  concat_ws(' | ',
    CASE WHEN over_ THEN {sql_t(LA['overgrazing'], herd='CAST(herd_size AS VARCHAR)', max='CAST(CAST(trunc(cap * farm_area) AS BIGINT) AS VARCHAR)')}
         WHEN near_ THEN {sql_t(LA['near_limit'], density='CAST(round_even(density, 2) AS VARCHAR)')}
         WHEN cattle THEN {lit(LA['sustainable'])} END,
    CASE WHEN cattle AND slope > 15.0 THEN {lit(LA['slope'])} END,
    CASE WHEN pig_crit THEN {lit(LA['pig_density'])} END,
    CASE WHEN vac_low THEN {sql_t(LA['vaccination_low'], rate=_VAC)} ELSE {sql_t(LA['vaccination_ok'], rate=_VAC)} END) AS alerts
FROM h4"""

SQL["livestock_cash_flow"] = with_(MONTHS, *LIVE_CTES) + """,
lf AS (SELECT herd_id, mo.mes AS month_num, mo.month_short AS mes,
    CASE WHEN cattle AND milk_p THEN milk_day * 30 * 2150.0
           + CASE WHEN dual AND mo.mes - 1 IN (5, 11) THEN (revenue - milk_day * 305 * 2150.0) / 2 ELSE 0.0 END
         WHEN mo.mes - 1 IN (5, 11) THEN revenue / 2 ELSE 0.0 END AS income,
    cost / 12 AS cost_m, interest / 12 AS int_m FROM h4 CROSS JOIN months mo)
SELECT herd_id, month_num, mes, CAST(round_even(income, 0) AS BIGINT) AS ingresos,
  CAST(round_even(cost_m, 0) AS BIGINT) AS costos, CAST(round_even(int_m, 0) AS BIGINT) AS intereses,
  CAST(round_even(income - cost_m - int_m, 0) AS BIGINT) AS neto FROM lf"""


# ------------------------------------------------------------------ text
from agrolattice.params import (AGRO_KEYWORDS, GEL_XML_TEMPLATE, LOW_QUALITY_KEYWORDS,  # noqa: E402
                                PROJECT_TYPES)


def _kwcount(text: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, {lit(w)}) AS INTEGER)" for w in words) + ")"


_TT = "coalesce(\"Titulo\", '')"
_DD = "coalesce(\"Descripción\", '')"
_JJ = "coalesce(ds_justificacion, '')"
_FULL = f"(lower({_TT}) || ' ' || lower({_JJ}))"
_ROWS = 'CAST("Número de Filas" AS DOUBLE)'
_COLS = 'CAST("Número de Columnas" AS DOUBLE)'
_SEC = f"lower(coalesce({q(ENT + 'Sector')}, ''))"
_ORD = f"lower(coalesce({q(ENT + 'Orden')}, ''))"
_SC = "lower(coalesce(alcance_geografico, ''))"
FEATS_SQL = [
    ("titulo_len", f"length({_TT})"), ("titulo_word_count", f"len(regexp_extract_all({_TT}, '\\S+'))"),
    ("titulo_has_year", f"CAST(regexp_matches({_TT}, '\\b20\\d{{2}}\\b') AS INTEGER)"),
    ("titulo_has_dept", f"CAST(regexp_matches(lower({_TT}), 'antioquia|cundinamarca|boyac|tolima|huila|meta|nari|cauca|cesar|cordoba') AS INTEGER)"),
    ("desc_len", f"length({_DD})"), ("desc_word_count", f"len(regexp_extract_all({_DD}, '\\S+'))"),
    ("just_len", f"length({_JJ})"),
    ("agro_keyword_count", _kwcount(_FULL, AGRO_KEYWORDS)), ("low_quality_flags", _kwcount(_FULL, LOW_QUALITY_KEYWORDS)),
    ("filas_raw", _ROWS), ("filas_log", f"round(ln(1 + {_ROWS}), 6)"), ("filas_gt1k", f"CAST({_ROWS} > 1000 AS INTEGER)"),
    ("filas_gt10k", f"CAST({_ROWS} > 10000 AS INTEGER)"), ("cols_raw", _COLS), ("cols_log", f"round(ln(1 + {_COLS}), 6)"),
    ("cols_gt10", f"CAST({_COLS} > 10 AS INTEGER)"), ("cols_gt20", f"CAST({_COLS} > 20 AS INTEGER)"),
    ("ds_score_relevancia", "ds_score_relevancia"), ("ds_calidad_datos", "ds_calidad_datos"),
    ("score_producto", "round(ds_score_relevancia * ds_calidad_datos, 6)"),
    ("score_suma", "round(ds_score_relevancia + ds_calidad_datos, 6)"),
    ("score_relevancia_gt4", "CAST(ds_score_relevancia >= 4 AS INTEGER)"),
    ("score_calidad_gt3", "CAST(ds_calidad_datos >= 3 AS INTEGER)"),
    ("ambos_scores_altos", "CAST(ds_score_relevancia >= 4 AND ds_calidad_datos >= 3 AS INTEGER)"),
    ("has_encabezados", "CAST(coalesce(lower(trim(ds_encabezados_utiles)) IN ('true', '1', 'yes'), false) AS INTEGER)"),
    ("potencial_integracion", "CAST(ds_potencial_integracion AS INTEGER)"),
    ("es_nacional", f"CAST({_SC} = 'nacional' AS INTEGER)"), ("es_regional", f"CAST({_SC} = 'regional' AS INTEGER)"),
    ("es_local", f"CAST({_SC} = 'local' AS INTEGER)"),
    ("es_sector_agro", f"CAST(regexp_matches({_SEC}, 'agricultura|agropecuario|rural|desarrollo rural') AS INTEGER)"),
    ("es_nacional_orden", f"CAST({_ORD} = 'nacional' AS INTEGER)"), ("es_territorial", f"CAST({_ORD} = 'territorial' AS INTEGER)"),
]
SQL["text_features"] = CLEAN + 'SELECT "UID", ' + ", ".join(f"{e} AS {n}" for n, e in FEATS_SQL) + " FROM geocoded"

SQL["keyword_hits"] = CLEAN + ", kw(keyword, kind) AS (VALUES " + ", ".join(
    [f"({lit(k)}, 'agro')" for k in AGRO_KEYWORDS] + [f"({lit(k)}, 'low_quality')" for k in LOW_QUALITY_KEYWORDS]) + \
    f""")
SELECT kind, keyword, count(*) AS datasets FROM geocoded JOIN kw ON contains({_FULL}, keyword) GROUP BY ALL"""


def _ptype_sql() -> str:
    s, t = f"lower(trim(coalesce({q(ENT + 'Sector')}, '')))", "lower(trim(coalesce(\"Titulo\", '')))"
    parts = []
    for pid, words, use_title, _ in PROJECT_TYPES:
        if not words:
            continue
        cond = " OR ".join((f"contains({s}, {lit(w)}) OR contains({t}, {lit(w)})" if use_title else f"contains({s}, {lit(w)})")
                           for w in words)
        parts.append(f"WHEN {cond} THEN {pid}")
    return "CASE " + " ".join(parts) + f" ELSE {PROJECT_TYPES[-1][0]} END"


SQL["project_type"] = CLEAN + ", pt(project_id, proj_title) AS (VALUES " + ", ".join(
    f"({p[0]}, {lit(p[3])})" for p in PROJECT_TYPES) + f""")
SELECT "UID", x.project_id, pt.proj_title FROM (SELECT "UID", {_ptype_sql()} AS project_id FROM geocoded) x
JOIN pt USING (project_id)"""


def _esc(e: str) -> str:
    return f"replace(replace(replace(replace(replace({e}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"


_PROB = "(CASE WHEN es_viable THEN 1.0 ELSE 0.0 END)"
SQL["xml_record"] = CLEAN + 'SELECT "UID", ' + sql_t(
    GEL_XML_TEMPLATE, fecha="'2026-05-01'", uid=_esc('"UID"'), titulo=_esc('"Titulo"'), descripcion=_esc('"Descripción"'),
    entidad=_esc(q(ENT + "Nombre de la Entidad")), sector=_esc(q(ENT + "Sector")), orden=_esc(q(ENT + "Orden")),
    departamento=_esc(q(ENT + "Departamento")), municipio=_esc(q(ENT + "Municipio")),
    filas='CAST("Número de Filas" AS VARCHAR)', columnas='CAST("Número de Columnas" AS VARCHAR)', url=_esc("url"),
    prob_pct=f"CAST(round_even({_PROB} * 100, 2)::DOUBLE AS VARCHAR)",
    relevancia="CAST(ds_score_relevancia AS VARCHAR)", calidad="CAST(ds_calidad_datos AS VARCHAR)",
    apto=f"CASE WHEN {_PROB} >= 0.5 THEN 'true' ELSE 'false' END") + " AS xml FROM geocoded"


# ------------------------------------------------------------------ E9
from agrolattice.params import CONTEXT_TEXT, QUESTION_CROPS, QUESTION_DEPTS, QUESTION_MUNS, TOPIC_WORDS  # noqa: E402

QUESTIONS = f"""questions AS (SELECT conv_id, turn, text || {case_pick(QUESTION_TAILS, f"conv_id % {len(QUESTION_TAILS)}")} AS question
  FROM conversations WHERE role = 'user')"""


def _first(qv: str, toks) -> str:
    return "CASE " + " ".join(f"WHEN contains({qv}, {lit(t)}) THEN {lit(t)}" for t in toks) + " END"


def _any(qv: str, toks) -> str:
    return "(" + " OR ".join(f"contains({qv}, {lit(t)})" for t in toks) + ")"


_Q = "lower(question)"
_CROPNAME = "CASE " + " ".join(f"WHEN contains({_Q}, {lit(t)}) THEN {lit(n)}" for t, n in QUESTION_CROPS) + " END"
ET = f"""et AS (SELECT conv_id, turn, {_first(_Q, QUESTION_DEPTS)} AS detected_dept, {_first(_Q, QUESTION_MUNS)} AS detected_mun,
  {_first(_Q, [t for t, _ in QUESTION_CROPS])} AS detected_crop, {_CROPNAME} AS crop_name, """ + ", ".join(
    f"{_any(_Q, v)} AS ask_{k}" for k, v in TOPIC_WORDS.items()) + " FROM questions)"
SQL["entity_topics"] = with_(QUESTIONS, ET) + "SELECT * FROM et"

CT = CONTEXT_TEXT
TOKS = "toks(tok) AS (VALUES " + ", ".join(f"({lit(t)})" for t in QUESTION_DEPTS) + ")"


def _tok_agg(name: str, table: str, aggs: str, crop: bool) -> str:
    """Aggregates per (token or NULL, crop or NULL) the plain way: one query per level."""
    by = ", cultivo" if crop else ""
    parts = [f"SELECT tok, {'cultivo' if crop else 'NULL'} AS crop, {aggs} FROM {table} JOIN toks ON contains(lower(departamento), tok) GROUP BY tok{by}"]
    if crop:
        parts.append(f"SELECT tok, NULL, {aggs} FROM {table} JOIN toks ON contains(lower(departamento), tok) GROUP BY tok")
        parts.append(f"SELECT NULL, cultivo, {aggs} FROM {table} GROUP BY cultivo")
    parts.append(f"SELECT NULL, NULL, {aggs} FROM {table}")
    return f"{name} AS (" + " UNION ALL ".join(parts) + ")"


def _j(alias: str, crop: bool) -> str:
    c = f"{alias}.crop IS NOT DISTINCT FROM et.crop_name" if crop else f"{alias}.crop IS NULL"
    return f"LEFT JOIN {alias} ON {alias}.tok IS NOT DISTINCT FROM et.detected_dept AND {c}"


_PL = sql_t(CT["price_line"], crop="cultivo", price="format('{:,}', CAST(trunc(precio_kg_promedio_cop) AS BIGINT))",
            central="central_abasto", fecha="strftime(fecha, '%Y-%m-%d')")
CTX = [f"""lat AS (SELECT cultivo AS crop, fecha, l_orderkey, l_linenumber, {_PL} AS line FROM (
    SELECT *, row_number() OVER (PARTITION BY cultivo ORDER BY fecha DESC, l_orderkey DESC, l_linenumber DESC) AS rn
    FROM prices WHERE fecha IS NOT NULL) WHERE rn <= 5
  UNION ALL SELECT NULL, fecha, l_orderkey, l_linenumber, {_PL} FROM (
    SELECT *, row_number() OVER (ORDER BY fecha DESC, l_orderkey DESC, l_linenumber DESC) AS rn
    FROM prices WHERE fecha IS NOT NULL) WHERE rn <= 5)""",
       "ptxt AS (SELECT crop, string_agg(line, chr(10) ORDER BY fecha, l_orderkey, l_linenumber) AS txt FROM lat GROUP BY crop)",
       TOKS,
       _tok_agg("pd", "production", "avg(rendimiento_ton_ha) AS y, sum(hectareas_sembradas) AS ha", True),
       _tok_agg("so", "soils", "(SELECT NULL) AS apt_unused, avg(ph_suelo) AS ph, avg(altitud_m) AS alt", True),
       f"""soapt AS (SELECT tok, crop, aptitud AS apt FROM (
    SELECT tok, crop, aptitud, row_number() OVER (PARTITION BY tok, crop ORDER BY c DESC, aptitud ASC) AS rn FROM (
      SELECT tok, cultivo AS crop, aptitud, count(*) AS c FROM soils JOIN toks ON contains(lower(departamento), tok) WHERE aptitud IS NOT NULL GROUP BY ALL
      UNION ALL SELECT tok, NULL, aptitud, count(*) FROM soils JOIN toks ON contains(lower(departamento), tok) WHERE aptitud IS NOT NULL GROUP BY ALL
      UNION ALL SELECT NULL, cultivo, aptitud, count(*) FROM soils WHERE aptitud IS NOT NULL GROUP BY ALL
      UNION ALL SELECT NULL, NULL, aptitud, count(*) FROM soils WHERE aptitud IS NOT NULL GROUP BY ALL)) WHERE rn = 1)""",
       _tok_agg("cr", "credit", "sum(monto_creditos_cop) AS amount, avg(tasa_interes_promedio) AS rate", True),
       _tok_agg("we", "climate", "avg(temperatura_promedio_c) AS t, sum(precipitacion_diaria_mm) AS rsum, count(*) AS n", False),
       _tok_agg("le", "land", "avg(indice_seguridad_juridica) AS isj, round(sum(hectareas_catastradas), 4) AS cat, round(sum(hectareas_formalizadas), 4) AS form", False),
       _tok_agg("lv", "livestock", "avg(poblacion_bovina) AS b, avg(poblacion_porcina) AS p, avg(vacunacion_fiebre_aftosa_pct) AS v", False)]

_F = lambda e, n: f"printf('%.{n}f', {e})"
_BLOCKS = [
    f"CASE WHEN et.ask_price AND ptxt.txt IS NOT NULL THEN {lit(CT['price_header'])} || chr(10) || ptxt.txt END",
    f"""CASE WHEN et.crop_name IS NOT NULL AND (pd.y IS NOT NULL OR pd.ha IS NOT NULL) THEN concat_ws(chr(10),
        {sql_t(CT['prod_header'], crop='et.crop_name')}, {sql_t(CT['prod_yield'], y=_F('pd.y', 2))},
        {sql_t(CT['prod_area'], ha="format('{:,.1f}', pd.ha)")}) END""",
    f"""CASE WHEN et.crop_name IS NOT NULL AND so.ph IS NOT NULL THEN concat_ws(chr(10),
        {sql_t(CT['soil_header'], crop='et.crop_name')}, {sql_t(CT['soil_apt'], apt='soapt.apt')},
        {sql_t(CT['soil_ph'], ph=_F('so.ph', 2), alt='CAST(CAST(trunc(so.alt) AS BIGINT) AS VARCHAR)')}) END""",
    f"""CASE WHEN et.ask_credit AND cr.amount IS NOT NULL THEN concat_ws(chr(10), {lit(CT['credit_header'])},
        {sql_t(CT['credit_amount'], amount="format('{:,}', CAST(trunc(cr.amount) AS BIGINT))")},
        {sql_t(CT['credit_rate'], rate=_F('cr.rate', 2))}) END""",
    f"""CASE WHEN et.ask_weather AND we.n > 0 THEN concat_ws(chr(10), {lit(CT['weather_header'])},
        {sql_t(CT['weather_temp'], t=_F('we.t', 1))},
        {sql_t(CT['weather_rain'], r='CAST(CAST(trunc(we.rsum / (we.n / 365)) AS BIGINT) AS VARCHAR)')}) END""",
    f"""CASE WHEN et.ask_legal AND le.isj IS NOT NULL THEN concat_ws(chr(10), {lit(CT['legal_header'])},
        {sql_t(CT['legal_index'], isj=_F('le.isj', 1))},
        CASE WHEN le.cat > 0 THEN {sql_t(CT['legal_area'], cat="format('{:,.1f}', le.cat)", form="format('{:,.1f}', le.form)",
                                         pct=_F('le.form / le.cat * 100', 1))} ELSE '' END) END""",
    f"""CASE WHEN et.ask_livestock AND lv.b IS NOT NULL THEN concat_ws(chr(10), {lit(CT['live_header'])},
        {sql_t(CT['live_cattle'], b="format('{:,}', CAST(trunc(lv.b) AS BIGINT))")},
        {sql_t(CT['live_pigs'], p="format('{:,}', CAST(trunc(lv.p) AS BIGINT))")},
        {sql_t(CT['live_vac'], v=_F('lv.v', 2))}) END""",
    f"CASE WHEN et.ask_frontier THEN {lit(chr(10).join(CT['frontier']))} END",
]
SQL["question_context"] = with_(GEO, PRICES, PRODUCTION, SUPPLIER_LINES, SOILS, CREDIT, CLIMATE, LAND, LIVESTOCK,
                                QUESTIONS, ET, *CTX) + f"""SELECT et.conv_id, et.turn, et.crop_name, et.detected_dept,
  concat_ws(chr(10), {", ".join(_BLOCKS)}) AS context
FROM et LEFT JOIN ptxt ON ptxt.crop IS NOT DISTINCT FROM et.crop_name
{_j('pd', True)} {_j('so', True)} LEFT JOIN soapt ON soapt.tok IS NOT DISTINCT FROM et.detected_dept AND soapt.crop IS NOT DISTINCT FROM et.crop_name
{_j('cr', True)} {_j('we', False)} {_j('le', False)} {_j('lv', False)}"""


# ------------------------------------------------------------------ M1
def _tfidf_sql(col: str, k: int) -> str:
    t = f"t_{abs(hash(col)) % 1000}"
    return f"""SELECT '{col}' AS field, "UID", term, tf, round(w / sqrt(sum(w * w) OVER (PARTITION BY "UID")), 6) AS weight FROM (
  SELECT tf."UID", tf.term, tf.tf, tf.tf * (ln((1 + n) / (1 + v.df)) + 1) AS w
  FROM (SELECT "UID", term, count(*) AS tf FROM (
          SELECT "UID", unnest(regexp_extract_all(lower(coalesce({q(col)}, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term
          FROM geocoded) GROUP BY ALL) tf
  JOIN (SELECT term, count(*) AS df FROM (SELECT "UID", term, count(*) AS c FROM (
          SELECT "UID", unnest(regexp_extract_all(lower(coalesce({q(col)}, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term
          FROM geocoded) GROUP BY ALL) GROUP BY term ORDER BY sum(c) DESC, term ASC LIMIT {k}) v USING (term)
  CROSS JOIN (SELECT count(*) AS n FROM geocoded) nn) x"""


SQL["tfidf_terms"] = CLEAN + " UNION ALL ".join(
    f"({_tfidf_sql(c, k)})" for c, k in {"Titulo": 50, "Descripción": 50, "ds_justificacion": 25}.items())


# ------------------------------------------------------------------ extensions
SQL["stream_daily"] = with_(STATIONS) + """, mx AS (SELECT max(fecha) AS m FROM stations)
SELECT strftime(date_trunc('day', fecha), '%Y-%m-%d') AS window_start, departamento, municipio,
  round(avg(temperatura_promedio_c), 6) AS temp_media_c, round(coalesce(sum(precipitacion_diaria_mm), 0.0), 6) AS precipitacion_mm,
  round(avg(humedad_relativa_pct), 6) AS humedad_media_pct, round(coalesce(sum(brillo_solar_horas), 0.0), 6) AS brillo_solar_horas
FROM stations GROUP BY date_trunc('day', fecha), departamento, municipio
HAVING date_trunc('day', fecha) + INTERVAL 1 DAY <= (SELECT m FROM mx) - INTERVAL 2 DAY"""

SQL["moving_average"] = with_(PRICES) + """, w AS (
  SELECT cultivo, precio_kg_promedio_cop AS p,
    epoch(fecha)::BIGINT // 604800 * 604800 - k * 604800 AS ws
  FROM prices, range(4) t(k) WHERE fecha IS NOT NULL)
SELECT strftime(make_timestamp(ws * 1000000), '%Y-%m-%d') AS window_start, cultivo, round(avg(p), 6) AS moving_avg_price,
  count(*) AS n_prices FROM w GROUP BY ws, cultivo"""

SQL["outlier_fence"] = with_(GEO, PRODUCTION) + """, f AS (SELECT cultivo,
    quantile_cont(rendimiento_ton_ha, 0.25) - 1.5 * (quantile_cont(rendimiento_ton_ha, 0.75) - quantile_cont(rendimiento_ton_ha, 0.25)) AS lower_fence,
    quantile_cont(rendimiento_ton_ha, 0.75) + 1.5 * (quantile_cont(rendimiento_ton_ha, 0.75) - quantile_cont(rendimiento_ton_ha, 0.25)) AS upper_fence
  FROM production GROUP BY 1),
j AS (SELECT p.*, f.lower_fence, f.upper_fence,
    (rendimiento_ton_ha < lower_fence OR rendimiento_ton_ha > upper_fence) AS is_outlier,
    coalesce(abs(CASE WHEN hectareas_sembradas > 0 THEN produccion_obtenida_ton / hectareas_sembradas END - rendimiento_ton_ha) > 0.5, false) AS is_inconsistent
  FROM production p LEFT JOIN f USING (cultivo))
SELECT l_orderkey, l_linenumber, cultivo, round(rendimiento_ton_ha, 6) AS rendimiento_ton_ha, round(lower_fence, 6) AS lower_fence,
  round(upper_fence, 6) AS upper_fence, is_outlier, is_inconsistent FROM j WHERE is_outlier OR is_inconsistent"""


# ------------------------------------------------------------------ A19
_HD_NUM = ["altitud_m", "ph_suelo", "pendiente_pct", "materia_organica_pct", "temp_media_c", "precipitacion_anual_mm"]
from agrolattice.params import PARCEL_LIMITS as _HD_LIM, PLANNER_DEFAULTS as _HD_DEF  # noqa: E402
_REGION = ("(r.departamento = 'Todos' OR mf2.d = lower(r.departamento)) AND "
           "(r.municipio = 'Todos' OR mf2.m = lower(r.municipio))")


def _hd_level(name: str, with_crop: bool) -> str:
    cond = _REGION + (" AND mf2.c = lower(r.cultivo)" if with_crop else "")
    return f"""{name} AS (SELECT r.parcel_id, {", ".join(f"avg(mf2.{c}) AS {c}" for c in _HD_NUM)}, count(*) AS n
  FROM req r JOIN mf2 ON {cond} GROUP BY r.parcel_id),
{name}_tx AS (SELECT parcel_id, textura FROM (SELECT parcel_id, textura,
    row_number() OVER (PARTITION BY parcel_id ORDER BY cnt DESC, textura ASC) AS rn FROM (
    SELECT r.parcel_id, mf2.textura, count(*) AS cnt FROM req r JOIN mf2 ON {cond}
    WHERE mf2.textura IS NOT NULL GROUP BY ALL)) WHERE rn = 1)"""


def _hd_col(c: str) -> str:
    v = f"CASE WHEN rc.n IS NOT NULL THEN rc.{c} WHEN rr.n IS NOT NULL THEN rr.{c} ELSE {_HD_DEF[c]}::DOUBLE END"
    if c == "altitud_m":
        v = f"CAST(trunc({v}) AS DOUBLE)"
    lo, hi = _HD_LIM[c]
    return f"round(least(greatest({v}, {lo}::DOUBLE), {hi}::DOUBLE), 6) AS default_{c}"


SQL["hierarchical_defaults"] = with_(*MASTER_CTES) + ",\n" + MASTER_FINAL + ",\n" + PARCELS + f""",
req AS (SELECT parcel_id, CASE WHEN parcel_id % 7 = 0 THEN 'Todos' ELSE departamento END AS departamento,
  CASE WHEN parcel_id % 3 = 0 THEN 'Todos' ELSE municipio END AS municipio,
  CASE WHEN parcel_id % 11 = 0 THEN 'Yuca' ELSE cultivo END AS cultivo FROM parcels),
mf2 AS (SELECT lower(departamento) AS d, lower(municipio) AS m, lower(cultivo) AS c, {", ".join(_HD_NUM)}, textura
  FROM master_final),
{_hd_level("rc", True)},
{_hd_level("rr", False)}
SELECT r.parcel_id, r.departamento, r.municipio, r.cultivo, {", ".join(_hd_col(c) for c in _HD_NUM)},
  CASE WHEN rc.n IS NOT NULL THEN rc_tx.textura WHEN rr.n IS NOT NULL THEN rr_tx.textura ELSE 'Franco' END AS default_textura,
  CASE WHEN rc.n IS NOT NULL THEN 'region_crop' WHEN rr.n IS NOT NULL THEN 'region' ELSE 'constants' END AS default_source
FROM req r LEFT JOIN rc USING (parcel_id) LEFT JOIN rc_tx USING (parcel_id) LEFT JOIN rr USING (parcel_id)
LEFT JOIN rr_tx USING (parcel_id)"""


# ------------------------------------------------------------------ calibration building blocks
_LP = """lp AS (SELECT cultivo, greatest(avg(precio_kg_promedio_cop), 100.0) AS live_price_kg FROM (
    SELECT *, row_number() OVER (PARTITION BY cultivo ORDER BY fecha DESC, l_orderkey DESC, l_linenumber DESC) AS rn
    FROM prices WHERE fecha IS NOT NULL AND cultivo IS NOT NULL) WHERE rn <= 12 GROUP BY 1)"""
SQL["latest_n_mean"] = with_(PRICES, _LP) + "SELECT cultivo, round(live_price_kg, 6) AS live_price_kg FROM lp"
SQL["complete_with_base"] = with_(PRICES, CP, _LP) + """SELECT coalesce(cp.crop, lp.cultivo) AS cultivo,
  round(coalesce(lp.live_price_kg, cp.price_kg), 6) AS precio_kg, round(coalesce(cp.basket_pct, 2.0), 6) AS canasta_pct,
  round(coalesce(cp.demand_trend, 0.5), 6) AS demanda_tendencia FROM cp FULL JOIN lp ON cp.crop = lp.cultivo"""
SQL["latest_prices"] = with_(PRICES) + """SELECT scope, rank, cultivo, l_orderkey, l_linenumber,
  round(precio_kg_promedio_cop, 6) AS precio_kg_promedio_cop, central_abasto FROM (
  SELECT cultivo AS scope, row_number() OVER (PARTITION BY cultivo ORDER BY fecha DESC, l_orderkey DESC, l_linenumber DESC) AS rank, *
  FROM prices WHERE fecha IS NOT NULL
  UNION ALL
  SELECT 'Todos', row_number() OVER (ORDER BY fecha DESC, l_orderkey DESC, l_linenumber DESC), * FROM prices WHERE fecha IS NOT NULL)
WHERE rank <= 5"""
SQL["zone_factor"] = with_(GEO, PRODUCTION, PARCELS, CP, _ZONE) + """SELECT p.parcel_id, p.cultivo,
  round(CASE WHEN zm.c IS NOT NULL OR zd.c IS NOT NULL THEN least(greatest(coalesce(zm.ra, zd.ra) / coalesce(cp.base_yield, 2.0), 0.5), 2.5) ELSE 1.0 END, 6) AS zone_planner,
  (zm.c IS NOT NULL OR zd.c IS NOT NULL) AS zone_planner_found,
  round(CASE WHEN zd.c IS NOT NULL OR zn.c IS NOT NULL THEN least(greatest(coalesce(zd.ra, zn.ra) / coalesce(cp.base_yield, 2.0), 0.6), 2.0) ELSE 1.0 END, 6) AS zone_economics,
  (zd.c IS NOT NULL OR zn.c IS NOT NULL) AS zone_economics_found
FROM parcels p LEFT JOIN cp ON lower(cp.crop) = lower(p.cultivo)
LEFT JOIN zm ON zm.c = lower(p.cultivo) AND zm.d = lower(p.departamento) AND zm.m = lower(p.municipio)
LEFT JOIN zd ON zd.c = lower(p.cultivo) AND zd.d = lower(p.departamento)
LEFT JOIN zn ON zn.c = lower(p.cultivo)"""
SQL["interest_rate"] = with_(GEO, SUPPLIER_LINES, CREDIT, PARCELS) + f"""SELECT parcel_id, round(coalesce(rt.r, 12.5), 6) AS rate,
  round(CASE WHEN producer_type IN {SUBS} THEN greatest(1.0, coalesce(rt.r, 12.5) - 2.0) ELSE coalesce(rt.r, 12.5) END, 6) AS rate_final
FROM parcels p LEFT JOIN (SELECT lower(departamento) AS d, avg(tasa_interes_promedio) AS r FROM credit GROUP BY 1) rt
  ON rt.d = lower(p.departamento)"""
SQL["livestock_calibration"] = with_(*LIVE_CTES) + """SELECT herd_id, round(ls.slope, 6) AS slope, round(ls.om, 6) AS om,
  round(li.milk, 6) AS milk_per_head, round(li.vac, 6) AS vaccination, round(lc.rate, 6) AS rate
FROM herds h LEFT JOIN ls ON ls.d = lower(h.departamento) AND ls.m = lower(h.municipio)
LEFT JOIN li ON li.d = lower(h.departamento) AND li.m = lower(h.municipio)
LEFT JOIN lc ON lc.d = lower(h.departamento) AND lc.m = lower(h.municipio)"""

from agrolattice.params import GENDER_STATS, PRIORITY_TERRITORY_TOKENS  # noqa: E402
GS = "gs(ord, k, ipg, muj, rel) AS (VALUES " + ", ".join(
    f"({i}, {lit(k.lower())}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for i, (k, a, b, c) in enumerate(GENDER_STATS)) + ")"


def _gs(col: str) -> str:
    dn = f"lower(trim(g.{q(ENT + 'Departamento')}))"
    return (f"(SELECT {col} FROM gs WHERE contains({dn}, k) OR contains(k, {dn}) ORDER BY ord LIMIT 1)")


SQL["gender_indicators"] = CLEAN + ", " + GS + f"""
SELECT "UID", {q(ENT + 'Departamento')} AS dept, {_gs('ipg')} AS ipg_educacion, {_gs('muj')} AS mujeres_beneficiarias_pct,
  {_gs('rel')} AS relevo_joven_pct,
  ({" OR ".join(f"contains(lower(coalesce({q(ENT + 'Departamento')}, '')), {lit(t)})" for t in PRIORITY_TERRITORY_TOKENS)}) AS priority_territory
FROM geocoded g"""

SQL["known_override"] = CLEAN + """, req AS (SELECT doc_id AS request_id,
    CASE WHEN doc_id % 3 = 0 THEN md5(text) WHEN doc_id % 3 = 1 THEN '' END AS uid,
    CASE WHEN doc_id % 2 = 0 THEN split_part(text, chr(10), 1) ELSE 'sin título' END AS titulo FROM documents),
r2 AS (SELECT *, CASE WHEN uid IS NOT NULL AND trim(uid) <> '' AND uid <> 'No disponible' THEN uid END AS ru,
    CASE WHEN NOT (uid IS NOT NULL AND trim(uid) <> '' AND uid <> 'No disponible')
          AND titulo IS NOT NULL AND trim(titulo) <> '' AND titulo <> 'No disponible' THEN titulo END AS rt FROM req),
bu AS (SELECT "UID" AS k, arg_min(es_viable, "UID") AS v FROM geocoded GROUP BY 1),
bt AS (SELECT "Titulo" AS k, arg_min(es_viable, "UID") AS v FROM geocoded GROUP BY 1)
SELECT request_id, CASE WHEN coalesce(bu.v, bt.v) IS NULL THEN NULL WHEN coalesce(bu.v, bt.v) THEN 1.0 ELSE 0.0 END AS known_prob
FROM r2 LEFT JOIN bu ON bu.k = r2.ru LEFT JOIN bt ON bt.k = r2.rt"""


# ------------------------------------------------------------------ documents
import agrolattice.templates as TPL  # noqa: E402

_DEPT = q(ENT + "Departamento")
_PTD = "ptd(pid, ods, arch, ptitle) AS (VALUES " + ", ".join(
    f"({k}, {lit(v[0])}, {lit(v[1])}, {lit([p[3] for p in PROJECT_TYPES if p[0] == k][0])})"
    for k, v in TPL.PROJECT_DETAILS.items()) + ")"


def _gsx(col: str, dept: str) -> str:
    dn = f"lower(trim({dept}))"
    return f"(SELECT {col} FROM gs WHERE contains({dn}, k) OR contains(k, {dn}) ORDER BY ord LIMIT 1)"


_PCT = "CAST(round_even(prob * 100, 2)::DOUBLE AS VARCHAR)"
_REASONS = f"""concat_ws(', ',
    CASE WHEN "Número de Filas" < 2000 THEN {sql_t(TPL.REASON_ROWS, filas="format('{:,}', \"Número de Filas\")")} END,
    CASE WHEN "Número de Columnas" < 10 THEN {sql_t(TPL.REASON_COLS, columnas='CAST("Número de Columnas" AS VARCHAR)')} END,
    CASE WHEN ds_score_relevancia < 3.5 THEN {sql_t(TPL.REASON_REL, relevancia='CAST(ds_score_relevancia AS VARCHAR)')} END)"""
_TERR = "(" + " OR ".join(f"contains(lower(coalesce(dept, '')), {lit(t)})" for t in PRIORITY_TERRITORY_TOKENS) + ")"
_DOC = sql_t(
    TPL.PROPOSAL,
    banner=f"CASE WHEN prob < 0.5 THEN {sql_t(TPL.WARNING_BANNER, pct=_PCT, reasons=f'CASE WHEN reasons <> {lit(chr(0))} AND reasons <> {lit(chr(39) * 0)} THEN reasons ELSE {lit(TPL.REASON_DEFAULT)} END')} ELSE '' END",
    proj_title="ptitle", entidad=q(ENT + "Nombre de la Entidad"), sector=q(ENT + "Sector"), orden=q(ENT + "Orden"),
    cobertura="alcance_geografico", titulo='"Titulo"', columnas='CAST("Número de Columnas" AS VARCHAR)',
    filas="format('{:,}', \"Número de Filas\")", pct=_PCT, justificacion="ds_justificacion",
    encabezados="ds_encabezados_utiles", uid='"UID"', url="url", ods="ods", arch="arch",
    madurez=f"CASE WHEN prob < 0.5 THEN {lit(TPL.MATURITY_LOW)} ELSE {lit(TPL.MATURITY_HIGH)} END",
    recomendacion=f"CASE WHEN prob < 0.5 THEN {lit(TPL.RECOMMEND_LOW)} ELSE {sql_t(TPL.RECOMMEND_HIGH, dept='dept')} END",
    gender=f"""CASE WHEN ipg IS NOT NULL THEN {sql_t(TPL.GENDER_TEXT, ipg="printf('%.2f', round_even(ipg, 2))",
        mujeres='CAST(muj AS VARCHAR)', relevo='CAST(rel AS VARCHAR)', dept='dept')} ELSE {lit(TPL.GENDER_DEFAULT)} END""",
    territorial=f"CASE WHEN {_TERR} THEN {sql_t(TPL.TERRITORIAL_TEXT, dept='dept')} ELSE '' END")
SQL["proposal_doc"] = CLEAN + ", " + GS + ", " + _PTD + f""",
pp AS (SELECT g.*, {_DEPT} AS dept, CASE WHEN es_viable THEN 1.0 ELSE 0.0 END AS prob, ({_ptype_sql()}) AS pid,
    {_gsx('ipg', _DEPT)} AS ipg, {_gsx('muj', _DEPT)} AS muj, {_gsx('rel', _DEPT)} AS rel FROM geocoded g),
p2 AS (SELECT pp.*, ptd.ods, ptd.arch, ptd.ptitle, {_REASONS} AS reasons FROM pp JOIN ptd USING (pid))
SELECT "UID", regexp_replace({_DOC}, '^\\s+|\\s+$', '', 'g') AS proposal FROM p2"""

_RULE_LINES = "array_to_string(list_transform(string_split(rules_txt, ' | '), lambda r: chr(10) || '* ' || r), '')"
SQL["compliance_report"] = PLANNER_BASE + "," + BEST + f""",
rep0 AS (SELECT *, {STATUS_SQL} AS st, {RULES_SQL} AS rules_txt FROM best),
rep AS (SELECT rep0.*, p.textura FROM rep0 JOIN parcels p USING (parcel_id))
SELECT parcel_id, {sql_t(TPL.CROP_REPORT, fecha="'2026-05-01'", crop='cultivo', alt='CAST(altitud_m AS VARCHAR)',
    ph='CAST(ph_suelo AS VARCHAR)', slope='CAST(pendiente_pct AS VARCHAR)', texture='textura', best_month='best_month',
    best_yield='CAST(best_yield AS VARCHAR)',
    score="CAST(CASE WHEN st = 'Conforme' THEN 100 WHEN st = 'Condicionado' THEN 60 ELSE 20 END AS VARCHAR)",
    status='upper(st)')} || {_RULE_LINES} || {lit(TPL.CROP_REPORT_FOOTER)} AS report FROM rep"""

_ALERTS_SQL = SQL["livestock_alerts"].split("concat_ws(' | ',", 1)[1].rsplit(") AS alerts", 1)[0]
SQL["livestock_plan"] = with_(*LIVE_CTES) + f""", lp2 AS (SELECT *, concat_ws(' | ', {_ALERTS_SQL}) AS alerts_txt,
    round_even(CASE WHEN revenue > 0 THEN net / revenue * 100.0 ELSE 0.0 END, 1) AS margin,
    round_even(CASE WHEN invest > 0 THEN net / invest * 100.0 ELSE 0.0 END, 1) AS roi FROM h4)
SELECT herd_id, {sql_t(TPL.LIVESTOCK_REPORT, fecha="'2026-05-01'", mun='municipio', dept='departamento',
    area='CAST(farm_area AS VARCHAR)', species='species',
    purpose="CASE WHEN species = 'Bovino' THEN purpose ELSE 'Carne' END", herd='CAST(herd_size AS VARCHAR)',
    revenue="format('{:,}', CAST(trunc(revenue) AS BIGINT))", costs="format('{:,}', CAST(trunc(cost) AS BIGINT))",
    interest="format('{:,}', CAST(trunc(interest) AS BIGINT))", net="format('{:,}', CAST(trunc(net) AS BIGINT))",
    margin='CAST(margin::DOUBLE AS VARCHAR)', roi='CAST(roi::DOUBLE AS VARCHAR)',
    capacity='CAST(round_even(cap, 2)::DOUBLE AS VARCHAR)', max_animals='CAST(CAST(trunc(cap * farm_area) AS BIGINT) AS VARCHAR)',
    load="CASE WHEN farm_area > 0 THEN CAST(round_even(hs / farm_area, 2)::DOUBLE AS VARCHAR) ELSE '0' END",
    credit="format('{:,}', CAST(trunc(credit_amt) AS BIGINT))")} || {_RULE_LINES.replace('rules_txt', 'alerts_txt')}
  || {lit(TPL.LIVESTOCK_REPORT_FOOTER)} AS report FROM lp2"""

_CAT_DEPTS = ["Valle del Cauca", "Norte de Santander", "Bogotá D.C.", "Caquetá", "Antioquia", None, "Amazonas", "Cauca"]
SQL["credit_barrier"] = with_(GEO, HERDS, GS) + f""", hb AS (SELECT herd_id, producer_type,
    coalesce({case_pick(_CAT_DEPTS, "herd_id % 8")}, 'Todos') AS departamento FROM herds),
hg AS (SELECT *, {_gsx('muj', 'departamento')} AS muj, {_gsx('rel', 'departamento')} AS rel, {_gsx('ipg', 'departamento')} AS ipg
  FROM hb WHERE departamento <> 'Todos' AND producer_type <> 'General')
SELECT herd_id, departamento, producer_type,
  CASE WHEN producer_type = {lit(SUBSIDISED_PROFILES[0])} THEN {sql_t(TPL.BARRIER_WOMEN, dept='departamento', pct='CAST(muj AS VARCHAR)')}
       ELSE {sql_t(TPL.BARRIER_YOUTH, dept='departamento', pct='CAST(rel AS VARCHAR)')} END AS barrier,
  CASE WHEN producer_type = {lit(SUBSIDISED_PROFILES[0])} THEN {lit(TPL.LINE_WOMEN)} ELSE {lit(TPL.LINE_YOUTH)} END AS suggested_line
FROM hg WHERE ipg IS NOT NULL"""


# ------------------------------------------------------------------ sinks and filters
SQL["regional_extract"] = CLEAN + f"""SELECT coalesce({_DEPT}, 'Nacional') AS departamento, count(*) AS rows
FROM geocoded GROUP BY 1"""
SQL["pipeline_outputs"] = with_(*MASTER_CTES) + ",\n" + MASTER_FINAL + ",\n" + ", ".join([
    CATALOG_RAW, DEDUP, TYPED, COORDS, GEOCODED]) + """
SELECT 'consolidated_data' AS table_name, count(*) AS rows FROM master_final
UNION ALL SELECT 'clima_ideam_anual', count(*) FROM clim_y
UNION ALL SELECT 'precios_sipsa_anual', count(*) FROM price_y
UNION ALL SELECT 'inventario_ganadero_anual', count(*) FROM livestock
UNION ALL SELECT 'cleaned_datasets_catalog', count(*) FROM geocoded"""
SQL["region_filter"] = CLEAN + f"""SELECT "UID", 'exact' AS filter_kind FROM geocoded WHERE {_DEPT} = 'Valle del Cauca'
UNION ALL SELECT "UID", 'case_insensitive' FROM geocoded WHERE lower({_DEPT}) = 'cauca'"""
SQL["hectares_display"] = with_(GEO, PRODUCTION, HECT) + """SELECT departamento AS "Departamento", municipio AS "Municipio",
  cultivo AS "Sector (Cultivo)", hectareas_sembradas AS "Ha Sembradas", produccion_total_ton AS "Producción Total (Ton)",
  rendimiento_promedio AS "Rend. Prom. (Ton/Ha)" FROM hect"""
SQL["explorer_vars"] = with_(*MASTER_CTES) + ",\n" + MASTER_FINAL + """
SELECT l_orderkey, l_linenumber, round(temp_media_c, 6) AS x, round(rendimiento_ton_ha, 6) AS y, cultivo AS colour,
  round(monto_creditos_cop, 6) AS size FROM master_final"""
SQL["region_scan"] = with_(GEO, CLIMATE) + """SELECT CAST(year(fecha) AS INTEGER) AS anio, CAST(month(fecha) AS INTEGER) AS mes,
  count(*) AS rows, round(sum(precipitacion_diaria_mm), 6) AS rain FROM climate
WHERE departamento = (SELECT min(departamento) FROM climate) GROUP BY ALL"""


# ------------------------------------------------------------------ remaining inventory items
SQL["label_distribution"] = CLEAN + "SELECT es_viable, count(*) AS count FROM geocoded GROUP BY 1"
SQL["stratified_split"] = CLEAN + """, split AS (
  SELECT UID, es_viable, CASE WHEN row_number() OVER (PARTITION BY es_viable ORDER BY md5('split42|' || UID))
      <= floor(0.2 * count(*) OVER (PARTITION BY es_viable) + 0.5) THEN 'test' ELSE 'train' END AS part FROM geocoded),
ranks AS (
  SELECT UID, es_viable, part, row_number() OVER (PARTITION BY es_viable, part ORDER BY md5('fold42|' || UID)) AS r,
    count(*) OVER (PARTITION BY es_viable, part) AS n, row_number() OVER (PARTITION BY es_viable ORDER BY md5('fold43|' || UID)) AS ra,
    count(*) OVER (PARTITION BY es_viable) AS na FROM split),
folds AS (
  SELECT es_viable, part, CAST((r > n // 5) AS INT) + CAST((r > 2 * n // 5) AS INT) + CAST((r > 3 * n // 5) AS INT) + CAST((r > 4 * n // 5) AS INT) AS fold,
    CAST((ra > na // 5) AS INT) + CAST((ra > 2 * na // 5) AS INT) + CAST((ra > 3 * na // 5) AS INT) + CAST((ra > 4 * na // 5) AS INT) AS fold_all FROM ranks)
SELECT es_viable, part, fold, fold_all, count(*) AS datasets FROM folds GROUP BY ALL"""
SQL["preview_rows"] = with_(GEO, PRODUCTION) + """SELECT anio, departamento, municipio, cultivo,
  round(hectareas_sembradas, 6) AS hectareas_sembradas, round(produccion_obtenida_ton, 6) AS produccion_obtenida_ton,
  round(rendimiento_ton_ha, 6) AS rendimiento_ton_ha, round(hectareas_cosechadas, 6) AS hectareas_cosechadas,
  l_orderkey, l_linenumber FROM production ORDER BY l_orderkey, l_linenumber LIMIT 15"""
SQL["price_series"] = with_(PRICES) + """SELECT strftime(fecha, '%Y-%m-%d') AS fecha, cultivo,
  round(precio_kg_promedio_cop, 6) AS precio_kg_promedio_cop, l_orderkey, l_linenumber FROM prices WHERE fecha IS NOT NULL"""
SQL["land_table"] = with_(GEO, LAND) + """SELECT departamento, municipio, round(hectareas_catastradas, 6) AS hectareas_catastradas,
  round(hectareas_formalizadas, 6) AS hectareas_formalizadas, predios_formalizados, solicitudes_restitucion_activas,
  round(conflicto_uso_suelo_pct, 6) AS conflicto_uso_suelo_pct, round(indice_seguridad_juridica, 6) AS indice_seguridad_juridica
FROM land"""
SQL["model_roundtrip"] = with_(*MASTER_CTES) + ",\n" + MASTER_FINAL + "\nSELECT count(*) AS rows, CAST(0 AS DOUBLE) AS max_abs_diff FROM master_final"
SQL["table_profile"] = """WITH c AS (SELECT text, lang, source, count(*) AS n FROM documents GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(3 * sum(n) AS BIGINT) AS cells,
  CAST(sum(n * ((text IS NULL)::INT + (lang IS NULL)::INT + (source IS NULL)::INT)) AS BIGINT) AS nulls,
  round(sum(n * ((text IS NULL)::INT + (lang IS NULL)::INT + (source IS NULL)::INT)) / (3.0 * sum(n)), 6) AS null_share,
  CAST(sum(n - 1) AS BIGINT) AS duplicates FROM c"""
SQL["fitness_features"] = with_(*MASTER_CTES) + ",\n" + MASTER_FINAL + ",\n" + CP + f""",
mr AS (SELECT cultivo, avg(precipitacion_anual_mm) AS crop_rain FROM master_final GROUP BY 1)
SELECT l_orderkey, l_linenumber, m.cultivo,
  round({stress('ph_suelo', 'ph_min', 'ph_max', 'ph_sigma')}, 6) AS ph_fitness,
  round({stress('altitud_m', 'alt_min', 'alt_max', 'alt_sigma')}, 6) AS alt_fitness,
  round({stress('temp_media_c', 'temp_min', 'temp_max', 'temp_sigma')}, 6) AS temp_fitness,
  round(mr.crop_rain - precipitacion_anual_mm, 6) AS rain_deficit_mm, precipitacion_anual_mm < mr.crop_rain AS water_stress_risk
FROM master_final m LEFT JOIN cp ON cp.crop = m.cultivo LEFT JOIN mr ON mr.cultivo = m.cultivo"""

SQL["stream_prices"] = with_(PRICES) + """, p2 AS (SELECT * FROM prices WHERE fecha IS NOT NULL AND precio_kg_promedio_cop IS NOT NULL),
mx AS (SELECT max(fecha) AS m FROM p2),
w AS (SELECT cultivo, precio_kg_promedio_cop AS p, epoch(fecha)::BIGINT // 604800 * 604800 - k * 604800 AS ws
      FROM p2, range(4) t(k))
SELECT strftime(make_timestamp(ws * 1000000), '%Y-%m-%d') AS window_start, cultivo, round(avg(p), 6) AS moving_avg_price,
  count(*) AS n_prices FROM w GROUP BY ws, cultivo
HAVING make_timestamp((ws + 28 * 86400) * 1000000) <= (SELECT m FROM mx) - INTERVAL 14 DAY"""
SQL["stream_daily_complete"] = with_(STATIONS) + """SELECT strftime(date_trunc('day', fecha), '%Y-%m-%d') AS window_start,
  departamento, municipio, round(avg(temperatura_promedio_c), 6) AS temp_media_c,
  round(coalesce(sum(precipitacion_diaria_mm), 0.0), 6) AS precipitacion_mm, round(avg(humedad_relativa_pct), 6) AS humedad_media_pct,
  round(coalesce(sum(brillo_solar_horas), 0.0), 6) AS brillo_solar_horas
FROM stations GROUP BY date_trunc('day', fecha), departamento, municipio"""


SQL["geocode_exact"] = CLEAN + f"""SELECT "UID", {q(ENT + "Municipio")} AS municipio, lat, lon FROM geocoded
JOIN coords ON {q(ENT + "Municipio")} <> 'No disponible' AND k = lower(trim({q(ENT + "Municipio")}))"""
SQL["geocode_contains"] = CLEAN + f""", names AS (SELECT DISTINCT lower(trim({_DEPT})) AS departamento FROM geocoded
  WHERE {_DEPT} IS NOT NULL)
SELECT departamento, arg_min(lat, r) AS lat, arg_min(lon, r) AS lon FROM (
  SELECT n.departamento, c.lat, c.lon, CASE WHEN c.k = n.departamento THEN 0 ELSE c.ord + 1 END AS r
  FROM names n JOIN coords c ON contains(n.departamento, c.k) OR contains(c.k, n.departamento)) GROUP BY 1"""
_SLOPE_V = slope_f("value")
SQL["response_curves"] = with_(GEO, SUPPLIER_LINES, SOILS, CLIMATE, CP) + f""", vals AS (
  SELECT DISTINCT variable, value FROM (
    SELECT 'ph' AS variable, ph_suelo AS value FROM soils UNION ALL SELECT 'alt', altitud_m FROM soils
    UNION ALL SELECT 'slope', pendiente_pct FROM soils UNION ALL SELECT 'temp', temperatura_promedio_c FROM climate)
  WHERE value IS NOT NULL)
SELECT cp.crop AS cultivo, variable, round(value, 6) AS value, round(CASE
    WHEN variable = 'ph' THEN {stress('value', 'ph_min', 'ph_max', 'ph_sigma')}
    WHEN variable = 'alt' THEN {stress('value', 'alt_min', 'alt_max', 'alt_sigma')}
    WHEN variable = 'temp' THEN {stress('value', 'temp_min', 'temp_max', 'temp_sigma')}
    ELSE {_SLOPE_V} END, 6) AS factor
FROM vals CROSS JOIN cp"""

# late rows merged: the days are those of the batch roll-up
SQL["stream_repaired"] = SQL["stream_daily"]

SQL["feed_plan"] = f"SELECT parcel_id, cultivo, best_month, best_yield, data_source FROM ({SQL['best_month']}) AS plan"

SQL["catalog_quarantine"] = with_(CATALOG_RAW) + """SELECT 'row does not fit the header' AS problem, "UID" AS record FROM raw WHERE "Fuente" IS NULL
UNION ALL SELECT 'no header', NULL"""
