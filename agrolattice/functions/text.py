"""Text features and text generation as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import (AGRO_KEYWORDS, AGRO_SECTOR_PATTERN, HEADER_TRUE_TOKENS, LOW_QUALITY_KEYWORDS,
                      PRIORITY_TERRITORY_TOKENS, PROJECT_TYPES, TITLE_DEPT_PATTERN, TITLE_YEAR_PATTERN)
from ..schemas import ENT

WORD = r"\S+"


def word_count(c: Column) -> Column:
    """whitespace-separated words (empty text -> 0)."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(WORD))


def keyword_count(text: Column, words: list[str]) -> Column:
    """F8: how many of ``words`` occur in ``text`` (substring semantics, each counted once)."""
    total = None
    for w in words:
        hit = text.contains(w).cast("int")
        total = hit if total is None else total + hit
    return total


def _col(df: DataFrame, name: str, default) -> Column:
    return F.col(f"`{name}`") if name in df.columns else F.lit(default)


def catalog_features(df: DataFrame) -> DataFrame:
    """The 32 numeric features of the viability model, one row per dataset."""
    title = F.coalesce(_col(df, "Titulo", ""), F.lit("")).cast("string")
    desc = F.coalesce(_col(df, "Descripción", ""), F.lit("")).cast("string")
    just = F.coalesce(_col(df, "ds_justificacion", ""), F.lit("")).cast("string")
    full = F.concat(F.lower(title), F.lit(" "), F.lower(just)) if "ds_justificacion" in df.columns else F.lower(title)
    rows = F.coalesce(_col(df, "Número de Filas", 0).cast("double"), F.lit(0.0))
    cols = F.coalesce(_col(df, "Número de Columnas", 0).cast("double"), F.lit(0.0))
    rel = F.coalesce(_col(df, "ds_score_relevancia", 3.0).cast("double"), F.lit(3.0))
    cal = F.coalesce(_col(df, "ds_calidad_datos", 2.0).cast("double"), F.lit(2.0))
    headers = F.lower(F.trim(_col(df, "ds_encabezados_utiles", "").cast("string"))).isin(*HEADER_TRUE_TOKENS)
    scope = F.lower(F.coalesce(_col(df, "alcance_geografico", ""), F.lit("")))
    sector = F.lower(F.coalesce(_col(df, ENT + "Sector", ""), F.lit("")))
    order = F.lower(F.coalesce(_col(df, ENT + "Orden", ""), F.lit("")))
    integ = F.coalesce(_col(df, "ds_potencial_integracion", False).cast("int"), F.lit(0))
    i = lambda c: c.cast("int")
    feats = {
        "titulo_len": F.length(title), "titulo_word_count": word_count(title),
        "titulo_has_year": i(title.rlike(TITLE_YEAR_PATTERN)),
        "titulo_has_dept": i(F.lower(title).rlike(TITLE_DEPT_PATTERN)),
        "desc_len": F.length(desc), "desc_word_count": word_count(desc), "just_len": F.length(just),
        "agro_keyword_count": keyword_count(full, AGRO_KEYWORDS),
        "low_quality_flags": keyword_count(full, LOW_QUALITY_KEYWORDS),
        "filas_raw": rows, "filas_log": F.log1p(rows), "filas_gt1k": i(rows > 1000), "filas_gt10k": i(rows > 10000),
        "cols_raw": cols, "cols_log": F.log1p(cols), "cols_gt10": i(cols > 10), "cols_gt20": i(cols > 20),
        "ds_score_relevancia": rel, "ds_calidad_datos": cal, "score_producto": rel * cal, "score_suma": rel + cal,
        "score_relevancia_gt4": i(rel >= 4), "score_calidad_gt3": i(cal >= 3),
        "ambos_scores_altos": i((rel >= 4) & (cal >= 3)),
        "has_encabezados": i(F.coalesce(headers, F.lit(False))), "potencial_integracion": integ,
        "es_nacional": i(scope == "nacional"), "es_regional": i(scope == "regional"), "es_local": i(scope == "local"),
        "es_sector_agro": i(sector.rlike(AGRO_SECTOR_PATTERN)),
        "es_nacional_orden": i(order == "nacional"), "es_territorial": i(order == "territorial"),
    }
    return df.withColumns(feats)


FEATURE_NAMES = ["titulo_len", "titulo_word_count", "titulo_has_year", "titulo_has_dept", "desc_len",
                 "desc_word_count", "just_len", "agro_keyword_count", "low_quality_flags", "filas_raw", "filas_log",
                 "filas_gt1k", "filas_gt10k", "cols_raw", "cols_log", "cols_gt10", "cols_gt20",
                 "ds_score_relevancia", "ds_calidad_datos", "score_producto", "score_suma", "score_relevancia_gt4",
                 "score_calidad_gt3", "ambos_scores_altos", "has_encabezados", "potencial_integracion", "es_nacional",
                 "es_regional", "es_local", "es_sector_agro", "es_nacional_orden", "es_territorial"]


def project_type(sector: Column, title: Column) -> Column:
    """project type id by the ordered keyword rules (first two also look at the title)."""
    s, t = F.lower(F.trim(F.coalesce(sector, F.lit("")))), F.lower(F.trim(F.coalesce(title, F.lit(""))))
    expr = None
    for pid, words, use_title, _ in PROJECT_TYPES:
        if not words:
            continue
        cond = None
        for w in words:
            c = s.contains(w) | t.contains(w) if use_title else s.contains(w)
            cond = c if cond is None else cond | c
        expr = F.when(cond, pid) if expr is None else expr.when(cond, pid)
    return expr.otherwise(PROJECT_TYPES[-1][0])


def project_titles(spark) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(p[0], p[3]) for p in PROJECT_TYPES], "project_id int, proj_title string"))


def priority_territory(dept: Column) -> Column:
    """department names a priority territory (substring)."""
    d = F.lower(F.coalesce(dept, F.lit("")))
    out = None
    for z in PRIORITY_TERRITORY_TOKENS:
        out = d.contains(z) if out is None else out | d.contains(z)
    return out


def xml_escape(c: Column) -> Column:
    """escape &, <, >, " and ' (ampersand first)."""
    e = F.replace(c, F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        e = F.replace(e, F.lit(a), F.lit(b))
    return e
