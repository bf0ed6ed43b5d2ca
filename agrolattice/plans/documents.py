"""F27 (+J10): GEL-XML asset records for a whole catalog as one batch job.

The viability probability of a catalog dataset comes from the known-dataset lookup (J10):
a dataset found in the clean catalog by UID (or by title when the UID is blank) gets 1.0 or
0.0 from its own label; only unmatched rows need the model (``scores`` argument).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import xml_escape
from ..params import APT_PROBABILITY, GEL_XML_TEMPLATE, NO_DATA
from ..schemas import ENT
from .planner import _t


def known_probability(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Probability 1/0 for requests that match a catalog dataset (UID first, title only
    when the UID is blank), null otherwise.  The catalog side is de-duplicated per key
    (first by UID) so the lookup never multiplies rows."""
    def blank(c: Column) -> Column:
        return c.isNull() | (F.trim(c) == "") | (c == NO_DATA)
    by_uid = catalog.groupBy(F.col("UID").alias("_k_uid")).agg(F.min_by("es_viable", "UID").alias("_v_uid"))
    by_title = catalog.groupBy(F.col("Titulo").alias("_k_title")).agg(
        F.min_by("es_viable", "UID").alias("_v_title"))
    r = (requests.withColumn("_ru", F.when(~blank(F.col("UID")), F.col("UID")))
         .withColumn("_rt", F.when(blank(F.col("UID")) & ~blank(F.col("Titulo")), F.col("Titulo"))))
    # most rows have no title key, others no UID key: a null key would send them all to one
    # task, so it becomes a key of the row's own that no catalog row has
    own = F.concat(F.lit("\u0000"), F.xxhash64(*[F.col(f"`{c}`") for c in requests.columns]).cast("string"))
    r = r.withColumn("_ru", F.coalesce("_ru", own)).withColumn("_rt", F.coalesce("_rt", own))
    r = r.join(by_uid, F.col("_ru") == F.col("_k_uid"), "left").join(by_title, F.col("_rt") == F.col("_k_title"), "left")
    v = F.coalesce(F.col("_v_uid"), F.col("_v_title"))
    return r.withColumn("known_prob", F.when(v.isNotNull(), F.when(v, 1.0).otherwise(0.0))).drop(
        "_ru", "_rt", "_k_uid", "_v_uid", "_k_title", "_v_title")


def gel_xml(df: DataFrame, prob: Column, fecha: Column) -> Column:
    """the XML record of each row (texts escaped, & first)."""
    def s(name, default):
        return xml_escape(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(default)))
    pct = F.bround(prob * 100, 2).cast("string")
    return _t(GEL_XML_TEMPLATE, fecha=fecha, uid=s("UID", NO_DATA), titulo=s("Titulo", "Dataset sin título"),
              descripcion=s("Descripción", NO_DATA), entidad=s(ENT + "Nombre de la Entidad", NO_DATA),
              sector=s(ENT + "Sector", NO_DATA), orden=s(ENT + "Orden", NO_DATA),
              departamento=s(ENT + "Departamento", NO_DATA), municipio=s(ENT + "Municipio", NO_DATA),
              filas=F.col("`Número de Filas`").cast("string"), columnas=F.col("`Número de Columnas`").cast("string"),
              url=s("url", "https://www.datos.gov.co"), prob_pct=pct,
              relevancia=F.col("ds_score_relevancia").cast("string"), calidad=F.col("ds_calidad_datos").cast("string"),
              apto=F.when(prob >= APT_PROBABILITY, "true").otherwise("false"))


# ---------------------------------------------------------------- F28 proposal, F29 reports, F26 barriers
from .. import templates as TPL  # noqa: E402
from ..functions.agronomy import suitability_score  # noqa: E402
from ..functions.text import priority_territory, project_type  # noqa: E402
from ..operators.geocode import gender_indicators  # noqa: E402
from ..params import PROJECT_TYPES, SUBSIDISED_PROFILES  # noqa: E402


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _pyfloat(c: Column) -> Column:
    """``str(float)`` for the values the templates print (shortest round-trip form)."""
    return c.cast("double").cast("string")


def proposal_markdown(cat: DataFrame, prob: Column) -> DataFrame:
    """the project proposal of every catalog row; adds ``proposal``."""
    spark = cat.sparkSession
    details = F.broadcast(spark.createDataFrame(
        [(k, v[0], v[1]) for k, v in TPL.PROJECT_DETAILS.items()], "_pid int, _ods string, _arch string"))
    titles = F.broadcast(spark.createDataFrame([(p[0], p[3]) for p in PROJECT_TYPES], "_tid int, _ptitle string"))
    dept_col = ENT + "Departamento"
    df = cat.withColumn("_prob", prob).withColumn("_pid", project_type(F.col(f"`{ENT}Sector`"), F.col("Titulo")))
    df = df.join(details, "_pid").join(titles, F.col("_pid") == F.col("_tid"))
    df = gender_indicators(df.withColumn("_dept", F.col(f"`{dept_col}`").cast("string")), "_dept")
    filas, cols, rel = F.col("`Número de Filas`"), F.col("`Número de Columnas`"), F.col("ds_score_relevancia")
    pct = F.bround(F.col("_prob") * 100, 2).cast("string")
    reasons = F.array_compact(F.array(
        F.when(filas < 2000, _t(TPL.REASON_ROWS, filas=F.format_number(filas, 0))),
        F.when(cols < 10, _t(TPL.REASON_COLS, columnas=cols.cast("string"))),
        F.when(rel < 3.5, _t(TPL.REASON_REL, relevancia=_pyfloat(rel)))))
    reasons_s = F.when(F.size(reasons) > 0, F.array_join(reasons, ", ")).otherwise(F.lit(TPL.REASON_DEFAULT))
    banner = F.when(F.col("_prob") < 0.5, _t(TPL.WARNING_BANNER, pct=pct, reasons=reasons_s)).otherwise(F.lit(""))
    dept = F.col("_dept")
    gender = F.when(F.col("ipg_educacion").isNotNull(), _t(
        TPL.GENDER_TEXT, ipg=F.format_string("%.2f", F.bround("ipg_educacion", 2)),
        mujeres=_pyfloat(F.col("mujeres_beneficiarias_pct")), relevo=_pyfloat(F.col("relevo_joven_pct")),
        dept=dept)).otherwise(F.lit(TPL.GENDER_DEFAULT))
    territorial = F.when(priority_territory(dept), _t(TPL.TERRITORIAL_TEXT, dept=dept)).otherwise(F.lit(""))
    low = F.col("_prob") < 0.5
    doc = _t(TPL.PROPOSAL, banner=banner, proj_title=F.col("_ptitle"),
             entidad=F.col(f"`{ENT}Nombre de la Entidad`"), sector=F.col(f"`{ENT}Sector`"),
             orden=F.col(f"`{ENT}Orden`"), cobertura=F.col("alcance_geografico"), titulo=F.col("Titulo"),
             columnas=cols.cast("string"), filas=F.format_number(filas, 0), pct=pct,
             justificacion=F.col("ds_justificacion"), encabezados=F.col("ds_encabezados_utiles"),
             uid=F.col("UID"), url=F.col("url"), ods=F.col("_ods"), arch=F.col("_arch"),
             madurez=F.when(low, F.lit(TPL.MATURITY_LOW)).otherwise(F.lit(TPL.MATURITY_HIGH)),
             recomendacion=F.when(low, F.lit(TPL.RECOMMEND_LOW)).otherwise(_t(TPL.RECOMMEND_HIGH, dept=dept)),
             gender=gender, territorial=territorial)
    return df.withColumn("proposal", _strip(doc)).select(*cat.columns, "proposal")


def crop_report(plan: DataFrame, fecha: Column) -> Column:
    """compliance report of a sowing plan row (``planner.sowing_plan`` output)."""
    status = F.col("madr_compliance")
    head = _t(TPL.CROP_REPORT, fecha=fecha, crop=F.col("cultivo"), alt=_pyfloat(F.col("altitud_m")),
              ph=_pyfloat(F.col("ph_suelo")), slope=_pyfloat(F.col("pendiente_pct")), texture=F.col("textura"),
              best_month=F.col("best_month"), best_yield=_pyfloat(F.col("best_yield")),
              score=suitability_score(status).cast("string"), status=F.upper(status))
    rules = F.array_join(F.transform("madr_rules", lambda r: F.concat(F.lit("\n* "), r)), "")
    return F.concat(head, rules, F.lit(TPL.CROP_REPORT_FOOTER))


def livestock_report(eco: DataFrame, fecha: Column) -> Column:
    """herd management plan of a ``livestock_economics`` output row."""
    area, herd = F.col("farm_area"), F.col("herd_size")
    money = lambda c: F.format_number(F.col(c), 0)
    head = _t(TPL.LIVESTOCK_REPORT, fecha=fecha, mun=F.col("municipio"), dept=F.col("departamento"),
              area=_pyfloat(area), species=F.col("species"),
              purpose=F.when(F.col("species") == "Bovino", F.col("purpose")).otherwise(F.lit("Carne")),
              herd=herd.cast("string"), revenue=money("gross_revenue"), costs=money("total_operating_costs"),
              interest=money("annual_interest_payment"), net=money("net_profit"),
              margin=_pyfloat(F.col("margin_pct")), roi=_pyfloat(F.col("roi_pct")),
              capacity=_pyfloat(F.col("carrying_capacity_ha")), max_animals=F.col("max_animals_allowed").cast("string"),
              load=F.when(area > 0, _pyfloat(F.bround(herd / area, 2))).otherwise(F.lit("0")),
              credit=money("recommended_credit"))
    alerts = F.array_join(F.transform("alerts", lambda r: F.concat(F.lit("\n* "), r)), "")
    return F.concat(head, alerts, F.lit(TPL.LIVESTOCK_REPORT_FOOTER))


def credit_barriers(requests: DataFrame, dept_col: str = "departamento",
                    producer_col: str = "producer_type") -> DataFrame:
    """barrier text and suggested credit line for preferential producers in a department
    with indicators (ordered substring lookup, as J9); other rows are dropped."""
    df = requests.where((F.col(dept_col) != "Todos") & (F.col(producer_col) != "General"))
    df = gender_indicators(df, dept_col).where(F.col("ipg_educacion").isNotNull())
    women = F.col(producer_col) == SUBSIDISED_PROFILES[0]
    d = F.col(dept_col)
    barrier = F.when(women, _t(TPL.BARRIER_WOMEN, dept=d, pct=_pyfloat(F.col("mujeres_beneficiarias_pct")))) \
        .otherwise(_t(TPL.BARRIER_YOUTH, dept=d, pct=_pyfloat(F.col("relevo_joven_pct"))))
    line = F.when(women, F.lit(TPL.LINE_WOMEN)).otherwise(F.lit(TPL.LINE_YOUTH))
    return df.withColumn("barrier", barrier).withColumn("suggested_line", line)
