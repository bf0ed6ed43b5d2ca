"""Retrieval context for a whole table of questions.

Entities and topics are per-row CASE chains over the fixed dictionaries (first hit in list
order).  Every topic aggregate depends only on (department token, crop), so it is computed
once per key - department tokens are matched against the *distinct* department names of a
table (theta join on a few rows), then joined back by name - and equi-joined to the
questions.  Nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.topk import top_n_per_group
from ..params import CONTEXT_TEXT, QUESTION_CROPS, QUESTION_DEPTS, QUESTION_MUNS, TOPIC_WORDS
from .planner import _t

C = CONTEXT_TEXT


def first_token(q: Column, tokens: list[str]) -> Column:
    """the first dictionary token contained in ``q`` (list order), else null."""
    expr = None
    for t in tokens:
        expr = F.when(q.contains(t), F.lit(t)) if expr is None else expr.when(q.contains(t), F.lit(t))
    return expr


def any_token(q: Column, tokens: list[str]) -> Column:
    """any of ``tokens`` occurs in ``q`` (substring semantics)."""
    out = None
    for t in tokens:
        out = q.contains(t) if out is None else out | q.contains(t)
    return out


def entities_topics(questions: DataFrame, text_col: str = "question") -> DataFrame:
    q = F.lower(F.col(text_col))
    crop_map = F.create_map(*[x for pair in QUESTION_CROPS for x in (F.lit(pair[0]), F.lit(pair[1]))])
    tok = first_token(q, [t for t, _ in QUESTION_CROPS])
    return questions.withColumns({
        "detected_dept": first_token(q, QUESTION_DEPTS), "detected_mun": first_token(q, QUESTION_MUNS),
        "detected_crop": tok, "crop_name": crop_map[tok],
        **{f"ask_{k}": any_token(q, v) for k, v in TOPIC_WORDS.items()},
    })


def _total(col: str) -> Column:
    """Sum, 0 of nulls only (D4); rounded, so that the order of summation can't turn a printed tie."""
    return F.round(F.coalesce(F.sum(col), F.lit(0.0)), 4)


def _dept_tokens(table: DataFrame, dept_col: str = "departamento") -> DataFrame:
    """(department name, token) pairs: tokens contained in the lower-cased name."""
    spark = table.sparkSession
    toks = F.broadcast(spark.createDataFrame([(t,) for t in QUESTION_DEPTS], "_tok string"))
    names = table.select(F.col(dept_col).alias("_dname")).where(F.col("_dname").isNotNull()).distinct()
    return names.join(toks, F.lower(F.col("_dname")).contains(F.col("_tok")))


def _by_token(table: DataFrame, aggs: list[Column], crop: bool, dept_col: str = "departamento") -> DataFrame:
    """Aggregates per (token or null = all departments, crop or null = all crops)."""
    keys = ["cultivo"] if crop else []
    pairs = _dept_tokens(table, dept_col)
    tok = (table.join(pairs, F.col(dept_col) == F.col("_dname"))
           .groupingSets([["_tok"] + keys, ["_tok"]] if crop else [["_tok"]], "_tok", *keys).agg(*aggs))
    alls = table.groupingSets([keys, []] if crop else [[]], *keys).agg(*aggs).withColumn("_tok", F.lit(None).cast("string"))
    if not crop:
        return tok.unionByName(alls).withColumn("_crop", F.lit(None).cast("string"))
    return tok.unionByName(alls).withColumnRenamed("cultivo", "_crop")


def _attach(qs: DataFrame, table: DataFrame, prefix: str, use_crop: bool) -> DataFrame:
    t = table.select(*[F.col(c).alias(prefix + c) for c in table.columns])
    cond = F.col("detected_dept").eqNullSafe(F.col(prefix + "_tok"))
    cond = cond & (F.col("crop_name").eqNullSafe(F.col(prefix + "_crop")) if use_crop else F.col(prefix + "_crop").isNull())
    return qs.join(t, cond, "left")


def _fmt(c: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", c)


def question_context(questions: DataFrame, prices: DataFrame, production: DataFrame, soils: DataFrame,
                     credit: DataFrame, climate: DataFrame, land: DataFrame, livestock: DataFrame,
                     price_tiebreak: tuple = ("l_orderkey", "l_linenumber")) -> DataFrame:
    qs = entities_topics(questions)
    # A. latest five prices per crop and overall (W5), as ready-made text lines
    line = _t(C["price_line"], crop=F.col("cultivo"),
              price=F.format_number(F.col("precio_kg_promedio_cop").cast("bigint"), 0),
              central=F.col("central_abasto"), fecha=F.date_format("fecha", "yyyy-MM-dd"))
    order = [F.col("fecha").desc()] + [F.col(c).desc() for c in price_tiebreak]
    p = prices.where(F.col("fecha").isNotNull())
    per_crop = top_n_per_group(p, ["cultivo"], order, 5, list(price_tiebreak)).withColumn("_crop", F.col("cultivo"))
    overall = top_n_per_group(p.withColumn("_all", F.lit(1)), ["_all"], order, 5, list(price_tiebreak)) \
        .drop("_all").withColumn("_crop", F.lit(None).cast("string"))
    latest = per_crop.unionByName(overall).withColumn("_line", line).withColumn("_ord", F.struct(
        *[F.col(c) for c in ["fecha", *price_tiebreak]]))
    price_txt = latest.groupBy("_crop").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_ord", "_line"))), lambda s: s["_line"]), "\n").alias("_txt"))
    qs = qs.join(price_txt.select(F.col("_crop").alias("pr_crop"), F.col("_txt").alias("pr_txt")),
                 F.col("crop_name").eqNullSafe(F.col("pr_crop")), "left")
    # B. production and soils for the detected crop (optionally the detected department)
    prod = _by_token(production, [F.avg("rendimiento_ton_ha").alias("y"), _total("hectareas_sembradas").alias("ha")], True)
    soil = _by_token(soils, [F.mode("aptitud", True).alias("apt"), F.avg("ph_suelo").alias("ph"),
                             F.avg("altitud_m").alias("alt")], True)
    cred = _by_token(credit, [_total("monto_creditos_cop").alias("amount"), F.avg("tasa_interes_promedio").alias("rate")],
                     True)
    weather = _by_token(climate, [F.avg("temperatura_promedio_c").alias("t"),
                                  F.sum("precipitacion_diaria_mm").alias("rsum"), F.count(F.lit(1)).alias("n")], False)
    legal = _by_token(land, [F.avg("indice_seguridad_juridica").alias("isj"), _total("hectareas_catastradas").alias("cat"),
                             _total("hectareas_formalizadas").alias("form")], False)
    live = _by_token(livestock, [F.avg("poblacion_bovina").alias("b"), F.avg("poblacion_porcina").alias("p"),
                                 F.avg("vacunacion_fiebre_aftosa_pct").alias("v")], False)
    qs = _attach(qs, prod, "pd", True)
    qs = _attach(qs, soil, "so", True)
    qs = _attach(qs, cred, "cr", True)
    qs = _attach(qs, weather, "we", False)
    qs = _attach(qs, legal, "le", False)
    qs = _attach(qs, live, "lv", False)
    crop = F.col("crop_name")
    blocks = [
        F.when(F.col("ask_price") & F.col("pr_txt").isNotNull(),
               F.concat_ws("\n", F.lit(C["price_header"]), F.col("pr_txt"))),
        F.when(crop.isNotNull() & F.col("pdy").isNotNull() | crop.isNotNull() & F.col("pdha").isNotNull(), F.concat_ws(
            "\n", _t(C["prod_header"], crop=crop), _t(C["prod_yield"], y=_fmt(F.col("pdy"), 2)),
            _t(C["prod_area"], ha=F.format_number(F.col("pdha"), 1)))),
        F.when(crop.isNotNull() & F.col("soph").isNotNull(), F.concat_ws(
            "\n", _t(C["soil_header"], crop=crop), _t(C["soil_apt"], apt=F.col("soapt")),
            _t(C["soil_ph"], ph=_fmt(F.col("soph"), 2), alt=F.col("soalt").cast("bigint").cast("string")))),
        F.when(F.col("ask_credit") & F.col("cramount").isNotNull(), F.concat_ws(
            "\n", F.lit(C["credit_header"]), _t(C["credit_amount"], amount=F.format_number(F.col("cramount").cast("bigint"), 0)),
            _t(C["credit_rate"], rate=_fmt(F.col("crrate"), 2)))),
        F.when(F.col("ask_weather") & (F.col("wen") > 0), F.concat_ws(
            "\n", F.lit(C["weather_header"]), _t(C["weather_temp"], t=_fmt(F.col("wet"), 1)),
            _t(C["weather_rain"], r=(F.col("wersum") / (F.col("wen") / 365)).cast("bigint").cast("string")))),
        F.when(F.col("ask_legal") & F.col("leisj").isNotNull(), F.concat_ws(
            "\n", F.lit(C["legal_header"]), _t(C["legal_index"], isj=_fmt(F.col("leisj"), 1)),
            F.when(F.col("lecat") > 0, _t(C["legal_area"], cat=F.format_number(F.col("lecat"), 1),
                                          form=F.format_number(F.col("leform"), 1),
                                          pct=_fmt(F.col("leform") / F.col("lecat") * 100, 1))).otherwise(F.lit("")))),
        F.when(F.col("ask_livestock") & F.col("lvb").isNotNull(), F.concat_ws(
            "\n", F.lit(C["live_header"]), _t(C["live_cattle"], b=F.format_number(F.col("lvb").cast("bigint"), 0)),
            _t(C["live_pigs"], p=F.format_number(F.col("lvp").cast("bigint"), 0)), _t(C["live_vac"], v=_fmt(F.col("lvv"), 2)))),
        F.when(F.col("ask_frontier"), F.lit("\n".join(C["frontier"]))),
    ]
    out = qs.withColumn("context", F.concat_ws("\n", *blocks))
    keep = list(questions.columns) + ["detected_dept", "detected_mun", "detected_crop", "crop_name"] + \
        [f"ask_{k}" for k in TOPIC_WORDS] + ["context"]
    return out.select(*keep)
