"""M1: TF-IDF with a corpus-frequency vocabulary, as DataFrame operations.

Tokens are maximal runs of 2+ letters/digits/underscore in the lower-cased text (whole
texts).  The vocabulary is the ``k`` most frequent terms of the corpus (ties by term), so it
has a proven size bound: it reaches every row as a set of literals, and term counts,
weights and the L2 norm are computed inside the row, from its sorted vocabulary tokens.  Only
term totals are shuffled, after a partial aggregate; no document is.  idf is the smooth form
``ln((1+n)/(1+df)) + 1``.  Output is long: (doc, term, tf, weight).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .topk import top_n

TOKEN = r"[\p{L}\p{N}_]{2,}"


def tokenize(text_col: str):
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(TOKEN), 0)


def vocabulary(df: DataFrame, text_col: str, k: int) -> DataFrame:
    """One row: ``vocab``, the ``k`` most frequent terms with their smooth idf."""
    docs = df.select(tokenize(text_col).alias("_tokens"))
    counts = docs.select(F.explode_outer("_tokens").alias("term")).where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("_cf"))
    terms = top_n(counts, [F.col("_cf").desc(), F.col("term").asc()], k).agg(F.collect_set("term").alias("_terms"))
    found = docs.join(F.broadcast(terms)).select(F.array_intersect("_terms", "_tokens").alias("_found"))
    seen = found.select(F.explode_outer("_found").alias("term")).where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    n = docs.agg(F.count(F.lit(1)).alias("_n"))
    idf = F.log((1 + F.col("_n")) / (1 + F.col("_df"))) + 1
    return seen.join(F.broadcast(n)).agg(F.array_sort(F.collect_list(F.struct("term", idf.alias("idf")))).alias("vocab"))


def tfidf_long(df: DataFrame, doc_col: str, text_col: str, k: int) -> DataFrame:
    """``doc_col`` identifies rows; a document without a vocabulary term gives no rows."""
    idf = {v["term"]: v["idf"] for v in vocabulary(df, text_col, k).first()["vocab"] or []}  # k terms at most
    if not idf:
        return df.limit(0).select(doc_col, F.lit("").alias("term"), F.lit(0).cast("bigint").alias("tf"), F.lit(0.0).alias("weight"))
    # a token is looked up in a set of literals; equal ones then lie side by side, and a term's count
    # is the distance to the next term's first place.  The outer explode and the several uses of
    # _known and _at keep the optimiser from computing them again for a filter or for each term
    docs = df.select(F.col(doc_col).alias("_doc"), F.sort_array(F.filter(tokenize(text_col), lambda t: t.isin(list(idf)))).alias("_known"))
    docs = docs.withColumn("_terms", F.array_distinct("_known"))
    docs = docs.withColumn("_at", F.expr("transform(_terms, t -> array_position(_known, t))"))
    weights = F.create_map(*[F.lit(x) for pair in idf.items() for x in pair])
    counted = docs.withColumn("_w", F.transform("_terms", lambda t, i: F.struct(
        t.alias("term"), (F.coalesce(F.get("_at", i + 1), F.size("_known") + 1) - F.get("_at", i)).alias("tf"), weights[t].alias("idf"))))
    norm = F.expr("sqrt(aggregate(_w, 0D, (a, x) -> a + x.tf * x.idf * x.tf * x.idf))")
    return (counted.select("_doc", "_w", norm.alias("_norm")).select("_doc", "_norm", F.explode_outer("_w").alias("x")).where("x is not null")
            .select(F.col("_doc").alias(doc_col), "x.term", F.col("x.tf").cast("bigint").alias("tf"),
                    (F.col("x.tf") * F.col("x.idf") / F.col("_norm")).alias("weight")))
