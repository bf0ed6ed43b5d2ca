"""Registered queries of the operators, each over its whole table with production parameters.

They are thin: the operator does the work, the query derives the digest columns.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, decontaminate, embeddings, filter_audit, html_text, lexical, line_dedup, pii, quality, secrets, simhash,
               suffix_dedup, toxicity)
from .common import documents, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {"op11_lexical_search": lexical.RANK_SQL, "op12_embedding_near_dedup": embeddings.LINKS_SQL,
                       "op13_filter_audit": filter_audit.AUDIT_SQL}

#: The vocabulary file; every worker has it.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


@register("op1_line_dedup")
def q_line_dedup(spark, sf_dir):
    """Per document: its lines, the lines taken out (number and positions), the text left."""
    out = line_dedup.dedup_lines(documents(spark, sf_dir))
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.size("_dropped").alias("n_dropped"),
                      F.col("_dropped").alias("dropped"), F.length("text").alias("n_chars_kept"),
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@register("op2_benchmark_decontamination")
def q_decontamination(spark, sf_dir):
    """A row for each document and benchmark item it contains: its best window."""
    return decontaminate.contamination(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark")).drop("doc_key")


@register("op3_pii")
def q_pii(spark, sf_dir):
    found = pii.find_personal_data(documents(spark, sf_dir))
    return found.select("doc_id", *[pii.count_of(k).alias(f"n_{k}") for k in pii.KINDS],
                        F.sha2(pii.base_digest(), 256).alias("base_sha256"), "spans")


@register("op4_toxicity")
def q_toxicity(spark, sf_dir):
    return toxicity.toxicity_scores(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


@register("op5_html_extraction")
def q_html(spark, sf_dir):
    return html_text.extract_pages(read_table(spark, sf_dir, "pages"))


@register("op6_bpe_codec")
def q_bpe(spark, sf_dir):
    return bpe.encode_documents(documents(spark, sf_dir), VOCABULARY, with_ids=False)


@register("op7_quality_rules")
def q_quality(spark, sf_dir):
    out = quality.quality_verdicts(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))
    return out.select("doc_id", *quality.BASE, "base_failed", "kept", "anomaly")


@register("op8_suffix_dedup")
def q_suffix(spark, sf_dir):
    return suffix_dedup.without_repeats(documents(spark, sf_dir), length=200).drop("kept")


@register("op9_secret_scan")
def q_secrets(spark, sf_dir):
    found = secrets.find_secrets(documents(spark, sf_dir))
    return found.select("doc_id", *[secrets.count_of(k).alias(f"n_{k}") for k in secrets.KINDS],
                        F.sha2(secrets.spans_text("base"), 256).alias("base_sha256"),
                        secrets.spans_text("concat(base, extra)").alias("spans"))


@register("op10_simhash_near_dedup")
def q_simhash(spark, sf_dir):
    found = simhash.near_duplicates(documents(spark, sf_dir), shingle=3, max_bits=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register("op11_lexical_search")
def q_lexical(spark, sf_dir):
    return lexical.rank_documents(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


@register("op12_embedding_near_dedup")
def q_embeddings(spark, sf_dir):
    return embeddings.near_vectors(read_table(spark, sf_dir, "embeddings"))


@register("op13_filter_audit")
def q_filter_audit(spark, sf_dir):
    return filter_audit.audit(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))
