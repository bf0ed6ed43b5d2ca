"""agrolattice: Spark-native agricultural and open-data analytics (DataFrame in, DataFrame out)."""

from .operators.dedup import dedup_keep_first, duplicate_report
from .operators.gapfill import gap_fill_linear
from .operators.profile import column_profile
from .operators.quantiles import exact_quantiles
from .operators.tfidf import tfidf_long
from .plans.catalog import clean_catalog
from .plans.context import question_context
from .plans.documents import credit_barriers, gel_xml, known_probability, proposal_markdown
from .plans.economics import compare_all_crops, crop_economics
from .plans.livestock import livestock_economics
from .plans.master import consolidate
from .plans.models import score_viability, train_viability, train_yield, predict_yield
from .plans.pipeline import run_pipeline
from .plans.planner import sowing_plan, sowing_plan_with_model
from .session import build_session, materialize

__all__ = [
    "build_session", "materialize", "consolidate", "clean_catalog", "sowing_plan", "sowing_plan_with_model",
    "crop_economics", "compare_all_crops", "livestock_economics", "train_viability", "score_viability",
    "train_yield", "predict_yield", "gel_xml", "proposal_markdown", "known_probability", "credit_barriers",
    "question_context", "run_pipeline", "gap_fill_linear", "dedup_keep_first", "duplicate_report",
    "column_profile", "exact_quantiles", "tfidf_long",
]
