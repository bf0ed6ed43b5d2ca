"""Cleaning and typing as native column expressions (no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..params import NO_DATA, TRUE_TOKENS

THOUSANDS = r"^\d{1,3}(\.\d{3})+$"


def to_bool_default_true(c: Column) -> Column:
    """Parse a boolean; null or unparseable -> true."""
    return F.coalesce(c.try_cast("boolean"), F.lit(True))


def count_column(c: Column) -> Column:
    """C2 (quirk Q1 decided): "8.869" is a thousands-dotted integer; "18.0" and "18" parse as
    numbers; anything else -> 0.  Doubles truncate toward zero."""
    s = F.trim(c)
    num = F.when(s.rlike(THOUSANDS), F.regexp_replace(s, r"\.", "")).otherwise(s)
    return F.coalesce(num.try_cast("double").cast("bigint"), F.lit(0)).cast("int")


def score_column(c: Column, default: float) -> Column:
    """Numeric score with a default for null / unparseable."""
    return F.coalesce(c.try_cast("double"), F.lit(float(default)))


def synonym_bool(c: Column, true_tokens: list[str] = TRUE_TOKENS) -> Column:
    """C4: true for the listed synonyms (trimmed, lower case), false otherwise."""
    return F.coalesce(F.lower(F.trim(c)).isin(*true_tokens), F.lit(False))


def fill_text(df: DataFrame, value: str = NO_DATA) -> DataFrame:
    """Every string column's nulls -> ``value``."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    return df.fillna(value, subset=cols) if cols else df
