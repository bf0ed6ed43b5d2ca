"""Ordered dictionary lookups by exact key or by substring, inside the row.

The dictionaries are fixed parameter tables of some thirty entries, so each lookup is an
expression over a literal array: no join, no distinct names, no second scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import DEFAULT_COORDINATES, GENDER_STATS, NO_DATA, PLACE_COORDINATES


def norm(c: Column) -> Column:
    return F.lower(F.trim(c))


def lookup(name: Column, table: list[tuple], fields: list[str], exact_first: bool = True) -> Column:
    """Struct ``fields`` of the first ``table`` row (key, then values) whose key is a substring of
    the normalised name or contains it; null if none does or the name is null.  ``exact_first``
    lets an exact key win over an earlier substring key ("valle del cauca" before "cauca")."""
    rows = F.array(*[F.struct(F.lit(r[0].lower()).alias("key"), *[F.lit(v).alias(f) for f, v in zip(fields, r[1:])]) for r in table])
    hits = F.filter(rows, lambda r: name.contains(r["key"]) | r["key"].contains(name))
    found = F.get(hits, F.lit(0))
    if exact_first:
        found = F.coalesce(F.get(F.filter(rows, lambda r: r["key"] == name), F.lit(0)), found)
    return F.when(name.isNotNull(), found)


def exact_lookup(name: Column, table: list[tuple], fields: list[str]) -> Column:
    """Struct of the row whose key equals the normalised name."""
    rows = F.array(*[F.struct(F.lit(r[0].lower()).alias("key"), *[F.lit(v).alias(f) for f, v in zip(fields, r[1:])]) for r in table])
    return F.get(F.filter(rows, lambda r: r["key"] == name), F.lit(0))


def geocode(df: DataFrame, dept_col: str, mun_col: str, exact_first: bool = True) -> DataFrame:
    """J7 + J8: latitude/longitude from the municipality (exact key) else the department
    (ordered substring), else the national default."""
    mun = exact_lookup(F.when(F.col(mun_col) != NO_DATA, norm(F.col(mun_col))), PLACE_COORDINATES, ["lat", "lon"])
    dept = lookup(norm(F.col(dept_col)), PLACE_COORDINATES, ["lat", "lon"], exact_first)
    out = df.withColumns({"_mun": mun, "_dept": dept})
    return out.withColumns({
        "latitud": F.coalesce("_mun.lat", "_dept.lat", F.lit(DEFAULT_COORDINATES[0])),
        "longitud": F.coalesce("_mun.lon", "_dept.lon", F.lit(DEFAULT_COORDINATES[1]))}).drop("_mun", "_dept")


def gender_indicators(df: DataFrame, dept_col: str) -> DataFrame:
    """Department indicators by the same ordered substring rule (no exact-first; null
    when nothing matches)."""
    cols = ["ipg_educacion", "mujeres_beneficiarias_pct", "relevo_joven_pct"]
    hit = lookup(norm(F.col(dept_col)), GENDER_STATS, cols, exact_first=False)
    return df.withColumn("_hit", hit).withColumns({c: F.col(f"_hit.{c}") for c in cols}).drop("_hit")
