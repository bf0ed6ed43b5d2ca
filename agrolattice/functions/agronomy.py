"""Agronomic and financial row formulas as Column expressions.

All functions take Columns and return Columns, so they also work inside higher-order
functions (``transform``) on per-month arrays.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import (CROP_RULES, LIVESTOCK, STATUS_COND, STATUS_CRIT, STATUS_OK, SUBSIDISED_PROFILES,
                      SUBSIDY_FLOOR, SUBSIDY_POINTS, SUITABILITY_SCORE)


def py_round(c: Column, places: int = 0) -> Column:
    """Round half-to-even (Python's ``round``); ``places=0`` returns a bigint."""
    r = F.bround(c, places)
    return r.cast("bigint") if places == 0 else r


def trunc_int(c: Column) -> Column:
    """``int(x)``: truncate toward zero."""
    return c.cast("bigint")


def crop_norm(c: Column) -> Column:
    """canonical crop name by substring (accents included); null when unknown."""
    lc = F.lower(c)
    return (F.when(lc.contains("cafe"), "Cafe").when(lc.contains("cacao"), "Cacao")
            .when(lc.contains("arroz"), "Arroz")
            .when(lc.contains("maiz") | lc.contains("maíz"), "Maiz")
            .when(lc.contains("platano") | lc.contains("plátano"), "Platano"))


def stress_factor(v: Column, lo: Column, hi: Column, sigma: Column) -> Column:
    """1 inside [lo, hi], Gaussian decay outside.  A null value gives 1 (no penalty)."""
    below, above = v - lo, v - hi
    return (F.when(v < lo, F.exp(-(below * below) / (2 * (sigma * sigma))))
            .when(v > hi, F.exp(-(above * above) / (2 * (sigma * sigma))))
            .otherwise(F.lit(1.0)))


def slope_factor(s: Column) -> Column:
    """F2: 1 up to 15 %, -1 point per % to 30 %, then -2 points per %, floor 0.1."""
    return (F.when(s <= 15.0, F.lit(1.0)).when(s <= 30.0, 1.0 - 0.01 * (s - 15.0))
            .otherwise(F.greatest(F.lit(0.1), F.lit(1.0) - 0.01 * 15.0 - 0.02 * (s - 30.0))))


def stressed_yield(pred: Column, known: Column, ph: Column, alt: Column, temp: Column, slope: Column,
                   p: dict) -> Column:
    """``max(0.1, pred * S_ph * S_alt * S_temp * S_slope)`` for a known crop, else ``pred``.
    ``p`` maps ph_min/ph_max/... to Columns of the crop-parameter row."""
    s = (stress_factor(ph, p["ph_min"], p["ph_max"], p["ph_sigma"])
         * stress_factor(alt, p["alt_min"], p["alt_max"], p["alt_sigma"])
         * stress_factor(temp, p["temp_min"], p["temp_max"], p["temp_sigma"])
         * slope_factor(slope))
    return F.when(known, F.greatest(F.lit(0.1), pred * s)).otherwise(pred)


def subsidised_rate(rate: Column, producer_type: Column) -> Column:
    """the two preferential producer profiles get ``max(1, r - 2)``."""
    return F.when(producer_type.isin(*SUBSIDISED_PROFILES),
                  F.greatest(F.lit(SUBSIDY_FLOOR), rate - SUBSIDY_POINTS)).otherwise(rate)


def is_subsidised(producer_type: Column) -> Column:
    return F.coalesce(producer_type.isin(*SUBSIDISED_PROFILES), F.lit(False))


def crop_rules(crop: Column, ph: Column, alt: Column, slope: Column, dry: Column, zone: Column) -> tuple:
    """F16: (status, rule texts) for a sowing plan, rule order as in the original checks."""
    lc = F.lower(crop)
    cafe, cacao = lc.contains("cafe"), ~lc.contains("cafe") & lc.contains("cacao")
    arroz = ~lc.contains("cafe") & ~lc.contains("cacao") & lc.contains("arroz")
    maiz = ~lc.contains("cafe") & ~lc.contains("cacao") & ~lc.contains("arroz") & lc.contains("maiz")
    R = CROP_RULES
    low_pct = py_round((1 - zone) * 100).cast("string")
    high_pct = py_round((zone - 1) * 100).cast("string")
    rules = F.array_compact(F.array(
        F.when(cafe & (ph < 5.0), R["cafe_ph_low"]).when(cafe & (ph > 6.5), R["cafe_ph_high"]),
        F.when(cafe & (alt < 1000), R["cafe_alt_low"]).when(cafe & (alt > 2000), R["cafe_alt_high"]),
        F.when(cacao & (ph < 5.5), R["cacao_ph_low"]),
        F.when(cacao & (alt > 1200), R["cacao_alt_high"]),
        F.when(arroz & ((ph < 5.0) | (ph > 7.0)), R["arroz_ph"]),
        F.when(arroz & (alt > 1000), R["arroz_alt_high"]),
        F.when(maiz & (alt > 2000), R["maiz_alt_high"]),
        F.when(slope > 15, R["slope_15"]),
        F.when(slope > 30, R["slope_30"]),
        F.when(dry, R["dry_month"]).otherwise(R["rain_month"]),
        F.when(zone < 0.8, _fill(R["zone_low"], "{pct}", low_pct))
        .when(zone > 1.2, _fill(R["zone_high"], "{pct}", high_pct)),
        F.lit(R["registry"]),
    ))
    conditioned = ((cafe & ((ph < 5.0) | (ph > 6.5) | (alt < 1000) | (alt > 2000)))
                   | (cacao & ((ph < 5.5) | (alt > 1200)))
                   | (arroz & ((ph < 5.0) | (ph > 7.0) | (alt > 1000)))
                   | (slope > 15) | dry)
    status = (F.when(slope > 30, STATUS_CRIT).when(F.coalesce(conditioned, F.lit(False)), STATUS_COND)
              .otherwise(STATUS_OK))
    return status, rules


def _fill(template: str, slot: str, value: Column) -> Column:
    """Put ``value`` into the ``slot`` of a fixed text template."""
    before, after = template.split(slot, 1)
    return F.concat(F.lit(before), value, F.lit(after))


def suitability_score(status: Column) -> Column:
    """Conforme 100, Condicionado 60, Crítico 20."""
    return (F.when(status == STATUS_OK, SUITABILITY_SCORE[STATUS_OK])
            .when(status == STATUS_COND, SUITABILITY_SCORE[STATUS_COND])
            .otherwise(SUITABILITY_SCORE[STATUS_CRIT]))


def rule_route(rule: Column) -> tuple:
    """section flags (soil / water / registry, case-sensitive keywords; a rule may be in
    several sections) and a severity from its leading symbol."""
    def has(*words):
        out = None
        for w in words:
            out = rule.contains(w) if out is None else out | rule.contains(w)
        return out
    soil = has("Suelo", "Altitud", "altitud", "Pendiente", "UPRA")
    water = has("Siembra", "lluvias", "riego", "Decreto 1076")
    registry = has("ICA", "Registro")
    severity = (F.when(rule.contains("❌"), "error").when(rule.contains("⚠️"), "warning")
                .otherwise("info"))
    return soil, water, registry, severity


# ---------------------------------------------------------------- livestock
L = LIVESTOCK


def carrying_capacity(cattle: Column, slope: Column, om: Column) -> Column:
    """animals per hectare = base x slope factor x organic-matter factor."""
    base = F.when(cattle, F.lit(L["carrying_cattle"])).otherwise(F.lit(L["carrying_pigs"]))
    sf = F.when(slope > 30, 0.25).when(slope > 15, 0.65).otherwise(1.0)
    of = F.when(om < 2.0, 0.8).when(om > 4.0, 1.25).otherwise(1.0)
    return base * sf * of
