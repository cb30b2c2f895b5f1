"""Rubric scores for a (candidate, company) pair.

The reference asks a chat model for four sub-scores and a weighted total.
Here the same rubric is a set of deterministic column expressions so that the
whole pipeline runs offline and the total is computed, not reported.

Tier values and weights below are fixed values of the rubric.  The relation
tables (which industries are adjacent, which skills are related, how staff
maps to a stage) are this project's own definitions for the test schema and
can be replaced by passing other dictionaries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: rubric weights and tiers --------------------------------
WEIGHTS = {"industry": 0.35, "technical": 0.25, "experience": 0.25, "growth": 0.15}
INDUSTRY_TIERS = {"exact": 1.0, "adjacent": 0.7, "same_sector": 0.5, "none": 0.0}
TECHNICAL_TIERS = {"core": 1.0, "related": 0.7, "foundational": 0.5, "none": 0.0}
GROWTH_TIERS = {0: 1.0, 1: 0.7, 2: 0.5}          # stage distance -> score, else 0.0
# Experience bands: (max staff, min ideal years, max ideal years or None).
EXPERIENCE_BANDS = [(10, 0, 5), (50, 6, 12), (None, 15, None)]
EXPERIENCE_STEP = 0.1                            # score lost per year outside the band

# ---- relation tables for the test schema (part types, part-name words) -----
ADJACENT_INDUSTRIES = {
    "SMALL": ["MEDIUM"], "MEDIUM": ["SMALL", "LARGE"], "LARGE": ["MEDIUM"],
    "ECONOMY": ["STANDARD"], "STANDARD": ["ECONOMY", "PROMO"], "PROMO": ["STANDARD"],
}
INDUSTRY_SECTOR = {
    "SMALL": "size", "MEDIUM": "size", "LARGE": "size",
    "ECONOMY": "market", "STANDARD": "market", "PROMO": "market",
}
RELATED_SKILLS = {
    "widget": ["gizmo"], "gizmo": ["widget"],
    "gear": ["bolt", "ring"], "bolt": ["gear", "rod"], "rod": ["bolt", "plate"],
    "plate": ["anvil", "rod"], "anvil": ["plate"], "ring": ["gear"],
}
# Company stages in growth order, and the staff count that ends each stage.
STAGES = ["Seed", "Series A", "Series B", "Series C", "Growth"]
STAGE_MAX_STAFF = [10, 25, 50, 75, None]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _str_map(d: dict) -> Column:
    kv = []
    for k, v in d.items():
        kv += [F.lit(k), F.lit(v) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v])]
    return F.create_map(*kv)


def stage_of_staff(staff) -> Column:
    s = _c(staff)
    expr = None
    for name, mx in zip(STAGES, STAGE_MAX_STAFF):
        cond = s <= mx if mx is not None else F.lit(True)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return F.when(s.isNull(), F.lit(None).cast("string")).otherwise(expr)


def stage_ordinal(stage) -> Column:
    """0-based position of a stage name in ``STAGES``; null when unknown."""
    pos = F.array_position(F.array(*[F.lit(s) for s in STAGES]), _c(stage)).cast("int")
    return F.when(pos > 0, pos - 1)


def score_industry(preferred, industry, adjacent: dict = ADJACENT_INDUSTRIES,
                   sector: dict = INDUSTRY_SECTOR) -> Column:
    """Best tier over the preferred industries: exact, adjacent, same sector."""
    adj, sec = _str_map(adjacent), _str_map(sector)
    ind = _c(industry)

    def tier(x):
        return (F.when(x == ind, F.lit(INDUSTRY_TIERS["exact"]))
                .when(F.coalesce(F.array_contains(F.try_element_at(adj, x), ind), F.lit(False)),
                      F.lit(INDUSTRY_TIERS["adjacent"]))
                .when(F.coalesce(F.try_element_at(sec, x) == F.try_element_at(sec, ind), F.lit(False)),
                      F.lit(INDUSTRY_TIERS["same_sector"]))
                .otherwise(F.lit(INDUSTRY_TIERS["none"])))

    pref = F.coalesce(_c(preferred), F.array().cast("array<string>"))
    return F.aggregate(pref, F.lit(0.0).cast("double"),
                       lambda acc, x: F.greatest(acc, tier(x).cast("double")))


def score_technical(core_skills, foundational_skills, core_stack, foundational_stack,
                    related: dict = RELATED_SKILLS) -> Column:
    """Core skill shared -> 1.0; a related core skill -> 0.7; a shared
    foundational skill -> 0.5; else 0."""
    rel = _str_map(related)
    empty = F.array().cast("array<string>")
    cs, fs = F.coalesce(_c(core_skills), empty), F.coalesce(_c(foundational_skills), empty)
    ct, ft = F.coalesce(_c(core_stack), empty), F.coalesce(_c(foundational_stack), empty)
    related_hit = F.exists(cs, lambda s: F.coalesce(
        F.arrays_overlap(F.coalesce(F.try_element_at(rel, s), empty), ct), F.lit(False)))
    return (F.when(F.coalesce(F.arrays_overlap(cs, ct), F.lit(False)), F.lit(TECHNICAL_TIERS["core"]))
            .when(related_hit, F.lit(TECHNICAL_TIERS["related"]))
            .when(F.coalesce(F.arrays_overlap(fs, ft), F.lit(False)), F.lit(TECHNICAL_TIERS["foundational"]))
            .otherwise(F.lit(TECHNICAL_TIERS["none"]))).cast("double")


def score_experience(staff, years) -> Column:
    """1.0 inside the ideal years of the company's stage band, minus 0.1 per
    year outside it, floored at 0.  A staff of exactly 50 is growth stage."""
    s, y = _c(staff), _c(years).cast("int")
    lo = hi = None
    for mx, a, b in EXPERIENCE_BANDS:
        cond = s <= mx if mx is not None else F.lit(True)
        lo = F.when(cond, F.lit(a)) if lo is None else lo.when(cond, F.lit(a))
        bb = F.lit(b) if b is not None else F.lit(None).cast("int")
        hi = F.when(cond, bb) if hi is None else hi.when(cond, bb)
    gap = (F.when(y < lo, lo - y)
           .when(hi.isNotNull() & (y > hi), y - hi)
           .otherwise(F.lit(0)))
    score = F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(EXPERIENCE_STEP) * gap.cast("double"))
    return F.when(s.isNull() | y.isNull(), F.lit(0.0)).otherwise(F.round(score, 4)).cast("double")


def score_growth(preferred_stages, stage) -> Column:
    """Stage distance to the nearest preferred stage: 0 -> 1.0, 1 -> 0.7,
    2 -> 0.5, otherwise (or nothing preferred) 0."""
    target = stage_ordinal(stage)
    pref = F.coalesce(_c(preferred_stages), F.array().cast("array<string>"))
    dists = F.filter(F.transform(pref, lambda s: F.abs(stage_ordinal(s) - target)),
                     lambda d: d.isNotNull())
    best = F.array_min(dists)
    expr = None
    for dist, val in GROWTH_TIERS.items():
        expr = F.when(best == dist, F.lit(val)) if expr is None else expr.when(best == dist, F.lit(val))
    return F.coalesce(expr, F.lit(0.0)).cast("double")


def weighted_score(industry, technical, experience, growth) -> Column:
    """Weighted total, rounded to 4 digits before any threshold."""
    total = (F.lit(WEIGHTS["industry"]) * _c(industry)
             + F.lit(WEIGHTS["technical"]) * _c(technical)
             + F.lit(WEIGHTS["experience"]) * _c(experience)
             + F.lit(WEIGHTS["growth"]) * _c(growth))
    return F.round(total.cast("double"), 4)


def score_reasoning(industry, technical, experience, growth) -> Column:
    """Short explanation built from the sub-scores."""
    def part(col, name):
        c = _c(col)
        return (F.when(c >= 1.0, F.lit(f"{name}: strong"))
                .when(c >= 0.5, F.lit(f"{name}: partial"))
                .otherwise(F.lit(f"{name}: weak")))
    return F.concat_ws("; ", part(industry, "industry"), part(technical, "skills"),
                       part(experience, "experience"), part(growth, "stage"))
