"""Candidate -> company matching: retrieve, score, threshold, rank, limit.

One DataFrame plan per call: blocked k-NN over-fetches ``2 * num_matches``
hits per candidate, attributes are joined to the short hit list (ids only go
through the k-NN shuffle), the rubric is column arithmetic, and the final
per-candidate ranking is a ``row_number`` over at most ``2k`` rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoutline.functions import scoring
from scoutline.functions.vectors import similarity
from scoutline.operators.knn import knn_approx, knn_exact, overfetch
from scoutline.session import cut_lineage

DEFAULT_NUM_MATCHES = 3
DEFAULT_MIN_SCORE = 0.6

COMPANY_ATTRS = ["doc_id", "company_name", "company_description", "industry", "staff",
                 "stage", "core_stack", "foundational_stack"]
CANDIDATE_ATTRS = ["cand_id", "years", "industries", "company_stages", "core_skills",
                   "foundational_skills"]


def enrich_hits(hits: DataFrame, index: DataFrame, cols=COMPANY_ATTRS, key: str = "doc_id") -> DataFrame:
    """Attach index attributes to k-NN hits (after top-k, so only the short
    hit list meets the index)."""
    return hits.join(index.select(*cols), key)


def score_pairs(pairs: DataFrame) -> DataFrame:
    """Add the four sub-scores, the weighted total and the reasoning."""
    return (pairs
            .withColumn("industry_score", scoring.score_industry("industries", "industry"))
            .withColumn("technical_score", scoring.score_technical(
                "core_skills", "foundational_skills", "core_stack", "foundational_stack"))
            .withColumn("experience_score", scoring.score_experience("staff", "years"))
            .withColumn("growth_score", scoring.score_growth("company_stages", "stage"))
            .withColumn("final_score", scoring.weighted_score(
                "industry_score", "technical_score", "experience_score", "growth_score"))
            .withColumn("reasoning", scoring.score_reasoning(
                "industry_score", "technical_score", "experience_score", "growth_score")))


def industry_relation(spark, adjacent: dict = scoring.ADJACENT_INDUSTRIES,
                      sector: dict = scoring.INDUSTRY_SECTOR) -> DataFrame:
    """(preferred, industry, tier) rows of the industry rubric: exact,
    adjacent, same sector (the best tier per pair)."""
    names = sorted(set(sector) | set(adjacent))
    rows = []
    for a in names:
        for b in names:
            if a == b:
                t = scoring.INDUSTRY_TIERS["exact"]
            elif b in adjacent.get(a, []):
                t = scoring.INDUSTRY_TIERS["adjacent"]
            elif sector.get(a) is not None and sector.get(a) == sector.get(b):
                t = scoring.INDUSTRY_TIERS["same_sector"]
            else:
                continue
            rows.append((a, b, float(t)))
    return spark.createDataFrame(rows, "preferred string, industry string, tier double")


def adjacency_lookup(pairs: DataFrame, relation: DataFrame, *, keys=("cand_id", "doc_id"),
                     preferred_col: str = "industries", value_col: str = "industry",
                     out: str = "industry_score") -> DataFrame:
    """Best relation tier between any preferred value and the pair's value,
    as a join (for relation tables too large for literal maps).

    Spark chooses the join by the relation's size at run time; pairs explode
    their (short) preference lists, and the best tier per pair is an
    aggregate.  Pairs with no related preference score 0."""
    rel = relation.select(F.col("preferred").alias("_p"), F.col("industry").alias("_v"),
                          F.col("tier").alias("_t"))
    exploded = pairs.select(*keys, F.col(value_col).alias("_v"),
                            F.explode_outer(preferred_col).alias("_p"))
    best = (exploded.join(rel, ["_p", "_v"], "left")
            .groupBy(*keys).agg(F.max("_t").alias("_best")))
    return best.select(*keys, F.coalesce(F.col("_best"), F.lit(0.0)).cast("double").alias(out))


def min_score_filter(df: DataFrame, min_score: float = DEFAULT_MIN_SCORE,
                     col: str = "final_score") -> DataFrame:
    """Keep rows whose score (missing counts as 0) reaches the threshold.  Rows
    with an ``error`` (output that did not parse) never pass."""
    ok = F.coalesce(F.col(col), F.lit(0.0)) >= F.lit(min_score)
    return df.filter(ok & F.col("error").isNull() if "error" in df.columns else ok)


def rank_by_score(df: DataFrame, partition: str = "cand_id", score: str = "final_score",
                  distance: str = "distance", key: str = "doc_id", out: str = "rank") -> DataFrame:
    """Descending score; ties keep nearest first, then id (a stable sort of a
    nearest-first list, as in the reference)."""
    w = Window.partitionBy(partition).orderBy(F.col(score).desc(), F.col(distance).asc(), F.col(key).asc())
    return df.withColumn(out, F.row_number().over(w))


def limit_matches(df: DataFrame, num_matches: int = DEFAULT_NUM_MATCHES, rank: str = "rank") -> DataFrame:
    return df.filter(F.col(rank) <= num_matches)


def topk_per_candidate(df: DataFrame, k: int = DEFAULT_NUM_MATCHES, **kw) -> DataFrame:
    return limit_matches(rank_by_score(df, **kw), k)


def match_candidates(candidates: DataFrame, index: DataFrame,
                     num_matches: int = DEFAULT_NUM_MATCHES,
                     min_score: float = DEFAULT_MIN_SCORE,
                     knn=knn_exact, exclude: tuple[str, str] | None = None,
                     materialize: bool = True, **knn_kw) -> DataFrame:
    """Flagship: over-fetch -> score -> threshold -> rank -> limit.

    One row per (candidate, match) with ``rank`` 1..num_matches.  ``exclude``
    names a pair of columns whose equal values do not match (none by default).
    """
    if materialize:
        # Both inputs are read several times (k-NN, attribute joins):
        # compute each once into the shared checkpoint folder.
        candidates = cut_lineage(candidates)
        index = cut_lineage(index)
    if knn in (knn_exact, knn_approx):
        knn_kw.setdefault("materialize", False)      # stored above or by the caller
    hits = knn(candidates, index, overfetch(num_matches), query_id="cand_id",
               index_id="doc_id", exclude=exclude, **knn_kw).drop("rank")
    pairs = (enrich_hits(hits, index)
             .join(candidates.select(*CANDIDATE_ATTRS), "cand_id"))
    scored = min_score_filter(score_pairs(pairs), min_score)
    return (topk_per_candidate(scored, num_matches)
            .withColumn("similarity", similarity("distance")))


MATCH_COLUMNS = ["cand_id", "rank", "doc_id", "company_name", "final_score", "distance",
                 "similarity", "industry_score", "technical_score", "experience_score",
                 "growth_score", "reasoning"]


def project_match(df: DataFrame) -> DataFrame:
    """The nested match record of the reference's response."""
    return df.select(
        "cand_id", "rank",
        F.struct(
            F.col("doc_id").cast("string").alias("startup_id"),
            F.col("final_score"),
            F.col("company_name"),
            F.col("company_description"),
            F.col("distance").alias("similarity_score"),
            F.col("company_description").alias("startup_info"),
            F.struct(F.col("industry_score").alias("industry_match"),
                     F.col("technical_score").alias("technical_match"),
                     F.col("experience_score").alias("experience_match"),
                     F.col("growth_score").alias("growth_match"),
                     F.col("reasoning")).alias("match_reasons"),
            F.struct("industry", "staff", "stage").alias("metadata"),
        ).alias("match"))


def match_envelope(matches: DataFrame, candidates: DataFrame,
                   min_score: float = DEFAULT_MIN_SCORE) -> DataFrame:
    """Per candidate: matches ordered by rank, their true count and the
    threshold.  Candidates without a match keep an empty list.

    Each candidate holds at most ``num_matches`` rows, so ``collect_list``
    is bounded per group."""
    agg = (project_match(matches).groupBy("cand_id")
           .agg(F.sort_array(F.collect_list(F.struct("rank", "match"))).alias("_m")))
    match_type = agg.schema["_m"].dataType.elementType["match"].dataType
    return (candidates.select("cand_id").join(agg, "cand_id", "left")
            .select("cand_id",
                    F.coalesce(F.transform("_m", lambda x: x["match"]),
                               F.array().cast(T.ArrayType(match_type))).alias("matches"),
                    F.coalesce(F.size("_m"), F.lit(0)).cast("int").alias("count"),
                    F.lit(float(min_score)).alias("min_score_applied")))


def match_count(matches: DataFrame) -> DataFrame:
    return matches.groupBy("cand_id").agg(F.count(F.lit(1)).alias("match_count"))
