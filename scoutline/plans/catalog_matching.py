"""Registered queries for retrieval, scoring and ranking, with their DuckDB
oracles.  Every query reads the whole driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutline.functions import scoring
from scoutline.functions.vectors import cosine_distance
from scoutline.operators import knn, matching
from scoutline.plans import roles
from scoutline.plans.sqlfrag import case_list, list_lit
from scoutline.session import cut_lineage

K = matching.DEFAULT_NUM_MATCHES
HITS = knn.overfetch(K)


# ---------------------------------------------------------------- Spark side

def _hits(spark, sf):
    c, i = cut_lineage(roles.candidates(spark, sf)), cut_lineage(roles.companies(spark, sf))
    h = knn.knn_exact(c, i, HITS, query_id="cand_id", index_id="doc_id", materialize=False)
    return c, i, h


def _scored(spark, sf):
    c, i, h = _hits(spark, sf)
    pairs = matching.enrich_hits(h, i).join(c.select(*matching.CANDIDATE_ATTRS), "cand_id")
    return matching.score_pairs(pairs)


def q_match_candidates(spark: SparkSession, sf: str) -> DataFrame:
    c, i = roles.candidates(spark, sf), roles.companies(spark, sf)
    return matching.match_candidates(c, i).select(*matching.MATCH_COLUMNS)


def q_knn_exact(spark, sf):
    e = roles.read(spark, sf, "embeddings").select("vec_id", "embedding")
    return knn.knn_exact(e, e.withColumnRenamed("vec_id", "doc_id").withColumn("vec_id", F.col("doc_id")),
                         HITS, query_id="vec_id", index_id="doc_id", exclude=("vec_id", "vec_id"))


def q_cosine_distance(spark, sf):
    e = roles.read(spark, sf, "embeddings").select("vec_id", "embedding")
    b = e.select(F.col("vec_id").alias("next_id"), F.col("embedding").alias("next_embedding"))
    return (e.join(b, b.next_id == e.vec_id + 1)
            .select("vec_id", "next_id", cosine_distance("embedding", "next_embedding").alias("distance")))


def q_overfetch(spark, sf):
    _, _, h = _hits(spark, sf)
    return h.select("cand_id", "doc_id", "distance", "rank")


def q_enrich_hits(spark, sf):
    _, i, h = _hits(spark, sf)
    return matching.enrich_hits(h, i).select("cand_id", "doc_id", "distance", "company_name",
                                             "industry", "staff", "stage")


def _score_query(col):
    def run(spark, sf):
        return _scored(spark, sf).select("cand_id", "doc_id", col)
    return run


def q_adjacency_lookup(spark, sf):
    c, i, h = _hits(spark, sf)
    pairs = matching.enrich_hits(h, i).join(c.select(*matching.CANDIDATE_ATTRS), "cand_id")
    return matching.adjacency_lookup(pairs, matching.industry_relation(spark))


def q_min_score_filter(spark, sf):
    return matching.min_score_filter(_scored(spark, sf)).select("cand_id", "doc_id", "final_score")


def q_rank_by_score(spark, sf):
    return (matching.rank_by_score(matching.min_score_filter(_scored(spark, sf)))
            .select("cand_id", "doc_id", "final_score", "distance", "rank"))


def q_topk_per_candidate(spark, sf):
    return (matching.topk_per_candidate(matching.min_score_filter(_scored(spark, sf)), K)
            .select("cand_id", "doc_id", "rank"))


def q_limit_matches(spark, sf):
    """The single best match per candidate (num_matches = 1)."""
    ranked = matching.rank_by_score(matching.min_score_filter(_scored(spark, sf)))
    return matching.limit_matches(ranked, 1).select("cand_id", "doc_id", "final_score", "rank")


def q_match_record(spark, sf):
    m = matching.project_match(q_full_matches(spark, sf))
    return m.select("cand_id", "rank", F.col("match.startup_id").alias("startup_id"),
                    F.col("match.company_name").alias("company_name"),
                    F.col("match.company_description").alias("company_description"),
                    F.col("match.similarity_score").alias("similarity_score"),
                    F.col("match.match_reasons.industry_match").alias("industry_match"),
                    F.col("match.match_reasons.reasoning").alias("reasoning"),
                    F.col("match.metadata.stage").alias("stage"))


def q_full_matches(spark, sf):
    c, i = roles.candidates(spark, sf), roles.companies(spark, sf)
    return matching.match_candidates(c, i)


def q_match_envelope(spark, sf):
    c, i = cut_lineage(roles.candidates(spark, sf)), cut_lineage(roles.companies(spark, sf))
    env = matching.match_envelope(matching.match_candidates(c, i, materialize=False), c)
    return env.select("cand_id", "count", "min_score_applied",
                      F.array_join(F.transform("matches", lambda m: m["company_name"]), "|").alias("companies"))


def q_match_count(spark, sf):
    return matching.match_count(q_full_matches(spark, sf))


def q_knn_pruned(spark, sf):
    """The over-fetched hits, with rings of the index skipped by the triangle inequality."""
    c, i = cut_lineage(roles.candidates(spark, sf)), cut_lineage(roles.companies(spark, sf))
    return knn.knn_exact(c, i, HITS, query_id="cand_id", index_id="doc_id", materialize=False, prune=True)


def q_knn_approx(spark, sf):
    c, i = roles.candidates(spark, sf), cut_lineage(roles.companies(spark, sf, as_stored=True))
    # Half of the cells: the hashed texts have little cluster structure.
    return knn.knn_approx(c, i, HITS, query_id="cand_id", index_id="doc_id", n_lists=32, n_probe=16,
                          materialize=False)


QUERIES = {
    "match_candidates": q_match_candidates,
    "knn_exact": q_knn_exact,
    "cosine_distance": q_cosine_distance,
    "overfetch": q_overfetch,
    "enrich_hits": q_enrich_hits,
    "score_industry": _score_query("industry_score"),
    "score_technical": _score_query("technical_score"),
    "score_experience": _score_query("experience_score"),
    "score_growth": _score_query("growth_score"),
    "weighted_score": _score_query("final_score"),
    "score_reasoning": _score_query("reasoning"),
    "adjacency_lookup": q_adjacency_lookup,
    "min_score_filter": q_min_score_filter,
    "rank_by_score": q_rank_by_score,
    "topk_per_candidate": q_topk_per_candidate,
    "limit_matches": q_limit_matches,
    "match_record": q_match_record,
    "match_envelope": q_match_envelope,
    "match_count": q_match_count,
    "knn_pruned": q_knn_pruned,
    "knn_approx": q_knn_approx,
}


# --------------------------------------------------------------- DuckDB side

def _sql_stage(staff: str) -> str:
    parts = []
    for name, mx in zip(scoring.STAGES, scoring.STAGE_MAX_STAFF):
        parts.append(f"WHEN {staff} <= {mx} THEN '{name}'" if mx is not None else f"ELSE '{name}'")
    return "(CASE " + " ".join(parts) + " END)"


def _sql_role_case(years: str) -> str:
    parts = []
    for mx, rs in roles.ROLE_BANDS:
        parts.append(f"WHEN {years} <= {mx} THEN {list_lit(rs)}" if mx is not None else f"ELSE {list_lit(rs)}")
    return "(CASE " + " ".join(parts) + " END)"


def _stage_ord(x: str) -> str:
    return f"(NULLIF(list_position({list_lit(scoring.STAGES)}, {x}), 0) - 1)"


def _sector(x: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in scoring.INDUSTRY_SECTOR.items())
    return f"(CASE {x} {whens} ELSE NULL END)"


def sql_embed(text: str, dim: int = 64) -> str:
    """The default embedder: unit vector of token counts."""
    places = (f"list_transform(regexp_extract_all(lower(COALESCE({text}, '')), '[\\p{{L}}\\p{{N}}_]+'), "
              f"lambda t: CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % {dim})")
    counts = f"list_transform(range({dim}), lambda i: CAST(len(list_filter({places}, lambda p: p = i)) AS DOUBLE))"
    return (f"(SELECT CASE WHEN s = 0 THEN v ELSE list_transform(v, lambda x: x / sqrt(s)) END::FLOAT[] FROM "
            f"(SELECT v, list_dot_product(v, v) AS s FROM (SELECT {counts} AS v)))")


# Search text of a candidate, as ``search_text`` writes it.
_SEARCH = ("'Resume: ' || COALESCE(resume_text, '') || ' Desired Role: ' || array_to_string(desired_roles, ', ')"
           " || ' Preferred Industries: ' || array_to_string(industries, ', ')"
           " || ' Preferred Locations: ' || array_to_string(work_locations, ', ')")

CTE_BASE = f"""
best_line AS (
  SELECT o_custkey AS custkey, l_partkey,
         row_number() OVER (PARTITION BY o_custkey
                            ORDER BY l_extendedprice DESC, l_orderkey DESC, l_linenumber DESC) AS rn
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
skills AS (
  SELECT custkey, p_name FROM best_line JOIN part ON l_partkey = p_partkey WHERE rn = 1),
cands0 AS (
  SELECT c_custkey AS cand_id,
         CAST(c_custkey % 20 AS INTEGER) AS years,
         {case_list('c_mktsegment', roles.SEGMENT_INDUSTRIES)} AS industries,
         {case_list('r_name', roles.REGION_STAGES)} AS company_stages,
         CASE WHEN p_name IS NULL THEN []::VARCHAR[] ELSE [string_split(p_name, ' ')[-1]] END AS core_skills,
         CASE WHEN p_name IS NULL THEN []::VARCHAR[] ELSE [string_split(p_name, ' ')[1]] END AS foundational_skills,
         {_sql_role_case('CAST(c_custkey % 20 AS INTEGER)')} AS desired_roles,
         CASE WHEN n_name IS NULL THEN []::VARCHAR[] ELSE [n_name] END AS work_locations,
         c_name || ' has ' || CAST(CAST(c_custkey % 20 AS INTEGER) AS VARCHAR) || ' years of experience building '
           || COALESCE(p_name, 'general') || ' systems.' AS resume_text
  FROM customer
  LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN skills ON c_custkey = custkey),
cands AS (
  SELECT *, {sql_embed(_SEARCH)} AS embedding FROM cands0),
comps0 AS (
  SELECT p_partkey AS doc_id,
         p_name || ' ' || CAST(p_partkey AS VARCHAR) AS company_name,
         p_type AS industry, CAST(p_size * 2 AS INTEGER) AS staff,
         {_sql_stage('p_size * 2')} AS stage,
         [string_split(p_name, ' ')[-1]] AS core_stack,
         [string_split(p_name, ' ')[1]] AS foundational_stack,
         p_name || ' ' || CAST(p_partkey AS VARCHAR) || ' is a ' || {_sql_stage('p_size * 2')} || ' stage ' || p_type
           || ' company with ' || CAST(p_size * 2 AS VARCHAR) || ' people.' AS company_description
  FROM part),
comps AS (
  SELECT *, {sql_embed('company_description')} AS embedding FROM comps0),
dists AS (
  SELECT c.cand_id, m.doc_id,
         round(1 - list_cosine_similarity(c.embedding::DOUBLE[], m.embedding::DOUBLE[]), 6) AS distance
  FROM cands c CROSS JOIN comps m),
hits AS (
  SELECT * FROM (
    SELECT cand_id, doc_id, distance,
           CAST(row_number() OVER (PARTITION BY cand_id ORDER BY distance, doc_id) AS INTEGER) AS rank
    FROM dists) WHERE rank <= {HITS}),
pairs AS (
  SELECT h.cand_id, h.doc_id, h.distance, m.company_name, m.industry, m.staff, m.stage,
         m.core_stack, m.foundational_stack,
         c.years, c.industries, c.company_stages, c.core_skills, c.foundational_skills
  FROM hits h JOIN comps m ON h.doc_id = m.doc_id JOIN cands c ON h.cand_id = c.cand_id),
sub AS (
  SELECT *,
    CAST(COALESCE(list_max(list_transform(industries, lambda x:
      CASE WHEN x = industry THEN 1.0
           WHEN list_contains({case_list('x', scoring.ADJACENT_INDUSTRIES)}, industry) THEN 0.7
           WHEN {_sector('x')} = {_sector('industry')} THEN 0.5
           ELSE 0.0 END)), 0.0) AS DOUBLE) AS industry_score,
    CAST(CASE WHEN list_has_any(core_skills, core_stack) THEN 1.0
         WHEN COALESCE(list_bool_or(list_transform(core_skills, lambda s:
                list_has_any({case_list('s', scoring.RELATED_SKILLS)}, core_stack))), false) THEN 0.7
         WHEN list_has_any(foundational_skills, foundational_stack) THEN 0.5
         ELSE 0.0 END AS DOUBLE) AS technical_score,
    CAST(round(greatest(0.0, 1.0 - 0.1 * (
      CASE WHEN staff <= 10 THEN (CASE WHEN years < 0 THEN 0 - years WHEN years > 5 THEN years - 5 ELSE 0 END)
           WHEN staff <= 50 THEN (CASE WHEN years < 6 THEN 6 - years WHEN years > 12 THEN years - 12 ELSE 0 END)
           ELSE (CASE WHEN years < 15 THEN 15 - years ELSE 0 END) END)), 4) AS DOUBLE) AS experience_score,
    CAST(CASE list_min(list_filter(list_transform(company_stages, lambda s: abs({_stage_ord('s')} - {_stage_ord('stage')})), lambda d: d IS NOT NULL))
         WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 WHEN 2 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS growth_score
  FROM pairs),
scored AS (
  SELECT *,
    round(0.35 * industry_score + 0.25 * technical_score + 0.25 * experience_score + 0.15 * growth_score, 4) AS final_score,
    concat_ws('; ',
      CASE WHEN industry_score >= 1.0 THEN 'industry: strong' WHEN industry_score >= 0.5 THEN 'industry: partial' ELSE 'industry: weak' END,
      CASE WHEN technical_score >= 1.0 THEN 'skills: strong' WHEN technical_score >= 0.5 THEN 'skills: partial' ELSE 'skills: weak' END,
      CASE WHEN experience_score >= 1.0 THEN 'experience: strong' WHEN experience_score >= 0.5 THEN 'experience: partial' ELSE 'experience: weak' END,
      CASE WHEN growth_score >= 1.0 THEN 'stage: strong' WHEN growth_score >= 0.5 THEN 'stage: partial' ELSE 'stage: weak' END) AS reasoning
  FROM sub),
kept AS (SELECT * FROM scored WHERE COALESCE(final_score, 0.0) >= 0.6),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY cand_id ORDER BY final_score DESC, distance ASC, doc_id ASC) AS INTEGER) AS rank2
  FROM kept),
matches AS (
  SELECT cand_id, rank2 AS rank, doc_id, company_name, final_score, distance,
         round(1.0 - distance, 6) AS similarity, industry_score, technical_score,
         experience_score, growth_score, reasoning, stage, industry, staff
  FROM ranked WHERE rank2 <= {K})
"""


def _with(body: str) -> str:
    return "WITH " + CTE_BASE.strip() + "\n" + body


ORACLE = {
    "match_candidates": _with("""SELECT cand_id, rank, doc_id, company_name, final_score, distance, similarity,
       industry_score, technical_score, experience_score, growth_score, reasoning FROM matches"""),
    "knn_exact": f"""
SELECT vec_id, doc_id, distance, rank FROM (
  SELECT a.vec_id, b.vec_id AS doc_id,
         round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance,
         CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY
              round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6), b.vec_id) AS INTEGER) AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= {HITS}""",
    "cosine_distance": """
SELECT a.vec_id, b.vec_id AS next_id,
       round(1 - list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])
             / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])
                    * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS distance
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "overfetch": _with("SELECT cand_id, doc_id, distance, rank FROM hits"),
    "knn_pruned": _with("SELECT cand_id, doc_id, distance, rank FROM hits"),
    "enrich_hits": _with("SELECT cand_id, doc_id, distance, company_name, industry, staff, stage FROM pairs"),
    "score_industry": _with("SELECT cand_id, doc_id, industry_score FROM scored"),
    "adjacency_lookup": _with("SELECT cand_id, doc_id, industry_score FROM scored"),
    "score_technical": _with("SELECT cand_id, doc_id, technical_score FROM scored"),
    "score_experience": _with("SELECT cand_id, doc_id, experience_score FROM scored"),
    "score_growth": _with("SELECT cand_id, doc_id, growth_score FROM scored"),
    "weighted_score": _with("SELECT cand_id, doc_id, final_score FROM scored"),
    "score_reasoning": _with("SELECT cand_id, doc_id, reasoning FROM scored"),
    "min_score_filter": _with("SELECT cand_id, doc_id, final_score FROM kept"),
    "rank_by_score": _with("SELECT cand_id, doc_id, final_score, distance, rank2 AS rank FROM ranked"),
    "topk_per_candidate": _with("SELECT cand_id, doc_id, rank FROM matches"),
    "limit_matches": _with("SELECT cand_id, doc_id, final_score, rank2 AS rank FROM ranked WHERE rank2 <= 1"),
    "match_record": _with("""SELECT cand_id, rank, CAST(doc_id AS VARCHAR) AS startup_id, company_name,
       company_name || ' is a ' || stage || ' stage ' || industry || ' company with ' || CAST(staff AS VARCHAR) || ' people.' AS company_description,
       distance AS similarity_score, industry_score AS industry_match, reasoning, stage FROM matches"""),
    "match_envelope": _with("""SELECT c.cand_id, CAST(COALESCE(m.n, 0) AS INTEGER) AS count, CAST(0.6 AS DOUBLE) AS min_score_applied,
       COALESCE(m.companies, '') AS companies
FROM cands c LEFT JOIN (
  SELECT cand_id, count(*) AS n, string_agg(company_name, '|' ORDER BY rank) AS companies
  FROM matches GROUP BY cand_id) m ON c.cand_id = m.cand_id"""),
    "match_count": _with("SELECT cand_id, count(*) AS match_count FROM matches GROUP BY cand_id"),
}
