"""Registered queries for search text, prompts, contacts, company lookup and
outreach packages, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoutline.functions import prompts as PR
from scoutline.operators import embed as EM
from scoutline.operators import knn, matching
from scoutline.operators import outreach as OU
from scoutline.plans import roles
from scoutline.plans.catalog_matching import CTE_BASE, HITS, sql_embed
from scoutline.operators.preprocess import preprocess
from scoutline.plans.catalog_text import gazetteer, rx, s_clean, s_words
from scoutline.streaming.index_stream import index_rows
from scoutline.functions.text import WS
from scoutline.plans.sqlfrag import q as sq
from scoutline.session import cut_lineage

OWN_CONTACT_MIN_BALANCE = 5000.0


def _cands(spark, sf):
    return roles.candidates(spark, sf)


def _hits_with_attrs(spark, sf):
    """Over-fetched hits with company and candidate attributes, computed once
    (the short hit list is materialised; matches and lookups both read it)."""
    c = cut_lineage(_cands(spark, sf))
    i = cut_lineage(roles.companies(spark, sf))
    h = knn.knn_exact(c, i, HITS, query_id="cand_id", index_id="doc_id", materialize=False)
    pairs = (matching.enrich_hits(h, i)
             .join(c.select(*matching.CANDIDATE_ATTRS, "resume_text", "desired_roles",
                            "work_locations"), "cand_id"))
    return cut_lineage(pairs)


def _matches_from(pairs):
    scored = matching.min_score_filter(matching.score_pairs(pairs.drop("rank")))
    return matching.topk_per_candidate(scored, matching.DEFAULT_NUM_MATCHES)


def _matches(spark, sf):
    return _matches_from(_hits_with_attrs(spark, sf))


def q_search_text(spark, sf):
    c = _cands(spark, sf)
    args = ("resume_text", "desired_roles", "industries", "work_locations")
    return c.select("cand_id", PR.search_text(*args).alias("search_text"),
                    PR.search_text(*args, mode="reference").alias("search_text_reference"))


def q_eval_prompt(spark, sf):
    h = _hits_with_attrs(spark, sf)
    p = PR.eval_prompt("company_description", "resume_text", "desired_roles", "industries",
                       "work_locations", "company_stages")
    return h.select("cand_id", "doc_id", F.length(p).alias("length"), F.md5(p).alias("md5"))


def q_fallback_contacts(spark, sf):
    s = roles.read(spark, sf, "supplier")
    c = OU.fallback_contacts(F.col("s_name"))
    return s.select("s_suppkey", c[0]["name"].alias("name1"), c[0]["email"].alias("email1"),
                    c[1]["role"].alias("role2"), c[1]["email"].alias("email2"))


def q_parse_contacts(spark, sf):
    s = roles.read(spark, sf, "supplier")
    own = F.to_json(F.array(F.struct(F.col("s_name").alias("name"), F.lit("CEO").alias("role"),
                                     F.concat(F.lit("ceo@"), OU.company_domain("s_name"), F.lit(".com")).alias("email"))))
    raw = F.when(F.col("s_acctbal") > OWN_CONTACT_MIN_BALANCE, own).otherwise(F.col("s_name"))
    c = OU.parse_contacts(raw, F.col("s_name"))
    return s.select("s_suppkey", F.size(c).cast("int").alias("n_contacts"),
                    c[0]["name"].alias("first_name"), c[0]["email"].alias("first_email"))


def _lookups(spark, sf):
    pairs = _hits_with_attrs(spark, sf)
    h = pairs.select("cand_id", "company_name", F.col("rank").alias("hit_rank"))
    m = _matches_from(pairs).select("cand_id", "company_name", "rank", "company_description",
                                    "industry", "resume_text", "desired_roles")
    return OU.lookup_company(h, m)


def q_lookup_company(spark, sf):
    return _lookups(spark, sf).select("cand_id", "company_name", "rank", "error")


def _packages(spark, sf):
    found = _lookups(spark, sf).filter(F.col("error").isNull())
    return OU.outreach_package(found, industry_col="industry")


def q_outreach_package(spark, sf):
    p = _packages(spark, sf)
    return p.select("cand_id", "company_name", F.col("contacts")[0]["email"].alias("email1"),
                    F.col("contacts")[1]["email"].alias("email2"), "cover_letter")


def q_cover_letter(spark, sf):
    m = _matches(spark, sf)
    letter = OU.cover_letter("resume_text", "company_name", "company_description", "industry",
                             OU.role_preference("desired_roles"))
    return m.select("cand_id", "doc_id", letter.alias("cover_letter"))


def q_outreach_prompt(spark, sf):
    m = _matches(spark, sf)
    role = OU.role_preference("desired_roles")
    cp = OU.contact_prompt("company_name", "company_description", "industry", role)
    lp = OU.letter_prompt("resume_text", "company_name", "company_description", "industry", role)
    return m.select("cand_id", "doc_id", F.md5(cp).alias("contact_prompt_md5"),
                    F.length(lp).alias("letter_prompt_length"), F.md5(lp).alias("letter_prompt_md5"))


def q_outreach_by_company(spark, sf):
    p = _packages(spark, sf)
    by = OU.outreach_by_company(p, order_col="hit_rank")
    return by.select("cand_id", F.explode("outreach_packages").alias("company_name", "letter")) \
        .select("cand_id", "company_name", F.length("letter").alias("letter_length"))


def q_embed_hash(spark, sf):
    d = roles.read(spark, sf, "documents").select("doc_id", "text")
    return EM.embed(d, "text").select("doc_id", "embedding")


def _index_rows(spark, sf):
    """The stored index rows of the documents table, from raw text."""
    d = roles.read(spark, sf, "documents").select("doc_id", "text", "source")
    d = d.withColumn("path", F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".pdf"))))
    return index_rows(preprocess(d, gazetteer=gazetteer(spark, sf)))


def q_index_rows(spark, sf):
    return _index_rows(spark, sf).select("doc_id", "filename", "document", "embedding", "word_count")


def q_match_from_text(spark, sf):
    """Candidates' search texts against the index built from the documents' texts."""
    return knn.knn_exact(roles.candidates(spark, sf), _index_rows(spark, sf).select("doc_id", "embedding"), HITS,
                         query_id="cand_id", index_id="doc_id")


QUERIES = {
    "index_rows": q_index_rows,
    "match_from_text": q_match_from_text,
    "search_text": q_search_text,
    "eval_prompt": q_eval_prompt,
    "fallback_contacts": q_fallback_contacts,
    "parse_contacts": q_parse_contacts,
    "lookup_company": q_lookup_company,
    "outreach_package": q_outreach_package,
    "cover_letter": q_cover_letter,
    "outreach_prompt": q_outreach_prompt,
    "outreach_by_company": q_outreach_by_company,
    "embed_hash": q_embed_hash,
}


# --------------------------------------------------------------- DuckDB side

def sql_format(fmt: str, args) -> str:
    """Render a printf-style template (only %s and %%) as a SQL concatenation."""
    pieces = fmt.replace("%%", "\x00").split("%s")
    assert len(pieces) == len(args) + 1
    out = []
    for i, p in enumerate(pieces):
        if p:
            out.append(sq(p.replace("\x00", "%")))
        if i < len(args):
            out.append(f"({args[i]})")
    return "(" + " || ".join(out) + ")"


def _py_list(e):
    return f"('[' || array_to_string(list_transform({e}, lambda x: '''' || x || ''''), ', ') || ']')"


def _trim(e):
    return rx(e, "^" + WS + "+|" + WS + "+$")


def _domain(e):
    return f"replace(lower(COALESCE({e}, 'company')), ' ', '')"


ROLE = "COALESCE(desired_roles[1], '')"
INDUSTRY = "COALESCE(industry, 'Technology')"
EVAL_FMT = ("Evaluate this candidate for this startup.\n\nSTARTUP:\n%s\n\nRESUME:\n%s\n\n"
            "PREFERENCES:\nRoles: %s\nIndustries: %s\nLocations: %s\nStages: %s\n\n"
            "Score industry (35%%), technical skills (25%%), experience level (25%%) and growth stage "
            "(15%%) between 0 and 1, and answer with one JSON object holding company_name, "
            "company_description, industry_score, technical_score, experience_score, growth_score, "
            "final_score and reasoning.")
CONTACT_FMT = ("Task: invent two plausible contact people at the company below.\n"
               "company = %s\nabout = %s\nsector = %s\nrole sought = %s\n"
               "Answer with a JSON array of two objects (keys: name, role, email). "
               "Both should be people who would decide on hiring for: %s.")
LETTER_PROMPT_FMT = ("Task: cover letter, formal tone, opening line \"Dear Hiring Manager,\".\n"
                     "role sought = %s\ncompany = %s\nsector = %s\nabout = %s\nbackground = %s")
LETTER_SQL = sql_format(OU.LETTER_TEMPLATE, [ROLE, "company_name", "COALESCE(company_description, '')",
                                             "resume_text", "company_name", INDUSTRY])

MATCH_PLUS = """mplus AS (
  SELECT m.*, c.resume_text, c.desired_roles, m2.company_description
  FROM matches m JOIN cands c ON m.cand_id = c.cand_id JOIN comps m2 ON m.doc_id = m2.doc_id),
hitnames AS (SELECT h.cand_id, m2.company_name, h.rank AS hit_rank FROM hits h JOIN comps m2 ON h.doc_id = m2.doc_id),
lookups AS (
  SELECT h.cand_id, h.company_name, h.hit_rank, f.rank, f.company_description, f.industry, f.resume_text,
         f.desired_roles, CASE WHEN f.rank IS NULL THEN 'Company not found in matches' END AS error
  FROM hitnames h LEFT JOIN (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cand_id, company_name ORDER BY rank) AS rn FROM mplus)
    WHERE rn = 1) f ON h.cand_id = f.cand_id AND h.company_name = f.company_name)"""


def _w(body):
    return "WITH " + CTE_BASE.strip() + ",\n" + MATCH_PLUS + "\n" + body


ORACLE = {
    "index_rows": f"""
WITH c AS (SELECT doc_id, CAST(doc_id AS VARCHAR) || '.pdf' AS filename, {s_clean('text')} AS document FROM documents)
SELECT doc_id, filename, document, {sql_embed('document')} AS embedding, {s_words('document')} AS word_count FROM c""",
    "match_from_text": "WITH " + CTE_BASE.strip() + f""",
texts AS (SELECT doc_id, {s_clean('text')} AS document FROM documents),
stored AS (SELECT doc_id, {sql_embed('document')} AS embedding FROM texts),
near AS (
  SELECT c.cand_id, m.doc_id,
         round(1 - COALESCE(list_cosine_similarity(c.embedding::DOUBLE[], m.embedding::DOUBLE[]), 0), 6) AS distance
  FROM cands c CROSS JOIN stored m)
SELECT * FROM (
  SELECT cand_id, doc_id, distance,
         CAST(row_number() OVER (PARTITION BY cand_id ORDER BY distance, doc_id) AS INTEGER) AS rank
  FROM near) WHERE rank <= {HITS}""",
    "embed_hash": f"SELECT doc_id, {sql_embed('text')} AS embedding FROM documents",
    "search_text": "WITH " + CTE_BASE.strip() + "\nSELECT cand_id, " + _trim(
        "'Resume: ' || resume_text || chr(10) || '        Desired Role: ' || array_to_string(desired_roles, ', ')"
        " || chr(10) || '        Preferred Industries: ' || array_to_string(industries, ', ')"
        " || chr(10) || '        Preferred Locations: ' || array_to_string(work_locations, ', ')") +
    " AS search_text, " + _trim(
        "'Resume: ' || resume_text || chr(10) || '        Desired Role: '"
        " || chr(10) || '        Preferred Industries: ' || array_to_string(industries, ', ')"
        " || chr(10) || '        Preferred Locations: '") + " AS search_text_reference FROM cands",
    "eval_prompt": "WITH " + CTE_BASE.strip() + f""",
ev AS (
  SELECT h.cand_id, h.doc_id, {sql_format(EVAL_FMT, ['m.company_description', 'c.resume_text',
                                                     _py_list('c.desired_roles'), _py_list('c.industries'),
                                                     _py_list('c.work_locations'), _py_list('c.company_stages')])} AS p
  FROM hits h JOIN comps m ON h.doc_id = m.doc_id JOIN cands c ON h.cand_id = c.cand_id)
SELECT cand_id, doc_id, CAST(length(p) AS INTEGER) AS length, md5(p) AS md5 FROM ev""",
    "fallback_contacts": f"""
SELECT s_suppkey, 'John Smith' AS name1, 'jsmith@' || {_domain('s_name')} || '.com' AS email1,
       'Technical Recruiter' AS role2, 'sjohnson@' || {_domain('s_name')} || '.com' AS email2
FROM supplier""",
    "parse_contacts": f"""
SELECT s_suppkey,
  CASE WHEN s_acctbal > {OWN_CONTACT_MIN_BALANCE} THEN 1 ELSE 2 END AS n_contacts,
  CASE WHEN s_acctbal > {OWN_CONTACT_MIN_BALANCE} THEN s_name ELSE 'John Smith' END AS first_name,
  CASE WHEN s_acctbal > {OWN_CONTACT_MIN_BALANCE} THEN 'ceo@' ELSE 'jsmith@' END || {_domain('s_name')} || '.com' AS first_email
FROM supplier""",
    "lookup_company": _w("SELECT cand_id, company_name, rank, error FROM lookups"),
    "outreach_package": _w(f"""SELECT cand_id, company_name,
  'jsmith@' || {_domain('company_name')} || '.com' AS email1,
  'sjohnson@' || {_domain('company_name')} || '.com' AS email2,
  {LETTER_SQL} AS cover_letter
FROM lookups WHERE error IS NULL"""),
    "cover_letter": _w(f"SELECT cand_id, doc_id, {LETTER_SQL} AS cover_letter FROM mplus"),
    "outreach_prompt": _w(f"""SELECT cand_id, doc_id,
  md5({sql_format(CONTACT_FMT, ['company_name', 'company_description', INDUSTRY, ROLE, ROLE])}) AS contact_prompt_md5,
  CAST(length({sql_format(LETTER_PROMPT_FMT, [ROLE, 'company_name', INDUSTRY, "COALESCE(company_description, '')", 'resume_text'])}) AS INTEGER) AS letter_prompt_length,
  md5({sql_format(LETTER_PROMPT_FMT, [ROLE, 'company_name', INDUSTRY, "COALESCE(company_description, '')", 'resume_text'])}) AS letter_prompt_md5
FROM mplus"""),
    "outreach_by_company": _w(f"""SELECT cand_id, company_name, CAST(length({LETTER_SQL}) AS INTEGER) AS letter_length
FROM lookups WHERE error IS NULL"""),
}
