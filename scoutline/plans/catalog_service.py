"""Registered queries for sources, sinks, uploads, requests and model output,
with their DuckDB oracles.  Tables that only exist in a running service (model
output, request bodies, files) are built by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoutline.functions import text as X
from scoutline.operators import ann_index, knn, matching
from scoutline.operators import outreach as OU
from scoutline.operators import sessions as SE
from scoutline.plans import roles
from scoutline.plans.catalog_matching import CTE_BASE, HITS, ORACLE as MATCHING_ORACLE
from scoutline.plans.catalog_text import rx, s_html, s_trim
from scoutline.plans.sqlfrag import q as sq
from scoutline.session import cut_lineage, new_folder
from scoutline.sources.files import extract_text, scan_documents
from scoutline.sources.index import read_index, write_index, write_run_report

REPORT_CLOCK = "2024-01-31 00:00:00"
EXTENSIONS = ["pdf", "docx"]
PAGES_PER_FILE = 500


own_folder = new_folder


# ---------------------------------------------------------------- Spark side

def q_scan_documents(spark, sf):
    """Pages written to text files (one base64 line each), scanned and read back."""
    base = own_folder(spark, "scan")
    line = F.concat_ws(",", F.col("page_id").cast("string"), F.replace(F.base64(F.encode("html", "UTF-8")), F.lit("\r\n")))
    (roles.read(spark, sf, "pages").select(line).write
     .option("maxRecordsPerFile", PAGES_PER_FILE).text(base))
    files = extract_text(scan_documents(spark, base, "*.txt"))
    got = files.select(F.explode(F.split(F.trim("raw_text", F.lit("\n")), "\n")).alias("line"))
    html = F.decode(F.unbase64(F.element_at(F.split("line", ","), 2)), "UTF-8")
    return got.select(F.element_at(F.split("line", ","), 1).cast("bigint").alias("page_id"),
                      F.md5(html).alias("html_md5"))


def page_files(pages):
    """Pages as (page_id, path, content) of files of four types; every tenth holds a byte that is no UTF-8."""
    ext = F.element_at(F.array(*[F.lit(e) for e in (".html", ".txt", ".pdf", ".HTM")]), (F.col("page_id") % 4 + 1).cast("int"))
    whole = F.encode("html", "UTF-8")
    return pages.select("page_id", F.concat(F.col("page_id").cast("string"), ext).alias("path"),
                        F.when(F.col("page_id") % 10 == 9, F.concat(F.unhex(F.lit("FF")), whole)).otherwise(whole).alias("content"))


def q_extract_text(spark, sf):
    files = page_files(roles.read(spark, sf, "pages"))
    return extract_text(files).select("page_id", F.md5("raw_text").alias("text_md5"), F.length("raw_text").alias("n_chars"))


def _content_ids(spark, sf):
    d = X.drop_empty_text(roles.read(spark, sf, "documents"))
    return d.select(X.doc_id(F.lit("docs/release.pdf"), F.col("text")).alias("content_id"), "doc_id")


def q_write_index(spark, sf):
    """Two runs into one index: the labelled documents, then all; the first
    write of a content id stays."""
    base, docs = own_folder(spark, "index"), _content_ids(spark, sf)
    labelled = docs.join(roles.read(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    for batch in (labelled.select("content_id", "doc_id"), docs):
        write_index(batch, base, id_col="content_id", order_col="doc_id")
    return read_index(spark, base)


def q_write_run_report(spark, sf):
    base = own_folder(spark, "report")
    write_run_report(_content_ids(spark, sf), base, clock=REPORT_CLOCK)
    ids = spark.read.parquet(f"{base}/processed_ids")
    summary = spark.read.schema("processed_documents bigint, timestamp string").json(f"{base}/summary")
    return summary.crossJoin(F.broadcast(ids.agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))))


def q_remove_captions(spark, sf):
    """Documents with a caption naming their source in front."""
    captioned = F.concat(F.lit("(Photo: "), "source", F.lit(") "), "text", F.lit(" (see Image "), "lang", F.lit(")"))
    return roles.read(spark, sf, "documents").select("doc_id", X.remove_captions(captioned).alias("text"))


def q_cut_about(spark, sf):
    """Documents with an "About" line naming their source near the end, cut by
    the rule for the end of a text and by the rule for every line."""
    d = roles.read(spark, sf, "documents")
    text = F.concat("text", F.lit("\nAbout "), "source", F.lit("\n"), "lang")
    return d.select("doc_id", X.cut_about(text).alias("text"), X.cut_about(text, line_wise=True).alias("text_by_line"))


def q_validate_upload(spark, sf):
    p = roles.read(spark, sf, "pages")
    name = F.when(F.col("page_id") % 5 != 0, F.concat(F.lit("cv."), F.element_at(F.split("url", r"\."), -1)))
    own = F.when(F.col("page_id") % 3 == 0, F.concat(F.col("page_id").cast("string"), F.lit(".PDF"))).otherwise(name)
    return p.select("page_id", SE.validate_upload(F.col("page_id") % 7 != 0, own, EXTENSIONS).alias("error"))


def _bodies(spark, sf):
    """Preference bodies from the events: valid ones, one with a string for a
    list, one without a field, and broken JSON for errors."""
    ev = roles.read(spark, sf, "events")
    kind, k = F.col("event_type"), F.col("event_id").cast("string")
    lists = [F.array(kind).alias("desired_roles"), F.array(k, kind).alias("industries"), F.array(k).alias("work_locations")]
    stages = F.array().cast("array<string>").alias("company_stages")
    body = (F.when(kind == "error", F.concat(F.lit("!"), "props"))
            .when(F.col("event_id") % 7 == 0, F.to_json(F.struct(*lists, kind.alias("company_stages"))))
            .when(F.col("event_id") % 11 == 0, F.to_json(F.struct(*lists)))
            .otherwise(F.to_json(F.struct(*lists, stages, F.lit("x").alias("other")))))
    return ev.select("event_id", "user_id", "event_type", body.alias("body"))


def q_validate_preferences(spark, sf):
    b = _bodies(spark, sf)
    return b.select("event_id", SE.validate_preferences(b, "body").alias("error"))


def q_project_preferences(spark, sf):
    p = SE.project_preferences(_bodies(spark, sf), "body")
    return p.select("event_id", *[F.array_join(F.col("preferences")[f], ",").alias(f) for f in SE.PREFERENCE_FIELDS])


def q_validate_outreach(spark, sf):
    ev = roles.read(spark, sf, "events")
    session = F.when(F.col("event_type") != "error", F.col("user_id").cast("string"))
    company = F.when(F.col("event_id") % 9 == 0, F.lit("")).otherwise(F.col("event_type"))
    return ev.select("event_id", SE.validate_outreach(session, company).alias("error"))


def q_company_info(spark, sf):
    m = matching.project_match(matching.match_candidates(roles.candidates(spark, sf), roles.companies(spark, sf)))
    return m.select("cand_id", "rank", OU.company_info("match").alias("info")).select("cand_id", "rank", "info.*")


def _evaluations(spark, sf):
    """Model output with real scores; some scores are strings, some rows are no
    object or broken."""
    ev = roles.read(spark, sf, "events")
    score = (F.col("event_id") % 101) / F.lit(100.0)
    good = F.struct(F.col("event_type").alias("company_name"), score.alias("final_score"))
    raw = (F.when(F.col("event_type") == "error", F.concat(F.lit("!"), "props"))
           .when(F.col("event_id") % 13 == 0, F.lit("5"))
           .when(F.col("event_id") % 7 == 0, F.to_json(F.struct(F.lit("0.9").alias("final_score"))))
           .otherwise(F.to_json(good)))
    return OU.parse_evaluation(ev.select("event_id", raw.alias("raw")), "raw")


def q_parse_scores(spark, sf):
    return _evaluations(spark, sf).select("event_id", "company_name", "final_score", "error", "raw_response")


def q_min_score_evaluations(spark, sf):
    return matching.min_score_filter(_evaluations(spark, sf), 0.0).select("event_id", "final_score")


def _vectors(spark, sf):
    e = roles.read(spark, sf, "embeddings").select("vec_id", "embedding")
    return e, e.withColumnRenamed("vec_id", "doc_id").withColumn("vec_id", F.col("doc_id"))


def q_ann_index(spark, sf):
    """Stored cells searched in full: equal to the exact search."""
    e, stored = _vectors(spark, sf)
    path = own_folder(spark, "ann")
    ann_index.build_ann_index(stored, path, index_id="doc_id", n_lists=32)
    return ann_index.search_ann_index(spark, path, e, HITS, query_id="vec_id", index_id="doc_id", n_probe=32,
                                      exclude=("vec_id", "vec_id"))


def q_ann_append(spark, sf):
    """An index built on a third of the vectors and brought up to date in two batches that split
    cells, searched in full: equal to the exact search over all."""
    e, stored = _vectors(spark, sf)
    path = own_folder(spark, "ann")
    ann_index.build_ann_index(stored.where("doc_id % 3 = 0"), path, index_id="doc_id", n_lists=8)
    for part in (1, 2):
        ann_index.append_ann_index(spark, path, stored.where(F.col("doc_id") % 3 == part), index_id="doc_id",
                                   max_rows=e.count() // 12)
    return ann_index.search_ann_index(spark, path, e, HITS, query_id="vec_id", index_id="doc_id",
                                      n_probe=len(ann_index.read_cells(spark, path).ids), exclude=("vec_id", "vec_id"))


def q_ann_codes(spark, sf):
    """Recall of the code search (16 bytes a vector, 48 vectors compared per query) against the exact one."""
    e, stored = (cut_lineage(x) for x in _vectors(spark, sf))
    path = own_folder(spark, "ann")
    ids = {"query_id": "vec_id", "index_id": "doc_id"}
    ann_index.build_ann_index(stored, path, index_id="doc_id", n_lists=32, code_bytes=16)
    near = ann_index.search_ann_index(spark, path, e, HITS, n_probe=32, rerank=8 * HITS, exclude=("vec_id", "vec_id"), **ids)
    exact = knn.knn_exact(e, stored, HITS, exclude=("vec_id", "vec_id"), materialize=False, **ids)
    keys = ["vec_id", "doc_id"]
    both = exact.select(*keys).join(near.select(*keys, F.lit(1).alias("hit")), keys, "left")
    return both.agg(F.count("*").alias("exact_hits"), (F.count("hit") >= 0.9 * F.count("*")).alias("recall_reached"))


def q_match_approx(spark, sf):
    """The flagship over approximate hits from every cell."""
    c, i = roles.candidates(spark, sf), roles.companies(spark, sf)
    return matching.match_candidates(c, i, knn=knn.knn_approx, n_lists=16, n_probe=16).select(*matching.MATCH_COLUMNS)


QUERIES = {
    "scan_documents": q_scan_documents,
    "extract_text": q_extract_text,
    "write_index": q_write_index,
    "write_run_report": q_write_run_report,
    "remove_captions_in_text": q_remove_captions,
    "cut_about": q_cut_about,
    "validate_upload": q_validate_upload,
    "validate_preferences": q_validate_preferences,
    "project_preferences": q_project_preferences,
    "validate_outreach": q_validate_outreach,
    "company_info": q_company_info,
    "parse_scores": q_parse_scores,
    "min_score_evaluations": q_min_score_evaluations,
    "ann_index": q_ann_index,
    "ann_append": q_ann_append,
    "ann_codes": q_ann_codes,
    "match_approx": q_match_approx,
}


# --------------------------------------------------------------- DuckDB side

_IDS = """ids AS (SELECT 'release_' || substr(md5(text), 1, 8) AS content_id, doc_id
  FROM documents WHERE text IS NOT NULL AND text <> '')"""
_TEXT = f"""CASE WHEN page_id % 10 = 9 OR page_id % 4 = 2 THEN '' WHEN page_id % 4 = 1 THEN html
  ELSE {s_html('html')} END"""
_BAD = sq(SE.MSG_BAD_JSON)
_BROKEN = "(event_type = 'error' OR event_id % 13 = 0 OR event_id % 7 = 0)"

ORACLE = {
    "scan_documents": "SELECT page_id, md5(html) AS html_md5 FROM pages",
    "extract_text": f"""
SELECT page_id, md5(t) AS text_md5, CAST(length(t) AS INTEGER) AS n_chars
FROM (SELECT page_id, {_TEXT} AS t FROM pages)""",
    "write_index": f"""
WITH {_IDS}
SELECT content_id, COALESCE(min(doc_id) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)), min(doc_id)) AS doc_id
FROM ids GROUP BY content_id""",
    "write_run_report": f"""
WITH {_IDS}
SELECT count(*) AS processed_documents, {sq(REPORT_CLOCK)} AS timestamp, min(doc_id) AS first_id, max(doc_id) AS last_id
FROM ids""",
    "remove_captions_in_text": f"""
SELECT doc_id, {rx("'(Photo: ' || source || ') ' || text || ' (see Image ' || lang || ')'", X.CAPTION_PATTERN)} AS text
FROM documents""",
    "cut_about": f"""
SELECT doc_id, {rx("t", X.ABOUT_PATTERN)} AS text, {rx("t", '(?im)^About .*' + chr(10) + '.*$')} AS text_by_line
FROM (SELECT doc_id, text || chr(10) || 'About ' || source || chr(10) || lang AS t FROM documents)""",
    "validate_upload": f"""
SELECT page_id, CASE WHEN page_id % 7 = 0 THEN {sq(SE.MSG_NO_FILE)} WHEN page_id % 3 = 0 THEN NULL
  WHEN page_id % 5 = 0 THEN {sq(SE.MSG_NO_NAME)}
  WHEN lower(string_split(url, '.')[-1]) NOT IN ('pdf', 'docx') THEN {sq(SE.MSG_BAD_TYPE)} END AS error
FROM pages""",
    "validate_preferences": f"""
SELECT event_id, CASE WHEN event_type = 'error' THEN {_BAD}
  WHEN event_id % 7 = 0 THEN 'company_stages must be an array'
  WHEN event_id % 11 = 0 THEN 'Missing required field: company_stages' END AS error
FROM events""",
    "project_preferences": """
SELECT event_id, CASE WHEN ok THEN event_type END AS desired_roles,
  CASE WHEN ok THEN CAST(event_id AS VARCHAR) || ',' || event_type END AS industries,
  CASE WHEN ok THEN CAST(event_id AS VARCHAR) END AS work_locations,
  CASE WHEN ok AND event_id % 7 <> 0 AND event_id % 11 <> 0 THEN '' END AS company_stages
FROM (SELECT *, event_type <> 'error' AS ok FROM events)""",
    "validate_outreach": f"""
SELECT event_id, CASE WHEN event_type = 'error' OR event_id % 9 = 0 THEN {sq(SE.MSG_OUTREACH_PARAMS)} END AS error
FROM events""",
    "company_info": "WITH " + CTE_BASE.strip() + """
SELECT cand_id, rank, company_name, company_name || ' is a ' || stage || ' stage ' || industry || ' company with '
  || CAST(staff AS VARCHAR) || ' people.' AS company_description, industry FROM matches""",
    "parse_scores": f"""
SELECT event_id, CASE WHEN NOT {_BROKEN} THEN event_type END AS company_name,
  CASE WHEN NOT {_BROKEN} THEN CAST(event_id % 101 AS DOUBLE) / 100 END AS final_score,
  CASE WHEN {_BROKEN} THEN {sq(OU.MSG_BAD_EVALUATION)} END AS error,
  CASE WHEN event_type = 'error' THEN '!' || props WHEN event_id % 13 = 0 THEN '5'
       WHEN event_id % 7 = 0 THEN '{{"final_score":"0.9"}}' END AS raw_response
FROM events""",
    "min_score_evaluations": f"""
SELECT event_id, CAST(event_id % 101 AS DOUBLE) / 100 AS final_score FROM events WHERE NOT {_BROKEN}""",
    "ann_index": MATCHING_ORACLE["knn_exact"],
    "ann_append": MATCHING_ORACLE["knn_exact"],
    "ann_codes": f"SELECT count(*) AS exact_hits, true AS recall_reached FROM ({MATCHING_ORACLE['knn_exact']})",
    "match_approx": MATCHING_ORACLE["match_candidates"],
}
