"""Registered queries for session events, request validation, JSON payloads
and grouped operators, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoutline.functions import text as X
from scoutline.operators import aggregates as AG
from scoutline.operators import outreach as OU
from scoutline.operators import sessions as SE
from scoutline.plans import roles
from scoutline.plans.sqlfrag import q as sq
from scoutline.plans.catalog_text import rx
from scoutline.session import new_folder
from scoutline.sources.index import index_upsert, write_run_report

REPORT_CLOCK = "2024-01-31 00:00:00"


def _events(spark, sf):
    return roles.session_events(spark, sf)


def _sessions(spark, sf):
    return SE.latest_per_session(_events(spark, sf))


def _requests(spark, sf):
    """Incoming requests: every customer id used as a session id."""
    return roles.read(spark, sf, "customer").select(F.col("c_custkey").alias("session_id"), "c_name")


def _model_output(spark, sf):
    """Event payloads as model output; payloads of 'error' events get a prefix that breaks the JSON."""
    ev = roles.read(spark, sf, "events")
    raw = F.when(F.col("event_type") == "error", F.concat(F.lit("!"), "props")).otherwise(F.col("props"))
    return ev.select("event_id", "user_id", raw.alias("raw"))


def q_json_props(spark, sf):
    ev = roles.read(spark, sf, "events")
    return ev.select("event_id", SE.parse_request_json("props", "k INT")["k"].alias("k"))


def q_validate_prefs(spark, sf):
    m = _model_output(spark, sf)
    known = _sessions(spark, sf).select(F.col("session_id").alias("user_id"),
                                        F.col("created").isNotNull().alias("_known"))
    j = m.join(known, "user_id", "left")
    return j.select("event_id", SE.validate_preferences(j, "raw", ["k"], known_col="_known").alias("error"))


def q_latest_per_session(spark, sf):
    return _sessions(spark, sf)


def q_known_sessions(spark, sf):
    return SE.known_sessions(_requests(spark, sf), _sessions(spark, sf))


def q_unknown_sessions(spark, sf):
    return SE.unknown_sessions(_requests(spark, sf), _sessions(spark, sf))


def q_session_lookup(spark, sf):
    return SE.get_session(_requests(spark, sf), _sessions(spark, sf)).select("session_id", "resume", "error")


def q_match_ready(spark, sf):
    return SE.match_ready(_requests(spark, sf), _sessions(spark, sf)).select("session_id", "status")


def q_stored_name(spark, sf):
    ev = roles.read(spark, sf, "events")
    name = F.concat(F.lit("resume "), F.col("user_id").cast("string"), F.lit(".pdf"))
    return ev.select("event_id", X.stored_name(name, F.col("ts")).alias("stored_name"))


def q_parse_evaluation(spark, sf):
    p = OU.parse_evaluation(_model_output(spark, sf), "raw")
    return p.select("event_id", "company_name", "final_score", "error", "raw_response")


def q_run_counts(spark, sf):
    d = roles.read(spark, sf, "documents")
    ok = F.length(X.trim_text("text")) > 0
    return AG.run_counts(d, ok, by="source")


def q_run_report(spark, sf):
    """The report of a run over the documents with text: its summary and the span of its ids."""
    base = new_folder(spark, "run_report")
    write_run_report(X.drop_empty_text(roles.read(spark, sf, "documents")), base, clock=REPORT_CLOCK)
    summary = spark.read.schema("processed_documents bigint, timestamp string").json(f"{base}/summary")
    ids = spark.read.parquet(f"{base}/processed_ids").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    return summary.join(ids)                      # one row each


def _conv(spark, sf):
    return roles.read(spark, sf, "conversations")


def q_concat_pages(spark, sf):
    return AG.concat_pages(_conv(spark, sf), "conv_id", "turn", "text", " ")


def q_ordered_distinct(spark, sf):
    od = AG.ordered_distinct(_conv(spark, sf), "conv_id", "turn", "role", "roles")
    return od.select("conv_id", AG.csv_list("roles").alias("roles"))


def q_csv_list(spark, sf):
    c = _conv(spark, sf)
    turns = F.sort_array(F.collect_list(F.when(F.col("role") == "assistant", F.col("turn"))))
    return (c.groupBy("conv_id")
            .agg(AG.csv_list(F.transform(turns, lambda t: t.cast("string"))).alias("assistant_turns")))


def q_next_turn(spark, sf):
    return AG.next_row(_conv(spark, sf).select("conv_id", "turn", "text"), "conv_id", "turn", "text",
                       out="next_text").select("conv_id", "turn", "next_text")


def q_index_upsert(spark, sf):
    d = roles.read(spark, sf, "documents")
    cid = X.doc_id(F.lit("docs/release.pdf"), F.col("text"))
    batch = X.drop_empty_text(d).select(cid.alias("content_id"), "doc_id")
    labelled = roles.read(spark, sf, "labels").select("doc_id")
    existing = batch.join(labelled, "doc_id", "left_semi")
    return index_upsert(batch, existing, id_col="content_id", order_col="doc_id")


QUERIES = {
    "json_props": q_json_props,
    "validate_prefs": q_validate_prefs,
    "latest_per_session": q_latest_per_session,
    "known_sessions": q_known_sessions,
    "unknown_sessions": q_unknown_sessions,
    "session_lookup": q_session_lookup,
    "match_ready": q_match_ready,
    "stored_name": q_stored_name,
    "parse_evaluation": q_parse_evaluation,
    "run_counts": q_run_counts,
    "run_report": q_run_report,
    "concat_pages": q_concat_pages,
    "ordered_distinct": q_ordered_distinct,
    "csv_list": q_csv_list,
    "next_turn": q_next_turn,
    "index_upsert": q_index_upsert,
}


# --------------------------------------------------------------- DuckDB side

_STEP = ("CASE event_type " + " ".join(f"WHEN {sq(k)} THEN {sq(v)}" for k, v in roles.EVENT_STEPS.items())
         + " END")
SESSIONS_CTE = f"""
ev AS (SELECT user_id AS session_id, event_id, ts, {_STEP} AS step, props AS payload FROM events),
rk AS (SELECT *, row_number() OVER (PARTITION BY session_id, step ORDER BY ts DESC, event_id DESC) AS rn FROM ev),
sessions AS (
  SELECT session_id,
  {', '.join(f"max(CASE WHEN step = {sq(s)} AND rn = 1 THEN payload END) AS {s}" for s in SE.STEPS)}
  FROM rk GROUP BY session_id),
requests AS (SELECT c_custkey AS session_id, c_name FROM customer)"""

MODEL_CTE = """model AS (
  SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN '!' || props ELSE props END AS raw
  FROM events)"""


def _safe_name(e):
    t = rx(f"trim({e})", X.WS + "+", "_")
    t = rx(t, r"[^A-Za-z0-9_.-]")
    return rx(t, r"^[._]+|[._]+$")


ORACLE = {
    "json_props": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events",
    "validate_prefs": f"""
WITH {SESSIONS_CTE.strip()}, {MODEL_CTE}
SELECT m.event_id,
  CASE WHEN NOT COALESCE(s.created IS NOT NULL, false) THEN {sq(SE.MSG_BAD_SESSION)}
       WHEN m.raw IS NOT NULL AND NOT json_valid(m.raw) THEN {sq(SE.MSG_BAD_JSON)}
       WHEN json_type(m.raw, '$.k') IS NULL THEN 'Missing required field: k'
       WHEN json_type(m.raw, '$.k') <> 'ARRAY' THEN 'k must be an array' END AS error
FROM model m LEFT JOIN sessions s ON m.user_id = s.session_id""",
    "latest_per_session": f"WITH {SESSIONS_CTE.strip()} SELECT * FROM sessions",
    "known_sessions": f"""WITH {SESSIONS_CTE.strip()}
SELECT * FROM requests r WHERE EXISTS (SELECT 1 FROM sessions s WHERE s.session_id = r.session_id)""",
    "unknown_sessions": f"""WITH {SESSIONS_CTE.strip()}
SELECT * FROM requests r WHERE NOT EXISTS (SELECT 1 FROM sessions s WHERE s.session_id = r.session_id)""",
    "session_lookup": f"""WITH {SESSIONS_CTE.strip()}
SELECT r.session_id, s.resume,
       CASE WHEN s.session_id IS NULL THEN {sq(SE.MSG_BAD_SESSION)} END AS error
FROM requests r LEFT JOIN sessions s ON r.session_id = s.session_id""",
    "match_ready": f"""WITH {SESSIONS_CTE.strip()}
SELECT r.session_id,
  CASE WHEN s.session_id IS NULL THEN {sq(SE.MSG_BAD_SESSION)}
       WHEN COALESCE(s.resume, '') = '' THEN {sq(SE.MSG_NO_RESUME)}
       WHEN s.preferences IS NULL THEN {sq(SE.MSG_NO_PREFERENCES)}
       ELSE 'ready' END AS status
FROM requests r LEFT JOIN sessions s ON r.session_id = s.session_id""",
    "stored_name": f"""SELECT event_id,
  strftime(ts, '%Y%m%d_%H%M%S') || '_' || {_safe_name("'resume ' || CAST(user_id AS VARCHAR) || '.pdf'")} AS stored_name
FROM events""",
    "parse_evaluation": f"""WITH {MODEL_CTE}
SELECT event_id,
  CASE WHEN json_valid(raw) THEN json_extract_string(raw, '$.company_name') END AS company_name,
  CASE WHEN json_valid(raw) THEN TRY_CAST(json_extract(raw, '$.final_score') AS DOUBLE) END AS final_score,
  CASE WHEN NOT json_valid(raw) THEN {sq(OU.MSG_BAD_EVALUATION)} END AS error,
  CASE WHEN NOT json_valid(raw) THEN raw END AS raw_response
FROM model""",
    "run_counts": f"""
SELECT source, count(*) AS found,
  CAST(sum(CASE WHEN length({rx('text', '^' + X.WS + '+|' + X.WS + '+$')}) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS processed,
  CAST(sum(CASE WHEN length({rx('text', '^' + X.WS + '+|' + X.WS + '+$')}) > 0 THEN 0 ELSE 1 END) AS BIGINT) AS failed
FROM documents GROUP BY source""",
    "run_report": f"""
SELECT count(*) AS processed_documents, min(doc_id) AS first_id, max(doc_id) AS last_id,
       {sq(REPORT_CLOCK)} AS timestamp
FROM documents WHERE text IS NOT NULL AND text <> ''""",
    "concat_pages": "SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id",
    "ordered_distinct": """
SELECT conv_id, string_agg(role, ',' ORDER BY p, role) AS roles
FROM (SELECT conv_id, role, min(turn) AS p FROM conversations GROUP BY conv_id, role) GROUP BY conv_id""",
    "csv_list": """
SELECT conv_id,
  COALESCE(string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS assistant_turns
FROM conversations GROUP BY conv_id""",
    "next_turn": """
SELECT conv_id, turn, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text FROM conversations""",
    "index_upsert": """
WITH batch AS (
  SELECT 'release_' || substr(md5(text), 1, 8) AS content_id, doc_id
  FROM documents WHERE text IS NOT NULL AND text <> ''),
existing AS (SELECT * FROM batch WHERE doc_id IN (SELECT doc_id FROM labels)),
fresh AS (SELECT content_id, min(doc_id) AS doc_id FROM batch GROUP BY content_id)
SELECT * FROM fresh WHERE content_id NOT IN (SELECT content_id FROM existing)""",
}
