"""Sessions as event tables: fold, validate, gate and look up.

The reference keeps one mutable in-memory dict per session (last write
wins).  Here a session is the fold of its events: per (session, step) the
payload with the greatest (ts, event_id) wins.  The fold is an aggregate with
map-side partial aggregation, so a session holding a third of all events
costs one partial row per task, not one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: messages of the reference API ----------------------------
MSG_BAD_SESSION = "Invalid or missing session ID"
MSG_NO_RESUME = "No resume found. Please upload a resume first."
MSG_NO_PREFERENCES = "No preferences found. Please set preferences first."
MSG_MISSING_FIELD = "Missing required field: {}"
MSG_NOT_ARRAY = "{} must be an array"
MSG_BAD_JSON = "Request body is not valid JSON"
MSG_OUTREACH_PARAMS = "Missing required parameters: session_id and company_name"
MSG_NO_COMPANY = "Company not found in matches"
MSG_NO_FILE = "No resume file uploaded"
MSG_NO_NAME = "No selected file"
MSG_BAD_TYPE = "Invalid file type"
PREFERENCE_FIELDS = ["desired_roles", "industries", "work_locations", "company_stages"]
STEPS = ["created", "resume", "preferences", "matches", "bad_request"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def latest_per_session(events: DataFrame, *, session_col: str = "session_id", step_col: str = "step",
                       payload_col: str = "payload", ts_col: str = "ts", tie_col: str = "event_id",
                       steps=STEPS) -> DataFrame:
    """One row per session, one column per step holding the latest payload.

    Written as conditional ``max_by`` per step (rows of other steps have a
    null ordering and are skipped), so the same expression runs in batch and
    in a streaming aggregation, where ``pivot`` is not available."""
    order = F.struct(_c(ts_col), _c(tie_col))
    aggs = [F.max_by(F.when(_c(step_col) == s, _c(payload_col)),
                     F.when(_c(step_col) == s, order)).alias(s) for s in steps]
    return events.groupBy(session_col).agg(*aggs)


def known_sessions(requests: DataFrame, sessions: DataFrame, on: str = "session_id") -> DataFrame:
    return requests.join(sessions.select(on), on, "left_semi")


def unknown_sessions(requests: DataFrame, sessions: DataFrame, on: str = "session_id") -> DataFrame:
    return requests.join(sessions.select(on), on, "left_anti")


def get_session(requests: DataFrame, sessions: DataFrame, on: str = "session_id") -> DataFrame:
    """Session row for each request, or the reference's error message."""
    s = sessions.withColumn("_known", F.lit(True))
    out = requests.join(s, on, "left")
    return (out.withColumn("error", F.when(F.col("_known").isNull(), F.lit(MSG_BAD_SESSION)))
            .drop("_known"))


def match_ready(requests: DataFrame, sessions: DataFrame, *, on: str = "session_id",
                created_col: str = "created", resume_col: str = "resume",
                preferences_col: str = "preferences") -> DataFrame:
    """Gate with the reference's precedence: unknown session, then missing
    résumé (null or ''), then missing preferences; ``status`` is 'ready'
    or the error message."""
    s = sessions.select(on, F.lit(True).alias("_known"), F.col(resume_col).alias("_resume"),
                        F.col(preferences_col).alias("_prefs"))
    if created_col not in sessions.columns:
        raise ValueError(f"sessions need a {created_col!r} column")
    j = requests.join(s, on, "left")
    status = (F.when(F.col("_known").isNull(), F.lit(MSG_BAD_SESSION))
              .when(F.coalesce(F.col("_resume"), F.lit("")) == "", F.lit(MSG_NO_RESUME))
              .when(F.col("_prefs").isNull(), F.lit(MSG_NO_PREFERENCES))
              .otherwise(F.lit("ready")))
    return j.withColumn("status", status).drop("_known", "_resume", "_prefs")


def validate_preferences(df: DataFrame, body_col: str, fields=PREFERENCE_FIELDS,
                         known_col: str | None = None) -> Column:
    """First error of a preferences body, or null when valid.

    Order: unknown session, body not JSON, then per field in order: missing,
    not an array.  Uses the VARIANT type, so a JSON null is present but not
    an array, and an empty list is a valid array."""
    body = F.col(body_col)
    v = F.try_parse_json(body)
    checks = []
    if known_col is not None:
        checks.append((~F.coalesce(F.col(known_col), F.lit(False)), F.lit(MSG_BAD_SESSION)))
    checks.append((body.isNotNull() & v.isNull(), F.lit(MSG_BAD_JSON)))
    for f in fields:
        item = F.try_variant_get(v, f"$.{f}", "variant")
        checks.append((item.isNull(), F.lit(MSG_MISSING_FIELD.format(f))))
        checks.append((~F.coalesce(F.schema_of_variant(item).startswith("ARRAY"), F.lit(False)),
                       F.lit(MSG_NOT_ARRAY.format(f))))
    out = None
    for cond, msg in checks:
        out = F.when(cond, msg) if out is None else out.when(cond, msg)
    return out


def project_preferences(df: DataFrame, body_col: str, fields=PREFERENCE_FIELDS) -> DataFrame:
    """Keep the known preference fields (arrays of strings), drop others."""
    schema = ", ".join(f"{f} array<string>" for f in fields)
    return df.withColumn("preferences", F.from_json(F.col(body_col), schema))


def parse_request_json(col, schema: str) -> Column:
    """Typed struct from a JSON body (null fields where absent or invalid)."""
    return F.from_json(_c(col), schema, {"mode": "PERMISSIVE"})


def validate_outreach(session_col, company_col) -> Column:
    return F.when((F.coalesce(_c(session_col), F.lit("")) == "") |
                  (F.coalesce(_c(company_col), F.lit("")) == ""), F.lit(MSG_OUTREACH_PARAMS))


def validate_upload(has_file, filename, extensions=None) -> Column:
    """First upload error: no file part, empty name, then a type outside
    the allowed extensions; null when the upload is acceptable."""
    from scoutline.functions.text import ALLOWED_EXTENSIONS, allowed_file
    exts = extensions or ALLOWED_EXTENSIONS
    name = _c(filename)
    return (F.when(~F.coalesce(_c(has_file), F.lit(False)), F.lit(MSG_NO_FILE))
            .when(F.coalesce(name, F.lit("")) == "", F.lit(MSG_NO_NAME))
            .when(~allowed_file(name, exts), F.lit(MSG_BAD_TYPE)))
