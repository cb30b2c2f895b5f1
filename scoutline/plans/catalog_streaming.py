"""Registered streaming queries.  Each runs a Structured Streaming job to
completion (``availableNow``) into a table under the session's checkpoint
folder and returns the table; its rows must equal the batch operator's."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoutline.plans import roles
from scoutline.operators.matching import MATCH_COLUMNS
from scoutline.plans.catalog_matching import ORACLE as MATCHING_ORACLE
from scoutline.plans.catalog_matching import sql_embed
from scoutline.plans.catalog_service import page_files
from scoutline.plans.catalog_sessions import ORACLE as SESSION_ORACLE
from scoutline.plans.catalog_text import gazetteer, s_clean, s_html, s_words
from scoutline.session import cut_lineage, new_folder, table_path
from scoutline.sources.index import read_index
from scoutline.streaming.index_stream import read_runs, stream_index_files, stream_index_texts
from scoutline.streaming.sessions_stream import (compact_sessions, read_sessions, session_state, stream_match,
                                                 stream_ready_matches, stream_sessions, upsert_sessions)


def _base(spark, name):
    return new_folder(spark, name)


def q_stream_sessions(spark, sf):
    base = _base(spark, "stream_sessions")
    q = stream_sessions(_event_stream(spark, sf), f"{base}/table", f"{base}/checkpoint")
    q.awaitTermination()
    return read_sessions(spark, f"{base}/table")


def _table_stream(spark, sf, name, **options):
    """A table as a stream of its files.  The file source watches a folder: the table's, or, where the table
    is one file, the one around it, kept to that file by a glob."""
    path = table_path(sf, name)
    reader = spark.readStream.schema(spark.read.parquet(path).schema).options(**options)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _event_stream(spark, sf):
    """The events table as a stream of session events."""
    src = _table_stream(spark, sf, "events", maxFilesPerTrigger=1)
    steps = F.create_map(*[x for k, v in roles.EVENT_STEPS.items() for x in (F.lit(k), F.lit(v))])
    return src.select(F.col("user_id").alias("session_id"), "event_id", "ts",
                      F.try_element_at(steps, F.col("event_type")).alias("step"), F.col("props").alias("payload"))


def q_stream_sessions_expiring(spark, sf):
    """The session fold with a state that expires, after a time that no session reaches."""
    base = _base(spark, "stream_expiring")
    q = stream_sessions(_event_stream(spark, sf), f"{base}/table", f"{base}/checkpoint", watermark="1 hour",
                        expire_after_ms=20 * 365 * 86_400_000)
    q.awaitTermination()
    return read_sessions(spark, f"{base}/table")


def q_stream_ready(spark, sf):
    """Customers matched when the events of their session make them ready; run twice, the second
    time over the same events."""
    base, cands, companies = _base(spark, "stream_ready"), cut_lineage(roles.candidates(spark, sf)), roles.companies(spark, sf)

    def candidates_of(ready):
        return cands.join(ready.select(F.col("session_id").alias("cand_id"), "ready_event"), "cand_id")

    for _ in range(2):
        q = stream_ready_matches(_event_stream(spark, sf), candidates_of, companies, f"{base}/matches", f"{base}/checkpoint")
        q.awaitTermination()
    return spark.read.parquet(f"{base}/matches").select(*MATCH_COLUMNS)


def q_stream_index_runs(spark, sf):
    """Pages as files of four types, some with bad bytes, indexed as a stream: documents by outcome."""
    base = _base(spark, "stream_runs")
    pages = _table_stream(spark, sf, "pages")
    q = stream_index_files(page_files(pages), f"{base}/index", f"{base}/checkpoint", runs=f"{base}/runs")
    q.awaitTermination()
    runs = read_runs(spark, f"{base}/runs")
    rows = runs.select(F.explode(F.map_concat(F.create_map(F.lit("processed"), "processed"), "reasons"))
                       .alias("outcome", "documents"), "found")
    return rows.groupBy("outcome").agg(F.sum("documents").alias("documents"), F.sum("found").alias("found"))


def q_stream_match(spark, sf):
    """Candidates arriving as a stream of files, matched against the companies."""
    base = _base(spark, "stream_match")
    cands = roles.candidates(spark, sf)
    cands.write.parquet(f"{base}/candidates")
    src = spark.readStream.schema(cands.schema).parquet(f"{base}/candidates")
    q = stream_match(src, roles.companies(spark, sf), f"{base}/matches", f"{base}/checkpoint")
    q.awaitTermination()
    return spark.read.parquet(f"{base}/matches").select(*MATCH_COLUMNS)


def q_stream_index(spark, sf):
    """The documents table as a stream of texts, cleaned, embedded and indexed."""
    base = _base(spark, "stream_index")
    src = _table_stream(spark, sf, "documents")
    path = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    docs = src.select(path.alias("path"), F.col("text").alias("raw_text"))
    q = stream_index_texts(docs, f"{base}/index", f"{base}/checkpoint", gazetteer=gazetteer(spark, sf))
    q.awaitTermination()
    return read_index(spark, f"{base}/index").select("doc_id", "filename", "document", "embedding", "word_count")


def q_compact_sessions(spark, sf):
    """Events folded in two runs of unequal halves, merged into one version."""
    base = _base(spark, "compact_sessions")
    events = roles.session_events(spark, sf)
    for epoch, part in enumerate((events.where("event_id % 3 = 0"), events)):
        upsert_sessions(session_state(part), base, epoch)
    compact_sessions(spark, base)
    return read_sessions(spark, base)


QUERIES = {"stream_sessions": q_stream_sessions, "stream_sessions_expiring": q_stream_sessions_expiring,
           "stream_ready": q_stream_ready, "stream_index_runs": q_stream_index_runs, "stream_match": q_stream_match, "stream_index": q_stream_index,
           "compact_sessions": q_compact_sessions}
ORACLE = {
    "stream_sessions": SESSION_ORACLE["latest_per_session"],
    "stream_sessions_expiring": SESSION_ORACLE["latest_per_session"],
    "stream_ready": MATCHING_ORACLE["match_candidates"] + """
WHERE cand_id IN (SELECT user_id FROM events WHERE event_type = 'view' AND props <> '')
  AND cand_id IN (SELECT user_id FROM events WHERE event_type = 'click' AND props IS NOT NULL)""",
    "stream_index_runs": f"""
SELECT outcome, count(*) AS documents, CAST(sum(count(*)) OVER () AS BIGINT) AS found FROM (
  SELECT CASE WHEN html IS NULL THEN 'no content' WHEN page_id % 4 = 2 THEN 'unsupported type'
              WHEN page_id % 10 = 9 THEN 'not UTF-8'
              WHEN (CASE WHEN page_id % 4 = 1 THEN html ELSE {s_html('html')} END) = '' THEN 'no text'
              ELSE 'processed' END AS outcome FROM pages) GROUP BY outcome""",
    "compact_sessions": SESSION_ORACLE["latest_per_session"],
    "stream_match": MATCHING_ORACLE["match_candidates"],
    "stream_index": f"""
WITH c AS (SELECT doc_id || '_' || substr(md5(text), 1, 8) AS doc_id, CAST(doc_id AS VARCHAR) || '.pdf' AS filename,
                  {s_clean('text')} AS document FROM documents WHERE text IS NOT NULL AND text <> '')
SELECT doc_id, filename, document, {sql_embed('document')} AS embedding, {s_words('document')} AS word_count FROM c""",
}
