"""Session fold, validation messages, gate, evaluation parsing, contacts,
stream = batch."""

import json

import pandas as pd
from pyspark.sql import functions as F

from scoutline.operators import outreach as OU
from scoutline.operators import sessions as SE
from scoutline.plans import roles
from scoutline.streaming.sessions_stream import (compact_sessions, read_sessions, session_state, stream_sessions,
                                                 upsert_sessions)

from conftest import SF_MID


def test_latest_per_session_equals_pandas(spark):
    ev = roles.session_events(spark, SF_MID)
    got = {r["session_id"]: r.asDict() for r in SE.latest_per_session(ev).collect()}
    pdf = ev.toPandas().sort_values(["ts", "event_id"])
    last = pdf.groupby(["session_id", "step"]).tail(1)
    for _, row in last.iterrows():
        assert got[row["session_id"]][row["step"]] == row["payload"]
    assert len(got) == pdf["session_id"].nunique()


def prefs_df(spark, rows):
    return spark.createDataFrame(rows, "sid string, known boolean, body string")


def test_validate_preferences_messages(spark):
    ok = {"desired_roles": [], "industries": [], "work_locations": [], "company_stages": []}
    missing = {k: v for k, v in ok.items() if k != "industries"}
    wrong = dict(ok, industries="x")
    rows = [("a", True, json.dumps(missing)), ("b", True, json.dumps(wrong)),
            ("c", True, json.dumps(ok)), ("d", False, json.dumps(ok)), ("e", True, "{bad")]
    df = prefs_df(spark, rows)
    got = {r["sid"]: r["e"] for r in df.select("sid", SE.validate_preferences(df, "body", known_col="known")
                                               .alias("e")).collect()}
    assert got == {"a": "Missing required field: industries", "b": "industries must be an array",
                   "c": None, "d": "Invalid or missing session ID", "e": SE.MSG_BAD_JSON}


def test_match_gate_precedence(spark):
    sessions = spark.createDataFrame([(1, "{}", "", None), (2, "{}", "cv", None), (3, "{}", "cv", "{}")],
                                     "session_id long, created string, resume string, preferences string")
    req = spark.createDataFrame([(1,), (2,), (3,), (4,)], "session_id long")
    got = {r[0]: r[1] for r in SE.match_ready(req, sessions).select("session_id", "status").collect()}
    assert got == {1: SE.MSG_NO_RESUME, 2: SE.MSG_NO_PREFERENCES, 3: "ready", 4: SE.MSG_BAD_SESSION}


def test_parse_evaluation_quarantine(spark):
    good = json.dumps({"company_name": "Acme", "company_description": "d", "industry_score": 1.0,
                       "technical_score": 0.7, "experience_score": 1.0, "growth_score": 0.5,
                       "final_score": 0.85, "reasoning": "r"})
    df = spark.createDataFrame([(1, good), (2, "not json")], "id int, raw string")
    ok, bad = OU.split_quarantine(OU.parse_evaluation(df, "raw"))
    o, b = ok.collect(), bad.collect()
    assert [(r["id"], r["company_name"], r["final_score"]) for r in o] == [(1, "Acme", 0.85)]
    assert [(r["id"], r["error"], r["raw_response"]) for r in b] == [(2, OU.MSG_BAD_EVALUATION, "not json")]
    assert b[0]["final_score"] is None


def test_fallback_and_parsed_contacts(spark):
    df = spark.createDataFrame([("Acme Labs", None), (None, '[{"name":"A","role":"B","email":"a@x.com"}]')],
                               "n string, raw string")
    rows = df.select(OU.parse_contacts("raw", "n").alias("c")).collect()
    assert [c["email"] for c in rows[0]["c"]] == ["jsmith@acmelabs.com", "sjohnson@acmelabs.com"]
    assert [c["name"] for c in rows[1]["c"]] == ["A"]


def test_role_preference_and_lookup(spark):
    df = spark.createDataFrame([([],), (["Lead", "Dev"],), (None,)], "r array<string>")
    assert [x[0] for x in df.select(OU.role_preference("r")).collect()] == ["", "Lead", ""]
    matches = spark.createDataFrame([(1, "Acme", 2, "x"), (1, "Acme", 1, "y"), (1, "Beta", 3, "z")],
                                    "cand_id long, company_name string, rank int, company_description string")
    req = spark.createDataFrame([(1, "Acme"), (1, "Gone")], "cand_id long, company_name string")
    got = {r["company_name"]: (r["rank"], r["company_description"], r["error"])
           for r in OU.lookup_company(req, matches).collect()}
    assert got == {"Acme": (1, "y", None), "Gone": (None, None, "Company not found in matches")}


def test_validate_outreach(spark):
    df = spark.createDataFrame([("s", "c"), ("", "c"), ("s", None)], "s string, c string")
    got = [r[0] for r in df.select(SE.validate_outreach("s", "c")).collect()]
    assert got == [None, SE.MSG_OUTREACH_PARAMS, SE.MSG_OUTREACH_PARAMS]


def test_stream_sessions_equals_batch(spark, tmp_path):
    src = tmp_path / "events"
    ev = roles.session_events(spark, SF_MID)
    # Three arrival batches of the same events.
    ev.withColumn("_b", F.col("event_id") % 3).write.partitionBy("_b").parquet(str(src))
    schema = spark.read.parquet(str(src)).drop("_b").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2) \
        .option("recursiveFileLookup", "true").parquet(str(src))
    q = stream_sessions(stream, str(tmp_path / "table"), str(tmp_path / "ckpt"))
    q.awaitTermination()
    got = sorted(tuple(r) for r in read_sessions(spark, str(tmp_path / "table")).collect())
    want = sorted(tuple(r) for r in SE.latest_per_session(ev).select(*read_sessions(
        spark, str(tmp_path / "table")).columns).collect())
    assert got == want


def test_validate_upload(spark):
    df = spark.createDataFrame([(False, None), (True, ""), (True, "cv.txt"), (True, "cv.PDF")],
                               "has boolean, name string")
    got = [r[0] for r in df.select(SE.validate_upload("has", "name")).collect()]
    assert got == [SE.MSG_NO_FILE, SE.MSG_NO_NAME, SE.MSG_BAD_TYPE, None]


def test_project_preferences_keeps_known_fields(spark):
    body = json.dumps({"desired_roles": ["Dev"], "industries": ["AI/ML"], "work_locations": [],
                       "company_stages": ["Seed"], "extra": 1})
    df = SE.project_preferences(spark.createDataFrame([(body,)], "b string"), "b")
    p = df.first()["preferences"].asDict()
    assert p == {"desired_roles": ["Dev"], "industries": ["AI/ML"], "work_locations": [],
                 "company_stages": ["Seed"]}


def test_company_info_null_industry(spark):
    from pyspark.sql import Row
    df = spark.createDataFrame([Row(m=Row(company_name="Acme", company_description="d",
                                          metadata=Row(industry=None, staff=3)))],
                               "m struct<company_name:string,company_description:string,"
                               "metadata:struct<industry:string,staff:int>>")
    info = df.select(OU.company_info("m").alias("i")).first()["i"]
    assert (info["company_name"], info["industry"]) == ("Acme", None)
    # The letter falls back to 'Technology' only when the industry is null.
    letter = df.select(OU.cover_letter(F.lit("cv"), F.lit("Acme"), F.lit("d"), F.col("m.metadata.industry"),
                                       F.lit("Dev"))).first()[0]
    assert letter.startswith("Dear Hiring Manager,") and "work in Technology." in letter


def test_compaction_keeps_the_newest_rows(spark, tmp_path):
    out, events = str(tmp_path / "s"), roles.session_events(spark, SF_MID)
    for epoch, part in enumerate((events.where("event_id % 3 = 0"), events.where("session_id % 2 = 0"), events)):
        upsert_sessions(session_state(part), out, epoch)
    want = sorted(map(str, read_sessions(spark, out).collect()))
    assert compact_sessions(spark, out) == 2
    assert sorted(p.name for p in (tmp_path / "s").iterdir()) == ["_version=2"]
    assert sorted(map(str, read_sessions(spark, out).collect())) == want
    # A call broken off after writing the merged rows, with the newest version gone.
    (tmp_path / "s" / "_version=2").rename(tmp_path / "s" / ".merged=2")
    assert compact_sessions(spark, out) == 2
    assert sorted(map(str, read_sessions(spark, out).collect())) == want


def test_replay_after_compaction_loses_no_session(spark, tmp_path):
    out, events = str(tmp_path / "s"), roles.session_events(spark, SF_MID)
    parts = [events.where("event_id % 3 = 0"), events, events.where("session_id % 5 = 0"), events.where("session_id % 7 = 0"),
             events.where("session_id % 11 = 0")]
    want = sorted(map(str, SE.latest_per_session(events).collect()))
    read = lambda: sorted(map(str, read_sessions(spark, out).select(SE.latest_per_session(events).columns).collect()))
    for epoch, part in enumerate(parts):
        upsert_sessions(session_state(part), out, epoch)
        if epoch > 1:                    # each time with the snapshot of the call before
            assert compact_sessions(spark, out) == epoch
            assert read() == want
            upsert_sessions(session_state(part), out, epoch)
            assert read() == want and compact_sessions(spark, out) == epoch
    assert [p.name for p in (tmp_path / "s").iterdir()] == ["_version=4"]
    assert len(list((tmp_path / "s.merged").glob("*/*"))) == 1


def test_broken_compaction_changes_no_result(spark, tmp_path):
    import shutil
    out, events = tmp_path / "s", roles.session_events(spark, SF_MID)
    for epoch, part in enumerate((events.where("event_id % 3 = 0"), events, events.where("session_id % 5 = 0"))):
        upsert_sessions(session_state(part), str(out), epoch)
    want = sorted(map(str, read_sessions(spark, str(out)).collect()))
    shutil.copytree(out, tmp_path / "copy")
    compact_sessions(spark, str(out))
    for v in (0, 1):                     # broken off before the merged versions were deleted ...
        shutil.copytree(tmp_path / "copy" / f"_version={v}", out / f"_version={v}")
    assert sorted(map(str, read_sessions(spark, str(out)).collect())) == want
    for f in (tmp_path / "s.merged").rglob("*.parquet"):
        f.unlink()                       # ... or while the snapshot was written
    assert sorted(map(str, read_sessions(spark, str(out)).collect())) == want
    assert compact_sessions(spark, str(out)) == 2
    assert sorted(map(str, read_sessions(spark, str(out)).collect())) == want
