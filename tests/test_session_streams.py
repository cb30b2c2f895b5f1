"""Session state with expiry, readiness transitions and run accounting of the
indexing stream."""

import os
import shutil

from pyspark.sql import functions as F

from scoutline.operators.sessions import latest_per_session
from scoutline.streaming import index_stream as X
from scoutline.streaming import sessions_stream as S

EVENT = "session_id string, event_id bigint, ts timestamp, step string, payload string"


def folder(spark, tmp_path, batches):
    """A folder whose files are read one per micro-batch, in order."""
    out = str(tmp_path / "in")
    os.makedirs(out)
    for i, rows in enumerate(batches):
        part = str(tmp_path / f"part{i}")
        spark.createDataFrame(rows, "session_id string, event_id bigint, ts string, step string, payload string").select(
            "session_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "step", "payload").coalesce(1).write.parquet(part)
        (name,) = [f for f in os.listdir(part) if f.endswith(".parquet")]
        shutil.copy(f"{part}/{name}", f"{out}/{i}.parquet")
        os.utime(f"{out}/{i}.parquet", (1_700_000_000 + 60 * i,) * 2)
    return out


def stream(spark, path):
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(path)


def done(q):
    q.awaitTermination()
    return [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]


BATCHES = [
    [("a", 1, "2024-01-01 10:00:00", "created", "c"), ("a", 2, "2024-01-01 10:05:00", "resume", "r1"),
     ("b", 3, "2024-01-01 11:00:00", "created", None), ("c", 4, None, "resume", "x")],
    [("a", 5, "2024-01-01 10:04:00", "resume", "late"), ("b", 6, "2024-01-02 09:00:00", "preferences", "p"),
     ("b", 7, "2024-01-02 09:00:00", "preferences", "p2")],
    [("z", 8, "2024-03-01 00:00:00", "created", "c")],
    [("z", 9, "2024-03-01 00:01:00", "resume", "r"), ("a", 10, "2024-03-01 00:02:00", "created", "again")],
]


def test_state_falls_after_expiry(spark, tmp_path):
    src = folder(spark, tmp_path, BATCHES)
    day = 86_400_000
    q = S.stream_sessions(stream(spark, src), f"{tmp_path}/table", f"{tmp_path}/check", watermark="90 days", expire_after_ms=day)
    rows = done(q)
    assert rows[-1] == 3                # only the session without a time went: nothing expires behind this watermark
    q = S.stream_sessions(stream(spark, src), f"{tmp_path}/short", f"{tmp_path}/check2", watermark="1 hour", expire_after_ms=day)
    rows = done(q)
    assert max(rows) >= 3 and rows[-1] <= 2 and rows[-1] < max(rows), rows
    again = {r.session_id: r for r in S.read_sessions(spark, f"{tmp_path}/short").collect()}["a"]
    assert (again.created, again.resume) == ("again", None)  # a new session: the old one had expired


def test_without_expiry_the_fold_equals_the_batch(spark, tmp_path):
    src = folder(spark, tmp_path, BATCHES)
    want = sorted(map(tuple, latest_per_session(spark.read.schema(EVENT).parquet(src)).collect()), key=str)
    q = S.stream_sessions(stream(spark, src), f"{tmp_path}/a", f"{tmp_path}/ca")
    done(q)
    assert sorted(map(tuple, S.read_sessions(spark, f"{tmp_path}/a").collect()), key=str) == want
    q = S.stream_sessions(stream(spark, src), f"{tmp_path}/b", f"{tmp_path}/cb", watermark="90 days", expire_after_ms=10**12)
    done(q)
    assert sorted(map(tuple, S.read_sessions(spark, f"{tmp_path}/b").collect()), key=str) == want


def ready_rows(spark, src, tmp_path, name, **kw):
    out = []
    q = (S.ready_sessions(stream(spark, src), **kw).writeStream
         .foreachBatch(lambda b, e: out.append((e, sorted(tuple(r) for r in b.select(
             "session_id", "ready_event", "resume", "preferences").collect()))))
         .option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start())
    rows = done(q)
    return [r for _, rs in sorted(out) for r in rs], rows


def test_sessions_become_ready_once(spark, tmp_path):
    batches = [
        [("a", 1, "2024-01-01 10:00:00", "resume", "r"), ("b", 2, "2024-01-01 10:00:00", "preferences", "p"),
         ("d", 3, "2024-01-01 10:00:00", "resume", ""), ("d", 4, "2024-01-01 10:01:00", "preferences", "p"),
         ("e", 6, "2024-01-01 10:02:00", "preferences", "p"), ("e", 5, "2024-01-01 10:01:00", "resume", "r")],
        [("a", 7, "2024-01-01 11:00:00", "preferences", "p7"), ("b", 8, "2024-01-01 11:00:00", "preferences", None),
         ("e", 9, "2024-01-01 11:00:00", "resume", "r9")],
        [("b", 10, "2024-01-01 12:00:00", "resume", "r10"), ("a", 11, "2024-01-01 12:00:00", "preferences", "p11"),
         ("d", 12, "2024-01-01 12:00:00", "resume", "r12")],
        [("b", 13, "2024-01-01 13:00:00", "preferences", "p13")],
    ]
    src = folder(spark, tmp_path, batches)
    want = [("e", 6, "r", "p"), ("a", 7, "r", "p7"), ("d", 12, "r12", "p"), ("b", 13, "r10", "p13")]
    assert ready_rows(spark, src, tmp_path, "c1")[0] == want
    assert ready_rows(spark, src, tmp_path, "c1")[0] == []          # nothing new: a restart adds nothing
    got, states = ready_rows(spark, src, tmp_path, "c2", watermark="1 minute", expire_after_ms=60_000)
    assert states[-1] < max(states) and ("e", 6, "r", "p") in got


def test_runs_count_failures_by_reason_and_replays_change_nothing(spark, tmp_path):
    files = [("a.txt", b"We raised $5 million."), ("b.txt", b"\xff\xfe bad"), ("c.pdf", b"%PDF"), ("d.txt", None),
             ("e.txt", b""), ("f.html", b"<p>Acme ships robots.</p>")]
    batch = spark.createDataFrame(files, "path string, content binary")
    out, runs = f"{tmp_path}/index", f"{tmp_path}/runs"
    assert X.index_batch(batch, out, runs=runs, epoch=0) == 2
    want = {"not UTF-8": 1, "unsupported type": 1, "no content": 1, "no text": 1}

    def table():
        return sorted((r._epoch, r.found, r.processed, r.failed, sorted(r.reasons.items())) for r in X.read_runs(spark, runs).collect())

    assert table() == [(0, 6, 2, 4, sorted(want.items()))]
    assert X.index_batch(batch, out, runs=runs, epoch=0) == 0         # a replay: stored ids stay, the run is the same
    assert table() == [(0, 6, 2, 4, sorted(want.items()))]

    def embedder(texts):
        if any("robots" in t for t in texts):
            raise ValueError("no vector")
        return [[1.0, 0.0]] * len(texts)

    def broken(content):
        raise ValueError("not a document")

    assert X.index_batch(batch, f"{tmp_path}/other", runs=runs, epoch=1, extractor=broken) == 0
    assert table()[1] == (1, 6, 0, 6, [("extractor failed", 5), ("no content", 1)])
    texts = spark.createDataFrame([("a", "text one"), ("b", ""), ("c", None)], "path string, raw_text string")
    assert X.index_texts(texts, f"{tmp_path}/texts", runs=runs, epoch=2) == 1
    assert table()[2] == (2, 3, 1, 2, [("no text", 2)])
