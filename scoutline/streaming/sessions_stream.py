"""Session state from an event stream, and matching of sessions as they
become ready.

The fold is the same aggregate as the batch ``latest_per_session`` (a
streaming aggregation in update mode keeps one state row per session).  The
reference never expires sessions, and by default neither does this state: ``watermark`` only
drops events that come later than it allows.  With ``expire_after`` the fold runs as a custom
state with event-time timeouts: a session without events for that long leaves the state."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from scoutline.operators.matching import match_candidates
from scoutline.operators.sessions import STEPS, latest_per_session
from scoutline.session import cut_lineage, ship_package


def session_state(events: DataFrame, watermark: str | None = None, ts_col: str = "ts") -> DataFrame:
    if watermark:
        events = events.withWatermark(ts_col, watermark)
    return latest_per_session(events)


NO_TIME = -(1 << 62)


def _timed(events: DataFrame, columns: list[str], ts_col: str, watermark: str | None) -> DataFrame:
    """``columns`` with the event time as ``_at`` (microseconds; null times come first)."""
    moment = F.col(ts_col).cast("timestamp")               # watermarks need one with a time zone
    out = events.select(*columns, moment.alias("_time"), F.coalesce(F.unix_micros(moment), F.lit(NO_TIME)).alias("_at"))
    return out.withWatermark("_time", watermark) if watermark else out.drop("_time")


def _ordered(batches, tie_col: str) -> pd.DataFrame:
    """The events of one session in one micro-batch, by time."""
    return pd.concat(list(batches), ignore_index=True).sort_values(["_at", tie_col], kind="stable")


def _keep_until(state, last_us: int, keep_ms: int) -> None:
    """Time out ``keep_ms`` after the last event, or as soon as the watermark allows."""
    state.setTimeoutTimestamp(max(last_us // 1000 + keep_ms, state.getCurrentWatermarkMs() + 1))


def expiring_session_state(events: DataFrame, watermark: str, expire_after_ms: int, *, session_col: str = "session_id",
                           step_col: str = "step", payload_col: str = "payload", ts_col: str = "ts",
                           tie_col: str = "event_id", steps=STEPS) -> DataFrame:
    """The rows of ``latest_per_session`` for the sessions with new events.  The state of a session (time,
    tie and payload of the latest event per step) is dropped once the watermark is
    ``expire_after_ms`` past its last event (at once if none has a time); events after that begin a new
    session."""
    kinds = dict(events.dtypes)
    steps = list(steps)
    ship_package(events.sparkSession)

    def fold(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        new = _ordered(batches, tie_col)
        at, tie, payload, last = [None] * len(steps), [None] * len(steps), [None] * len(steps), NO_TIME
        # A session with new events is handed over before it times out, however old it is.
        if state.exists and state.get[3] // 1000 + expire_after_ms > state.getCurrentWatermarkMs():
            at, tie, payload, last = *(list(x) for x in state.get[:3]), state.get[3]
        for i, step in enumerate(steps):
            own = new[new[step_col] == step]
            if len(own):
                e = own.iloc[-1]
                if at[i] is None or (e["_at"], e[tie_col]) >= (at[i], tie[i]):
                    at[i], tie[i] = int(e["_at"]), int(e[tie_col])
                    payload[i] = None if pd.isna(e[payload_col]) else e[payload_col]
        last = max(last, int(new["_at"].iloc[-1]))
        state.update((at, tie, payload, last))
        _keep_until(state, last, expire_after_ms)
        yield pd.DataFrame({session_col: [key[0]], **{s: [p] for s, p in zip(steps, payload)}}, dtype=object)

    out = f"`{session_col}` {kinds[session_col]}, " + ", ".join(f"`{s}` {kinds[payload_col]}" for s in steps)
    kept = f"at array<bigint>, tie array<bigint>, payload array<{kinds[payload_col]}>, last bigint"
    return (_timed(events, [session_col, step_col, payload_col, tie_col], ts_col, watermark)
            .groupBy(session_col).applyInPandasWithState(fold, out, kept, "update", GroupStateTimeout.EventTimeTimeout))


def ready_sessions(events: DataFrame, *, session_col: str = "session_id", step_col: str = "step",
                   payload_col: str = "payload", ts_col: str = "ts", tie_col: str = "event_id",
                   resume_step: str = "resume", preferences_step: str = "preferences",
                   watermark: str | None = None, expire_after_ms: int | None = None) -> DataFrame:
    """Sessions at the event that makes them ready, each once: a stored résumé that is not empty
    and stored preferences, in either order (the gate of ``match_ready``).  Columns: ``session_col``,
    ``ready_ts``, ``ready_event``, ``resume``, ``preferences``.

    The state of a session is what it has so far, or that it was put out.  With ``watermark`` and
    ``expire_after_ms`` it is dropped that long after the session's last event."""
    kinds = dict(events.dtypes)
    ship_package(events.sparkSession)

    def step(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        resume, preferences, done, last = None, None, False, NO_TIME
        if state.exists and (expire_after_ms is None or state.get[3] // 1000 + expire_after_ms > state.getCurrentWatermarkMs()):
            resume, preferences, done, last = state.get
        new = _ordered(batches, tie_col)
        for e in () if done else new.to_dict("records"):
            value = None if pd.isna(e[payload_col]) else e[payload_col]
            if e[step_col] == resume_step:
                resume = value
            elif e[step_col] == preferences_step:
                preferences = value
            else:
                continue
            if resume and preferences is not None:
                yield pd.DataFrame({session_col: [key[0]], "ready_ts": [e[ts_col]], "ready_event": [e[tie_col]],
                                    "resume": [resume], "preferences": [preferences]})
                resume, preferences, done = None, None, True
                break
        last = max(last, int(new["_at"].iloc[-1]))
        state.update((resume, preferences, done, last))
        if expire_after_ms is not None:
            _keep_until(state, last, expire_after_ms)

    slim = _timed(events, list(dict.fromkeys([session_col, step_col, payload_col, ts_col, tie_col])), ts_col, watermark)
    out = (f"`{session_col}` {kinds[session_col]}, ready_ts {kinds[ts_col]}, ready_event {kinds[tie_col]}, "
           f"resume {kinds[payload_col]}, preferences {kinds[payload_col]}")
    kept = f"resume {kinds[payload_col]}, preferences {kinds[payload_col]}, done boolean, last bigint"
    timeout = GroupStateTimeout.EventTimeTimeout if expire_after_ms is not None else GroupStateTimeout.NoTimeout
    return slim.groupBy(session_col).applyInPandasWithState(step, out, kept, "append", timeout)


def upsert_sessions(batch: DataFrame, table_path: str, epoch: int) -> None:
    """Write a micro-batch of updated sessions as version ``epoch``; readers
    keep the latest version per key (``read_sessions``).  A replayed epoch
    overwrites its own version, so the sink is idempotent."""
    batch.write.mode("overwrite").parquet(f"{table_path}/_version={epoch}")


def _newest(t: DataFrame, key: str) -> DataFrame:
    cols = [c for c in t.columns if c not in (key, "_version")]
    return (t.groupBy(key).agg(F.max_by(F.struct(*cols), F.col("_version")).alias("_s"))
            .select(key, "_s.*"))


def _snapshots(table_path: str) -> str:
    """Where compaction puts merged versions: beside the table, where no epoch is
    written."""
    return f"{table_path.rstrip('/')}.merged"


def _with_snapshots(spark, table_path: str, versions: DataFrame) -> DataFrame:
    """``versions`` and the rows of the table's snapshots.  A row of a snapshot is its
    session's newest up to its ``_version``, so snapshots that overlap, or one that is
    not complete yet (what it holds is still there), change no result."""
    try:
        merged = spark.read.schema(versions.schema).parquet(_snapshots(table_path)).select(versions.columns)
        merged.schema                    # Spark Connect looks for the path only now
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return versions
    return versions.unionByName(merged)


def read_sessions(spark, table_path: str, key: str = "session_id") -> DataFrame:
    return _newest(_with_snapshots(spark, table_path, spark.read.parquet(table_path)), key)


def compact_sessions(spark, table_path: str, key: str = "session_id") -> int:
    """Merge all versions below the newest into a snapshot and delete them;
    returns the newest version (-1: the table has none).

    The newest version stays as it is: a restarted stream may replay that epoch
    and overwrite it, while earlier epochs are committed.  A snapshot is a Parquet
    folder of its own, which ``read_sessions`` reads with the versions.  What it
    holds is deleted after it is written, so a call may break off anywhere; the next
    one merges what is left.  Run one call at a time, and no reader while it deletes.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    root, own = path(table_path), path(_snapshots(table_path))
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(prefix):
        names = [f.getPath().getName() for f in fs.listStatus(root)]
        return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))

    for v in numbers(".merged="):        # earlier releases swapped hidden folders for versions
        if fs.exists(path(root, f"_version={v}")):
            fs.delete(path(root, f".merged={v}"), True)
        else:
            fs.rename(path(root, f".merged={v}"), path(root, f"_version={v}"))
    old = numbers("_version=")
    if len(old) > 1:
        before = [c.getPath() for v in fs.listStatus(own) for c in fs.listStatus(v.getPath())] if fs.exists(own) else []
        t = spark.read.option("basePath", table_path).parquet(*[f"{table_path}/_version={v}" for v in old[:-1]])
        merged = _newest(_with_snapshots(spark, table_path, t), key).select(*[c for c in t.columns if c != "_version"])
        merged.write.parquet(f"{_snapshots(table_path)}/_version={old[-2]}/call={uuid.uuid4().hex}")
        for p in [path(root, f"_version={v}") for v in old[:-1]] + before:
            fs.delete(p, True)
    return old[-1] if old else -1


def stream_sessions(events: DataFrame, table_path: str, checkpoint: str, *,
                    watermark: str | None = None, expire_after_ms: int | None = None, available_now: bool = True):
    """Fold a session-event stream into the session table at ``table_path``.  ``expire_after_ms`` (with a
    ``watermark``) drops sessions from the state, not from the table."""
    if expire_after_ms is None:
        state = session_state(events, watermark)
    else:
        state = expiring_session_state(events, watermark, expire_after_ms)
    w = (state.writeStream.outputMode("update")
         .foreachBatch(lambda b, e: upsert_sessions(b, table_path, e))
         .option("checkpointLocation", checkpoint))
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def stream_match(candidates: DataFrame, index: DataFrame, out_path: str, checkpoint: str, *,
                 num_matches: int = 3, min_score: float = 0.6, available_now: bool = True):
    """Match each micro-batch of new candidates against a static index, which is
    stored once when the stream starts; only the batch is stored per epoch."""
    index = cut_lineage(index)

    def body(batch: DataFrame, epoch: int):
        m = match_candidates(cut_lineage(batch), index, num_matches=num_matches, min_score=min_score,
                             materialize=False)
        m.write.mode("overwrite").parquet(f"{out_path}/_epoch={epoch}")

    w = (candidates.writeStream.foreachBatch(body)
         .option("checkpointLocation", checkpoint))
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def stream_ready_matches(events: DataFrame, candidates_of, index: DataFrame, out_path: str, checkpoint: str, *,
                         num_matches: int = 3, min_score: float = 0.6, available_now: bool = True, **ready):
    """Match every session once, when résumé and preferences are both there.  ``candidates_of`` turns
    the rows of :func:`ready_sessions` into candidates (the columns of ``match_candidates``); ``ready``
    are arguments of that function.  A replayed micro-batch overwrites its own matches."""
    index = cut_lineage(index)

    def body(batch: DataFrame, epoch: int):
        # Stored, as the state is stepped forward by every evaluation of the batch.
        candidates = cut_lineage(candidates_of(cut_lineage(batch)))
        m = match_candidates(candidates, index, num_matches=num_matches, min_score=min_score, materialize=False)
        m.write.mode("overwrite").parquet(f"{out_path}/_epoch={epoch}")

    w = ready_sessions(events, **ready).writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()
