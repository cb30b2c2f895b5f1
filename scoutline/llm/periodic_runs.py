"""Periodic runs of words by an online sparse diagonal DP.

A run is a stretch of words with smallest period ``q`` and at least
``max(24, 3 * q)`` words that no neighbouring word extends.  Words equal to the word
``q`` before them form a diagonal with lag ``q``; a run is a diagonal of
``length - q`` matches.  The words of a text are gone over once:

* At a word, its earlier occurrences open lags or add to the match length of lags that
  are active.  A lag whose next pair of words differs ends there and, if it is long enough,
  its run is put out at once.
* Only occurrences that can belong to a run are looked at.  For lags in ``(w/2, w]``, with
  ``w`` = 8, 16, 32, ..., that is the last earlier place of the same ``w`` words: in a run
  with smallest period ``q <= w`` an equal window nearer than ``q`` would give the run a
  smaller period, and ``3 * q`` words (24 for short ones) hold two such windows or
  more ``q`` apart.  So a word has at most one candidate per power of two, however often it
  occurs, and a text of one repeated word costs as much as any other.  Windows are
  compared by 64-bit hashes (numpy, over a slice of texts); the DP compares the words
  themselves.
* A longer window repeats only where its halves do, so nearly all places leave after
  the first size.  Texts without a candidate never reach the word loop.

Each text is handled alone in one pass without a shuffle; memory follows the slice (6 MB)
or the one longer text.

Defined results: null and empty texts have no words and no runs; rows with null or repeated
ids are rows of their own; an empty table gives an empty result; columns named like
the results are replaced, other columns stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutline.llm import shared
from scoutline.llm.words import buffer, mix, owner, slices, words

LEAST_WORDS, LEAST_PERIODS = 24, 3
FIRST_WINDOW = 8
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def candidates(codes: np.ndarray, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, lags): where a window equals its last earlier occurrence in the text
    at a lag that fits the window's size, sorted by place."""
    places, lags = [], []
    hashes, w = mix(codes.astype(np.uint64) + np.uint64(1)), 1
    ends, doc = np.repeat(ranges[1:], np.diff(ranges)), owner(ranges)
    longest = (ends - ranges[doc]) // LEAST_PERIODS
    at = np.flatnonzero(ends - ranges[doc] >= LEAST_WORDS)
    while len(at):
        # Windows of twice the size; those over the end of the slice are never asked for.
        after = np.zeros_like(hashes)
        after[:-w] = hashes[w:]
        hashes, w = mix(hashes * np.uint64(0x9E3779B97F4A7C15) + after), 2 * w
        if w < FIRST_WINDOW:
            continue
        at = at[at + w <= ends[at]]
        key = mix(hashes[at] + doc[at].astype(np.uint64))
        order = np.argsort(key, kind="stable")                  # equal windows by place
        sorted_at, key = at[order], key[order]
        lag = np.diff(sorted_at)
        lag[key[1:] != key[:-1]] = np.iinfo(np.int64).max
        fits = (lag <= w) & ((lag > w // 2) | (w == FIRST_WINDOW))
        places.append(sorted_at[1:][fits])
        lags.append(lag[fits])
        near = np.zeros(len(at), bool)                           # may repeat in the next size
        repeats = lag <= longest[sorted_at[1:]]
        near[1:] |= repeats
        near[:-1] |= repeats
        at = np.sort(sorted_at[near])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, lag = np.concatenate(places), np.concatenate(lags)
    order = np.argsort(place, kind="stable")
    return place[order], lag[order]


def text_runs(word: list[int], opens: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of one text by start and period, given the sorted
    (place, lag) that may open a diagonal."""
    out, active, n = [], {}, len(word)           # active: lag -> match length

    def close(lag: int, end: int) -> None:
        length = active.pop(lag) + lag
        if length >= max(LEAST_WORDS, LEAST_PERIODS * lag):
            out.append((end - length, length, lag))

    i, k = 0, 0
    while k < len(opens) or active:
        if not active:
            i = max(i, opens[k][0])              # nothing happens before
        if i == n:
            for lag in list(active):
                close(lag, n)
            break
        for lag in list(active):
            if word[i] == word[i - lag]:
                active[lag] += 1
            else:
                close(lag, i)
        while k < len(opens) and opens[k][0] <= i:
            lag = opens[k][1]
            if lag <= i and lag not in active and word[i] == word[i - lag]:
                before = i - 1                   # matches whose windows met a nearer occurrence
                while before >= lag and word[before] == word[before - lag]:
                    before -= 1
                active[lag] = i - before
            k += 1
        i += 1
    return sorted(out, key=lambda run: (run[0], run[2]))


def collapse(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay: a run keeps its first period."""
    kept = np.ones(n, bool)
    for start, length, period in runs:
        kept[start + period:start + length] = False
    return kept


def _joined(pieces: pa.Array, ranges: np.ndarray) -> pa.Array:
    """The words of every document joined by one space."""
    lists = pa.LargeListArray.from_arrays(pa.array(ranges), pieces)
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string()))


def runs_of_slice(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(word counts, runs, collapsed texts) of an Arrow column of texts."""
    codes, ranges, vocabulary = words(*buffer(texts))
    place, lag = candidates(codes, ranges)
    found: list[list] = [[] for _ in range(len(texts))]
    kept = np.ones(len(codes), bool)
    docs = np.searchsorted(ranges, place, side="right") - 1
    for d in np.unique(docs):
        lo, hi = np.searchsorted(docs, [d, d + 1])
        start, end = ranges[d], ranges[d + 1]
        found[d] = text_runs(codes[start:end].tolist(), list(zip((place[lo:hi] - start).tolist(), lag[lo:hi].tolist())))
        kept[start:end] = collapse(end - start, found[d])
    stays = np.concatenate([[0], np.cumsum(kept)])[ranges]
    runs = pa.array([[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in found], _RUN_TYPE)
    return pa.array(np.diff(ranges)), runs, _joined(vocabulary.take(pa.array(codes[kept])), stays)


def periodic_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` replaced by the collapsed text (words joined by one space,
    of each run only its first period) and the columns ``n_words`` and ``runs`` (structs
    of ``start``, ``length``, ``period`` in words, by start and period)."""
    added = {"n_words", "runs", text_col}
    others = [c for c in docs.columns if c.lower() not in {a.lower() for a in added}]
    slim = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row") if others else F.lit(None).alias("row"),
                       F.col(f"`{text_col}`").alias("text"))
    kind = slim.schema["row"].dataType.simpleString() if others else "void"

    def run(batches):
        for b in slices(batches, "text"):
            n_words, runs, collapsed = runs_of_slice(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("row"), collapsed.cast(pa.string()), n_words, runs],
                                             ["row", "text", "n_words", "runs"])

    done = shared.ready(slim).mapInArrow(run, f"row {kind}, text string, n_words bigint, runs {RUNS}")
    return done.select(*[F.col("row").getField(c).alias(c) for c in others], F.col("text").alias(text_col),
                       "n_words", "runs")


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period (ties: smallest start, then
    period); null without runs.  ``runs`` is sorted by start and period."""
    better = lambda x, best: x["length"] * best["period"] > best["length"] * x["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, x: F.when(better(x, best), x).otherwise(best))


def periodic_tail(text: Column, first: Column, period: Column) -> Column:
    """The words of ``text`` joined by one space, where every word from number ``first``
    on repeats with ``period``; both are columns over the word count, given as functions."""
    found = F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def planted(w: Column) -> Column:
        a, p = first(F.size(w)), period(F.size(w))
        at = F.sequence(F.lit(0), F.size(w) - 1)
        return F.array_join(F.transform(at, lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p))), " ")

    # A one-element array binds the words once.
    return F.get(F.transform(F.array(found), lambda w: F.when(F.size(w) > 0, planted(w)).otherwise(F.lit(""))), F.lit(0))
