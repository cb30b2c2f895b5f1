"""Line dedup with a sharded minimal perfect hash.

A line's key is the line with ``[\\x20\\x09-\\x0D]`` stripped at both ends and
A-Z lower-cased.  Keys found in at least ``min_docs`` documents lose all their
lines in every document.

1. The documents are stored once with a row number and the distinct 128-bit digests of
   their lines.
2. Digests are counted (pre-aggregated per slice, then per shard).  Each shard
   of the digest space gets a minimal perfect hash over its digests and, in the
   hash's order, an array of 64-bit fingerprints and one of counts.  Lines found in
   one document stay out of the index: a failed fingerprint means count 1.
3. Documents probe: a slice sends the digests and row numbers of each shard that it meets as
   one packed row to the task that holds that shard's arrays.  A shard with many probes (a hot line) is held by several tasks, as
   its occurrence count says; only such shards are told to the probes.  A task streams its
   probes, sorted by shard, past one shard's arrays, so memory is one shard plus one batch.
4. The few digests to drop go back to their documents by row number, so that null or
   repeated ids are no hot key.

Defined results: a null or empty text is one empty line and stays empty (a null
text comes back as ''); empty keys are never dropped; every row counts as one
document, also when ids repeat or are null; an empty table gives an empty result;
a text of any length is handled whole.  Input columns named like an output column
are replaced, all others are passed through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutline.llm import shared
from scoutline.llm.words import mix, slices

BLANK = b" \t\n\x0b\x0c\r"
SHARD_LINES = 1 << 19          # lines a shard's hash covers at most, on average
PROBES_PER_TASK = 1 << 22      # probes of one shard beyond which it is held by more tasks
LOAD = 2.0                     # bits per key of each level of the hash
BROADCAST_SHARDS = 500_000     # hot shards (twelve bytes each) that are broadcast
INDEX = "shard int, levels array<bigint>, bits binary, fingerprints binary, counts binary, occurrences bigint"


def line_key(line: bytes) -> bytes:
    return line.strip(BLANK).lower()


def _digests(text: bytes) -> set[bytes]:
    return {xxhash.xxh3_128_digest(k) for k in map(line_key, text.split(b"\n")) if k}


def line_digests(docs: DataFrame) -> DataFrame:
    """``docs`` (columns ``rest`` and ``text``) with the distinct line digests of every text, 16 bytes
    each, and their number ``n``."""
    def run(batches):
        for b in slices(batches, "text"):
            packed = [b"".join(_digests(t.encode())) if t else b"" for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.select(["rest", "text"]).columns, pa.array(packed, pa.binary()),
                 pa.array([len(p) // 16 for p in packed], pa.int64())], ["rest", "text", "digests", "n"])

    kind = docs.schema["rest"].dataType.simpleString()
    return shared.ready(docs).mapInArrow(run, f"rest {kind}, text string, digests binary, n bigint")


# --- the hash --------------------------------------------------------------

def _halves(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(packed, "<u8").reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _place(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = np.uint64(0x9E3779B97F4A7C15 * (2 * level + 1) & 0xFFFFFFFFFFFFFFFF)
    return ((mix(hi ^ seed) + mix(lo + seed)) % np.uint64(size)).astype(np.int64)


def fingerprint(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return mix(hi ^ mix(lo))


class PerfectHash:
    """Minimal perfect hash in levels: a key that is alone at its place of a
    level is settled there, all others go on to the next level.  A key's number
    is the count of settled places before its own."""

    def __init__(self, levels: list[int], bits: np.ndarray):
        self.levels, self.bits = levels, bits            # bits: uint64 words, levels padded to 64
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits).astype(np.int64))])

    @classmethod
    def build(cls, hi: np.ndarray, lo: np.ndarray) -> PerfectHash:
        levels, words = [], []
        while len(hi):
            size = -(-max(64, int(LOAD * len(hi))) // 64) * 64
            at = _place(hi, lo, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(size)
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            rest = ~alone[at]
            hi, lo = hi[rest], lo[rest]
        return cls(levels, np.concatenate(words) if words else np.zeros(0, "<u8"))

    def number(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The key's number; -1 for keys that end at no place (surely absent)."""
        out = np.full(len(hi), -1, np.int64)
        left, base = np.arange(len(hi)), 0
        for level, size in enumerate(self.levels):
            at = _place(hi[left], lo[left], level, size) + base
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            found = (self.bits[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(self.bits[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[found]] = (self.before[word] + below)[found]
            left = left[~found]
            base += size
        return out


def index_row(shard: int, packed: bytes, counts: np.ndarray) -> dict:
    hi, lo = _halves(packed)
    h = PerfectHash.build(hi, lo)
    order = np.argsort(h.number(hi, lo))
    return {"shard": shard, "levels": h.levels, "bits": h.bits.tobytes(),
            "fingerprints": fingerprint(hi, lo)[order].tobytes(),
            "counts": counts[order].astype("<u4").tobytes(), "occurrences": int(counts.sum())}


class ShardIndex:
    def __init__(self, row: dict):
        self.hash = PerfectHash(list(row["levels"]), np.frombuffer(row["bits"], "<u8"))
        self.fingerprints = np.frombuffer(row["fingerprints"], "<u8")
        self.counts = np.frombuffer(row["counts"], "<u4")

    def count(self, packed: bytes) -> np.ndarray:
        """Documents that hold each digest; 1 for digests not in the index."""
        hi, lo = _halves(packed)
        out = np.ones(len(hi), np.int64)
        number = self.hash.number(hi, lo)
        at = np.flatnonzero(number >= 0)
        at = at[self.fingerprints[number[at]] == fingerprint(hi[at], lo[at])]
        out[at] = self.counts[number[at]]
        return out


# --- Spark jobs ------------------------------------------------------------

def build_index(lines: DataFrame, n_shards: int) -> DataFrame:
    """The index, one row per shard (schema ``INDEX``)."""
    spark = lines.sparkSession

    def count(batches):
        for b in slices(batches, "digests", 1 << 23):
            flat = np.frombuffer(b"".join(b.column("digests").to_pylist()), "V16")
            if not len(flat):
                continue
            coded = pa.Array.from_buffers(pa.binary(16), len(flat), [None, pa.py_buffer(flat)]).value_counts()
            digests = coded.field("values")
            shard = _shards(np.frombuffer(digests.buffers()[1], "<u8")[::2][:len(digests)], n_shards)
            yield pa.RecordBatch.from_arrays([pa.array(shard), digests.cast(pa.binary()), coded.field("counts")],
                                             ["shard", "digest", "n"])

    def build(batches):
        shard, digests, counts = None, [], []
        for b in batches:
            at = b.column("shard").to_numpy()
            bounds = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            for i, j in zip(bounds, np.append(bounds[1:], len(at))):
                if at[i] != shard and digests:
                    yield _as_batch(index_row(shard, b"".join(digests), np.concatenate(counts)))
                    digests, counts = [], []
                shard = int(at[i])
                digests.extend(b.column("digest").slice(i, j - i).to_pylist())
                counts.append(b.column("n").slice(i, j - i).to_numpy())
        if digests:
            yield _as_batch(index_row(shard, b"".join(digests), np.concatenate(counts)))

    counted = (lines.select("digests").mapInArrow(count, "shard int, digest binary, n bigint")
               .repartition(shared.partitions(spark), "shard")
               .groupBy("shard", "digest").agg(F.sum("n").alias("n")).where("n >= 2")
               .sortWithinPartitions("shard"))
    return counted.mapInArrow(build, INDEX)


def _shards(hi: np.ndarray, n_shards: int) -> np.ndarray:
    return ((hi >> np.uint64(32)) % np.uint64(n_shards)).astype(np.int32)


def _as_batch(row: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([row], schema=pa.schema([
        ("shard", pa.int32()), ("levels", pa.list_(pa.int64())), ("bits", pa.binary()),
        ("fingerprints", pa.binary()), ("counts", pa.binary()), ("occurrences", pa.int64())]))


def spread(rows: np.ndarray, packed: list[bytes], n_shards: int) -> pa.RecordBatch:
    """The digests of a slice of documents, one row per shard that holds any: ``shard``, ``rows`` (of the
    documents) and ``probes`` (16 bytes each)."""
    flat = np.frombuffer(b"".join(packed), "V16")
    shard = _shards(flat.view("<u8")[::2], n_shards)
    order = np.argsort(shard, kind="stable")
    shard = shard[order]
    starts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(0, np.int64)
    bounds = np.append(starts, len(shard))
    probes = pa.Array.from_buffers(pa.binary(), len(starts), [
        None, pa.py_buffer((16 * bounds).astype(np.int32)), pa.py_buffer(flat[order].tobytes())])
    documents = np.repeat(rows, [len(p) // 16 for p in packed])[order]
    return pa.RecordBatch.from_arrays(
        [pa.array(shard[starts]), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(documents)), probes],
        ["shard", "rows", "probes"])


def probe_index(lines: DataFrame, index: DataFrame, n_shards: int, min_docs: int) -> DataFrame:
    """(row, digest) of every line to drop."""
    spark = lines.sparkSession

    def probes(batches):
        for b in slices(batches, "digests", 1 << 23):
            yield spread(b.column("row").to_numpy(), b.column("digests").to_pylist(), n_shards)

    def look_up(batches):
        held = None
        for b in batches:
            shard = b.column("shard").to_numpy()
            arrays = b.column("probes").is_null().to_numpy(zero_copy_only=False)      # a shard's row comes first
            starts = np.flatnonzero(arrays | np.concatenate([[True], shard[1:] != shard[:-1]]))
            for i, j in zip(starts, np.append(starts[1:], len(shard))):
                if arrays[i]:
                    held = int(shard[i]), ShardIndex(b.slice(i, 1).to_pylist()[0])
                    i += 1
                if i < j and held and held[0] == shard[i]:
                    packed = b"".join(b.column("probes").slice(i, j - i).to_pylist())
                    hit = np.flatnonzero(held[1].count(packed) >= min_docs)
                    if len(hit):
                        yield pa.RecordBatch.from_arrays(
                            [b.column("rows").slice(i, j - i).flatten().take(pa.array(hit)),
                             pa.array([packed[16 * h:16 * h + 16] for h in hit], pa.binary())], ["row", "digest"])

    held = index.withColumn("held_by", F.greatest(F.lit(1), F.ceil(F.col("occurrences") / PROBES_PER_TASK)))
    hot = held.where("held_by > 1").select("shard", "held_by")
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_SHARDS else hot
    sent = lines.select("row", "digests").mapInArrow(probes, "shard int, rows array<bigint>, probes binary")
    sent = sent.join(hot, "shard", "left").withColumn(
        "part", F.pmod(F.crc32("probes"), F.coalesce("held_by", F.lit(1)))).drop("held_by")
    held = held.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("held_by") - 1))).drop("held_by")
    both = held.unionByName(sent, allowMissingColumns=True)
    return (both.repartition(shared.partitions(spark), "shard", "part")
            .sortWithinPartitions("shard", "part", F.col("probes").isNotNull())
            .mapInArrow(look_up, "row bigint, digest binary"))


def drop_lines(stored: DataFrame, drops: DataFrame) -> DataFrame:
    """``rest``, ``text`` without the lines to drop, ``n_lines`` and ``n_dropped``."""
    def run(batches):
        for b in slices(batches, "text"):
            texts, lines, gone = [], [], []
            for text, drop in zip(b.column("text").to_pylist(), b.column("drop").to_pylist()):
                own = (text or "").split("\n")
                if drop:
                    drop = set(drop)
                    kept = [x for x in own if not (k := line_key(x.encode())) or xxhash.xxh3_128_digest(k) not in drop]
                else:
                    kept = own
                texts.append("\n".join(kept))
                lines.append(len(own))
                gone.append(len(own) - len(kept))
            yield pa.RecordBatch.from_arrays(
                [b.column("rest"), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(gone, pa.int64())],
                ["rest", "text", "n_lines", "n_dropped"])

    listed = drops.groupBy("row").agg(F.collect_set("digest").alias("drop"))
    both = stored.select("row", "rest", "text").join(listed, "row", "left").select("rest", "text", "drop")
    kind = stored.schema["rest"].dataType.simpleString()
    return both.mapInArrow(run, f"rest {kind}, text string, n_lines bigint, n_dropped bigint")


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def line_dedup(docs: DataFrame, min_docs: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines of frequent keys dropped from ``text_col``, and
    ``n_lines`` (before) and ``n_dropped``.  See the module for the method and
    the defined results; every row counts as one document, ``id_col`` is only passed through."""
    if min_docs < 2:
        raise ValueError("min_docs must be at least 2")
    rest = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    if id_col not in rest:
        raise ValueError(f"documents need a column {id_col!r}")
    slim = docs.select(F.struct(*[_quoted(c) for c in rest]).alias("rest"), _quoted(text_col).alias("text"))
    stored = shared.table(line_digests(slim).withColumn("row", F.monotonically_increasing_id()), "lines")
    total = stored.agg(F.sum("n")).first()[0] or 0
    n_shards = max(shared.partitions(docs.sparkSession), math.ceil(total / SHARD_LINES))
    index = shared.table(build_index(stored, n_shards), "line-index")
    done = drop_lines(stored, probe_index(stored, index, n_shards, min_docs))
    return done.select(*[F.col("rest").getField(c).alias(c) for c in rest], F.col("text").alias(text_col),
                       "n_lines", "n_dropped")


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
frequent AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (
  SELECT k.*, f.key IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
