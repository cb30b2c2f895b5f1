"""Exact dedup by a tree merge of sorted digest runs (DataFrame functions only).

Texts are equal when identical after replacing each ``[\\x20\\x09-\\x0D]+`` by one
space (null counts as empty).  Of equal texts the row with the smallest id stays.

* A partition of the input is a *run*.  One pass over the texts writes a slim
  table, each run sorted by shard of the digest space, 64-bit digest, and what
  verifies it (SHA-256 and length of the normalised text).
* Level 0 reduces every run to one row per text.  In each further round the runs
  ``r`` with equal ``r >> bits`` meet, shard by shard, in digest order, and one ordered pass
  over them (a sort aggregate: it holds one row, not a table of groups) merges neighbours
  that are equal in digest, SHA-256 and length, keeping the smallest id and the summed
  count.  After ``log`` rounds one run per shard is left.  A group of copies, however
  large, is never more than ``2 ** bits`` rows of a merge.
* Answers travel back through level 0: the merged rows meet the level-0 rows (one
  per run and text), so the rows of a hot text are spread over the runs they
  came from and are never gathered by text.

Defined results: null ids are ignored when the smallest is sought (a group of
only null ids keeps null); a row is ``kept`` when its id equals the group's
smallest, so repeated rows with that id are all kept; an empty table gives an
empty result; texts of any length are read whole; only the named columns are read, so
others of any name do no harm.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutline.llm import shared

FAN_BITS = 3          # a round merges 2 ** FAN_BITS runs
TEXT = ["digest", "text_sha256", "length"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def _level0(docs: DataFrame, id_col: str, text_col: str, n_shards: int) -> DataFrame:
    text = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("t"))
    return text.select(
        "id", F.spark_partition_id().alias("run"), F.xxhash64("t").alias("digest"),
        F.sha2("t", 256).alias("text_sha256"), F.octet_length("t").alias("length"),
    ).withColumn("shard", F.pmod("digest", F.lit(n_shards)).cast("int")).sortWithinPartitions("shard", "run", *TEXT)


def _merge(runs: DataFrame, n: int) -> DataFrame:
    """Runs with the same number meet, shard by shard, and are merged in digest order.  The smallest id is
    held as a struct, which Spark aggregates over sorted input only."""
    return (runs.repartition(n, "shard", "run").sortWithinPartitions("shard", "run", *TEXT)
            .groupBy("shard", "run", *TEXT).agg(F.min("keep").alias("keep"), F.sum("group_size").alias("group_size")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``keep_id``, ``group_size``,
    ``kept``, ``text_sha256`` (of the normalised text)."""
    n = shared.partitions(docs.sparkSession)
    rows = shared.table(_level0(docs, id_col, text_col, n), "digest-runs")
    last = rows.agg(F.max("run")).first()[0] or 0
    known = F.when(F.col("id").isNotNull(), F.struct("id"))            # null ids are not the smallest
    ones = rows.select("shard", "run", *TEXT, known.alias("keep"), F.lit(1).cast("bigint").alias("group_size"))
    level0 = shared.table(_merge(ones, n), "level0")
    top = level0
    for _ in range(math.ceil(math.log2(last + 1) / FAN_BITS) if last else 0):
        top = _merge(top.withColumn("run", F.shiftright("run", FAN_BITS)), n)
    answers = level0.select("run", *TEXT).join(top.select(*TEXT, F.col("keep.id").alias("keep_id"), "group_size"), TEXT)
    return rows.join(answers, ["run", *TEXT]).select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
           FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
