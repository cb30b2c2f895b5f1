"""Sharding along a Hilbert curve.

Metadata dimensions are quantised into ``2 ** bits`` equally filled steps, a
row's steps give its place on a Hilbert curve, and the rows, sorted by (place,
id), are cut into ``n_shards`` runs whose counts are at most one apart (law
``rows``).  Neighbouring rows share narrow ranges of all dimensions, so min/max
statistics of the written files prune on any of them.

The sort is one range exchange over slim rows (id, size, checksum, steps; no
texts).  Equal places are split by id, so a hot place spreads over partitions.
Global positions are each partition's row number plus the counts of the
partitions before it (one row per partition).

Defined results: a null text has no bytes (size 1, checksum 0); null metadata is
the lowest step; ties of place and id are equal rows, in any order; an empty table
gives an empty result; null and repeated ids are rows of their own; other columns
than the named ones are not read.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from scoutline.llm import shared

BITS = 6


def hilbert_index(steps: np.ndarray, bits: int) -> np.ndarray:
    """Place on the curve of each row of ``steps`` (rows x dimensions, each
    below ``2 ** bits``), after Skilling's public transform."""
    x = steps.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:                                    # undo the excess rotations
        low = q - 1
        for i in range(dims):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):                        # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> bit) & 1)
    return out


def _place_udf(cuts: list[list[float]], bits: int):
    @F.pandas_udf("bigint")
    def place(values: pd.DataFrame) -> pd.Series:
        steps = np.stack([_steps(c, values.iloc[:, i]) for i, c in enumerate(cuts)], axis=1)
        return pd.Series(hilbert_index(steps, bits))
    return place


def _steps(cuts: list, values: pd.Series) -> np.ndarray:
    """Number of cuts at or below each value."""
    if values.dtype != object:
        return np.searchsorted(np.asarray(cuts), values.to_numpy(float), side="right")
    codes, distinct = pd.factorize(values)
    return np.array([bisect_right(cuts, v) for v in distinct], np.int64)[codes]


def _string_cuts(slim: DataFrame, name: str, bits: int) -> list[bytes]:
    """The values of a string column at each ``2 ** -bits`` of the rows: rows are
    counted per distinct value, and the counts summed along a range exchange."""
    counts = shared.table(slim.groupBy(F.col(name).alias("value")).agg(F.count("*").alias("rows"))
                          .repartitionByRange(shared.partitions(slim.sparkSession), "value").sortWithinPartitions("value")
                          .withColumn("at", F.monotonically_increasing_id()), "shard-values")
    counts = counts.withColumn("part", F.shiftright("at", 33))
    # One row per range partition: bounded by the number of partitions.
    parts = counts.groupBy("part").agg(F.sum("rows").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"),
                          F.sum("rows").over(Window.partitionBy()).alias("total"))
    within = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ends = (counts.withColumn("end", F.sum("rows").over(within)).join(F.broadcast(starts), "part")
            .withColumn("end", F.col("end") + F.col("start")))
    steps = 1 << bits
    cut = (ends.select("value", F.expr(f"((end - rows) * {steps}) div total").alias("low"),
                       F.expr(f"(end * {steps}) div total").alias("high")).where("high > low").orderBy("high").collect())
    # At most one row per step.
    return [r.value for r in cut for k in range(r.low + 1, r.high + 1) if k < steps]


def hilbert_shards(docs: DataFrame, dimensions: dict[str, Column], n_shards: int = 16,
                   id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """Per row: id, ``size`` (UTF-8 bytes + 1), ``text_crc32``, ``hilbert``,
    ``shard`` and ``slot``.  ``dimensions``: numeric and string columns by name;
    strings are ordered by all their UTF-8 bytes."""
    names = [f"dim{i}" for i in range(len(dimensions))]
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    strings = [n for n, c in zip(names, dimensions.values()) if docs.select(c).schema[0].dataType == StringType()]
    dims = [F.coalesce(c.cast("binary"), F.lit(b"")) if n in strings else F.coalesce(c.cast("double"), F.lit(float("-inf")))
            for n, c in zip(names, dimensions.values())]
    slim = shared.table(docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        *[c.alias(n) for n, c in zip(names, dims)],
    ), "shard-dims")
    points = [i / (1 << bits) for i in range(1, 1 << bits)]
    numeric = [F.percentile_approx(n, points, 10_000).alias(n) for n in names if n not in strings]
    cuts = slim.agg(F.count("*"), *numeric).first().asDict() | {n: _string_cuts(slim, n, bits) for n in strings}
    place = _place_udf([list(cuts[n] or []) for n in names], bits)
    n = shared.partitions(docs.sparkSession)
    order = ["hilbert", "id", "text_crc32", "size"]
    placed = shared.table(
        shared.ready(slim).withColumn("hilbert", place(F.struct(*names))).drop(*names)
        .repartitionByRange(n, *order).sortWithinPartitions(*order)
        .withColumn("at", F.monotonically_increasing_id()), "shard-order")
    part = F.shiftright("at", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    # One row per range partition: bounded by the number of partitions.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"),
                           F.sum("rows").over(Window.partitionBy()).alias("total"))
    ranked = placed.withColumn("part", part).join(F.broadcast(starts), "part").withColumn(
        "rank", F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    return (ranked.withColumn("shard", F.expr(f"(rank * {n_shards}) div total").cast("int"))
            .withColumn("first", F.expr(f"(shard * total + {n_shards} - 1) div {n_shards}"))
            .select(F.col("id").alias(id_col), "size", "text_crc32", "hilbert", "shard",
                    (F.col("rank") - F.col("first")).alias("slot")))


def write_shards(docs: DataFrame, dimensions: dict[str, Column], path: str, n_shards: int = 16,
                 text_col: str = "text", bits: int = BITS) -> None:
    """Write ``docs`` in curve order, one folder per shard (several files where
    a shard is large).  Rows are numbered first, so that null and repeated ids do no harm."""
    numbered = shared.table(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    shards = hilbert_shards(numbered, dimensions, n_shards, "_row", text_col, bits).select("_row", "shard", "slot")
    (numbered.join(shards, "_row").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .drop("_row", "slot").write.partitionBy("shard").mode("overwrite").parquet(path))


def document_dimensions() -> dict[str, Column]:
    """Dimensions of the ``documents`` table: source, language and length."""
    return {"source": F.col("source"), "lang": F.col("lang"),
            "length": F.octet_length(F.coalesce(F.col("text"), F.lit("")))}
