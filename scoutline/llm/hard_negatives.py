"""Hard-negative mining with exact integer scores by Four-Russians tables.

A component ``x`` counts as ``floor(scale * x)``; a score is the integer inner
product.  Every row is stored once as packed bit planes (two's complement): bit ``b``
of eight neighbouring components is one byte.  For a chunk of anchors the sums of
every subset of eight components are tabulated (256 entries a group), so a plane of a
candidate is scored by looking its bytes up and adding, and the planes are joined by
shift and add, from the sign plane down.  These are the full exact scores; nothing is
estimated or skipped.

* Positives: rows are dealt to buckets by label, large buckets are split by row, and an
  anchor meets the blocks of its own bucket only.
* Negatives: anchors and rows are dealt to bounded blocks by row number and each pair of
  blocks is one group.  A group knows the scores its negatives must lie between
  and keeps the first few of each (anchor, positive score) while it goes over its rows in
  id order, so that ties cost nothing.
* Small sorted lists come out of a group; a window over them takes the first ones.

No group grows with a label, a copy group or the table: a hot label is more blocks.
The work is anchors x rows, as the search is exhaustive by contract.

Defined results: rows with a null label, a null vector, or a null or non-finite
component take no part; a null id sorts after all others; repeated ids are rows of
their own (an anchor's other rows include its repeats); shorter vectors are padded
with zeros; an empty table gives an empty result; only the named columns are read.
A table whose scores do not fit in 62 bits is refused with an error.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoutline.llm import shared

BLOCK_ROWS = 65_536        # candidates of a group at most
BLOCK_ANCHORS = 8_192      # anchors of a group at most
LEAST_ROWS = 1_024         # smaller blocks are not worth a group
CHUNK = (2_048, 64)        # candidates x anchors scored at once: tables and sums stay in the cache
BROADCAST_ROWS = 500_000   # of the bucket sizes (four numbers a row)
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


# --- bit planes --------------------------------------------------------------

def quantise(vectors: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whole numbers of all usable rows, their lengths, which rows are usable)."""
    if not pa.types.is_list(vectors.type):
        vectors = vectors.cast(pa.list_(vectors.type.value_type))
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)      # null: nan
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    ends = np.cumsum(sizes)
    usable = bad[ends] == bad[ends - sizes]
    q = np.floor(scale * flat[np.repeat(usable, sizes)])
    if len(q) and np.abs(q).max() >= 2.0 ** 52:
        raise ValueError("a component is too large for integer scores")
    return q.astype(np.int64), sizes[usable], usable


def to_planes(q: np.ndarray) -> np.ndarray:
    """(rows, planes, groups) bytes of a (rows, components) matrix."""
    rows, n = q.shape
    q = np.pad(q, ((0, 0), (0, -n % 8)))
    top = max(int(q.max(initial=0)).bit_length(), int(-1 - q.min(initial=0)).bit_length()) + 1
    return np.stack([np.packbits(((q >> b) & 1).astype(np.uint8).reshape(rows, -1, 8), axis=2)[:, :, 0]
                     for b in range(top)], axis=1)


def from_planes(planes: np.ndarray) -> np.ndarray:
    """The (rows, components) matrix of (rows, planes, groups) bytes."""
    bits = np.unpackbits(planes, axis=2).astype(np.int64)
    top = planes.shape[1] - 1
    return sum((bits[:, b] << b for b in range(top)), -(bits[:, top] << top))


def stack(table: pa.Table) -> np.ndarray:
    """Planes of all rows of a group as one array: a row with fewer planes repeats its
    sign, one with fewer groups gets zeros."""
    n_planes, n_groups = (table.column(c).to_numpy() for c in ("n_planes", "n_groups"))
    out = np.zeros((len(n_planes), max(n_planes.max(), 1), n_groups.max()), np.uint8)
    packed = table.column("planes").combine_chunks()
    for b, g in set(zip(n_planes.tolist(), n_groups.tolist())):
        at = np.flatnonzero((n_planes == b) & (n_groups == g))
        if g:
            raw = np.frombuffer(b"".join(packed.take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), b, g)
            out[at, :b, :g] = raw
            out[at, b:, :g] = raw[:, -1:]
    return out


def tables_of(q: np.ndarray, n_groups: int, n_planes: int) -> np.ndarray:
    """Sums of every subset of eight components: (groups, 256, anchors)."""
    q = np.pad(q, ((0, 0), (0, 8 * n_groups - q.shape[1]))) if q.shape[1] < 8 * n_groups else q
    bound = int(np.abs(q).sum(axis=1).max(initial=0)) << n_planes
    if bound >= 1 << 62:
        raise ValueError("scores do not fit in 62 bits")
    kind = np.int32 if bound < 1 << 31 else np.int64
    return np.stack([(BITS @ q[:, 8 * g:8 * g + 8].T).astype(kind) for g in range(n_groups)])


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(candidates, anchors) inner products; ``planes`` is (planes, groups, candidates)."""
    shape = (planes.shape[2], tables.shape[2])
    total, one, looked = np.zeros(shape, tables.dtype), np.empty(shape, tables.dtype), np.empty(shape, tables.dtype)
    for b in range(len(planes) - 1, -1, -1):
        np.take(tables[0], planes[b, 0], axis=0, out=one, mode="clip")
        for g in range(1, len(tables)):
            one += np.take(tables[g], planes[b, g], axis=0, out=looked, mode="clip")
        if b == len(planes) - 1:
            np.negative(one, out=total)
        else:
            total <<= 1
            total += one
    return total


# --- a pair of blocks --------------------------------------------------------

class First:
    """The first ``k`` candidates of every slot, by score down and then position.
    Candidates come in position order, so a full slot takes higher scores only."""

    def __init__(self, above: np.ndarray, upto: np.ndarray, k: int):
        self.above, self.upto, self.k = above, upto, k          # (anchors, slots of an anchor)
        self.slot, self.score, self.at = (np.zeros(0, np.int64) for _ in range(3))

    def offer(self, found: np.ndarray, allowed: np.ndarray, base: int) -> None:
        n_slots, parts = self.above.shape[1], [(self.slot, self.score, self.at)]
        for j in range(n_slots):
            hit = (found > self.above[:, j]) & (found <= self.upto[:, j]) & allowed
            i, a = np.nonzero(hit)
            parts.append((a * n_slots + j, found[i, a].astype(np.int64), i + base))
        if not any(len(p[0]) for p in parts[1:]):
            return
        slot, score, at = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((at, -score, slot))
        slot, score, at = slot[order], score[order], at[order]
        first = np.searchsorted(slot, slot)
        rank = np.arange(len(slot)) - first
        full = rank == self.k - 1
        self.above.reshape(-1)[slot[full]] = score[full]
        kept = rank < self.k
        self.slot, self.score, self.at = slot[kept], score[kept], at[kept]


OUT = "anchor_row bigint, bound bigint, row bigint, id {kind}, score bigint"


def search(anchors: pa.Table, rows: pa.Table, same_label: bool, k: int, low: int, high: int) -> pa.Table:
    """Positives (``same_label``) or negatives of one pair of blocks."""
    kind = rows.schema.field("id").type
    names = ["anchor_row", "bound", "row", "id", "score"]
    types = [pa.int64(), pa.int64(), pa.int64(), kind, pa.int64()]
    if not anchors.num_rows or not rows.num_rows:
        return pa.table([pa.array([], t) for t in types], names)
    rows = rows.take(pc.sort_indices(rows, [("id", "ascending"), ("row", "ascending")], null_placement="at_end"))
    labels = pa.chunked_array([*anchors.column("label").chunks, *rows.column("label").chunks]).combine_chunks()
    codes = labels.dictionary_encode().indices.to_numpy()
    a_label, c_label = codes[:anchors.num_rows], codes[anchors.num_rows:]
    a_row, c_row = anchors.column("row").to_numpy(), rows.column("row").to_numpy()
    q = from_planes(stack(anchors))
    planes = stack(rows).transpose(1, 2, 0)
    n_groups = max(planes.shape[1], q.shape[1] // 8, 1)
    planes = np.ascontiguousarray(np.pad(planes, ((0, 0), (0, n_groups - planes.shape[1]), (0, 0))))
    bounds = None if same_label else anchors.column("bounds").to_pylist()
    out = []
    for a in range(0, len(q), CHUNK[1]):
        end = min(a + CHUNK[1], len(q))
        if same_label:
            limits = np.full((end - a, 1), np.iinfo(np.int64).max)
            first = First(-limits, limits, k)
        else:
            most = max(len(b) for b in bounds[a:end])
            limits = np.zeros((end - a, most), np.int64)
            above, upto = np.zeros_like(limits), np.full_like(limits, -1)     # an unused slot takes nothing
            for x, some in enumerate(bounds[a:end]):
                for j, p in enumerate(some):
                    limits[x, j], above[x, j], upto[x, j] = p, -(-low * p // 100) - 1, high * p // 100
            first = First(above, upto, k)
        tables = tables_of(q[a:end], n_groups, len(planes))
        for c in range(0, len(c_row), CHUNK[0]):
            stop = min(c + CHUNK[0], len(c_row))
            found = scores(tables, planes[:, :, c:stop])
            alike = c_label[c:stop, None] == a_label[None, a:end]
            allowed = alike & (c_row[c:stop, None] != a_row[None, a:end]) if same_label else ~alike
            first.offer(found, allowed, c)
        anchor = first.slot // limits.shape[1]
        out.append(pa.table([
            pa.array(a_row[a:end][anchor]), pa.array(limits.reshape(-1)[first.slot]), pa.array(c_row[first.at]),
            rows.column("id").take(pa.array(first.at)).combine_chunks(), pa.array(first.score)], names))
    return pa.concat_tables(out).cast(pa.schema(list(zip(names, types))))


# --- Spark -------------------------------------------------------------------

def packed(vectors: DataFrame, anchor: Column, scale: float, id_col: str, vector_col: str,
           label: Column) -> DataFrame:
    """The usable rows as a stored table: ``row`` (a number of its own), ``id``, ``label``,
    ``anchor``, ``n_planes``, ``n_groups``, ``planes``."""
    slim = vectors.select(F.col(id_col).alias("id"), label.alias("label"),
                          F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector_col).alias("vector"))
    slim = slim.where("label IS NOT NULL AND vector IS NOT NULL")
    kinds = dict(slim.dtypes)

    def run(batches):
        for batch in batches:
            step = max(1, (8 << 20) // max(1, batch.column("vector").nbytes // max(1, batch.num_rows)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                q, sizes, usable = quantise(part.column("vector"), scale)
                part = part.filter(pa.array(usable)).select(["id", "label", "anchor"])
                starts = np.cumsum(sizes) - sizes
                for n in np.unique(sizes):
                    here = np.flatnonzero(sizes == n)
                    planes = to_planes(q[starts[here, None] + np.arange(n)])
                    some, width = part.take(pa.array(here)), planes.shape[1] * planes.shape[2]
                    data = pa.Array.from_buffers(pa.binary(), len(here), [
                        None, pa.py_buffer((np.arange(len(here) + 1) * width).astype(np.int32)),
                        pa.py_buffer(planes.tobytes())])
                    same = lambda v: pa.array(np.full(len(here), v, np.int32))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays(
                        [*some.columns, same(planes.shape[1]), same(planes.shape[2]), data],
                        [*some.schema.names, "n_planes", "n_groups", "planes"])

    schema = f"id {kinds['id']}, label {kinds['label']}, anchor boolean, n_planes int, n_groups int, planes binary"
    numbered = shared.ready(slim).mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())
    return shared.table(numbered, "bit-planes")


def _pairs(anchors: DataFrame, rows: DataFrame, n_tasks: int, function) -> DataFrame:
    """Every pair of blocks in one group.  The number of tasks is given, as a group is little
    data and much work: merging small partitions would take the cores from it."""
    kind = dict(rows.dtypes)["id"]
    keys = ["bucket", "a", "c"]
    anchors = anchors.select(*[F.col(c).alias(c) for c in anchors.columns])      # columns of their own
    anchors, rows = (df.repartition(n_tasks, *keys) for df in (anchors, rows))
    return (anchors.groupBy(*keys).cogroup(rows.groupBy(*keys))
            .applyInArrow(lambda left, right: function(left, right), OUT.format(kind=kind)))


def _deal(key: Column, n: Column) -> Column:
    return F.pmod(F.xxhash64(key), n).cast("int")


def _blocks(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80,
                   high: int = 100, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding",
                   label: Column | None = None, block_rows: int = BLOCK_ROWS,
                   block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """For every row where ``anchor`` holds, its first ``positives`` other rows of the same
    label, and for each of them the first ``negatives`` rows of other labels with
    ``low * positive_score <= 100 * negative_score <= high * positive_score``: ``anchor_id``,
    ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``."""
    spark = vectors.sparkSession
    rows = packed(vectors, anchor, scale, id_col, vector_col, F.col("label") if label is None else label)
    n, n_anchors = rows.agg(F.count("*"), F.count(F.when(F.col("anchor"), 1))).first()
    block_rows = max(1, min(block_rows, max(LEAST_ROWS, -(-n // (2 * shared.partitions(spark))))))
    n_blocks, n_anchor_blocks = max(1, -(-n // block_rows)), max(1, -(-n_anchors // block_anchors))
    n_tasks = min(n_blocks * n_anchor_blocks, 2 * shared.partitions(spark))

    # Positives: an anchor meets the blocks of its label's bucket.
    bucket = _deal(F.col("label"), F.lit(n_blocks))
    sizes = rows.groupBy(bucket.alias("bucket")).agg(
        F.ceil(F.count("*") / block_rows).alias("n_c"),
        F.ceil(F.count(F.when(F.col("anchor"), 1)) / block_anchors).alias("n_a")).where("n_a > 0")
    sized = rows.withColumn("bucket", bucket).join(
        F.broadcast(sizes) if n_blocks <= BROADCAST_ROWS else sizes, "bucket")
    own = _pairs(
        sized.where("anchor").select("*", _deal(F.col("row"), F.col("n_a")).alias("a"), _blocks(F.col("n_c")).alias("c")),
        sized.select("*", _deal(F.col("row"), F.col("n_c")).alias("c"), _blocks(F.col("n_a")).alias("a")),
        n_tasks, partial(search, same_label=True, k=positives, low=low, high=high))
    chosen = shared.table(
        _first(own, ["anchor_row"], positives).select("anchor_row", F.col("id").alias("positive_id"),
                                                       F.col("score").alias("positive_score")), "positives")

    # Negatives: every anchor meets every block.
    wanted = chosen.groupBy(F.col("anchor_row").alias("row")).agg(F.collect_set("positive_score").alias("bounds"))
    anchors = rows.where("anchor").join(wanted, "row").withColumn("bucket", F.lit(0))
    others = _pairs(
        anchors.select("*", _deal(F.col("row"), F.lit(n_anchor_blocks)).alias("a"), _blocks(F.lit(n_blocks)).alias("c")),
        rows.select("*", F.lit(0).alias("bucket"), _deal(F.col("row"), F.lit(n_blocks)).alias("c"),
                    _blocks(F.lit(n_anchor_blocks)).alias("a")),
        n_tasks, partial(search, same_label=False, k=negatives, low=low, high=high))
    best = _first(others, ["anchor_row", "bound"], negatives).select(
        "anchor_row", F.col("bound").alias("positive_score"), "rank", F.col("id").alias("negative_id"),
        F.col("score").alias("negative_score"))
    ids = rows.where("anchor").select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id"))
    return chosen.join(best, ["anchor_row", "positive_score"]).join(ids, "anchor_row").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
           FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike,
             CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE alike
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike
 AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) <= 5
"""
