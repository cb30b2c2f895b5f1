"""Nearest-neighbour joins by cosine distance.

Design (no cross join, no all-pairs rows):

* Both sides carry a *list* key.  For the exact search every row is on list 0;
  for the approximate search the list is an IVF cell (k-means centroid) and a
  query appears once per probed cell.
* Per list, both sides are split into hash blocks of about ``block_bytes`` of
  vectors.  Query rows are replicated across the index blocks of their list and
  vice versa, so every (query block, index block) pair meets in exactly one
  cogroup.  No group grows with the data: a hot list (a third of the index)
  simply gets more blocks.  A vector is shuffled once per opposite block, so
  blocks are as large as a task's memory allows.
* Where one list would be shuffled more than ``COPIES`` times, the index is stored once, a block a file, and every
  task reads the files one after the other for its queries (:func:`_through_files`): disk grows with the sides, not with
  their product, and each block is held to the k-th distances found before it.
* Each cogroup runs a numpy kernel (matrix products in bounded chunks, in single
  precision; pairs that may be among the k nearest again in double precision)
  and emits only its local top-k per query, ties broken by index id.  Boxes of rows whose bound
  (:mod:`knn_boxes`) does not reach a query's k-th distance so far are skipped for it.  Vectors stay as they
  came in the Arrow columns and are scaled to unit length where they are read.
* A final ``row_number() <= k`` per query (planned as a partial + final
  ``WindowGroupLimit``) merges the local winners.

The block-size table has one row per list, so broadcasting it is bounded by
the ``n_lists`` parameter, not by the data.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoutline.operators import knn_boxes
from scoutline.session import _context, cut_lineage, default_parallelism, new_folder, ship_package

BLOCK_BYTES = 32 << 20      # vectors per side per cogroup, as doubles
INDEX_BYTES = 128 << 20     # of the index where there is one list: more rows leave nearer limits and smaller boxes
QUERY_BYTES = 16 << 20      # of the queries there
READER_BYTES = 32 << 20     # of the queries of a task that reads the index itself
COPIES = 4                  # of all vectors that a shuffle may hold; beyond, tasks read the stored index
FOUND_ROWS = 65_536         # rows of an Arrow batch of hits
FRAME_ROWS = 4_096          # rows of a search that is one group of frames
KERNEL_CHUNK = 512          # index rows of a matrix product inside a group; products of 1 MB stay near the core
QUERY_CHUNK = 512           # its queries
FIRST_COLUMNS = 256         # index rows of a group's first product, taken in double precision
DENSE = 0.01                # share of a product's pairs from which all of them are taken in double precision
MIN_BLOCK_ROWS = 256        # smallest block worth a task of its own
CHUNK = 4_096               # rows scaled at a time


def _smallest(vals: np.ndarray, k: int) -> np.ndarray:
    """Column positions of the k smallest ``vals`` per row, ordered by (value, position)."""
    kk = min(k, vals.shape[1])
    if kk == 0:
        return np.empty((len(vals), 0), dtype=np.int64)
    kth = np.partition(vals, kk - 1, axis=1)[:, kk - 1:kk]
    less, tied = vals < kth, vals == kth
    keep = less | (tied & (np.cumsum(tied, axis=1) <= kk - less.sum(axis=1, keepdims=True)))
    pos = np.nonzero(keep)[1].reshape(len(vals), kk)
    order = np.argsort(np.take_along_axis(vals, pos, axis=1), axis=1, kind="stable")
    return np.take_along_axis(pos, order, axis=1)


def _matrix(series: pd.Series | pa.Array) -> np.ndarray:
    """The rows of a column of vectors."""
    if len(series) == 0:
        return np.zeros((0, 0))
    flat = series.flatten().to_numpy(zero_copy_only=False) if isinstance(series, pa.Array) else np.concatenate(series.to_numpy())
    return flat.reshape(len(series), -1)


def _stack(series: pd.Series | pa.Array) -> np.ndarray:
    """Unit rows of a column of vectors; zero vectors stay zero."""
    if len(series) == 0:
        return np.zeros((0, 0))
    m = _matrix(series).astype(np.float64)                    # a copy
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        m /= norms
    m[~(norms > 0).ravel()] = 0.0
    return m


class _Units:
    """The rows of ``_stack``, held as they came and scaled where they are read."""

    def __init__(self, raw: np.ndarray, norms: np.ndarray | None = None):
        self.raw, self.shape = raw, raw.shape
        self.norms = norms if norms is not None else np.concatenate(
            [np.linalg.norm(raw[at:at + CHUNK].astype(np.float64), axis=1) for at in range(0, len(raw), CHUNK)] or [np.zeros(0)])

    def __len__(self) -> int:
        return len(self.raw)

    def __getitem__(self, at) -> np.ndarray:
        m, norms = self.raw[at].astype(np.float64), self.norms[at]
        with np.errstate(invalid="ignore", divide="ignore"):
            m /= norms[:, None]
        m[~(norms > 0)] = 0.0
        return m

    def ordered(self, order: np.ndarray) -> "_Units":
        return _Units(self.raw[order], self.norms[order])


class Cosine:
    """Distance ``round(OFFSET - q.d, DIGITS)`` of unit vectors.  Other distances are of the same form over
    other vectors (:class:`ann_codes.CodeDistance`)."""
    OFFSET, DIGITS = 1.0, 6

    def queries(self, column: pd.Series | pa.Array, cell: int) -> _Units:
        return _Units(_matrix(column))

    def rows(self, column: pd.Series | pa.Array, cell: int) -> _Units:
        return _Units(_matrix(column))


class _Best:
    """The k nearest rows found so far of a slice of queries, by (distance, code of the row)."""

    def __init__(self, n: int, k: int, codes: np.ndarray):
        self.k, self.codes = k, codes
        self.values, self.at = np.full((n, k), np.inf), np.zeros((n, k), np.int64)

    def clear(self) -> None:
        self.values.fill(np.inf)

    def add(self, rows: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
        touched = np.unique(rows)
        r = np.concatenate([np.repeat(touched, self.k), rows])
        v = np.concatenate([self.values[touched].ravel(), values])
        p = np.concatenate([self.at[touched].ravel(), at])
        order = np.lexsort((self.codes[p], v, r))
        starts = np.searchsorted(r[order], touched)
        first = order[(starts[:, None] + np.arange(self.k)).ravel()]
        self.values[touched], self.at[touched] = v[first].reshape(-1, self.k), p[first].reshape(-1, self.k)


def _spans(ends: np.ndarray) -> list[tuple[int, int, int]]:
    """Column slices (start, end, segment), short ones first: they give the bound that the others are held to."""
    out, width = [], FIRST_COLUMNS
    for segment, (s, e) in enumerate(zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist())):
        while s < e:
            out.append((s, min(s + width, e), segment))
            s, width = s + width, min(2 * width, KERNEL_CHUNK)
    return out


def _chunks(rows, as_type=np.float64):
    for at in range(0, len(rows), CHUNK):
        yield at, rows[at:at + CHUNK].astype(as_type, copy=False)


def _single(rows) -> np.ndarray:
    out = np.empty(rows.shape, np.float32)
    for at, m in _chunks(rows, np.float32):
        out[at:at + len(m)] = m
    return out


def _greatest_square(rows) -> float:
    return max((float(np.fmax.reduce(np.einsum("ij,ij->i", m, m))) for _, m in _chunks(rows)), default=0.0)


class _Picked:
    """Rows of a side in another order, read where they are needed."""

    def __init__(self, rows, at: np.ndarray):
        self.rows, self.at, self.shape = rows, at, (len(at), rows.shape[1])

    def __len__(self) -> int:
        return len(self.at)

    def __getitem__(self, some) -> np.ndarray:
        return self.rows[self.at[some]]


def _true_places(mask: np.ndarray, size: int) -> np.ndarray:
    """Places of the true ones among the first ``size`` of ``mask`` (8 longer), of which few are true: words of 8 are
    looked at first."""
    whole = -(-size // 8) * 8
    mask[size:whole] = False
    words = np.flatnonzero(mask[:whole].view(np.uint64) != 0)
    word, at = np.nonzero(mask[:whole].reshape(-1, 8)[words])
    return words[word] * 8 + at


def _make_kernel(k, qid, did, qvec, dvec, qex, dex, out_cols, distance, rings=None):
    """The k nearest rows of a block per query of a block.

    Products are taken in single precision, and only pairs that may beat the k-th distance so far (the
    rounding error of the product is bounded) are taken again in double precision, from which
    all results come.  Rows are sorted by id, so that a later row of equal distance never wins.
    ``rings`` (columns ``_ring`` of rows, ``_bound`` of queries): rings of rows that cannot hold a row
    within the bound are skipped.

    The kernel takes and returns pandas frames or Arrow tables."""
    offset, digits = distance.OFFSET, distance.DIGITS

    def double(products: np.ndarray) -> np.ndarray:
        out = offset - products
        return np.round(out, digits) if digits is not None else out

    def vectors(table, name):
        return table.column(name).combine_chunks() if isinstance(table, pa.Table) else table[name]

    def values(table, name):
        return (table.column(name).to_pandas() if isinstance(table, pa.Table) else table[name]).to_numpy()

    def result(qs, ds, of_q, of_d, near):
        if isinstance(qs, pa.Table):
            return pa.table([qs.column(qid).take(pa.array(of_q)), ds.column(did).take(pa.array(of_d)), pa.array(near)], out_cols)
        return pd.DataFrame({out_cols[0]: values(qs, qid)[of_q], out_cols[1]: values(ds, did)[of_d], out_cols[2]: near})

    def kernel(qs, ds, limits=None):
        if limits is not None:
            return search(qs, ds, limits)
        return result(qs, ds, *search(qs, ds, None))

    def search(qs, ds, limits):
        """Places of the queries and of the rows, and distances.  ``limits``: rows farther than a query's are not wanted."""
        if len(qs) == 0 or len(ds) == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        cell = int(values(qs, "_list")[0])
        dids = values(ds, did)
        codes = np.argsort(np.argsort(dids, kind="stable"), kind="stable")
        dx = values(ds, dex) if dex else None
        qx = values(qs, qex) if qex else None
        Q, D = distance.queries(vectors(qs, qvec), cell), distance.rows(vectors(ds, dvec), cell)
        longest = math.sqrt(_greatest_square(Q))
        largest = longest * math.sqrt(_greatest_square(D))
        largest = largest if math.isfinite(largest) else 1.0
        # n roundings of a sum of n products and of their factors, the bound's own, half a digit.
        slack = (D.shape[1] + 16) * 2.0 ** -24 * max(1.0, abs(offset), largest)
        slack += 0.0 if digits is None else 0.51 * 10.0 ** -digits
        found = []

        def keep(best, at, rows=None):
            some = np.isfinite(best.values.ravel())
            near = best.at.ravel()[some]
            found.append((np.repeat(np.arange(len(best.values)) + at, k)[some], near if rows is None else rows[near], best.values.ravel()[some]))

        def boxed() -> int:
            """Search by boxes; the number of queries done, all of them unless too little can be skipped."""
            if rings or len(D) < knn_boxes.LEAST_ROWS or len(Q) < knn_boxes.LEAST_QUERIES or not math.isfinite(longest):
                return 0
            boxes = knn_boxes.Boxes(D, Q, _chunks)
            rows32, done = _single(_Picked(D, boxes.place.ravel())), 0
            while done < len(Q):
                q = Q[done:done + knn_boxes.QUERIES]
                best = _Best(len(q), k, codes)

                def exact(r, c):
                    v = double(np.einsum("ij,ij->i", q[r], D[c]))
                    if qx is not None:
                        v[qx[done + r] == dx[c]] = np.inf
                    return np.where(np.isfinite(v), v, np.inf)

                given = None if limits is None else limits[done:done + len(q)]
                if not knn_boxes.search(boxes, rows32, q, k, best, exact, offset, slack, longest, _true_places, given):
                    break
                keep(best, done)
                done += len(q)
            return done

        done = boxed()
        if done == len(Q):
            return tuple(np.concatenate(x) for x in zip(*found))
        order = np.lexsort((codes, values(ds, "_ring"))) if rings else np.argsort(codes, kind="stable")
        codes, dx = codes[order], dx[order] if dex else None
        D = D.ordered(order) if isinstance(D, _Units) else D[order]
        ends, ring_ids = np.array([len(D)]), None
        if rings:
            ring_ids, starts = np.unique(values(ds, "_ring")[order], return_index=True)
            ends, bounds = np.append(starts[1:], len(D)), values(qs, "_bound").astype(np.float64)
        spans, D32 = _spans(ends), _single(D)
        buffer, mask = np.empty(QUERY_CHUNK * KERNEL_CHUNK, np.float32), np.empty(QUERY_CHUNK * KERNEL_CHUNK + 8, bool)

        def at_least(least, a, b):
            """Number of pairs whose ``a . b`` reaches the query's ``least``, true in ``mask``."""
            size, shape = len(a) * len(b), (len(a), len(b))
            products = np.matmul(a, b.T, out=buffer[:size].reshape(shape))
            return np.count_nonzero(np.greater_equal(products, least[:, None], out=mask[:size].reshape(shape)))

        for at in range(done, len(Q), QUERY_CHUNK):
            q = Q[at:at + QUERY_CHUNK]
            q32, best, everyone = q.astype(np.float32), _Best(len(q), k, codes), np.arange(len(q))
            limit, waiting, seen, due = np.full(len(q), np.inf), [], 0, 0
            if limits is not None and not rings:
                limit = np.nextafter(limits[at:at + QUERY_CHUNK], np.inf)       # one of equal distance may be wanted
            if rings:
                limit = bounds[at:at + QUERY_CHUNK] if limits is None else np.minimum(bounds[at:at + QUERY_CHUNK], limits[at:at + QUERY_CHUNK])
                wanted = rings.value.nearest_possible(q, ring_ids) <= limit[:, None] + rings.value.MARGIN
            for s, e, segment in spans:
                rows = everyone if not rings else np.flatnonzero(wanted[:, segment])
                if not len(rows):
                    continue
                least = (offset - limit[rows] - slack).astype(np.float32)
                part = q32 if len(rows) == len(q) else q32[rows]
                hits = at_least(least, part, D32[s:e])
                if hits > DENSE * len(rows) * (e - s):
                    # Many that may win: all in double precision, the slice's own k smallest.
                    dist = double(q[rows] @ D[s:e].T)
                    if qx is not None:
                        dist[qx[at + rows, None] == dx[None, s:e]] = np.inf
                    dist = np.where(np.isfinite(dist), dist, np.inf)
                    smallest = dist.min(axis=1)
                    some = np.flatnonzero(smallest <= limit[rows] if rings else smallest < limit[rows])
                    cols = _smallest(dist[some], k)
                    v, r, c = np.take_along_axis(dist[some], cols, axis=1).ravel(), np.repeat(rows[some], cols.shape[1]), cols.ravel() + s
                else:
                    r, c = np.divmod(_true_places(mask, len(rows) * (e - s)), e - s)
                    r, c = rows[r], c + s
                    v = double(np.einsum("ij,ij->i", q[r], D[c]))
                    if qx is not None:
                        v[qx[at + r] == dx[c]] = np.inf
                # Rings are not in the order of ids: there, rows of equal distance stay.
                good = (v <= limit[r] if rings else v < limit[r]) & np.isfinite(v)
                waiting.append((r[good], c[good], v[good]))
                seen += e - s
                if seen >= due or (s, e, segment) == spans[-1] or sum(len(w[0]) for w in waiting) > 64 * len(q):
                    best.add(*(np.concatenate(x) for x in zip(*waiting)))
                    limit, waiting, due = np.minimum(limit, best.values[:, -1]), [], 2 * seen
            if waiting:
                best.add(*(np.concatenate(x) for x in zip(*waiting)))
            keep(best, at, order)
        return tuple(np.concatenate(x) for x in zip(*found))
    return kernel


def _through_files(files, kernel, k: int, qid: str, did: str, out_cols: list[str]):
    """For ``mapInArrow``: the k nearest rows, over all ``files`` (list, file; shared), of the queries of a task.  The files
    are read one after the other, each held to the k-th distances found in those before.  Queries with a column
    ``_lists`` are compared with the files of these lists only."""

    def run(batches):
        given = [b for b in batches if b.num_rows]
        if not given:
            return
        qs, of_list = pa.Table.from_batches(given).combine_chunks(), None
        if "_lists" in qs.column_names:
            lists = qs.column("_lists").combine_chunks()
            one = np.repeat(np.arange(len(qs), dtype=np.int32), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            own = lists.flatten().to_numpy(zero_copy_only=False)
            order = np.argsort(own, kind="stable")
            names, starts = np.unique(own[order], return_index=True)
            of_list = dict(zip(names.tolist(), np.split(one[order], starts[1:])))
            qs = qs.drop_columns(["_lists"])
        limits, rows, near, ids = np.full(len(qs), np.inf), np.zeros(0, np.int64), np.zeros(0), None
        for name, uri in files.value:
            some = np.arange(len(qs)) if of_list is None else of_list.get(name, ())
            if not len(some):
                continue
            part = qs if of_list is None else qs.take(pa.array(some))
            if "_list" not in part.column_names:
                part = part.append_column("_list", pa.array(np.full(len(part), name, np.int64)))
            store, path = pafs.FileSystem.from_uri(uri)
            ds = pq.read_table(path, filesystem=store, partitioning=None).combine_chunks()
            r, c, v = kernel(part, ds, limits[some])
            if not len(r):
                continue
            found = ds.column(did).combine_chunks().take(pa.array(c))
            rows, near = np.concatenate([rows, some[r]]), np.concatenate([near, v])
            ids = found if ids is None else pa.concat_arrays([ids, found])
            codes = np.argsort(np.argsort(ids.to_pandas().to_numpy(), kind="stable"), kind="stable")
            order = np.lexsort((codes, near, rows))
            sorted_rows = rows[order]
            order = order[np.arange(len(order)) - np.searchsorted(sorted_rows, sorted_rows) < k]
            rows, near, ids = rows[order], near[order], ids.take(pa.array(order))
            n = np.bincount(rows, minlength=len(qs))
            limits[n == k] = near[(np.cumsum(n) - 1)[n == k]]
        if ids is not None:
            hits = [qs.column(qid).combine_chunks().take(pa.array(rows)), ids, pa.array(near)]
            yield from pa.table(hits, out_cols).to_batches(max_chunksize=FOUND_ROWS)
    return run


def _files_of(df: DataFrame, parts: int | dict[int, int]) -> list[tuple[int, str]] | None:
    """``df`` stored in about ``parts`` files of equal size, or that many per list (column ``_list``), as (list, file); None
    where Python cannot open them."""
    path = new_folder(df.sparkSession, "blocks")
    if isinstance(parts, dict):
        n = df.sparkSession.createDataFrame(list(parts.items()), "_list bigint, _parts bigint")      # one row per list
        cut = (df.join(F.broadcast(n), "_list").withColumn("_part", F.pmod(F.xxhash64("_did"), F.col("_parts")))
               .drop("_parts"))
        cut.repartition("_list", "_part").write.partitionBy("_list", "_part").parquet(path)
    else:
        df.repartition(parts).write.parquet(path)
    files = sorted(df.sparkSession.read.parquet(path).inputFiles()) if not isinstance(parts, dict) or parts else []
    try:
        for uri in files[:1]:
            pafs.FileSystem.from_uri(uri)
    except (pa.ArrowException, OSError):
        return None
    return [(int(uri.split("/_list=")[1].split("/")[0]) if isinstance(parts, dict) else 0, uri) for uri in files]


def _type_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def blocked_knn(queries: DataFrame, index: DataFrame, k: int, *,
                query_id: str, index_id: str,
                query_vector: str = "embedding", index_vector: str = "embedding",
                query_list: str | None = None, query_lists: str | None = None, index_list: str | None = None,
                exclude: tuple[str, str] | None = None,
                block_rows: int | None = None, block_bytes: int | None = None,
                distance_col: str = "distance", materialize: bool = True,
                list_rows: dict[int, int] | None = None, dim: int = 0, distance=Cosine(), rings=None) -> DataFrame:
    """k nearest index rows per query within matching lists: ``query_list`` names a column with a list,
    ``query_lists`` one with an array of lists (each once; the rows should be stored).

    Returns ``(query_id, index_id, distance, rank)`` with ``rank`` 1..k,
    ordered by (distance rounded to 6 digits, index id).  ``exclude=(q, d)``
    drops pairs whose ``q`` and ``d`` columns are equal (a point and itself).
    Rows with a null vector are near nothing: such queries have no hits.
    ``block_rows`` sets the rows per block; by default blocks hold
    ``block_bytes`` of vectors (``BLOCK_BYTES``; ``QUERY_BYTES`` and ``INDEX_BYTES`` where there is one list).  ``materialize=False`` is for inputs that are stored
    already; ``list_rows`` gives the index rows of every list where they are known (with
    the length ``dim`` of the vectors), so that they are not counted.  ``distance``
    makes vectors of a group's rows; other index columns than vectors need it.  ``rings`` (shared;
    see :mod:`knn_pruned`) skips parts of a block by the columns ``_bound`` and ``_ring``.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    qex, dex = exclude if exclude else (None, None)
    qcols = [F.col(query_id).alias("_qid"), F.col(query_vector).alias("_qv"),
             F.col(query_lists).cast("array<bigint>").alias("_lists") if query_lists else
             (F.col(query_list) if query_list else F.lit(0)).cast("long").alias("_list")]
    dcols = [F.col(index_id).alias("_did"), F.col(index_vector).alias("_dv"),
             (F.col(index_list) if index_list else F.lit(0)).cast("long").alias("_list")]
    if qex:
        qcols.append(F.col(qex).alias("_qex"))
        dcols.append(F.col(dex).alias("_dex"))
    if rings:
        qcols.append(F.col("_bound"))
        dcols.append(F.col("_ring"))
    queries = queries.where(F.col(query_vector).isNotNull())
    index = index.where(F.col(index_vector).isNotNull())
    # Materialise the narrow projections once (Parquet in the shared
    # checkpoint folder): the block-size counts below and the cogroup
    # then read them instead of recomputing the upstream plans.
    q = cut_lineage(queries.select(*qcols)) if materialize else queries.select(*qcols)
    d = cut_lineage(index.select(*dcols)) if materialize else index.select(*dcols)

    files, one_group, readers = None, False, 1

    def blocks(rows, width, most=BLOCK_BYTES):
        """Blocks that ``rows`` vectors of ``width`` numbers are split into."""
        return F.ceil(rows / block_rows if block_rows else rows * width * 8 / (block_bytes or most))

    tasks = default_parallelism(queries.sparkSession)
    if query_lists:
        # One row per list, counted from the arrays alone.
        per = q.select(F.explode("_lists").alias("_list")).groupBy("_list").count().collect()
        n_q, width = q.agg(F.count(F.lit(1)), F.max(F.size("_qv"))).first()
        n_of = list_rows if list_rows is not None else {r[0]: r[1] for r in d.groupBy("_list").count().collect()}
        size = lambda n: max(1, math.ceil(n / block_rows if block_rows else n * (width or 1) * 8 / (block_bytes or BLOCK_BYTES)))
        copies = sum(n * size(n_of.get(c, 0)) + n_of.get(c, 0) * size(n) for c, n in per)
        if copies > COPIES * (n_q + sum(n_of.values())):
            files = _files_of(d, {c: size(n_of[c]) for c, _ in per if n_of.get(c)})
            readers = math.ceil(n_q / block_rows if block_rows else n_q * (width or 1) * 8 / READER_BYTES)
        if files is None:
            q = q.withColumn("_list", F.explode("_lists")).drop("_lists")
    if files is not None:
        pass
    elif query_list is None and query_lists is None and index_list is None:
        # Single list: the block counts are two scalars.  Enough blocks for the
        # memory bound, and at least ~sqrt(parallelism) per side (not below
        # MIN_BLOCK_ROWS rows) so mid-size inputs still spread over the cluster.
        side = max(1, math.isqrt(default_parallelism(queries.sparkSession)))
        n, counts, rows = F.count(F.lit(1)), [], []
        for df, vector, most in ((q, "_qv", QUERY_BYTES), (d, "_dv", INDEX_BYTES)):
            spread = F.least(F.lit(side), F.floor(n / MIN_BLOCK_ROWS))
            found = df.agg(F.greatest(F.lit(1), blocks(n, F.max(F.size(vector)), most), spread), n,
                           blocks(n, F.max(F.size(vector)), READER_BYTES)).first()
            counts.append(found[0])
            rows.append(found[1])
            readers = found[2] or 1 if vector == "_qv" else readers
        if rows[0] * counts[1] + rows[1] * counts[0] > COPIES * sum(rows):
            files = _files_of(d, counts[1])
        one_group = counts == [1, 1]
        nqb, ndb = (F.lit(c).cast("long") for c in counts)
        q = q.withColumns({"_nqb": nqb, "_ndb": ndb})
        d = d.withColumns({"_nqb": nqb, "_ndb": ndb})
    else:
        def per_list(df, vector, out):
            return df.groupBy("_list").agg(blocks(F.count(F.lit(1)), F.max(F.size(vector))).cast("long").alias(out))
        if list_rows is None:
            index_sizes = per_list(d, "_dv", "_ndb")
        else:
            known = queries.sparkSession.createDataFrame(list(list_rows.items()), "_list bigint, _rows bigint")
            index_sizes = known.select("_list", blocks(F.col("_rows"), F.lit(dim)).cast("long").alias("_ndb"))
        sizes = per_list(q, "_qv", "_nqb").join(index_sizes, "_list").select(
            "_list", F.greatest(F.lit(1), "_nqb").alias("_nqb"), F.greatest(F.lit(1), "_ndb").alias("_ndb"))
        # One row per list: bounded by the number of lists, not by the data.
        sizes = F.broadcast(sizes)
        q = q.join(sizes, "_list")
        d = d.join(sizes, "_list")

    if files is None:
        qx = (q.withColumn("_qb", F.pmod(F.xxhash64("_qid"), F.col("_nqb")))
              .withColumn("_db", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_ndb") - 1)))
              .drop("_nqb", "_ndb"))
        dx = (d.withColumn("_db", F.pmod(F.xxhash64("_did"), F.col("_ndb")))
              .withColumn("_qb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nqb") - 1)))
              .drop("_nqb", "_ndb"))

    out_cols = [query_id, index_id, distance_col]
    schema = (f"`{query_id}` {_type_of(queries, query_id)}, "
              f"`{index_id}` {_type_of(index, index_id)}, `{distance_col}` double")
    ship_package(queries.sparkSession)
    kernel = _make_kernel(k, "_qid", "_did", "_qv", "_dv",
                          "_qex" if qex else None, "_dex" if dex else None, out_cols, distance, rings)
    keys = ["_list", "_qb", "_db"]
    if files is not None:
        held = shared_value(queries.sparkSession, files)
        local = (q.drop("_nqb", "_ndb").repartition(max(1, -(-readers // tasks)) * tasks)
                 .mapInArrow(_through_files(held, kernel, k, "_qid", "_did", out_cols), schema))
    else:
        pairs = qx.groupBy(*keys).cogroup(dx.groupBy(*keys))
        # One group of small sides passes as frames; larger ones stay Arrow columns.
        apply = pairs.applyInPandas if one_group and sum(rows) <= FRAME_ROWS else pairs.applyInArrow
        local = apply(lambda qs, ds: kernel(qs, ds), schema)

    w = Window.partitionBy(query_id).orderBy(F.col(distance_col), F.col(index_id))
    return (local.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k))


PRUNE_PAIRS = 1 << 30       # pairs from which a search is worth a look at the data


def knn_exact(queries: DataFrame, index: DataFrame, k: int, *,
              query_id: str, index_id: str,
              query_vector: str = "embedding", index_vector: str = "embedding",
              exclude: tuple[str, str] | None = None,
              block_rows: int | None = None, materialize: bool = True,
              prune: bool | None = None, report: dict | None = None) -> DataFrame:
    """Exact k-NN by cosine distance; fewer than k rows when the index is
    small.  Cost is at most |Q|*|D| multiply-adds, spread over bounded blocks;
    parts of the index that cannot hold a neighbour are skipped
    (:mod:`knn_pruned`), by default in searches of ``PRUNE_PAIRS`` pairs or more
    where a sample shows that it pays.  ``prune`` forces or forbids it; query ids must
    then be distinct.  ``materialize=False`` is for inputs that are stored already."""
    from scoutline.operators.knn_pruned import pruned_knn

    ids = {"query_id": query_id, "index_id": index_id, "query_vector": query_vector, "index_vector": index_vector,
           "exclude": exclude, "block_rows": block_rows}
    if k <= 0:
        raise ValueError("k must be positive")
    if materialize:
        queries = cut_lineage(queries.select(*dict.fromkeys([query_id, query_vector, *(exclude or ())[:1]])))
        index = cut_lineage(index.select(*dict.fromkeys([index_id, index_vector, *(exclude or ())[1:]])))
    if prune is None:
        prune = queries.count() * index.count() >= PRUNE_PAIRS
        always = False
    else:
        always = prune
    if prune:
        return pruned_knn(queries, index, k, always=always, report=report, **ids)
    return blocked_knn(queries, index, k, materialize=False, **ids)


def overfetch(num_matches: int) -> int:
    """Hits retrieved before re-ranking: twice the matches returned."""
    return 2 * num_matches


# --------------------------------------------------------------------------
# Approximate search: inverted file over k-means cells.
# --------------------------------------------------------------------------

class _Held:
    """Stand-in for a broadcast variable where none exists (Spark Connect):
    the bounded centroid matrix travels in the closure instead."""

    def __init__(self, value):
        self.value = value


def _probe_fn(cells, n_probe: int, need: int, qvec: str):
    """The cells to search per query, as an array: the ``n_probe`` nearest, and further ones
    until they hold ``need`` rows.  ``cells`` holds (centroids, rows per cell, ids)
    and arrives as a broadcast variable (fetched once per executor)."""

    def probe(batches):
        c, sizes, ids = cells.value
        cn = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
        for pdf in batches:
            if len(pdf) == 0:
                continue
            order = np.argsort(-(_stack(pdf[qvec]) @ cn.T), axis=1, kind="stable")
            held = np.cumsum(sizes[order], axis=1)
            n = np.minimum(np.maximum(n_probe, (held < need).sum(axis=1) + 1), len(cn))
            yield pdf.assign(_lists=[ids[o[:m]] for o, m in zip(order, n)])
    return probe


def shared_value(spark, value):
    """A broadcast variable of ``value``, which is bounded by a parameter."""
    sc = _context(spark)
    return sc.broadcast(value) if sc is not None else _Held(value)


def ivf_train(index: DataFrame, *, index_vector: str = "embedding", n_lists: int, seed: int = 42,
              max_iter: int = 10, train_rows_per_list: int = 256) -> np.ndarray:
    """Centroids of the coarse quantizer: distributed k-means over unit vectors of a
    random sample of about ``n_lists * train_rows_per_list`` rows.  ``n_lists`` is the
    caller's choice, about sqrt(|D|); it sets cell size and recall, so it never changes
    by itself."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from scoutline.functions.vectors import l2_normalize

    rows = index.where(F.col(index_vector).isNotNull()).select(index_vector)
    n, wanted = rows.count(), n_lists * train_rows_per_list
    if n == 0:
        return np.zeros((0, 0))
    some = rows if n <= wanted else rows.sample(wanted / n, seed=seed)
    # k-means reads its input once per iteration: store the sample.
    train = cut_lineage(some.select(array_to_vector(l2_normalize(index_vector)).alias("_feat")))
    model = KMeans(k=n_lists, seed=seed, maxIter=max_iter, featuresCol="_feat", predictionCol="_list").fit(train)
    return np.array([np.asarray(c, dtype=np.float64) for c in model.clusterCenters()])


def nearest_cell(spark, centroids: np.ndarray, ids: np.ndarray | None = None):
    """A function of a vector column: the id of the nearest centroid.  The centroid matrix
    (``n_lists x dim``) is the only thing shipped to tasks, the vectors the only thing
    that crosses to Python."""
    ids = np.arange(len(centroids)) if ids is None else ids
    held = shared_value(spark, (centroids, ids))
    ship_package(spark)

    @F.arrow_udf("bigint")
    def cell(vectors: pa.Array) -> pa.Array:
        c, names = held.value
        units = _stack(vectors)
        if not len(units):
            return pa.array([], pa.int64())
        return pa.array(names[(units @ c.T - (c * c).sum(axis=1) / 2).argmax(axis=1)])
    return cell


def ivf_assign(index: DataFrame, *, index_vector: str = "embedding", n_lists: int, seed: int = 42,
               max_iter: int = 10, train_rows_per_list: int = 256):
    """Train the coarse quantizer and tag every index row with its cell.  Returns
    (tagged index, centroids, rows per cell); rows with a null vector are left out.
    ``index`` is read several times and should be stored; it is not stored again."""
    rows = index.where(F.col(index_vector).isNotNull())
    centroids = ivf_train(index, index_vector=index_vector, n_lists=n_lists, seed=seed, max_iter=max_iter,
                          train_rows_per_list=train_rows_per_list)
    if not len(centroids):
        return rows.withColumn("_list", F.lit(0).cast("long")), centroids, np.zeros(0, np.int64)
    tagged = rows.withColumn("_list", nearest_cell(index.sparkSession, centroids)(F.col(index_vector)))
    sizes = np.zeros(len(centroids), np.int64)
    for cell, n in tagged.groupBy("_list").count().collect():      # one row per cell
        sizes[cell] = n
    return tagged, centroids, sizes


def probe_cells(queries: DataFrame, centroids: np.ndarray, sizes: np.ndarray, *, n_probe: int, need: int,
                query_vector: str, columns: list[str], ids: np.ndarray | None = None, nested: bool = False) -> DataFrame:
    """One row per query and cell to search (``columns`` and ``_list``); ``nested``: one per query, with the array ``_lists``."""
    q = queries.where(F.col(query_vector).isNotNull()).select(*dict.fromkeys(columns))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in q.schema.fields)
    if len(centroids) == 0:
        return queries.sparkSession.createDataFrame([], schema + (", `_lists` array<bigint>" if nested else ", `_list` bigint"))
    ship_package(queries.sparkSession)
    # n_lists x dim doubles: bounded by the n_lists parameter.
    ids = np.arange(len(centroids)) if ids is None else ids
    cells = shared_value(queries.sparkSession, (centroids, sizes, ids))
    # A vector crosses to Python and back once; its copies per cell are made by the JVM.
    probed = q.mapInPandas(_probe_fn(cells, n_probe, need, query_vector), schema + ", `_lists` array<bigint>")
    return probed if nested else probed.withColumn("_list", F.explode("_lists")).drop("_lists")


def known_lists(sizes: np.ndarray, dim: int, ids: np.ndarray | None = None) -> dict:
    """Arguments of ``blocked_knn`` for cells whose sizes are known."""
    ids = np.arange(len(sizes)) if ids is None else ids
    return {"list_rows": {int(c): int(n) for c, n in zip(ids, sizes)}, "dim": dim} if len(sizes) else {}


def knn_approx(queries: DataFrame, index: DataFrame, k: int, *,
               query_id: str, index_id: str,
               query_vector: str = "embedding", index_vector: str = "embedding",
               exclude: tuple[str, str] | None = None,
               n_lists: int, n_probe: int = 8, seed: int = 42,
               block_rows: int | None = None, materialize: bool = True) -> DataFrame:
    """Approximate k-NN (IVF-flat): each query searches the ``n_probe`` cells
    nearest to it, exactly, and further cells where these hold fewer than k
    rows (k + 1 with ``exclude``, whose index column must be unique for k hits
    to be certain).  Same output as ``knn_exact``.  Trains its cells on every
    call; ``ann_index`` stores them.  ``materialize=False`` is for an index that is
    stored already.
    """
    if materialize:
        index = cut_lineage(index.select(*dict.fromkeys([index_id, index_vector, *(exclude or ())[1:]])))
    tagged, centroids, sizes = ivf_assign(index, index_vector=index_vector, n_lists=n_lists, seed=seed)
    probes = cut_lineage(probe_cells(queries, centroids, sizes, n_probe=n_probe, need=k + bool(exclude),
                                     query_vector=query_vector, columns=[query_id, query_vector, *(exclude or ())[:1]],
                                     nested=True))
    return blocked_knn(probes, tagged, k, materialize=False, **known_lists(sizes, centroids.shape[1]),
                       query_id=query_id, index_id=index_id,
                       query_vector=query_vector, index_vector=index_vector,
                       query_lists="_lists", index_list="_list", exclude=exclude, block_rows=block_rows)
