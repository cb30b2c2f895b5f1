"""Exact nearest neighbours that skip what the triangle inequality rules out.

Angles between unit vectors are a metric.  Index rows are put into cells (nearest of a few
centres) and each cell into rings by the angle to its centre; every ring has a least and a
greatest angle.  A query at angle ``a`` from the centre is at least ``max(a - greatest, least
- a)`` away from all rows of the ring.

1. Centres and ring borders come from a bounded sample of the index (``SAMPLE_BYTES``).  They
   only decide how much is skipped, never what is found: least and greatest angles are taken
   over all rows.  The same sample estimates how much would be skipped; below ``WORTH``
   the plain blocked search runs instead.
2. Every query searches the nearest rings that hold ``k`` rows; its k-th distance so far is an
   upper bound.
3. Only rings whose least possible distance does not exceed the bound are searched.  Before that
   the pairs are counted, and where less than ``WORTH`` of them is skipped the plain search takes over.
   Neighbouring rings share a block of at most :data:`knn.BLOCK_BYTES`; a query is shipped once to each
   block that has a ring for it, as in the plain search, and inside the block its other rings are skipped.

Both searches are :func:`knn.blocked_knn`; a pair (query, ring) that is skipped is never compared.
Only centres and ring angles (``MAX_CELLS`` x rings) go to the tasks.  Zero vectors are at
distance 1 from everything: such rows are a ring of their own, such queries skip nothing.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutline.operators import knn
from scoutline.operators.knn import _stack, blocked_knn, shared_value
from scoutline.session import cut_lineage, ship_package

MAX_CELLS = 1024
RINGS = 4
SAMPLE_BYTES = 32 << 20     # of index vectors on the driver, as doubles
SAMPLE_ROWS = 65_536
SAMPLE_QUERIES = 256
ROUNDS = 6                  # of k-means over the sample
WORTH = 0.5                 # share of pairs to be skipped, else the plain search is cheaper
SLICE = 1024                # queries compared with all rings at a time
MARGIN = 2e-6               # of angles and of distances rounded to 6 digits


# --- geometry ----------------------------------------------------------------

def centres(sample: np.ndarray, n: int, seed: int = 42) -> np.ndarray:
    """``n`` unit vectors near all unit vectors of ``sample``: farthest-first, then rounds of
    k-means on the sphere."""
    if not len(sample):
        return sample
    near, chosen = np.full(len(sample), -2.0), [int(np.random.default_rng(seed).integers(len(sample)))]
    while len(chosen) < min(n, len(sample)):
        near = np.maximum(near, sample @ sample[chosen[-1]])
        far = int(near.argmin())
        if near[far] > 1 - 1e-12:
            break
        chosen.append(far)
    found = sample[chosen].copy()
    for _ in range(ROUNDS):
        cell = (sample @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, cell, sample)
        norms = np.linalg.norm(sums, axis=1)
        found[norms > 1e-9] = sums[norms > 1e-9] / norms[norms > 1e-9, None]
    return found


def angles(units: np.ndarray, found: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ found.T, -1.0, 1.0))


def place(units: np.ndarray, found: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ring number, angle to the centre) of unit vectors; zero vectors are in the last ring."""
    out, angle = np.full(len(units), len(found) * RINGS, np.int64), np.zeros(len(units))
    some = np.flatnonzero((units != 0).any(axis=1))
    if len(some) and len(found):
        a = angles(units[some], found)
        cell = a.argmin(axis=1)
        angle[some] = a[np.arange(len(some)), cell]
        out[some] = cell * RINGS + (angle[some, None] > borders[cell]).sum(axis=1)
    return out, angle


def ring_borders(units: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Inner borders of the rings: quantiles of the sample's angles per cell."""
    a = angles(units, found)
    cell, own = a.argmin(axis=1), a.min(axis=1)
    at = np.arange(1, RINGS) / RINGS
    return np.array([np.quantile(own[cell == c], at) if (cell == c).any() else np.zeros(RINGS - 1)
                     for c in range(len(found))]).reshape(len(found), RINGS - 1)


class Rings:
    """Centres, and rows, least and greatest angle of every ring (the last one holds zero vectors)."""

    def __init__(self, found: np.ndarray, rows: np.ndarray, least: np.ndarray, greatest: np.ndarray):
        self.found, self.rows, self.least, self.greatest = found, rows, least, greatest

    MARGIN = MARGIN

    def nearest_possible(self, units: np.ndarray, rings: np.ndarray | None = None) -> np.ndarray:
        """Least distance that a row of each ring (of ``rings``, by default all) can have to each query."""
        rings = np.arange(len(self.rows)) if rings is None else rings
        out = np.ones((len(units), len(rings)))
        some, real = np.flatnonzero((units != 0).any(axis=1)), np.flatnonzero(rings < len(self.found) * RINGS)
        if len(some) and len(real):
            own = rings[real]
            cells, at = np.unique(own // RINGS, return_inverse=True)
            a = angles(units[some], self.found[cells])[:, at]
            gap = np.maximum(np.maximum(a - self.greatest[own], self.least[own] - a) - MARGIN, 0.0)
            out[np.ix_(some, real)] = 1.0 - np.cos(gap)
        out[:, self.rows[rings] == 0] = np.inf
        return out

    def first(self, units: np.ndarray, need: int) -> list[np.ndarray]:
        """Per query the nearest rings that hold ``need`` rows."""
        possible = self.nearest_possible(units)
        order = np.argsort(possible, axis=1, kind="stable")
        held = np.cumsum(self.rows[order], axis=1)
        n = np.minimum((held < need).sum(axis=1) + 1, (self.rows > 0).sum())
        return [o[:m] for o, m in zip(order, n)]

    def within(self, units: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Whether a ring may hold a row within the query's ``bound``."""
        possible = self.nearest_possible(units)
        return (possible <= bound[:, None] + MARGIN) & np.isfinite(possible)


def blocks_of(rows: np.ndarray, most: int) -> np.ndarray:
    """Block number of every ring: neighbouring rings together, up to about ``most`` rows (a larger ring alone)."""
    out, block, held = np.zeros(len(rows), np.int64), 0, 0
    for ring, n in enumerate(rows.tolist()):
        if held and held + n > most:
            block, held = block + 1, 0
        out[ring], held = block, held + n
    return out


def estimated_share(sample: np.ndarray, queries: np.ndarray, found: np.ndarray, borders: np.ndarray, k: int,
                    rows: int) -> float:
    """Share of the pairs that would be searched, judged from the sample alone."""
    ring, angle = place(sample, found, borders)
    n = len(found) * RINGS + 1
    count = np.bincount(ring, minlength=n)
    least, greatest = np.where(count > 0, np.pi, 0.0), np.zeros(n)
    np.minimum.at(least, ring, angle)
    np.maximum.at(greatest, ring, angle)
    near = max(1, round(k * len(sample) / max(1, rows)))
    bound = np.partition(1.0 - queries @ sample.T, min(near, len(sample)) - 1, axis=1)[:, min(near, len(sample)) - 1]
    possible = Rings(found, count, least, greatest).nearest_possible(queries)
    return float(((possible <= bound[:, None] + MARGIN) * count).sum() / (len(queries) * len(sample)))


# --- Spark -------------------------------------------------------------------

def _sample(df: DataFrame, vector: str, rows: int, wanted: int, seed: int) -> np.ndarray:
    """About ``wanted`` unit vectors, collected (bounded by ``wanted``)."""
    some = df.select(vector)
    some = some if rows <= wanted else some.sample(min(1.0, 1.1 * wanted / rows), seed=seed)
    units = _stack(some.limit(wanted).toPandas()[vector])
    return units[(units != 0).any(axis=1)] if len(units) else units


def _assigned(d: DataFrame, held, vector: str) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields)

    def run(batches):
        found, borders = held.value
        for pdf in batches:
            if len(pdf):
                ring, angle = place(_stack(pdf[vector]), found, borders)
                yield pdf.assign(_list=ring, _angle=angle)
    return d.mapInPandas(run, schema + ", _list bigint, _angle double")


def _first(q: DataFrame, held, vector: str, need: int) -> DataFrame:
    """One row of ``q`` per nearest ring."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in q.schema.fields)

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), SLICE):
                some = pdf.iloc[at:at + SLICE]
                yield some.assign(_lists=[x.astype(np.int64) for x in held.value.first(_stack(some[vector]), need)])
    return q.mapInPandas(run, schema + ", _lists array<bigint>").withColumn("_list", F.explode("_lists")).drop("_lists")


def _rest(q: DataFrame, held, vector: str) -> DataFrame:
    """``q`` with the blocks that have a ring within ``_bound`` (``_lists``) and the rows of those rings (``_pairs``)."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in q.schema.fields)

    def run(batches):
        rings, block = held.value
        for pdf in batches:
            for at in range(0, len(pdf), SLICE):
                some = pdf.iloc[at:at + SLICE]
                wanted = rings.within(_stack(some[vector]), some["_bound"].to_numpy(np.float64))
                yield some.assign(_lists=[np.unique(block[w]) for w in wanted], _pairs=wanted @ rings.rows)
    return q.mapInPandas(run, schema + ", _lists array<bigint>, _pairs bigint")


def pruned_knn(queries: DataFrame, index: DataFrame, k: int, *, query_id: str, index_id: str,
               query_vector: str = "embedding", index_vector: str = "embedding",
               exclude: tuple[str, str] | None = None, block_rows: int | None = None, seed: int = 42,
               always: bool = False, report: dict | None = None) -> DataFrame:
    """Same rows as ``knn_exact``.  Both inputs must be stored (they are read several times)
    and query ids distinct.  ``always`` goes on however little is skipped.  ``report`` receives
    ``pairs``, ``searched`` (pairs of rows compared) and ``pruned`` (False if the plain search ran)."""
    spark, need = queries.sparkSession, k + bool(exclude)
    ids = {"query_id": query_id, "index_id": index_id, "query_vector": query_vector, "index_vector": index_vector,
           "exclude": exclude, "block_rows": block_rows}
    q = queries.select(*dict.fromkeys([query_id, query_vector, *(exclude or ())[:1]])).where(F.col(query_vector).isNotNull())
    d = index.select(*dict.fromkeys([index_id, index_vector, *(exclude or ())[1:]])).where(F.col(index_vector).isNotNull())
    report = {} if report is None else report
    n_q = q.count()
    n_d, dim = d.agg(F.count("*"), F.max(F.size(index_vector))).first()
    report.update(pairs=n_q * n_d, searched=n_q * n_d, pruned=False)

    def plain() -> DataFrame:
        return blocked_knn(q, d, k, materialize=False, **ids)

    if not n_q or not n_d:
        return plain()
    wanted = int(max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * max(dim, 1)))))
    sample = _sample(d, index_vector, n_d, wanted, seed)
    some_queries = _sample(q, query_vector, n_q, SAMPLE_QUERIES, seed)
    found = centres(sample, min(MAX_CELLS, max(1, math.isqrt(n_d) // RINGS), max(1, len(sample) // 8)), seed)
    borders = ring_borders(sample, found) if len(found) else np.zeros((0, RINGS - 1))
    if not always and (not len(found) or not len(some_queries)
                       or estimated_share(sample, some_queries, found, borders, need, n_d) > 1 - WORTH):
        return plain()

    ship_package(spark)
    cells = cut_lineage(_assigned(d, shared_value(spark, (found, borders)), index_vector))
    n = len(found) * RINGS + 1
    rows, least, greatest = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
    for r in cells.groupBy("_list").agg(F.count("*"), F.min("_angle"), F.max("_angle")).collect():     # one row per ring
        rows[r[0]], least[r[0]], greatest[r[0]] = r[1:]
    rings = Rings(found, rows, least, greatest)
    most = block_rows or max(1, knn.BLOCK_BYTES // (8 * max(1, int(dim))))
    block = blocks_of(rows, most)
    held, grouped = shared_value(spark, rings), shared_value(spark, (rings, block))

    def known(sizes):
        return {"list_rows": {i: int(m) for i, m in enumerate(sizes) if m}, "dim": int(dim),
                "index_list": "_list", "materialize": False, **ids}

    first = cut_lineage(_first(q, held, query_vector, need))
    per_ring = F.broadcast(spark.createDataFrame([(i, int(m)) for i, m in enumerate(rows)], "_list bigint, _rows bigint"))
    report["searched"] = first.join(per_ring, "_list").agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    near = blocked_knn(first, cells, k, query_list="_list", **known(rows))
    bounds = near.groupBy(query_id).agg(F.when(F.count("*") >= k, F.max("distance")).alias("_bound"))
    bounded = q.join(bounds, query_id, "left").withColumn("_bound", F.coalesce("_bound", F.lit(3.0)))
    probed = cut_lineage(_rest(bounded, grouped, query_vector))
    rest = probed.agg(F.coalesce(F.sum("_pairs"), F.lit(0))).first()[0]
    if not always and report["searched"] + rest > (1 - WORTH) * report["pairs"]:
        report["searched"] += report["pairs"]
        return plain()
    report["searched"] += rest
    report["pruned"] = True
    of_ring = F.array(*[F.lit(int(b)) for b in block])
    placed = cells.withColumnRenamed("_list", "_ring").withColumn("_list", F.get(of_ring, F.col("_ring").cast("int")))
    return blocked_knn(probed.drop("_pairs"), placed, k, rings=held, query_lists="_lists",
                       **known(np.bincount(block, weights=rows).astype(np.int64)))
