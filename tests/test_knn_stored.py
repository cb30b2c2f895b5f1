"""The search whose tasks read the stored index: same rows as the shuffled one."""

import numpy as np
import pytest

from scoutline.operators import knn, knn_boxes

IDS = {"query_id": "qid", "index_id": "did"}


def frame(spark, rng, n, name, kind, seed_rows=None):
    vectors = np.round(rng.normal(size=(n, 8)) if seed_rows is None else seed_rows[rng.integers(len(seed_rows), size=n)], 1)
    rows = [(kind(i), [float(x) for x in v] if i % 17 else None, i % 5) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"{name} {'string' if kind is str else 'bigint'}, embedding array<float>, g int")


def found(df):
    return sorted(map(tuple, df.select("qid", "did", "distance", "rank").collect()), key=repr)


@pytest.mark.parametrize("kind", [int, str])
@pytest.mark.parametrize("boxed", [False, True])
def test_stored_search_equals_the_shuffled_one(spark, monkeypatch, kind, boxed):
    if boxed:
        for name, value in (("LEAST_ROWS", 64), ("LEAST_QUERIES", 16), ("WORTH", 1.0), ("HITS", 1.0)):
            monkeypatch.setattr(knn_boxes, name, value)
    rng = np.random.default_rng(5)
    few = rng.normal(size=(40, 8))                         # many ties
    q, d = frame(spark, rng, 150, "qid", kind), frame(spark, rng, 700, "did", kind, few)
    d = d.withColumnRenamed("g", "h")
    for kw in ({}, {"exclude": ("g", "h")}):
        search = lambda: knn.blocked_knn(q, d, 6, block_rows=100, **IDS, **kw)
        monkeypatch.setattr(knn, "COPIES", 1_000)
        want = found(search())
        monkeypatch.setattr(knn, "COPIES", 0)
        got = search()
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "CoGroups" not in plan
        assert found(got) == want and len(want) == 6 * q.where("embedding IS NOT NULL").count()


def test_vectors_are_not_copied_per_block(spark, monkeypatch):
    """Rows sent through shuffles grow with the sides, not with the number of blocks."""
    rng = np.random.default_rng(6)
    q, d = frame(spark, rng, 400, "qid", int), frame(spark, rng, 400, "did", int)
    plan = knn.blocked_knn(q, d, 3, block_rows=20, **IDS)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan.lower() and "CoGroup" not in plan


def test_fewer_rows_than_k_and_empty_sides(spark, monkeypatch):
    rng = np.random.default_rng(7)
    q, d = frame(spark, rng, 30, "qid", int), frame(spark, rng, 4, "did", int)
    for a, b in ((q, d), (q.limit(0), d), (q, d.limit(0))):
        monkeypatch.setattr(knn, "COPIES", 1_000)
        want = found(knn.blocked_knn(a, b, 6, **IDS))
        monkeypatch.setattr(knn, "COPIES", 0)
        assert found(knn.blocked_knn(a, b, 6, **IDS)) == want


@pytest.mark.parametrize("kind", [int, str])
def test_lists_are_read_like_they_are_shuffled(spark, monkeypatch, kind):
    """IVF cells, and blocks of rings, of which a query searches some."""
    rng = np.random.default_rng(8)
    centres = 3 * rng.normal(size=(12, 8))
    q = frame(spark, rng, 200, "qid", kind, centres)
    d = frame(spark, rng, 900, "did", kind, centres + 0.3 * rng.normal(size=(12, 8))).withColumnRenamed("g", "h").cache()

    def approx():
        return knn.knn_approx(q, d, 5, n_lists=6, n_probe=2, block_rows=50, exclude=("g", "h"), **IDS)

    def pruned():
        return knn.knn_exact(q, d, 5, prune=True, block_rows=50, **IDS)

    for search in (approx, pruned):
        monkeypatch.setattr(knn, "COPIES", 10_000)
        want = search()
        assert "CoGroups" in want._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(knn, "COPIES", 0)
        got = search()
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "CoGroups" not in plan
        assert found(got) == found(want)
    monkeypatch.setattr(knn, "COPIES", 10_000)
    assert found(got) == found(knn.knn_exact(q, d, 5, prune=False, **IDS))
