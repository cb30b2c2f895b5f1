"""Pruned exact search: equal to the plain one, with most pairs skipped on
clustered data and the plain search where nothing can be skipped."""

import numpy as np
import pytest

from scoutline.operators import knn, knn_pruned

IDS = {"query_id": "qid", "index_id": "did"}


def frame(spark, rows, name):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows],
                                 f"{name} long, embedding array<double>")


def found(df):
    return sorted(tuple(r) for r in df.select("qid", "did", "distance", "rank").collect())


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 16))
    # The first centre holds a third of the rows.
    which = np.where(rng.random(3000) < 0.33, 0, rng.integers(0, 12, 3000))
    vectors = centres[which] + 0.1 * rng.normal(size=(3000, 16))
    vectors[100:130] = vectors[99]                       # ties
    vectors[5] = 0.0
    queries = vectors[::6] + 0.01
    queries[3] = 0.0
    return (frame(spark, [*enumerate(queries), (9_999, None)], "qid"),
            frame(spark, [*enumerate(vectors), (9_999, None)], "did"))


def test_most_pairs_are_skipped_and_none_is_lost(spark, clustered):
    q, d = clustered
    want = found(knn.knn_exact(q, d, 5, prune=False, **IDS))
    report = {}
    assert found(knn.knn_exact(q, d, 5, prune=True, report=report, **IDS)) == want and len(want) == 2_500
    skipped = 1 - report["searched"] / report["pairs"]
    assert report["pruned"] and skipped > 0.5, report
    print(f"skipped {skipped:.3f} of {report['pairs']} pairs")


def test_the_sample_lets_the_search_prune_by_itself(spark, clustered, monkeypatch):
    monkeypatch.setattr(knn, "PRUNE_PAIRS", 1)
    q, d = clustered
    report = {}
    assert found(knn.knn_exact(q, d, 5, report=report, **IDS)) == found(knn.knn_exact(q, d, 5, prune=False, **IDS))
    assert report["pruned"]


def test_self_search_leaves_the_row_out(spark, clustered):
    _, d = clustered
    own = d.withColumnRenamed("did", "qid")
    both = {"exclude": ("qid", "did"), **IDS}
    assert found(knn.knn_exact(own, d, 4, prune=True, **both)) == found(knn.knn_exact(own, d, 4, prune=False, **both))


def test_bad_case_is_the_plain_search(spark, monkeypatch):
    monkeypatch.setattr(knn, "PRUNE_PAIRS", 1)
    rng = np.random.default_rng(1)
    q, d = frame(spark, list(enumerate(rng.normal(size=(60, 48)))), "qid"), frame(spark, list(enumerate(rng.normal(size=(900, 48)))), "did")
    report = {}
    got = knn.knn_exact(q, d, 5, report=report, **IDS)
    want = knn.knn_exact(q, d, 5, prune=False, **IDS)
    assert not report["pruned"] and report["searched"] == report["pairs"]

    def operators(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return [plan.count(x) for x in ("Exchange", "FlatMapCoGroupsInPandas", "Scan parquet", "Window")]

    assert operators(got) == operators(want)
    assert found(got) == found(want)
    assert found(knn.knn_exact(q, d, 5, prune=True, **IDS)) == found(want)


def test_small_and_empty_sides(spark, clustered):
    q, d = clustered
    few = d.where("did < 3")
    assert found(knn.knn_exact(q, few, 5, prune=True, **IDS)) == found(knn.knn_exact(q, few, 5, prune=False, **IDS))
    for a, b in ((q.limit(0), d), (q, d.limit(0)), (q, d.where("did = 5")), (q, d.where("did = 9999"))):
        assert found(knn.knn_exact(a, b, 3, prune=True, **IDS)) == found(knn.knn_exact(a, b, 3, prune=False, **IDS))


def test_rings_bound_the_angle_to_every_row():
    rng = np.random.default_rng(2)
    units = rng.normal(size=(500, 6))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    found_, borders = knn_pruned.centres(units, 20), None
    borders = knn_pruned.ring_borders(units, found_)
    ring, angle = knn_pruned.place(units, found_, borders)
    n = len(found_) * knn_pruned.RINGS + 1
    rows = np.bincount(ring, minlength=n)
    least = np.array([angle[ring == i].min() if rows[i] else 0 for i in range(n)])
    greatest = np.array([angle[ring == i].max() if rows[i] else 0 for i in range(n)])
    possible = knn_pruned.Rings(found_, rows, least, greatest).nearest_possible(units[:50])
    true = 1 - units[:50] @ units.T
    for i in range(n):
        if rows[i]:
            assert (possible[:, i] <= true[:, ring == i].min(axis=1) + 1e-9).all()


def test_a_query_is_shipped_once_per_block(spark, clustered, monkeypatch):
    """Not once per ring: the second search ships a query at most as often as the plain one."""
    shipped = []
    search = knn_pruned.blocked_knn

    def counted(queries, index, k, **kw):
        if "_bound" in queries.columns or kw.get("query_list"):
            shipped.append(queries.count())
        return search(queries, index, k, **kw)

    monkeypatch.setattr(knn_pruned, "blocked_knn", counted)
    rng = np.random.default_rng(8)
    q = frame(spark, list(enumerate(rng.normal(size=(300, 16)))), "qid")
    d = clustered[1]
    got = found(knn.knn_exact(q, d, 5, prune=True, **IDS))
    assert got == found(knn.knn_exact(q, d, 5, prune=False, **IDS))
    assert len(shipped) == 2 and shipped[1] <= 300, shipped       # all rows of the index fit one block


def test_rings_in_several_blocks(spark, clustered):
    q, d = clustered
    assert found(knn.knn_exact(q, d, 5, prune=True, block_rows=100, **IDS)) == found(knn.knn_exact(q, d, 5, prune=False, **IDS))
