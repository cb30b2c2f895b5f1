"""Boxes of the blocked search: same rows as brute force, few pairs compared."""

import numpy as np
import pandas as pd
import pytest

from scoutline.operators import knn, knn_boxes
from scoutline.session import default_parallelism, spread


def _clustered(rng, n, dim=64, centres=40):
    base = rng.standard_normal((centres, dim)) * (0.7 ** np.arange(dim))
    return (base[rng.integers(centres, size=n)] + 0.05 * rng.standard_normal((n, dim))).astype(np.float32)


def _run(q, d, k, exclude=False):
    qs = pd.DataFrame({"q": np.arange(len(q)), "v": list(q), "_list": 0, "qx": np.arange(len(q)) % 7})
    ds = pd.DataFrame({"d": np.random.default_rng(9).permutation(len(d)), "w": list(d), "dx": np.arange(len(d)) % 7})
    kernel = knn._make_kernel(k, "q", "d", "v", "w", "qx" if exclude else None, "dx" if exclude else None,
                              ["q", "d", "distance"], knn.Cosine())
    out = kernel(qs, ds)
    return qs, ds, out.sort_values(["q", "distance", "d"], ignore_index=True)


def _brute(qs, ds, k, exclude=False):
    a, b = knn._stack(qs["v"]), knn._stack(ds["w"])
    dist = np.round(1.0 - a @ b.T, 6)
    if exclude:
        dist[qs["qx"].to_numpy()[:, None] == ds["dx"].to_numpy()[None]] = np.inf
    rows = []
    for q in range(len(a)):
        best = np.lexsort((ds["d"], dist[q]))[:k]
        rows += [(q, ds["d"][j], dist[q, j]) for j in best if np.isfinite(dist[q, j])]
    return pd.DataFrame(rows, columns=["q", "d", "distance"])


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(knn_boxes, "LEAST_ROWS", 64)
    monkeypatch.setattr(knn_boxes, "LEAST_QUERIES", 16)
    monkeypatch.setattr(knn_boxes, "AT_ONCE", 4)
    searched = []

    def counted(*args):
        searched.append(search(*args))
        return searched[-1]
    search = knn_boxes.search
    monkeypatch.setattr(knn_boxes, "search", counted)
    return searched


@pytest.mark.parametrize("exclude", [False, True])
@pytest.mark.parametrize("n, k", [(1000, 6), (1023, 1), (777, 40)])
def test_boxes_equal_brute_force(small, monkeypatch, n, k, exclude):
    monkeypatch.setattr(knn_boxes, "QUERIES", 64)
    monkeypatch.setattr(knn_boxes, "SLICE", 24)
    monkeypatch.setattr(knn_boxes, "WORTH", 1.0)
    monkeypatch.setattr(knn_boxes, "HITS", 1.0)
    rng = np.random.default_rng(n)
    d, q = _clustered(rng, n), _clustered(rng, 150)
    d[rng.integers(n, size=n // 4)] = d[3]                  # ties
    d[5], q[7] = 0.0, 0.0                                   # no direction
    d[6, 2], q[8, 1] = np.inf, -np.inf                      # near nothing
    q[9] = d[3]
    qs, ds, got = _run(q, d, k, exclude)
    assert small and all(small)
    want = _brute(qs, ds, k, exclude)
    pd.testing.assert_frame_equal(got, want.sort_values(["q", "distance", "d"], ignore_index=True), check_dtype=False)


def test_many_waiting_pairs_are_settled_in_between(small, monkeypatch):
    monkeypatch.setattr(knn_boxes, "WAITING", 50)
    monkeypatch.setattr(knn_boxes, "CHECKED", 7)
    rng = np.random.default_rng(3)
    qs, ds, got = _run(_clustered(rng, 60), _clustered(rng, 900), 6)
    pd.testing.assert_frame_equal(got, _brute(qs, ds, 6), check_dtype=False)


def test_clustered_rows_are_mostly_skipped(small, monkeypatch):
    compared, places = [], knn._true_places

    def counted(mask, size):
        compared.append(size)
        return places(mask, size)
    monkeypatch.setattr(knn, "_true_places", counted)
    rows = _clustered(np.random.default_rng(4), 4200)
    qs, ds, got = _run(rows[:200], rows[200:], 6)
    pd.testing.assert_frame_equal(got, _brute(qs, ds, 6), check_dtype=False)
    assert small == [True] and sum(compared) < 0.3 * 200 * 4000


@pytest.mark.parametrize("same", [False, True])
def test_plain_search_where_boxes_skip_little(small, same):
    rng = np.random.default_rng(5)
    d = rng.standard_normal((900, 64)).astype(np.float32)
    if same:
        d[:] = d[0]
    qs, ds, got = _run(rng.standard_normal((100, 64)).astype(np.float32), d, 6)
    pd.testing.assert_frame_equal(got, _brute(qs, ds, 6), check_dtype=False)
    assert small == [False]


def test_search_given_up_half_way_leaves_nothing(small, monkeypatch):
    monkeypatch.setattr(knn_boxes, "WORTH", 1.0)
    monkeypatch.setattr(knn_boxes, "HITS", 1e-4)
    rng = np.random.default_rng(6)
    qs, ds, got = _run(_clustered(rng, 100), np.repeat(_clustered(rng, 200), 5, axis=0), 6)
    pd.testing.assert_frame_equal(got, _brute(qs, ds, 6), check_dtype=False)
    assert small == [False]


def test_small_file_is_spread(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    wide = spread(table)
    assert wide.rdd.getNumPartitions() >= default_parallelism(spark)
    assert sorted(r.id for r in wide.collect()) == list(range(100))


def test_companies_leave_the_tasks_of_a_small_file(spark, tmp_path):
    from scoutline.plans import roles
    rows = [(i, "red nut", "LARGE", i % 50) for i in range(40)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_size int").coalesce(1) \
        .write.parquet(str(tmp_path / "part.parquet"))
    wide, narrow = (roles.companies(spark, str(tmp_path), as_stored=x) for x in (False, True))
    assert narrow.rdd.getNumPartitions() < default_parallelism(spark) <= wide.rdd.getNumPartitions()
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, narrow.collect()))
