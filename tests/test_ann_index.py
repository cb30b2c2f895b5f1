"""The stored index: exact at full probe, recall at partial probe, k hits where
cells are small, hot cells, nulls and empty tables."""

import numpy as np
import pytest

from scoutline.operators import knn
from scoutline.operators.ann_index import build_ann_index, search_ann_index

IDS = {"query_id": "qid", "index_id": "did"}


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 16))
    # The first centre holds a third of the rows.
    which = np.where(rng.random(900) < 0.33, 0, rng.integers(0, 8, 900))
    vectors = centres[which] + 0.2 * rng.normal(size=(900, 16))
    index = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(1000, None)]
    queries = [(i, (vectors[i] + 0.05).tolist()) for i in range(0, 900, 15)] + [(2000, None)]
    return (spark.createDataFrame(queries, "qid long, embedding array<double>"),
            spark.createDataFrame(index, "did long, embedding array<double>"))


def found(df):
    return sorted(tuple(r) for r in df.select("qid", "did", "distance", "rank").collect())


def test_full_probe_is_exact(spark, clustered, tmp_path):
    q, d = clustered
    path = str(tmp_path / "ann")
    build_ann_index(d, path, index_id="did", n_lists=8)
    want = found(knn.knn_exact(q, d, 5, **IDS))
    assert len(want) == 60 * 5 and 2000 not in {r[0] for r in want}
    for rows in (None, 50):         # 50: the hot cell is split into many blocks
        assert found(search_ann_index(spark, path, q, 5, n_probe=8, block_rows=rows, **IDS)) == want
    part = {r[:2] for r in found(search_ann_index(spark, path, q, 5, n_probe=1, **IDS))}
    assert len(part & {r[:2] for r in want}) / len(want) >= 0.9


def test_small_cells_are_widened(spark, clustered, tmp_path):
    q, d = clustered
    path = str(tmp_path / "ann")
    small = d.where("did % 9 = 0")
    build_ann_index(small, path, index_id="did", n_lists=50)
    hits = search_ann_index(spark, path, q, 20, n_probe=1, **IDS).groupBy("qid").count().collect()
    assert len(hits) == 60 and {r["count"] for r in hits} == {20}
    assert {r["count"] for r in knn.knn_approx(q, small, 20, n_lists=50, n_probe=1, **IDS).groupBy("qid").count().collect()} == {20}


def test_sampled_training_assigns_every_row(spark, clustered):
    _, d = clustered
    tagged, centroids, sizes = knn.ivf_assign(d, n_lists=8, train_rows_per_list=20)
    assert tagged.count() == 900 == sizes.sum() and len(centroids) == len(sizes)


def test_empty_sides(spark, clustered, tmp_path):
    q, d = clustered
    path = str(tmp_path / "ann")
    build_ann_index(d, path, index_id="did", n_lists=4)
    assert found(search_ann_index(spark, path, q.limit(0), 3, n_probe=2, **IDS)) == []
    build_ann_index(d.limit(0), str(tmp_path / "none"), index_id="did", n_lists=4)
    assert found(search_ann_index(spark, str(tmp_path / "none"), q, 3, n_probe=2, **IDS)) == []
    assert found(knn.knn_exact(q, d.limit(0), 3, **IDS)) == []
