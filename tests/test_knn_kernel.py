"""The kernel of the blocked search: equal to a plain computation, cheaper than it, bounded by its vectors."""

import time
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from scoutline.operators import ann_codes, knn


def sides(q, d, ids):
    return (pd.DataFrame({"_qid": np.arange(len(q)), "_qv": list(q), "_list": 0, "_qex": np.arange(len(q))}),
            pd.DataFrame({"_did": ids, "_dv": list(d), "_list": 0, "_dex": ids}))


def plain(q, d, ids, k, exclude):
    units = [x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) > 0, n, 1) for x in (q.astype(float), d.astype(float))]
    dist = np.round(1 - units[0] @ units[1].T, 6)
    if exclude:
        dist[np.arange(len(q))[:, None] == ids[None]] = np.inf
    out = []
    for i, row in enumerate(dist):
        out += [(i, int(ids[j]), round(row[j], 6)) for j in np.lexsort((ids, row))[:k] if np.isfinite(row[j])]
    return out


@pytest.mark.parametrize("exclude", [False, True])
@pytest.mark.parametrize("kind", ["normal", "counts", "equal"])
def test_same_rows_as_a_plain_computation(kind, exclude):
    rng = np.random.default_rng(3)
    make = {"normal": lambda n: rng.normal(size=(n, 24)), "equal": lambda n: np.ones((n, 24)),
            "counts": lambda n: rng.integers(0, 2, (n, 5)) @ rng.integers(0, 2, (5, 24))}[kind]
    q, d, ids = make(600).astype(np.float32), make(5_000).astype(np.float32), rng.permutation(5_000)
    q[7], d[11] = 0, 0
    a, b = sides(q, d, ids)
    kernel = knn._make_kernel(4, "_qid", "_did", "_qv", "_dv", *(("_qex", "_dex") if exclude else (None, None)),
                              ["q", "d", "v"], knn.Cosine())
    got = sorted((r.q, r.v, r.d) for r in kernel(a, b).itertuples())
    assert [(x, z, round(y, 6)) for x, y, z in got] == [(x, y, z) for x, y, z in plain(q, d, ids, 4, exclude)]


def test_cheaper_than_all_pairs_in_double_precision():
    rng = np.random.default_rng(4)
    q, d = rng.normal(size=(2_048, 64)), rng.normal(size=(32_768, 64))
    a, b = sides(q.astype(np.float32), d.astype(np.float32), np.arange(len(d)))
    kernel = knn._make_kernel(6, "_qid", "_did", "_qv", "_dv", None, None, ["q", "d", "v"], knn.Cosine())

    def all_pairs():
        for s in range(0, len(d), 2_048):
            np.argpartition(np.round(1 - q @ d[s:s + 2_048].T, 6), 13, axis=1)

    def seconds(run):
        best = np.inf
        for _ in range(3):
            began = time.perf_counter()
            run()
            best = min(best, time.perf_counter() - began)
        return best

    assert seconds(lambda: kernel(a, b)) < 0.6 * seconds(all_pairs)


def test_code_groups_hold_vectors_only():
    class Held:
        rng = np.random.default_rng(5)
        books = rng.normal(size=(16, ann_codes.WORDS, 4)) / 8
        value = (books, {0: rng.normal(size=64)})

    books, centre = Held.value[0], Held.value[1][0]
    q, codes = Held.rng.normal(size=(4_096, 64)), Held.rng.integers(0, 256, (6_000, 16)).astype(np.uint8)
    a, _ = sides(q, q, np.arange(len(q)))
    b = pd.DataFrame({"_did": np.arange(len(codes)), "_dv": [c.tobytes() for c in codes], "_list": 0})
    kernel = knn._make_kernel(5, "_qid", "_did", "_qv", "_dv", None, None, ["q", "d", "v"], ann_codes.CodeDistance(Held))
    tracemalloc.start()
    got = kernel(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # A table of 16 x 256 numbers per query is 134 MB.
    assert peak < 60e6, peak
    points = centre + np.concatenate([books[p][codes[:, p]] for p in range(16)], axis=1)
    units = q[:50] / np.linalg.norm(q[:50], axis=1, keepdims=True)
    want = ((units[:, None] - points[None]) ** 2).sum(axis=2) / 2
    near = got[got.q < 50].sort_values(["q", "v"])
    assert near.d.tolist() == np.argsort(want, axis=1)[:, :5].ravel().tolist()
    assert np.allclose(near.v, np.sort(want, axis=1)[:, :5].ravel())


def test_vectors_are_held_once_in_single_precision():
    rng = np.random.default_rng(6)
    q, d = rng.normal(size=(1_024, 64)).astype(np.float32), rng.normal(size=(40_000, 64)).astype(np.float32)
    a, b = sides(q, d, rng.permutation(len(d)))
    kernel = knn._make_kernel(3, "_qid", "_did", "_qv", "_dv", None, None, ["q", "d", "v"], knn.Cosine())
    tracemalloc.start()
    got = kernel(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # The vectors as they came are 10 MB: these, those in order and their unit rows.  Unit rows in double are 20 MB more.
    assert peak < 45e6, peak
    tables = [pa.Table.from_pandas(x.drop(columns=[c for c in x if c.endswith("ex")]), preserve_index=False) for x in (a, b)]
    assert kernel(*tables).to_pandas().equals(got)


@pytest.mark.parametrize("size", [0, 1, 7, 8, 64, 1_000, 4_099])
def test_true_places_of_a_longer_mask(size):
    rng = np.random.default_rng(size)
    for share in (0.0, 0.01, 1.0):
        mask = np.ones(size + 8, bool)          # what lies beyond is left from a product before
        mask[:size] = rng.random(size) < share
        assert np.array_equal(knn._true_places(mask, size), np.flatnonzero(mask[:size]))


def test_hits_are_found_by_words():
    """Few true ones in a mask cost a fraction of a look at each of its places."""
    mask = np.zeros((1 << 20) + 8, bool)
    mask[:1 << 20:4_001] = True

    def seconds(find):
        times = []
        for _ in range(15):
            t = time.perf_counter()
            find()
            times.append(time.perf_counter() - t)
        return min(times)
    assert seconds(lambda: knn._true_places(mask, 1 << 20)) < 0.7 * seconds(lambda: np.flatnonzero(mask[:1 << 20]))
