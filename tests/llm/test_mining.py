"""Hard negatives and periodic runs against brute force, and their defined
results on odd rows."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scoutline.llm import hard_negatives as hn
from scoutline.llm import periodic_runs as pr
from scoutline.llm import queries

from conftest import SF_SMALL


# --- op11 --------------------------------------------------------------------

@pytest.mark.parametrize("n_planes", [1, 2, 9, 14])
def test_planes_give_back_the_numbers(n_planes):
    r = np.random.default_rng(n_planes)
    q = r.integers(-(1 << n_planes - 1), 1 << n_planes - 1, (50, 21))
    planes = hn.to_planes(q)
    assert planes.shape[1] <= n_planes + 1 and planes.shape[2] == 3
    assert (hn.from_planes(planes)[:, :21] == q).all()


@pytest.mark.parametrize("size", [3, 300, 1 << 20])
def test_scores_are_exact_inner_products(size):
    r = np.random.default_rng(size)
    a, c = r.integers(-size, size, (7, 16)), r.integers(-size, size, (40, 16))
    planes = hn.to_planes(c)
    tables = hn.tables_of(a, 2, planes.shape[1])
    assert (hn.scores(tables, np.ascontiguousarray(planes.transpose(1, 2, 0))) == c @ a.T).all()


def test_scores_beyond_the_range_are_refused():
    with pytest.raises(ValueError):
        hn.tables_of(np.full((1, 8), 1 << 50), 1, 20)


def brute_negatives(rows, is_anchor, positives=5, negatives=5):
    """``rows``: (row, id, vector, label) as the operator sees them."""
    use = [(i, v, [int(np.floor(256 * float(x))) for x in e], y) for i, v, e, y in rows
           if y is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, v, e, y in use:
        if not is_anchor(v):
            continue
        scored = sorted(((dot(e, e2), v2, y2) for i2, v2, e2, y2 in use if i2 != i),
                        key=lambda x: (-x[0], x[1] is None, x[1]))
        for s, pid, _ in [x for x in scored if x[2] == y][:positives]:
            near = [x for x in scored if x[2] != y and 80 * s <= 100 * x[0] <= 100 * s][:negatives]
            out += [(v, pid, k + 1, x[1], s, x[0]) for k, x in enumerate(near)]
    return sorted(out, key=str)


def vectors(spark, rows):
    return spark.createDataFrame([(v, e, y, "x", v) for _, v, e, y in rows],
                                 "vec_id bigint, embedding array<float>, label int, row string, id bigint").repartition(4)


def mine(spark, rows, **kw):
    got = hn.hard_negatives(vectors(spark, rows), F.col("vec_id") % 10 == 0, **kw)
    return sorted((tuple(x) for x in got.collect()), key=str)


@pytest.mark.parametrize("block", [(7, 2), (1000, 1000)])
def test_hard_negatives_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(hn, "LEAST_ROWS", 7)
    monkeypatch.setattr(hn, "CHUNK", (16, 3))
    r = np.random.default_rng(5)
    base = r.normal(size=(6, 12)).astype(np.float32)
    rows = [(i, i, (base[i % 6] + 0.2 * r.normal(size=12).astype(np.float32)).tolist(), int(r.integers(0, 3)))
            for i in range(150)]
    rows += [(200 + i, 200 + i, base[0].tolist(), i % 2) for i in range(60)]          # one very common vector
    got = mine(spark, rows, block_rows=block[0], block_anchors=block[1])
    assert got == brute_negatives(rows, lambda v: v % 10 == 0) and got


def test_hard_negatives_defined_results(spark):
    one, two = [0.5, 0.25], [0.5, 0.125]
    rows = [(0, 0, one, 1), (1, 1, None, 1), (2, 2, [0.5, None], 1), (3, 3, [float("nan"), 1.0], 1),
            (4, 4, [float("inf"), 1.0], 1), (5, 5, one, None), (6, 6, [], 1), (7, 7, [0.5], 1),
            (8, 8, two, 2), (9, 8, two, 2), (10, None, one, 2), (11, None, two, 1), (12, 0, one, 1),
            (13, 9, [*one, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, -3.0], 3), (14, 10, [-1.0, -1.0], 5)]
    got = mine(spark, rows)
    assert got == brute_negatives(rows, lambda v: v is not None and v % 10 == 0) and got
    assert mine(spark, rows[:1]) == []
    empty = hn.hard_negatives(vectors(spark, rows).limit(0), F.col("vec_id") % 10 == 0)
    assert empty.count() == 0 and empty.columns == ["anchor_id", "positive_id", "rank", "negative_id",
                                                    "positive_score", "negative_score"]


# --- op13 --------------------------------------------------------------------

def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_runs(w):
    n, found = len(w), {}
    for q in range(1, n // 3 + 1):
        i = q
        while i < n:
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                found.setdefault((i - q, j - i + q), q)       # the smallest period comes first
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def repetitive(seed):
    r, w = random.Random(seed), []
    letters = "abcd"[:r.randrange(1, 5)]
    for _ in range(r.randrange(1, 6)):
        block = [r.choice(letters) for _ in range(r.randrange(1, 20))]
        w += [block[i % len(block)] for i in range(r.randrange(0, r.choice([10, 200])))] if r.random() < .7 else block
    return r.choice([" ", "\n", " \t "]).join(w)


def thue_morse(n):
    return " ".join("ab"[bin(i).count("1") % 2] for i in range(n))


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return " ".join(b)


TEXTS = [None, "", " \n ", "one", " ".join("a" * 23), " ".join("a" * 24), " ".join(["word"] * 30_000),
         " ".join(f"w{i % 700}" for i in range(2_100)), " ".join(f"w{i % 700}" for i in range(2_099)),
         thue_morse(1_000), fibonacci(600), " ".join("aab" * 9 + "aabaac" * 9), "x" * 50_000,
         *[repetitive(i) for i in range(400)]]


def as_tuples(runs):
    return [(r["start"], r["length"], r["period"]) for r in runs]


def test_runs_match_brute_force():
    n_words, runs, text = pr.runs_of_slice(pa.array(TEXTS))
    for t, n, found, c in zip(TEXTS, n_words.to_pylist(), runs.to_pylist(), text.to_pylist()):
        w = split(t)
        want = [(0, 30_000, 1)] if len(w) == 30_000 else brute_runs(w)
        assert (n, as_tuples(found)) == (len(w), want)
        assert c == collapsed(w, want)


def test_equal_windows_of_other_texts_open_nothing():
    place, _ = pr.candidates(np.zeros(64, np.int64), np.arange(0, 65, 16))
    assert not len(place)


def test_work_does_not_grow_with_the_frequency_of_a_word():
    place, lag = pr.candidates(np.zeros(20_000, np.int64), np.array([0, 20_000]))
    assert len(place) <= 20_000 and set(lag) == {1}


def test_periodic_runs_table(spark):
    rows = [(i % 50 if i % 7 else None, t, "keep", 3, "r") for i, t in enumerate(TEXTS[:60])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, row string, n_words int, runs string").repartition(3)
    out = pr.periodic_runs(docs)
    assert out.columns == ["doc_id", "row", "text", "n_words", "runs"]
    want = sorted((str(d), collapsed(split(t), r := brute_runs(split(t)) if len(t or "") < 60_000 else [(0, 30_000, 1)]),
                   str(r)) for d, t, *_ in rows)
    assert sorted((str(x["doc_id"]), x["text"], str(as_tuples(x["runs"]))) for x in out.collect()) == want
    assert pr.periodic_runs(docs.limit(0)).count() == 0


def test_strongest_run_is_exact(spark):
    big = 3_000_000_000
    runs = [(0, big, 1000), (5, big + 1, 1000), (9, 2 * (big + 1), 2000)]
    df = spark.createDataFrame([([tuple(r) for r in runs],), ([],)], f"runs {pr.RUNS}")
    got = [x["best"] for x in df.select(pr.strongest(F.col("runs")).alias("best")).collect()]
    assert tuple(got[0]) == (5, big + 1, 1000) and got[1] is None


def planted(doc_id, text):
    w = split(text)
    n, h = len(w), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_op13_query_equals_brute_force(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF_SMALL}/documents.parquet'").fetchall()
    want = []
    for doc_id, text in docs:
        w = planted(doc_id, text)
        runs = brute_runs(w)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
                     sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapsed(w, runs))))
    got = [tuple(x) for x in queries.op13_periodic_runs(spark, SF_SMALL).collect()]
    assert sorted(got) == sorted(want)
    assert any(x[1] for x in want)
