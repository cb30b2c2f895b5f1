"""k-NN against brute force, IVF recall, rubric scores, threshold, ties,
partition invariance."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoutline.functions import scoring as SC
from scoutline.operators import knn, matching
from scoutline.plans import roles

from conftest import SF_MID


def brute_topk(Q, qids, D, dids, k, exclude_same=False):
    Qn = Q / np.linalg.norm(Q, axis=1, keepdims=True)
    Dn = D / np.linalg.norm(D, axis=1, keepdims=True)
    dist = np.round(1 - Qn @ Dn.T, 6)
    out = {}
    for i, q in enumerate(qids):
        cand = [(dist[i, j], dids[j]) for j in range(len(dids)) if not (exclude_same and dids[j] == q)]
        out[q] = [d for _, d in sorted(cand)[:k]]
    return out


@pytest.mark.parametrize("block_rows", [3, 7, 4096])
def test_knn_exact_equals_brute_force(spark, block_rows):
    rng = np.random.default_rng(7)
    D = rng.normal(size=(40, 5))
    D[10] = D[3]            # exact duplicates -> ties broken by id
    D[11] = D[3]
    Q = np.vstack([D[:8], rng.normal(size=(5, 5))])
    qids, dids = list(range(len(Q))), list(range(len(D)))
    qdf = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(qids, Q)], "qid long, embedding array<double>")
    ddf = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(dids, D)], "did long, embedding array<double>")
    got = knn.knn_exact(qdf.withColumn("x", F.col("qid")), ddf.withColumn("x", F.col("did")), 4,
                        query_id="qid", index_id="did", exclude=("x", "x"), block_rows=block_rows).collect()
    res = {}
    for r in sorted(got, key=lambda r: (r["qid"], r["rank"])):
        res.setdefault(r["qid"], []).append(r["did"])
    assert res == brute_topk(Q, qids, D, dids, 4, exclude_same=True)


def test_knn_fewer_rows_than_k(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, embedding array<double>")
    d = spark.createDataFrame([(5, [0.0, 1.0]), (6, [1.0, 1.0])], "did long, embedding array<double>")
    got = knn.knn_exact(q, d, 6, query_id="qid", index_id="did").orderBy("rank").collect()
    assert [r["did"] for r in got] == [6, 5]
    assert got[1]["distance"] == 1.0


def test_knn_approx_recall(spark):
    c, i = roles.candidates(spark, SF_MID), roles.companies(spark, SF_MID)
    exact = knn.knn_exact(c, i, 6, query_id="cand_id", index_id="doc_id")
    approx = knn.knn_approx(c, i, 6, query_id="cand_id", index_id="doc_id", n_lists=32, n_probe=16)
    # Equal texts tie, so ranks are compared by distance.
    e = {(r[0], r[1]): r[2] for r in exact.select("cand_id", "rank", "distance").collect()}
    a = {(r[0], r[1]): r[2] for r in approx.select("cand_id", "rank", "distance").collect()}
    assert sum(a.get(k) == v for k, v in e.items()) / len(e) >= 0.9


def test_knn_approx_recall_clustered(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 16)) * 5
    D = np.vstack([c + rng.normal(size=(40, 16)) for c in centers])
    Q = D[::7] + rng.normal(size=(len(D[::7]), 16)) * 0.1
    qdf = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(Q)], "qid long, embedding array<double>")
    ddf = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(D)], "did long, embedding array<double>")
    exact = {(r[0], r[1]) for r in knn.knn_exact(qdf, ddf, 5, query_id="qid", index_id="did").select("qid", "did").collect()}
    approx = {(r[0], r[1]) for r in knn.knn_approx(qdf, ddf, 5, query_id="qid", index_id="did", n_lists=12,
                                                   n_probe=2).select("qid", "did").collect()}
    assert len(exact & approx) / len(exact) >= 0.95


def test_weighted_score_and_threshold(spark):
    df = spark.createDataFrame([(1.0, 0.7, 1.0, 0.5)], "a double, b double, c double, d double")
    assert df.select(SC.weighted_score("a", "b", "c", "d")).first()[0] == 0.85
    s = spark.createDataFrame([(0.6,), (0.5999,), (None,)], "final_score double")
    assert [r[0] for r in matching.min_score_filter(s).collect()] == [0.6]


def test_experience_and_growth(spark):
    df = spark.createDataFrame([(10, 3), (50, 13), (60, 10), (100, 20), (11, 0)], "staff int, years int")
    got = [r[0] for r in df.select(SC.score_experience("staff", "years")).collect()]
    assert got == [1.0, 0.9, 0.5, 1.0, 0.4]
    g = spark.createDataFrame([(["Seed"], "Seed"), (["Seed"], "Series A"), (["Seed", "Growth"], "Series B"),
                               (["Seed"], "Growth"), ([], "Seed")], "p array<string>, s string")
    assert [r[0] for r in g.select(SC.score_growth("p", "s")).collect()] == [1.0, 0.7, 0.5, 0.0, 0.0]


def test_rank_ties_nearest_first(spark):
    df = spark.createDataFrame([(1, 10, 0.7, 0.3), (1, 11, 0.7, 0.2), (1, 9, 0.7, 0.2), (1, 12, 0.9, 0.9)],
                               "cand_id long, doc_id long, final_score double, distance double")
    got = matching.rank_by_score(df).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [12, 9, 11, 10]


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_partition_invariance(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        c, i = roles.candidates(spark, SF_MID), roles.companies(spark, SF_MID)
        got = sorted(tuple(r) for r in matching.match_candidates(c, i)
                     .select("cand_id", "rank", "doc_id", "final_score").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    c, i = roles.candidates(spark, SF_MID), roles.companies(spark, SF_MID)
    base = sorted(tuple(r) for r in matching.match_candidates(c, i)
                  .select("cand_id", "rank", "doc_id", "final_score").collect())
    assert got == base and len(base) > 0


def test_plan_has_no_nested_loop_and_partial_topk(spark):
    c, i = roles.candidates(spark, SF_MID), roles.companies(spark, SF_MID)
    plan = matching.match_candidates(c, i)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert "WindowGroupLimit" in plan


def test_stream_match_equals_batch(spark, tmp_path):
    from scoutline.streaming.sessions_stream import stream_match
    c, i = roles.candidates(spark, SF_MID), roles.companies(spark, SF_MID)
    src = str(tmp_path / "cands")
    c.withColumn("_b", F.col("cand_id") % 2).write.partitionBy("_b").parquet(src)
    schema = spark.read.parquet(src).drop("_b").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4) \
        .option("recursiveFileLookup", "true").parquet(src)
    q = stream_match(stream, i, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    cols = ["cand_id", "rank", "doc_id", "final_score"]
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*cols).collect())
    want = sorted(tuple(r) for r in matching.match_candidates(c, i).select(*cols).collect())
    assert got == want and len(want) > 0
