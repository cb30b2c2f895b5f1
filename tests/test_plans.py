"""Plan properties the design relies on (checked on the optimized plans)."""

import __spark_entry__ as E
from scoutline.functions.text import SENTENCE_PATTERN, URL_PATTERN

from conftest import SF_SMALL


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_preprocess_splits_sentences_once_and_never_shuffles(spark):
    df = E.queries()["preprocess"](spark, SF_SMALL)
    plan = optimized(df)
    assert plan.count(SENTENCE_PATTERN) == 1
    phys = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in phys and "Join" not in phys


def test_knn_exact_has_no_cartesian(spark):
    phys = E.queries()["knn_exact"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in phys and "NestedLoopJoin" not in phys
    assert "FlatMapCoGroupsInPandas" in phys and "WindowGroupLimit" in phys


def test_session_fold_is_one_aggregate(spark):
    phys = E.queries()["latest_per_session"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in phys and "Join" not in phys


def test_scan_prunes_columns(spark):
    df = E.queries()["run_counts"](spark, SF_SMALL)
    phys = df._jdf.queryExecution().executedPlan().toString()
    assert "n_chars" not in phys and "lang" not in phys
    assert URL_PATTERN not in optimized(df)


def test_candidates_are_built_once(spark):
    """The final plans read the stored candidates; lineitem is not aggregated again."""
    for name in ("match_envelope", "score_growth", "overfetch", "outreach_package", "match_candidates"):
        phys = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "l_extendedprice" not in phys, name


def test_stored_inputs_are_not_stored_again(spark, monkeypatch):
    from scoutline.operators import knn
    from scoutline.session import cut_lineage
    e = cut_lineage(spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select("vec_id", "embedding"))
    d = e.withColumnRenamed("vec_id", "doc_id")
    stored = []
    monkeypatch.setattr(knn, "cut_lineage", lambda df: stored.append(df.columns) or cut_lineage(df))
    knn.knn_exact(e, d, 3, query_id="vec_id", index_id="doc_id", materialize=False).count()
    assert stored == []
    knn.knn_approx(e, d, 3, query_id="vec_id", index_id="doc_id", n_lists=4, n_probe=2, materialize=False).count()
    assert [c for c in stored if "doc_id" in c] == []          # probes and the training sample only


def test_indexed_rows_split_sentences_once(spark):
    """The embedder does not make Spark write the sentences out at each of their uses."""
    from scoutline.operators.preprocess import preprocess
    from scoutline.streaming.index_stream import index_rows

    docs = spark.createDataFrame([("1", "a/b.txt", "We raised a round. The AI team grew.")], "doc_id string, path string, text string")
    rows = index_rows(preprocess(docs))
    assert optimized(rows).count(SENTENCE_PATTERN) == 1
    r = rows.first()
    assert r["document"].startswith("We raised") and len(r["embedding"]) == 64 and r["sentence_count"] == 2
