"""Folder scans, extraction hook, idempotent index writes, streaming
indexing, gazetteer entities, run report."""

import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from scoutline.operators.aggregates import concat_pages, next_row, ordered_distinct
from scoutline.operators.entities import gazetteer_entities
from scoutline.sources.files import extract_text, scan_documents
from scoutline.sources.index import read_index, write_index, write_run_report
from scoutline.streaming.index_stream import index_batch, stream_index


def write(p, text):
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w") as f:
        f.write(text)


def test_scan_is_flat_and_case_sensitive(spark, tmp_path):
    for n in ["a.pdf", "b.PDF", "sub/c.pdf", "x.txt"]:
        write(str(tmp_path / n), "x")
    names = sorted(os.path.basename(r[0]) for r in scan_documents(spark, str(tmp_path)).select("path").collect())
    assert names == ["a.pdf"]


def test_extractor_failure_gives_empty_text(spark, tmp_path):
    write(str(tmp_path / "ok.pdf"), "fine")
    write(str(tmp_path / "bad.pdf"), "boom")

    def extractor(b):
        if b == b"boom":
            raise ValueError("cannot decode")
        return b.decode()
    got = {os.path.basename(r["path"]): r["raw_text"]
           for r in extract_text(scan_documents(spark, str(tmp_path)), extractor).collect()}
    assert got == {"ok.pdf": "fine", "bad.pdf": ""}


def test_write_index_rerun_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([("d1", "b/x.pdf", 1), ("d1", "a/x.pdf", 2), ("d2", "c.pdf", 3)],
                               "doc_id string, path string, v int")
    out = str(tmp_path / "index")
    assert write_index(df, out) == 2
    assert write_index(df, out) == 0
    rows = {r["doc_id"]: r["path"] for r in read_index(spark, out).collect()}
    assert rows == {"d1": "a/x.pdf", "d2": "c.pdf"}


def test_read_missing_index_raises(spark, tmp_path):
    with pytest.raises(AnalysisException):
        read_index(spark, str(tmp_path / "nope")).collect()


def test_stream_index_batches_equal_one_run(spark, tmp_path):
    src, out1, out2 = tmp_path / "src", str(tmp_path / "i1"), str(tmp_path / "i2")
    texts = {"a.txt": "We raised a round. The team grew.", "b.txt": "Acme builds a platform.",
             "c.txt": "We raised a round. The team grew."}
    for n, t in list(texts.items())[:2]:
        write(str(src / n), t)
    q = stream_index(spark, str(src), out1, str(tmp_path / "ck"))
    q.awaitTermination()
    write(str(src / "c.txt"), texts["c.txt"])
    q = stream_index(spark, str(src), out1, str(tmp_path / "ck"))
    q.awaitTermination()
    q = stream_index(spark, str(src), out1, str(tmp_path / "ck"))   # nothing new
    q.awaitTermination()
    index_batch(scan_documents(spark, str(src), "*.txt"), out2)
    cols = ["doc_id", "document", "word_count", "section_present"]
    a = sorted(tuple(r) for r in read_index(spark, out1).select(*cols).collect())
    b = sorted(tuple(r) for r in read_index(spark, out2).select(*cols).collect())
    assert a == b and len(a) == 3


def test_gazetteer_order_and_dedupe(spark):
    docs = spark.createDataFrame([(1, "Ann Lee met MIT people. Then Ann Lee left for Paris, then MIT.")],
                                 "doc_id long, text string")
    gaz = spark.createDataFrame([("Ann Lee", "PERSON"), ("MIT", "ORG"), ("Paris", "GPE"), ("Lee", "PERSON")],
                                "phrase string, label string")
    r = gazetteer_entities(docs, gaz).first()
    assert r["people"] == ["Ann Lee", "Lee"] and r["organizations"] == ["MIT"] and r["locations"] == ["Paris"]


def test_grouped_helpers(spark):
    df = spark.createDataFrame([(1, 2, "c", "z"), (1, 0, "a", "x"), (1, 1, "b", "x")],
                               "k int, o int, t string, v string")
    assert concat_pages(df, "k", "o", "t", "").first()["text"] == "abc"
    assert ordered_distinct(df, "k", "o", "v").first()["values"] == ["x", "z"]
    nxt = {r["o"]: r["next"] for r in next_row(df, "k", "o", "t").collect()}
    assert nxt == {0: "b", 1: "c", 2: None}
    nxt2 = {r["o"]: r["next"] for r in next_row(df, "k", "o", "t", dense=False).collect()}
    assert nxt2 == nxt


def test_run_report(spark, tmp_path):
    ids = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    s = write_run_report(ids, str(tmp_path / "rep"), clock="2024-01-01 00:00:00").first()
    assert s["processed_documents"] == 2
    assert spark.read.json(str(tmp_path / "rep/summary")).first()["processed_documents"] == 2
