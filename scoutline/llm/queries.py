"""Registered queries of the corpus operators and the SQL of those that SQL
can express.  Each query runs its operator over its whole table and derives the
digest columns from the operator's output."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutline.llm import (bpe, exact_dedup, hard_negatives, hilbert, license_scan, line_dedup, near_dedup, packing, periodic_runs,
                           pseudonyms, quality_rules, rule_ensemble, warc)
from scoutline.llm.shared import documents, folder

#: Vocabulary files of the registered queries; the operators take any path.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
#: Key of the registered query over the public test tables; real data need a secret one.
PSEUDONYM_KEY = b"corpus"


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.line_dedup(documents(spark, sf_dir).select("doc_id", "text"), min_docs=10)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op3_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = hilbert.hilbert_shards(documents(spark, sf_dir), hilbert.document_dimensions(), n_shards=16)
    return shards.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality_rules.fit_quality_rules(docs, labels(spark, sf_dir))
    return quality_rules.quality_rules(docs, model, keep=["doc_id"]).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "probability")


def op6_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return rule_ensemble.quality_score(docs, rule_ensemble.fit_quality_classifier(docs, labels(spark, sf_dir)))


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), PSEUDONYM_KEY)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.bpe_encode(documents(spark, sf_dir), BYTE_BPE)
    digests = encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                             F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), "ids")
    decoded = bpe.bpe_decode(digests, BYTE_BPE, keep=["doc_id", "n_tokens", "ids_sha256"])
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def pieces(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset", "tier", "step")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(packing.pack_sequences(documents(spark, sf_dir), WORD_BPE))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id is divisible by 7 carry the next label, as the contract has it."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"),
                                         F.col("vec_id") % 100 == 0, label=label)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = folder(spark, "warc")
    warc.write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), target)
    return warc.read_warc(spark, target, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def periodic_documents(docs: DataFrame) -> DataFrame:
    """The texts of the contract: where crc32(doc_id) is divisible by 10, the words from
    some place on repeat."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    a = lambda n: (g % n).cast("int")
    p = lambda n: (1 + F.floor((n - a(n)) / (3 + g % 8))).cast("int")
    return docs.select("doc_id", F.when(h % 10 == 0, periodic_runs.periodic_tail(F.col("text"), a, p))
                       .otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = periodic_runs.periodic_runs(periodic_documents(documents(spark, sf_dir)))
    best = F.col("best")
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    return done.withColumn("best", periodic_runs.strongest(F.col("runs"))).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), best["start"].alias("start"),
        best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_line_dedup, op2_exact_dedup, op3_hilbert_sharding, op4_license_scan, op5_quality_rules, op6_rule_ensemble,
    op7_pseudonyms, op8_bpe, op9_packing, op10_order_minhash, op11_hard_negatives,
    op12_warc, op13_periodic_runs)}

ORACLE = {"op1_line_dedup": line_dedup.ORACLE, "op2_exact_dedup": exact_dedup.ORACLE,
          "op11_hard_negatives": hard_negatives.ORACLE, "op12_warc": warc.ORACLE}
