"""Corpus pipeline: quality rules, line dedup, near-duplicate removal,
pseudonyms, packing.

Every stage takes the table its predecessor wrote and works on all of it; all but
the last return the columns of ``documents``.  Nulls, empty tables, ties and
repeated rows are defined by each operator's module; a document with a null id is
never a near duplicate of another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutline.llm import line_dedup, near_dedup, packing, pseudonyms, quality_rules, queries, shared


def _edited(docs: DataFrame, edit) -> DataFrame:
    """``docs`` with the texts that ``edit`` returns, and ``n_chars`` of them where it exists.  The
    other columns go through as one, so that those of any name are given back as they were."""
    others = [c for c in docs.columns if c != "text"]
    done = edit(docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("given"), F.col("doc_id"),
                            "text"))
    given = {c: F.col("given").getField(c) for c in others} | {"text": F.col("text")}
    if "n_chars" in given:
        given["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return done.select(*[given[c].alias(c) for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the boosted trees keep."""
    model = quality_rules.fit_quality_rules(docs, queries.labels(spark, sf_dir))
    return quality_rules.quality_rules(docs, model).where("kept").select("row.*")


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines found in ten documents or more."""
    return _edited(docs, lambda d: line_dedup.line_dedup(d, min_docs=10))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every near-duplicate group.  Of a repeated
    id, only the texts that are near duplicates go."""
    gone = near_dedup.near_documents(docs).where("NOT kept").select("doc_id", "text_key").distinct()
    same = (F.col("d.doc_id") == F.col("g.doc_id")) & (near_dedup.text_key(F.col("d.text")) == F.col("g.text_key"))
    return docs.alias("d").join(gone.alias("g"), same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal values."""
    return _edited(docs, lambda d: pseudonyms.pseudonymise(d, queries.PSEUDONYM_KEY))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, as in ``op9_packing``."""
    return queries.pieces(packing.pack_sequences(docs, queries.WORD_BPE))


STAGES = [("quality rules", keep_quality), ("line dedup", drop_common_lines),
          ("MinHash near-dedup", drop_near_duplicates), ("PII", replace_private), ("packing", pack)]

# Boosted trees, sketches, pseudonyms and the tokenizer are not SQL: the tests
# run the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and reread."""
    docs = shared.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = shared.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
