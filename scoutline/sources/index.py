"""The document index as a Parquet table: read, idempotent append, run
report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from scoutline.operators.aggregates import dedupe_by_id
from scoutline.session import cut_lineage
from scoutline.sources.membership import BUCKETS, Members


def read_index(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Open an existing index; a missing path raises AnalysisException."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(path)


def _existing_ids(spark: SparkSession, path: str, id_col: str):
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):   # no folder, or an empty one
            return None
        raise
    return stored.select(id_col)


def index_upsert(new: DataFrame, existing_ids: DataFrame | None, *, id_col: str = "doc_id",
                 order_col: str = "path") -> DataFrame:
    """Rows to append: one per id (first by ``order_col``), ids already in
    the index skipped (first write wins, as in the reference's store)."""
    fresh = dedupe_by_id(new, id_col, order_col)
    if existing_ids is not None:
        fresh = fresh.join(existing_ids.select(id_col), id_col, "left_anti")
    return fresh


def write_index(new: DataFrame, path: str, *, id_col: str = "doc_id", order_col: str = "path",
                partition_by: list[str] | None = None, buckets: int = BUCKETS) -> int:
    """Append the fresh rows of ``new`` to the Parquet index at ``path`` and
    return how many were appended.  Rerunning with the same input appends
    nothing (ids already stored are skipped).

    Stored ids are found through the Bloom filters beside the index
    (:mod:`membership`): a batch of new ids reads filters only, and of the ids only the
    buckets that may hold one of the batch's.  ``buckets`` counts for a new index."""
    spark = new.sparkSession
    members = Members(spark, path, id_col, buckets)
    members.recover()
    if not members.exists():
        before = _existing_ids(spark, path, id_col)
        if before is not None:               # an index written without filters
            members.add(before, lambda: None)
    # Once per id and stored, as the ids are tested before the rows are written.
    rows = cut_lineage(index_upsert(new, None, id_col=id_col, order_col=order_col))
    fresh = index_upsert(rows, members.known(rows.select(id_col)), id_col=id_col, order_col=order_col)
    written = Observation()

    def write() -> None:
        w = fresh.observe(written, F.count(F.lit(1)).alias("rows")).write.mode("append")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(path)

    members.add(fresh.select(id_col), write)
    return written.get["rows"]


def write_run_report(ids: DataFrame, path: str, *, id_col: str = "doc_id", clock: str) -> DataFrame:
    """Run report: the processed id table (Parquet, any size) plus a one-row
    JSON summary with the count and the run timestamp."""
    ids.select(id_col).write.mode("overwrite").parquet(f"{path}/processed_ids")
    summary = ids.agg(F.count(F.lit(1)).alias("processed_documents")) \
        .withColumn("timestamp", F.lit(clock))
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    return summary
