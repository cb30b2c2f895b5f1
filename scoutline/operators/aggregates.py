"""Grouped operators: run counts, ordered text assembly, ordered distinct,
next row, dedupe by id."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutline.session import cut_lineage, ship_package


def run_counts(df: DataFrame, ok, by: str | None = None) -> DataFrame:
    """Found / processed / failed per run (or per ``by`` group)."""
    okc = F.coalesce(ok, F.lit(False))
    aggs = [F.count(F.lit(1)).alias("found"), F.count_if(okc).alias("processed"),
            F.count_if(~okc).alias("failed")]
    return df.groupBy(by).agg(*aggs) if by else df.agg(*aggs)


def concat_pages(df: DataFrame, key: str, order: str, text: str, sep: str = " ",
                 out: str = "text") -> DataFrame:
    """Ordered page texts -> one document text per key (``sep=' '`` for the
    indexer, ``''`` for uploads).  The output is one value per document, so
    the group is the document itself."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return df.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["t"]), sep).alias(out))


def ordered_distinct(df: DataFrame, key: str, order: str, value: str, out: str = "values") -> DataFrame:
    """Distinct values per key in first-occurrence order.  Values are reduced
    to (key, value, first position) by an aggregate before the list is built,
    so the list holds distinct values only."""
    first = df.groupBy(key, value).agg(F.min(order).alias("_pos"))
    return (first.groupBy(key)
            .agg(F.sort_array(F.collect_list(F.struct("_pos", F.col(value).alias("_v")))).alias("_l"))
            .select(key, F.transform("_l", lambda x: x["_v"]).alias(out)))


def csv_list(arr) -> F.Column:
    """','.join(list); empty or null list -> ''."""
    c = F.col(arr) if isinstance(arr, str) else arr
    return F.coalesce(F.array_join(c, ","), F.lit(""))


def _followers(key: str, value: str, out: str):
    """Per sorted partition: every row with its follower's value where the key is the same.  The first and
    last row are marked: the value of the one is the follower's of an earlier partition's last."""
    def run(batches):
        held, first = None, True
        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([b] if held is None else [held, b])
            k, n = rows.column(key), rows.num_rows - 1
            same = pc.fill_null(pc.equal(k.slice(0, n), k.slice(1)), False)
            same = pc.or_(same, pc.and_(k.slice(0, n).is_null(), k.slice(1).is_null()))
            following = rows.column(value).take(pa.array(np.arange(1, n + 1), mask=~same.to_numpy()))
            held = rows.take([n]).combine_chunks().to_batches()[0]
            if n:
                yield marked(rows.take(np.arange(n)), following, [first, *[False] * (n - 1)], [False] * n)
                first = False
        if held is not None:
            last = pa.Table.from_batches([held])
            yield marked(last, last.column(value).take(pa.array([None], pa.int64())), [first], [True])

    def marked(rows, following, first, last):
        done = rows.append_column(out, following).append_column("_first", pa.array(first)).append_column("_last", pa.array(last))
        return done.combine_chunks().to_batches()[0]

    return run


def next_row(df: DataFrame, key: str, order: str, value: str, out: str = "next",
             dense: bool = False) -> DataFrame:
    """Value of the following row within each key.

    Rows are range-partitioned by (key, order), so a key of any size is spread over many
    tasks; a task looks at neighbours in its sorted partition, and one border row per
    partition answers the last row of the partition before it (empty ones are passed
    over).  Rows of equal order are in any order.

    ``dense=True`` is for orders known to be consecutive integers: an equi-join on
    (key, order + 1), which gives null where a number is missing."""
    if dense:
        nxt = df.select(F.col(key).alias("_k"), (F.col(order) - 1).alias("_o"), F.col(value).alias(out))
        return (df.join(nxt, (df[key] == nxt["_k"]) & (df[order] == nxt["_o"]), "left")
                .drop("_k", "_o"))
    spark, columns = df.sparkSession, [c for c in df.columns if c != out]
    ship_package(spark)
    kinds = dict(df.dtypes)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + f", `{out}` {kinds[value]}, _first boolean, _last boolean"
    ordered = df.select(*[F.col(f"`{c}`") for c in columns]).repartitionByRange(n, key, order).sortWithinPartitions(key, order)
    stored = cut_lineage(ordered.mapInArrow(_followers(key, value, out), schema)
                         .withColumn("_part", F.spark_partition_id()))
    parts = sorted(r[0] for r in stored.where("_first").select("_part").collect())       # one row per partition
    before = spark.createDataFrame([(b, a) for a, b in zip(parts, parts[1:])], "_part int, _before int")
    borders = (stored.where("_first").join(before, "_part")
               .select(F.col("_before").alias("_part"), F.col(key).alias("_key"), F.col(value).alias("_value")))
    last = (stored.where("_last").drop(out).join(borders, "_part", "left")
            .withColumn(out, F.when(F.col(key).eqNullSafe(F.col("_key")), F.col("_value"))))
    return stored.where("NOT _last").select(*columns, out).unionByName(last.select(*columns, out))


def dedupe_by_id(df: DataFrame, id_col: str, order_col: str) -> DataFrame:
    """One row per id: the row with the smallest ``order_col`` (deterministic
    first-wins).  An aggregate, so copies of one id combine map-side."""
    others = [c for c in df.columns if c != id_col]
    return (df.groupBy(id_col).agg(F.min_by(F.struct(*others), F.col(order_col)).alias("_r"))
            .select(id_col, "_r.*"))
