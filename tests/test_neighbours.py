"""The following row within a key, without a task that holds a whole key."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from scoutline.operators import aggregates as AG


def rows(n=600, seed=4):
    r = random.Random(seed)
    # One conversation holds a third of all turns; one key and some orders are null.
    keys = ["hot" if i % 3 == 0 else r.choice(["a", "b", "c", None, f"k{i}"]) for i in range(n)]
    orders = r.sample(range(10 * n), n)
    return [(k, o, None if o % 11 == 0 else f"t{o}", "x") for k, o in zip(keys, orders)]


SCHEMA = "conv string, turn int, text string, next string"


def window(df):
    w = Window.partitionBy("conv").orderBy("turn")
    return df.drop("next").withColumn("next", F.lead("text", 1).over(w))


def found(df):
    return sorted((str(r.conv), r.turn, r.text, r.next) for r in df.select("conv", "turn", "text", "next").collect())


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_equals_a_window_at_any_number_of_partitions(spark, parts):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        out = AG.next_row(df, "conv", "turn", "text")
        assert out.columns == ["conv", "turn", "text", "next"]
        assert found(out) == found(window(df))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_a_hot_key_is_spread_over_the_tasks(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(AG, "cut_lineage", lambda d, cut=AG.cut_lineage: stored.append(cut(d)) or stored[-1])
    df = spark.createDataFrame(rows(3_000), SCHEMA)
    AG.next_row(df, "conv", "turn", "text").count()
    parts = {r._part: r["count"] for r in stored[0].groupBy("_part").count().collect()}
    hot = {r._part: r["count"] for r in stored[0].where("conv = 'hot'").groupBy("_part").count().collect()}
    assert len(hot) >= 2 and max(parts.values()) < 3_000 / 4 and sum(hot.values()) == 1_000
    plan = stored[0]._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_empty_and_single(spark):
    df = spark.createDataFrame(rows(1), SCHEMA)
    assert [x[3] for x in found(AG.next_row(df, "conv", "turn", "text"))] == [None]
    assert AG.next_row(df.limit(0), "conv", "turn", "text").count() == 0
