"""Roles the generic operators play on the driver's TPC-H-style tables.

* companies (the startup index): every ``part``.  industry = ``p_type``,
  staff = ``p_size * 2``, stack = the two words of ``p_name`` (adjective =
  foundational, noun = core).  The vector embeds the company's description.
* candidates: every ``customer``.  years = ``c_custkey % 20``, preferred
  industries from the market segment, skills = the words of the dearest part the
  customer ordered, location = nation name, preferred stages from the region.
  The vector embeds the candidate's search text.
* sessions: ``events`` (user_id = session, event_type = step).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutline.functions import scoring
from scoutline.functions.prompts import search_text
from scoutline.operators.embed import embed_hashed
from scoutline.session import spread, table_path

# ---- fixed values of the role mapping ---------------------------------------
SEGMENT_INDUSTRIES = {
    "AUTOMOBILE": ["LARGE", "MEDIUM"],
    "BUILDING": ["STANDARD", "LARGE"],
    "FURNITURE": ["SMALL", "MEDIUM"],
    "HOUSEHOLD": ["SMALL", "ECONOMY"],
    "MACHINERY": ["PROMO", "STANDARD"],
}
REGION_STAGES = {
    "AFRICA": ["Seed", "Series A"],
    "AMERICA": ["Series A", "Series B"],
    "ASIA": ["Series B", "Series C"],
    "EUROPE": ["Seed"],
    "MIDDLE EAST": ["Growth"],
}
# Desired role by years of experience: (max years, roles).
ROLE_BANDS = [(5, ["Software Engineer", "Full Stack Developer"]),
              (12, ["Technical Lead"]),
              (None, ["Engineering Manager"])]
EVENT_STEPS = {"signup": "created", "view": "resume", "click": "preferences",
               "purchase": "matches", "error": "bad_request"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def _map_lit(d: dict) -> Column:
    kv = []
    for k, v in d.items():
        kv += [F.lit(k), F.array(*[F.lit(x) for x in v])]
    return F.create_map(*kv)


def companies(spark: SparkSession, sf_dir: str, *, as_stored: bool = False) -> DataFrame:
    """``as_stored`` keeps the rows in the order and the tasks of the file, by which k-means draws its first cells."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    part = part if as_stored else spread(part)
    words = F.split(F.col("p_name"), " ")
    staff = (F.col("p_size") * 2).cast("int")
    comps = (part
            .select(F.col("p_partkey").alias("doc_id"),
                    F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("company_name"),
                    F.col("p_type").alias("industry"),
                    staff.alias("staff"),
                    scoring.stage_of_staff(staff).alias("stage"),
                    F.array(F.element_at(words, -1)).alias("core_stack"),
                    F.array(F.element_at(words, 1)).alias("foundational_stack"))
            .withColumn("company_description",
                        F.format_string("%s is a %s stage %s company with %d people.",
                                        "company_name", "stage", "industry", "staff")))
    return embed_hashed(comps, "company_description")


def dearest_part_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(custkey, p_name)`` of the most expensive line each customer ordered,
    ties broken by (orderkey, linenumber).

    The winner is reduced per order before the join with orders (partial
    aggregation cuts lineitem ~4x before it shuffles) and the part name is
    joined to one row per customer only.
    """
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    key = F.struct("l_extendedprice", "l_orderkey", "l_linenumber")
    per_order = (li.groupBy("l_orderkey")
                 .agg(F.max_by(F.struct(key.alias("k"), F.col("l_partkey").alias("p")), key).alias("best")))
    per_cust = (per_order.join(orders, per_order.l_orderkey == orders.o_orderkey)
                .groupBy("o_custkey")
                .agg(F.max_by(F.col("best.p"), F.col("best.k")).alias("partkey")))
    return (per_cust.join(part, per_cust.partkey == part.p_partkey)
            .select(F.col("o_custkey").alias("custkey"), "p_name"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    skills = dearest_part_per_customer(spark, sf_dir)
    years = (F.col("c_custkey") % 20).cast("int")
    words = F.split(F.col("p_name"), " ")
    empty = F.array().cast("array<string>")
    roles = None
    for mx, rs in ROLE_BANDS:
        cond = years <= mx if mx is not None else F.lit(True)
        val = F.array(*[F.lit(r) for r in rs])
        roles = F.when(cond, val) if roles is None else roles.when(cond, val)
    df = (cust
          .join(nation, cust.c_nationkey == nation.n_nationkey, "left")
          .join(region, nation.n_regionkey == region.r_regionkey, "left")
          .join(skills, cust.c_custkey == skills.custkey, "left"))
    cands = df.select(
        F.col("c_custkey").alias("cand_id"),
        years.alias("years"),
        F.coalesce(F.try_element_at(_map_lit(SEGMENT_INDUSTRIES), F.col("c_mktsegment")), empty).alias("industries"),
        F.when(F.col("n_name").isNotNull(), F.array("n_name")).otherwise(empty).alias("work_locations"),
        F.coalesce(F.try_element_at(_map_lit(REGION_STAGES), F.col("r_name")), empty).alias("company_stages"),
        roles.alias("desired_roles"),
        F.when(F.col("p_name").isNotNull(), F.array(F.element_at(words, -1))).otherwise(empty).alias("core_skills"),
        F.when(F.col("p_name").isNotNull(), F.array(F.element_at(words, 1))).otherwise(empty).alias("foundational_skills"),
        F.format_string("%s has %d years of experience building %s systems.",
                        F.col("c_name"), years, F.coalesce(F.col("p_name"), F.lit("general"))).alias("resume_text"),
    )
    text = search_text("resume_text", "desired_roles", "industries", "work_locations")
    return embed_hashed(cands.withColumn("_search", text), "_search").drop("_search")


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` read as session events: (session_id, event_id, ts, step, payload)."""
    ev = read(spark, sf_dir, "events")
    steps = F.create_map(*[x for k, v in EVENT_STEPS.items() for x in (F.lit(k), F.lit(v))])
    return ev.select(F.col("user_id").alias("session_id"), "event_id", "ts",
                     F.try_element_at(steps, F.col("event_type")).alias("step"),
                     F.col("props").alias("payload"), "value")
