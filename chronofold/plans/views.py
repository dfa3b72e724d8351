"""Point-in-time shaped views derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import running
UTC = ("UTC", "Etc/UTC", "Z", "GMT")
STRICT, RECONSTRUCTED = "STRICT_PIT", "RECONSTRUCTED_PIT"


class Tables:
    """Lazy access to the parquet tables of one directory."""

    def __init__(self, spark: SparkSession, directory: str):
        if spark.conf.get("spark.sql.session.timeZone") not in UTC:
            spark.conf.set("spark.sql.session.timeZone", "UTC")  # the tables' clocks have no zone of their own
        self.spark, self.directory = spark, directory.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")


def ts(text: str) -> Column:
    return F.expr(f"timestamp_ntz '{text}'")


def span(text: str) -> Column:
    return F.expr(f"interval {text}")


def matches(t: Tables) -> DataFrame:
    """One keyed three-way outcome per order, with a late and sometimes unknown availability."""
    goals = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("hg"),
        F.count(F.when(F.col("l_returnflag") == "A", 1)).alias("ag"),
    )
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(goals, "o_orderkey", "left")
    key, kick = F.col("o_orderkey"), F.col("o_orderdate")
    return joined.select(
        key.alias("match_id"),
        F.col("c_mktsegment").alias("competition_id"),
        F.col("c_nationkey").alias("home_id"),
        ((F.col("c_nationkey") + 1 + key % 24) % 25).cast("int").alias("away_id"),
        kick.alias("kickoff_at"),
        (kick + span("2 hours")).alias("completed_at"),
        F.when(key % 50 != 0, kick + span("2 days")).alias("available_at"),
        F.when(F.col("o_orderstatus") == "F", STRICT).otherwise(RECONSTRUCTED).alias("availability_mode"),
        F.coalesce("hg", F.lit(0)).alias("home_goals"),
        F.coalesce("ag", F.lit(0)).alias("away_goals"),
    )


def match_revisions(t: Tables) -> DataFrame:
    """`matches` plus a corrected second version, five days later, on every 11th match."""
    first = matches(t).withColumn("version", F.lit(1).cast("bigint"))
    second = first.filter((F.col("match_id") % 11 == 0) & F.col("available_at").isNotNull()).withColumns(
        {
            "version": F.lit(2).cast("bigint"),
            "available_at": F.col("available_at") + span("5 days"),
            "home_goals": F.col("away_goals"),
            "away_goals": F.col("home_goals") + 1,
        }
    )
    return first.unionByName(second)


def revisions(t: Tables) -> DataFrame:
    """A version chain per user; versions follow time."""
    numbered = running.ordinal(
        t.events, ["user_id"], ["ts", "event_id"], running.calendar_slice("ts"), name="version"
    )
    return numbered.select(
        F.col("event_id").alias("record_id"),
        F.col("user_id").alias("entity_key"),
        "version",
        F.when(F.col("event_id") % 37 != 0, F.col("ts")).alias("available_at"),
        F.when(F.col("event_id") % 3 == 0, RECONSTRUCTED).otherwise(STRICT).alias("availability_mode"),
        "event_type",
        "value",
        "ts",
    )


def linked_revisions(t: Tables) -> DataFrame:
    linked = running.with_previous(
        revisions(t), ["entity_key"], ["ts", "record_id"], ["record_id"], running.calendar_slice("ts")
    )
    return linked.withColumnRenamed("prev_record_id", "supersedes_id").drop("prev_exists")


def quotes(t: Tables) -> DataFrame:
    """Three-way prices of many bookmakers for a fixture."""
    e = F.col("event_id")
    return t.events.select(
        e.alias("snapshot_id"),
        (F.col("user_id") % 40).alias("fixture_id"),
        (e % 12).alias("bookmaker_id"),
        F.col("ts").alias("quoted_at"),
        F.when(e % 61 != 0, F.col("ts") + span("5 minutes")).alias("available_at"),
        (F.lit(1.2).cast("double") + (e * 7 % 400) / F.lit(100.0)).alias("odds_home"),
        (F.lit(2.0).cast("double") + (e * 13 % 300) / F.lit(100.0)).alias("odds_draw"),
        (F.lit(1.5).cast("double") + (e * 29 % 600) / F.lit(100.0)).alias("odds_away"),
    )
