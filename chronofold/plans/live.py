"""Streams over rows of the given tables, each played in several micro-batches and checked like a batch query."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import running
from ..session import scratch_path
from ..sources import tables
from ..streaming import streams
from . import views
from .quality import ATTEMPT, BODY_SAME, NOW, RECORD, records
from .registry import query
from .sqlviews import MATCH, REVISION, with_
from .views import Tables, span, ts

CUTS = ("2024-01-11 00:00:00", "2024-01-21 00:00:00")
FILES = 4  # of a piece, which is one micro-batch
STATE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# State of a stream-stream join: one store a partition instead of four, batches leave their changes
# instead of whole files, and writing a row doesn't first look for it, as nobody reads the row counts.
JOIN_STATE = {
    "spark.sql.streaming.join.stateFormatVersion": "3",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def played(t: Tables, rows: DataFrame, at: Column, cuts: tuple[str, str] = CUTS, beat: DataFrame | None = None) -> DataFrame:
    """`rows` as a stream of three micro-batches in the order of the clock `at`; then `beat`, which moves the watermark past them all."""
    path = scratch_path(t.spark, "feed")
    piece = F.when(at < ts(cuts[0]), 0).when(at < ts(cuts[1]), 1).otherwise(2)
    for i in range(3):
        rows.filter(piece == i).repartition(FILES).write.mode("append").parquet(path)
    if beat is not None:
        beat.coalesce(1).write.mode("append").parquet(path)
    return streams.read_stream(t.spark, path, rows.schema, files_per_trigger=FILES)


def finished(t: Tables, stream: DataFrame, mode: str = "append", **state: str) -> DataFrame:
    """What the stream has written when all is processed, with the batch of each row."""
    out = scratch_path(t.spark, "stream")
    settings = {STATE: ROCKS} | state
    before = {name: t.spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        t.spark.conf.set(name, value)
    try:
        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

        streams.run_available(stream.writeStream.foreachBatch(keep).outputMode(mode), scratch_path(t.spark, "stream-state"))
    finally:
        for name, value in before.items():
            t.spark.conf.unset(name) if value is None else t.spark.conf.set(name, value)
    return t.spark.read.schema(T.StructType([*stream.schema, T.StructField("batch", T.LongType())])).option("basePath", out).parquet(out)


@query("stream_verdicts", with_(RECORD) + "select arrival, fixture_id, reasons, verdict from verdicts")
def stream_verdicts(t: Tables) -> DataFrame:
    """The record gate over three batches; their borders lie inside groups of repeated ids."""
    third = t.events.count() // 90 * 30 + 1
    second = lambda n: str(datetime.fromtimestamp(n, UTC).replace(tzinfo=None))
    at = F.timestamp_seconds("arrival").cast("timestamp_ntz")
    root = scratch_path(t.spark, "verdicts")
    before = t.spark.conf.get(STATE)
    t.spark.conf.set(STATE, ROCKS)
    try:
        feed = played(t, records(t).withColumn("seen_at", F.timestamp_seconds(F.col("arrival") + 86400)), at, (second(third), second(2 * third - 1)))
        streams.run_available(streams.split_verdicts(feed, root, ts(NOW), "arrival", BODY_SAME, "seen_at", "1 minute"), scratch_path(t.spark, "stream-state"))
    finally:
        t.spark.conf.set(STATE, before)
    return t.spark.read.parquet(root).select("arrival", "fixture_id", F.col("reason_codes").alias("reasons"), "verdict")


def clocked(t: Tables) -> DataFrame:
    return t.events.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_windows", "select cast(date_trunc('day', ts) as timestamp) as start, event_type, count(*) as n from events group by 1, 2")
def stream_windows(t: Tables) -> DataFrame:
    rows = clocked(t).select("event_type", "ts")
    updates = finished(t, streams.activity(played(t, rows, F.col("ts")), "event_type", "ts", "40 days", "1 day"), "update")
    return updates.groupBy(F.col("start").cast("timestamp_ntz").alias("start"), "event_type").agg(F.max_by("n", "batch").alias("n"))


@query("stream_dedup", "select event_id, user_id from events")
def stream_dedup(t: Tables) -> DataFrame:
    """Every event arrives twice, every third one in a later batch."""
    rows = clocked(t).select("event_id", "user_id", "ts")
    again = rows.withColumn("ts", F.when(F.col("event_id") % 3 == 0, F.col("ts") + span("9 days")).otherwise(F.col("ts")))
    return finished(t, streams.deduplicated(played(t, rows.unionByName(again), F.col("ts")), "event_id", "ts", "60 days")).select("event_id", "user_id")


@query("stream_append", """with rows_all as (select event_id as record_id, user_id as natural_key, ts, sha256(cast(user_id as varchar) || '|' || event_type || '|' || cast(event_id % 6 as varchar)) as k from events),
firsts as (select * from rows_all qualify row_number() over (partition by k order by ts, record_id) = 1)
select record_id, natural_key, row_number() over (partition by natural_key order by ts, record_id) as version from firsts""")
def stream_append(t: Tables) -> DataFrame:
    key = tables.dedup_key(F.col("user_id").cast("string"), F.concat_ws("|", "event_type", (F.col("event_id") % 6).cast("string")))
    rows = t.events.select(F.col("event_id").alias("record_id"), F.col("user_id").alias("natural_key"), F.col("ts").alias("arrived_at"), key.alias("dedup_key"))
    root = scratch_path(t.spark, "versions")
    writer = streams.append_stream(played(t, rows, F.col("arrived_at")), root, ["arrived_at"], running.calendar_slice("arrived_at"))
    streams.run_available(writer, scratch_path(t.spark, "stream-state"))
    return t.spark.read.parquet(root).select("record_id", "natural_key", "version")


@query("stream_labels", "select event_id as prediction_id, 'HOME' as outcome from events where event_id % 4 = 0")
def stream_labels(t: Tables) -> DataFrame:
    """Predictions that found their outcome; a quarter have one, two days later."""
    made = clocked(t).select(F.col("event_id").alias("prediction_id"), F.col("ts").alias("issued_at"))
    seen = made.filter("prediction_id % 4 = 0").select(F.col("prediction_id").alias("outcome_prediction_id"), (F.col("issued_at") + span("2 days")).alias("observed_at"), F.lit("HOME").alias("outcome"))
    joined = streams.late_labels(played(t, made, F.col("issued_at")), played(t, seen, F.col("observed_at")), "40 days", "3 days")
    return finished(t, joined, **JOIN_STATE).filter(F.col("outcome").isNotNull()).select("prediction_id", "outcome")


@query("stream_latest", with_(REVISION) + "select entity_key, max(version) as version, max_by(record_id, version) as record_id from v_revision group by 1")
def stream_latest(t: Tables) -> DataFrame:
    rows = views.revisions(t).select("entity_key", "version", "record_id", "ts")
    updates = finished(t, streams.latest_versions(played(t, rows, F.col("ts")).drop("ts")), "update")
    return updates.groupBy("entity_key").agg(F.max("version").alias("version"), F.max_by("record_id", "version").alias("record_id"))


CURSORS = ("2024-01-09 00:00:00", "2024-01-16 12:00:00", "2024-01-29 06:00:00")


@query("stream_as_of", with_(REVISION) + ", cursors as (select unnest([" + ", ".join(f"timestamp '{c}'" for c in CURSORS) + """]) as cursor_at)
select cursor_at, entity_key, max(version) as version, max_by(record_id, version) as record_id from v_revision join cursors on available_at <= cursor_at group by 1, 2""")
def stream_as_of(t: Tables) -> DataFrame:
    """Versions arrive up to twelve hours early or late, and count from their availability on; what was current at three moments."""
    known = views.revisions(t).filter(F.col("available_at").isNotNull()).withColumn("ts", F.col("available_at").cast("timestamp"))
    rows = known.select("entity_key", "record_id", "version", F.unix_micros("ts").alias("us"), "ts")
    arrival = F.col("ts") + F.make_dt_interval(hours=(F.col("record_id") * 7 % 25 - 12).cast("int"))
    changes = finished(t, streams.current_versions(played(t, rows, arrival, beat=heartbeat(t, rows, "entity_key", "ts")), "ts", "2 days"))
    cursors = F.explode(F.array(*map(ts, CURSORS))).alias("cursor_at")
    before = changes.select("*", cursors).filter(F.col("available_us") <= F.unix_micros(F.col("cursor_at").cast("timestamp")))
    return before.groupBy("cursor_at", "entity_key").agg(F.max("version").alias("version"), F.max_by("record_id", "version").alias("record_id"))


def heartbeat(t: Tables, rows: DataFrame, key: str, at: str) -> DataFrame:
    """One row long after all others, under a key of its own; the watermark never passes the row itself."""
    return t.spark.range(1).select(*[
        F.lit("~" if kind == "string" else -1).cast(kind).alias(c) if c == key else ts("2100-01-01 00:00:00").cast("timestamp").alias(c) if c == at else F.lit(4102444800000000).cast(kind).alias(c) if c.endswith("us") else F.lit(0).cast(kind).alias(c)
        for c, kind in rows.dtypes])


@query("stream_rate_gate", with_(ATTEMPT) + """
select a.attempt_id, count(b.attempt_id) as in_last_day, coalesce(any_value(a.soon), false) as too_soon
from (select *, attempted_at - lag(attempted_at) over (partition by source_id order by attempted_at, attempt_id) < interval '60' second as soon from attempt) a
join attempt b on b.source_id = a.source_id and b.attempted_at <= a.attempted_at and b.attempted_at + interval '1' day > a.attempted_at group by 1""")
def stream_rate_gate(t: Tables) -> DataFrame:
    """Attempts arrive up to a day late, so out of order within and across batches."""
    rows = clocked(t).select(F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")).alias("source"), F.col("event_id").alias("attempt_id"), F.unix_micros("ts").alias("us"), "ts")
    arrival = F.col("ts") + F.make_dt_interval(hours=(F.col("attempt_id") * 7 % 25).cast("int"))
    feed = played(t, rows, arrival, beat=heartbeat(t, rows, "source", "ts"))
    return finished(t, streams.rate_gate(feed, "ts", "2 days")).select("attempt_id", "in_last_day", "too_soon")


@query("stream_live_ratings", with_(MATCH).replace("with", "with recursive", 1) + """,
steps as (select competition_id, match_id, home_id, away_id, home_goals - away_goals as goals, row_number() over (partition by competition_id order by completed_at, match_id) as i from v_match where available_at is not null),
walk as (
  select distinct competition_id, cast(0 as bigint) as i, cast(null as bigint) as match_id, cast(null as double) as chance, [1500e0 for x in range(25)] as ratings from v_match
  union all
  select s.competition_id, s.i, s.match_id, 1e0 / (1e0 + pow(10e0, (w.ratings[away_id + 1] - w.ratings[home_id + 1] - 65e0) / 400e0)),
    list_transform(w.ratings, lambda x, j: x + (case j - 1 when home_id then 20e0 when away_id then -20e0 else 0e0 end)
      * ((sign(goals) + 1e0) / 2e0 - 1e0 / (1e0 + pow(10e0, (w.ratings[away_id + 1] - w.ratings[home_id + 1] - 65e0) / 400e0))))
  from walk w join steps s on s.competition_id = w.competition_id and s.i = w.i + 1)
select competition_id, match_id, round(chance, 7) as chance from walk where match_id is not null""")
def stream_live_ratings(t: Tables) -> DataFrame:
    """Results arrive up to nine days late, so out of order within and across batches."""
    m = views.matches(t).filter(F.col("available_at").isNotNull()).withColumn("ts", F.col("completed_at").cast("timestamp"))
    rows = m.select("competition_id", "match_id", "home_id", "away_id", (F.col("home_goals") - F.col("away_goals")).alias("goals"), F.unix_micros("ts").alias("completed_us"), "ts")
    arrival = F.col("ts") + F.make_dt_interval(days=(F.col("match_id") % 10).cast("int"))
    feed = played(t, rows, arrival, ("1994-07-01 00:00:00", "1996-07-01 00:00:00"), heartbeat(t, rows, "competition_id", "ts"))
    return finished(t, streams.live_ratings(feed, "ts", "15 days")).filter("competition_id <> '~'").select("competition_id", "match_id", F.round("chance", 7).alias("chance"))


@query("stream_freshness", """select 'feed' || cast(datediff('day', date '1970-01-01', cast(ts as date)) // 2 as varchar) as source, epoch_us(max(ts)) // 1000 as last_seen_ms, epoch_us(max(ts)) // 1000 + 21600000 as alerted_at_ms from events group by 1""")
def stream_freshness(t: Tables) -> DataFrame:
    """Each feed lives for two days; six hours of silence raise its one alert."""
    feed_of = F.concat(F.lit("feed"), F.floor(F.datediff("ts", F.lit("1970-01-01")) / 2).cast("string"))
    rows = clocked(t).select(feed_of.alias("source"), F.unix_millis("ts").alias("ms"), "ts")
    feed = played(t, rows, F.col("ts"), beat=heartbeat(t, rows, "source", "ts"))
    return finished(t, streams.stale_alerts(feed, "ts", 21_600_000, "1 hour")).filter("source <> '~'").select("source", "last_seen_ms", "alerted_at_ms")
