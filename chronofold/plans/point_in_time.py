"""Derived views, availability, as-of selection, horizons, chain audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import running, temporal
from . import views
from .registry import query
from .sqlviews import MATCH, QUOTE, REVISION, with_
from .views import RECONSTRUCTED, STRICT, Tables, span, ts

CURSOR = "2024-01-15 00:00:00"


@query("view_match", with_(MATCH) + "select * exclude(outcome) from v_match")
def view_match(t: Tables) -> DataFrame:
    return views.matches(t)


@query("view_revision", with_(REVISION) + "select * from v_revision")
def view_revision(t: Tables) -> DataFrame:
    return views.linked_revisions(t)


@query("view_quote", with_(QUOTE) + """select snapshot_id, fixture_id, bookmaker_id, quoted_at, available_at,
  round(odds_home,6) as odds_home, round(odds_draw,6) as odds_draw, round(odds_away,6) as odds_away from v_quote""")
def view_quote(t: Tables) -> DataFrame:
    q = views.quotes(t)
    return q.withColumns({c: F.round(c, 6) for c in ("odds_home", "odds_draw", "odds_away")})


def _as_of_sql(mode: str) -> str:
    return with_(REVISION) + f"""select entity_key, version, record_id, available_at, value from v_revision
      where available_at <= timestamp '{CURSOR}' {mode}
      qualify row_number() over (partition by entity_key order by version desc) = 1"""


TAKEN = ["version", "record_id", "available_at", "value"]


@query("as_of_strict", _as_of_sql("and availability_mode = 'STRICT_PIT'"))
def as_of_strict(t: Tables) -> DataFrame:
    return temporal.as_of(views.revisions(t), ts(CURSOR), STRICT, TAKEN)


@query("as_of_reconstructed", _as_of_sql(""))
def as_of_reconstructed(t: Tables) -> DataFrame:
    return temporal.as_of(views.revisions(t), ts(CURSOR), RECONSTRUCTED, TAKEN)


@query("as_of_join", with_(REVISION) + """
select e.event_id, e.user_id as entity_key, e.ts as asked_at, max(r.version) as version, max_by(r.record_id, r.version) as record_id
from events e join v_revision r on r.entity_key = e.user_id and r.available_at <= e.ts and r.availability_mode = 'STRICT_PIT'
group by all""")
def as_of_join(t: Tables) -> DataFrame:
    asked = t.events.select("event_id", F.col("user_id").alias("entity_key"), F.col("ts").alias("asked_at"))
    return temporal.as_of_many(asked, views.revisions(t), STRICT, ["entity_key"], "asked_at", "version", ["record_id"])


VERSIONED = REVISION + """,
versioned as (select record_id, entity_key as natural_key, version, ts as available_at,
  ts + (record_id % 5) * interval '1' hour as created_at,
  case when record_id % 53 = 0 then '{"updated_at":"not-a-time"}'
    else concat('{"updated_at":"', strftime(ts, '%Y-%m-%d %H:%M:%S'), '","n":', cast(version as varchar), '}') end as payload
  from v_revision)"""


def versioned(t: Tables) -> DataFrame:
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    good = F.concat(F.lit('{"updated_at":"'), stamp, F.lit('","n":'), F.col("version").cast("string"), F.lit("}"))
    rows = views.revisions(t)
    return rows.select(
        "record_id",
        F.col("entity_key").alias("natural_key"),
        "version",
        F.col("ts").alias("available_at"),
        (F.col("ts") + F.make_dt_interval(hours=F.col("record_id") % 5)).alias("created_at"),
        F.when(F.col("record_id") % 53 == 0, '{"updated_at":"not-a-time"}').otherwise(good).alias("payload"),
    )


@query("two_clock_as_of", with_(VERSIONED) + f"""select natural_key, version, record_id, payload from versioned
  where available_at <= timestamp '{CURSOR}' and created_at <= timestamp '{CURSOR}'
  qualify row_number() over (partition by natural_key order by version desc) = 1""")
def two_clock_as_of(t: Tables) -> DataFrame:
    at = ts(CURSOR)
    known = versioned(t).filter((F.col("available_at") <= at) & (F.col("created_at") <= at))
    return temporal.latest_by(known, ["natural_key"], ["version"], ["version", "record_id", "payload"])


@query("json_clock_as_of", with_(VERSIONED) + f"""select natural_key, version, record_id from versioned
  where available_at <= timestamp '{CURSOR}' and created_at <= timestamp '{CURSOR}'
    and try_cast(json_extract_string(payload, '$.updated_at') as timestamp) <= timestamp '{CURSOR}'
  qualify row_number() over (partition by natural_key order by version desc) = 1""")
def json_clock_as_of(t: Tables) -> DataFrame:
    at = ts(CURSOR)
    updated = F.get_json_object("payload", "$.updated_at").try_cast("timestamp_ntz")
    known = versioned(t).filter((F.col("available_at") <= at) & (F.col("created_at") <= at) & (updated <= at))
    return temporal.latest_by(known, ["natural_key"], ["version"], ["version", "record_id"])


@query("observation_as_of", with_(VERSIONED) + f"""select record_id, natural_key, available_at, created_at from versioned
  where available_at <= timestamp '{CURSOR}' and created_at <= timestamp '{CURSOR}' and record_id % 53 <> 0
  order by created_at, record_id limit 100""")
def observation_as_of(t: Tables) -> DataFrame:
    """First hundred observations known on all three clocks, in ingestion order (top-N report)."""
    at = ts(CURSOR)
    updated = F.get_json_object("payload", "$.updated_at").try_cast("timestamp_ntz")
    known = versioned(t).filter((F.col("available_at") <= at) & (F.col("created_at") <= at) & (updated <= at))
    return known.orderBy("created_at", "record_id").limit(100).select("record_id", "natural_key", "available_at", "created_at")


CONTINUUM = """
continuum as (select event_id as record_id, user_id % 40 as fixture_id,
  case event_type when 'click' then 'OBSERVATION' when 'view' then 'MARKET_OBSERVATION' when 'error' then 'RECONSTRUCTION'
    when 'purchase' then 'PREDICTION' else 'HYPOTHESIS' end as epistemic_type,
  ts + (event_id % 3) * interval '1' day as event_at,
  case when event_id % 37 = 0 then null else ts end as available_at,
  case when event_id % 3 = 0 then 'RECONSTRUCTED_PIT' else 'STRICT_PIT' end as availability_mode,
  event_id % 6 as evidence_count, event_id % 13 = 0 as synthetic from events)"""


def continuum(t: Tables) -> DataFrame:
    e, kind = F.col("event_id"), F.col("event_type")
    return t.events.select(
        e.alias("record_id"),
        (F.col("user_id") % 40).alias("fixture_id"),
        F.when(kind == "click", "OBSERVATION").when(kind == "view", "MARKET_OBSERVATION")
        .when(kind == "error", "RECONSTRUCTION").when(kind == "purchase", "PREDICTION")
        .otherwise("HYPOTHESIS").alias("epistemic_type"),
        (F.col("ts") + F.make_dt_interval(days=e % 3)).alias("event_at"),
        F.when(e % 37 != 0, F.col("ts")).alias("available_at"),
        F.when(e % 3 == 0, RECONSTRUCTED).otherwise(STRICT).alias("availability_mode"),
        (e % 6).alias("evidence_count"),
        (e % 13 == 0).alias("synthetic"),
    )


@query("cursor", with_(CONTINUUM) + f"""select record_id, fixture_id, epistemic_type, event_at, available_at from continuum
  where available_at <= timestamp '{CURSOR}'""")
def cursor(t: Tables) -> DataFrame:
    known = temporal.knowledge_cursor(continuum(t), ts(CURSOR), RECONSTRUCTED)
    return known.select("record_id", "fixture_id", "epistemic_type", "event_at", "available_at")


@query("cursor_facts_only", with_(CONTINUUM) + f"""select record_id, fixture_id, epistemic_type, event_at, available_at from continuum
  where available_at <= timestamp '{CURSOR}' and availability_mode = 'STRICT_PIT' and not synthetic
    and epistemic_type in ('OBSERVATION','MARKET_OBSERVATION')""")
def cursor_facts_only(t: Tables) -> DataFrame:
    known = temporal.knowledge_cursor(continuum(t), ts(CURSOR), STRICT, facts_only=True)
    return known.select("record_id", "fixture_id", "epistemic_type", "event_at", "available_at")


@query("epistemic_contract", with_(CONTINUUM) + """
select record_id, concat_ws(',',
    case when epistemic_type in ('OBSERVATION','MARKET_OBSERVATION') and availability_mode <> 'STRICT_PIT' then 'RECONSTRUCTED_LABELLED_OBSERVATION' end,
    case when epistemic_type = 'RECONSTRUCTION' and availability_mode <> 'RECONSTRUCTED_PIT' then 'STRICT_LABELLED_RECONSTRUCTION' end,
    case when evidence_count = 0 then 'NO_EVIDENCE_REFERENCE' end) as reasons,
  not synthetic and epistemic_type in ('OBSERVATION','MARKET_OBSERVATION') as observed_fact from continuum""")
def epistemic_contract(t: Tables) -> DataFrame:
    return continuum(t).select(
        "record_id", F.array_join(temporal.epistemic_reasons(), ",").alias("reasons"), temporal.observed_fact().alias("observed_fact")
    )


@query("first_latest_per_key", """select user_id, min_by(event_id, (ts, event_id)) as first_id, min(ts) as first_at,
  max_by(event_id, (ts, event_id)) as latest_id, max(ts) as latest_at, count(*) as n from events group by user_id""")
def first_latest_per_key(t: Tables) -> DataFrame:
    order = F.struct("ts", "event_id")
    return t.events.groupBy("user_id").agg(
        F.min_by("event_id", order).alias("first_id"), F.min("ts").alias("first_at"),
        F.max_by("event_id", order).alias("latest_id"), F.max("ts").alias("latest_at"), F.count(F.lit(1)).alias("n"),
    )


SCHEDULE = REVISION + """,
schedule as (select entity_key as fixture_id, version as revision, ts as available_at,
  case when record_id % 29 = 0 then null else ts + interval '10' day end as scheduled_at, event_type as status from v_revision)"""


@query("schedule_at", with_(SCHEDULE) + f"""select fixture_id, revision, scheduled_at, status from schedule
  where available_at <= timestamp '{CURSOR}' qualify row_number() over (partition by fixture_id order by revision desc) = 1""")
def schedule_at(t: Tables) -> DataFrame:
    rows = views.revisions(t).select(
        F.col("entity_key").alias("fixture_id"), F.col("version").alias("revision"), F.col("ts").alias("available_at"),
        F.when(F.col("record_id") % 29 != 0, F.col("ts") + span("10 days")).alias("scheduled_at"),
        F.col("event_type").alias("status"),
    )
    known = rows.filter(F.col("available_at") <= ts(CURSOR))
    return temporal.latest_by(known, ["fixture_id"], ["revision"], ["revision", "scheduled_at", "status"])


FAULTY = REVISION + """,
chain as (select record_id, entity_key, case when record_id % 307 = 0 then version + 1 else version end as version,
  case when record_id % 211 = 0 then null else supersedes_id end as supersedes_id,
  case when record_id % 401 = 0 then ts - interval '40' day else available_at end as available_at,
  case when record_id % 503 = 0 then ts - interval '40' day else ts end as ingested_at from v_revision),
numbered as (select *, lag(record_id) over w as p_id, lag(version) over w as p_version, lag(available_at) over w as p_available,
  lag(ingested_at) over w as p_ingested from chain window w as (partition by entity_key order by version, record_id))"""


def faulty_chain(t: Tables) -> DataFrame:
    i = F.col("record_id")
    early = F.col("ts") - span("40 days")
    return views.linked_revisions(t).select(
        "record_id", "entity_key",
        F.when(i % 307 == 0, F.col("version") + 1).otherwise(F.col("version")).alias("version"),
        F.when(i % 211 != 0, F.col("supersedes_id")).alias("supersedes_id"),
        F.when(i % 401 == 0, early).otherwise(F.col("available_at")).alias("available_at"),
        F.when(i % 503 == 0, early).otherwise(F.col("ts")).alias("ingested_at"),
    )


@query("revision_chain_audit", with_(FAULTY) + """
select entity_key, record_id, version, 'VERSION_GAP' as reason from numbered where version <> coalesce(p_version, 0) + 1
union all select entity_key, record_id, version, 'WRONG_PREDECESSOR' from numbered where supersedes_id is distinct from p_id
union all select entity_key, record_id, version, 'INGESTION_BACKWARDS' from numbered where ingested_at < p_ingested
union all select entity_key, record_id, version, 'AVAILABILITY_BACKWARDS' from numbered where available_at < p_available""")
def revision_chain_audit(t: Tables) -> DataFrame:
    return temporal.chain_violations(faulty_chain(t))


@query("horizons_all", with_(MATCH) + """
select match_id, h.horizon, kickoff_at - h.mins * interval '1' minute as decision_at from v_match
cross join (values ('T_MINUS_24H',1440),('T_MINUS_6H',360),('T_MINUS_1H',60),('T_MINUS_15M',15),('KICKOFF',0)) h(horizon, mins)""")
def horizons_all(t: Tables) -> DataFrame:
    targets = t.orders.select(F.col("o_orderkey").alias("match_id"), F.col("o_orderdate").alias("kickoff_at"))
    return temporal.horizons(targets).select("match_id", "horizon", "decision_at")


CLOCKS = """
clocks as (select event_id as record_id, ts as observed_at,
  ts + (event_id % 4 - case when event_id % 17 = 0 then 10 else 0 end) * interval '1' minute as retrieved_at,
  ts + (event_id % 4 + 1) * interval '1' minute as ingested_at,
  case when event_id % 37 = 0 then null else ts + (event_id % 7) * interval '1' minute end as available_at,
  case when event_id % 3 = 0 then 'RECONSTRUCTED_PIT' when event_id % 101 = 0 then 'LIVE' else 'STRICT_PIT' end as availability_mode,
  case when event_id % 43 = 0 then '  ' else 'CAPTURE' end as policy, case when event_id % 59 = 0 then null else event_type end as source,
  case when event_id % 31 = 0 then 1.5e0 else (event_id % 100) / 100e0 end as confidence from events)"""


def clocks(t: Tables) -> DataFrame:
    e = F.col("event_id")
    late = F.when(e % 17 == 0, 10).otherwise(0)
    def minutes(c):
        return F.col("ts") + F.make_dt_interval(mins=c)
    return t.events.select(
        e.alias("record_id"), F.col("ts").alias("observed_at"), minutes(e % 4 - late).alias("retrieved_at"),
        minutes(e % 4 + 1).alias("ingested_at"), F.when(e % 37 != 0, minutes(e % 7)).alias("available_at"),
        F.when(e % 3 == 0, RECONSTRUCTED).when(e % 101 == 0, "LIVE").otherwise(STRICT).alias("availability_mode"),
        F.when(e % 43 == 0, "  ").otherwise("CAPTURE").alias("policy"),
        F.when(e % 59 != 0, F.col("event_type")).alias("source"),
        F.when(e % 31 == 0, 1.5).otherwise((e % 100) / 100.0).alias("confidence"),
    )


@query("availability_contract", with_(CLOCKS) + """
select record_id, concat_ws(',', case when not (observed_at <= retrieved_at and retrieved_at <= ingested_at) then 'CLOCK_ORDER' end,
  case when trim(policy) = '' then 'MISSING_POLICY' end, case when source is null then 'MISSING_SOURCE' end,
  case when confidence > 1 then 'CONFIDENCE_RANGE' end,
  case when availability_mode = 'STRICT_PIT' and available_at < ingested_at then 'STRICT_BACKDATED' end,
  case when availability_mode = 'LIVE' then 'UNKNOWN_MODE' end) as reasons from clocks""")
def availability_contract(t: Tables) -> DataFrame:
    return clocks(t).select("record_id", F.array_join(temporal.availability_reasons(), ",").alias("reasons"))


@query("availability_policy", """
with base as (select o_orderkey as record_id, case when o_orderkey % 7 = 0 then null else o_orderdate + interval '2' hour end as event_at,
  o_orderdate + interval '30' day as observed_at,
  case when o_orderkey % 5 = 0 then o_orderdate + (o_orderkey % 60) * interval '1' day end as published_at,
  cast(o_orderkey % 12 as int) * 1440 as delay from orders),
p as (select *, published_at is not null and published_at <= observed_at as proven,
  event_at is not null and delay > 0 and delay <= 10080 as delayed from base)
select record_id, case when proven then 'SOURCE_PUBLICATION_EVIDENCED_TIMESTAMP' when delayed then 'RESULT_FINAL' else 'UNKNOWN' end as policy,
  case when proven then published_at when delayed then event_at + delay * interval '1' minute end as available_at,
  'RECONSTRUCTED_PIT' as availability_mode, case when proven or delayed then 0.8e0 else 0e0 end as confidence from p""")
def availability_policy(t: Tables) -> DataFrame:
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    rows = t.orders.select(
        k.alias("record_id"), F.when(k % 7 != 0, d + span("2 hours")).alias("event_at"), (d + span("30 days")).alias("observed_at"),
        F.when(k % 5 == 0, d + F.make_dt_interval(days=k % 60)).alias("published_at"),
        ((k % 12).cast("int") * 1440).alias("delay"), F.lit(0.8).alias("confidence"),
    )
    assigned = temporal.assign_availability(rows, F.col("delay"))
    return assigned.select("record_id", "policy", "available_at", "availability_mode", "confidence")
