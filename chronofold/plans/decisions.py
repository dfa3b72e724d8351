"""Research ranking, answers, prediction ledger and operational selections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ledger, research, running, temporal
from ..session import cut_lineage
from . import views
from .registry import query, r
from .sqlviews import MATCH, with_
from .views import Tables, span, ts

NOW = "2024-02-01 00:00:00"
BASE = (0.4, 0.3, 0.3)

NEED = f"""
need as (select p_partkey as need_id, timestamp '{NOW}' + (p_size - 5) * interval '1' hour as deadline, (p_partkey % 9)/2e0 as cost, (p_partkey * 37 % 20000)/1e0 as seconds,
  'f' || cast(p_partkey % 4 as varchar) as missing_field, 3 + p_size % 4 as known_fields, 8 as required_fields from part),
scen as (select need_id, i, case i when 0 then 0.25e0 + (need_id % 3)/4e0 else 0.75e0 - (need_id % 3)/4e0 end as w, 0.2e0 + ((need_id + 3*i) % 6)/10e0 as c1, 0.1e0 + ((need_id + i) % 2)/20e0 as c2
  from need cross join (values (0),(1)) v(i)),
cond as (select need_id, w, c1, c2, 1 - c1 - c2 as c3 from scen),
src as (select source as source_id, case when count(*) % 3 = 0 then 'BLOCKED' else 'APPROVED' end as state from documents group by 1),
allowed as (select need_id, 'src' || cast(case i when 0 then need_id % 23 else need_id * 7 % 23 end as varchar) as source_id, i from need cross join (values (0),(1)) v(i)
  where i = 0 or need_id % 23 <> need_id * 7 % 23),
appr as (select need_id, count(*) as approved_sources, min_by(source_id, i) as first_source from allowed join src using (source_id) where state = 'APPROVED' group by 1),
outlook as (select need_id, sum(w * -(c1*ln(c1) + c2*ln(c2) + c3*ln(c3))) as h, max((abs(c1-0.4e0)+abs(c2-0.3e0)+abs(c3-0.3e0))/2) as tv from cond group by 1),
ranked as (select n.*, coalesce(approved_sources, 0) as approved_sources, first_source, -(0.4e0*ln(0.4e0)+0.6e0*ln(0.3e0)) - h as gain, tv,
  coalesce(approved_sources > 0 and timestamp '{NOW}' < deadline and cost <= 3 and seconds < date_diff('second', timestamp '{NOW}', deadline), false) as feasible
  from need n join outlook using (need_id) left join appr using (need_id))"""


def needs(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    return t.part.select(
        k.alias("need_id"), (ts(NOW) + F.make_dt_interval(hours=F.col("p_size") - 5)).alias("deadline"), ((k % 9) / 2.0).alias("cost"), (k * 37 % 20000).cast("double").alias("seconds"),
        F.concat(F.lit("f"), (k % 4).cast("string")).alias("missing_field"), (3 + F.col("p_size") % 4).alias("known_fields"), F.lit(8).alias("required_fields"),
        *[F.lit(b).alias(c) for b, c in zip(BASE, research.BASE)])


def ranked(t: Tables) -> DataFrame:
    n, k, i = needs(t), F.col("need_id"), F.col("i")
    two = F.explode(F.array(F.lit(0), F.lit(1))).alias("i")
    c1, c2 = 0.2 + ((k + 3 * i) % 6) / 10.0, 0.1 + ((k + i) % 2) / 20.0
    scenarios = n.select("need_id", two).select("need_id", F.when(i == 0, 0.25 + (k % 3) / 4.0).otherwise(0.75 - (k % 3) / 4.0).alias("weight"),
                                                c1.alias("c_home"), c2.alias("c_draw"), (1 - c1 - c2).alias("c_away"))
    first, second = k % 23, k * 7 % 23
    allowed = n.select("need_id", two).filter((i == 0) | (first != second)).select(
        "need_id", F.concat(F.lit("src"), F.when(i == 0, first).otherwise(second).cast("string")).alias("source_id"), i.alias("position"))
    states = t.documents.groupBy(F.col("source").alias("source_id")).agg(F.when(F.count(F.lit(1)) % 3 == 0, "BLOCKED").otherwise("APPROVED").alias("state"))
    return research.rank(n, scenarios, allowed, states, ts(NOW), 3.0)


@query("research_rank", with_(NEED) + """select need_id, feasible, approved_sources, round(gain,7)+0e0 as entropy_gain, round(tv,7) as max_total_variation,
  round(case when feasible then greatest(0e0, gain)/(1+cost+seconds/60) else 0e0 end, 7) as priority from ranked""")
def research_rank(t: Tables) -> DataFrame:
    out = ranked(t).select("need_id", "feasible", "approved_sources", r("entropy_gain", 7), r("max_total_variation", 7), r("priority", 7))
    return out.orderBy(F.col("priority").desc(), "need_id")


@query("answer_states", with_(NEED) + f""",
ans as (select need_id, case when need_id % 11 <> 0 then case when need_id % 13 = 0 then 'other' else first_source end end as answer_source,
    case when need_id % 17 = 0 then 'fx' else missing_field end as field, timestamp '{NOW}' + (case when need_id % 19 = 0 then 1 else -1 end) * interval '1' hour as available_at,
    case when need_id % 23 = 0 then 'RECONSTRUCTED_PIT' else 'STRICT_PIT' end as mode, case when need_id % 29 = 0 then null else need_id % 5 <> 0 end as valid,
    case when need_id % 31 <> 0 then 0.6e0 end as a1, 0.25e0 as a2, 0.15e0 as a3 from ranked),
st as (select r.*, a.a1, a.a2, a.a3, case when timestamp '{NOW}' >= deadline then 'DEADLINE_EXPIRED' when approved_sources = 0 then 'TERMS_BLOCKED' when not feasible or answer_source is null then 'SOURCE_UNAVAILABLE'
    when not (answer_source = first_source and field = missing_field and available_at <= timestamp '{NOW}' and mode = 'STRICT_PIT') then 'REJECT' when not coalesce(valid, false) then 'QUARANTINE'
    when a1 is null then 'MODEL_FAILURE' else 'VALIDATED_RECALCULATED' end as state from ranked r join ans a using (need_id))
select need_id, state, round(-(0.4e0*ln(0.4e0)+0.6e0*ln(0.3e0)),7) as entropy_before, case when state='VALIDATED_RECALCULATED' then round(-(0.6e0*ln(0.6e0)+0.25e0*ln(0.25e0)+0.15e0*ln(0.15e0)),7) end as entropy_after,
  case when state='VALIDATED_RECALCULATED' then round(-(0.4e0*ln(0.4e0)+0.6e0*ln(0.3e0)) + (0.6e0*ln(0.6e0)+0.25e0*ln(0.25e0)+0.15e0*ln(0.15e0)),7) end as entropy_reduction,
  round(known_fields/8e0,6) as completeness_before, round((known_fields + cast(state='VALIDATED_RECALCULATED' as int))/8e0,6) as completeness_after from st""")
def answer_states(t: Tables) -> DataFrame:
    ranks, k = ranked(t), F.col("need_id")
    answers = ranks.select(
        "need_id", F.when(k % 11 != 0, F.when(k % 13 == 0, "other").otherwise(F.col("first_source"))).alias("answer_source"),
        F.when(k % 17 == 0, "fx").otherwise(F.col("missing_field")).alias("field"), (ts(NOW) + F.make_dt_interval(hours=F.when(k % 19 == 0, 1).otherwise(-1))).alias("available_at"),
        (ts(NOW) - span("1 hour")).alias("ingested_at"), F.when(k % 23 == 0, "RECONSTRUCTED_PIT").otherwise("STRICT_PIT").alias("availability_mode"),
        F.when(k % 29 != 0, k % 5 != 0).alias("valid"), F.when(k % 31 != 0, 0.6).alias("a_home"), F.lit(0.25).alias("a_draw"), F.lit(0.15).alias("a_away"))
    out = research.answer_states(ranks, answers, ts(NOW))
    return out.select("need_id", "state", r("entropy_before", 7), r("entropy_after", 7), r("entropy_reduction", 7), r("completeness_before"), r("completeness_after"))


# -- ledger --------------------------------------------------------------------------------------

PREDICTION = """
pred as (select o_orderkey as prediction_id, o_custkey as chain, o_orderdate + (o_orderkey % 37 - 1) * interval '1' hour as issued_at, o_orderdate + interval '1' day as kickoff_at,
  0.2e0 + (o_orderkey % 5)/10e0 as p_home, 0.2e0 as p_draw, case when o_orderkey % 43 = 0 then 0.9e0 else 0.6e0 - (o_orderkey % 5)/10e0 end as p_away,
  'src' || cast(o_orderkey % 3 as varchar) as declared_source, case when o_orderkey % 47 = 0 then null else 'h' end as artifact_hash, o_orderkey % 10 = 0 as synthetic from orders)"""


def predictions(t: Tables) -> DataFrame:
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    return t.orders.select(
        k.alias("prediction_id"), F.col("o_custkey").alias("chain"), (d + F.make_dt_interval(hours=k % 37 - 1)).alias("issued_at"), (d + span("1 day")).alias("kickoff_at"),
        (0.2 + (k % 5) / 10.0).alias("p_home"), F.lit(0.2).alias("p_draw"), F.when(k % 43 == 0, 0.9).otherwise(0.6 - (k % 5) / 10.0).alias("p_away"),
        F.concat(F.lit("src"), (k % 3).cast("string")).alias("declared_source"), F.when(k % 47 != 0, "h").alias("artifact_hash"), (k % 10 == 0).alias("synthetic"))


@query("ledger_gate", with_(PREDICTION) + """,
inp as (select l_orderkey as prediction_id, o.o_orderdate + (l_linenumber - 4) * interval '5' hour as available_at, o.o_orderdate - interval '1' day as ingested_at,
  case when l_linenumber = 7 then 'RECONSTRUCTED_PIT' else 'STRICT_PIT' end as mode, 'src' || cast(case when l_partkey % 50 = 0 then 9 else l_orderkey % 3 end as varchar) as source
  from lineitem join orders o on o.o_orderkey = l_orderkey),
facts as (select prediction_id, count(*) as n, count(case when not (available_at <= issued_at and mode = 'STRICT_PIT' and ingested_at <= issued_at) then 1 end) as bad,
  count(case when source <> declared_source then 1 end) as undeclared from inp join pred using (prediction_id) group by 1)
select prediction_id, concat_ws(',', case when issued_at >= kickoff_at then 'ISSUED_AFTER_KICKOFF' end, case when abs(p_home+p_draw+p_away-1) > 1e-9 then 'INVALID_PROBABILITIES' end,
  case when n is null then 'NO_INPUTS' end, case when bad > 0 then 'INPUT_NOT_AVAILABLE' end, case when undeclared > 0 then 'INPUT_SOURCE_UNDECLARED' end,
  case when artifact_hash is null and not synthetic then 'ARTIFACT_HASH_REQUIRED' end) as reasons from pred left join facts using (prediction_id)""")
def ledger_gate(t: Tables) -> DataFrame:
    o, l = t.orders.select("o_orderkey", "o_orderdate"), t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    inputs = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("prediction_id"), (F.col("o_orderdate") + F.make_dt_interval(hours=(F.col("l_linenumber") - 4) * 5)).alias("available_at"),
        (F.col("o_orderdate") - span("1 day")).alias("ingested_at"), F.when(F.col("l_linenumber") == 7, "RECONSTRUCTED_PIT").otherwise("STRICT_PIT").alias("availability_mode"),
        F.concat(F.lit("src"), F.when(F.col("l_partkey") % 50 == 0, 9).otherwise(F.col("l_orderkey") % 3).cast("string")).alias("source"))
    return ledger.gate_predictions(predictions(t), inputs).select("prediction_id", F.array_join("reasons", ",").alias("reasons"))


OUTCOME = """
outc as (select o_orderkey * 2 as outcome_id, case when o_orderkey % 53 = 0 then -1 else o_orderkey end as prediction_id, o_orderdate + (26 + case when o_orderkey % 59 = 0 then -3 else 0 end) * interval '1' hour as completed_at,
    o_orderdate + interval '30' hour as observed_at, o_orderdate + (case when o_orderkey % 61 = 0 then 60 else 31 end) * interval '1' hour as available_at, o_orderdate + interval '48' hour as recorded_at,
    case o_orderkey % 3 when 0 then 'HOME' when 1 then 'DRAW' else 'AWAY' end as outcome, case when o_orderkey % 67 = 0 then true else o_orderkey % 10 = 0 end as synthetic from orders where o_orderkey % 4 < 3
  union all select o_orderkey * 2 + 1, o_orderkey, o_orderdate + interval '26' hour, o_orderdate + interval '30' hour, o_orderdate + interval '31' hour, o_orderdate + interval '50' hour, 'HOME', o_orderkey % 10 = 0 from orders where o_orderkey % 71 = 0)"""


def outcomes(t: Tables) -> DataFrame:
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    def hours(n):
        return d + F.make_dt_interval(hours=n if not isinstance(n, int) else F.lit(n))
    first = t.orders.filter(k % 4 < 3).select(
        (k * 2).alias("outcome_id"), F.when(k % 53 == 0, -1).otherwise(k).alias("prediction_id"), hours(26 + F.when(k % 59 == 0, -3).otherwise(0)).alias("completed_at"),
        hours(30).alias("observed_at"), hours(F.when(k % 61 == 0, 60).otherwise(31)).alias("available_at"), hours(48).alias("recorded_at"),
        F.when(k % 3 == 0, "HOME").when(k % 3 == 1, "DRAW").otherwise("AWAY").alias("outcome"), F.when(k % 67 == 0, True).otherwise(k % 10 == 0).alias("synthetic"))
    again = t.orders.filter(k % 71 == 0).select((k * 2 + 1).alias("outcome_id"), k.alias("prediction_id"), hours(26).alias("completed_at"), hours(30).alias("observed_at"),
                                                hours(31).alias("available_at"), hours(50).alias("recorded_at"), F.lit("HOME").alias("outcome"), (k % 10 == 0).alias("synthetic"))
    return first.unionByName(again)


@query("ledger_outcomes", with_(PREDICTION, OUTCOME) + """,
j as (select o.*, p.kickoff_at, p.p_home, p.p_draw, p.p_away, p.synthetic as ps, first_value(outcome_id) over (partition by o.prediction_id order by recorded_at, outcome_id) as first_id
  from outc o left join pred p using (prediction_id)),
g as (select *, concat_ws(',', case when kickoff_at is null then 'PREDICTION_UNKNOWN' end, case when outcome_id <> first_id then 'ALREADY_SCORED' end,
  case when not (kickoff_at < completed_at and completed_at <= observed_at and observed_at <= recorded_at) then 'CHRONOLOGY' end,
  case when available_at > recorded_at then 'NOT_AVAILABLE_AT_RECORDING' end, case when synthetic <> ps then 'MIXED_EVIDENCE_CLASS' end) as reasons from j)
select outcome_id, prediction_id, reasons, case when reasons = '' then round(-ln(case outcome when 'HOME' then p_home when 'DRAW' then p_draw else p_away end),7) end as log_loss,
  case when reasons = '' then round((pow(p_home-cast(outcome='HOME' as int),2)+pow(p_home+p_draw-cast(outcome in ('HOME','DRAW') as int),2))/2,7) end as rps from g""")
def ledger_outcomes(t: Tables) -> DataFrame:
    safe = predictions(t)
    out = ledger.gate_outcomes(safe.select("prediction_id", "kickoff_at", "p_home", "p_draw", "p_away", "synthetic"), outcomes(t))
    return out.select("outcome_id", "prediction_id", F.array_join("reasons", ",").alias("reasons"), r("log_loss", 7), r("rps", 7))


@query("pending_outcomes", with_(PREDICTION, OUTCOME) + """,
cap as (select o_orderkey as prediction_id, case when o_orderkey % 5 = 0 then 'SCHEDULED' else 'REPORTED_FINAL' end as status, cast(o_orderdate as date) as match_date,
  o_orderdate + (o_orderkey % 60) * interval '1' hour as captured_at from orders)
select prediction_id, captured_at from pred join cap using (prediction_id) where not synthetic and prediction_id not in (select prediction_id from outc)
  and status = 'REPORTED_FINAL' and match_date < cast(captured_at as date) and captured_at > kickoff_at""")
def pending_outcomes(t: Tables) -> DataFrame:
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    captured = t.orders.select(k.alias("fixture_id"), F.when(k % 5 == 0, "SCHEDULED").otherwise("REPORTED_FINAL").alias("status"), F.to_date(d).alias("match_date"),
                               (d + F.make_dt_interval(hours=k % 60)).alias("captured_at"))
    found = ledger.pending_outcomes(predictions(t).withColumn("fixture_id", F.col("prediction_id")), outcomes(t), captured)
    return found.select("prediction_id", "captured_at")


BODY = ("prediction_id", "declared_source")
CHAIN = PREDICTION + """,
seq as (select chain, prediction_id, declared_source, issued_at as recorded_at, row_number() over (partition by chain order by issued_at, prediction_id) as sequence from pred),
linked as (
  select chain, prediction_id, declared_source, recorded_at, sequence, repeat('0', 64) as previous_hash,
    sha256(repeat('0', 64) || '|' || cast(sequence as varchar) || '|' || cast(prediction_id as varchar) || '|' || declared_source) as hash from seq where sequence = 1
  union all select s.chain, s.prediction_id, s.declared_source, s.recorded_at, s.sequence, l.hash,
    sha256(l.hash || '|' || cast(s.sequence as varchar) || '|' || cast(s.prediction_id as varchar) || '|' || s.declared_source)
  from linked l join seq s on s.chain = l.chain and s.sequence = l.sequence + 1)"""


def chained(t: Tables) -> DataFrame:
    rows = predictions(t).select("chain", "prediction_id", "declared_source", F.col("issued_at").alias("recorded_at"))
    return ledger.build_chain(rows, "chain", ["recorded_at", "prediction_id"], BODY, running.calendar_slice("recorded_at"))


@query("hash_chain", "with recursive " + CHAIN + " select chain, prediction_id, sequence, previous_hash, hash from linked")
def hash_chain(t: Tables) -> DataFrame:
    return chained(t).select("chain", "prediction_id", "sequence", "previous_hash", "hash")


@query("ledger_verify", "with recursive " + CHAIN + """,
tampered as (select chain, prediction_id, case when prediction_id % 401 = 0 then 'srcX' else declared_source end as declared_source,
  case when prediction_id % 503 = 0 then recorded_at - interval '9000' day else recorded_at end as recorded_at, sequence,
  case when prediction_id % 307 = 0 then repeat('f', 64) else previous_hash end as previous_hash, hash from linked where prediction_id % 601 <> 0),
s as (select *, lag(hash) over w as ph, lag(sequence) over w as psq, lag(recorded_at) over w as pr from tampered window w as (partition by chain order by sequence))
select chain, sequence, 'SEQUENCE_BROKEN' as violation from s where sequence <> coalesce(psq, 0) + 1
union all select chain, sequence, 'PREVIOUS_HASH_MISMATCH' from s where previous_hash <> coalesce(ph, repeat('0', 64))
union all select chain, sequence, 'BODY_HASH_MISMATCH' from s where hash <> sha256(previous_hash || '|' || cast(sequence as varchar) || '|' || cast(prediction_id as varchar) || '|' || declared_source)
union all select chain, sequence, 'CLOCK_BACKWARDS' from s where recorded_at < pr
union all select t.chain, t.sequence, 'HEAD_MISMATCH' from (select chain, max(sequence) as sequence, max_by(hash, sequence) as h from tampered group by 1) t
  join (select chain, max_by(hash, sequence) as expected from linked group by 1) e using (chain) where t.h <> e.expected""")
def ledger_verify(t: Tables) -> DataFrame:
    """A tampered copy of the ledger checked against its own hashes and the retained heads."""
    clean, k = cut_lineage(chained(t)), F.col("prediction_id")
    heads = clean.groupBy("chain").agg(F.max_by("hash", "sequence").alias("expected_head"))
    bad = clean.filter(k % 601 != 0).withColumns({
        "declared_source": F.when(k % 401 == 0, "srcX").otherwise(F.col("declared_source")),
        "recorded_at": F.when(k % 503 == 0, F.col("recorded_at") - span("9000 days")).otherwise(F.col("recorded_at")),
        "previous_hash": F.when(k % 307 == 0, F.repeat(F.lit("f"), 64)).otherwise(F.col("previous_hash"))})
    return ledger.chain_violations(bad, "chain", BODY, heads)


@query("next_target", with_(MATCH) + """, c as (select competition_id, match_id, cast(kickoff_at as date) - interval '14' hour as lower_bound from v_match where match_id % 3 <> 0)
select competition_id, min(lower_bound) as lower_bound, min_by(match_id, (lower_bound, match_id)) as match_id from c where lower_bound > timestamp '1998-06-01 13:00:00' group by 1""")
def next_target(t: Tables) -> DataFrame:
    """Earliest future schedule bound per competition: calendar day minus 14 hours, over an hour away."""
    rows = views.matches(t).filter(F.col("match_id") % 3 != 0).select(
        "competition_id", "match_id", (F.to_date("kickoff_at").cast("timestamp_ntz") - span("14 hours")).alias("lower_bound"))
    future = rows.filter(F.col("lower_bound") > ts("1998-06-01 12:00:00") + span("1 hour"))
    return temporal.latest_by(future, ["competition_id"], ["lower_bound", "match_id"], ["lower_bound", "match_id"], first=True)


@query("strict_inputs", with_(MATCH) + """
select match_id, competition_id, cast(kickoff_at as date) + interval '1' day as completed_at, home_goals, away_goals, timestamp '1999-01-01 00:00:00' as available_at
from v_match where match_id % 6 <> 0 and match_id % 7 <> 0 and match_id % 11 <> 0 and cast(kickoff_at as date) + interval '1' day < timestamp '1999-01-01 00:00:00'""")
def strict_inputs(t: Tables) -> DataFrame:
    """Final, genuine, provenance-matched fixtures of a capture; availability is the construction time."""
    built = ts("1999-01-01 00:00:00")
    k = F.col("match_id")
    fixtures = views.matches(t).select(
        "match_id", "competition_id", "kickoff_at", "home_goals", "away_goals", F.when(k % 6 == 0, "SCHEDULED").otherwise("REPORTED_FINAL").alias("status"),
        (k % 7 == 0).alias("synthetic"), F.when(k % 11 == 0, "other").otherwise("snap").alias("snapshot_id"))
    day = F.to_date("kickoff_at").cast("timestamp_ntz")
    kept = fixtures.filter((F.col("status") == "REPORTED_FINAL") & ~F.col("synthetic") & (F.col("snapshot_id") == "snap") & (day + span("1 day") < built))
    return kept.select("match_id", "competition_id", (day + span("1 day")).alias("completed_at"), "home_goals", "away_goals", built.alias("available_at"))


@query("historical_inputs", with_(MATCH) + """
select match_id, cast(kickoff_at as date) as kickoff_day, cast(kickoff_at as date) - interval '1' day as schedule_available_at, cast(kickoff_at as date) + interval '1' day as completed_at,
  cast(kickoff_at as date) + interval '2' day as available_at, outcome, 'RECONSTRUCTED_PIT' as availability_mode from v_match""")
def historical_inputs(t: Tables) -> DataFrame:
    """Calendar-day proxies: schedule known a day before, completion a day after, result two days after."""
    from ..functions import scores
    day = F.to_date("kickoff_at").cast("timestamp_ntz")
    return views.matches(t).select(
        "match_id", F.to_date("kickoff_at").alias("kickoff_day"), (day - span("1 day")).alias("schedule_available_at"), (day + span("1 day")).alias("completed_at"),
        (day + span("2 days")).alias("available_at"), scores.outcome(F.col("home_goals"), F.col("away_goals")).alias("outcome"), F.lit("RECONSTRUCTED_PIT").alias("availability_mode"))
