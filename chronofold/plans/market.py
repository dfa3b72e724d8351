"""Market and price analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import forecast, market, temporal
from . import views
from .registry import query, r
from .sqlviews import MATCH, QUOTE, league, with_
from .views import RECONSTRUCTED, STRICT, Tables, span, ts

AT = "2024-01-20 00:00:00"
FAIR = market.FAIR

# Quotes with hourly stamps, corrections, providers, kickoff and class; some rows break a rule.
RICH = QUOTE + """,
v_rich as (
  select q.* exclude (quoted_at, available_at), date_trunc('hour', quoted_at) as quoted_at,
    case when snapshot_id % 61 = 0 then null else date_trunc('hour', quoted_at) + (snapshot_id % 2 + 1) * interval '5' minute end as available_at,
    case when snapshot_id % 3 = 0 then 'RECONSTRUCTED_PIT' else 'STRICT_PIT' end as availability_mode,
    timestamp '2024-02-01 00:00:00' + (case when snapshot_id % 997 = 0 then 1 else 0 end) * interval '1' hour
      - (case when snapshot_id % 313 = 0 then 40 else 0 end) * interval '1' day as kickoff_at,
    case when snapshot_id % 613 = 0 then 'px' else 'p' || cast(fixture_id % 3 as varchar) end as provider,
    fixture_id in (3, 7) and snapshot_id % 2 = 0 as synthetic,
    case when snapshot_id % 5 = 0 then 'proof' when snapshot_id % 101 = 0 then ' ' end as closing_evidence
  from v_quote q),
known as (select * from v_rich where quoted_at <= timestamp '""" + AT + "' and available_at <= timestamp '" + AT + "')"


def rich_quotes(t: Tables) -> DataFrame:
    i = F.col("snapshot_id")
    hour = F.date_trunc("hour", F.col("quoted_at")).cast("timestamp_ntz")
    return views.quotes(t).withColumns({
        "available_at": F.when(i % 61 != 0, hour + F.make_dt_interval(mins=(i % 2 + 1) * 5)),
        "quoted_at": hour,
        "availability_mode": F.when(i % 3 == 0, RECONSTRUCTED).otherwise(STRICT),
        "kickoff_at": ts("2024-02-01 00:00:00") + F.make_dt_interval(
            days=-F.when(i % 313 == 0, 40).otherwise(0), hours=F.when(i % 997 == 0, 1).otherwise(0)),
        "provider": F.when(i % 613 == 0, "px").otherwise(F.concat(F.lit("p"), (F.col("fixture_id") % 3).cast("string"))),
        "synthetic": F.col("fixture_id").isin(3, 7) & (i % 2 == 0),
        "closing_evidence": F.when(i % 5 == 0, "proof").when(i % 101 == 0, " "),
    })


def known(t: Tables) -> DataFrame:
    return market.as_of(rich_quotes(t), ts(AT), RECONSTRUCTED)


@query("market_as_of", with_(RICH) + "select snapshot_id, fixture_id, bookmaker_id, quoted_at, available_at from known")
def market_as_of(t: Tables) -> DataFrame:
    return known(t).select("snapshot_id", "fixture_id", "bookmaker_id", "quoted_at", "available_at")


@query("market_violations", with_(RICH) + """
select fixture_id, 'MIXED_KICKOFF' as violation, cast(1 as bigint) as cases from known group by 1 having count(distinct kickoff_at) > 1
union all select fixture_id, 'SYNTHETIC_POOLED_WITH_REAL', 1 from known group by 1 having count(distinct synthetic) > 1
union all select fixture_id, 'CROSS_PROVIDER', 1 from known group by 1 having count(distinct provider) > 1
union all select fixture_id, 'AMBIGUOUS_REVISION', count(*) from (select fixture_id from known group by fixture_id, bookmaker_id, quoted_at, available_at
   having count(distinct (odds_home, odds_draw, odds_away)) > 1) group by 1""")
def market_violations(t: Tables) -> DataFrame:
    return market.violations(known(t))


@query("opening_latest", with_(RICH) + """select fixture_id, bookmaker_id, first_retained, latest_retained, nullif(vc, -1) as verified_closing, quotes from (
  select fixture_id, bookmaker_id, min_by(snapshot_id, (quoted_at, available_at, snapshot_id)) as first_retained,
  max_by(snapshot_id, (quoted_at, available_at, snapshot_id)) as latest_retained,
  max_by(case when closing_evidence is not null then snapshot_id else -1 end, (quoted_at, available_at, snapshot_id)) as vc, count(*) as quotes
  from known group by 1,2)""")
def opening_latest(t: Tables) -> DataFrame:
    return market.opening_latest(known(t))


LATEST = """,
latest as (select * from known qualify row_number() over (partition by fixture_id, bookmaker_id order by quoted_at desc, available_at desc, snapshot_id desc) = 1),
fair as (select *, (1/odds_home)/(1/odds_home+1/odds_draw+1/odds_away) as fair_home, (1/odds_draw)/(1/odds_home+1/odds_draw+1/odds_away) as fair_draw,
  (1/odds_away)/(1/odds_home+1/odds_draw+1/odds_away) as fair_away from latest),
con as (select fixture_id, count(*) as bookmakers, avg(fair_home) as fair_home, avg(fair_draw) as fair_draw, avg(fair_away) as fair_away from fair group by 1)"""


def fair_out(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, *[r(f, 8) for f in FAIR])


@query("consensus_proportional", with_(RICH) + LATEST + "select fixture_id, bookmakers, round(fair_home,8) as fair_home, round(fair_draw,8) as fair_draw, round(fair_away,8) as fair_away from con")
def consensus_proportional(t: Tables) -> DataFrame:
    return fair_out(market.consensus(known(t)), "fixture_id", "bookmakers")


def powered(source: str) -> str:
    """The exponent of every quote of `source`, halving an interval sixty times."""
    return f""",
halves as (
  select snapshot_id, 1/odds_home as q1, 1/odds_draw as q2, 1/odds_away as q3, 0e0 as lo, 4096e0 as hi, 0 as i from {source}
  union all select snapshot_id, q1, q2, q3, case when pow(q1, (lo+hi)/2) + pow(q2, (lo+hi)/2) + pow(q3, (lo+hi)/2) > 1 then (lo+hi)/2 else lo end,
    case when pow(q1, (lo+hi)/2) + pow(q2, (lo+hi)/2) + pow(q3, (lo+hi)/2) > 1 then hi else (lo+hi)/2 end, i + 1 from halves where i < 70),
solved as (select snapshot_id, (lo+hi)/2 as k, pow(q1,(lo+hi)/2) as f1, pow(q2,(lo+hi)/2) as f2, pow(q3,(lo+hi)/2) as f3 from halves where i = 70)"""


def recursive(*parts: str) -> str:
    return with_(*parts).replace("with", "with recursive", 1)


@query("consensus_power", recursive(RICH) + LATEST + powered("latest") + """
select fixture_id, count(*) as bookmakers, round(avg(f1/(f1+f2+f3)),8) as fair_home, round(avg(f2/(f1+f2+f3)),8) as fair_draw, round(avg(f3/(f1+f2+f3)),8) as fair_away
from latest join solved using (snapshot_id) group by 1""")
def consensus_power(t: Tables) -> DataFrame:
    return fair_out(market.consensus(known(t), "POWER"), "fixture_id", "bookmakers")


@query("power_demargin", recursive(QUOTE) + powered("v_quote") + """
select snapshot_id, round(k,6) as exponent, round(f1/(f1+f2+f3),8) as fair_home, round(f2/(f1+f2+f3),8) as fair_draw, round(f3/(f1+f2+f3),8) as fair_away from solved""")
def power_demargin(t: Tables) -> DataFrame:
    """Exponent and fair probabilities of every quote by the power method."""
    fair = market.demargined(views.quotes(t).withColumn("k", scores.power_exponent(market.odds_columns())), "POWER")
    return fair.select("snapshot_id", F.round("k", 6).alias("exponent"), *[r(f, 8) for f in FAIR])


@query("consensus_report", with_(RICH) + LATEST + """,
asked as (select range as fixture_id from range(45)),
strength as (select fixture_id, count(*) as inputs, bool_or(synthetic) as s, bool_or(availability_mode = 'RECONSTRUCTED_PIT') as rc from known group by 1),
proof as (select fixture_id, string_agg(cast(snapshot_id as varchar), ',' order by snapshot_id) as latest_inputs from latest group by 1)
select a.fixture_id, case when c.fixture_id is not null then 'CALCULATED' else 'INSUFFICIENT_EVIDENCE' end as state,
  case when rc then 'RECONSTRUCTED_PIT' when c.fixture_id is not null then 'STRICT_PIT' end as temporal_mode, s as synthetic, coalesce(inputs, 0) as inputs, latest_inputs,
  round(fair_home,8) as fair_home, round(fair_draw,8) as fair_draw, round(fair_away,8) as fair_away
from asked a left join con c using (fixture_id) left join strength using (fixture_id) left join proof using (fixture_id)""")
def consensus_report(t: Tables) -> DataFrame:
    asked = t.spark.range(45).withColumnRenamed("id", "fixture_id")
    out = market.consensus_report(asked, known(t))
    return fair_out(out, "fixture_id", "state", "temporal_mode", "synthetic", "inputs", "latest_inputs")


PATH = """,
res as (select * from known qualify row_number() over (partition by fixture_id, bookmaker_id, quoted_at order by available_at desc, snapshot_id desc) = 1),
path as (select *, (1/odds_home)/(1/odds_home+1/odds_draw+1/odds_away) as f1, (1/odds_draw)/(1/odds_home+1/odds_draw+1/odds_away) as f2,
  (1/odds_away)/(1/odds_home+1/odds_draw+1/odds_away) as f3 from {source}),
stepped as (select *, lag(quoted_at) over w as pq, lag(f1) over w as p1, lag(f2) over w as p2, lag(f3) over w as p3 from path
  window w as (partition by fixture_id, bookmaker_id order by quoted_at)),
vel as (select *, (f1-p1)/(date_diff('second', pq, quoted_at)/3600e0) as v1, (f2-p2)/(date_diff('second', pq, quoted_at)/3600e0) as v2,
  (f3-p3)/(date_diff('second', pq, quoted_at)/3600e0) as v3 from stepped
  qualify row_number() over (partition by fixture_id, bookmaker_id order by quoted_at desc) = 1)"""


@query("trajectory", with_(RICH) + PATH.format(source="known") + """
select snapshot_id, fixture_id, bookmaker_id, quoted_at, round(f1,8) as fair_home, round(f2,8) as fair_draw, round(f3,8) as fair_away,
  snapshot_id in (select snapshot_id from res) as current from path""")
def trajectory(t: Tables) -> DataFrame:
    return fair_out(market.trajectory(known(t)), "snapshot_id", "fixture_id", "bookmaker_id", "quoted_at", "current")


@query("velocity", with_(RICH) + PATH.format(source="res") + """
select fixture_id, bookmaker_id, quoted_at, round(f1,8) as fair_home, round(f2,8) as fair_draw, round(f3,8) as fair_away,
  round(v1,8)+0e0 as v_home, round(v2,8)+0e0 as v_draw, round(v3,8)+0e0 as v_away from vel where pq is not null""")
def velocity(t: Tables) -> DataFrame:
    out = market.velocity(known(t))
    return fair_out(out, "fixture_id", "bookmaker_id", "quoted_at", "v_home", "v_draw", "v_away").withColumns(
        {v: F.round(v, 8) + 0.0 for v in ("v_home", "v_draw", "v_away")})


@query("projection", with_(RICH) + PATH.format(source="res") + f""",
raw as (select fixture_id, bookmaker_id, f1, f2, f3, date_diff('second', quoted_at, timestamp '2024-01-20 12:00:00')/3600e0 as h, v1, v2, v3 from vel where pq is not null),
cut as (select *, greatest(0e0, least(1e0, f1+v1*h)) as c1, greatest(0e0, least(1e0, f2+v2*h)) as c2, greatest(0e0, least(1e0, f3+v3*h)) as c3 from raw)
select fixture_id, bookmaker_id, 'HYPOTHESIS' as epistemic_type, round(case when c1+c2+c3 > 0 then c1/(c1+c2+c3) else f1 end,7) as projected_home,
  round(case when c1+c2+c3 > 0 then c2/(c1+c2+c3) else f2 end,7) as projected_draw, round(case when c1+c2+c3 > 0 then c3/(c1+c2+c3) else f3 end,7) as projected_away from cut""")
def projection(t: Tables) -> DataFrame:
    out = market.projection(known(t), ts(AT), ts("2024-01-20 12:00:00"))
    return out.select("fixture_id", "bookmaker_id", "epistemic_type", *[r(f"projected_{k}", 7) for k in scores.LETTERS])


@query("movement", with_(QUOTE) + """, m as (
  select snapshot_id, lag(quoted_at) over w as pq, quoted_at, odds_home, odds_draw, odds_away, lag(odds_home) over w as ph, lag(odds_draw) over w as pd,
    lag(odds_away) over w as pa from v_quote window w as (partition by fixture_id, bookmaker_id order by quoted_at, snapshot_id)),
u as (select snapshot_id, pq, quoted_at, 'HOME' as selection, ph as o, odds_home as n from m union all select snapshot_id, pq, quoted_at, 'DRAW', pd, odds_draw from m
  union all select snapshot_id, pq, quoted_at, 'AWAY', pa, odds_away from m)
select snapshot_id, selection, round(n-o,6)+0e0 as odds_delta, round((n-o)/o*100,6)+0e0 as percentage_movement,
  cast(floor(date_diff('microsecond', pq, quoted_at)/1000000) as bigint) as seconds_between from u where pq is not null""")
def movement(t: Tables) -> DataFrame:
    out = market.movement(views.quotes(t))
    return out.select("snapshot_id", "selection", r("odds_delta"), r("percentage_movement"), "seconds_between")


@query("quote_conflicts", with_(RICH) + """
select fixture_id, provider, bookmaker_id, quoted_at, count(*) as quotes,
  case when count(*) = 1 then 'DISTINCT' when count(distinct (odds_home, availability_mode)) = 1 then 'DUPLICATE' else 'CONFLICTING_DATA' end as state
from v_rich group by 1,2,3,4""")
def quote_conflicts(t: Tables) -> DataFrame:
    return market.quote_classes(rich_quotes(t), ["fixture_id", "provider", "bookmaker_id", "quoted_at"], ["odds_home", "availability_mode"])


@query("overround", with_(QUOTE) + """select fixture_id, bookmaker_id, count(*) as quotes, round(avg(1/odds_home+1/odds_draw+1/odds_away-1),8) as mean_overround,
  round(min(1/odds_home+1/odds_draw+1/odds_away-1),8) as min_overround, round(max(1/odds_home+1/odds_draw+1/odds_away-1),8) as max_overround from v_quote group by 1,2""")
def overround(t: Tables) -> DataFrame:
    over = sum((scores.implied(o) for o in market.odds_columns()), F.lit(0.0)) - 1
    q = views.quotes(t).withColumn("over", over)
    return q.groupBy("fixture_id", "bookmaker_id").agg(
        F.count(F.lit(1)).alias("quotes"), r(F.avg("over"), 8).alias("mean_overround"), r(F.min("over"), 8).alias("min_overround"), r(F.max("over"), 8).alias("max_overround"))


@query("fair_odds", with_(QUOTE) + """select snapshot_id, round(odds_home*(1/odds_home+1/odds_draw+1/odds_away),7) as fair_home_price,
  case when fixture_id = 0 then null else round(odds_draw*(1/odds_home+1/odds_draw+1/odds_away),7) end as fair_draw_price from v_quote""")
def fair_odds(t: Tables) -> DataFrame:
    f = market.demargined(views.quotes(t))
    draw = F.when(F.col("fixture_id") == 0, 0.0).otherwise(F.col("fair_draw"))
    return f.select("snapshot_id", F.round(scores.fair_price(F.col("fair_home")), 7).alias("fair_home_price"), F.round(scores.fair_price(draw), 7).alias("fair_draw_price"))


CONTRACT = RICH + """,
contract as (select snapshot_id, case when snapshot_id % 211 = 0 then 1e0 else odds_home end as odds_home, odds_draw, odds_away, quoted_at, kickoff_at,
  case when snapshot_id % 89 = 0 then quoted_at - interval '1' minute else available_at end as available_at,
  quoted_at + (snapshot_id % 83 - 1) * interval '1' minute as observed_at, provider, 'p' || cast(fixture_id % 3 as varchar) as bookmaker_provider,
  case when snapshot_id % 71 = 0 then 'not-a-hash' else sha256(cast(snapshot_id as varchar)) end as evidence_hash, closing_evidence from v_rich)"""


@query("quote_contract", with_(CONTRACT) + """
select snapshot_id, concat_ws(',', case when odds_home <= 1 or odds_draw <= 1 or odds_away <= 1 then 'INVALID_ODDS' end,
  case when quoted_at > kickoff_at then 'QUOTED_AFTER_KICKOFF' end, case when available_at < quoted_at then 'AVAILABLE_BEFORE_QUOTED' end,
  case when quoted_at > observed_at then 'QUOTED_AFTER_OBSERVED' end, case when bookmaker_provider <> provider then 'PROVIDER_MISMATCH' end,
  case when not regexp_full_match(evidence_hash, '[0-9a-f]{64}') then 'INVALID_HASH' end,
  case when trim(closing_evidence) = '' then 'BLANK_CLOSING_PROOF' end) as reasons from contract""")
def quote_contract(t: Tables) -> DataFrame:
    i, q = F.col("snapshot_id"), F.col("quoted_at")
    rows = rich_quotes(t).withColumns({
        "odds_home": F.when(i % 211 == 0, 1.0).otherwise(F.col("odds_home")),
        "available_at": F.when(i % 89 == 0, q - span("1 minute")).otherwise(F.col("available_at")),
        "observed_at": q + F.make_dt_interval(mins=i % 83 - 1),
        "bookmaker_provider": F.concat(F.lit("p"), (F.col("fixture_id") % 3).cast("string")),
        "evidence_hash": F.when(i % 71 == 0, "not-a-hash").otherwise(F.sha2(i.cast("string"), 256)),
    })
    return rows.select("snapshot_id", F.array_join(market.quote_reasons(), ",").alias("reasons"))


@query("selection_contract", """
with s as (select event_id as observation_id, case when event_id % 67 = 0 then 0.9e0 else 1.5e0 + (event_id % 50)/10e0 end as decimal_odds,
  case event_id % 4 when 0 then 'h2h' when 1 then 'totals' when 2 then 'spreads' else 'props' end as market_type,
  case when event_id % 5 = 0 then null else 2.5e0 end as line_value, case when event_id % 31 = 0 then 'PAUSED' else 'OPEN' end as market_status,
  case when event_id % 37 = 0 then 'GUESSED' else 'CONFIRMED' end as verification_state, ts as observed_at,
  ts + (event_id % 9 - 1) * interval '1' hour as expires_at from events)
select observation_id, concat_ws(',', case when decimal_odds <= 1 then 'INVALID_ODDS' end,
  case when decimal_odds > 1 and observation_id % 41 = 0 then 'INVALID_IMPLIED_PROBABILITY' end, case when market_type = 'props' then 'UNKNOWN_MARKET' end,
  case when market_status = 'PAUSED' then 'UNKNOWN_MARKET_STATUS' end, case when verification_state = 'GUESSED' then 'INVALID_VERIFICATION_STATE' end,
  case when market_type in ('totals','spreads') and line_value is null then 'MISSING_LINE' end,
  case when expires_at < observed_at then 'EXPIRES_BEFORE_OBSERVED' end) as reasons from s""")
def selection_contract(t: Tables) -> DataFrame:
    e = F.col("event_id")
    odds = F.when(e % 67 == 0, 0.9).otherwise(1.5 + (e % 50) / 10.0)
    rows = t.events.select(
        e.alias("observation_id"), odds.alias("decimal_odds"), F.when(e % 41 == 0, 0.01).otherwise(1 / odds).alias("implied_probability"),
        F.when(e % 4 == 0, "h2h").when(e % 4 == 1, "totals").when(e % 4 == 2, "spreads").otherwise("props").alias("market_type"),
        F.when(e % 5 != 0, 2.5).alias("line_value"), F.when(e % 31 == 0, "PAUSED").otherwise("OPEN").alias("market_status"),
        F.when(e % 37 == 0, "GUESSED").otherwise("CONFIRMED").alias("verification_state"), F.col("ts").alias("observed_at"),
        (F.col("ts") + F.make_dt_interval(hours=e % 9 - 1)).alias("expires_at"),
    )
    return rows.select("observation_id", F.array_join(market.selection_reasons(), ",").alias("reasons"))


@query("model_vs_market", with_(MATCH, league()) + "," + RICH.strip() + LATEST + """
select l.match_id, c.fixture_id, round((c_home+1.0)/(n+3.0) - fair_home,7)+0e0 as d_home, round((c_draw+1.0)/(n+3.0) - fair_draw,7)+0e0 as d_draw,
  round((c_away+1.0)/(n+3.0) - fair_away,7)+0e0 as d_away from league l join con c on c.fixture_id = l.match_id % 40 where n >= 50""")
def model_vs_market(t: Tables) -> DataFrame:
    """Difference between model and market vector per class; the consensus is one row per fixture."""
    m = views.matches(t)
    rows = forecast.league_frame(m, m, RECONSTRUCTED).filter(F.col("n") >= 50).withColumn("fixture_id", F.col("match_id") % 40)
    both = rows.join(market.consensus(known(t)), "fixture_id")
    gaps = [r(p - F.col(f), 7).alias(f"d_{k}") for p, f, k in zip(forecast.league_probabilities(), FAIR, scores.LETTERS)]
    return both.select("match_id", "fixture_id", *gaps)
