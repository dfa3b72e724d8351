"""The derived views once more, as ANSI SQL text for the checking engine."""

MATCH = """
v_match as (
  select o.o_orderkey as match_id, c.c_mktsegment as competition_id, c.c_nationkey as home_id,
    cast((c.c_nationkey + 1 + o.o_orderkey % 24) % 25 as int) as away_id,
    o.o_orderdate as kickoff_at, o.o_orderdate + interval '2' hour as completed_at,
    case when o.o_orderkey % 50 = 0 then null else o.o_orderdate + interval '2' day end as available_at,
    case when o.o_orderstatus = 'F' then 'STRICT_PIT' else 'RECONSTRUCTED_PIT' end as availability_mode,
    coalesce(l.hg, 0) as home_goals, coalesce(l.ag, 0) as away_goals,
    case when coalesce(l.hg,0) > coalesce(l.ag,0) then 'HOME' when coalesce(l.hg,0) < coalesce(l.ag,0) then 'AWAY' else 'DRAW' end as outcome
  from orders o join customer c on o.o_custkey = c.c_custkey
  left join (select l_orderkey, count(case when l_returnflag = 'R' then 1 end) as hg,
                    count(case when l_returnflag = 'A' then 1 end) as ag
             from lineitem group by l_orderkey) l on l.l_orderkey = o.o_orderkey)"""

REVISION = """
v_revision as (
  select event_id as record_id, user_id as entity_key,
    cast(row_number() over (partition by user_id order by ts, event_id) as bigint) as version,
    lag(event_id) over (partition by user_id order by ts, event_id) as supersedes_id,
    case when event_id % 37 = 0 then null else ts end as available_at,
    case when event_id % 3 = 0 then 'RECONSTRUCTED_PIT' else 'STRICT_PIT' end as availability_mode,
    event_type, value, ts
  from events)"""

QUOTE = """
v_quote as (
  select event_id as snapshot_id, user_id % 40 as fixture_id, event_id % 12 as bookmaker_id, ts as quoted_at,
    case when event_id % 61 = 0 then null else ts + interval '5' minute end as available_at,
    cast(1.2 as double) + (event_id * 7 % 400) / cast(100 as double) as odds_home,
    cast(2.0 as double) + (event_id * 13 % 300) / cast(100 as double) as odds_draw,
    cast(1.5 as double) + (event_id * 29 % 600) / cast(100 as double) as odds_away
  from events)"""

# Range-join form of a league history: every usable earlier result of the competition.
LEAGUE = """
league as (
  select t.match_id, t.competition_id, t.home_id, t.away_id, t.kickoff_at, t.outcome,
    count(h.match_id) as n,
    count(case when h.outcome='HOME' then 1 end) as c_home,
    count(case when h.outcome='DRAW' then 1 end) as c_draw,
    count(case when h.outcome='AWAY' then 1 end) as c_away,
    coalesce(sum(h.home_goals),0) as hg, coalesce(sum(h.away_goals),0) as ag,
    min(h.completed_at) as train_start, max(h.completed_at) as train_end
  from v_match t left join v_match h on h.competition_id = t.competition_id
    and h.completed_at < t.kickoff_at and h.available_at <= t.kickoff_at {mode}
  group by all)"""

VENUE = """
home_hist as (
  select t.match_id, count(h.match_id) as hn, coalesce(sum(h.home_goals),0) as hgf, coalesce(sum(h.away_goals),0) as hga,
    count(case when h.outcome='HOME' then 1 end) as h_home, count(case when h.outcome='DRAW' then 1 end) as h_draw,
    count(case when h.outcome='AWAY' then 1 end) as h_away
  from v_match t left join v_match h on h.competition_id = t.competition_id and h.home_id = t.home_id
    and h.completed_at < t.kickoff_at and h.available_at <= t.kickoff_at group by all),
away_hist as (
  select t.match_id, count(h.match_id) as an, coalesce(sum(h.away_goals),0) as agf, coalesce(sum(h.home_goals),0) as aga,
    count(case when h.outcome='HOME' then 1 end) as a_home, count(case when h.outcome='DRAW' then 1 end) as a_draw,
    count(case when h.outcome='AWAY' then 1 end) as a_away
  from v_match t left join v_match h on h.competition_id = t.competition_id and h.away_id = t.away_id
    and h.completed_at < t.kickoff_at and h.available_at <= t.kickoff_at group by all)"""

POSTERIOR = """
league_p as (select *, (c_home+1.0)/(n+3.0) as l_home, (c_draw+1.0)/(n+3.0) as l_draw, (c_away+1.0)/(n+3.0) as l_away from league),
venue_p as (
  select l.match_id, l.competition_id, l.outcome, l.n, l.kickoff_at,
    ((h.h_home+5.0*l_home)/(hn+5.0) + (a.a_home+5.0*l_home)/(an+5.0))/2 as p_home,
    ((h.h_draw+5.0*l_draw)/(hn+5.0) + (a.a_draw+5.0*l_draw)/(an+5.0))/2 as p_draw,
    ((h.h_away+5.0*l_away)/(hn+5.0) + (a.a_away+5.0*l_away)/(an+5.0))/2 as p_away
  from league_p l join home_hist h using (match_id) join away_hist a using (match_id))"""

RATES = """
rates0 as (
  select l.match_id, l.competition_id, l.outcome, l.n, l.kickoff_at, hn, hgf, hga, an, agf, aga,
    (l.hg + 7.5e0)/(l.n + 5e0) as hm, (l.ag + 6e0)/(l.n + 5e0) as am
  from league l join home_hist using (match_id) join away_hist using (match_id)),
rates as (
  select match_id, competition_id, outcome, n, kickoff_at,
    greatest(0.05e0, least(8e0, ((hgf+5e0*hm)/(hn+5e0)) * ((aga+5e0*hm)/(an+5e0)) / hm)) as rate_home,
    greatest(0.05e0, least(8e0, ((agf+5e0*am)/(an+5e0)) * ((hga+5e0*am)/(hn+5e0)) / am)) as rate_away
  from rates0)"""

GRID = """
pmf as (
  select *, list_transform(range(0,21), lambda k: exp(-rate_home)*pow(rate_home,k)/cast(factorial(cast(k as int)) as double)) as h,
    list_transform(range(0,21), lambda k: exp(-rate_away)*pow(rate_away,k)/cast(factorial(cast(k as int)) as double)) as a
  from rates),
grid as (
  select match_id, competition_id, outcome, n, kickoff_at, rate_home, rate_away, h, a,
    list_sum(list_transform(range(1,22), lambda i: h[i]*a[i])) as g_draw,
    list_sum(list_transform(range(2,22), lambda i: h[i]*list_sum(a[1:i-1]))) as g_home,
    list_sum(list_transform(range(2,22), lambda i: a[i]*list_sum(h[1:i-1]))) as g_away,
    list_sum(h)*list_sum(a) as mass
  from pmf)"""

SCORE = """
case p_true when 0 then null else -ln(p_true) end as log_loss, p_true = 0 as log_loss_infinite,
(pow(p_home-y_home,2) + pow(p_home+p_draw-y_home-y_draw,2))/2 as rps,
pow(p_home-y_home,2)+pow(p_draw-y_draw,2)+pow(p_away-y_away,2) as brier,
pow(p_home-y_home,2) as brier_home, pow(p_draw-y_draw,2) as brier_draw, pow(p_away-y_away,2) as brier_away,
case when outcome = (case when p_home>=p_draw and p_home>=p_away then 'HOME' when p_draw>=p_away then 'DRAW' else 'AWAY' end) then 1e0 else 0e0 end as correct"""


def scored(source: str) -> str:
    """CTE text `scored`: forecasts of `source` (match_id, model_id, p_*, outcome) with scores."""
    return f"""
labelled as (select *, case outcome when 'HOME' then p_home when 'DRAW' then p_draw else p_away end as p_true,
    case when outcome='HOME' then 1e0 else 0e0 end as y_home, case when outcome='DRAW' then 1e0 else 0e0 end as y_draw,
    case when outcome='AWAY' then 1e0 else 0e0 end as y_away from {source}),
scored as (select *, {SCORE} from labelled)"""


BASELINES = """
baselines as (
  select match_id, competition_id, outcome, kickoff_at, 'LEAGUE_EMPIRICAL' as model_id, l_home as p_home, l_draw as p_draw, l_away as p_away from league_p where n >= 50
  union all select match_id, competition_id, outcome, kickoff_at, 'VENUE_EMPIRICAL', p_home, p_draw, p_away from venue_p where n >= 50
  union all select match_id, competition_id, outcome, kickoff_at, 'UNIFORM', 1e0/3, 1e0/3, 1e0/3 from league_p where n >= 50)"""

ANY_MODE = ""
STRICT_MODE = "and h.availability_mode = 'STRICT_PIT'"


def league(mode: str = ANY_MODE) -> str:
    return LEAGUE.format(mode=mode)


def with_(*parts: str) -> str:
    return "with " + ",".join(parts) + "\n"
