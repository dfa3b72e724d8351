"""Walk-forward baselines, goal models, features, scores and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import features, forecast, running, scoring, temporal
from . import views
from .registry import query, r
from .sqlviews import (BASELINES, GRID, MATCH, POSTERIOR, RATES, STRICT_MODE, VENUE, league, scored, with_)
from .views import RECONSTRUCTED, STRICT, Tables, ts

FLOOR = 50
P = scoring.PROBS


def labels(matches: DataFrame) -> DataFrame:
    return matches.select("match_id", scores.outcome(F.col("home_goals"), F.col("away_goals")).alias("outcome"))


def named(ps):
    return [p.alias(name) for p, name in zip(ps, P)]


def baseline_forecasts(t: Tables, models: tuple[str, ...] = ("LEAGUE_EMPIRICAL", "VENUE_EMPIRICAL", "UNIFORM")) -> DataFrame:
    """Long forecasts with labels for every target that has enough history."""
    m = views.matches(t)
    frame = forecast.pit_frame(m, m, RECONSTRUCTED) if "VENUE_EMPIRICAL" in models else forecast.league_frame(m, m, RECONSTRUCTED)
    rows = frame.filter(F.col("n") >= FLOOR).withColumn("outcome", scores.outcome(F.col("home_goals"), F.col("away_goals")))
    made = {"LEAGUE_EMPIRICAL": forecast.league_probabilities(), "UNIFORM": forecast.uniform_probabilities()}
    if "VENUE_EMPIRICAL" in models:
        made["VENUE_EMPIRICAL"] = forecast.venue_probabilities()
    return forecast.long_forecasts(rows, {k: made[k] for k in models}, ["match_id", "competition_id", "kickoff_at", "outcome"])


LEAGUE_P = """select match_id, competition_id, n, round((c_home+1.0)/(n+3.0),9) as p_home, round((c_draw+1.0)/(n+3.0),9) as p_draw,
  round((c_away+1.0)/(n+3.0),9) as p_away from league where n >= 50"""


def _walk(t: Tables, mode: str) -> DataFrame:
    m = views.matches(t)
    rows = forecast.league_frame(m, m, mode).filter(F.col("n") >= FLOOR)
    return rows.select("match_id", "competition_id", F.col("n").cast("bigint").alias("n"),
                       *[F.round(p, 9).alias(c) for p, c in zip(forecast.league_probabilities(), P)])


@query("walk_forward_league", with_(MATCH, league()) + LEAGUE_P)
def walk_forward_league(t: Tables) -> DataFrame:
    return _walk(t, RECONSTRUCTED)


@query("walk_forward_strict", with_(MATCH, league(STRICT_MODE)) + LEAGUE_P)
def walk_forward_strict(t: Tables) -> DataFrame:
    return _walk(t, STRICT)


REVISED = MATCH + """,
v_result as (
  select match_id, competition_id, completed_at, available_at, outcome, 1 as version from v_match
  union all
  select match_id, competition_id, completed_at, available_at + interval '5' day,
    case when away_goals > home_goals + 1 then 'HOME' when away_goals < home_goals + 1 then 'AWAY' else 'DRAW' end, 2
  from v_match where match_id % 11 = 0 and available_at is not null),
picked as (
  select t.match_id, t.competition_id, h.match_id as h_id, max_by(h.outcome, h.version) as o
  from v_match t join v_result h on h.competition_id = t.competition_id and h.available_at <= t.kickoff_at and h.completed_at < t.kickoff_at
  group by all)"""


@query("walk_forward_revised", with_(REVISED) + """
select match_id, competition_id, count(*) as n, round((count(case when o='HOME' then 1 end)+1.0)/(count(*)+3.0),9) as p_home,
  round((count(case when o='DRAW' then 1 end)+1.0)/(count(*)+3.0),9) as p_draw,
  round((count(case when o='AWAY' then 1 end)+1.0)/(count(*)+3.0),9) as p_away
from picked group by match_id, competition_id having count(*) >= 50""")
def walk_forward_revised(t: Tables) -> DataFrame:
    m = views.matches(t)
    rows = forecast.league_frame(m, views.match_revisions(t), RECONSTRUCTED).filter(F.col("n") >= FLOOR)
    return rows.select("match_id", "competition_id", F.col("n").cast("bigint").alias("n"),
                       *[F.round(p, 9).alias(c) for p, c in zip(forecast.league_probabilities(), P)])


@query("walk_forward_venue", with_(MATCH, league(), VENUE, POSTERIOR) + """select match_id, competition_id, round(p_home,9) as p_home,
  round(p_draw,9) as p_draw, round(p_away,9) as p_away from venue_p where n >= 50""")
def walk_forward_venue(t: Tables) -> DataFrame:
    m = views.matches(t)
    rows = forecast.pit_frame(m, m, RECONSTRUCTED).filter(F.col("n") >= FLOOR)
    return rows.select("match_id", "competition_id", *[F.round(p, 9).alias(c) for p, c in zip(forecast.venue_probabilities(), P)])


@query("walk_forward_uniform", with_(MATCH, league()) + """select match_id, competition_id, n, round(1e0/3,9) as p_home, round(1e0/3,9) as p_draw,
  round(1e0/3,9) as p_away, train_start, train_end from league where n >= 50""")
def walk_forward_uniform(t: Tables) -> DataFrame:
    """Uniform benchmark with the training window every model of a target shares."""
    m = views.matches(t)
    rows = forecast.league_frame(m, m, RECONSTRUCTED, span=True).filter(F.col("n") >= FLOOR)
    return rows.select("match_id", "competition_id", F.col("n").cast("bigint").alias("n"),
                       *[F.round(p, 9).alias(c) for p, c in zip(forecast.uniform_probabilities(), P)], "train_start", "train_end")


ALL_SCORED = (MATCH, league(), VENUE, POSTERIOR, BASELINES, scored("baselines"))


@query("score_forecasts", with_(*ALL_SCORED) + """select match_id, model_id, outcome, round(log_loss,8) as log_loss, log_loss_infinite, round(rps,8) as rps,
  round(brier,8) as brier, correct from scored""")
def score_forecasts(t: Tables) -> DataFrame:
    s = scoring.score(baseline_forecasts(t))
    return s.select("match_id", "model_id", "outcome", r("log_loss", 8), "log_loss_infinite", r("rps", 8), r("brier", 8), "correct")


@query("metric_summary", with_(*ALL_SCORED) + """select competition_id, model_id, count(*) as matches,
  case when bool_or(log_loss_infinite) then null else round(avg(log_loss),8) end as log_loss, bool_or(log_loss_infinite) as log_loss_infinite,
  round(avg(rps),8) as rps, round(avg(brier),8) as brier, round(avg(brier_home),8) as brier_home, round(avg(brier_draw),8) as brier_draw,
  round(avg(brier_away),8) as brier_away, round(avg(correct),8) as accuracy from scored group by all""")
def metric_summary(t: Tables) -> DataFrame:
    out = scoring.metric_summary(scoring.score(baseline_forecasts(t)), ["competition_id", "model_id"])
    cols = ("log_loss", "rps", "brier", "brier_home", "brier_draw", "brier_away", "accuracy")
    return out.withColumns({c: F.round(c, 8) for c in cols})


def _calibration_sql(bins: int) -> str:
    return f""",
members as (
  select model_id, 'HOME' as class, p_home as p, y_home as y from scored union all
  select model_id, 'DRAW', p_draw, y_draw from scored union all select model_id, 'AWAY', p_away, y_away from scored),
spine as (select model_id, class, b.bucket from (select distinct model_id, class from members) cross join (select range as bucket from range({bins})) b),
folded as (select model_id, class, cast(least(floor(p*{bins}), {bins - 1}) as bigint) as bucket, count(*) as n, avg(p) as mp, avg(y) as fy from members group by all),
cal as (select s.model_id, s.class, s.bucket, coalesce(f.n,0) as n, f.mp, f.fy from spine s left join folded f using (model_id, class, bucket))"""


@query("calibration_10", with_(*ALL_SCORED) + _calibration_sql(10) + """
select model_id, class, bucket, n, round(mp,7) as mean_probability, round(fy,7) as observed_frequency from cal""")
def calibration_10(t: Tables) -> DataFrame:
    cal = scoring.calibration(scoring.score(baseline_forecasts(t)), ["model_id"], 10)
    return cal.select("model_id", "class", "bucket", "n", r("mean_probability", 7), r("observed_frequency", 7))


@query("ece_5", with_(*ALL_SCORED) + _calibration_sql(5) + """
select model_id, class, round(sum(n*abs(mp-fy))/sum(n),7) as ece from cal group by all""")
def ece_5(t: Tables) -> DataFrame:
    cal = scoring.calibration(scoring.score(baseline_forecasts(t)), ["model_id"], 5)
    return scoring.expected_calibration_error(cal, ["model_id"]).withColumn("ece", F.round("ece", 7))


PERIOD = ("1996-01-01 00:00:00", "2001-01-01 00:00:00")


@query("skip_reasons", with_(MATCH, league()) + f"""
select match_id, case when not (kickoff_at >= timestamp '{PERIOD[0]}' and kickoff_at < timestamp '{PERIOD[1]}') then 'OUTSIDE_EVALUATION_PERIOD'
  when match_id % 23 = 0 then 'SCHEDULE_UNAVAILABLE_AT_HORIZON' when n < 600 then 'INSUFFICIENT_TRAINING_HISTORY' end as skip_reason from league""")
def skip_reasons(t: Tables) -> DataFrame:
    m = views.matches(t).withColumn(
        "schedule_available_at", F.when(F.col("match_id") % 23 != 0, F.col("kickoff_at") - views.span("10 days"))
    )
    frame = forecast.league_frame(m, m, RECONSTRUCTED)
    known = temporal.eligible(F.col("decision_at"), RECONSTRUCTED, "schedule_available_at")
    return forecast.skip_reasons(frame, ts(PERIOD[0]), ts(PERIOD[1]), 600, known).select("match_id", "skip_reason")


@query("skip_counts", with_(MATCH, league()) + f""", reasons as (
select competition_id, case when not (kickoff_at >= timestamp '{PERIOD[0]}' and kickoff_at < timestamp '{PERIOD[1]}') then 'OUTSIDE_EVALUATION_PERIOD'
  when n < 600 then 'INSUFFICIENT_TRAINING_HISTORY' else 'FORECAST' end as state from league)
select competition_id, state, count(*) as targets from reasons group by all""")
def skip_counts(t: Tables) -> DataFrame:
    m = views.matches(t)
    out = forecast.skip_reasons(forecast.league_frame(m, m, RECONSTRUCTED), ts(PERIOD[0]), ts(PERIOD[1]), 600, F.lit(True))
    state = F.coalesce("skip_reason", F.lit("FORECAST"))
    return out.groupBy("competition_id", state.alias("state")).agg(F.count(F.lit(1)).alias("targets"))


@query("late_label_join", with_(REVISED) + """, final as (
  select match_id, max_by(outcome, version) as outcome, max(version) as version from v_result
  where available_at <= timestamp '2000-06-01 00:00:00' group by match_id)
select t.match_id, f.outcome, cast(f.version as bigint) as version from v_match t join final f using (match_id)
where t.completed_at <= timestamp '2000-06-01 00:00:00' and t.completed_at > t.kickoff_at""")
def late_label_join(t: Tables) -> DataFrame:
    """Predictions joined to the latest label known when the report is computed; later labels stay out."""
    at = ts("2000-06-01 00:00:00")
    results = views.match_revisions(t).withColumn("outcome", scores.outcome(F.col("home_goals"), F.col("away_goals")))
    final = temporal.as_of(results, at, RECONSTRUCTED, ["outcome", "version"], key="match_id")
    targets = views.matches(t).filter((F.col("completed_at") <= at) & (F.col("completed_at") > F.col("kickoff_at"))).select("match_id")
    return targets.join(final, "match_id").select("match_id", "outcome", "version")


@query("evidence_registry", with_(REVISED) + """
select match_id, min(case when role = 'SCHEDULE' then 1 when role = 'TRAINING_RESULT' then 2 else 3 end) as role_rank, count(*) as uses, max(available_at) as available_at
from (select match_id, 'SCHEDULE' as role, kickoff_at - interval '10' day as available_at from v_match where match_id % 2 = 0
  union all select match_id, 'TRAINING_RESULT', available_at from v_result where match_id % 3 = 0
  union all select match_id, 'SCORING_OUTCOME', available_at from v_result) group by match_id""")
def evidence_registry(t: Tables) -> DataFrame:
    """Distinct evidence records with their strongest role; the union of all evidence kinds."""
    m = views.matches(t)
    results = views.match_revisions(t).select("match_id", "available_at")
    kinds = (
        m.filter(F.col("match_id") % 2 == 0).select("match_id", F.lit(1).alias("role_rank"), (F.col("kickoff_at") - views.span("10 days")).alias("available_at"))
        .unionByName(results.filter(F.col("match_id") % 3 == 0).withColumn("role_rank", F.lit(2)))
        .unionByName(results.withColumn("role_rank", F.lit(3)))
    )
    return kinds.groupBy("match_id").agg(F.min("role_rank").alias("role_rank"), F.count(F.lit(1)).alias("uses"), F.max("available_at").alias("available_at"))


# -- features -------------------------------------------------------------------------------

TEAM_HISTORY = """
tm as (
  select match_id, competition_id, home_id as team, true as at_home, home_goals as gf, away_goals as ga, completed_at, available_at from v_match
  union all select match_id, competition_id, away_id, false, away_goals, home_goals, completed_at, available_at from v_match),
asked as (
  select match_id, competition_id, kickoff_at, 'home' as side, home_id as team from v_match
  union all select match_id, competition_id, kickoff_at, 'away', away_id from v_match),
hist as (
  select a.match_id, a.side, a.kickoff_at, h.match_id as h_id, h.gf, h.ga, h.completed_at, h.available_at,
    (h.at_home and a.side = 'home') or (not h.at_home and a.side = 'away') as at_venue,
    row_number() over (partition by a.match_id, a.side order by h.completed_at desc nulls last, h.match_id desc) as rn
  from asked a left join tm h on h.competition_id = a.competition_id and h.team = a.team
    and h.completed_at < a.kickoff_at and h.available_at <= a.kickoff_at),
feat as (
  select match_id, side, avg(case when rn <= 5 then case when gf > ga then 3e0 when gf = ga then 1e0 when gf < ga then 0e0 end end) as form,
    avg(gf) as goals_for, avg(ga) as goals_against, avg(case when at_venue then gf end) as venue_goals_for,
    avg(case when at_venue then ga end) as venue_goals_against,
    date_diff('second', max(completed_at), any_value(kickoff_at))/86400e0 as rest_days,
    cast(count(case when completed_at >= kickoff_at - interval '14' day then 1 end) as double) as congestion_14d,
    case when count(h_id) > 0 then 0e0 else 1e0 end as history_missing,
    string_agg(case when rn <= 5 then cast(h_id as varchar) end, ',' order by h_id) as form_ids
  from hist group by match_id, side)"""

FEATS = (MATCH, TEAM_HISTORY)


def _pivot_sql(*cols: str, value: str = "round({},7)") -> str:
    parts = [f"max(case when side='{s}' then {value.format(c)} end) as {s}_{c}" for s in ("home", "away") for c in cols]
    return f"select match_id, {', '.join(parts)} from feat group by match_id"


@query("feat_form", with_(*FEATS) + """select match_id, max(case when side='home' then round(form,7) end) as home_form,
  max(case when side='away' then round(form,7) end) as away_form from feat group by match_id having count(form) > 0""")
def feat_form(t: Tables) -> DataFrame:
    m = views.matches(t)
    return features.form(m, m, RECONSTRUCTED).select("match_id", r("home_form", 7), r("away_form", 7))


def _table_features(t: Tables, *suffixes: str) -> DataFrame:
    m = views.matches(t)
    frame = forecast.pit_frame(m, m, RECONSTRUCTED)
    made = features.table_columns()
    names = [f"{s}_{c}" for s in ("home", "away") for c in suffixes]
    return frame.select("match_id", *[F.round(made[n], 7).alias(n) for n in names])


@query("feat_goals", with_(*FEATS) + _pivot_sql("goals_for", "goals_against"))
def feat_goals(t: Tables) -> DataFrame:
    return _table_features(t, "goals_for", "goals_against")


@query("feat_venue", with_(*FEATS) + _pivot_sql("venue_goals_for", "venue_goals_against"))
def feat_venue(t: Tables) -> DataFrame:
    return _table_features(t, "venue_goals_for", "venue_goals_against")


@query("feat_rest", with_(*FEATS) + _pivot_sql("rest_days"))
def feat_rest(t: Tables) -> DataFrame:
    return _table_features(t, "rest_days")


@query("feat_congestion", with_(*FEATS) + _pivot_sql("congestion_14d"))
def feat_congestion(t: Tables) -> DataFrame:
    return _table_features(t, "congestion_14d")


@query("feat_missing", with_(*FEATS) + _pivot_sql("history_missing"))
def feat_missing(t: Tables) -> DataFrame:
    return _table_features(t, "history_missing")


EXTERNAL_SQL = ", ".join(f"cast(null as double) as {e}, 1e0 as {e}_missing" for e in features.EXTERNAL)
WIDE = _pivot_sql(*features.SIDE_FEATURES)
EXACT = _pivot_sql(*features.SIDE_FEATURES, value="{}")


def wide_features(t: Tables) -> DataFrame:
    m = views.matches(t)
    return features.feature_frame(m, m, RECONSTRUCTED)


@query("feature_frame", with_(*FEATS) + f"select *, {EXTERNAL_SQL} from ({WIDE})")
def feature_frame(t: Tables) -> DataFrame:
    wide = wide_features(t)
    return wide.select("match_id", *[F.round(n, 7).alias(n) for n in features.NAMES])


@query("feature_long", with_(*FEATS) + f""", wide as (select *, {EXTERNAL_SQL} from ({WIDE}))
select match_id, feature, feature_value from wide unpivot include nulls (feature_value for feature in (columns(* exclude (match_id))))""")
def feature_long(t: Tables) -> DataFrame:
    return features.long_features(wide_features(t)).withColumn("feature_value", F.round("feature_value", 7))


@query("feature_lineage", with_(*FEATS) + """
select match_id, max(case when side='home' then form_ids end) as home_form_ids, max(case when side='away' then form_ids end) as away_form_ids
from feat group by match_id having count(form) > 0""")
def feature_lineage(t: Tables) -> DataFrame:
    """Evidence ids behind the bounded features; unbounded ones carry counts instead of arrays."""
    m = views.matches(t)
    got = features.form(m, m, RECONSTRUCTED)
    def blank(c):
        return F.when(F.col(c) != "", F.col(c)).alias(c)
    return got.select("match_id", blank("home_form_ids"), blank("away_form_ids"))


@query("missing_features", with_(*FEATS) + f""", wide as (select *, {EXTERNAL_SQL} from ({WIDE})),
long as (select match_id, feature, feature_value from wide unpivot include nulls (feature_value for feature in (columns(* exclude (match_id)))))
select match_id, count(*) as n_missing, string_agg(feature, ',' order by feature) as missing_features from long where feature_value is null group by match_id""")
def missing_features(t: Tables) -> DataFrame:
    return features.missing_inventory(wide_features(t))


@query("pit_audit", with_(*FEATS) + """
select count(*) as inputs, count(case when available_at > kickoff_at or completed_at >= kickoff_at or h_id = match_id then 1 end) as leaks
from hist where rn <= 5 and h_id is not null""")
def pit_audit(t: Tables) -> DataFrame:
    """Every input of every form feature is re-checked against the raw table; leaks must be 0."""
    m = views.matches(t)
    asked = forecast.decide(m).select(F.col("match_id").alias("target_id"), "decision_at")
    used = features.last_results(m, m, RECONSTRUCTED).select("target_id", "match_id").join(asked, "target_id")
    checked = used.join(m.select("match_id", "completed_at", "available_at"), "match_id")
    leak = (F.col("available_at") > F.col("decision_at")) | (F.col("completed_at") >= F.col("decision_at")) | (F.col("match_id") == F.col("target_id"))
    return checked.agg(F.count(F.lit(1)).alias("inputs"), F.count(F.when(leak, 1)).alias("leaks"))


# -- goal models -----------------------------------------------------------------------------

RATED = (MATCH, league(), VENUE, RATES)


def rated(t: Tables) -> DataFrame:
    m = views.matches(t)
    home, away = forecast.goal_rates()
    frame = forecast.pit_frame(m, m, RECONSTRUCTED).filter(F.col("n") >= FLOOR)
    return frame.withColumns({"rate_home": home, "rate_away": away, "outcome": scores.outcome(F.col("home_goals"), F.col("away_goals"))})


@query("goal_rates", with_(*RATED) + "select match_id, round(rate_home,7) as rate_home, round(rate_away,7) as rate_away from rates where n >= 50")
def goal_rates(t: Tables) -> DataFrame:
    return rated(t).select("match_id", r("rate_home", 7), r("rate_away", 7))


def gridded(t: Tables) -> DataFrame:
    return rated(t).withColumn("grid", scores.goal_grid(F.col("rate_home"), F.col("rate_away")))


@query("poisson_hda", with_(*RATED, GRID) + """select match_id, round(g_home/mass,7) as p_home, round(g_draw/mass,7) as p_draw,
  round(g_away/mass,7) as p_away from grid where n >= 50""")
def poisson_hda(t: Tables) -> DataFrame:
    return gridded(t).select("match_id", *[F.round(p, 7).alias(c) for p, c in zip(forecast.grid_probabilities(), P)])


@query("score_marginals", with_(*RATED, GRID) + """select match_id, round(h[1],7) as home_0, round(h[2],7) as home_1, round(h[3],7) as home_2,
  round(a[1],7) as away_0, round(a[2],7) as away_1, round(a[3],7) as away_2,
  round(1 - (h[1]*a[1]+h[1]*a[2]+h[2]*a[1]+h[2]*a[2]+h[1]*a[3]+h[3]*a[1])/mass, 7) as over_2_5, round(greatest(0e0, 1-mass),7) as tail_mass from grid where n >= 50""")
def score_marginals(t: Tables) -> DataFrame:
    g, lh, la = F.col("grid"), F.col("rate_home"), F.col("rate_away")
    h = [F.exp(-lh), F.exp(-lh) * lh, F.exp(-lh) * lh * lh / 2]
    a = [F.exp(-la), F.exp(-la) * la, F.exp(-la) * la * la / 2]
    return gridded(t).select(
        "match_id", *[F.round(x, 7).alias(f"home_{i}") for i, x in enumerate(h)], *[F.round(x, 7).alias(f"away_{i}") for i, x in enumerate(a)],
        F.round(1 - g["under_2_5"] / g["mass"], 7).alias("over_2_5"),
        (F.round(F.greatest(F.lit(0.0), 1 - g["mass"]), 7) + 0.0).alias("tail_mass"),
    )


@query("scenario_mixture", """
with s as (select p_partkey, i, case i when 0 then (p_size % 5 + 1)/10e0 else 1 - (p_size % 5 + 1)/10e0 end as w,
    0.5e0 + (p_size % (7 + i))/4e0 as rate_home, 0.4e0 + (p_partkey % (9 + i))/5e0 as rate_away from part cross join (values (0),(1)) v(i)),
pmf as (select *, list_transform(range(0,21), lambda k: exp(-rate_home)*pow(rate_home,k)/cast(factorial(cast(k as int)) as double)) as h,
    list_transform(range(0,21), lambda k: exp(-rate_away)*pow(rate_away,k)/cast(factorial(cast(k as int)) as double)) as a from s),
g as (select p_partkey, w, list_sum(list_transform(range(1,22), lambda i: h[i]*a[i])) as d,
    list_sum(list_transform(range(2,22), lambda i: h[i]*list_sum(a[1:i-1]))) as hm,
    list_sum(list_transform(range(2,22), lambda i: a[i]*list_sum(h[1:i-1]))) as aw, list_sum(h)*list_sum(a) as mass from pmf)
select p_partkey, count(*) as scenarios, round(sum(w*hm/mass),7) as p_home, round(sum(w*d/mass),7) as p_draw, round(sum(w*aw/mass),7) as p_away,
  round(sum(w*greatest(0e0,1-mass)),7) as tail_mass from g group by p_partkey""")
def scenario_mixture(t: Tables) -> DataFrame:
    """Weighted mixture of score scenarios per part; weights of a part sum to one."""
    size, key, i = F.col("p_size"), F.col("p_partkey"), F.col("i")
    w = (size % 5 + 1) / 10.0
    s = t.part.select("p_partkey", "p_size", F.explode(F.array(F.lit(0), F.lit(1))).alias("i")).select(
        "p_partkey", F.when(i == 0, w).otherwise(1 - w).alias("w"),
        (0.5 + (size % (7 + i)) / 4.0).alias("rate_home"), (0.4 + (key % (9 + i)) / 5.0).alias("rate_away"),
    ).withColumn("grid", scores.goal_grid(F.col("rate_home"), F.col("rate_away")))
    mixed = [F.round(F.sum(F.col("w") * p), 7).alias(c) for p, c in zip(forecast.grid_probabilities(), P)]
    tail = F.sum(F.col("w") * F.greatest(F.lit(0.0), 1 - F.col("grid.mass")))
    return s.groupBy("p_partkey").agg(F.count(F.lit(1)).alias("scenarios"), *mixed, (F.round(tail, 7) + 0.0).alias("tail_mass"))


@query("wilson_ci", with_(MATCH) + """, c as (select competition_id, count(*) as n, count(case when outcome='HOME' then 1 end)/cast(count(*) as double) as p from v_match group by 1)
select competition_id, n, round(p,7) as p, round(greatest(0e0, ((p + 3.8416/(2*n))/(1+3.8416/n)) - 1.96*sqrt(p*(1-p)/n + 3.8416/(4.0*n*n))/(1+3.8416/n)),7) as ci_low,
  round(least(1e0, ((p + 3.8416/(2*n))/(1+3.8416/n)) + 1.96*sqrt(p*(1-p)/n + 3.8416/(4.0*n*n))/(1+3.8416/n)),7) as ci_high from c""")
def wilson_ci(t: Tables) -> DataFrame:
    home = scores.outcome(F.col("home_goals"), F.col("away_goals")) == "HOME"
    c = views.matches(t).groupBy("competition_id").agg(F.count(F.lit(1)).alias("n"), F.avg(home.cast("double")).alias("p"))
    low, high = scores.wilson(F.col("p"), F.col("n").cast("double"))
    return c.select("competition_id", "n", r("p", 7), F.round(low, 7).alias("ci_low"), F.round(high, 7).alias("ci_high"))


# -- paired evaluation -------------------------------------------------------------------------

BLOCKS = """,
bench as (select match_id, log_loss as b from scored where model_id = 'LEAGUE_EMPIRICAL'),
blocks as (select model_id, cast(kickoff_at as date) as block, sum(log_loss - b) as diff, count(*) as n from scored join bench using (match_id) group by all)"""


def paired(t: Tables) -> DataFrame:
    s = scoring.score(baseline_forecasts(t))
    return scoring.paired_difference(s, [], "LEAGUE_EMPIRICAL", F.col("kickoff_at").cast("date"))


@query("paired_difference", with_(*ALL_SCORED) + BLOCKS + "select model_id, sum(n)::bigint as n, round(sum(diff)/sum(n),7) + 0e0 as mean_difference from blocks group by 1")
def paired_difference(t: Tables) -> DataFrame:
    return paired(t).groupBy("model_id").agg(F.sum("n").alias("n"), r(F.sum("diff") / F.sum("n"), 7).alias("mean_difference"))


@query("bootstrap_ci", with_(*ALL_SCORED) + BLOCKS + """,
placed as (select block, row_number() over (order by block) - 1 as slot, count(*) over () as nb from (select distinct block from blocks)),
drawn as (select d.range as draw, ((((d.range*7919 + slot*104729 + 15485863) % 2147483647) * 48271 % 2147483647) * 69621 % 2147483647) % nb as slot
  from placed cross join range(400) d),
times as (select draw, slot, count(*) as times from drawn group by all),
means as (select model_id, draw, sum(times*diff)/sum(times*n) as m from times join placed using (slot) join blocks using (block) group by all),
ci as (select model_id, list_sort(list(m)) as s from means group by 1)
select b.model_id, round(sum(diff)/sum(n),6) + 0e0 as mean_difference, round(any_value(s)[11],6) + 0e0 as ci_low, round(any_value(s)[390],6) + 0e0 as ci_high
from blocks b join ci using (model_id) group by 1""")
def bootstrap_ci(t: Tables) -> DataFrame:
    out = scoring.block_bootstrap(paired(t), [])
    return out.select("model_id", r("mean_difference"), r("ci_low"), r("ci_high"))


ROW_DIGEST = "sha256(concat_ws('|', cast(match_id as varchar), model_id, cast(cast(round(p_home*1e6) as bigint) as varchar), cast(cast(round(p_draw*1e6) as bigint) as varchar)))"


@query("replay_digest", with_(*ALL_SCORED) + f""", d as (select model_id, {ROW_DIGEST} as h from scored)
select model_id, count(*) as n_rows, sha256(concat_ws(':', cast(count(*) as varchar), cast(sum(cast('0x' || substr(h,1,12) as bigint)) as varchar),
  cast(sum(cast('0x' || substr(h,13,12) as bigint)) as varchar), cast(sum(cast('0x' || substr(h,25,12) as bigint)) as varchar),
  cast(sum(cast('0x' || substr(h,37,12) as bigint)) as varchar))) as digest from d group by model_id""")
def replay_digest(t: Tables) -> DataFrame:
    return scoring.set_digest(baseline_forecasts(t), ["model_id"], digest_parts())


def digest_parts():
    micro = [F.round(F.col(c) * 1e6).cast("bigint").cast("string") for c in ("p_home", "p_draw")]
    return [F.col("match_id").cast("string"), F.col("model_id"), *micro]


@query("replay_check", with_(*ALL_SCORED) + "select model_id, true as same_digest, cast(0 as bigint) as rows_only_left, cast(0 as bigint) as rows_only_right from scored group by 1")
def replay_check(t: Tables) -> DataFrame:
    """Two independent replays from different physical layouts give the same digest and the same rows."""
    keys = ["match_id", "model_id"]
    sides = [forecasts.select(*keys, F.lit(n).alias("side"), scoring.row_digest(digest_parts()).alias("_d")) for n, forecasts in enumerate((baseline_forecasts(t), forecast_replayed(t)))]
    # each replay is made once: a row's digest goes with its key, and both sides meet by it
    held = [f"{c}{n}" for n in (0, 1) for c in ("n", *scoring.LIMBS)]
    def own(n: int) -> list:
        mine = F.when(F.col("side") == n, F.col("_d"))
        return [F.count(mine).alias(f"n{n}"), *[F.sum(limb).alias(f"{c}{n}") for c, limb in zip(scoring.LIMBS, scoring.limbs(mine))]]
    met = sides[0].unionByName(sides[1]).groupBy(*keys).agg(*own(0), *own(1))
    totals = met.groupBy("model_id").agg(
        *[F.sum(c).alias(c) for c in held], F.sum(F.when(F.col("n1") == 0, F.col("n0")).otherwise(0)).alias("rows_only_left"), F.sum(F.when(F.col("n0") == 0, F.col("n1")).otherwise(0)).alias("rows_only_right"))
    same = scoring.folded_digest(F.col("n0"), [F.col(f"{c}0") for c in scoring.LIMBS]) == scoring.folded_digest(F.col("n1"), [F.col(f"{c}1") for c in scoring.LIMBS])
    return totals.filter("n0 > 0 and n1 > 0").select("model_id", same.alias("same_digest"), "rows_only_left", "rows_only_right")


def forecast_replayed(t: Tables) -> DataFrame:
    shuffled = Tables(t.spark, t.directory)
    m = views.matches(shuffled).repartition(5, F.col("match_id") % 3)
    rows = forecast.pit_frame(m, m, RECONSTRUCTED).filter(F.col("n") >= FLOOR).withColumn("outcome", scores.outcome(F.col("home_goals"), F.col("away_goals")))
    made = {"LEAGUE_EMPIRICAL": forecast.league_probabilities(), "VENUE_EMPIRICAL": forecast.venue_probabilities(), "UNIFORM": forecast.uniform_probabilities()}
    return forecast.long_forecasts(rows, made, ["match_id", "competition_id", "kickoff_at", "outcome"])
