"""Fitted models, neighbours, ensembles and the full walk-forward."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import ensemble, features, forecast, models, scoring
from ..session import cut_lineage
from . import views
from .forecasting import EXACT, FEATS, FLOOR, WIDE, P, rated
from .registry import query, r
from .sqlviews import GRID, MATCH, POSTERIOR, RATES, VENUE, league, scored, with_
from .views import RECONSTRUCTED, Tables


def fits(t: Tables) -> DataFrame:
    m = views.matches(t)
    return models.fitted_rates(m, m, RECONSTRUCTED)


# Every target's history as counts by pair, by a plain range join; its rates and the likelihood at 31 values of rho.
PAIRS = """
pc as (
  select t.match_id, h.home_id, h.away_id, count(*) as n, sum(h.home_goals) as hg, sum(h.away_goals) as ag,
    count(*) filter (h.home_goals = 0 and h.away_goals = 0) as n00, count(*) filter (h.home_goals = 0 and h.away_goals = 1) as n01,
    count(*) filter (h.home_goals = 1 and h.away_goals = 0) as n10, count(*) filter (h.home_goals = 1 and h.away_goals = 1) as n11
  from v_match t join v_match h on h.competition_id = t.competition_id and h.completed_at < t.kickoff_at and h.available_at <= t.kickoff_at group by all)"""
RHO = """
lg as (select match_id, (sum(hg) + 7.5e0) / (sum(n) + 5e0) as mh, (sum(ag) + 6e0) / (sum(n) + 5e0) as ma from pc group by match_id),
hh as (select match_id, home_id, sum(n) as n, sum(hg) as gf, sum(ag) as ga from pc group by all),
aa as (select match_id, away_id, sum(n) as n, sum(ag) as gf, sum(hg) as ga from pc group by all),
pr as (
  select pc.match_id, n00, n01, n10, n11,
    greatest(0.05e0, least(8e0, (hh.gf + 5e0 * mh) / (hh.n + 5e0) * (aa.ga + 5e0 * mh) / (aa.n + 5e0) / mh)) as lh,
    greatest(0.05e0, least(8e0, (aa.gf + 5e0 * ma) / (aa.n + 5e0) * (hh.ga + 5e0 * ma) / (hh.n + 5e0) / ma)) as la
  from pc join lg using (match_id) join hh using (match_id, home_id) join aa using (match_id, away_id)),
tried as (
  select match_id, rho, sum(n00 * ln(greatest(1 - lh * la * rho, 1e-300)) + n01 * ln(greatest(1 + lh * rho, 1e-300)) + n10 * ln(greatest(1 + la * rho, 1e-300)) + n11 * ln(1 - rho)) as ll,
    min(least(1 - lh * la * rho, 1 + lh * rho, 1 + la * rho, 1 - rho)) as least_factor
  from pr, (select i / 100e0 as rho from range(-15, 16) g(i)) group by all),
fitted as (
  select match_id, rho from tried join rates using (match_id)
  where least(least_factor, 1 - rate_home * rate_away * rho, 1 + rate_home * rho, 1 + rate_away * rho) > 0.001
  qualify row_number() over (partition by match_id order by 10 * rho * rho - ll, abs(rho), rho) = 1),
rho as (select r.*, coalesce(f.rho, 0e0) as rho from rates r left join fitted f using (match_id))"""


@query("dixon_coles_rho", with_(MATCH, league(), VENUE, RATES, PAIRS, RHO) + "select match_id, rho, round(rate_home,7) as rate_home, round(rate_away,7) as rate_away from rho")
def dixon_coles_rho(t: Tables) -> DataFrame:
    return fits(t).select("match_id", "rho", r("rate_home", 7), r("rate_away", 7))


@query("dixon_coles_hda", with_(MATCH, league(), VENUE, RATES, PAIRS, RHO, GRID) + """,
moved as (select match_id, -h[1] * a[1] * g.rate_home * g.rate_away * rho - h[2] * a[2] * rho as d, h[2] * a[1] * g.rate_away * rho as h1, h[1] * a[2] * g.rate_home * rho as a1 from grid g join rho using (match_id))
select match_id, round((g_home + h1) / (mass + d + h1 + a1), 7) as p_home, round((g_draw + d) / (mass + d + h1 + a1), 7) as p_draw, round((g_away + a1) / (mass + d + h1 + a1), 7) as p_away
from grid join moved using (match_id)""")
def dixon_coles_hda(t: Tables) -> DataFrame:
    g = fits(t).withColumn("grid", scores.goal_grid(F.col("rate_home"), F.col("rate_away"), F.col("rho")))
    return g.select("match_id", *[F.round(p, 7).alias(c) for p, c in zip(forecast.grid_probabilities(), P)])


# Seventy steps of gradient descent for all targets at once: a row for each target and team of its history.
LOG_LINEAR = """
total as (select match_id, sum(n) as n, sum(hg) as hg, sum(ag) as ag from pc group by match_id),
own as (
  select match_id, team, sum(gf) as gf, sum(ga) as ga from (
    select match_id, home_id as team, hg as gf, ag as ga from pc union all select match_id, away_id, ag, hg from pc) group by all),
descent as (
  select 0 as i, match_id, team, gf, ga, n, hg, ag, ln((hg + 7.5e0) / (n + 5e0)) as bh, ln((ag + 6e0) / (n + 5e0)) as ba, 0e0 as attack, 0e0 as defence from own join total using (match_id)
  union all
  select i + 1, match_id, team, gf, ga, n, hg, ag, bh - 0.08e0 * (sum(th) over m - hg) / n, ba - 0.08e0 * (sum(ta) over m - ag) / n,
    attack - 0.08e0 * ((xa - gf) / n + 0.04e0 * attack), defence - 0.08e0 * ((xd - ga) / n + 0.04e0 * defence)
  from (
    select match_id, team, sum(xa) as xa, sum(xd) as xd, sum(th) as th, sum(ta) as ta from (
      select match_id, unnest([home_id, away_id]) as team, unnest([eh, ea]) as xa, unnest([ea, eh]) as xd, unnest([eh, 0e0]) as th, unnest([ea, 0e0]) as ta
      from (
        select p.match_id, home_id, away_id, p.n * exp(greatest(-4e0, least(2.5e0, h.bh + h.attack + a.defence))) as eh, p.n * exp(greatest(-4e0, least(2.5e0, h.ba + a.attack + h.defence))) as ea
        from pc p join descent h on h.match_id = p.match_id and h.team = p.home_id join descent a on a.match_id = p.match_id and a.team = p.away_id)) group by match_id, team) e
  join descent using (match_id, team) where i < 70
  window m as (partition by match_id)),
fit as (select * from descent where i = 70),
rates as (
  select m.match_id, m.competition_id, m.outcome, 0 as n, m.kickoff_at,
    exp(greatest(-3e0, least(2e0, coalesce(b.bh, ln(1.5e0)) + coalesce(h.attack, 0) + coalesce(a.defence, 0)))) as rate_home,
    exp(greatest(-3e0, least(2e0, coalesce(b.ba, ln(1.2e0)) + coalesce(a.attack, 0) + coalesce(h.defence, 0)))) as rate_away
  from v_match m left join fit h on h.match_id = m.match_id and h.team = m.home_id left join fit a on a.match_id = m.match_id and a.team = m.away_id
  left join (select match_id, any_value(bh) as bh, any_value(ba) as ba from fit group by match_id) b on b.match_id = m.match_id)"""


@query("poisson_glm", with_(MATCH, PAIRS, LOG_LINEAR, GRID).replace("with", "with recursive", 1) + """
select match_id, round(rate_home, 6) as glm_home, round(rate_away, 6) as glm_away, round(g_home/mass, 6) as p_home, round(g_draw/mass, 6) as p_draw, round(g_away/mass, 6) as p_away from grid""")
def poisson_glm(t: Tables) -> DataFrame:
    g = fits(t).withColumn("grid", scores.goal_grid(F.col("glm_home"), F.col("glm_away")))
    return g.select("match_id", r("glm_home"), r("glm_away"), *[F.round(p, 6).alias(c) for p, c in zip(forecast.grid_probabilities(), P)])


# Results and questions of a competition in one order; ratings are a list by team, moved step by step.
RATED = """,
steps as (
  select *, row_number() over (partition by competition_id order by known_at, step, completed_at, match_id) as i from (
    select competition_id, match_id, home_id, away_id, greatest(available_at, completed_at + interval '1' microsecond) as known_at, 1 as step, completed_at, home_goals - away_goals as goals
    from v_match where available_at is not null
    union all select competition_id, match_id, home_id, away_id, kickoff_at, 2, null, null from v_match)),
walk as (
  select distinct competition_id, cast(0 as bigint) as i, cast(null as bigint) as match_id, cast(null as double) as chance, [1500e0 for x in range(25)] as ratings from v_match
  union all
  select s.competition_id, s.i, case when step = 2 then s.match_id end, 1e0 / (1e0 + pow(10e0, (w.ratings[away_id + 1] - w.ratings[home_id + 1] - 65e0) / 400e0)),
    case when step = 2 then w.ratings else list_transform(w.ratings, lambda x, j: x + (case j - 1 when home_id then 20e0 when away_id then -20e0 else 0e0 end)
      * ((sign(goals) + 1e0) / 2e0 - 1e0 / (1e0 + pow(10e0, (w.ratings[away_id + 1] - w.ratings[home_id + 1] - 65e0) / 400e0)))) end
  from walk w join steps s on s.competition_id = w.competition_id and s.i = w.i + 1)"""


@query("elo_walk_forward", with_(MATCH, league()).replace("with", "with recursive", 1) + RATED + """
select match_id, l.competition_id, round((1 - (c_draw+1e0)/(n+3e0)) * chance, 7) as p_home, round((c_draw+1e0)/(n+3e0), 7) as p_draw, round((1 - (c_draw+1e0)/(n+3e0)) * (1 - chance), 7) as p_away
from league l join walk using (match_id)""")
def elo_walk_forward(t: Tables) -> DataFrame:
    m = views.matches(t)
    frame = forecast.league_frame(m, m, RECONSTRUCTED)
    draw = forecast.league_probabilities()[1]
    joined = frame.join(models.elo_chances(m, m, RECONSTRUCTED), "match_id")
    return joined.select("match_id", "competition_id", *[F.round(p, 7).alias(c) for p, c in zip(models.elo_probabilities(F.col("chance"), draw), P)])


KEPT = [n for n in models.KNN_FEATURES if n not in models.ABLATED]


def neighbours_sql(names, name: str) -> str:
    """CTEs up to `name` (match_id, p_*): every usable earlier result is measured by a plain range join."""
    moments = ", ".join(f"coalesce(avg(h.{n}), 0e0) as m_{n}, case when count(h.{n}) = 0 then 1e0 else greatest(1e-6, sqrt(greatest(0e0, avg(h.{n} * h.{n}) - avg(h.{n}) * avg(h.{n})))) end as w_{n}" for n in names)
    squares = " + ".join(f"pow((coalesce(h.{n}, m_{n}) - coalesce(t.{n}, m_{n})) / w_{n}, 2)" for n in names)
    return f"""
{name}_m as (select t.match_id, {moments} from value t left join value h on h.competition_id = t.competition_id and h.known_at <= t.kickoff_at group by t.match_id),
{name}_n as (select t.match_id, h.outcome from value t join {name}_m m using (match_id) join value h on h.competition_id = t.competition_id and h.known_at <= t.kickoff_at
  qualify row_number() over (partition by t.match_id order by round({squares}, 8), h.match_id) <= 25),
{name} as (select match_id, (count(*) filter (n.outcome = 'HOME') + 1e0) / (count(n.outcome) + 3e0) as p_home, (count(*) filter (n.outcome = 'DRAW') + 1e0) / (count(n.outcome) + 3e0) as p_draw,
  (count(*) filter (n.outcome = 'AWAY') + 1e0) / (count(n.outcome) + 3e0) as p_away from v_match left join {name}_n n using (match_id) group by match_id)"""


VALUE = f"""
value as (select f.*, m.competition_id, m.kickoff_at, m.outcome, case when m.available_at is not null then greatest(m.available_at, m.completed_at + interval '1' microsecond) end as known_at from ({EXACT}) f join v_match m using (match_id))"""
KNN_ROUNDED = "select match_id, round(p_home,7) as p_home, round(p_draw,7) as p_draw, round(p_away,7) as p_away from "


def _knn(t: Tables, names) -> DataFrame:
    m = views.matches(t)
    frame = cut_lineage(features.feature_frame(m, m, RECONSTRUCTED))
    out = models.knn_probabilities(models.votes(frame, m, RECONSTRUCTED, [names])[0], frame.select("match_id"))
    return out.select("match_id", *[r(c, 7) for c in P])


@query("knn_forecast", with_(*FEATS, VALUE, neighbours_sql(models.KNN_FEATURES, "knn")) + KNN_ROUNDED + "knn")
def knn_forecast(t: Tables) -> DataFrame:
    return _knn(t, models.KNN_FEATURES)


@query("knn_ablation", with_(*FEATS, VALUE, neighbours_sql(KEPT, "knn")) + KNN_ROUNDED + "knn")
def knn_ablation(t: Tables) -> DataFrame:
    return _knn(t, KEPT)


@forecast.register_model("LEAGUE_STRONG_PRIOR")
def strong_prior() -> list:
    """League frequencies with twenty matches of a uniform league added."""
    return [(F.col(f"c_{k}") + 20) / (F.col("n") + 60) for k in scores.LETTERS]


@query("plugged_models", with_(MATCH, league()) + """, m as (select match_id, n, (c_home+1e0)/(n+3e0) as a1, (c_draw+1e0)/(n+3e0) as a2, (c_away+1e0)/(n+3e0) as a3,
  (c_home+20e0)/(n+60e0) as b1, (c_draw+20e0)/(n+60e0) as b2, (c_away+20e0)/(n+60e0) as b3 from league where n >= 50)
select match_id, 'LEAGUE_EMPIRICAL' as model_id, round(a1,7) as p_home, round(a2,7) as p_draw, round(a3,7) as p_away from m
union all select match_id, 'LEAGUE_STRONG_PRIOR', round(b1,7), round(b2,7), round(b3,7) from m""")
def plugged_models(t: Tables) -> DataFrame:
    m = views.matches(t)
    made = forecast.registered_forecasts(m, m, RECONSTRUCTED, ["LEAGUE_EMPIRICAL", "LEAGUE_STRONG_PRIOR"])
    return made.select("match_id", "model_id", *[r(p, 7) for p in P])


# -- ensembles of the models that plain SQL can follow --------------------------------------------

TRIO = (MATCH, league(), VENUE, POSTERIOR, RATES, GRID, """
trio as (
  select match_id, competition_id, outcome, kickoff_at, 'LEAGUE_EMPIRICAL' as model_id, l_home as p_home, l_draw as p_draw, l_away as p_away from league_p where n >= 50
  union all select match_id, competition_id, outcome, kickoff_at, 'VENUE_EMPIRICAL', p_home, p_draw, p_away from venue_p where n >= 50
  union all select match_id, competition_id, outcome, kickoff_at, 'POISSON', g_home/mass, g_draw/mass, g_away/mass from grid where n >= 50)""", scored("trio"), """
ent as (select *, -(p_home*ln(p_home)+p_draw*ln(p_draw)+p_away*ln(p_away)) as h from scored),
eq as (select match_id, avg(p_home) as e1, avg(p_draw) as e2, avg(p_away) as e3, avg(h) as mh, max(p_home)-min(p_home) as r1, max(p_draw)-min(p_draw) as r2, max(p_away)-min(p_away) as r3 from ent group by 1)""")


def trio_forecasts(t: Tables) -> DataFrame:
    m = views.matches(t).select("match_id", F.col("available_at").alias("outcome_available_at"))
    home, away = F.col("rate_home"), F.col("rate_away")
    rows = rated(t).drop("available_at").withColumn("grid", scores.goal_grid(home, away)).join(m, "match_id")
    made = {"LEAGUE_EMPIRICAL": forecast.league_probabilities(), "VENUE_EMPIRICAL": forecast.venue_probabilities(), "POISSON": forecast.grid_probabilities()}
    keep = ["match_id", "competition_id", "decision_at", "outcome", "outcome_available_at"]
    return forecast.long_forecasts(rows, made, keep)


def combined(t: Tables) -> DataFrame:
    return ensemble.compare(scoring.score(trio_forecasts(t)), ["competition_id"])


def evenly(t: Tables) -> DataFrame:
    return ensemble.even(trio_forecasts(t), ["competition_id"])


@query("ensemble_equal", with_(*TRIO) + "select match_id, round(e1,7) as p_home, round(e2,7) as p_draw, round(e3,7) as p_away from eq")
def ensemble_equal(t: Tables) -> DataFrame:
    return evenly(t).select("match_id", *[r(F.col(f"equal_{p}"), 7).alias(p) for p in P])


PAST = """,
past as (select t.match_id, t.model_id, t.p_home, t.p_draw, t.p_away, count(s.match_id) as k, avg(s.log_loss) as ml
  from trio t left join (select sc.*, m.available_at from scored sc join v_match m using (match_id)) s on s.competition_id = t.competition_id and s.model_id = t.model_id and s.available_at <= t.kickoff_at and s.kickoff_at < t.kickoff_at
  group by all),
wt as (select match_id, min(k) as k, sum(exp(-ml)*p_home)/sum(exp(-ml)) as w1, sum(exp(-ml)*p_draw)/sum(exp(-ml)) as w2, sum(exp(-ml)*p_away)/sum(exp(-ml)) as w3 from past group by 1)"""


@query("ensemble_past_loss", with_(*TRIO) + PAST + """select match_id, k >= 30 as adaptive, round(case when k >= 30 then w1 else e1 end,7) as p_home,
  round(case when k >= 30 then w2 else e2 end,7) as p_draw, round(case when k >= 30 then w3 else e3 end,7) as p_away from wt join eq using (match_id)""")
def ensemble_past_loss(t: Tables) -> DataFrame:
    return combined(t).select("match_id", "adaptive", *[r(F.col(f"weighted_{p}"), 7).alias(p) for p in P])


@query("js_disagreement", with_(*TRIO) + "select match_id, round(greatest(0e0, -(e1*ln(e1)+e2*ln(e2)+e3*ln(e3)) - mh),7)+0e0 as js_disagreement from eq")
def js_disagreement(t: Tables) -> DataFrame:
    return evenly(t).select("match_id", r("js_disagreement", 7))


@query("class_ranges", with_(*TRIO) + "select match_id, round(r1,7) as range_p_home, round(r2,7) as range_p_draw, round(r3,7) as range_p_away from eq")
def class_ranges(t: Tables) -> DataFrame:
    return evenly(t).select("match_id", *[r(f"range_{p}", 7) for p in P])


@query("analysis_record", with_(*TRIO[:1], *FEATS[1:], *TRIO[1:]) + f""", wide as ({WIDE})
select match_id, n as training_count, round(e1,7) as equal_p_home, round(-(e1*ln(e1)+e2*ln(e2)+e3*ln(e3)),7) as entropy, round(greatest(0e0, -(e1*ln(e1)+e2*ln(e2)+e3*ln(e3)) - mh),7)+0e0 as js_disagreement,
  3 + (home_form is null)::int + (away_form is null)::int + (home_goals_for is null)::int + (away_goals_for is null)::int + (home_goals_against is null)::int + (away_goals_against is null)::int
  + (home_venue_goals_for is null)::int + (away_venue_goals_for is null)::int + (home_venue_goals_against is null)::int + (away_venue_goals_against is null)::int
  + (home_rest_days is null)::int + (away_rest_days is null)::int as n_missing
from eq join league using (match_id) join wide using (match_id)""")
def analysis_record(t: Tables) -> DataFrame:
    """One row per target: training size, ensemble, entropy, disagreement and missing inputs."""
    m = views.matches(t)
    made = evenly(t)
    missing = features.missing_inventory(features.feature_frame(m, m, RECONSTRUCTED)).select("match_id", "n_missing")
    size = forecast.league_frame(m, m, RECONSTRUCTED).select("match_id", F.col("n").cast("bigint").alias("training_count"))
    h = scores.entropy([F.col(f"equal_{p}") for p in P])
    joined = made.join(size, "match_id").join(missing, "match_id")
    return joined.select("match_id", "training_count", r("equal_p_home", 7), F.round(h, 7).alias("entropy"), r("js_disagreement", 7), F.col("n_missing").cast("int").alias("n_missing"))


# -- everything at once ------------------------------------------------------------------------


def full_run(t: Tables) -> DataFrame:
    m = views.matches(t)
    return ensemble.walk_forward(m, m, RECONSTRUCTED)


@query("walk_forward_models")
def walk_forward_models(t: Tables) -> DataFrame:
    """Metrics of seven models, the ablation, both ensembles and the uniform benchmark."""
    out = scoring.metric_summary(full_run(t), ["competition_id", "model_id"])
    cols = ("log_loss", "rps", "brier", "brier_home", "brier_draw", "brier_away", "accuracy")
    return out.withColumns({c: F.round(c, 6) for c in cols})


@query("ablation_delta", with_(*FEATS, VALUE, neighbours_sql(models.KNN_FEATURES, "knn"), neighbours_sql(KEPT, "cut")) + """,
loss as (select competition_id, -ln(case outcome when 'HOME' then k.p_home when 'DRAW' then k.p_draw else k.p_away end) as a,
  -ln(case outcome when 'HOME' then c.p_home when 'DRAW' then c.p_draw else c.p_away end) as b from v_match join knn k using (match_id) join cut c using (match_id))
select competition_id, round(avg(b) - avg(a), 6) as log_loss_delta from loss group by competition_id""")
def ablation_delta(t: Tables) -> DataFrame:
    """Mean log-loss change of the neighbour model when form, rest and congestion are removed."""
    m = views.matches(t)
    frame = cut_lineage(features.feature_frame(m, m, RECONSTRUCTED))
    label = m.select("match_id", "competition_id", scores.outcome(F.col("home_goals"), F.col("away_goals")).alias("outcome"))
    runs = None
    for name, votes in zip(("KNN", ensemble.ABLATION), models.votes(frame, m, RECONSTRUCTED, [models.KNN_FEATURES, KEPT])):
        one = models.knn_probabilities(votes, frame.select("match_id")).withColumn("model_id", F.lit(name))
        runs = one if runs is None else runs.unionByName(one)
    losses = scoring.score(runs.join(label, "match_id")).groupBy("competition_id").pivot("model_id", ["KNN", ensemble.ABLATION]).agg(F.avg("log_loss"))
    return losses.select("competition_id", F.round(F.col(ensemble.ABLATION) - F.col("KNN"), 6).alias("log_loss_delta"))
