"""Leakage-free history of every target, and the forecasts that are projections of it.

`pit_frame` is the one expensive step: two passes of running totals (per competition and per
competition and team) turned into columns of one row per target.  Baselines, goal rates and
features are then column arithmetic over it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from . import running, temporal

LEAGUE = ("n", "hg", "ag", "c_home", "c_draw", "c_away")
VENUE = tuple(f"{side}_{m}" for side in ("h", "a") for m in ("n", "gf", "ga", "c_home", "c_draw", "c_away"))
TEAM = ("n", "gf", "ga", *VENUE, "recent")
CONGESTION_DAYS = 14
# Totals are folded per instant first, so a (key, month) slice holds at most one row per minute
# of kickoff times; finer slices would cost more than they spread.
SLICE = "month"


def knowable_from(available: str = "available_at", completed: str = "completed_at") -> Column:
    """First instant T with `available <= T` and `completed < T`."""
    return F.greatest(F.col(available), F.col(completed) + F.expr(temporal.TICK))


def signed_results(results: DataFrame, mode: str) -> DataFrame:
    """(+1 when a version becomes usable, -1 when a later version replaces it) per result.

    With `version` present, a replaced version leaves the totals at the very instant its
    successor is known, whether or not the successor is usable yet.
    """
    if "version" in results.columns:
        known = temporal.validity_intervals(results, "match_id", mode)
        known = known.withColumn("at", knowable_from()).filter(F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))
        plus = known.withColumn("sign", F.lit(1))
        minus = known.filter(F.col("valid_to").isNotNull()).withColumns({"at": F.col("valid_to"), "sign": F.lit(-1)})
        return plus.unionByName(minus).drop("valid_from")
    known = results.filter(F.col("available_at").isNotNull() & temporal.mode_allows(mode))
    return known.withColumns({"at": knowable_from(), "sign": F.lit(1), "valid_to": F.lit(None).cast("timestamp_ntz")})


def _outcome_counts(prefix: str = "c_") -> dict[str, Column]:
    label = scores.outcome(F.col("home_goals"), F.col("away_goals"))
    return {
        f"{prefix}{name}": F.when(label == c, F.col("sign")).otherwise(0)
        for c, name in zip(scores.CLASSES, scores.LETTERS)
    }


def league_totals(results: DataFrame, cursors: DataFrame, mode: str, span: bool = False) -> DataFrame:
    """Per (competition, instant): match, goal and outcome counts known at that instant."""
    signed = signed_results(results, mode).withColumns(_outcome_counts()).withColumns(
        {"n": F.col("sign"), "hg": F.col("sign") * F.col("home_goals"), "ag": F.col("sign") * F.col("away_goals"),
         "train_start": F.col("completed_at"), "train_end": F.col("completed_at")}
    )
    return running.totals_at(
        signed, cursors, ["competition_id"], "at", sums=LEAGUE,
        minima=["train_start"] if span else [], maxima=["train_end"] if span else [], unit=SLICE,
    )


def team_rows(signed: DataFrame) -> DataFrame:
    """Each signed result seen once by its home and once by its away team."""
    sides = F.array(
        F.struct(F.col("home_id").alias("team"), F.lit(True).alias("at_home"), F.col("home_goals").alias("gf"), F.col("away_goals").alias("ga")),
        F.struct(F.col("away_id").alias("team"), F.lit(False).alias("at_home"), F.col("away_goals").alias("gf"), F.col("home_goals").alias("ga")),
    )
    return signed.withColumn("_side", F.explode(sides)).select("*", "_side.*").drop("_side")


def team_totals(results: DataFrame, cursors: DataFrame, mode: str) -> DataFrame:
    """Per (competition, team, instant): overall, home-venue and away-venue totals.

    `recent` counts completions in the last 14 days: +1 when a result is usable, -1 once it is
    both usable and older than the window, which keeps it additive for any publication delay.
    """
    signed = team_rows(signed_results(results, mode))
    sign = F.col("sign")
    measures = {"n": sign, "gf": sign * F.col("gf"), "ga": sign * F.col("ga"), "recent": sign, "last_completed": F.col("completed_at")}
    counts = _outcome_counts("")
    for side, here in (("h", F.col("at_home")), ("a", ~F.col("at_home"))):
        for name, value in {"n": sign, "gf": sign * F.col("gf"), "ga": sign * F.col("ga"),
                            **{f"c_{k}": v for k, v in counts.items()}}.items():
            measures[f"{side}_{name}"] = F.when(here, value).otherwise(0)
    used = signed.select("competition_id", "team", "at", *[v.alias(k) for k, v in measures.items()])
    expiry = F.greatest(F.col("at"), F.col("completed_at") + F.expr(f"interval {CONGESTION_DAYS} days") + F.expr(temporal.TICK))
    aged = signed.select("competition_id", "team", expiry.alias("at"), (-F.col("sign")).alias("recent"))
    return running.totals_at(
        used.unionByName(aged, allowMissingColumns=True), cursors, ["competition_id", "team"], "at",
        sums=TEAM, maxima=["last_completed"], unit=SLICE,
    )


def decide(targets: DataFrame, offset_minutes: int = 0) -> DataFrame:
    if "decision_at" in targets.columns:
        return targets
    return targets.withColumn("decision_at", F.col("kickoff_at") - F.make_dt_interval(mins=F.lit(offset_minutes)))


TARGET = ("match_id", "competition_id", "home_id", "away_id", "kickoff_at", "decision_at")


def league_frame(targets: DataFrame, results: DataFrame, mode: str, span: bool = False) -> DataFrame:
    decided = decide(targets)
    cursors = decided.select("competition_id", F.col("decision_at").alias("at"))
    totals = league_totals(results, cursors, mode, span).withColumnRenamed("at", "decision_at")
    return decided.join(totals, ["competition_id", "decision_at"])


def pit_frame(targets: DataFrame, results: DataFrame, mode: str, span: bool = False) -> DataFrame:
    """One row per target: league columns plus `home_*` and `away_*` team totals."""
    framed = league_frame(targets, results, mode, span)
    decided = decide(targets)
    totals = team_totals(results, team_cursors(decided), mode).withColumnRenamed("at", "decision_at")
    columns = (*TEAM, "last_completed")
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_id").alias("team")) for s in ("home", "away")])
    asked = decided.select("match_id", "competition_id", "decision_at", F.explode(sides).alias("_s")).select(
        "match_id", "competition_id", "decision_at", "_s.*")
    # one pass over the totals for both teams; the two rows of a match meet again by its id
    paired = asked.join(totals, ["competition_id", "team", "decision_at"]).groupBy("match_id").agg(
        *[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{s}_{c}") for s in ("home", "away") for c in columns])
    return framed.join(paired, "match_id")


def team_cursors(decided: DataFrame) -> DataFrame:
    return decided.select(
        "competition_id", F.explode(F.array("home_id", "away_id")).alias("team"), F.col("decision_at").alias("at")
    )


# -- forecasts that are column arithmetic over the frame ---------------------------------------


def league_probabilities() -> list[Column]:
    return [(F.col(f"c_{k}") + 1.0) / (F.col("n") + 3.0) for k in scores.LETTERS]


def venue_probabilities(strength: float = 5.0) -> list[Column]:
    """Mean of the home team's home record and the away team's away record, both shrunk to the league."""
    league = league_probabilities()
    def posterior(side: str, prior: Column, k: str) -> Column:
        return (F.col(f"{side}_c_{k}") + strength * prior) / (F.col(f"{side}_n") + strength)
    return [(posterior("home_h", p, k) + posterior("away_a", p, k)) / 2 for p, k in zip(league, scores.LETTERS)]


def uniform_probabilities() -> list[Column]:
    return [F.lit(1.0) / 3 for _ in scores.LETTERS]


def goal_rates(prior: float = 5.0) -> tuple[Column, Column]:
    """Smoothed venue attack and defence rates, kept inside [0.05, 8]."""
    n = F.col("n") + prior
    mean_home, mean_away = (F.col("hg") + 1.5 * prior) / n, (F.col("ag") + 1.2 * prior) / n
    home, away = F.col("home_h_n") + prior, F.col("away_a_n") + prior
    attack_home = (F.col("home_h_gf") + mean_home * prior) / home
    defence_away = (F.col("away_a_ga") + mean_home * prior) / away
    attack_away = (F.col("away_a_gf") + mean_away * prior) / away
    defence_home = (F.col("home_h_ga") + mean_away * prior) / home
    def clip(x: Column) -> Column:
        return F.greatest(F.lit(0.05), F.least(F.lit(8.0), x))
    return clip(attack_home * defence_away / mean_home), clip(attack_away * defence_home / mean_away)


def grid_probabilities(grid: str = "grid") -> list[Column]:
    return [F.col(f"{grid}.{k}") / F.col(f"{grid}.mass") for k in scores.LETTERS]


def long_forecasts(frame: DataFrame, models: dict[str, Sequence[Column]], keep: Sequence[str]) -> DataFrame:
    """One row per (target, model) from columns of one row per target."""
    packed = F.array(
        *[F.struct(F.lit(m).alias("model_id"), *[p.alias(f"p_{k}") for p, k in zip(ps, scores.LETTERS)]) for m, ps in models.items()]
    )
    return frame.select(*keep, F.explode(packed).alias("_f")).select(*keep, "_f.*")


# A forecast model is a function that gives three probabilities as columns of `pit_frame`.
Model = Callable[[], Sequence[Column]]
MODELS: dict[str, Model] = {"LEAGUE_EMPIRICAL": league_probabilities, "VENUE_EMPIRICAL": venue_probabilities, "UNIFORM": uniform_probabilities}


def register_model(name: str) -> Callable[[Model], Model]:
    """Adds a model under a name of its own."""

    def register(model: Model) -> Model:
        if name in MODELS:
            raise ValueError(f"model {name} is registered twice")
        MODELS[name] = model
        return model

    return register


def registered_forecasts(targets: DataFrame, results: DataFrame, mode: str, names: Sequence[str] | None = None, floor: int = 50) -> DataFrame:
    """Long forecasts of the registered models, all over one frame."""
    ready = pit_frame(targets, results, mode).filter(F.col("n") >= floor)
    chosen = {name: MODELS[name]() for name in (names or MODELS)}
    return long_forecasts(ready, chosen, ["match_id", "competition_id", "decision_at", "n"])


def skip_reasons(frame: DataFrame, start: Column, end: Column, floor: int, schedule_known: Column) -> DataFrame:
    """Why a target is not forecast; null when it is."""
    inside = (F.col("decision_at") >= start) & (F.col("decision_at") < end)
    return frame.withColumn(
        "skip_reason",
        F.when(~inside, "OUTSIDE_EVALUATION_PERIOD")
        .when(~F.coalesce(schedule_known, F.lit(False)), "SCHEDULE_UNAVAILABLE_AT_HORIZON")
        .when(F.col("n") < floor, "INSUFFICIENT_TRAINING_HISTORY"),
    )
