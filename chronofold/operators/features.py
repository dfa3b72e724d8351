"""The 22 named features of a target and their long, audited form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import forecast, running

SIDE_FEATURES = ("form", "goals_for", "goals_against", "venue_goals_for", "venue_goals_against",
                 "rest_days", "congestion_14d", "history_missing")
EXTERNAL = ("lineup_continuity", "injury_burden", "market_movement")
NAMES = tuple(f"{s}_{f}" for s in ("home", "away") for f in SIDE_FEATURES) + tuple(
    n for e in EXTERNAL for n in (e, f"{e}_missing")
)
FORM_LENGTH = 5
FAN, LEVELS = 4, 8  # of the tree over a team's instants; as many levels as these need


def _ratio(total: Column, n: Column) -> Column:
    return F.when(n > 0, total / n)


def days_between(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(86400e6)


def _cover(low: Column, high: Column, levels: int = LEVELS) -> Column:
    """Nodes (level, place) of a tree over numbers, FAN children each, that together are [low, high).

    A node belongs to the cover if it lies inside and its parent doesn't: at most 2 * (FAN - 1) a level.
    """
    def numbers(first: Column, end: Column) -> Column:
        return F.when(first < end, F.sequence(first, end - 1)).otherwise(F.array().cast("array<bigint>"))

    nodes = []
    for level in range(levels):
        first, end = F.ceil(low / FAN**level), F.floor(high / FAN**level)
        first_up, end_up = F.ceil(low / FAN**(level + 1)) * FAN, F.floor(high / FAN**(level + 1)) * FAN  # parents inside
        places = F.when(first_up < end_up, F.concat(numbers(first, first_up), numbers(end_up, end))).otherwise(numbers(first, end))
        nodes.append(F.transform(places, lambda x: F.struct(F.lit(level).alias("level"), x.alias("place"))))  # noqa: B023
    return F.concat(*nodes)


def last_states(targets: DataFrame, results: DataFrame, mode: str, length: int = FORM_LENGTH) -> DataFrame:
    """(competition_id, team, decision_at, rows): the last `length` usable results, newest first, at every instant asked for.

    A version is usable for an interval of time, from its knowledge to its replacement. Of the versions
    with one interval, `length` are enough. The instants of a team are numbered, and an interval is covered
    by a few nodes of a tree over these numbers; a node keeps only its `length` most recently completed
    versions, a state that merges. The state at an instant is the merge of the nodes above it. So neither
    long publication delays nor removals nor many targets at one instant add candidates.
    """
    key = ["competition_id", "team"]
    seen = forecast.team_rows(forecast.signed_results(results, mode).filter((F.col("sign") == 1) & F.col("at").isNotNull()))
    versions = seen.select(*key, F.struct("completed_at", "match_id", "at", "gf", "ga").alias("row"), "at", "valid_to")

    def newest(*by: str) -> Column:
        return F.row_number().over(Window.partitionBy(*key, *by).orderBy(F.col("row.completed_at").desc(), F.col("row.match_id").desc()))

    folded = cut_lineage(versions.withColumn("_r", newest("at", "valid_to")).filter(F.col("_r") <= length).groupBy(*key, "at", "valid_to").agg(F.collect_list("row").alias("rows")))
    cursors = cut_lineage(forecast.team_cursors(forecast.decide(targets)).distinct())
    ends = folded.select(*key, F.explode(F.array_compact(F.array("at", "valid_to"))).alias("at"))
    instants = ends.unionByName(cursors).filter(F.col("at").isNotNull()).distinct()
    places = cut_lineage(running.ordinal(instants, key, ["at"], running.calendar_slice("at", forecast.SLICE), "_place"))
    levels, most = 1, places.agg(F.max("_place")).first()[0] or 0
    while FAN**levels <= most:
        levels += 1

    until = places.select(*key, F.col("at").alias("valid_to"), F.col("_place").alias("_to"))
    spans = folded.join(places.withColumnRenamed("_place", "_from"), [*key, "at"]).join(until, [*key, "valid_to"], "left")
    nodes = spans.select(*key, "rows", F.inline(_cover(F.col("_from"), F.coalesce("_to", F.lit(FAN**levels)), levels))).select(*key, "level", "place", F.explode("rows").alias("row"))
    states = nodes.withColumn("_r", newest("level", "place")).filter(F.col("_r") <= length).groupBy(*key, "level", "place").agg(F.collect_list("row").alias("rows"))
    above = cursors.join(places, [*key, "at"]).select(
        *key, "at", F.posexplode(F.array(*[F.floor(F.col("_place") / FAN**n) for n in range(levels)])).alias("level", "place"))
    merged = above.join(states, [*key, "level", "place"]).groupBy(*key, "at").agg(F.flatten(F.collect_list("rows")).alias("rows"))
    return merged.select(*key, F.col("at").alias("decision_at"), F.slice(F.sort_array("rows", asc=False), 1, length).alias("rows"))


def last_results(targets: DataFrame, results: DataFrame, mode: str, length: int = FORM_LENGTH) -> DataFrame:
    """The last `length` usable results of both teams of every target, one row each."""
    key = ["competition_id", "team"]
    asked = forecast.decide(targets).select(
        F.col("match_id").alias("target_id"), "competition_id", "decision_at",
        F.explode(F.array(F.struct(F.lit("home").alias("side"), F.col("home_id").alias("team")),
                          F.struct(F.lit("away").alias("side"), F.col("away_id").alias("team")))).alias("_s"),
    ).select("target_id", "competition_id", "decision_at", "_s.*")
    found = asked.join(last_states(targets, results, mode, length), [*key, "decision_at"])
    return found.select("target_id", "side", *key, F.explode("rows").alias("row")).select("target_id", "side", *key, "row.*")


def with_form(frame: DataFrame, targets: DataFrame, results: DataFrame, mode: str) -> DataFrame:
    """`frame`, of targets with `decision_at`, with the mean points of both teams' last five, the ids they rest on and when these were known."""
    def points(x: Column) -> Column:
        return F.when(x["gf"] > x["ga"], 3.0).when(x["gf"] == x["ga"], 1.0).otherwise(0.0)

    rows = F.col("rows")
    made = cut_lineage(last_states(targets, results, mode).select(
        "competition_id", "team", "decision_at",
        (F.aggregate(rows, F.lit(0.0), lambda total, x: total + points(x)) / F.size(rows)).alias("form"),
        F.array_join(F.sort_array(F.transform(rows, lambda x: x["match_id"])), ",").alias("form_ids"),
        F.array_max(F.transform(rows, lambda x: x["at"])).alias("form_known_at")))
    for side in ("home", "away"):
        own = made.select("competition_id", F.col("team").alias(f"{side}_id"), "decision_at", *[F.col(c).alias(f"{side}_{c}") for c in ("form", "form_ids", "form_known_at")])
        frame = frame.join(own, ["competition_id", f"{side}_id", "decision_at"], "left")
    return frame.withColumns({f"{side}_form_ids": F.coalesce(f"{side}_form_ids", F.lit("")) for side in ("home", "away")})


def form(targets: DataFrame, results: DataFrame, mode: str) -> DataFrame:
    """Mean points of the last five, as `home_form`, `away_form`, plus the ids they rest on; targets where neither team has any are left out."""
    asked = forecast.decide(targets).select("match_id", "competition_id", "home_id", "away_id", "decision_at")
    found = with_form(asked, targets, results, mode).filter(F.col("home_form").isNotNull() | F.col("away_form").isNotNull())
    return found.select("match_id", *[f"{side}_{c}" for side in ("home", "away") for c in ("form", "form_ids", "form_known_at")])


def side_columns(side: str, venue: str) -> dict[str, Column]:
    n, v = F.col(f"{side}_n"), F.col(f"{side}_{venue}_n")
    return {
        f"{side}_goals_for": _ratio(F.col(f"{side}_gf"), n),
        f"{side}_goals_against": _ratio(F.col(f"{side}_ga"), n),
        f"{side}_venue_goals_for": _ratio(F.col(f"{side}_{venue}_gf"), v),
        f"{side}_venue_goals_against": _ratio(F.col(f"{side}_{venue}_ga"), v),
        f"{side}_rest_days": days_between(F.col("kickoff_at"), F.col(f"{side}_last_completed")),
        f"{side}_congestion_14d": F.col(f"{side}_recent").cast("double"),
        f"{side}_history_missing": F.when(n > 0, 0.0).otherwise(1.0),
    }


def table_columns() -> dict[str, Column]:
    """Everything except form, straight from a `pit_frame` row."""
    external = {}
    for name in EXTERNAL:
        external[name] = F.lit(None).cast("double")
        external[f"{name}_missing"] = F.lit(1.0)
    return {**side_columns("home", "h"), **side_columns("away", "a"), **external}


def feature_frame(targets: DataFrame, results: DataFrame, mode: str, keep: tuple[str, ...] = (), span: bool = False) -> DataFrame:
    """Wide frame: target columns, league totals, 22 features; one row per target."""
    frame = forecast.pit_frame(targets, results, mode, span)
    joined = with_form(frame, targets, results, mode)
    made = table_columns()
    return joined.select(*forecast.TARGET, *keep, *[
        F.col(n) if n.endswith("_form") else made[n].alias(n) for n in NAMES
    ])


def long_features(wide: DataFrame, ids: tuple[str, ...] = ("match_id",)) -> DataFrame:
    return wide.unpivot(list(ids), list(NAMES), "feature", "feature_value")


def missing_inventory(wide: DataFrame) -> DataFrame:
    """Number and names of null features per target, without unpivoting."""
    flags = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in NAMES]))
    return wide.select("match_id", F.size(flags).cast("bigint").alias("n_missing"), F.array_join(F.sort_array(flags), ",").alias("missing_features"))
