"""Price observations: contracts, market as-of, consensus, trajectories, projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from . import running, temporal

ODDS = ("odds_home", "odds_draw", "odds_away")
FAIR = ("fair_home", "fair_draw", "fair_away")
MARKET = ("fixture_id", "bookmaker_id")
ORDER = ("quoted_at", "available_at", "snapshot_id")  # total order of quotes


def odds_columns() -> list[Column]:
    return [F.col(o) for o in ODDS]


def demargined(quotes: DataFrame, method: str = "PROPORTIONAL") -> DataFrame:
    """Fair probabilities of each quote; POWER solves for an exponent inside the row."""
    if method == "PROPORTIONAL":
        fair = scores.proportional(odds_columns())
        return quotes.withColumns(dict(zip(FAIR, fair)))
    powered = quotes.withColumn("_k", scores.power_exponent(odds_columns()))
    q = [F.pow(scores.implied(o), F.col("_k")) for o in odds_columns()]
    total = q[0] + q[1] + q[2]
    return powered.withColumns({n: x / total for n, x in zip(FAIR, q)}).drop("_k")


def as_of(quotes: DataFrame, at: Column, mode: str) -> DataFrame:
    return quotes.filter((F.col("quoted_at") <= at) & temporal.eligible(at, mode))


def violations(quotes: DataFrame) -> DataFrame:
    """Groups that must not be pooled: mixed kickoff, class or provider, ambiguous revisions."""
    checks = {"MIXED_KICKOFF": "kickoff_at", "SYNTHETIC_POOLED_WITH_REAL": "synthetic", "CROSS_PROVIDER": "provider"}
    per = quotes.groupBy("fixture_id").agg(
        *[(F.min(c) != F.max(c)).alias(code) for code, c in checks.items()]
    )
    mixed = per.select("fixture_id", F.explode(temporal.reasons({c: F.col(c) for c in checks})).alias("violation")).withColumn(
        "cases", F.lit(1).cast("bigint"))
    same = quotes.groupBy(*MARKET, "quoted_at", "available_at").agg(
        F.min(F.struct(*ODDS)).alias("_lo"), F.max(F.struct(*ODDS)).alias("_hi")
    ).filter(F.col("_lo") != F.col("_hi"))
    ambiguous = same.groupBy("fixture_id").agg(F.count(F.lit(1)).alias("cases")).select(
        "fixture_id", F.lit("AMBIGUOUS_REVISION").alias("violation"), "cases")
    return mixed.unionByName(ambiguous)


def opening_latest(quotes: DataFrame) -> DataFrame:
    order = F.struct(*ORDER)
    last = F.max_by(F.struct("snapshot_id", "closing_evidence"), order)
    per = quotes.groupBy(*MARKET).agg(
        F.min_by("snapshot_id", order).alias("first_retained"), last.alias("_l"), F.count(F.lit(1)).alias("quotes")
    )
    return per.select(*MARKET, "first_retained", F.col("_l.snapshot_id").alias("latest_retained"),
                      F.when(F.col("_l.closing_evidence").isNotNull(), F.col("_l.snapshot_id")).alias("verified_closing"), "quotes")


def latest_quotes(quotes: DataFrame, take: Sequence[str] = ODDS) -> DataFrame:
    return temporal.latest_by(quotes, MARKET, ORDER, ["snapshot_id", "quoted_at", *take])


def consensus(quotes: DataFrame, method: str = "PROPORTIONAL") -> DataFrame:
    """Mean fair vector over each bookmaker's latest quote, per fixture."""
    fair = demargined(latest_quotes(quotes), method)
    return fair.groupBy("fixture_id").agg(F.count(F.lit(1)).alias("bookmakers"), *[F.avg(f).alias(f) for f in FAIR])


def consensus_report(fixtures: DataFrame, quotes: DataFrame) -> DataFrame:
    """Every asked fixture with its consensus, input counts and the state of the evidence."""
    strength = quotes.groupBy("fixture_id").agg(
        F.count(F.lit(1)).alias("inputs"), F.max(F.col("synthetic").cast("int")).alias("_s"),
        F.max((F.col("availability_mode") == temporal.RECONSTRUCTED).cast("int")).alias("_r"),
    )
    # one row per bookmaker, so the provenance array is bounded by the number of bookmakers
    proof = latest_quotes(quotes, []).groupBy("fixture_id").agg(
        F.array_join(F.sort_array(F.collect_list(F.col("snapshot_id"))), ",").alias("latest_inputs"))
    joined = fixtures.join(consensus(quotes), "fixture_id", "left").join(strength, "fixture_id", "left").join(proof, "fixture_id", "left")
    found = F.col("bookmakers").isNotNull()
    return joined.select(
        "fixture_id", F.when(found, "CALCULATED").otherwise("INSUFFICIENT_EVIDENCE").alias("state"),
        F.when(F.col("_r") == 1, temporal.RECONSTRUCTED).when(found, temporal.STRICT).alias("temporal_mode"),
        (F.col("_s") == 1).alias("synthetic"), F.coalesce("inputs", F.lit(0)).alias("inputs"), "latest_inputs", *FAIR,
    )


def resolved(quotes: DataFrame) -> DataFrame:
    """Last revision per (market, quote time): a correction is not another sample in time."""
    return temporal.latest_by(quotes, [*MARKET, "quoted_at"], ["available_at", "snapshot_id"], ["snapshot_id", *ODDS])


def trajectory(quotes: DataFrame) -> DataFrame:
    """All points with fair probabilities; `current` marks those not corrected later."""
    points = demargined(quotes).withColumn("snapshot", F.col("snapshot_id"))
    kept = resolved(quotes).select("snapshot_id", F.lit(True).alias("_kept"))
    return points.join(kept, "snapshot_id", "left").select(
        "snapshot_id", *MARKET, "quoted_at", *FAIR, F.coalesce("_kept", F.lit(False)).alias("current"))


def velocity(quotes: DataFrame) -> DataFrame:
    """Change per hour of the fair vector between the two most recent distinct quote times."""
    path = demargined(resolved(quotes))
    stepped = running.with_previous(path, MARKET, ["quoted_at"], ["quoted_at", *FAIR], running.calendar_slice("quoted_at"))
    last = stepped.groupBy(*MARKET).agg(
        F.max_by(F.struct("quoted_at", *FAIR, "prev_exists", "prev_quoted_at", *[f"prev_{f}" for f in FAIR]), F.col("quoted_at")).alias("_p")
    ).select(*MARKET, "_p.*").filter("prev_exists")
    hours = F.timestamp_diff("MICROSECOND", F.col("prev_quoted_at"), F.col("quoted_at")) / F.lit(3600e6)
    return last.select(*MARKET, "quoted_at", *FAIR, *[((F.col(f) - F.col(f"prev_{f}")) / hours).alias(f"v_{f[5:]}") for f in FAIR])


def projection(quotes: DataFrame, computed_at: Column, projected_at: Column) -> DataFrame:
    """Clipped, renormalised constant-velocity hypothesis at a time at most 24 hours ahead."""
    moving = velocity(quotes.filter(F.col("available_at") <= computed_at))
    ahead = F.timestamp_diff("MICROSECOND", F.col("quoted_at"), projected_at) / F.lit(3600e6)
    raw = [F.col(f) + F.col(f"v_{f[5:]}") * ahead for f in FAIR]
    cut = scores.clip_renormalise(raw, [F.col(f) for f in FAIR])
    valid = (projected_at > computed_at) & (projected_at <= computed_at + F.expr("interval 24 hours"))
    return moving.filter(valid).select(*MARKET, *[c.alias(f"projected_{f[5:]}") for c, f in zip(cut, FAIR)], F.lit("HYPOTHESIS").alias("epistemic_type"))


def movement(quotes: DataFrame) -> DataFrame:
    """Price change of every selection against the preceding quote of the same market."""
    stepped = running.with_previous(quotes, MARKET, ["quoted_at", "snapshot_id"], ["quoted_at", *ODDS], running.calendar_slice("quoted_at")).filter("prev_exists")
    sides = F.array(*[F.struct(F.lit(o[5:].upper()).alias("selection"), F.col(f"prev_{o}").alias("old"), F.col(o).alias("new")) for o in ODDS])
    rows = stepped.select("snapshot_id", F.timestamp_diff("SECOND", F.col("prev_quoted_at"), F.col("quoted_at")).alias("seconds_between"), F.explode(sides).alias("_m"))
    return rows.select("snapshot_id", "_m.selection", (F.col("_m.new") - F.col("_m.old")).alias("odds_delta"),
                       ((F.col("_m.new") - F.col("_m.old")) / F.col("_m.old") * 100).alias("percentage_movement"), "seconds_between")


def quote_reasons() -> Column:
    odds_ok = F.lit(True)
    for o in odds_columns():
        odds_ok = odds_ok & scores.implied(o).isNotNull()
    return temporal.reasons({
        "INVALID_ODDS": ~odds_ok,
        "QUOTED_AFTER_KICKOFF": F.col("quoted_at") > F.col("kickoff_at"),
        "AVAILABLE_BEFORE_QUOTED": F.col("available_at") < F.col("quoted_at"),
        "QUOTED_AFTER_OBSERVED": F.col("quoted_at") > F.col("observed_at"),
        "PROVIDER_MISMATCH": F.col("bookmaker_provider") != F.col("provider"),
        "INVALID_HASH": ~F.coalesce(F.col("evidence_hash").rlike("^[0-9a-f]{64}$"), F.lit(False)),
        "BLANK_CLOSING_PROOF": F.trim("closing_evidence") == "",
    })


def selection_reasons() -> Column:
    line, p = F.col("line_value"), scores.implied(F.col("decimal_odds"))
    return temporal.reasons({
        "INVALID_ODDS": p.isNull(),
        "INVALID_IMPLIED_PROBABILITY": F.abs(F.col("implied_probability") - p) > 1e-12 * p,
        "UNKNOWN_MARKET": ~F.coalesce(F.col("market_type").isin("h2h", "totals", "spreads"), F.lit(False)),
        "UNKNOWN_MARKET_STATUS": ~F.coalesce(F.col("market_status").isin("OPEN", "SUSPENDED", "CLOSED", "UNKNOWN"), F.lit(False)),
        "INVALID_VERIFICATION_STATE": ~F.coalesce(F.col("verification_state").isin("CONFIRMED", "CORROBORATED", "UNCONFIRMED", "STALE", "CONFLICTING", "REJECTED"), F.lit(False)),
        "MISSING_LINE": F.col("market_type").isin("totals", "spreads") & line.isNull(),
        "EXPIRES_BEFORE_OBSERVED": F.col("expires_at") < F.col("observed_at"),
    })


def quote_classes(quotes: DataFrame, identity: Sequence[str], value: Sequence[str]) -> DataFrame:
    """Groups sharing an identity: one price is DISTINCT or DUPLICATE, several are CONFLICTING_DATA."""
    per = quotes.groupBy(*identity).agg(F.count(F.lit(1)).alias("quotes"), F.min(F.struct(*value)).alias("_lo"), F.max(F.struct(*value)).alias("_hi"))
    state = F.when(F.col("quotes") == 1, "DISTINCT").when(F.col("_lo") == F.col("_hi"), "DUPLICATE").otherwise("CONFLICTING_DATA")
    return per.select(*identity, "quotes", state.alias("state"))
