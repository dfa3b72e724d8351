"""Ranking of information needs and acceptance of their answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from . import temporal

COND = ("c_home", "c_draw", "c_away")
BASE = ("b_home", "b_draw", "b_away")


def rank(needs: DataFrame, scenarios: DataFrame, allowed: DataFrame, states: DataFrame, now: Column, budget: float) -> DataFrame:
    """Feasibility, expected entropy gain, largest shift and priority of every need.

    needs: need_id, deadline, cost, seconds, b_*;  scenarios: need_id, weight, c_*;
    allowed: need_id, source_id, position;  states: source_id, state.
    """
    cond, base = [F.col(c) for c in COND], [F.col(b) for b in BASE]
    outlook = scenarios.join(needs.select("need_id", *BASE), "need_id").groupBy("need_id").agg(
        F.sum(F.col("weight") * scores.entropy(cond)).alias("_h"), F.max(scores.total_variation(base, cond)).alias("max_total_variation"))
    approved = allowed.join(states.filter(F.col("state") == "APPROVED"), "source_id").groupBy("need_id").agg(
        F.count(F.lit(1)).alias("approved_sources"), F.min_by("source_id", "position").alias("first_source"))
    # A need without a scenario has no outlook: it stays, as not feasible and without a gain.
    joined = needs.join(outlook, "need_id", "left").join(approved, "need_id", "left")
    remaining = F.timestamp_diff("MICROSECOND", now, F.col("deadline")) / F.lit(1e6)
    feasible = F.coalesce((F.col("approved_sources") > 0) & F.col("_h").isNotNull() & (now < F.col("deadline")) & (F.col("cost") <= budget) & (F.col("seconds") < remaining), F.lit(False))
    gain = scores.entropy(base) - F.col("_h")
    return joined.withColumns({
        "approved_sources": F.coalesce("approved_sources", F.lit(0)), "feasible": feasible, "entropy_gain": gain,
        "priority": F.when(feasible, F.greatest(F.lit(0.0), gain) / (1 + F.col("cost") + F.col("seconds") / 60)).otherwise(0.0),
    }).drop("_h")


def answer_states(ranked: DataFrame, answers: DataFrame, now: Column) -> DataFrame:
    """Outcome of one answer per need, and the entropy reduction of the accepted ones.

    answers: need_id, answer_source, field, available_at, ingested_at, availability_mode,
    valid (null when validation itself failed), a_* (null when recalculation failed).
    """
    after = [F.col(c) for c in ("a_home", "a_draw", "a_away")]
    timely = temporal.eligible(now, temporal.STRICT) & (F.col("ingested_at") <= now)
    matches = F.coalesce((F.col("answer_source") == F.col("first_source")) & (F.col("field") == F.col("missing_field")) & timely, F.lit(False))
    state = temporal.first_reason({
        "DEADLINE_EXPIRED": now >= F.col("deadline"),
        "TERMS_BLOCKED": F.col("approved_sources") == 0,
        "SOURCE_UNAVAILABLE": ~F.col("feasible") | F.col("answer_source").isNull(),
        "REJECT": ~matches,
        "QUARANTINE": ~F.coalesce(F.col("valid"), F.lit(False)),
        "MODEL_FAILURE": after[0].isNull(),
    }, "VALIDATED_RECALCULATED")
    done = F.col("state") == "VALIDATED_RECALCULATED"
    before = scores.entropy([F.col(b) for b in BASE])
    joined = ranked.join(answers, "need_id", "left").withColumn("state", state)
    return joined.select(
        "need_id", "state", before.alias("entropy_before"), F.when(done, scores.entropy(after)).alias("entropy_after"),
        F.when(done, before - scores.entropy(after)).alias("entropy_reduction"), F.col("known_fields"), F.col("required_fields"),
        (F.col("known_fields") / F.col("required_fields")).alias("completeness_before"),
        ((F.col("known_fields") + done.cast("int")) / F.col("required_fields")).alias("completeness_after"))
