"""Record gates: verdicts with reason codes, policies, contracts, reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import running, temporal

REQUIRED = ("fixture_id", "home_team_id", "away_team_id", "source_id", "source_url", "observed_at", "retrieved_at",
            "available_at", "content_hash", "parser_version")
QUARANTINABLE = ("STALE_DATA", "CONFLICTING_DATA")
STALE_AFTER = "interval 7 days"


def any_of(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def record_reasons(at: Column) -> Column:
    """Reason codes that need only the record itself; clock columns are raw text."""
    seen, got, known = (text.offset_timestamp(F.col(c)) for c in ("observed_at", "retrieved_at", "available_at"))
    readable = seen.isNotNull() & got.isNotNull()
    ordered = seen <= got
    clocks_bad = ~readable | (ordered & known.isNull())
    late = ~clocks_bad & (~ordered | ~((got <= known) & (known <= at)))
    return temporal.reasons({
        "ENTITY_UNRESOLVED": any_of([~text.uuid_text(F.col(c)) for c in ("fixture_id", "home_team_id", "away_team_id")]
                                    + [F.col("home_team_id").eqNullSafe(F.col("away_team_id"))]),
        "EPISTEMIC_STATE_INVALID": ~(F.col("temporal_mode").eqNullSafe(F.lit("STRICT_PIT")) & F.col("epistemic_state").eqNullSafe(F.lit("OBSERVATION"))),
        "FUTURE_TIMESTAMP": late,
        "MISSING_PROVENANCE": any_of([F.coalesce(F.col(c), F.lit("")) == "" for c in REQUIRED]),
        "SCHEMA_CHANGED": any_of([~text.public_url(F.col("source_url")), ~text.sha256_hex(F.col("content_hash")), clocks_bad]),
        "STALE_DATA": ~clocks_bad & (at > got + F.expr(STALE_AFTER)),
    })


def body_hash(columns: Sequence[str]) -> Column:
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c), F.lit("\u0000")) for c in columns]), 256)


def record_gate(records: DataFrame, at: Column, arrival: str, body: Sequence[str], seen: DataFrame | Column | None = None,
                rows_per_slice: int = 100_000, within: Sequence[str] = ()) -> DataFrame:
    """ACCEPT / QUARANTINE / REJECT per record with sorted reason codes.

    A repeated id is compared with the body that arrived just before it, or with `seen`
    (fixture_id, seen_hash) for the first arrival; slices of the arrival counter keep a hot id
    parallel. What only needs the record is judged before rows are dealt by id, so that columns nobody
    reads later stay behind. `seen` may be of any size, and its estimate does not see rows that were exploded;
    it may also be a column of the records. Where an id belongs to one group, which `within` names, and records
    are dealt by these few, ids are compared inside their groups and no record is shuffled.
    """
    hashed = records.withColumns({"body_hash": body_hash(body), "_own": record_reasons(at)})
    if within:
        stepped = hashed.withColumn("prev_body_hash", F.lag("body_hash").over(Window.partitionBy(*within, "fixture_id").orderBy(arrival)))
    else:
        stepped = running.with_previous(hashed, ["fixture_id"], [arrival], ["body_hash"], F.floor(F.col(arrival) / rows_per_slice))
    prior = F.col("prev_body_hash")
    if isinstance(seen, Column):
        prior = F.coalesce(prior, seen)
    elif seen is not None:
        stepped = stepped.join(seen.hint("merge"), "fixture_id", "left")
        prior = F.coalesce(prior, F.col("seen_hash"))
    return judged(stepped, at, prior, F.col("_own")).drop("_own")


def judged(hashed: DataFrame, at: Column, prior: Column, own: Column | None = None) -> DataFrame:
    """Reason codes and verdict of records with a `body_hash`, given the body that arrived before under the same id."""
    repeat = F.when(prior.isNull(), None).when(prior == F.col("body_hash"), "DUPLICATE").otherwise("CONFLICTING_DATA")
    codes = F.array_sort(F.array_compact(F.concat(record_reasons(at) if own is None else own, F.array(repeat))))
    severe = F.array_except("reason_codes", F.array(*[F.lit(q) for q in QUARANTINABLE]))
    return hashed.withColumn("reason_codes", codes).withColumn(
        "verdict", F.when(F.size("reason_codes") == 0, "ACCEPT").when(F.size(severe) == 0, "QUARANTINE").otherwise("REJECT"))


def policy_failure(now: Column, url: Column) -> Column:
    """First failing policy rule of a source row, or null; evaluation order is part of the contract."""
    ladder = temporal.first_reason({
        "SOURCE_UNKNOWN": F.col("terms_status").isNull(),
        "INVALID_URL": ~text.public_url(url),
        "TERMS_BLOCKED": (F.col("terms_status") != "ALLOWED_RESEARCH") | ~F.coalesce(F.col("license_status").isin("RESEARCH_ONLY", "CC0-1.0"), F.lit(False)),
        "TERMS_UNVERIFIED": ~(F.col("terms_verification").eqNullSafe(F.lit("VERIFIED")) & F.col("license_verification").eqNullSafe(F.lit("VERIFIED"))),
        "TERMS_REVIEW_EXPIRED": now > F.col("reviewed_at") + F.expr("interval 30 days"),
        "SOURCE_URL_NOT_ALLOWED": (text.url_host(url) != F.col("host")) | ~F.array_contains("allowed_urls", url),
    }, F.lit(None).cast("string"))
    return ladder


def policy_gate(records: DataFrame, policies: DataFrame, now: Column, on: str = "source_id") -> DataFrame:
    """Policy is a small dimension; Spark broadcasts it only while its measured size allows."""
    return records.join(policies, on, "left").withColumn("policy_failure", policy_failure(now, F.col("source_url")))


def observation_verdict(records: DataFrame, policies: DataFrame, now: Column) -> DataFrame:
    gated = policy_gate(records, policies, now)
    observed, available, updated, target = (F.col(c) for c in ("observed_at", "available_at", "updated_at", "target_as_of_at"))
    disordered = ~((observed <= available) & (available <= updated)) | (updated > now)
    reason = F.coalesce(F.col("policy_failure"), temporal.first_reason({
        "ROBOTS_BLOCKED": ~F.coalesce(F.col("robots_status").isin("ALLOWED", "ABSENT"), F.lit(False)),
        "CONTENT_TYPE_UNEXPECTED": ~F.array_contains("content_types", F.col("content_type")),
        "INVALID_TIMESTAMP_ORDER": disordered,
        "FUTURE_LEAKAGE": F.greatest(observed, available, updated) > target,
        "ENTITY_UNRESOLVED": F.coalesce(F.col("entity_id"), F.lit("")) == "",
        "CONFLICTING_DATA": F.col("conflict"),
        "DUPLICATE": F.col("duplicate"),
        "STALE_DATA": F.timestamp_diff("SECOND", observed, now) > F.coalesce("stale_after_seconds", F.lit(86400)),
    }, "SOURCE_POLICY_AND_PROVENANCE_VALID"))
    verdict = (
        F.when(F.col("reason").isin("ENTITY_UNRESOLVED", "CONFLICTING_DATA"), "QUARANTINE").when(F.col("reason") == "STALE_DATA", "ACCEPT_WITH_WARNING")
        .when(F.col("reason") == "SOURCE_POLICY_AND_PROVENANCE_VALID", "ACCEPT").otherwise("REJECT"))
    return gated.withColumn("reason", reason).withColumn("verdict", verdict)


def snapshot_reasons(now: Column) -> Column:
    required = ("snapshot_id", "source_id", "source_url", "content_hash", "raw_artifact_hash", "parser_version", "source_policy_version", "temporal_mode")
    return temporal.reasons({
        "INCOMPLETE_PROVENANCE": any_of([F.coalesce(F.trim(F.col(c)), F.lit("")) == "" for c in required]),
        "NOT_STRICT": ~F.col("temporal_mode").eqNullSafe(F.lit("STRICT_PIT")),
        "INVALID_HASH": ~text.sha256_hex(F.col("content_hash")) | ~text.sha256_hex(F.col("raw_artifact_hash")),
        "HASH_MISMATCH": F.col("content_hash") != F.col("raw_artifact_hash"),
        "INVALID_TIMESTAMP_ORDER": ~((F.col("observed_at") <= F.col("retrieved_at")) & (F.col("retrieved_at") <= F.col("available_at")) & (F.col("available_at") <= now)),
        "INVALID_URL": ~text.public_url(F.col("source_url")),
    })


def reconcile(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Multiset differences both ways in one pass: each row is counted, not compared in pairs."""
    sides = left.select(*columns, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(*columns, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    return sides.groupBy(*columns).agg(F.sum("_l").alias("in_left"), F.sum("_r").alias("in_right")).filter("in_left <> in_right")


def source_metrics(attempts: DataFrame, by: Sequence[str] = ("source_id",)) -> DataFrame:
    """Attempt, success, transport and parser rates, mean latency, adjacent content changes."""
    ok = F.col("status") == "COMPLETE"
    rates = attempts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("attempts"), F.count(F.when(ok, 1)).alias("successes"), F.avg(ok.cast("double")).alias("validated_rate"),
        F.avg(F.col("transported").cast("double")).alias("transport_rate"),
        F.count(F.when(F.col("reason").isin("AttributeError", "GATE_REJECTED"), 1)).alias("parser_failures"),
        F.avg("elapsed_seconds").alias("mean_latency_seconds"))
    changes = running.with_previous(attempts.filter(ok), by, ["attempted_at", "attempt_id"], ["content_hash"], running.calendar_slice("attempted_at"))
    revised = changes.groupBy(*by).agg(F.count(F.when(F.col("prev_exists") & (F.col("content_hash") != F.col("prev_content_hash")), 1)).alias("content_revisions"))
    return rates.join(revised, list(by), "left").withColumn("content_revisions", F.coalesce("content_revisions", F.lit(0)))


def rate_gate(attempts: DataFrame, by: Sequence[str], limit: int = 4, gap_seconds: int = 60) -> DataFrame:
    """Attempts that exceed `limit` per rolling day or follow the previous one too soon.

    The rolling count is a running count minus the running count a day earlier.
    """
    at = "attempted_at"
    stepped = running.with_previous(attempts, by, [at, "attempt_id"], [at], running.calendar_slice(at))
    marks = attempts.select(*by, at, F.lit(1).alias("_n"))
    aged = attempts.select(*by, (F.col(at) + F.expr("interval 1 day")).alias(at), F.lit(-1).alias("_n"))
    open_now = running.totals_at(marks.unionByName(aged), attempts.select(*by, at), by, at, sums=["_n"])
    joined = stepped.join(open_now, [*by, at])
    return joined.select(
        "attempt_id", *by, at, F.col("_n").cast("bigint").alias("in_last_day"),
        F.array_join(temporal.reasons({
            "DAILY_LIMIT": F.col("_n") > limit,
            "MINIMUM_INTERVAL": F.timestamp_diff("SECOND", F.col(f"prev_{at}"), F.col(at)) < gap_seconds,
        }), ",").alias("reasons"))
