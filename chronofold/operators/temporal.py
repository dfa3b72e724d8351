"""Availability contracts, eligibility, as-of selection and revision-chain audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import running

STRICT, RECONSTRUCTED = "STRICT_PIT", "RECONSTRUCTED_PIT"
TICK = "interval '0.000001' second"  # resolution of a timestamp

# Named decision horizons: offset before kickoff, in minutes.
HORIZON_MINUTES = {"T_MINUS_24H": 1440, "T_MINUS_6H": 360, "T_MINUS_1H": 60, "T_MINUS_15M": 15, "KICKOFF": 0}


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def reasons(rules: Mapping[str, Column]) -> Column:
    """Array of the codes whose condition holds, in declared order; a null condition is false."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for code, cond in rules.items()]))


def first_reason(rules: Mapping[str, Column], otherwise: str | Column) -> Column:
    ladder = None
    for code, cond in rules.items():
        ladder = F.when(cond, code) if ladder is None else ladder.when(cond, code)
    return ladder.otherwise(otherwise)


def mode_allows(mode: str, row_mode: str | Column = "availability_mode") -> Column:
    return F.lit(True) if mode == RECONSTRUCTED else col(row_mode) == STRICT


def eligible(at: Column, mode: str, available: str | Column = "available_at",
             row_mode: str | Column = "availability_mode") -> Column:
    """Known at the cursor and admitted by the mode; a null availability is never eligible."""
    return col(available).isNotNull() & (col(available) <= at) & mode_allows(mode, row_mode)


def availability_reasons(now: Column | None = None) -> Column:
    confidence = F.col("confidence")
    rules = {
        "CLOCK_ORDER": ~((F.col("observed_at") <= F.col("retrieved_at")) & (F.col("retrieved_at") <= F.col("ingested_at"))),
        "MISSING_POLICY": F.coalesce(F.trim("policy"), F.lit("")) == "",
        "MISSING_SOURCE": F.coalesce(F.trim("source"), F.lit("")) == "",
        "CONFIDENCE_RANGE": ~F.coalesce(confidence.between(0, 1) & ~F.isnan(confidence), F.lit(False)),
        "STRICT_BACKDATED": (F.col("availability_mode") == STRICT) & (F.col("available_at") < F.col("ingested_at")),
        "UNKNOWN_MODE": ~F.coalesce(F.col("availability_mode").isin(STRICT, RECONSTRUCTED), F.lit(False)),
    }
    return reasons(rules)


def assign_availability(rows: DataFrame, delay_minutes: Column, published: str = "published_at",
                        event: str = "event_at", observed: str = "observed_at") -> DataFrame:
    """Availability by policy: evidenced publication first, else final-result delay, else unknown.

    A publication stamp after the observation proves nothing, and a result delay must lie in
    (0, 7 days]; such rows fall through to UNKNOWN with confidence 0.
    """
    proven = F.col(published).isNotNull() & (F.col(published) <= F.col(observed))
    delayed = F.col(event).isNotNull() & (delay_minutes > 0) & (delay_minutes <= 7 * 1440)
    shifted = F.col(event) + F.make_dt_interval(mins=delay_minutes)
    return rows.withColumns(
        {
            "policy": F.when(proven, "SOURCE_PUBLICATION_EVIDENCED_TIMESTAMP").when(delayed, "RESULT_FINAL").otherwise("UNKNOWN"),
            "available_at": F.when(proven, F.col(published)).when(delayed, shifted),
            "availability_mode": F.lit(RECONSTRUCTED),
            "confidence": F.when(proven | delayed, F.col("confidence")).otherwise(0.0),
        }
    )


def horizons(targets: DataFrame, names: Sequence[str] = tuple(HORIZON_MINUTES), kickoff: str = "kickoff_at") -> DataFrame:
    """One row per target and named horizon with its `decision_at`."""
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(HORIZON_MINUTES[n]).alias("mins")) for n in names])
    return targets.withColumn("_h", F.explode(pairs)).withColumns(
        {"horizon": F.col("_h.name"), "decision_at": F.col(kickoff) - F.make_dt_interval(mins=F.col("_h.mins"))}
    ).drop("_h")


def latest_by(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], take: Sequence[str],
              first: bool = False) -> DataFrame:
    """Latest (or first) row per key as a partial aggregate: no sort, safe for a hot key."""
    pick = (F.min_by if first else F.max_by)(F.struct(*take), F.struct(*order))
    return rows.groupBy(*keys).agg(pick.alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in take])


def as_of(revisions: DataFrame, at: Column, mode: str, take: Sequence[str], key: str = "entity_key",
          version: str = "version", extra: Column | None = None) -> DataFrame:
    """Highest eligible version per entity at one cursor; later versions never hide earlier ones.

    The eligibility filter has to precede the choice, and being a plain predicate it reaches
    the scan.  `extra` adds further clocks (creation, ingestion, update).
    """
    known = revisions.filter(eligible(at, mode) if extra is None else eligible(at, mode) & extra)
    return latest_by(known, [key], [version], take)


def as_of_many(cursors: DataFrame, revisions: DataFrame, mode: str, keys: Sequence[str], at: str,
               version: str, take: Sequence[str]) -> DataFrame:
    """Highest eligible version for every cursor row, without a range join.

    Per key the answer is a running maximum over availability time, so it is computed with
    sliced running windows and equi-joined back to the cursors.
    """
    known = revisions.filter(F.col("available_at").isNotNull() & mode_allows(mode)).select(
        *keys, F.col("available_at").alias(at), F.struct(F.col(version), *take).alias("_best")
    )
    best = running.totals_at(known, cursors, keys, at, maxima=["_best"])
    return cursors.join(best.filter(F.col("_best").isNotNull()), [*keys, at]).select(
        *cursors.columns, F.col("_best")[version].alias(version), *[F.col("_best")[c].alias(c) for c in take]
    )


def validity_intervals(revisions: DataFrame, key: str, mode: str, carry: Sequence[str] = ()) -> DataFrame:
    """Knowledge interval [valid_from, valid_to) of every version among the admitted ones.

    A version ends when the first of all later ones is known, which need not be the next one. Chains
    are short (corrections of one fact), so the version window is keyed by the fact.
    """
    from pyspark.sql import Window

    later = Window.partitionBy(key).orderBy("version").rowsBetween(1, Window.unboundedFollowing)
    known = revisions.filter(F.col("available_at").isNotNull() & mode_allows(mode))
    return known.withColumn("valid_to", F.min("available_at").over(later)).withColumn("valid_from", F.col("available_at"))


def chain_violations(chain: DataFrame, key: str = "entity_key", rows_per_slice: int = 4096) -> DataFrame:
    """Versions 1..n, each naming its predecessor, clocks never running backwards, ids unique."""
    numbered = running.with_previous(
        chain, [key], ["version", "record_id"], ["record_id", "version", "available_at", "ingested_at"],
        F.floor(F.col("version") / rows_per_slice),
    )
    first = ~F.col("prev_exists")
    rules = {
        "VERSION_GAP": F.when(first, F.col("version") != 1).otherwise(F.col("version") != F.col("prev_version") + 1),
        "WRONG_PREDECESSOR": ~F.col("supersedes_id").eqNullSafe(F.col("prev_record_id")),
        "INGESTION_BACKWARDS": F.col("ingested_at") < F.col("prev_ingested_at"),
        "AVAILABILITY_BACKWARDS": F.col("available_at") < F.col("prev_available_at"),
    }
    broken = numbered.select(key, "record_id", "version", F.explode(reasons(rules)).alias("reason"))
    repeated = (
        chain.groupBy("record_id")
        .agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias(key), F.min("version").alias("version"))
        .filter("_n > 1")
        .select(key, "record_id", "version", F.lit("DUPLICATE_RECORD_ID").alias("reason"))
    )
    return broken.unionByName(repeated)


def epistemic_reasons() -> Column:
    kind, mode = F.col("epistemic_type"), F.col("availability_mode")
    return reasons(
        {
            "UNKNOWN_EPISTEMIC_TYPE": ~kind.isin(
                "OBSERVATION", "RECONSTRUCTION", "DERIVED_FEATURE", "PREDICTION", "SIMULATION",
                "MARKET_OBSERVATION", "HYPOTHESIS",
            ),
            "RECONSTRUCTED_LABELLED_OBSERVATION": kind.isin("OBSERVATION", "MARKET_OBSERVATION") & (mode != STRICT),
            "STRICT_LABELLED_RECONSTRUCTION": (kind == "RECONSTRUCTION") & (mode != RECONSTRUCTED),
            "NO_EVIDENCE_REFERENCE": F.coalesce(F.col("evidence_count"), F.lit(0)) == 0,
        }
    )


def observed_fact() -> Column:
    return ~F.col("synthetic") & F.col("epistemic_type").isin("OBSERVATION", "MARKET_OBSERVATION")


def knowledge_cursor(records: DataFrame, at: Column, mode: str, facts_only: bool = False) -> DataFrame:
    """Records known at the cursor (an event may lie after it), ordered by (availability, id)."""
    known = records.filter(eligible(at, mode))
    if facts_only:
        known = known.filter(observed_fact())
    return known.orderBy("available_at", "record_id")
