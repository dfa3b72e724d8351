"""Bitemporal crosswalk: resolution by key and by name, revisions, audits, projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import running, temporal

KEY = ("provider", "entity_type", "provider_key")


def mapping_at(lookups: DataFrame, crosswalk: DataFrame, on: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """Per lookup (and provider key) the mapping in force at valid_at as known at known_at.

    The highest known revision is chosen first and its interval is tested afterwards, so a
    closing correction never lets an older open interval back in.
    """
    known = lookups.join(crosswalk, list(on)).filter(
        (F.col("recorded_at") <= F.col("known_at")) & (F.col("valid_from") <= F.col("valid_at")))
    group = list(dict.fromkeys([*ids, *KEY, "valid_at"]))
    picked = known.groupBy(*group).agg(
        F.max_by(F.struct("revision", "valid_to", "canonical_id", "review_state", "normal_name"), "revision").alias("_m"))
    return picked.select(*group, "_m.*").filter(F.col("valid_to").isNull() | (F.col("valid_at") < F.col("valid_to")))


def unreviewed() -> Column:
    return F.col("canonical_id").isNull() | (F.col("review_state") != "CONFIRMED")


def resolve(lookups: DataFrame, crosswalk: DataFrame) -> DataFrame:
    found = mapping_at(lookups, crosswalk, KEY, ["lookup_id"]).select("lookup_id", "revision", "canonical_id", "review_state")
    reason = F.when(F.col("revision").isNull(), "NO_VALID_KNOWN_MAPPING").when(unreviewed(), "UNRESOLVED_OR_UNCONFIRMED").otherwise("RESOLVED")
    return lookups.join(found, "lookup_id", "left").select(
        "lookup_id", reason.alias("reason"), F.when(reason == "RESOLVED", F.col("canonical_id")).alias("canonical_id"))


def resolve_names(lookups: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Unique confirmed name or a reason; any unreviewed candidate of the name blocks it.

    Candidate keys are narrowed to those that ever carried the name before the as-of choice.
    """
    keys = crosswalk.select(*KEY, F.col("normal_name").alias("asked_name")).distinct()
    asked = lookups.withColumnRenamed("normal_name", "asked_name")
    narrowed = asked.join(keys, ["provider", "entity_type", "asked_name"])
    in_force = mapping_at(narrowed, crosswalk, KEY, ["lookup_id", "asked_name"]).filter(F.col("normal_name") == F.col("asked_name"))
    folded = in_force.groupBy("lookup_id").agg(
        F.max(unreviewed().cast("int")).alias("_open"), F.min("canonical_id").alias("_lo"), F.max("canonical_id").alias("_hi"))
    reason = (
        F.when(F.col("_open") == 1, "UNREVIEWED_NAME_CANDIDATE").when(F.col("_lo").isNull(), "NAME_NOT_FOUND")
        .when(F.col("_lo") != F.col("_hi"), "AMBIGUOUS_NAME").otherwise("UNIQUE_CONFIRMED_NAME"))
    return asked.join(folded, "lookup_id", "left").select(
        "lookup_id", reason.alias("reason"), F.when(reason == "UNIQUE_CONFIRMED_NAME", F.col("_lo")).alias("canonical_id"))


def violations(crosswalk: DataFrame, entities: DataFrame) -> DataFrame:
    """Revisions consecutive, knowledge monotone, intervals nonempty, entities registered."""
    stepped = running.with_previous(crosswalk, KEY, ["revision", "recorded_at"], ["revision", "recorded_at"], F.floor(F.col("revision") / 4096))
    known = entities.select("canonical_id", F.lit(True).alias("_known"))
    joined = stepped.join(known, "canonical_id", "left")
    return joined.select(*KEY, "revision", F.explode(temporal.reasons({
        "REVISION_NOT_CONSECUTIVE": F.col("revision") != F.coalesce("prev_revision", F.lit(0)) + 1,
        "KNOWLEDGE_BACKWARDS": F.col("recorded_at") < F.col("prev_recorded_at"),
        "EMPTY_INTERVAL": F.col("valid_to") <= F.col("valid_from"),
        "UNREGISTERED_ENTITY": F.col("canonical_id").isNotNull() & F.col("_known").isNull(),
        "UNRESOLVED_CLAIMS_ID": (F.col("method") == "UNRESOLVED") & F.col("canonical_id").isNotNull(),
        "RESOLVED_WITHOUT_ID": (F.col("method") != "UNRESOLVED") & F.col("canonical_id").isNull(),
    })).alias("violation"))


def append_aliases(crosswalk: DataFrame, additions: DataFrame) -> DataFrame:
    """Next revision numbers for new alias declarations; identical declarations are skipped."""
    heads = crosswalk.groupBy(*KEY).agg(F.max("revision").alias("_head"), F.max("recorded_at").alias("_head_at"))
    fresh = additions.join(crosswalk.select(*KEY, "canonical_id", "recorded_at"), [*KEY, "canonical_id", "recorded_at"], "left_anti")
    numbered = running.ordinal(fresh, KEY, ["recorded_at", "canonical_id"], running.calendar_slice("recorded_at"), name="_nth")
    joined = numbered.join(heads, list(KEY), "left")
    return joined.filter(F.col("_head_at").isNull() | (F.col("recorded_at") >= F.col("_head_at"))).withColumn(
        "revision", F.coalesce("_head", F.lit(0)) + F.col("_nth")).drop("_nth", "_head", "_head_at")


def registry_projection(entities: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Entity with the number of its mappings, its latest knowledge time and its aliases in order."""
    per = crosswalk.groupBy("canonical_id").agg(
        F.count(F.lit(1)).alias("mappings"), F.max("recorded_at").alias("latest_recorded_at"),
        F.count_distinct("provider_key").alias("aliases"), F.min("provider_key").alias("first_alias"), F.max("provider_key").alias("last_alias"))
    return entities.join(per, "canonical_id", "left").withColumns(
        {"mappings": F.coalesce("mappings", F.lit(0)), "aliases": F.coalesce("aliases", F.lit(0))})
