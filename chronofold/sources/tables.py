"""Append-only versioned tables, content-addressed rows, exports and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import running, scoring


def content_key(body: str | Column) -> Column:
    return F.sha2(body, 256)


def put_content(existing: DataFrame, incoming: DataFrame, body: str = "body", take: Sequence[str] = ()) -> DataFrame:
    """New (hash, body) rows: first arrival of every body that is not stored yet."""
    hashed = incoming.withColumn("content_hash", content_key(body))
    fresh = hashed.join(existing.select("content_hash"), "content_hash", "left_anti")
    return fresh.groupBy("content_hash").agg(F.first(body).alias(body), *[F.min(c).alias(c) for c in take], F.count(F.lit(1)).alias("copies"))


def audit_content(stored: DataFrame, body: str = "body") -> DataFrame:
    return stored.filter(~F.col("content_hash").eqNullSafe(content_key(body)))


def dedup_key(key: Column, payload: Column) -> Column:
    return F.sha2(F.concat_ws("|", key, payload), 256)


def append_versions(existing: DataFrame, incoming: DataFrame, arrival: Sequence[str], slice_by: Column) -> DataFrame:
    """Rows to append: next version numbers and predecessors per natural key.

    existing: record_id, natural_key, version, dedup_key;  incoming: record_id, natural_key,
    dedup_key, arrival columns and payload.  Known dedup keys are skipped; repeats inside the
    batch keep their first arrival.  Ids come from the input, so a retried batch appends
    nothing twice.
    """
    names = [c for c in incoming.columns if c != "dedup_key"]
    order = F.struct(*arrival, "record_id")
    firsts = incoming.groupBy("dedup_key").agg(F.min_by(F.struct(*names), order).alias("_r")).select("dedup_key", "_r.*")
    fresh = firsts.join(existing.select("dedup_key"), "dedup_key", "left_anti")
    heads = existing.groupBy("natural_key").agg(F.max_by(F.struct("version", "record_id"), "version").alias("_h")).select(
        "natural_key", F.col("_h.version").alias("_version"), F.col("_h.record_id").alias("_head"))
    numbered = running.ordinal(fresh, ["natural_key"], [*arrival, "record_id"], slice_by, name="_nth")
    linked = running.with_previous(numbered, ["natural_key"], [*arrival, "record_id"], ["record_id"], slice_by)
    joined = linked.join(heads, "natural_key", "left")
    return joined.select(
        *incoming.columns, (F.coalesce("_version", F.lit(0)) + F.col("_nth")).alias("version"),
        F.coalesce("prev_record_id", F.col("_head")).alias("supersedes_id"))


def immutable_refusals(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows whose key already exists, but not with this payload, for tables that never version."""
    known = incoming.join(existing.select("natural_key").distinct(), "natural_key", "left_semi")
    return known.join(existing.select("natural_key", "dedup_key").distinct(), ["natural_key", "dedup_key"], "left_anti")


def manifest(rows: DataFrame, parts: Sequence[Column], body: Column) -> DataFrame:
    """Row count, byte count and order-free digest of an export, without collecting it."""
    facts = rows.agg(F.count(F.lit(1)).alias("row_count"), F.sum(F.octet_length(body) + 1).alias("byte_count"))
    return facts.join(scoring.set_digest(rows, [], parts).select("digest"))  # both sides are one row


def export_json(rows: DataFrame, path: str, parts: Sequence[Column], body: Column) -> None:
    """JSON lines plus manifest; refuses to overwrite either."""
    rows.select(body.alias("value")).write.mode("errorifexists").text(f"{path}/data")
    manifest(rows, parts, body).write.mode("errorifexists").json(f"{path}/manifest")


def summary_row(key: str, columns: DataFrame) -> DataFrame:
    """One presentation row per cache key; writing it overwrites that key's partition only."""
    return columns.select(F.lit(key).alias("cache_key"), F.to_json(F.struct(*columns.columns)).alias("payload"))


def write_summary(row: DataFrame, path: str) -> None:
    row.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cache_key").parquet(path)
