"""Prediction ledger: issuance and outcome gates, hash chains, parallel verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..session import scratch_path
from . import running, temporal

GENESIS = "0" * 64
CHAIN_SCHEMA = "chain string, sequence bigint, previous_hash string, hash string"


def body_text(columns: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in columns])


def link_hash(previous: Column, sequence: Column, body: Column) -> Column:
    return F.sha2(F.concat_ws("|", previous, sequence.cast("string"), body), 256)


def fold_chains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Link rows sorted by (chain, sequence); only the current chain's head is held.

    A row without sequence carries the head of an earlier slice and sorts first.
    """
    current, tip = None, GENESIS
    for rows in batches:
        out = []
        for chain, sequence, body, carried in zip(rows["chain"], rows["sequence"], rows["body"], rows["head"]):
            if chain != current:
                current, tip = chain, GENESIS
            if pd.isna(sequence):
                tip = carried
                continue
            previous, number = tip, int(sequence)
            tip = hashlib.sha256(f"{previous}|{number}|{body}".encode()).hexdigest()
            out.append((chain, number, previous, tip))
        yield pd.DataFrame(out, columns=["chain", "sequence", "previous_hash", "hash"]).astype({"sequence": "int64"})


def build_chain(rows: DataFrame, chain: str, order: Sequence[str], body: Sequence[str], slice_by: Column, rows_per_slice: int = 100_000) -> DataFrame:
    """Number the events of every chain and link them by hash.

    Linking is sequential by definition, so it advances in bounded slices; all chains advance
    together and only one head per chain crosses a slice border.
    """
    numbered = running.ordinal(rows, [chain], order, slice_by, name="sequence")
    work = numbered.select(F.col(chain).cast("string").alias("chain"), "sequence", body_text(body).alias("body"), F.lit(None).cast("string").alias("head"),
                           F.floor((F.col("sequence") - 1) / rows_per_slice).cast("int").alias("part"))
    # Written once by parts, so that each step reads its own part and the heads of the step before.
    spark = rows.sparkSession
    path, made = scratch_path(spark, "chain-events"), scratch_path(spark, "chain-links")
    work.write.partitionBy("part").parquet(path)
    stored = spark.read.parquet(path)
    schema, last = stored.drop("part").schema, stored.agg(F.max("part")).first()[0]
    for i in range((-1 if last is None else last) + 1):
        part = spark.read.schema(schema).parquet(f"{path}/part={i}")
        if i:  # sequences have no gaps, so a chain that goes on had its head in the part before
            heads = spark.read.schema(CHAIN_SCHEMA).parquet(f"{made}/part={i - 1}").groupBy("chain").agg(F.max_by("hash", "sequence").alias("head"))
            part = part.unionByName(heads.join(part.select("chain").distinct(), "chain", "left_semi"), allowMissingColumns=True)
        done = part.repartition("chain").sortWithinPartitions("chain", F.col("sequence").asc_nulls_first()).mapInPandas(fold_chains, CHAIN_SCHEMA)
        done.write.parquet(f"{made}/part={i}")
    linked = spark.createDataFrame([], CHAIN_SCHEMA) if last is None else spark.read.schema(CHAIN_SCHEMA).parquet(*[f"{made}/part={i}" for i in range(last + 1)])
    return numbered.withColumn("_chain", F.col(chain).cast("string")).join(
        linked.withColumnRenamed("chain", "_chain"), ["_chain", "sequence"]).drop("_chain")


def chain_violations(ledger: DataFrame, chain: str, body: Sequence[str], heads: DataFrame | None = None, rows_per_slice: int = 100_000) -> DataFrame:
    """Broken links of a ledger; every check is local to a row and its predecessor.

    heads: optional (chain, expected_head) retained elsewhere.
    """
    stepped = running.with_previous(ledger, [chain], ["sequence", "hash"], ["sequence", "hash", "recorded_at"], F.floor(F.col("sequence") / rows_per_slice))
    found = stepped.select(chain, "sequence", F.explode(temporal.reasons({
        "SEQUENCE_BROKEN": F.col("sequence") != F.coalesce("prev_sequence", F.lit(0)) + 1,
        "PREVIOUS_HASH_MISMATCH": F.col("previous_hash") != F.coalesce("prev_hash", F.lit(GENESIS)),
        "BODY_HASH_MISMATCH": F.col("hash") != link_hash(F.col("previous_hash"), F.col("sequence"), body_text(body)),
        "CLOCK_BACKWARDS": F.col("recorded_at") < F.col("prev_recorded_at"),
    })).alias("violation"))
    if heads is None:
        return found
    tips = ledger.groupBy(chain).agg(F.max_by(F.struct("sequence", "hash"), "sequence").alias("_t"))
    wrong = tips.join(heads, chain).filter(F.col("_t.hash") != F.col("expected_head"))
    return found.unionByName(wrong.select(chain, F.col("_t.sequence").alias("sequence"), F.lit("HEAD_MISMATCH").alias("violation")))


def prediction_reasons() -> Column:
    """Needs issued_at, kickoff_at, p_*, n_inputs, n_ineligible, n_undeclared, artifact hash and class."""
    return temporal.reasons({
        "ISSUED_AFTER_KICKOFF": F.col("issued_at") >= F.col("kickoff_at"),
        "INVALID_PROBABILITIES": ~scores.is_distribution([F.col(c) for c in ("p_home", "p_draw", "p_away")]),
        "NO_INPUTS": F.coalesce(F.col("n_inputs"), F.lit(0)) == 0,
        "INPUT_NOT_AVAILABLE": F.col("n_ineligible") > 0,
        "INPUT_SOURCE_UNDECLARED": F.col("n_undeclared") > 0,
        "ARTIFACT_HASH_REQUIRED": F.col("artifact_hash").isNull() & ~F.col("synthetic"),
    })


def gate_predictions(proposals: DataFrame, inputs: DataFrame) -> DataFrame:
    """Every input must be strict, known at issue time and of a declared source."""
    facts = inputs.join(proposals.select("prediction_id", "issued_at", "declared_source"), "prediction_id").groupBy("prediction_id").agg(
        F.count(F.lit(1)).alias("n_inputs"),
        F.count(F.when(~F.coalesce(temporal.eligible(F.col("issued_at"), temporal.STRICT) & (F.col("ingested_at") <= F.col("issued_at")), F.lit(False)), 1)).alias("n_ineligible"),
        F.count(F.when(F.col("source") != F.col("declared_source"), 1)).alias("n_undeclared"))
    joined = proposals.join(facts, "prediction_id", "left")
    return joined.withColumn("reasons", prediction_reasons())


def gate_outcomes(predictions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Outcome events with the reasons they are refused, and scores where they are not."""
    first = temporal.latest_by(outcomes, ["prediction_id"], ["recorded_at", "outcome_id"], ["outcome_id"], first=True).withColumnRenamed("outcome_id", "first_id")
    joined = outcomes.join(predictions.withColumnRenamed("synthetic", "p_synthetic"), "prediction_id", "left").join(first, "prediction_id", "left")
    ordered = (F.col("kickoff_at") < F.col("completed_at")) & (F.col("completed_at") <= F.col("observed_at")) & (F.col("observed_at") <= F.col("recorded_at"))
    codes = temporal.reasons({
        "PREDICTION_UNKNOWN": F.col("kickoff_at").isNull(),
        "ALREADY_SCORED": F.col("outcome_id") != F.col("first_id"),
        "CHRONOLOGY": ~ordered,
        "NOT_AVAILABLE_AT_RECORDING": ~F.coalesce(F.col("available_at") <= F.col("recorded_at"), F.lit(False)),
        "MIXED_EVIDENCE_CLASS": F.col("synthetic") != F.col("p_synthetic"),
    })
    made = scores.score_columns([F.col(c) for c in ("p_home", "p_draw", "p_away")], F.col("outcome"))
    gated = joined.withColumn("reasons", codes)
    fine = F.size("reasons") == 0
    return gated.select("outcome_id", "prediction_id", "reasons", *[F.when(fine, made[k]).alias(k) for k in ("log_loss", "rps", "brier")])


def pending_outcomes(predictions: DataFrame, outcomes: DataFrame, captured: DataFrame) -> DataFrame:
    """Unscored real predictions whose fixture is reported final in a later capture."""
    open_ones = predictions.filter(~F.col("synthetic")).join(outcomes.select("prediction_id"), "prediction_id", "left_anti")
    return open_ones.join(captured, "fixture_id").filter(
        (F.col("status") == "REPORTED_FINAL") & (F.col("match_date") < F.to_date("captured_at")) & (F.col("captured_at") > F.col("kickoff_at")))
