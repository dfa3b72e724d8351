"""Chains do not depend on how they are cut, and tampering is found."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from chronofold.operators import ledger, running

BODY = ("event", "kind")


def build(spark, size):
    rows = [(f"c{i % 3}" if i % 4 else "hot", i, "PREDICTION", datetime(2024, 1, 1) + timedelta(hours=i)) for i in range(60)]
    df = spark.createDataFrame(rows, "chain string, event bigint, kind string, recorded_at timestamp_ntz")
    return ledger.build_chain(df, "chain", ["recorded_at", "event"], BODY, running.calendar_slice("recorded_at"), size)


def test_slices_do_not_change_hashes(spark):
    whole = sorted((r.chain, r.sequence, r.hash) for r in build(spark, 1000).collect())
    cut = sorted((r.chain, r.sequence, r.hash) for r in build(spark, 4).collect())
    assert whole == cut and len(whole) == 60


def test_clean_chain_verifies_and_tampering_is_reported(spark):
    clean = build(spark, 1000)
    assert ledger.chain_violations(clean, "chain", BODY).count() == 0
    bad = clean.withColumn("kind", F.when(F.col("event") == 10, "OUTCOME").otherwise(F.col("kind")))
    assert [r.violation for r in ledger.chain_violations(bad, "chain", BODY).collect()] == ["BODY_HASH_MISMATCH"]
