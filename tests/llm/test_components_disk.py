"""Rounds of star steps leave no shuffle files behind, so disk does not grow with the rounds."""

import os

from chronofold.llm import near_dedup


def files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {n for d in manager.localDirs() for _, _, names in os.walk(d.getPath()) for n in names if n.startswith("shuffle_")}


def test_rounds_leave_no_shuffle_files(spark):
    n = 60
    links = spark.createDataFrame([(i * 37 % n, (i + 1) * 37 % n) for i in range(n - 1)], "a bigint, b bigint")
    before = files(spark)
    got = near_dedup.components(links)
    assert files(spark) <= before
    assert {tuple(r) for r in got.collect()} == {(i, 0) for i in range(1, n)}
