"""Records of fault_injection stay where their event was dealt to."""

from test_findings_r03 import against_sql
from test_findings_r04 import shuffled_records

import __spark_entry__ as entry_points


def test_records_are_not_shuffled(spark, directory):
    n = spark.read.parquet(f"{directory}/events.parquet").count()
    rows = shuffled_records(spark, lambda: entry_points.queries()["fault_injection"](spark, directory).write.format("noop").mode("overwrite").save())
    print("rows shuffled an event", rows / n)
    assert rows < 4 * n


def test_an_event_without_id_is_judged_too(spark, tmp_path):
    path = f"{tmp_path}/events.parquet"
    spark.createDataFrame([(i,) for i in (0, 7, 12, None, -3, 2**40)], "event_id bigint").coalesce(1).write.parquet(path)
    assert against_sql(spark, "fault_injection", {"events": path}) == ("ok", 8)


def test_a_repeated_id_is_compared_with_the_one_before(spark, tmp_path):
    spark.createDataFrame([(i,) for i in (1, 2, 2, 2, 3)], "event_id bigint").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["fault"]: (r["cases"], r["detected"], r["false_positives"]) for r in entry_points.queries()["fault_injection"](spark, str(tmp_path)).collect()}
    assert got["duplicate"] == (5, 5, 0) and got["control"] == (5, 0, 2)
    assert got["conflicting_observation"] == (5, 3, 0)  # the second and third repeat a body that arrived
