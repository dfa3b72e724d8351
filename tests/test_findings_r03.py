"""Cases of the third round's findings."""

import os
import sys
from datetime import datetime, timedelta

sys.path.insert(0, "/root/repo/tools")

import parity  # noqa: E402
import __spark_entry__ as entry_points  # noqa: E402
from chronofold.operators import features, models  # noqa: E402

ODD_PAGES = [
    "<p>a &amp</p><p>b &amp; c &eacute; &#8217; &amp;lt;</p>", "<p>1 < 2 and 3 > 2</p><>x", "<p>\u00a0y\u00a0</p>\x0b z \x0b",
    "<SCRIPT\u00e9>a</script\x0b>b</script >c", "<scripty>kept</scripty><!-- gone --><style>p{}</style\n>", "", None]


def against_sql(spark, name, tables):
    """A registered query and its SQL over the given parquet files."""
    directory = os.path.dirname(next(iter(tables.values())))
    con = parity.duckdb.connect()
    for table, path in tables.items():
        con.execute(f"create view {table} as select * from read_parquet('{path}/*.parquet')")
    return parity.compare(entry_points.queries()[name](spark, directory), con, entry_points.oracle_sql()[name])


def test_page_text_is_its_sql_on_odd_pages(spark, tmp_path):
    path = f"{tmp_path}/pages.parquet"
    spark.createDataFrame([(i, "http://e.org", p) for i, p in enumerate(ODD_PAGES)], "page_id bigint, url string, html string").coalesce(1).write.parquet(path)
    assert against_sql(spark, "page_text", {"pages": path}) == ("ok", len(ODD_PAGES))


def test_pit_audit_agrees_with_sql(spark, directory):
    assert parity.compare(entry_points.queries()["pit_audit"](spark, directory), parity.engine(directory), entry_points.oracle_sql()["pit_audit"]) == ("ok", 1)


def test_last_results_grow_with_instants_not_with_targets(spark):
    at = datetime(2023, 1, 1)
    rows = [(i, "c", 1, 2, at, at + timedelta(hours=2), at + timedelta(days=1), "STRICT_PIT", 1, 0) for i in range(300)]
    rows += [(1000 + i, "c", 1, 2, at + timedelta(days=1), at + timedelta(days=1, hours=2), None, "STRICT_PIT", 1, 0) for i in range(300)]
    df = spark.createDataFrame(rows, "match_id bigint, competition_id string, home_id int, away_id int, kickoff_at timestamp_ntz, completed_at timestamp_ntz, "
                                     "available_at timestamp_ntz, availability_mode string, home_goals int, away_goals int")
    states = features.last_states(df, df, "RECONSTRUCTED_PIT").collect()
    assert len(states) == 2 and all([x["match_id"] for x in s["rows"]] == [299, 298, 297, 296, 295] for s in states)
    assert features.last_results(df, df, "RECONSTRUCTED_PIT").count() == 300 * 2 * 5


def test_fault_injection_broadcasts_nothing_that_grows(spark, directory):
    plan = entry_points.queries()["fault_injection"](spark, directory)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_neighbours_store_no_pairs_of_blocks(spark):
    at = datetime(2023, 1, 1)
    rows = [(i, "c", 1, 2, at + timedelta(hours=i), at + timedelta(hours=i, minutes=5), at + timedelta(hours=i, minutes=9), "STRICT_PIT", i % 3, 1) for i in range(200)]
    results = spark.createDataFrame(rows, "match_id bigint, competition_id string, home_id int, away_id int, kickoff_at timestamp_ntz, completed_at timestamp_ntz, "
                                          "available_at timestamp_ntz, availability_mode string, home_goals int, away_goals int")
    frame = spark.createDataFrame([(i, "c", at + timedelta(hours=i), float(i % 7)) for i in range(200)], "match_id bigint, competition_id string, decision_at timestamp_ntz, a double")
    made = models.Neighbours(frame, results, "RECONSTRUCTED_PIT", ["a"], 3, 16, 4)
    got = {}
    for r in made.nearest().collect():
        got.setdefault(r["target_id"], set()).add(r["match_id"])
    assert "bounds" not in made.__dict__ and "history" not in made.__dict__
    for i in range(1, 200):
        assert got[i] == {x[1] for x in sorted((abs(j % 7 - i % 7), j) for j in range(i))[:3]}
