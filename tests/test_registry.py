"""Registered queries: names, shapes, and a sample of them against DuckDB at the smallest scale."""

import sys

import pytest

sys.path.insert(0, "/root/repo/tools")

import parity  # noqa: E402
import __spark_entry__ as entry_points  # noqa: E402

SAMPLE = ("as_of_strict", "as_of_join", "walk_forward_revised", "feature_frame", "evidence_select", "crosswalk_resolve", "record_gate", "consensus_report",
          "velocity", "envelope_verdicts", "versioned_append", "ledger_verify", "secret_scan", "research_rank")


def test_every_oracle_belongs_to_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert len(entry_points.queries()) > 100


@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_sql(spark, directory, name):
    result, _ = parity.compare(entry_points.queries()[name](spark, directory), parity.engine(directory), entry_points.oracle_sql()[name])
    assert result.replace("; EMPTY", "").replace("EMPTY", "ok") == "ok"


def test_entry_runs(spark):
    assert entry_points.entry(spark).columns[:2] == ["competition_id", "model_id"]


def test_export_refuses_to_overwrite(spark, directory):
    import tempfile

    from pyspark.sql import functions as F

    from chronofold.sources import tables

    rows, path = spark.range(10), tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/out"
    body, parts = F.to_json(F.struct("id")), [F.col("id").cast("string")]
    tables.export_json(rows, path, parts, body)
    assert spark.read.json(f"{path}/manifest").first().row_count == 10
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        tables.export_json(rows, path, parts, body)


def test_html_udfs(spark):
    from chronofold.functions import html

    html.register_udfs(spark)
    page = "<p>Hi <b>you</b><script>no()</script></p><a href='/x?a=1&amp;b=2'>go</a>"
    assert spark.createDataFrame([(page,)], "h string").selectExpr("visible_text(h) as t").first().t == "Hi you go"
    assert [r.link for r in spark.sql(f"select * from extract_links(\"{page}\")").collect()] == ["/x?a=1&b=2"]
