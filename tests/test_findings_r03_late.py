"""Cases of the third round's later findings."""

import __spark_entry__ as entry_points
from chronofold.operators import ensemble, scoring
from chronofold.plans import forecasting, views


def test_long_documents_are_made_by_many_tasks(spark, directory):
    for name in ("scan_forecast_arrays", "scan_forecast_series"):
        assert entry_points.queries()[name](spark, directory).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_envelopes_are_made_by_many_tasks_and_clocks_parsed_once(spark, directory):
    out = entry_points.queries()["envelope_verdicts"](spark, directory)
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert out._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") <= 4  # created, sources, artifacts, observations


def test_even_ensembles_ask_for_no_past_scores(spark, directory, monkeypatch):
    monkeypatch.setattr(ensemble, "past_scores_at", None)
    for name in ("ensemble_equal", "class_ranges"):
        assert entry_points.queries()[name](spark, directory).columns[0] == "match_id"


def test_past_loss_keeps_only_what_it_weighs(spark, directory, monkeypatch):
    kept, cut = [], ensemble.cut_lineage
    monkeypatch.setattr(ensemble, "cut_lineage", lambda df: kept.append(df.columns) or cut(df))
    entry_points.queries()["ensemble_past_loss"](spark, directory)
    assert kept and "log_loss" in kept[0] and "rps" not in kept[0]


def test_bootstrap_makes_its_blocks_once(spark, directory, monkeypatch):
    kept, cut = [], scoring.cut_lineage
    monkeypatch.setattr(scoring, "cut_lineage", lambda df: kept.append(cut(df)) or kept[-1])
    plan = entry_points.queries()["bootstrap_ci"](spark, directory)._jdf.queryExecution().optimizedPlan().toString()
    assert len(kept) == 1 and "l_orderkey" not in plan


def test_replay_makes_each_side_once(spark, directory):
    def scans(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [l_orderkey")
    t = views.Tables(spark, directory)
    assert scans(entry_points.queries()["replay_check"](spark, directory)) <= scans(forecasting.baseline_forecasts(t)) + scans(forecasting.forecast_replayed(t))
