"""Nothing is left out for its size, and answers that once went wrong."""

import json

import pytest
from pyspark.sql import functions as F

from chronofold.functions import html, scores, text
from chronofold.operators import forecast
from chronofold.sources import documents


def test_a_page_of_three_megabytes_is_read_whole(spark):
    body = "<p>word &amp; <b>more</b></p>" * 120_000 + "<!-- <a href='/no'> --><a class=x href='/last?a=1&amp;b=2'>end</a><script>var a = '<a href=\"/no\">'</script>"
    row = html.extract(spark.createDataFrame([(1, body), (2, None)], "page_id int, html string")).orderBy("page_id").collect()
    assert len(body) > 3_000_000 and row[0].text.endswith("word & more end") and row[0].text.count("word") == 120_000
    assert row[0].links == ["/last?a=1&b=2"] and row[1].text is None


def test_a_document_of_six_hundred_matches_is_kept(spark):
    games = [{"round": "r", "date": "2024-01-01", "team1": f"a{i}", "team2": f"b{i}", "score": {"ft": [60 + i % 3, 1]}} for i in range(600)]
    docs = spark.createDataFrame([("d", json.dumps({"name": "n", "matches": games}))], "doc_id string, body string")
    rows, rejected = documents.match_documents(docs)
    assert rows.count() == 600 and rejected.count() == 0
    assert [r.reason for r in documents.match_documents(docs, max_matches=500)[1].collect()] == ["MATCH_COUNT"]
    assert [r.reason for r in documents.match_documents(docs, max_goals=50)[1].collect()] == ["SCHEMA_CHANGED"]


def test_malformed_provider_rows_are_reported(spark):
    entry = lambda **x: {"match_id": 1, "home_team": {"home_team_id": 2}, "away_team": {"away_team_id": 3}, "home_score": 0, "away_score": 0, "match_date": "2024-01-01"} | x
    docs = spark.createDataFrame([("d", json.dumps([entry(), entry(match_id=None), entry(home_score=-1)])), ("e", "no json")], "doc_id string, body string")
    rows, rejected = documents.provider_matches(docs)
    assert rows.count() == 1
    assert sorted(tuple(r) for r in rejected.fillna(-1, "position").collect()) == [("d", 1, "KEY_MISSING"), ("d", 2, "INVALID_VALUE"), ("e", -1, "PARSE_FAILED")]


@pytest.mark.parametrize("sample, lines", [
    ('password = "p-" + secrets.token_urlsafe("x")', []),
    ('a\napi_key =\n"k-1234567"', [2]),
    ('secret = "changeme"\nsecret = "Zq81-real"', [2]),
    ("x\n\npwd = 'os.environ[a]'", []),
])
def test_secrets_over_whole_texts(spark, sample, lines):
    found = text.secret_lines("literal_credential_assignment", F.col("t"))
    assert spark.createDataFrame([(sample,)], "t string").select(found.alias("x")).first().x == lines


def test_prices_near_one_have_an_exponent(spark):
    odds = [F.lit(1 + 1e-9), F.lit(1.5), F.lit(1 + 1e-8)]
    q = [1 / x for x in (1 + 1e-9, 1.5, 1 + 1e-8)]
    k = spark.range(1).select(scores.power_exponent(odds).alias("k")).first().k
    assert sum(x**k for x in q) == pytest.approx(1, abs=1e-6)


def test_a_version_ends_with_the_first_of_all_later_ones(spark):
    rows = [(1, v, f"2024-01-0{day} 00:00:00", 2, v) for v, day in ((1, 1), (2, 4), (3, 2))]
    results = spark.createDataFrame(rows, "match_id int, version int, at string, home_goals int, away_goals int").select(
        "match_id", "version", F.col("at").cast("timestamp_ntz").alias("available_at"), F.lit("STRICT_PIT").alias("availability_mode"),
        F.lit("2023-12-31 00:00:00").cast("timestamp_ntz").alias("completed_at"), "home_goals", "away_goals")
    signed = forecast.signed_results(results, "STRICT_PIT")
    known = signed.filter(F.col("at") <= F.lit("2024-01-03 00:00:00").cast("timestamp_ntz")).agg(F.sum("sign").alias("n"), F.sum(F.col("sign") * F.col("away_goals")).alias("g")).first()
    assert (known.n, known.g) == (1, 3)
