"""Known answers of the column functions."""

import math
import uuid

import pytest
from pyspark.sql import functions as F

from chronofold.functions import ids, scores, text


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_uniform_forecast_scores(spark):
    ps = [F.lit(1.0) / 3] * 3
    got = one(spark, **{k: v for k, v in scores.score_columns(ps, F.lit("HOME")).items()})
    assert got.log_loss == pytest.approx(math.log(3))
    assert got.rps == pytest.approx(5 / 18)
    assert got.brier == pytest.approx(2 / 3)
    assert got.correct == 1.0


def test_zero_probability_is_flagged_not_infinite(spark):
    got = one(spark, **scores.score_columns([F.lit(0.0), F.lit(0.5), F.lit(0.5)], F.lit("HOME")))
    assert got.log_loss is None and got.log_loss_infinite


def test_proportional_and_power_demargin(spark):
    odds = [F.lit(2.0), F.lit(3.0), F.lit(4.0)]
    fair = one(spark, **{f"p{i}": p for i, p in enumerate(scores.proportional(odds))})
    assert [fair.p0, fair.p1, fair.p2] == pytest.approx([6 / 13, 4 / 13, 3 / 13])
    k = one(spark, k=scores.power_exponent(odds)).k
    assert sum((1 / o) ** k for o in (2, 3, 4)) == pytest.approx(1, abs=1e-12)


def test_goal_grid_matches_explicit_grid(spark):
    lh, la, rho = 1.7, 0.9, 0.08
    def pmf(rate):
        out = [math.exp(-rate)]
        for i in range(1, 21):
            out.append(out[-1] * rate / i)
        return out
    h, a = pmf(lh), pmf(la)
    factor = {(0, 0): 1 - lh * la * rho, (0, 1): 1 + lh * rho, (1, 0): 1 + la * rho, (1, 1): 1 - rho}
    grid = {(i, j): h[i] * a[j] * factor.get((i, j), 1.0) for i in range(21) for j in range(21)}
    got = spark.range(1).select(scores.goal_grid(F.lit(lh), F.lit(la), F.lit(rho)).alias("g")).select("g.*").first()
    assert got.home == pytest.approx(sum(v for (i, j), v in grid.items() if i > j), abs=1e-14)
    assert got.draw == pytest.approx(sum(v for (i, j), v in grid.items() if i == j), abs=1e-14)
    assert got.away == pytest.approx(sum(v for (i, j), v in grid.items() if i < j), abs=1e-14)
    assert got.mass == pytest.approx(sum(grid.values()), abs=1e-14)
    assert got.under_2_5 == pytest.approx(sum(v for (i, j), v in grid.items() if i + j <= 2), abs=1e-14)


def test_uuid5_equals_the_standard_library(spark):
    got = spark.createDataFrame([("Málaga",), ("x" * 80,)], "k string").select("k", ids.entity_id("team", F.col("k")).alias("u")).collect()
    for row in got:
        assert row.u == str(uuid.uuid5(uuid.UUID(ids.NAMESPACE), f'["team","{row.k}"]'))


def test_name_normalisation_folds_width_case_and_space(spark):
    rows = spark.createDataFrame([("  Ｆull  Width ",), ("STRASSE",), ("straße",), ("A\tB",)], "n string")
    got = {r.n: r.normal_name for r in ids.with_normal_name(rows, "n").collect()}
    assert got == {"  Ｆull  Width ": "full width", "STRASSE": "strasse", "straße": "strasse", "A\tB": "a b"}


@pytest.mark.parametrize("url,ok", [
    ("https://example.org/a", True), ("https://example.org:443/a", True), ("https://8.8.8.8/", True), ("https://example.org/?", True),
    ("http://example.org/a", False), ("https://u:p@example.org/", False), ("https://example.org/?q=1", False), ("https://example.org/#f", False),
    ("https://example.org:8443/", False), ("https://localhost/", False), ("https://printer.local/", False), ("https://intranet/", False),
    ("https://10.0.0.1/", False), ("https://172.20.1.1/", False), ("https://169.254.1.1/", False), ("https://exa mple.org/", False), (None, False)])
def test_public_url(spark, url, ok):
    assert spark.createDataFrame([(url,)], "u string").select(text.public_url(F.col("u")).alias("x")).first().x is ok


def test_offset_is_required(spark):
    rows = spark.createDataFrame([("2024-01-01T02:00:00+02:00",), ("2024-01-01T00:00:00",), ("nope",)], "s string")
    got = [r.t for r in rows.select(text.offset_timestamp(F.col("s")).cast("string").alias("t")).collect()]
    assert got == ["2024-01-01 00:00:00", None, None]


def test_secret_rules_report_rules_and_skip_placeholders(spark):
    rows = spark.createDataFrame([("pwd=changeme;",), ("Password=Zx81kQpL77;",), ('api_key = "k9f8a7s6d5f4"',), ('api_key = "fake-value"',)], "t string")
    hit = F.array_compact(F.array(*[F.when(text.secret_hit(k, F.col("t")), F.lit(k)) for k in text.SECRET_RULES]))
    assert [r.h for r in rows.select(hit.alias("h")).collect()] == [[], ["credential_connection_string"], ["literal_credential_assignment"], []]
