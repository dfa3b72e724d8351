"""Last results and evidence selection, kept as states over time, against looking at every row."""

import random
from datetime import datetime, timedelta

import pytest

from chronofold.operators import evidence, features

START = datetime(2023, 1, 1)
RESULTS = "match_id bigint, competition_id string, home_id int, away_id int, kickoff_at timestamp_ntz, completed_at timestamp_ntz, available_at timestamp_ntz, availability_mode string, home_goals int, away_goals int, version bigint"


def results(rng, n):
    """Matches of a few teams, published in time, within their day, or up to a year late, some corrected more than once."""
    rows = []
    for i in range(n):
        kickoff = START + timedelta(hours=7 * i + rng.randrange(3))
        done = kickoff + timedelta(hours=2)
        known = done + rng.choice([timedelta(minutes=1), timedelta(hours=5), timedelta(days=3), timedelta(days=rng.randrange(365))])
        row = (i, "c", rng.randrange(4), 4 + rng.randrange(3), kickoff, done)
        rows.append((*row, known if i % 17 else None, "STRICT_PIT", rng.randrange(4), rng.randrange(4), 1))
        for version in range(2, 2 + rng.choice([0, 0, 1, 2])):
            known += rng.choice([timedelta(minutes=3), timedelta(days=40)])
            rows.append((*row, known, "STRICT_PIT", rng.randrange(4), rng.randrange(4), version))
    return rows


@pytest.mark.parametrize("versions", [False, True])
def test_last_results_equal_a_look_at_all(spark, versions):
    rows = [r for r in results(random.Random(5), 260) if versions or r[-1] == 1]
    df = spark.createDataFrame(rows, RESULTS)
    targets = df.filter("version = 1").drop("version")
    got = {}
    for r in features.last_results(targets, df if versions else df.drop("version"), "RECONSTRUCTED_PIT").collect():
        got.setdefault((r["target_id"], r["team"]), set()).add((r["match_id"], r["gf"], r["ga"]))
    known = {}
    for r in rows:
        known.setdefault(r[0], []).append(r)
    for t in (r for r in rows if r[-1] == 1):
        for team in (t[2], t[3]):
            usable = []
            for chain in known.values():
                current = [r for r in chain if r[6] is not None and r[6] <= t[4]]
                if current and current[-1][5] < t[4] and team in current[-1][2:4]:
                    r = current[-1]
                    usable.append((r[5], r[0], *(r[8:10] if team == r[2] else r[9:7:-1])))
            expected = {u[1:] for u in sorted(usable)[-5:]}
            assert got.get((t[0], team), set()) == expected, (t, team)


def test_a_tree_of_days_covers_exactly(spark):
    rng = random.Random(2)
    spans = [(a, a + rng.choice([0, 1, 2, 5, 63, 64, 65, 1000, 40000])) for a in (rng.randrange(20000) for _ in range(200))]
    df = spark.createDataFrame(spans, "a int, b int")
    for r in df.select("a", "b", features._cover(df.a, df.b).alias("nodes")).collect():
        days = sorted(d for n in r["nodes"] for d in range(n["place"] * features.FAN ** n["level"], (n["place"] + 1) * features.FAN ** n["level"]))
        assert days == list(range(r["a"], r["b"]))
        assert len(r["nodes"]) <= 2 * (features.FAN - 1) * features.LEVELS


def plain_select(request, versions, replaced, edges):
    """Status, number current and number rejected of one request, from all rows."""
    _, entity, predicate, source, at, boundary = request
    strict = boundary == "STRICTLY_BEFORE"
    permits = lambda c: c is not None and (c < at or (not strict and c == at))
    mine = [v for v in versions if v["entity"] == entity and v["predicate"] == predicate and source in (None, v["source"])]
    active = [v for v in mine if permits(v["available_at"]) and not permits(replaced.get(v["version_id"]))]
    current = [v for v in active if v["expires_at"] is None or at < v["expires_at"]]
    ids = {v["version_id"] for v in current}
    clash = len({(v["value"], v["claim_kind"]) for v in current}) > 1 or any(left in ids and right in ids and permits(known) for left, right, known in edges)
    status = ("STALE" if active else "MISSING") if not current else "CONFLICTING" if clash else next((s for s in ("SUSPICIOUS", "UNKNOWN") if s in {v["status"] for v in current}), "KNOWN")
    flags = [any(v["available_at"] is not None and v["available_at"] > at for v in mine), strict and any(v["available_at"] == at for v in mine),
             any(permits(replaced.get(v["version_id"])) for v in mine), len(active) > len(current)]
    return status, flags, len(current), len(mine) - len(current)


def test_selection_equals_a_look_at_all(spark):
    rng = random.Random(9)
    minute = lambda n: START + timedelta(minutes=n)
    versions = [{"version_id": i, "source": rng.choice("ab"), "entity": rng.randrange(3), "predicate": "p", "value": rng.choice("xxxy"), "value_type": "s", "claim_kind": "FACT",
                 "available_at": None if rng.random() < 0.05 else minute(rng.randrange(60)), "expires_at": minute(rng.randrange(80)) if rng.random() < 0.4 else None,
                 "status": rng.choice(["VALID", "VALID", "SUSPICIOUS", "UNKNOWN"])} for i in range(120)]
    links, used = [], set()
    for i in range(0, 100, 3):
        later = [v for v in versions if v["entity"] == versions[i]["entity"] and v["source"] == versions[i]["source"] and v["version_id"] > i and v["version_id"] not in used]
        if later:
            links.append((i, later[0]["version_id"]))
            used.add(later[0]["version_id"])
    replaced = {a: versions[b]["available_at"] for a, b in links}
    edges = [(a, b, minute(rng.randrange(60))) for a in range(0, 110, 7) for b in (a + 1, a + 5) if versions[a]["entity"] == versions[b]["entity"]]
    requests = [(i, rng.randrange(4), "p", rng.choice([None, "a", "b"]), minute(rng.randrange(-3, 90)), rng.choice(["STRICTLY_BEFORE", "AT_OR_BEFORE"])) for i in range(300)]
    rows = [tuple(v[c] for c in ("version_id", "source", "entity", "predicate", "value", "value_type", "claim_kind", "available_at", "expires_at", "status")) for v in versions]
    frame = spark.createDataFrame(rows, "version_id int, source string, entity int, predicate string, value string, value_type string, claim_kind string, available_at timestamp_ntz, expires_at timestamp_ntz, status string")
    out = evidence.select(
        spark.createDataFrame(requests, "request_id int, entity int, predicate string, source string, at timestamp_ntz, boundary string"), frame,
        spark.createDataFrame(links, "previous_id int, replacement_id int"), spark.createDataFrame(edges, "left_id int, right_id int, available_at timestamp_ntz"),
    ).collect()
    names = ["FUTURE_INFORMATION_REJECTED", "EXACT_TARGET_AVAILABILITY_REJECTED", "SUPERSEDED_VERSIONS_RETAINED_FOR_REPLAY", "EVIDENCE_EXPIRED"]
    assert len(out) == len(requests) and len({r["status"] for r in out}) >= 5
    for r in out:
        expected = plain_select(requests[r["request_id"]], versions, replaced, edges)
        assert (r["status"], [n in r["reasons"].split(",") for n in names], r["n_current"], r["n_rejected"]) == expected, requests[r["request_id"]]
