"""Runs from stitched tiles against a plain search over all periods."""

import hashlib
import random

import pytest

from chronofold.llm import periodic
from chronofold.llm.queries import planted_run
from common import ODD, WORD, odd_rows


def plain_runs(words):
    """Every maximal stretch with its smallest period, by trying all periods."""
    found = {}
    n = len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def texts(seed):
    rng = random.Random(seed)
    out = ["a " * 500, "a " * 23, "a " * 24, "x " + "a b " * 40 + "c", "a b c a b c a b", ("a " * 10 + "b ") * 30, ""]
    fib = ["a", "a b"]
    while len(fib) < 14:
        fib.append(f"{fib[-1]} {fib[-2]}")
    out.append(fib[-1])
    for _ in range(60):
        base = [rng.choice("ab" if rng.random() < 0.4 else "abcdefgh") for _ in range(rng.randrange(1, 400))]
        for _ in range(rng.randrange(4)):
            at, p = rng.randrange(len(base)), rng.randrange(1, 120)
            stretch = [base[(at + k) % len(base)] for k in range(p)]
            base[at:at] = (stretch * rng.randrange(2, 9))[: rng.randrange(1, 900)]
        out.append("\n ".join(base))
    return out


@pytest.mark.parametrize("tile", [64, 500, periodic.TILE])
def test_against_all_periods(spark, tile):
    rows = list(enumerate(texts(tile)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = {r["doc_id"]: r for r in periodic.runs(df, tile=tile).collect()}
    assert len(found) == len(rows)
    for key, text in rows:
        words = WORD.findall(text)
        expected = periodic.summary(words, plain_runs(words))
        assert tuple(found[key])[1:] == expected, (key, plain_runs(words))


def test_summary():
    words = ["x"] + ["a", "b"] * 12 + ["y"]
    got = periodic.summary(words, [(1, 24, 2)])
    assert got == (1, 1, 24, 2, 12000, hashlib.sha256(b"1,24,2\n").hexdigest(), hashlib.sha256(b"x a b y").hexdigest())
    assert periodic.summary([], [])[:5] == (0, None, None, None, None)


def test_planted_run():
    words = [str(i) for i in range(97)]
    keys = [k for k in range(300) if planted_run(k, words) != words]
    assert 15 < len(keys) < 45
    runs = [plain_runs(planted_run(k, words)) for k in keys]
    assert sum(len(r) > 0 for r in runs) > len(keys) // 2


def test_odd_rows(spark):
    rows = odd_rows(spark)
    found = periodic.runs(rows).collect()
    plain = [(r["doc_id"], *periodic.summary(w := WORD.findall(r["text"] or ""), plain_runs(w[:3000]) if len(set(w)) > 1 and len(w) < 3000 else plain_long(w))) for r in rows.collect()]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, plain))
    assert len(found) == len(ODD) + 3
    assert periodic.runs(rows.filter("false")).count() == 0


def plain_long(words):
    """Of a text that repeats its first words throughout, or has no run."""
    n = len(words)
    q = next((q for q in range(1, n // 3 + 1) if q < 50 and words[q:] == words[:-q]), 0)
    return [(0, n, q)] if q and n >= max(24, 3 * q) else []
