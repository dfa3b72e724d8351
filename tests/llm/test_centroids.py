"""Heap-ordered k-means against plain rounds over all distances."""

import hashlib
import math

import numpy as np
import pytest

from chronofold.llm import centroids


def plain(rows, k, rounds, size):
    """[(vec_id, cluster, distance)] and the centroids, every distance measured in every round."""
    kept = [(key, [math.floor(64 * float(x)) for x in v]) for key, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"1:{key}".encode()).hexdigest(), v) for key, v in kept if key is not None)[:k]
    middle = [v for _, v in order]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), at) for at, c in enumerate(middle))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for c in range(len(middle)):
            members = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
            if members:
                middle[c] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    return sorted(((key, *nearest(v)[::-1]) for key, v in kept), key=str), middle


def found(spark, rows, k, rounds, size):
    df = spark.createDataFrame([(key, v, 1, "x", 0.5) for key, v in rows], "vec_id bigint, embedding array<float>, cluster int, vec string, gap double")
    out = centroids.clusters(df.repartition(3), k, rounds, size).collect()
    assert all(r["inertia"] == sum(x["distance"] for x in out) for r in out)
    assert all(r["cluster_inertia"] == sum(x["distance"] for x in out if x["cluster"] == r["cluster"]) for r in out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_rounds(spark, seed):
    random = np.random.default_rng(seed)
    middles = random.normal(0, 1, (6, 5))
    rows = [(i, [float(np.float32(x)) for x in middles[i % 6] + random.normal(0, 0.4, 5)]) for i in range(400)]
    rows += [(1000 + i, [0.25] * 5) for i in range(200)]  # equal vectors, a third of all
    rows += [(0, rows[0][1]), (None, rows[3][1]), (-1, None), (-2, [1.0] * 4), (-3, [1.0, None, 0.0, 0.0, 0.0]), (-4, [math.nan] * 5), (-5, [math.inf] + [0.0] * 4)]
    expected, middle = plain(rows, 7, 3, 5)
    out = found(spark, rows, 7, 3, 5)
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in out), key=str) == expected
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    assert all(r["centroid_sha256"] == digests[r["cluster"]] for r in out)


def test_ties_take_the_smaller_number(spark):
    rows = [(i, [float(i % 3 - 1) / 64, 0.0]) for i in range(60)]
    expected, _ = plain(rows, 4, 3, 2)
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in found(spark, rows, 4, 3, 2)), key=str) == expected


def test_small_and_empty_tables(spark):
    assert found(spark, [(1, [None, 1.0])], 4, 3, 2) == []
    (one,) = found(spark, [(7, [1.0, -0.5])], 4, 3, 2)
    assert (one["vec_id"], one["cluster"], one["distance"]) == (7, 0, 0)


def test_only_expired_entries_are_measured_again(spark):
    random = np.random.default_rng(5)
    middles = 20 * random.normal(0, 1, (8, 6))
    rows = [(i, [float(x) for x in middles[i % 8] + random.normal(0, 0.05, 6)]) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    heaps = centroids.fit(centroids.scaled(df, 6), 8, 3, 6)
    counts = [run.count() for run in heaps.runs]
    assert counts[0] == 2000 and heaps.live().count() == 2000
    assert counts[2] < 1200 and counts[3] < 600, counts
