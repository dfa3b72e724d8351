"""Exact k-means on integer vectors with heap-ordered bounds.

Every vector has an upper bound (to its own centroid) and a lower bound (to all others). Centroids
move by at most their drift, so a vector of cluster c can only change when its gap, lower - upper, is
used up by what has since been added to c's offset: c's own drift plus the largest drift of the rest.
A vector is entered under the key `gap + offset of c at entry`; keys never change, and those at or
below c's offset now are exactly the ones to be popped and measured against all centroids again.

A cluster's heap is kept as sorted arrays in files (a sorted array is a heap). Tasks write what they
measured as a run sorted by (cluster, key); popping reads the front of each cluster's part, as the
filter on (cluster, key) prunes row groups and pages; what was popped is entered again by appending
a run. As offsets only grow, an entry is live while its key is above its cluster's offset, so nothing
is ever deleted, and each vector has one live entry. Sums move by popped vectors that changed cluster
only. The driver sees the starting vectors and the sums of the clusters, both k rows.

All decisions are on integers: bounds are floats with a slack that covers their rounding, so a
vector that is not popped has its own centroid strictly nearest. Ties go to the smaller number.

Cases: vectors that are null, of another size, with null or non-finite components, or with one
beyond 2^20 after scaling (whose distances would not fit the sums) are left out; fewer vectors than
centroids start fewer; rows that repeat count each; a null id starts no centroid but is assigned; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import store

CLUSTERS, ROUNDS, SIZE, SCALE = 16, 3, 64, 64
LARGEST = 1 << 20  # of a scaled component: squared distances of 64 components stay below 2^48
SLACK = 1e-6  # relative, far above the rounding of a square root
RUN_BYTES = 8 << 20  # of a row group: what popping reads at least


def scaled(vectors: DataFrame, size: int = SIZE, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, vec): components as floor(SCALE * x)."""
    components = F.transform(F.col(column).cast("array<double>"), lambda x: F.lit(float(SCALE)) * x)
    fit = F.forall(components, lambda x: F.coalesce((x >= -LARGEST) & (x < LARGEST) & ~F.isnan(x), F.lit(False)))
    return vectors.filter((F.size(column) == size) & fit).select(
        F.col(key).alias("vec_id"), F.transform(components, lambda x: F.floor(x).cast("int")).alias("vec")
    )


def starts(vectors: DataFrame, clusters: int, size: int) -> np.ndarray:
    """The vectors whose ids have the smallest digests."""
    digest = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select("vec", digest.alias("digest")).filter("digest is not null").orderBy("digest", "vec").limit(clusters).collect()
    return np.array([r["vec"] for r in rows], np.int64).reshape(len(rows), size)


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, exact: all sums stay below 2^53."""
    x, c = vectors.astype(np.float64), centroids.astype(np.float64)
    return np.rint((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _batches(batches: Iterator[pa.RecordBatch], rows: int = 8192) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


@dataclass
class Heaps:
    """The clusters' heaps: runs of entries, and each cluster's offset, now and at the last popping."""

    centroids: np.ndarray
    offsets: np.ndarray
    before: np.ndarray
    runs: list[DataFrame] = field(default_factory=list)

    def expired(self, run: int) -> Column:
        """Entries that the latest drift reaches; older drift has popped those below it already."""
        newest = run == len(self.runs) - 1
        ranges = []
        for c in range(len(self.centroids)):
            old = F.lit(True) if newest else F.col("gap") > float(self.before[c])
            ranges.append((F.col("cluster") == c) & old & (F.col("gap") <= float(self.offsets[c])))
        return reduce(Column.__or__, ranges)

    def popped(self) -> DataFrame:
        return reduce(DataFrame.union, [run.filter(self.expired(i)) for i, run in enumerate(self.runs)])

    def live(self) -> DataFrame:
        kept = [(F.col("cluster") == c) & (F.col("gap") > float(self.offsets[c])) for c in range(len(self.centroids))]
        return reduce(DataFrame.union, [run.filter(reduce(Column.__or__, kept)) for run in self.runs])

    def measured(self, rows: DataFrame) -> DataFrame:
        """Rows (vec_id, vec, was) against all centroids: their nearest and the key to enter them under."""
        centroids, offsets = self.centroids, self.offsets

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _batches(batches):
                found = distances(_matrix(batch.column(1)), centroids)
                cluster = found.argmin(1)  # the first of equal ones
                at = np.arange(len(found))
                upper = np.sqrt(found[at, cluster])
                found[at, cluster] = np.iinfo(np.int64).max
                lower = np.sqrt(found.min(1)) if len(centroids) > 1 else np.full(len(found), np.inf)
                gap = lower - upper - SLACK * (np.where(np.isinf(lower), 0, lower) + upper + 1) + offsets[cluster]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster.astype(np.int32)), pa.array(gap)], names=[*batch.schema.names, "cluster", "gap"])

        kind = rows.schema["vec_id"].dataType.simpleString()
        return rows.mapInArrow(run, f"vec_id {kind}, vec array<int>, was int, cluster int, gap double")

    def enter(self, rows: DataFrame, last: bool = False) -> DataFrame:
        """Measures rows and appends them as a run sorted by cluster and key; the last ones stay live."""
        entered = self.measured(rows)
        entered = entered.withColumn("gap", F.lit(float("inf"))) if last else entered.sortWithinPartitions("cluster", "gap")
        run = store(entered, "heap-run", **{"parquet.block.size": str(RUN_BYTES)})
        self.runs.append(run)
        return run

    def move(self, centroids: np.ndarray) -> None:
        """New centroids: offsets grow by each one's drift and the largest of the others'."""
        moved = np.sqrt(((centroids - self.centroids) ** 2).sum(1).astype(np.float64)) * (1 + SLACK)
        others = np.array([np.delete(moved, c).max(initial=0.0) for c in range(len(moved))])
        self.before, self.offsets, self.centroids = self.offsets, self.offsets + moved + others, centroids


def _moved_sums(run: DataFrame, size: int, clusters: int) -> np.ndarray:
    """(clusters, size + 1): what entering the run adds to each cluster's component sums and count."""
    left = F.struct(F.col("was").alias("cluster"), F.lit(-1).alias("sign"))
    joined = F.struct("cluster", F.lit(1).alias("sign"))
    changed = run.filter(~F.col("was").eqNullSafe(F.col("cluster"))).select("vec", F.explode(F.array(left, joined)).alias("to")).filter("to.cluster is not null")
    totals = changed.groupBy("to.cluster").agg(
        *[F.sum(F.get("vec", F.lit(i)) * F.col("to.sign")).alias(f"s{i}") for i in range(size)], F.sum("to.sign").alias("n")
    )
    out = np.zeros((clusters, size + 1), np.int64)
    for row in totals.collect():
        out[row["cluster"]] = row[1:]
    return out


def fit(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE) -> Heaps:
    """Rounds of assignment and floor means, then one more assignment; `vectors` are (vec_id, vec)."""
    first = starts(vectors, clusters, size)
    k = len(first)
    heaps = Heaps(first, np.zeros(k), np.zeros(k))
    if not k:
        return heaps
    sums = np.zeros((k, size + 1), np.int64)
    rows = vectors.withColumn("was", F.lit(None).cast("int"))
    for _ in range(rounds):
        sums += _moved_sums(heaps.enter(rows), size, k)
        filled = sums[:, -1] > 0
        means = heaps.centroids.copy()
        means[filled] = sums[filled, :-1] // sums[filled, -1:]
        heaps.move(means)
        rows = heaps.popped().select("vec_id", "vec", F.col("cluster").alias("was"))
    heaps.enter(rows, last=True)
    return heaps


def assign(heaps: Heaps) -> DataFrame:
    """(vec_id, cluster, distance) of every live entry."""
    centroids = heaps.centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            cluster = batch.column(2).to_numpy(zero_copy_only=False)
            apart = _matrix(batch.column(1)).astype(np.int64) - centroids[cluster]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array((apart * apart).sum(1))], names=["vec_id", "cluster", "distance"])

    rows = heaps.live()
    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", "vec", "cluster").mapInArrow(run, f"vec_id {kind}, cluster int, distance bigint")


def clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector."""
    rows = scaled(vectors, size, key, column)
    heaps = fit(rows, k, rounds, size)
    if not heaps.runs:
        kind = rows.schema["vec_id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame(
            [], f"{key} {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
        )
    found = assign(heaps)
    sums = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    own = [(sums.get(c, 0), hashlib.sha256(",".join(map(str, v.tolist())).encode()).hexdigest()) for c, v in enumerate(heaps.centroids)]

    def of_cluster(place: int, kind: str) -> Column:
        return F.get(F.array(*[F.lit(o[place]).cast(kind) for o in own]), F.col("cluster"))

    return found.select(
        F.col("vec_id").alias(key), "cluster", "distance", of_cluster(0, "bigint").alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("bigint").alias("inertia"), of_cluster(1, "string").alias("centroid_sha256"),
    )
