"""Scores of forecasts, their summaries, calibration and block bootstrap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..session import cut_lineage

PROBS = ("p_home", "p_draw", "p_away")


def score(forecasts: DataFrame, labels: DataFrame | None = None, on: str = "match_id") -> DataFrame:
    """Forecast rows with a label and every score; labels join only after forecasts exist."""
    joined = forecasts if labels is None else forecasts.join(labels.select(on, "outcome"), on)
    return joined.withColumns(scores.score_columns([F.col(p) for p in PROBS], F.col("outcome")))


def metric_summary(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Means per group; the mean log loss is null as soon as one loss is infinite."""
    infinite = F.max(F.col("log_loss_infinite").cast("int")) == 1
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("matches"),
        F.when(~infinite, F.avg("log_loss")).alias("log_loss"),
        infinite.alias("log_loss_infinite"),
        *[F.avg(c).alias(c) for c in ("rps", "brier", "brier_home", "brier_draw", "brier_away")],
        F.avg("correct").alias("accuracy"),
    )


def calibration(scored: DataFrame, by: Sequence[str], bins: int) -> DataFrame:
    """Every (group, class, bucket), empty ones kept with null means.

    Members fold into at most `bins` x 3 rows per group before the spine is attached, so the
    spine join is over the aggregate and not over forecasts.
    """
    label = F.col("outcome")
    per_class = F.array(*[
        F.struct(F.lit(c).alias("class"), F.col(p).alias("p"), F.when(label == c, 1.0).otherwise(0.0).alias("y"))
        for c, p in zip(scores.CLASSES, PROBS)
    ])
    members = scored.select(*by, F.explode(per_class).alias("_m")).select(*by, "_m.*")
    bucket = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("bigint")
    folded = members.groupBy(*by, "class", bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_probability"), F.avg("y").alias("observed_frequency")
    )
    spine = folded.groupBy(*by).agg(F.lit(1).alias("_")).select(
        *by, F.explode(F.array(*[F.lit(c) for c in scores.CLASSES])).alias("class")
    ).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bucket"))
    return spine.join(folded, [*by, "class", "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def expected_calibration_error(calibrated: DataFrame, by: Sequence[str]) -> DataFrame:
    gap = F.col("n") * F.abs(F.col("mean_probability") - F.col("observed_frequency"))
    return calibrated.groupBy(*by, "class").agg((F.sum(gap) / F.sum("n")).alias("ece"))


def paired_difference(scored: DataFrame, by: Sequence[str], benchmark: str, block: Column) -> DataFrame:
    """Per (group, model, block): summed log-loss difference to the benchmark, and its count.

    The benchmark's loss reaches its siblings through a grouped aggregate over one target's few
    model rows instead of a self-join of all scores.
    """
    losses = F.map_from_entries(F.collect_list(F.struct("model_id", "log_loss")))
    per_target = scored.filter(F.col("log_loss").isNotNull()).groupBy(*by, "match_id", block.alias("block")).agg(losses.alias("_l"))
    rows = per_target.select(*by, "block", F.explode("_l").alias("model_id", "log_loss"), F.col("_l")[benchmark].alias("_b"))
    return rows.groupBy(*by, "model_id", "block").agg(
        F.sum(F.col("log_loss") - F.col("_b")).alias("diff"), F.count(F.lit(1)).alias("n")
    )


# Constants of the arithmetic block picker (any fixed primes do).
PICK = (7919, 104729, 15485863, 2147483647)


def pick_block(draw: Column, slot: Column, blocks: Column) -> Column:
    """Reproducible pseudo-random block position in 0..blocks-1, same integers in any engine."""
    a, b, c, m = (F.lit(x).cast("bigint") for x in PICK)
    mixed = (draw * a + slot * b + c) % m
    mixed = (mixed * F.lit(48271).cast("bigint")) % m
    mixed = (mixed * F.lit(69621).cast("bigint")) % m
    return mixed % blocks


def block_bootstrap(blocks: DataFrame, by: Sequence[str], draws: int = 400) -> DataFrame:
    """Percentile interval of the pooled mean difference over resampled blocks.

    Input is already one row per (group, model, block); a draw only re-weights those rows.
    """
    by = list(by)
    blocks = cut_lineage(blocks)  # read three times, and far fewer than the scores they are made of
    names = blocks.select(*by, "block").distinct()
    order = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    placed = names.withColumn("slot", F.row_number().over(order.orderBy("block")).cast("bigint") - 1).withColumn(
        "_blocks", F.count(F.lit(1)).over(order)
    )
    drawn = placed.select(*by, F.col("slot").alias("_s"), "_blocks", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    times = drawn.groupBy(*by, "draw", pick_block(F.col("draw").cast("bigint"), F.col("_s"), F.col("_blocks")).alias("slot")).agg(
        F.count(F.lit(1)).alias("times")
    )
    weighted = times.join(placed.select(*by, "block", "slot"), [*by, "slot"]).join(blocks, [*by, "block"])
    means = weighted.groupBy(*by, "model_id", "draw").agg((F.sum(F.col("times") * F.col("diff")) / F.sum(F.col("times") * F.col("n"))).alias("_mean"))
    lo, hi = int(draws * 0.025), int(draws * 0.975) - 1
    sorted_means = F.sort_array(F.collect_list("_mean"))  # exactly `draws` values
    interval = means.groupBy(*by, "model_id").agg(sorted_means[lo].alias("ci_low"), sorted_means[hi].alias("ci_high"))
    overall = blocks.groupBy(*by, "model_id").agg((F.sum("diff") / F.sum("n")).alias("mean_difference"))
    return overall.join(interval, [*by, "model_id"])


LIMBS = ("_l0", "_l1", "_l2", "_l3")


def row_digest(parts: Sequence[Column]) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def limbs(digest: Column) -> list[Column]:
    """Four integers of 48 bits of a row's digest."""
    return [F.conv(F.substring(digest, 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)") for i in range(len(LIMBS))]


def folded_digest(n: Column, sums: Sequence[Column]) -> Column:
    return F.sha2(F.concat_ws(":", n.cast("string"), *[x.cast("string") for x in sums]), 256)


def set_digest(rows: DataFrame, by: Sequence[str], parts: Sequence[Column]) -> DataFrame:
    """Order-free digest of a multiset of rows per group.

    Row digests are summed limb by limb, which is associative: Spark folds it map-side and no
    group, however large, is ever collected into a list.
    """
    by = list(by)
    folded = rows.select(*by, row_digest(parts).alias("_d")).groupBy(*by).agg(
        *[F.sum(limb).alias(c) for c, limb in zip(LIMBS, limbs(F.col("_d")))], F.count(F.lit(1)).alias("n_rows")
    )
    return folded.select(*by, folded_digest(F.col("n_rows"), [F.col(c) for c in LIMBS]).alias("digest"), "n_rows")
