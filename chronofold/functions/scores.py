"""Probability vectors, proper scores, odds arithmetic: plain Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLASSES = ("HOME", "DRAW", "AWAY")
LETTERS = ("home", "draw", "away")
GRID_TOP = 20  # largest goal count in a truncated score grid


def outcome(home: Column, away: Column) -> Column:
    return F.when(home > away, "HOME").when(home < away, "AWAY").otherwise("DRAW")


def hits(label: Column) -> list[Column]:
    return [F.when(label == c, 1.0).otherwise(0.0) for c in CLASSES]


def entropy(ps: list[Column]) -> Column:
    parts = [F.when(p > 0, -p * F.log(p)).otherwise(0.0) for p in ps]
    return parts[0] + parts[1] + parts[2]


def total_variation(a: list[Column], b: list[Column]) -> Column:
    return sum((F.abs(x - y) for x, y in zip(a, b)), F.lit(0.0)) / 2


def is_distribution(ps: list[Column], tolerance: float = 1e-12) -> Column:
    ok = F.abs(ps[0] + ps[1] + ps[2] - 1) <= tolerance
    for p in ps:
        ok = ok & p.isNotNull() & ~F.isnan(p) & p.between(0, 1)
    return F.coalesce(ok, F.lit(False))


def score_columns(ps: list[Column], label: Column) -> dict[str, Column]:
    """log_loss (null when the outcome had probability 0), rps, brier and parts, hit of the argmax."""
    y = hits(label)
    p_true = F.when(label == "HOME", ps[0]).when(label == "DRAW", ps[1]).otherwise(ps[2])
    parts = [(p - q) * (p - q) for p, q in zip(ps, y)]
    c1 = ps[0] - y[0]
    c2 = ps[0] + ps[1] - y[0] - y[1]
    first_best = (
        F.when((ps[0] >= ps[1]) & (ps[0] >= ps[2]), "HOME").when(ps[1] >= ps[2], "DRAW").otherwise("AWAY")
    )
    return {
        "log_loss": F.when(p_true > 0, -F.log(p_true)),
        "log_loss_infinite": p_true == 0,
        "rps": (c1 * c1 + c2 * c2) / 2,
        "brier": parts[0] + parts[1] + parts[2],
        "brier_home": parts[0],
        "brier_draw": parts[1],
        "brier_away": parts[2],
        "correct": (first_best == label).cast("double"),
    }


def implied(odds: Column) -> Column:
    """1/odds for a usable price, else null."""
    return F.when((odds > 1) & ~F.isnan(odds) & (odds < F.lit(float("inf"))), 1 / odds)


def proportional(odds: list[Column]) -> list[Column]:
    q = [implied(o) for o in odds]
    total = q[0] + q[1] + q[2]
    return [x / total for x in q]


def power_exponent(odds: list[Column], halvings: int = 120) -> Column:
    """k with sum(implied^k) = 1, by bisection.

    No bound is guessed: with q the largest implied price, three times q^k is at most 1 from
    k = ln 3 / -ln q on, and at k = 0 the sum is 3.
    """
    q = [implied(o) for o in odds]

    def mass(k: Column) -> Column:
        return F.pow(q[0], k) + F.pow(q[1], k) + F.pow(q[2], k)

    top = F.when(q[0].isNotNull() & q[1].isNotNull() & q[2].isNotNull(), F.log(F.lit(3.0)) / -F.log(F.greatest(*q)))
    start = F.struct(F.lit(0.0).alias("lo"), top.alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        above = mass(mid) > 1
        return F.struct(F.when(above, mid).otherwise(s["lo"]).alias("lo"), F.when(above, s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(halvings)), start, step, lambda s: (s["lo"] + s["hi"]) / 2)


def fair_price(p: Column) -> Column:
    return F.when(p > 0, 1 / p)


def clip_renormalise(raw: list[Column], fallback: list[Column]) -> list[Column]:
    cut = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) for x in raw]
    total = cut[0] + cut[1] + cut[2]
    return [F.when(total > 0, c / total).otherwise(f) for c, f in zip(cut, fallback)]


def wilson(p: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def tau(i: int, j: int, rate_home: Column, rate_away: Column, rho: Column) -> Column:
    """Low-score dependence factor for i:j, one of a table; 1 outside the four smallest scores."""
    factors = {(0, 0): -rate_home * rate_away, (0, 1): rate_home, (1, 0): rate_away, (1, 1): F.lit(-1.0)}
    return 1 + factors[i, j] * rho if (i, j) in factors else F.lit(1.0)


def goal_grid(rate_home: Column, rate_away: Column, rho: Column | None = None) -> Column:
    """Struct of outcome masses of a truncated independent Poisson grid, one loop over 0..20.

    The loop keeps both current point masses and both running sums, so no 21x21 grid is ever
    materialised; the low-score factor touches four cells and is added afterwards.
    """
    h0, a0 = F.exp(-rate_home), F.exp(-rate_away)
    start = F.struct(
        h0.alias("h"), a0.alias("a"), h0.alias("sh"), a0.alias("sa"),
        F.lit(0.0).alias("home"), (h0 * a0).alias("draw"), F.lit(0.0).alias("away"),
    )

    def step(s: Column, i: Column) -> Column:
        h, a = s["h"] * rate_home / i, s["a"] * rate_away / i
        return F.struct(
            h.alias("h"), a.alias("a"), (s["sh"] + h).alias("sh"), (s["sa"] + a).alias("sa"),
            (s["home"] + h * s["sa"]).alias("home"),
            (s["draw"] + h * a).alias("draw"),
            (s["away"] + a * s["sh"]).alias("away"),
        )

    looped = F.aggregate(F.sequence(F.lit(1), F.lit(GRID_TOP)), start, step)
    h1, a1 = h0 * rate_home, a0 * rate_away
    h2, a2 = h1 * rate_home / 2, a1 * rate_away / 2
    cell = {(0, 0): h0 * a0, (0, 1): h0 * a1, (1, 0): h1 * a0, (1, 1): h1 * a1}
    shift = {k: F.lit(0.0) for k in cell}
    if rho is not None:
        shift = {k: v * (tau(*k, rate_home, rate_away, rho) - 1) for k, v in cell.items()}
    under = cell[0, 0] + cell[0, 1] + cell[1, 0] + cell[1, 1] + h0 * a2 + h2 * a0
    return F.struct(
        (looped["home"] + shift[1, 0]).alias("home"),
        (looped["draw"] + shift[0, 0] + shift[1, 1]).alias("draw"),
        (looped["away"] + shift[0, 1]).alias("away"),
        (looped["sh"] * looped["sa"] + sum(shift.values(), F.lit(0.0))).alias("mass"),
        (under + sum(shift.values(), F.lit(0.0))).alias("under_2_5"),
    )
