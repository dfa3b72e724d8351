"""Periodic runs of words, by tiles per octave of periods.

A run is a stretch of words with smallest period q, at least max(least, times * q) long, that no
neighbouring word extends. Position t matches under q where words t and t + q are equal, so a run is a
stretch of matches, and those are found piece by piece:

* Explode. Periods are dealt into octaves: below 16, then [S, 2S) for S = 16, 32, ... A text up to
  TILE words is one tile for all its octaves; a longer one becomes overlapping tiles of TILE words for
  the small octaves and of 16 S words for each larger one, which are dealt out over all tasks.
* Solve. In a tile, boundaries lie S words apart (8 for the first octave). A run has at least 2 S
  matches in a row, so at least one block of S words between boundaries recurs q words on; fingerprints
  of all windows of S words tell where a block may recur. There the Z-function of the words from the
  boundary on, and the one of the reversed words before it, say exactly how far each period reaches, up
  to S words beyond the block. If a prefix shows that the stretch has a smaller period it goes, and
  blocks inside a stretch of a smaller octave aren't looked at again.
* Stitch. The fragments, intervals of matches, are shuffled by text and period, and those that touch
  are joined; only then lengths are judged.

Only texts with fragments go on to be joined with their runs. Fingerprints of windows may only propose a
block; equality is decided on word numbers. `solve` takes work and memory in proportion to
its tile, times octaves.

Cases: a null text and one without words have no run; rows that repeat or share a key are each their
own text; a null key is passed through (and plants nothing); a very long text is spread over tasks by
tiles, one row of it is held where its words are split; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytekit import mixed
from .shared import store

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LEAST, TIMES = 24, 3
FIRST = 8  # words between boundaries in the first octave, which has the periods below 2 * FIRST
TILE = 1 << 14
BATCH_WORDS = 1 << 17

U64 = np.uint64
Fragment = tuple[int, int, int]  # period, first match, end of matches


@lru_cache(maxsize=1 << 16)
def prime_factors(n: int) -> tuple[int, ...]:
    found, d = [], 2
    while d * d <= n:
        if n % d == 0:
            found.append(d)
            while n % d == 0:
                n //= d
        d += 1
    return (*found, n) if n > 1 else tuple(found)


def z_function(a: list[int]) -> list[int]:
    """z[i]: how many elements from i on equal those from 0 on."""
    n = len(a)
    z = [n] + [0] * (n - 1)
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and a[k] == a[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def joined(fragments: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Unions of the intervals that overlap or touch, in order."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(fragments):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def octaves(low: int, high: int) -> Iterator[int]:
    """Distances of boundaries from low to high."""
    while low <= high:
        yield low
        low *= 2


def largest(n: int) -> int:
    """Distance of boundaries in the last octave that has a period for n words; 0 if none has."""
    return 0 if n < LEAST else max(FIRST, 1 << (max(1, n // TIMES).bit_length() - 1))


def at_boundary(words: np.ndarray, start: int, end: int, b: int, size: int, periods: list[int]) -> Iterator[Fragment]:
    """The fragments around the block [b, b + size) of the text [start, end), for primitive periods among `periods`."""
    ahead = words[b : min(end, b + 4 * size)].tolist()
    forward = z_function(ahead)
    before = words[max(start, b - size) : b].tolist()[::-1]
    back = z_function([*before, -1, *ahead[: 2 * size][::-1], *before]) if before else []
    shift = len(before) + 1 + min(2 * size, len(ahead))
    for q in periods:
        reach = forward[q]
        if reach >= size and not any(forward[q // r] >= q - q // r for r in prime_factors(q)):
            yield q, b - (min(back[shift - q], len(before)) if before else 0), b + reach


def solve(texts: list[tuple[list[str], int, int]]) -> list[dict[int, list[tuple[int, int]]]]:
    """For texts (words, first and last distance of boundaries): intervals of matches by period, counted from the text's first word."""
    found: list[dict[int, list[tuple[int, int]]]] = [defaultdict(list) for _ in texts]
    order = sorted((i for i, t in enumerate(texts) if t[2]), key=lambda i: -texts[i][2])
    if not order:
        return found
    # Texts lie one after another, those with the largest boundaries first: each begins at a multiple of
    # its own, and the texts of an octave are a front part. Gaps have numbers of their own.
    starts, ends, total = [], [], 0
    for i in order:
        words, _, last = texts[i]
        starts.append(total)
        ends.append(total + len(words))
        total += -(-(len(words) + 1) // last) * last
    ids = -2 - np.arange(total, dtype=np.int64)
    numbers: dict[str, int] = {}
    for i, at in zip(order, starts, strict=True):
        words = texts[i][0]
        ids[at : at + len(words)] = [numbers.setdefault(w, len(numbers)) for w in words]
    first, last = (np.array([texts[i][k] for i in order]) for k in (1, 2))
    begin, end = np.array(starts), np.array(ends)
    known = np.zeros(total + 1, np.int64)  # furthest end of a stretch that begins here
    window, width = mixed(ids.astype(U64)), 1
    for size in octaves(FIRST, int(last[0])):
        while width < size:
            window = mixed(window[:-width] * U64(0x9E3779B97F4A7C15) + window[width:]) if len(window) > width else window[:0]
            width *= 2
        front = int(np.searchsorted(-last, -size, side="right"))
        limit = min(len(window), int(end[front - 1]))
        blocks, at = _recurring(window[:limit], size)
        owner = np.searchsorted(begin, blocks, side="right") - 1
        fit = (owner == np.searchsorted(begin, at, side="right") - 1) & (first[owner] <= size)
        blocks, at, owner = blocks[fit], at[fit], owner[fit]
        reach = np.maximum.accumulate(known)[blocks]
        fresh = reach < np.minimum(blocks + 3 * size, end[owner])
        periods: dict[tuple[int, int], list[int]] = defaultdict(list)
        for o, b, q in zip(owner[fresh].tolist(), blocks[fresh].tolist(), (at - blocks)[fresh].tolist(), strict=True):
            periods[o, b].append(q)
        here: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for (o, b), several in periods.items():
            for q, low, high in at_boundary(ids, int(begin[o]), int(end[o]), b, size, several):
                here[o, q].append((low, high))
        for (o, q), parts in here.items():
            own = int(begin[o])
            for low, high in joined(parts):
                known[low] = max(known[low], high + q)
                found[order[o]][q].append((low - own, high - own))
    return found


def _recurring(window: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks, and places within the octave's periods from each, where the windows' fingerprints agree."""
    n = len(window)
    place = np.arange(n)
    pairs = []
    for back in (1, 0) if size == FIRST else (1,):  # the first octave also has the periods below FIRST
        block = (place // size - back) * size
        pairs.append(np.flatnonzero((block >= 0) & (window[np.maximum(block, 0)] == window) & (block < place)))
        pairs[-1] = (block[pairs[-1]], pairs[-1])
    return tuple(np.concatenate([p[k] for p in pairs]) for k in (0, 1))


def tiles(n: int, tile: int = TILE) -> Iterator[tuple[int, int, int, int]]:
    """(first distance of boundaries, last one, first word, end word) of the tiles of a text of n words."""
    last = largest(n)
    if n <= tile or not last:
        yield FIRST, last, 0, n
        return
    small = FIRST
    while small < last and 16 * 2 * small <= tile:
        small *= 2
    for first, top, step in [(FIRST, small, tile), *[(s, s, 16 * s) for s in octaves(2 * small, last)]]:
        for at in range(0, n, step):
            yield first, top, max(0, at - top), min(n, at + step + 4 * top)
            if at + step + 4 * top >= n:
                break


def _complete(fragments: dict[int, list[tuple[int, int]]], low: int, high: int, n: int) -> Iterator[Fragment]:
    """Fragments in the text's own numbers; those that end inside the tile and are too short for a run go."""
    for q, parts in fragments.items():
        for a, b in parts:
            whole = (a > 0 or low == 0) and (b + q < high - low or high == n)
            if not whole or b - a + q >= max(LEAST, TIMES * q):
                yield q, a + low, b + low


def explode(docs: DataFrame, change: Callable[[object, list[str]], list[str]] | None = None, key: str = "doc_id", text: str = "text", tile: int = TILE) -> DataFrame:
    """One row a text (row, key, n_words, plain_sha256, fragments, words where it may have runs) and one a tile of longer texts.

    `change` may replace the words of a text, given its key. Texts of one tile are solved on the way.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for at, (name, value) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
                words = WORD.findall(value.as_py() or "")
                held.append((batch.column(0)[at].as_py(), name, change(name, words) if change else words))
                size += len(words)
                if size >= BATCH_WORDS:
                    yield from emit(held)
                    held, size = [], 0
            yield from emit(held)

    def emit(held: list[tuple[int, object, list[str]]]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        plans = [list(tiles(len(words), tile)) for _, _, words in held]
        solved = solve([(words, *p[0][:2]) if len(p) == 1 else ([], FIRST, 0) for (_, _, words), p in zip(held, plans, strict=True)])
        rows = []
        for (row, name, words), plan, fragments in zip(held, plans, solved, strict=True):
            line = " ".join(words)
            own = [dict(zip(("period", "low", "high"), f, strict=True)) for f in _complete(fragments, 0, len(words), len(words))]
            wanted = bool(own) or len(plan) > 1
            rows.append((row, name, len(words), hashlib.sha256(line.encode()).hexdigest(), own, line if wanted else None, None, None, None))
        yield _batch(rows, types)
        for (row, name, words), plan in zip(held, plans, strict=True):
            for first, last, low, high in plan if len(plan) > 1 else ():
                yield _batch([(row, name, len(words), None, [], " ".join(words[low:high]), first, last, low)], types)

    kind = docs.schema[key].dataType
    schema = f"row bigint, key {kind.simpleString()}, n_words bigint, plain_sha256 string, fragments array<struct<period: bigint, low: bigint, high: bigint>>, words string, first bigint, last bigint, at bigint"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    types = to_arrow_schema(StructType.fromDDL(schema))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, schema)


def _batch(rows: list[tuple], types: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), types, strict=True)], schema=types)


def solve_tiles(tiles: DataFrame) -> DataFrame:
    """(row, period, low, high) of rows (row, n_words, words, first, last, at)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                tile = batch.slice(at, 1).to_pylist()[0]
                words = tile["words"].split(" ")
                (fragments,) = solve([(words, tile["first"], tile["last"])])
                low = tile["at"]
                rows = list(_complete(fragments, low, low + len(words), tile["n_words"]))
                columns = [[tile["row"]] * len(rows), *([r[k] for r in rows] for k in range(3))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["row", "period", "low", "high"])

    return tiles.select("row", "n_words", "words", "first", "last", "at").mapInArrow(run, "row bigint, period bigint, low bigint, high bigint")


def stitch(fragments: DataFrame) -> DataFrame:
    """(row, start, length, period): fragments of a text and period that touch are one stretch; long enough ones are runs."""
    order = Window.partitionBy("row", "period").orderBy("low", "high")
    behind = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parted = fragments.withColumn("new", F.coalesce((F.col("low") > behind).cast("int"), F.lit(1)))
    numbered = parted.withColumn("stretch", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = numbered.groupBy("row", "period", "stretch").agg(F.min("low").alias("start"), (F.max("high") - F.min("low") + F.col("period")).alias("length"))
    return whole.filter(F.col("length") >= F.greatest(F.lit(LEAST), TIMES * F.col("period"))).select("row", "start", "length", "period")


RESULT = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def summary(words: list[str], runs: list[tuple[int, int, int]]) -> tuple:
    """RESULT of a text with the given (start, length, period)."""
    runs = sorted(runs, key=lambda r: (r[0], r[2]))
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(edges[:-1]) == 0)
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(runs), *four, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(" ".join([words[i] for i in kept]).encode()).hexdigest()


def summaries(rows: DataFrame) -> DataFrame:
    """RESULT of rows (key, words, runs)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = f"key {rows.schema['key'].dataType.simpleString()}, {RESULT}"
    types = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                runs = [(r["start"], r["length"], r["period"]) for r in row["runs"] or []]
                yield _batch([(row["key"], *summary(row["words"].split(" ") if row["words"] else [], runs))], types)

    return rows.select("key", "words", "runs").mapInArrow(run, schema)


def runs(docs: DataFrame, change: Callable[[object, list[str]], list[str]] | None = None, key: str = "doc_id", text: str = "text", tile: int = TILE) -> DataFrame:
    """(key, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of every row of `docs`.

    The four after n_runs are those of the run with the greatest length / period.
    """
    rows = store(explode(docs, change, key, text, tile), "tiles")
    texts, cut = rows.filter("first is null"), rows.filter("first is not null")
    found = texts.select("row", F.inline("fragments")).union(solve_tiles(cut.repartition("row", "first", "at")))
    listed = stitch(found).groupBy("row").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    asked = texts.filter("words is not null").select("row", "key", "words").join(listed.hint("merge"), "row", "left")
    empty = hashlib.sha256(b"").hexdigest()
    nulls = [F.lit(None).cast("bigint").alias(c) for c in ("start", "length", "period", "exponent_milli")]
    plain = texts.filter("words is null").select("key", F.lit(0).cast("bigint").alias("n_runs"), *nulls, F.lit(empty).alias("runs_sha256"), F.col("plain_sha256").alias("collapsed_sha256"))
    return plain.union(summaries(asked)).withColumnRenamed("key", key)
