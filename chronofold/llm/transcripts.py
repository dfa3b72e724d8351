"""Transcripts to chat turns: roles recovered by a hidden Markov model over lines.

A line is seen through its speaker marker ("User:", "A>", "[assistant]" ...) and a few features. The
hidden states are (role, begins or goes on); start, transition and emission probabilities are counted
on transcripts whose roles are known. Viterbi gives the roles, and lines of a turn are rendered as
one canonical message.

A conversation may be of any length. Its lines are cut into blocks of BLOCK turns' lines; a block is
summed up by the best score between each pair of its first and last states (a max-plus matrix),
blocks of blocks are summed up the same way until one is left, and the best states at the borders are
handed back down. No task sees more than BLOCK rows of a conversation at once and the path is the
exact Viterbi path.

Cases: null texts are empty lines, null and unknown roles are not learned; a conversation without
a line has no turn; rows without a conv_id are one conversation; rows without a turn come first in
theirs; rows of one turn, repeated ones too, follow each other in the order of their other columns; an
empty table gives empty results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import store

ROLES = ("system", "user", "assistant")
STATES = [(role, begins) for role in ROLES for begins in (True, False)]
N = len(STATES)
BLOCK = 256
BLOCK_CHARS = 1 << 20
SMOOTH = 0.5

# The spellings of speakers that markers use.
SPEAKERS = {
    "system": ("system", "instructions", "s", "sys"),
    "user": ("user", "human", "question", "q", "u", "customer"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "model"),
}
NAMES = {name: role for role, names in SPEAKERS.items() for name in names}
MARKER = regex.compile(r"^\s*(?:[\[<(*#]*\s*)(" + "|".join(sorted(NAMES, key=len, reverse=True)) + r")\s*(?:[\])>*]+\s*:?|:\**|\s*>)\s*", regex.IGNORECASE)
LENGTHS = (20, 60, 120, 240, 480)
SYMBOLS = 4 * (len(LENGTHS) + 1) * 2 * 2


def observe(line: str) -> tuple[int, str]:
    """The symbol of a line, and the line without its marker."""
    found = MARKER.match(line)
    body = line[found.end() :] if found else line
    kind = 1 + ROLES.index(NAMES[found[1].lower()]) if found else 0
    size = sum(len(body) > limit for limit in LENGTHS)
    asks, blank = int(body.rstrip().endswith("?")), int(not body.strip())
    return ((kind * (len(LENGTHS) + 1) + size) * 2 + asks) * 2 + blank, body


@dataclass
class Model:
    """Logarithms of the start, transition and emission probabilities."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray


def possible() -> tuple[np.ndarray, np.ndarray]:
    """Starts and transitions that make sense: a line goes on only in its own turn."""
    start = np.array([begins for _, begins in STATES])
    step = np.array([[b2 or r1 == r2 for r2, b2 in STATES] for r1, _ in STATES])
    return start, step


def learn(lines: DataFrame) -> Model:
    """Probabilities from (conv_id, at, role, begins, line) by counts; at most a few hundred counts come back."""
    order = {state: i for i, state in enumerate(STATES)}
    symbol = F.pandas_udf(lambda s: s.map(lambda t: observe(t)[0]), "int")
    known = lines.filter(F.col("role").isin(*ROLES))
    emit, step, start = (np.full(shape, SMOOTH) for shape in ((N, SYMBOLS), (N, N), (N,)))
    for r in known.groupBy("role", "begins", symbol("line").alias("symbol")).agg(F.count("*").alias("n")).collect():
        emit[order[r["role"], r["begins"]], r["symbol"]] += r["n"]
    after = known.select("conv_id", (F.col("at") + 1).alias("at"), F.col("role").alias("r1"), F.col("begins").alias("b1"))
    moves = joined_on(known, after, ["conv_id", "at"], "left").groupBy("r1", "b1", "role", "begins").agg(F.count("*").alias("n"), F.count(F.when(F.col("at") == 0, 1)).alias("first"))
    for r in moves.collect():
        to = order[r["role"], r["begins"]]
        start[to] += r["first"]
        if r["r1"] is not None:
            step[order[r["r1"], r["b1"]], to] += r["n"]
    can_start, can_step = possible()
    share = lambda x, ok: np.log(np.where(ok, x, 0) / np.where(ok, x, 0).sum(-1, keepdims=True) + np.where(ok, 0, 1e-300))
    return Model(share(start, can_start), share(step, can_step), np.log(emit / emit.sum(1, keepdims=True)))


def product(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Best scores over both: max-plus product."""
    return (first[:, :, None] + second[None, :, :]).max(axis=1)


def block_matrix(model: Model, symbols: np.ndarray, opening: bool) -> np.ndarray:
    """Best score from the state before the block to each state of its last line.

    Before the first line of a conversation any state counts as the same: its rows are equal.
    """
    total = np.tile(model.start + model.emit[:, symbols[0]], (N, 1)) if opening else model.step + model.emit[:, symbols[0]]
    for symbol in symbols[1:]:
        total = product(total, model.step) + model.emit[:, symbol]
    return total


def best_path(model: Model, symbols: np.ndarray, opening: bool, before: int, last: int) -> np.ndarray:
    """States of a block whose neighbours are settled: `before` it and at its `last` line."""
    now = (model.start if opening else model.step[before]) + model.emit[:, symbols[0]]
    back = np.zeros((len(symbols), N), np.int64)
    for i, symbol in enumerate(symbols[1:], 1):
        options = now[:, None] + model.step
        back[i] = options.argmax(axis=0)
        now = options.max(axis=0) + model.emit[:, symbol]
    path = np.empty(len(symbols), np.int64)
    path[-1] = last
    for i in range(len(symbols) - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def joined_on(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """A join on columns of the same name, which a null meets a null in."""
    renamed = right.withColumnsRenamed({n: f"right_{n}" for n in names})
    meets = [F.col(n).eqNullSafe(F.col(f"right_{n}")) for n in names]
    return left.join(renamed, reduce(Column.__and__, meets), how).drop(*[f"right_{n}" for n in names])


def lines_of(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, at, line, ...) for the lines of (conv_id, turn, text); `at` counts a conversation's lines.

    Numbers come from sums over blocks of turns, so that a long conversation is no single group; the
    rows without a turn are a block of their own.
    """
    cut = turns.withColumn("pieces", F.split(F.coalesce("text", F.lit("")), "\n", -1)).withColumn("n", F.size("pieces"))
    block = F.floor(F.col("turn") / BLOCK).alias("block")
    sums = cut.groupBy("conv_id", block).agg(F.sum("n").alias("total"))
    outer = sums.select("conv_id", "block", (F.expr("sum(total) over (partition by conv_id order by block)") - F.col("total")).alias("base"))
    # Rows that tie in every column have equal texts, so their order makes no difference.
    ties = [c for c in turns.columns if c not in ("conv_id", "turn")]
    before = Window.partitionBy("conv_id", "block").orderBy("turn", *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = cut.withColumn("block", block).withColumn("seen", F.sum("n").over(before) - F.col("n"))
    placed = joined_on(inner, outer, ["conv_id", "block"])
    line = F.posexplode("pieces").alias("i", "line")
    return placed.select("conv_id", "turn", *[c for c in turns.columns if c not in ("conv_id", "turn", "text")], (F.col("base") + F.col("seen")).alias("head"), line).select(
        "*", (F.col("head") + F.col("i")).alias("at"), (F.col("i") == 0).alias("begins")
    ).drop("head", "i")


def decode(lines: DataFrame, model: Model) -> DataFrame:
    """(conv_id, at, line, role, begins): the Viterbi path through (conv_id, at, line).

    Inside, a conversation goes by its id as a string, empty for none: pandas has no null integers.
    """
    lines = lines.withColumn("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    schema = "conv_id string, block bigint, symbols array<int>, bodies array<string>, matrix array<double>"

    def sum_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for conv, block, parts in zip(rows["conv_id"], rows["block"], rows["lines"], strict=True):
                seen = [observe(p["line"]) for p in sorted(parts, key=lambda p: p["at"])]
                symbols = np.array([s for s, _ in seen])
                out.append((conv, block, symbols, [b for _, b in seen], block_matrix(model, symbols, block == 0).ravel()))
            yield pd.DataFrame(out, columns=["conv_id", "block", "symbols", "bodies", "matrix"])

    blocks = store(lines.groupBy("conv_id", F.floor(F.col("at") / BLOCK).alias("block")).agg(F.collect_list(F.struct("at", "line")).alias("lines")).mapInPandas(sum_up, schema), "blocks")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for conv, block, parts in zip(rows["conv_id"], rows["block"], rows["parts"], strict=True):
                total = None
                for part in sorted(parts, key=lambda p: p["block"]):
                    own = np.array(part["matrix"]).reshape(N, N)
                    total = own if total is None else product(total, own)
                out.append((conv, block, total.ravel()))
            yield pd.DataFrame(out, columns=["conv_id", "block", "matrix"])

    levels, most = [blocks.select("conv_id", "block", "matrix")], blocks.agg(F.max("block")).first()[0] or 0
    while most > 0:
        parent = F.floor(F.col("block") / BLOCK)
        grouped = levels[-1].groupBy("conv_id", parent.alias("block_")).agg(F.collect_list(F.struct("block", "matrix")).alias("parts"))
        levels.append(store(grouped.select("conv_id", F.col("block_").alias("block"), "parts").mapInPandas(fold, "conv_id string, block bigint, matrix array<double>"), "folds"))
        most //= BLOCK

    def top(matrix: pd.Series) -> pd.Series:
        return matrix.map(lambda m: int(np.argmax(np.array(m).reshape(N, N)[0])))

    # From the whole conversation down: the states before and at the end of each block.
    settled = levels[-1].select("conv_id", "block", F.lit(0).alias("before"), F.pandas_udf(top, "int")("matrix").alias("last"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for conv, parts, before, last in zip(rows["conv_id"], rows["parts"], rows["before"], rows["last"], strict=True):
                parts = sorted(parts, key=lambda p: p["block"])
                own = [np.array(p["matrix"]).reshape(N, N) for p in parts]
                ahead = [own[0][before]]
                for matrix in own[1:]:
                    ahead.append((ahead[-1][:, None] + matrix).max(axis=0))
                ends = [last]
                for i in range(len(own) - 1, 0, -1):
                    ends.append(int(np.argmax(ahead[i - 1] + own[i][:, ends[-1]])))
                ends.reverse()
                out += [(conv, p["block"], b, e) for p, b, e in zip(parts, [before, *ends[:-1]], ends, strict=True)]
            yield pd.DataFrame(out, columns=["conv_id", "block", "before", "last"])

    for level in reversed(levels[:-1]):
        grouped = level.groupBy("conv_id", F.floor(F.col("block") / BLOCK).alias("up")).agg(F.collect_list(F.struct("block", "matrix")).alias("parts"))
        above = settled.select("conv_id", F.col("block").alias("up"), "before", "last")
        settled = grouped.join(above, ["conv_id", "up"]).select("conv_id", "parts", "before", "last").mapInPandas(split, "conv_id string, block bigint, before int, last int")

    def paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for conv, block, symbols, bodies, before, last in rows.itertuples(index=False):
                states = best_path(model, np.array(symbols), block == 0, before, last)
                out += [(conv, block * BLOCK + i, body, *STATES[s]) for i, (s, body) in enumerate(zip(states, bodies, strict=True))]
            yield pd.DataFrame(out, columns=["conv_id", "at", "line", "role", "begins"])

    joined = blocks.select("conv_id", "block", "symbols", "bodies").join(settled, ["conv_id", "block"])
    decoded = joined.mapInPandas(paths, "conv_id string, at bigint, line string, role string, begins boolean")
    return decoded.withColumn("conv_id", F.nullif("conv_id", F.lit("")).cast("bigint"))


def messages(decoded: DataFrame) -> DataFrame:
    """(conv_id, message, role, text, rendered): the lines of a turn as one canonical message.

    Turns are numbered by sums over blocks of lines; a turn's own lines are one value.
    """
    block = F.floor(F.col("at") / BLOCK)
    sums = decoded.groupBy("conv_id", block.alias("block")).agg(F.sum(F.col("begins").cast("int")).alias("total"))
    base = sums.select("conv_id", "block", (F.expr("sum(total) over (partition by conv_id order by block)") - F.col("total")).alias("base"))
    numbered = decoded.withColumn("block", block).withColumn("own", F.expr("sum(cast(begins as int)) over (partition by conv_id, block order by at)"))
    placed = joined_on(numbered, base, ["conv_id", "block"]).withColumn("message", F.col("base") + F.col("own") - 1)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")
    turns = placed.groupBy("conv_id", "message").agg(F.min_by("role", "at").alias("role"), F.min("at").alias("at"), text.alias("text"))
    return turns.withColumn("rendered", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>\n")))


def mark(turns: DataFrame) -> DataFrame:
    """Turns as a raw transcript has them: a speaker marker in one of several styles, and none in some turns."""
    style, drop = F.pmod(F.xxhash64("conv_id"), F.lit(4)), F.pmod(F.xxhash64("conv_id", "turn"), F.lit(6))
    short = F.upper(F.substring("role", 1, 1))
    marker = (
        F.when((drop == 0) | F.col("role").isNull(), "")
        .when(style == 0, F.concat(F.initcap("role"), F.lit(": ")))
        .when(style == 1, F.concat(F.lit("["), "role", F.lit("] ")))
        .when(style == 2, F.concat(short, F.lit("> ")))
        .otherwise(F.concat(F.lit("**"), F.initcap("role"), F.lit(":** ")))
    )
    return turns.withColumn("text", F.concat(marker, F.coalesce("text", F.lit(""))))
