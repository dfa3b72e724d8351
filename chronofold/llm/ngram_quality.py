"""Quality by the perplexity of an interpolated modified Kneser-Ney model of characters.

Counts of ORDER-grams come from every trusted text; all else (continuation counts, discounts by
counts of counts, interpolation weights) is derived from them with joins and aggregates. The model is
kept as a table that is cut into shards of at most SHARD_ROWS grams by the hash of the gram. Scoring
looks the grams of each whole text up shard by shard, so a task never holds more than a few shards,
whatever the corpus has. A document is kept if its perplexity stays under the threshold of its
language, a quantile of the trusted documents' perplexities.

Cases: null and empty texts have no perplexity and are not kept; a null language, or one with fewer
than LEAST_TRUSTED trusted documents, takes the threshold over all languages; without any trusted
document there is no threshold and every text stays; repeated labels count once; repeated rows
are scored each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytekit
from .shared import scratch, store
from .warc import file_system

ORDER = 5
START, END = "\x02", "\x03"
SHARD_ROWS = 1 << 21
SHARDS_HELD = 4
COUNTED = 1 << 21  # distinct grams that a counting task holds before it passes them on
QUANTILE = 0.995
ROOM = 0.1  # part of the logarithm of a perplexity by which a text may pass the quantile
LEAST_TRUSTED = 50
BITMAP_BITS = 23

U64 = np.uint64


def sequence(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts with borders, the places to be predicted, and the text of each place."""
    codes = np.frombuffer("".join(START * (ORDER - 1) + t + END for t in texts).encode("utf-32-le"), np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64) + 1
    begin = np.cumsum(sizes + ORDER - 1) - sizes
    text = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(sizes.sum()) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)
    return codes, place, text


def keys_by_order(codes: np.ndarray) -> list[np.ndarray]:
    """keys[k][i] identifies the k characters that end at i."""
    values = bytekit.mixed(codes.astype(U64) + U64(0x51ED27))
    up, total, out = bytekit.powers()[0], np.zeros(len(codes), U64), [np.zeros(len(codes), U64)]
    for k in range(1, ORDER + 1):
        total[k - 1 :] = total[k - 1 :] + values[: len(values) - k + 1] * up[k - 1]
        out.append(bytekit.mixed(total + U64(k)))
    return out


def gram_keys(grams: list[str]) -> np.ndarray:
    """The same keys for grams as strings."""
    sizes = np.array([len(g) for g in grams], np.int64)
    codes = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32)
    ends, keys, out = np.cumsum(sizes) - 1, keys_by_order(codes), np.empty(len(grams), U64)
    # Keys of k characters look at those alone, so neighbours in the joined string do no harm.
    for k in range(1, ORDER + 1):
        own = sizes == k
        out[own] = keys[k][ends[own]]
    return out


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    yield from bytekit.slices(np.concatenate(([0], np.cumsum([len(t) + ORDER for t in texts]))), 1 << 18)


def count(texts: DataFrame) -> DataFrame:
    """(gram, n) of every ORDER-gram of the texts, summed up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, codes, counts = np.zeros(0, U64), np.zeros((0, ORDER), np.uint32), np.zeros(0, np.int64)

        def merged(parts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            every = np.concatenate([p[0] for p in parts])
            unique, first, inverse = np.unique(every, return_index=True, return_inverse=True)
            total = np.bincount(inverse, np.concatenate([p[2] for p in parts]), len(unique)).astype(np.int64)
            return unique, np.concatenate([p[1] for p in parts])[first], total

        def table() -> pa.RecordBatch:
            text = codes.tobytes().decode("utf-32-le")
            return pa.RecordBatch.from_arrays([pa.array([text[i : i + ORDER] for i in range(0, len(text), ORDER)], pa.string()), pa.array(counts)], names=["gram", "n"])

        for batch in batches:
            whole = [t for t in batch.column(0).to_pylist() if t]
            for a, b in _slices(whole):
                points, place, _ = sequence(whole[a:b])
                unique, first, n = np.unique(keys_by_order(points)[ORDER][place], return_index=True, return_counts=True)
                at = place[first]
                keys, codes, counts = merged([(keys, codes, counts), (unique, points[at[:, None] + np.arange(1 - ORDER, 1)], n)])
                if len(keys) > COUNTED:
                    yield table()
                    keys, codes, counts = keys[:0], codes[:0], counts[:0]
        if len(keys):
            yield table()

    return texts.select("text").mapInArrow(run, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> list[float]:
    """D1, D2 and D3+ from the counts of counts."""
    few = {r["n"]: r["grams"] for r in counts.filter("n <= 4").groupBy("n").agg(F.count("*").alias("grams")).collect()}
    n1, n2, n3, n4 = (few.get(k, 0) for k in (1, 2, 3, 4))
    if not n1 or not n2:
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw, strict=True)]


def _discounted(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gram, context, own share) and (context, gamma) of one order."""
    d1, d2, d3 = _discounts(counts)
    by_context = counts.withColumn("context", F.expr("substring(gram, 1, char_length(gram) - 1)"))
    taken = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
    totals = by_context.groupBy("context").agg(F.sum("n").alias("total"), (F.sum(taken) / F.sum("n")).alias("gamma"))
    own = by_context.join(totals, "context").select("gram", ((F.col("n") - taken) / F.col("total")).alias("share"), "gamma")
    return own, totals.select("context", "gamma")


def model(counts: DataFrame) -> DataFrame:
    """(gram, logp, loggamma): a gram's probability after its context, and its weight as a context.

    The row of the empty gram has the weight of an unknown character's probability.
    """
    suffix = F.expr("substring(gram, 2)")
    orders = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: how many characters stand before a gram
        orders[k] = store(orders[k + 1].groupBy(suffix.alias("gram")).agg(F.count("*").alias("n")), f"order{k}")
    own, gamma = _discounted(orders[1])
    size = orders[1].count() + 1
    lower = own.select("gram", (F.col("share") + F.col("gamma") / size).alias("p"))
    parts = [lower.select("gram", F.log("p").alias("logp"), F.lit(None).cast("double").alias("loggamma"))]
    parts.append(gamma.select(F.col("context").alias("gram"), F.lit(None).cast("double").alias("logp"), F.log(F.col("gamma") / size).alias("loggamma")))
    for k in range(2, ORDER + 1):
        own, gamma = _discounted(orders[k])
        below = lower.select(F.col("gram").alias("tail"), F.col("p").alias("below"))
        lower = store(own.withColumn("tail", suffix).join(below, "tail").select("gram", (F.col("share") + F.col("gamma") * F.col("below")).alias("p")), f"p{k}")
        parts.append(lower.select("gram", F.log("p").alias("logp"), F.lit(None).cast("double").alias("loggamma")))
        parts.append(gamma.select(F.col("context").alias("gram"), F.lit(None).cast("double").alias("logp"), F.log("gamma").alias("loggamma")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("gram").agg(F.max("logp").alias("logp"), F.max("loggamma").alias("loggamma"))


def shard(table: DataFrame) -> tuple[str, int]:
    """Writes a model as shards of about SHARD_ROWS grams; their folder and number."""
    table = store(table, "grams")
    shards = max(1, -(-table.count() // SHARD_ROWS))
    path = scratch(table.sparkSession, "model")
    cut = table.withColumn("shard", F.pmod(F.xxhash64("gram"), F.lit(shards)))
    cut.repartition(int(shards), "shard").write.partitionBy("shard").parquet(path)
    return path, int(shards)


@lru_cache(maxsize=SHARDS_HELD)
def _shard(path: str, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys of one shard with their two values; nan where there is none."""
    system, base = file_system(f"{path}/shard={number}")
    if system.get_file_info(base).type == pa.fs.FileType.NotFound:  # no gram falls into this shard
        return np.zeros(0, U64), np.zeros(0, np.float32), np.zeros(0, np.float32)
    rows = pa.dataset.dataset(base, filesystem=system, format="parquet").to_table(columns=["gram", "logp", "loggamma"])
    grams = [g for g in rows["gram"].to_pylist()]
    keys = np.concatenate((gram_keys([g for g in grams if g]), np.zeros(sum(not g for g in grams), U64)))
    order = np.concatenate((np.flatnonzero([bool(g) for g in grams]), np.flatnonzero([not g for g in grams]))).astype(np.int64)
    sort = np.argsort(keys)
    values = [rows[c].to_numpy(zero_copy_only=False).astype(np.float32)[order][sort] for c in ("logp", "loggamma")]
    return keys[sort], *values


def lookup(path: str, shards: int, keys: np.ndarray, column: int) -> np.ndarray:
    """Values of the keys, nan for those that no shard has."""
    out = np.full(len(keys), np.nan, np.float32)
    for number in range(shards):
        table = _shard(path, number)
        if len(table[0]):
            at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
            hit = table[0][at] == keys
            out[hit] = table[column][at[hit]]
    return out


def log_probabilities(path: str, shards: int, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of every character, the end of the text included, and the text of each."""
    codes, place, text = sequence(texts)
    keys = keys_by_order(codes)
    out, open_ = np.zeros(len(place)), np.arange(len(place))
    for k in range(ORDER, 0, -1):
        found = lookup(path, shards, keys[k][place[open_]], 1)
        known = ~np.isnan(found)
        out[open_[known]] += found[known]
        open_ = open_[~known]
        if not len(open_):
            return out, text
        context = keys[k - 1][place[open_] - 1] if k > 1 else np.zeros(len(open_), U64)
        out[open_] += np.nan_to_num(lookup(path, shards, context, 2))
    return out, text


def score(docs: DataFrame, path: str, shards: int, carry: tuple[str, ...], text: str = "text") -> DataFrame:
    """(row, n_symbols, perplexity) of every whole text; n_symbols counts the end of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _slices(texts):
                found, own = log_probabilities(path, shards, texts[a:b])
                sizes = np.array([len(t) + 1 for t in texts[a:b]])
                perplexity = np.exp(-np.bincount(own, found, b - a) / sizes)
                values = pa.array(perplexity, mask=sizes == 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes), values], names=["row", "n_symbols", "perplexity"])

    rows = docs.select(F.struct(*carry).alias("row"), F.col(text).alias("text"))
    return rows.mapInArrow(run, rows.select("row").schema.add("n_symbols", T.LongType()).add("perplexity", T.DoubleType()))


def trusted_texts(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts of the trusted keys. A bitmap of fixed size keeps most others out of the shuffle."""
    place = F.pmod(F.xxhash64("key"), F.lit(1 << BITMAP_BITS))
    word, bit = F.shiftright(place, 6).alias("word"), place.bitwiseAND(63).cast("int")
    keys = trusted.select(F.col(key).alias("key")).filter(F.col("key").isNotNull()).distinct()
    bitmap = keys.select(word, F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("mask"))
    bitmap = bitmap.groupBy("word").agg(F.bit_or("mask").alias("mask"))  # 2^17 rows at most
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    likely = rows.withColumn("word", word).join(F.broadcast(bitmap), "word").filter(F.call_function("shiftrightunsigned", F.col("mask"), bit).bitwiseAND(F.lit(1)) == 1)
    return likely.join(keys.hint("merge"), "key", "left_semi").select("text")  # keys grow with the corpus


def thresholds(scored: DataFrame, trusted: DataFrame, key: str = "doc_id") -> DataFrame:
    """(lang, threshold); the row of the null language holds for all others."""
    own = scored.join(trusted.select(key).distinct(), key, "left_semi").filter(F.col("perplexity").isNotNull())
    limit = (F.percentile_approx(F.log("perplexity"), QUANTILE, 10_000) * (1 + ROOM)).alias("limit")
    each = own.filter(F.col("lang").isNotNull()).groupBy("lang").agg(limit, F.count("*").alias("n")).filter(F.col("n") >= LEAST_TRUSTED)
    overall = own.agg(limit).select(F.lit(None).cast("string").alias("lang"), "limit")
    return each.select("lang", "limit").unionByName(overall).select("lang", F.exp("limit").alias("threshold"))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, lang, n_symbols, perplexity, threshold, kept) for every row; `labels` names the trusted keys."""
    path, shards = shard(model(store(count(trusted_texts(docs, labels, key)), "counts")))
    scored = store(score(docs, path, shards, (key, "lang")).select("row.*", "n_symbols", "perplexity"), "scored")
    limits = store(thresholds(scored, labels, key), "limits")
    overall = limits.filter("lang is null").select(F.col("threshold").alias("overall"))
    total = overall.first()
    own = scored.join(limits.filter("lang is not null"), "lang", "left")
    threshold: Column = F.coalesce("threshold", F.lit(total["overall"] if total else None).cast("double"))
    return own.select(key, "lang", "n_symbols", "perplexity", threshold.alias("threshold")).withColumn(
        "kept", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.col("perplexity").isNotNull())
    )
