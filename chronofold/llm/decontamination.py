"""Benchmark passages in documents, by SimHash over item-sized windows.

Every item and every window of as many words as an item has is fingerprinted with a 64-bit SimHash
of its words. A multi-index finds all items within a radius that follows from the threshold: the
fingerprint is cut into blocks, so many that two fingerprints within the radius differ in at most
NEAR bits in one of them; items are listed under every block value that near, windows look up their
own block values. Candidates are verified exactly: the weighted similarity of their shingle bags (sum of
the smaller over sum of the larger multiplicities) must reach the threshold.

Windows that cannot reach it are not fingerprinted: a window of n words needs 2t/(1+t) of its
shingles among those of items of n words. Two bitmaps of fixed size, over shingles and over (shingle,
size), decide that, and never wrongly against a window. They and the list of sizes are all that
is sent to the tasks.

Cases: null or empty texts and items match nothing; an item shorter than a shingle has its whole
sequence as the one shingle; repeated items are found each under its id; repeated rows are scanned
each; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytekit
from .shared import store, trimmed

BITS = 64
NEAR = 2  # bits in which a block may differ from the one that an item is listed under
SLACK = 4.5  # standard deviations by which two prints at the threshold may differ more than on average
BITMAP_BITS = 24

U64 = np.uint64
WINDOW_SCHEMA = "key bigint, start bigint, size int, print bigint, bag array<bigint>, bag_id bigint"


def _size_mixed(shingles: np.ndarray, size: int) -> np.ndarray:
    return bytekit.mixed(shingles + bytekit.mixed(np.array([size], U64)))


def _places(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U64(64 - BITMAP_BITS)).astype(np.int64)


def _simhash(words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of `size` words from each start: each bit is the majority over the words' bits."""
    bits = np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
    total = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)))
    more = 2 * (total[starts + size] - total[starts]) > size
    return np.packbits(more, axis=1, bitorder="little").view("<u8").ravel()


def _numbered(bag: np.ndarray) -> np.ndarray:
    """The bag as a set: the second 'x' becomes another element than the first."""
    order = np.argsort(bag, kind="stable")
    ordered = bag[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(bag) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(bag)), 0))
    return np.sort(bytekit.mixed(ordered + (np.arange(len(bag)) - first).astype(U64) * U64(0xC2B2AE3D27D4EB4F)))


def _bags(shingles: np.ndarray, starts: np.ndarray, width: int) -> list[np.ndarray]:
    return [_numbered(shingles[s : s + width]) for s in starts]


def _record(keys: pa.Array, starts: np.ndarray, size: int, prints: np.ndarray, bags: list[np.ndarray]) -> pa.RecordBatch:
    flat = np.concatenate(bags).view(np.int64)
    offsets = np.concatenate(([0], np.cumsum([len(b) for b in bags]))).astype(np.int32)
    ids = np.array([np.bitwise_xor.reduce(bytekit.mixed(b + U64(len(b)))) for b in bags], U64)
    columns = [keys, pa.array(starts.astype(np.int64)), pa.array(np.full(len(starts), size, np.int32)), pa.array(prints.view(np.int64))]
    columns += [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(ids.view(np.int64))]
    return pa.RecordBatch.from_arrays(columns, names=["key", "start", "size", "print", "bag", "bag_id"])


def _per_text(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word hashes) of every text with a word."""
    data, offsets = bytekit.texts(column)
    for a, b in bytekit.slices(offsets):
        part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        start, end, row = bytekit.words(part, own)
        hashes = bytekit.word_hashes(part, start, end)
        borders = np.searchsorted(row, np.arange(b - a + 1))
        for i in range(b - a):
            if borders[i] < borders[i + 1]:
                yield a + i, hashes[borders[i] : borders[i + 1]]


def items(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """One window as large as itself for every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, words in _per_text(batch.column(1)):
                size = len(words)
                width = min(size, bytekit.SHINGLE)
                shingles = bytekit.windows(words, width)
                start = np.zeros(1, np.int64)
                yield _record(batch.column(0).slice(row, 1), start, size, _simhash(words, start, size), _bags(shingles, start, len(shingles)))

    rows = benchmark.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(trimmed(run), WINDOW_SCHEMA)


def _bitmaps(benchmark: DataFrame, text: str = "text") -> tuple[bytes, bytes, list[int]]:
    """The two bitmaps and the item sizes; their words are or-ed on the executors, 1 << 18 at most each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, words in _per_text(batch.column(0)):
                shingles = bytekit.windows(words, min(len(words), bytekit.SHINGLE))
                both = [np.unique(_places(shingles)), np.unique(_places(_size_mixed(shingles, len(words))))]
                which = np.repeat([0, 1], [len(b) for b in both]).astype(np.int32)
                place = np.concatenate(both)
                mask = (U64(1) << (place & 63).astype(U64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(which), pa.array((place >> 6).astype(np.int32)), pa.array(mask), pa.array(np.full(len(place), len(words), np.int32))], names=["which", "word", "mask", "size"])

    marks = benchmark.select(F.col(text).alias("text")).mapInArrow(trimmed(run), "which int, word int, mask bigint, size int")
    words = np.zeros((2, 1 << (BITMAP_BITS - 6)), np.int64)
    for row in marks.groupBy("which", "word").agg(F.bit_or("mask").alias("mask")).collect():
        words[row["which"], row["word"]] = row["mask"]
    sizes = sorted(row["size"] for row in marks.select("size").distinct().collect())
    return words[0].tobytes(), words[1].tobytes(), sizes


def windows(docs: DataFrame, benchmark: DataFrame, percent: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Item-sized windows of all texts that may reach the threshold."""
    by_shingle, by_size, sizes = _bitmaps(benchmark)
    share = docs.sparkSession.sparkContext.broadcast((by_shingle, by_size, sizes))  # 4 MB and the sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, sized = (np.unpackbits(np.frombuffer(m, np.uint8), bitorder="little").view(bool) for m in share.value[:2])
        for batch in batches:
            for row, words in _per_text(batch.column(1)):
                hot: dict[int, np.ndarray] = {}
                for size in share.value[2]:
                    if size > len(words):
                        break
                    width = min(size, bytekit.SHINGLE)
                    if width not in hot:
                        shingles = bytekit.windows(words, width)
                        hot[width] = (shingles, np.flatnonzero(some[_places(shingles)]))
                    shingles, at = hot[width]
                    if not len(at):
                        continue
                    n = size - width + 1
                    need = -(-2 * percent * n // (100 + percent))
                    at = at[sized[_places(_size_mixed(shingles[at], size))]]
                    if len(at) < need:
                        continue
                    flags = np.zeros(len(shingles) + 1, np.int64)
                    flags[at + 1] = 1
                    total = np.cumsum(flags)
                    starts = np.flatnonzero(total[n:] - total[:-n] >= need)
                    if len(starts):
                        low, high = starts[0], starts[-1] + size
                        prints = _simhash(words[low:high], starts - low, size)
                        keys = pa.array([batch.column(0)[row].as_py()] * len(starts), pa.int64())
                        yield _record(keys, starts, size, prints, _bags(shingles, starts, n))

    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(trimmed(run), WINDOW_SCHEMA)


def radius(percent: int) -> int:
    """Bits in which the prints of two bags at the threshold differ at most, but for SLACK standard deviations.

    Such bags share 2t/(1+t) of their words. A bit is the sign of a sum over the words, so two sums
    correlate by that share, and their signs differ with probability arccos(share) / pi.
    """
    flips = math.acos(2 * percent / (100 + percent)) / math.pi
    return min(BITS, math.ceil(BITS * flips + SLACK * (BITS * flips * (1 - flips)) ** 0.5))


def block_edges(percent: int) -> list[int]:
    """Borders of the blocks: one more than radius // (NEAR + 1), so one block differs in at most NEAR bits."""
    n = radius(percent) // (NEAR + 1) + 1
    return [BITS * b // n for b in range(n + 1)]


def _blocks(print_column: str, edges: list[int]) -> list[Column]:
    """The values of the blocks of a fingerprint."""
    return [F.shiftrightunsigned(F.col(print_column), a).bitwiseAND(F.lit((1 << (b - a)) - 1)).cast("int") for a, b in pairwise(edges)]


def _near_masks(width: int) -> list[int]:
    """All block values with at most NEAR bits set."""
    return [sum(1 << i for i in c) for k in range(NEAR + 1) for c in combinations(range(width), k)]


def matches(docs: DataFrame, benchmark: DataFrame, percent: int = 80, key: str = "doc_id") -> DataFrame:
    """(key, item_id, similarity, start_word, n_windows) for every document and item of a match."""
    found = store(windows(docs, benchmark, percent, key), "windows")
    listed = store(items(benchmark), "items")
    # Windows of equal bags and prints are looked up once, however many documents repeat them.
    distinct = found.groupBy("bag_id", "print", "size").agg(F.first("bag").alias("bag"))
    edges, bits = block_edges(percent), radius(percent)
    cell = lambda b, value: F.struct(F.lit(b).alias("b"), value.cast("int").alias("v"))
    own = F.array(*[cell(b, v) for b, v in enumerate(_blocks("wp", edges))])

    def listed_under(b: int, value: Column) -> Column:
        masks = F.array(*[F.lit(m) for m in _near_masks(edges[b + 1] - edges[b])])
        return F.transform(masks, lambda mask: cell(b, value.bitwiseXOR(mask)))

    listing = F.concat(*[listed_under(b, v) for b, v in enumerate(_blocks("ip", edges))])
    asking = distinct.select("bag_id", F.col("print").alias("wp"), "size").select("*", F.inline(own))
    near = listed.select(F.col("key").alias("item_id"), F.col("print").alias("ip"), "size").select("*", F.inline(listing))
    candidates = (
        asking.join(near, ["size", "b", "v"])
        .filter(F.bit_count(F.col("wp").bitwiseXOR(F.col("ip"))) <= bits)
        .select("bag_id", "wp", "size", "item_id")
        .distinct()
    )
    verified = (
        candidates.join(distinct.select("bag_id", F.col("print").alias("wp"), "size", "bag"), ["bag_id", "wp", "size"])
        .join(listed.select(F.col("key").alias("item_id"), F.col("bag").alias("item_bag")), "item_id")
        .withColumn("shared", F.size(F.array_intersect("bag", "item_bag")))
        .withColumn("either", F.size("bag") + F.size("item_bag") - F.col("shared"))
        .filter(F.expr(f"100L * shared >= {percent}L * either"))
        .select("bag_id", F.col("wp").alias("print"), "size", "item_id", (F.col("shared") / F.col("either")).alias("similarity"))
    )
    hits = found.select("key", "start", "bag_id", "print", "size").join(verified, ["bag_id", "print", "size"])
    best = F.max(F.struct("similarity", (-F.col("start")).alias("before"))).alias("best")
    return hits.groupBy("key", "item_id").agg(best, F.count_distinct("start").alias("n_windows")).select(
        F.col("key").alias(key), "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.before")).alias("start_word"), "n_windows"
    )
