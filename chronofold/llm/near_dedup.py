"""MinHash near-duplicate groups with odd sketches.

A document is its set of five-word shingles. Equal sets collapse into one node before anything is
compared, so thousands of copies cost one row each. For a node, SAMPLES MinHash values are taken;
bands of ROWS values, as many as the threshold asks for, propose candidates, and all values are folded into an odd sketch, a
parity bitmap: each (place, value) flips one bit, so shared samples cancel in the exclusive or of
two sketches, and its population count tells how many samples differ. Candidates whose sketches
leave room for the threshold are confirmed on the full sets.

A bucket never emits all its pairs. First each member is compared with the bucket's smallest, then,
where a bucket still holds several components, with its largest; only members of buckets that are
still split afterwards are compared across components (never inside one), in salted blocks.

Cases: a null or empty text has an empty set and is linked with nothing; a row without a key is
linked with nothing and kept; keys may be of any type that has an order; rows that share a key are placed each by its
own text; a very long text is one row of at most eight times its bytes; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, dropping_shuffles
from . import bytekit
from .shared import store, trimmed

SAMPLES = 256
ROWS = 4  # values of a band
MISS = 1e-5  # probability at most that a pair at the threshold shares no band
SKETCH_WORDS = 16  # 1024 bits
FINE_SAMPLES, FINE_WORDS = 1024, 64  # of the few members that are compared across components
SLACK = 4  # standard deviations by which a sketch may understate the similarity
BLOCK = 2048  # members of a split bucket that one block compares

U64 = np.uint64


def bands_for(percent: int) -> int:
    """Bands that a pair at the threshold misses with probability MISS at most: 16 at 85, 22 at 80."""
    if percent >= 100:
        return 1
    bands = math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))
    if bands * ROWS > SAMPLES:
        raise ValueError(f"{SAMPLES} samples are too few for a threshold of {percent} percent")
    return bands


def _minhashes(shingles: np.ndarray, offsets: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """(samples, rows) MinHash values of 32 bits; every row has a shingle."""
    multiply, add = bytekit.stream(3, samples) | U64(1), bytekit.stream(5, samples)
    out = np.empty((samples, len(offsets) - 1), np.uint32)
    scratch = np.empty_like(shingles)
    for i in range(samples):
        np.multiply(shingles, multiply[i], out=scratch)
        np.add(scratch, add[i], out=scratch)
        high = (scratch >> U64(32)).astype(np.uint32)
        out[i] = np.minimum.reduceat(high, offsets[:-1])
    return out


def _bands(values: np.ndarray, bands: int) -> np.ndarray:
    """(rows, bands) keys; the band's number is part of its key."""
    keys = np.empty((values.shape[1], bands), U64)
    for band in range(bands):
        total = np.full(values.shape[1], band + 1, U64)
        for row in values[band * ROWS : (band + 1) * ROWS]:
            total = bytekit.mixed(total * U64(0x9E3779B97F4A7C15) + row)
        keys[:, band] = total
    return keys


def _odd_sketches(values: np.ndarray, words: int = SKETCH_WORDS) -> np.ndarray:
    """(rows, words): each sample flips the bit that its place and value choose."""
    n, bits = values.shape[1], words * 64
    place = bytekit.mixed(values.astype(U64) + (np.arange(len(values), dtype=U64)[:, None] << U64(32))) % U64(bits)
    flips = np.zeros((n, bits), np.uint8)
    columns = np.arange(n)
    for row in place:
        flips[columns, row.astype(np.int64)] ^= 1
    return np.packbits(flips, axis=1, bitorder="little").view("<u8")


def _sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of rows [a, b): their distinct shingles, sorted in each row, and the offsets."""
    data, offsets = bytekit.texts(column)
    for a, b in bytekit.slices(offsets):
        part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        start, end, row = bytekit.words(part, own)
        every, at = bytekit.shingles(bytekit.word_hashes(part, start, end), row, b - a)
        distinct = [np.unique(every[at[i] : at[i + 1]]) for i in range(b - a)]
        yield a, b, np.concatenate(distinct) if distinct else every, np.concatenate(([0], np.cumsum([len(d) for d in distinct])))


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32)), pa.array(np.ascontiguousarray(values).view(np.int64).ravel()))


def _digests(flat: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums over each set, the digest that stands for it."""
    return [np.add.reduceat(bytekit.mixed(x), starts) for x in (flat ^ U64(0xA5A5), flat + U64(0x5A5A5A))]


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85, carry: str | None = None) -> DataFrame:
    """(key, carry, n_shingles, set1, set2, bands, sketch): set1 and set2 are a 128-bit digest of the set."""
    n_bands = bands_for(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "carry", "n_shingles", "set1", "set2", "bands", "sketch"]
        for batch in batches:
            for a, b, flat, offsets in _sets(batch.column(2)):
                size = np.diff(offsets)
                full = np.flatnonzero(size)
                keep = np.concatenate((offsets[full], offsets[-1:]))
                digests = np.zeros((2, b - a), U64)
                bands, sketch = np.zeros((b - a, n_bands), U64), np.zeros((b - a, SKETCH_WORDS), U64)
                if len(full):
                    values = _minhashes(flat, keep)
                    digests[:, full] = _digests(flat, keep[:-1])
                    bands[full], sketch[full] = _bands(values, n_bands), _odd_sketches(values)
                columns = [pa.array(size, pa.int64()), *[pa.array(d.view(np.int64)) for d in digests], _lists(bands), _lists(sketch)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in (0, 1)), *columns], names=names)

    rows = docs.select(F.col(key).alias("key"), (F.col(carry) if carry else F.lit(None).cast("string")).alias("carry"), F.col(text).alias("text"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("key", "carry")]
    return rows.mapInArrow(trimmed(run), f"key {kinds[0]}, carry {kinds[1]}, n_shingles bigint, set1 bigint, set2 bigint, bands array<bigint>, sketch array<bigint>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(node, shingles) of (node, set1, set2, text): the full set of every text that has this digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = [batch.column(i).to_numpy(zero_copy_only=False).view(U64) for i in (1, 2)]
            for a, b, flat, offsets in _sets(batch.column(3)):
                full = np.flatnonzero(np.diff(offsets))
                if not len(full):
                    continue
                own = _digests(flat, offsets[full])
                same = np.zeros(b - a, bool)
                same[full] = (own[0] == wanted[0][a:b][full]) & (own[1] == wanted[1][a:b][full])
                sets = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), sets], names=["node", "shingles"]).filter(pa.array(same))

    return docs.select("node", "set1", "set2", "text").mapInArrow(trimmed(run), "node bigint, shingles array<bigint>")


def fine_sketches(sets: DataFrame) -> DataFrame:
    """(node, fine): odd sketches of FINE_SAMPLES samples of (node, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                flat = part.column(1).flatten().to_numpy().view(U64)
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in part.column(1)])))
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(_odd_sketches(_minhashes(flat, offsets, FINE_SAMPLES), FINE_WORDS))], names=["node", "fine"])

    return sets.select("node", "shingles").filter(F.size("shingles") > 0).mapInArrow(trimmed(run), "node bigint, fine array<bigint>")


def differing(a: str, b: str) -> Column:
    """Set bits in the exclusive or of two odd sketches."""
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")


def most_differing(percent: int, samples: int = SAMPLES, words: int = SKETCH_WORDS, slack: float = SLACK) -> int:
    """Set bits that two sketches at the threshold stay under, with `slack` standard deviations.

    m samples differ, so 2m elements fall into the bits; those that meet cancel, which takes two set
    bits each time.
    """
    bits, miss = words * 64, 1 - percent / 100
    elements = 2 * samples * miss
    mean = bits / 2 * (1 - (1 - 2 / bits) ** elements)
    by_samples, by_meeting = 4 * samples * miss * (1 - miss), 4 * elements**2 / (2 * bits)
    return int(mean + slack * (by_samples + by_meeting) ** 0.5) + 1


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b); root is the smallest node that it reaches.

    Alternates the large-star and small-star steps: each node's neighbours are pointed at its
    smallest neighbour. Minima are aggregated before rows meet, so a hub costs no more than its rows.
    """
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = cut_lineage(small.select("e.u", "e.v").filter("u <> v").distinct())
        with dropping_shuffles(links.sparkSession):
            state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and odd sketches let through. Pairs grow with the corpus and are never broadcast."""
    left = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("sa"), F.col("n_shingles").alias("na"))
    right = nodes.select(F.col("node").alias("b"), F.col("sketch").alias("sb"), F.col("n_shingles").alias("nb"))
    both = pairs.hint("merge").join(left, "a").join(right, "b")
    return both.filter(F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb)") & (differing("sa", "sb") <= most_differing(percent))).select("a", "b")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    full = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("xa")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("xb")), "b"
    )
    shared = full.select("a", "b", F.size("xa").alias("na"), F.size("xb").alias("nb"), F.size(F.array_intersect("xa", "xb")).alias("i"))
    return shared.filter(f"100L * i >= {percent}L * (na + nb - i)").select("a", "b").distinct()


def across(parts: DataFrame, nodes: DataFrame, fine: DataFrame, percent: int, slack: float) -> DataFrame:
    """The pairs (a, b) of members of a bucket, in different components, that sizes and fine sketches let through; in salted blocks."""
    rest = parts.join(nodes.select("node", "n_shingles", "bands"), "node").join(fine, "node")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK).cast("int"))

    def side(letter: str, block: Column) -> DataFrame:
        return rest.select("bucket", *[F.col(c).alias(letter + c) for c in ("node", "root", "fine", "n_shingles", "bands")], block.alias("block"))

    one = side("a_", F.pmod(F.xxhash64("node"), blocks))
    other = side("b_", F.explode(F.sequence(F.lit(0).cast("bigint"), (blocks - 1).cast("bigint"))))
    meet = (F.col("a_node") < F.col("b_node")) & (F.col("a_root") != F.col("b_root")) & F.expr(f"100 * least(a_n_shingles, b_n_shingles) >= {percent} * greatest(a_n_shingles, b_n_shingles)")
    meet &= differing("a_fine", "b_fine") <= most_differing(percent, FINE_SAMPLES, FINE_WORDS, slack)
    meet &= F.col("x.bucket") == F.get(F.array_intersect("a_bands", "b_bands"), F.lit(0))  # once for all buckets that a pair shares
    met = one.alias("x").join(other.alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.block") == F.col("y.block")) & meet)
    return met.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct()


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85, carry: str | None = None) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row of `docs`.

    Nodes are distinct sets, numbered where they are written, so keys may be of any type and repeat.
    `carry` names one more column to pass on, and adds `component`, a number of the component that tells
    components apart even where their smallest keys are equal; it is null for rows linked with nothing.
    """
    rows = store(sketches(docs, key, text, percent, carry), "sketches")
    whole = rows.filter("n_shingles > 0 and key is not null")
    sets_of = ["set1", "set2", "n_shingles"]
    first = whole.groupBy(*sets_of).agg(F.min("key").alias("key"))
    one = whole.join(first, [*sets_of, "key"], "left_semi").dropDuplicates([*sets_of, "key"])
    nodes = store(one.select(F.monotonically_increasing_id().alias("node"), "key", *sets_of, "bands", "sketch"), "nodes")

    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).filter("n > 1")
    members = store(buckets.join(shared, "bucket"), "members")
    asked = nodes.join(members.select("node").distinct(), "node").select("node", "key", "set1", "set2")
    wanted = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(asked.hint("merge"), "key")
    sets = store(shingle_sets(wanted).dropDuplicates(["node"]), "sets")

    stars = members.filter("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
    links = store(confirm(likely(stars, nodes, percent), sets, percent), "links")
    roots = components(links)

    def split(roots: DataFrame) -> DataFrame:
        """Members of the buckets that hold several components."""
        placed = members.filter("n > 2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = placed.groupBy("bucket").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).filter("r1 <> r2").select("bucket")
        return placed.join(mixed, "bucket", "left_semi").select("bucket", "node", "root", "high", "n")

    parts = split(roots)
    tops = parts.filter("node = high").select("bucket", F.col("root").alias("top_root"))
    again = parts.join(tops, "bucket").filter("node <> high and root <> top_root").select(F.col("node").alias("a"), F.col("high").alias("b")).distinct()
    links = store(links.union(confirm(likely(again, nodes, percent), sets, percent)), "links")
    roots = components(links)

    # What is still split is compared across components, by sketches fine enough that few pairs in
    # vain reach the full sets. First come the pairs that the sketches put at the threshold or above it;
    # they connect most of a family, and only pairs still apart after that need the sketches' slack.
    fine = None
    for slack in (0, SLACK):
        parts = store(split(roots), "parts")
        if fine is None:
            fine = store(fine_sketches(sets.join(parts.select("node").distinct(), "node", "left_semi")), "fine")
        links = store(links.union(confirm(across(parts, nodes, fine, percent, slack), sets, percent)), "links")
        roots = components(links)

    # From nodes back to rows, by the set's digest; a component's key is the smallest of its rows.
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).select(*sets_of, "key", "root")
    least = named.groupBy("root").agg(F.min("key").alias("component"))
    placed = rows.join(named.join(least, "root").select(*sets_of, "component", "root"), sets_of, "left")
    linked = F.col("key").isNotNull() & (F.col("n_shingles") > 0)
    component = F.when(linked, F.col("component")).otherwise(F.col("key"))
    carried = [F.col("carry").alias(carry), F.when(linked, F.col("root")).alias("component")] if carry else []
    return placed.select(F.col("key").alias(key), *carried, "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True))
    )
