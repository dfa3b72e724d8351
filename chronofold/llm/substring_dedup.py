"""Repeated byte strings, by a sparse suffix array over anchored suffixes.

A byte goes if a string of LENGTH bytes that starts anywhere else too covers it. Sorting the suffix
of every byte is not needed for that: in each window of LENGTH bytes the smallest fingerprint of its
GRAM-byte strings marks an anchor, and equal windows have equal anchors at equal offsets.

1. Anchors: a window's leftmost smallest GRAM-string; about two in LENGTH - GRAM bytes are anchors.
2. Anchors whose GRAM-string occurs once drop out; GRAM-strings are counted over all texts.
3. The others carry the bytes of their windows. Equal records are counted first and go on once.
4. Sampled splitters range-partition the records by the leading GRAM bytes of the anchored suffix.
   Where these occur more than HOT times, the rest of the suffix and the bytes in front of it split
   further: records are distinct in these, so no lead is too frequent to be split. What reaches the
   driver is Spark's sample of such keys, 300 a partition and three million at most, of GRAM bytes
   each, or up to 336 for a hot lead.
5. A bucket is read in its order and cut into chunks of CHUNK_RECORDS or less; a chunk sorts its
   suffixes by multikey quicksort, eight bytes a key, and derives the common prefixes of neighbours.
   The windows at offset o of two records are equal when the suffixes share LENGTH - o bytes and the
   o bytes in front of the anchor have the same fingerprint.
6. Chunks are compared across their borders: a run of suffixes that reaches a border may go on
   behind it, so each of its windows leaves one row a chunk, and these are counted by fingerprint.
7. The windows found go back to their texts, which drop the bytes that are covered.

Texts are identified by a 128-bit digest, so copies of a text need no keys, and a third of all rows
being one text costs one row after the first aggregation. Matches never cross texts.

Cases: a null text is an empty one; a text shorter than LENGTH keeps all; rows that repeat are
copies of each other, and both lose what they share; an empty table gives an empty result; other
columns are carried in a struct, so no name can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytekit
from .shared import store, trimmed

LENGTH = 200
GRAM = 64
STARTS = LENGTH - GRAM + 1  # places in a window at which a GRAM-string starts
HOT = 1_000  # occurrences from which a lead is split by further bytes
BUFFER = 20_000  # records after which a chunk ends where the next suffix can have no match in it
CHUNK_RECORDS = 40_000  # records after which a chunk ends anywhere
RECORD_TEXTS = 500  # texts whose records are made and go out together
BORDER_ROWS = 1 << 18  # rows of border windows that are gathered before they go out
PLACE_BITS = 20

U64 = np.uint64
ID = ["id1", "id2"]


def _anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, anchor, largest and smallest offset of the windows of each anchor, and its fingerprint.

    `data` has at most 2^PLACE_BITS bytes; anchors are places in it.
    """
    n = len(data) - LENGTH + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, U64),)
    total = bytekit.running(data)
    at = np.arange(len(data) - GRAM + 1)
    prints = bytekit.between(total, at, at + GRAM)
    mask = U64((1 << PLACE_BITS) - 1)
    least, width = (prints & ~mask) | at.astype(U64), 1
    while 2 * width <= STARTS:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:n], least[STARTS - width : STARTS - width + n])
    ends = np.repeat(offsets[1:], np.diff(offsets))
    start = np.flatnonzero(np.arange(n) + LENGTH <= ends[:n])
    if not len(start):
        return _anchors(data[:0], offsets)
    anchor = (least[start] & mask).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    last = np.append(first[1:], len(anchor)) - 1
    own = anchor[first]
    row = np.searchsorted(offsets, own, side="right") - 1
    return row, own, own - start[first], own - start[last], prints[own]


def _all_anchors(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """`_anchors` for any texts, with places counted from the start of their rows."""
    for a, b in bytekit.slices(offsets):
        low, high = offsets[a], offsets[b]
        if high - low <= bytekit.CHUNK:
            row, at, most, fewest, prints = _anchors(data[low:high], offsets[a : b + 1] - low)
            yield row + a, at - (offsets[a : b + 1] - low)[row], most, fewest, prints
        else:  # one long text, in pieces that overlap by less than a window
            for p in range(low, high - LENGTH + 1, bytekit.CHUNK - LENGTH + 1):
                piece = data[p : min(p + bytekit.CHUNK, high)]
                row, at, most, fewest, prints = _anchors(piece, np.array([0, len(piece)]))
                yield row + a, at + (p - low), most, fewest, prints


def anchors(texts: DataFrame) -> DataFrame:
    """(id1, id2, place, print) for the anchors of (id1, id2, text); place packs anchor and offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytekit.texts(batch.column(2))
            for row, at, most, fewest, prints in _all_anchors(data, offsets):
                rows = pa.array(row)
                columns = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at << 16 | most << 8 | fewest), pa.array(prints.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=[*ID, "place", "print"])

    return texts.mapInArrow(trimmed(run), "id1 bigint, id2 bigint, place bigint, print bigint")


def records(located: DataFrame) -> DataFrame:
    """The bytes of all windows of an anchor, for (id1, id2, text, spots): the suffix, and what is in front, reversed.

    A spot is a place and, as its lowest bit, whether its lead is hot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, RECORD_TEXTS) for b in batches for i in range(0, b.num_rows, RECORD_TEXTS)):
            keys: list[list] = [[], [], [], []]
            after: list[bytes] = []
            front: list[bytes] = []
            for a, b, text, spots in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode()
                places = [spot >> 1 for spot in spots]
                for place in places:
                    at = place >> 16
                    after.append(raw[at : at + LENGTH - (place & 255)])
                    front.append(raw[at - (place >> 8 & 255) : at][::-1])
                keys[0] += [a] * len(places)
                keys[1] += [b] * len(places)
                keys[2] += places
                keys[3] += [spot & 1 for spot in spots]
            columns = [*(pa.array(k, pa.int64()) for k in keys[:3]), pa.array(keys[3], pa.int32()), pa.array(after, pa.binary()), pa.array(front, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*ID, "place", "hot", "suffix", "front"])

    return located.mapInArrow(trimmed(run), "id1 bigint, id2 bigint, place bigint, hot int, suffix binary, front binary")


def multikey_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of 64-bit words, and the bytes that each shares with the one before.

    A level sorts by one word, and only runs of rows that are still equal go on to the next.
    """
    n, depth = words.shape
    order, shared = np.arange(n), np.full(n, 8 * depth, np.int32)
    run, live = np.zeros(n, np.int64), np.arange(n) if n > 1 else np.zeros(0, np.int64)
    if n:
        shared[0] = 0
    for level in range(depth):
        if not len(live):
            break
        rows, runs = order[live], run[live]
        key = words[rows, level]
        sort = np.lexsort((key, runs))
        order[live], key = rows[sort], key[sort]
        same_run = np.concatenate(([False], runs[1:] == runs[:-1]))
        differ = same_run & np.concatenate(([False], key[1:] != key[:-1]))
        apart = np.flatnonzero(differ)
        difference = key[apart] ^ key[apart - 1]
        lead = np.zeros(len(apart), np.int32)
        for byte in range(1, 8):
            lead += (difference >> U64(64 - 8 * byte)) == 0
        shared[live[apart]] = 8 * level + lead
        begins = ~same_run | differ
        begin = np.flatnonzero(begins)
        run[live] = np.repeat(live[begin], np.diff(np.append(begin, len(live))))
        lone = begins & np.append(begins[1:], True)
        live = live[~lone]
    return order, shared


@lru_cache(maxsize=1)
def _tables() -> np.ndarray:
    """Random values of bytes: two tables for suffixes and two for what is in front of them."""
    return bytekit.stream(41, 4 * 256).reshape(4, 256)


def repeated_windows(suffixes: list[bytes], fronts: list[bytes], count: np.ndarray, before: int, after: int) -> tuple[np.ndarray, Iterator[tuple]]:
    """(records, STARTS) flags: the window at offset o of the record occurs elsewhere in the chunk; and border windows.

    `before` and `after` are the bytes that the first and last suffix may share with those outside
    the chunk. Border windows come as (fingerprint, fingerprint, record or -1 if repeated, offset)
    arrays by offset, each window once.
    """
    n = len(suffixes)
    words = np.frombuffer(b"".join(p.ljust(LENGTH, b"\0") for p in suffixes), ">u8").astype(U64).reshape(n, LENGTH // 8)
    ahead = np.frombuffer(b"".join(p.ljust(STARTS, b"\0") for p in fronts), np.uint8).reshape(n, STARTS)
    order, shared = multikey_order(words)
    most = np.array([len(p) for p in fronts])[order]
    fewest = LENGTH - np.array([len(p) for p in suffixes])[order]
    count, ahead = count[order], ahead[order]
    shared[0] = before
    reach = np.minimum.accumulate(shared)  # bytes shared with the suffix behind either border
    reach = np.maximum(reach, np.minimum.accumulate(np.append(shared[1:], after)[::-1])[::-1])

    values, up = bytekit.byte_values(False), bytekit.powers()[0]
    flags, front, borders = np.zeros((n, STARTS), bool), np.zeros(n, U64), []
    for o in range(STARTS):
        if o:
            front = front + values[ahead[:, o - 1]] * up[o]
        use = np.flatnonzero((fewest <= o) & (o <= most))
        if not len(use):
            continue
        run = np.cumsum(shared < LENGTH - o)[use].astype(U64)
        key = bytekit.mixed(front[use] + bytekit.mixed(run))
        sort = np.argsort(key)
        equal = key[sort][1:] == key[sort][:-1]
        twice = np.zeros(len(use), bool)
        twice[sort[1:]] |= equal
        twice[sort[:-1]] |= equal
        twice |= count[use] > 1
        flags[use, o] = twice
        open_ = reach[use] >= LENGTH - o
        if open_.any():
            known = use[open_ & twice][np.unique(key[open_ & twice], return_index=True)[1]]
            borders.append((o, use[open_ & ~twice], known))
    out = np.empty_like(flags)
    out[order] = flags

    def border_windows() -> Iterator[tuple]:
        """Fingerprints of 128 bits, from all bytes of a window; the prefix grows shorter as the offset grows."""
        rows = np.unique(np.concatenate([np.concatenate((lone, known)) for _, lone, known in borders]))
        texts, ahead_ = words[order[rows]].astype(">u8").view(np.uint8), ahead[rows]
        tables = _tables()
        prefix = [sum(t[texts[:, j]] * up[j] for j in range(LENGTH)) for t in tables[:2]]
        fronts_ = [np.zeros(len(rows), U64) for _ in range(2)]
        at = 0
        for o, lone, known in borders:
            while at < o:
                at += 1
                for k in range(2):
                    prefix[k] = prefix[k] - tables[k][texts[:, LENGTH - at]] * up[LENGTH - at]
                    fronts_[k] = fronts_[k] + tables[2 + k][ahead_[:, at - 1]] * up[at]
            own = np.searchsorted(rows, np.concatenate((lone, known)))
            prints = [bytekit.mixed(fronts_[k][own] + bytekit.mixed(prefix[k][own] + U64(o))) for k in range(2)]
            yield *prints, np.concatenate((order[lone], np.full(len(known), -1))), np.full(len(own), o)

    return out, border_windows() if borders else iter(())


def _marks(rows: list[tuple], before: int, after: int) -> Iterator[pa.RecordBatch]:
    suffixes, fronts, id1, id2, count = zip(*rows, strict=True)
    flags, borders = repeated_windows(list(suffixes), list(fronts), np.array(count), before, after)
    ids = [np.array(x, np.int64) for x in (id1, id2)]
    found = np.flatnonzero(flags.any(axis=1))
    bits = np.packbits(flags[found], axis=1, bitorder="little")
    size = len(found)
    columns = [pa.array(x[found]) for x in ids] + [pa.array([b.tobytes() for b in bits], pa.binary())]
    yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(size, t) for t in (pa.int64(), pa.int64(), pa.int32()))], names=MARKS)
    gathered, size = [], 0
    for part in chain(borders, [None]):
        if part is not None:
            gathered.append(part)
            size += len(part[0])
        if gathered and (part is None or size >= BORDER_ROWS):
            w1, w2, row, offset = (np.concatenate(x) for x in zip(*gathered, strict=True))
            known = row < 0
            columns = [pa.array(x[row], mask=known) for x in ids] + [pa.nulls(size, pa.binary()), pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(offset.astype(np.int32))], names=MARKS)
            gathered, size = [], 0


def _common(a: bytes, b: bytes) -> int:
    """Leading bytes that two suffixes share, each filled up with zeros to LENGTH."""
    differ = int.from_bytes(a.ljust(LENGTH, b"\0")) ^ int.from_bytes(b.ljust(LENGTH, b"\0"))
    return LENGTH - (differ.bit_length() + 7) // 8


MARKS = ["record1", "record2", "offsets", "w1", "w2", "offset"]


def marks(distinct: DataFrame) -> DataFrame:
    """(record1, record2, offsets, w1, w2, offset): a row with the offsets of repeated windows, a bit each, for
    records that have any, and a row with fingerprints for each border window (without record: repeated already).

    A bucket is streamed in its order, and no more than CHUNK_RECORDS of it are held. The first and
    last suffix of a bucket may have equals in the buckets beside it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        before = LENGTH
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(held) >= CHUNK_RECORDS or len(held) >= BUFFER and held[-1][0][:GRAM] != row[0][:GRAM]:
                    shared = _common(held[-1][0], row[0])
                    yield from _marks(held, before, shared)
                    held, before = [], shared
                held.append(row)
        if held:
            yield from _marks(held, before, LENGTH)

    further = [F.when(F.col("hot") == 1, F.col(c)) for c in ("suffix", "front")]
    buckets = distinct.repartitionByRange(F.substring("suffix", 1, GRAM), *further).sortWithinPartitions("suffix")
    return buckets.select("suffix", "front", "record1", "record2", "count").mapInArrow(trimmed(run), "record1 bigint, record2 bigint, offsets binary, w1 bigint, w2 bigint, offset int")


def _bits(found: DataFrame) -> DataFrame:
    """(record1, record2, offsets) with a bit for each of at most STARTS `found` offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = np.zeros((len(batch), STARTS), bool)
            for row, found in zip(flags, batch.column(2).to_pylist(), strict=True):
                row[found] = True
            bits = np.packbits(flags, axis=1, bitorder="little")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([b.tobytes() for b in bits], pa.binary())], names=MARKS[:3])

    return found.groupBy("record1", "record2").agg(F.collect_set("offset")).mapInArrow(trimmed(run), "record1 bigint, record2 bigint, offsets binary")


def repeated_records(distinct: DataFrame) -> DataFrame:
    """(record1, record2, offsets) of the repeated windows, found inside chunks and across their borders.

    A border window has at most one row a chunk, whatever number of texts has it.
    """
    marked = store(marks(distinct), "marks")
    border = marked.filter("w1 is not null")
    times = F.sum(F.when(F.col("record1").isNull(), 2).otherwise(1))
    common = store(border.groupBy("w1", "w2").agg(times.alias("n")).filter("n > 1").select("w1", "w2"), "border")
    lone = border.filter("record1 is not null").select("w1", "w2", "record1", "record2", "offset")
    across = _bits(lone.join(common, ["w1", "w2"], "left_semi"))
    return marked.filter("w1 is null").select("record1", "record2", "offsets").unionByName(across)


def repeats(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), as_text: bool = False) -> DataFrame:
    """(row, n_bytes, n_removed, n_spans, kept) for every row; `row` is a struct of `carry`.

    `kept` has the remaining bytes, or with `as_text` a string, without characters of which only a
    part remains.
    """
    digest = [F.xxhash64(F.col("text")).alias("id1"), F.xxhash64(F.lit(7), F.col("text")).alias("id2")]
    whole = docs.select(F.struct(*carry).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = whole.filter(F.octet_length("text") >= LENGTH).select(*digest, "text")

    every = store(anchors(texts), "anchors")
    # Written first: the join below then stands on two exchanges, and Spark can split a frequent print.
    common = store(every.groupBy("print").agg(F.count("*").alias("n")).filter("n > 1").select("print", (F.col("n") > HOT).cast("bigint").alias("hot")), "prints")
    spot = F.shiftleft("place", 1).bitwiseOR(F.col("hot")).alias("spot")
    spots = store(every.join(common, "print").select(*ID, spot).distinct().groupBy(*ID).agg(F.collect_list("spot").alias("spots")), "spots")

    located = texts.join(spots, ID).select(*ID, "text", "spots")
    sizes = [F.octet_length("suffix"), F.octet_length("front")]
    one = [F.xxhash64("suffix", "front", *sizes).alias("record1"), F.xxhash64(F.lit(7), "suffix", "front", *sizes).alias("record2")]
    found = store(records(located).select(*ID, "place", "hot", "suffix", "front", *one), "records")

    distinct = found.groupBy("suffix", "front", "record1", "record2", "hot").agg(F.count("*").alias("count"))
    marked = repeated_records(distinct)
    spans = (
        found.select(*ID, "place", "record1", "record2").distinct()
        .join(marked, ["record1", "record2"])
        .groupBy(*ID).agg(F.collect_list(F.struct("place", "offsets")).alias("spans"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, RECORD_TEXTS) for b in batches for i in range(0, b.num_rows, RECORD_TEXTS)):
            sizes, kept = [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = text.encode()
                gone = covered(len(raw), spans or ())
                if spans:
                    begins = gone & ~np.concatenate(([False], gone[:-1]))
                    sizes.append((len(raw), int(gone.sum()), int(begins.sum())))
                    kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
                else:
                    sizes.append((len(raw), 0, 0))
                    kept.append(raw)
            columns = [pa.array([s[i] for s in sizes], pa.int64()) for i in range(3)]
            left = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, left], names=["row", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = whole.select("row", "text", *digest).join(spans, ID, "left").select("row", "text", "spans")
    schema = T.StructType([whole.schema["row"], *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans"))])
    return joined.mapInArrow(trimmed(run), schema.add("kept", T.StringType() if as_text else T.BinaryType()))


def covered(n: int, spans) -> np.ndarray:
    """Flags of the bytes that the marked windows of a text of n bytes cover."""
    edges = np.zeros(n + 1, np.int32)
    for span in spans:
        offsets = np.flatnonzero(np.unpackbits(np.frombuffer(span["offsets"], np.uint8), bitorder="little"))
        starts = (span["place"] >> 16) - offsets
        edges[starts] += 1
        edges[starts + LENGTH] -= 1
    return np.cumsum(edges[:n]) > 0
