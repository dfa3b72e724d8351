"""Byte-level BPE encoding and decoding by forced-boundary splitting.

A merge joins two neighbouring tokens into a token that contains their border, so two bytes that are
neighbours inside no token of the vocabulary can never be joined: between them a cut is certain.
Every pre-token is split at its certain cuts, each fragment is merged on its own, and the ids are
concatenated. Fragments repeat across a corpus, so a bounded memo of them saves most merges.

Cases: a null text is an empty one (no ids); the strings of added tokens inside a text become their
ids, as the tokenizer file says; very long words cost n log n; rows that repeat are encoded one by
one; the input's other columns are passed over.
"""

from __future__ import annotations

import heapq
import json
import os
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .shared import trimmed

FOLDER = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.json"

# Fixed value: the published pre-token pattern of byte-level BPE, with Unicode's property for white
# space and the most frequent alternatives first (only a quote can begin the short endings).
PATTERN = (
    r" ?\p{L}+| ?\p{N}+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
MEMO = 500_000  # words and pre-tokens that a worker remembers, of at most MEMO_CHARS characters each
MEMO_CHARS = 64
SHORT = 32  # bytes up to which scanning for the next merge beats a queue; the ids are the same
NONE, GONE = 1 << 60, -1


def vocabulary_path(name: str = VOCABULARY, folder: str = FOLDER) -> str:
    return os.path.join(folder, name)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Vocabulary, merge ranks, certain cuts, and a memo of encoded pre-tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        as_bytes = lambda word: bytes(letters[c] for c in word)
        self.ids = {as_bytes(word): i for word, i in spec["model"]["vocab"].items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        merges = [(as_bytes(a), as_bytes(b)) for a, b in pairs]
        self.pair_ranks = {(self.ids[a], self.ids[b]): rank for rank, (a, b) in enumerate(merges)}
        self.made = [self.ids[a + b] for a, b in merges]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.by_id = {i: word for word, i in self.ids.items()} | {i: text.encode() for text, i in self.added.items()}
        inside = np.zeros(1 << 16, bool)
        for word in self.ids:
            raw = np.frombuffer(word, np.uint8).astype(np.uint16)
            inside[(raw[:-1] << 8) | raw[1:]] = True
        self.joined = {divmod(pair, 256) for pair in np.flatnonzero(inside).tolist()}
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.find = regex.compile(PATTERN).findall
        self.uneven = regex.compile(r" (?:\p{White_Space}|\Z)").search
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def fragments(self, raw: bytes) -> list[bytes]:
        """The pieces of `raw` between certain cuts."""
        joined = self.joined
        cuts = [at for at, pair in enumerate(zip(raw, raw[1:]), 1) if pair not in joined]
        return [raw[i:j] for i, j in zip([0, *cuts], [*cuts, len(raw)])] if cuts else [raw]

    def merge(self, raw: bytes) -> list[int]:
        """Merges of one fragment, lowest rank first and leftmost among equals."""
        if len(raw) > SHORT:
            return self.merge_long(raw)
        ranks, made = self.pair_ranks.get, self.made
        parts = [self.single[b] for b in raw]
        waiting = [ranks(pair, NONE) for pair in zip(parts, parts[1:])]
        while waiting and (rank := min(waiting)) != NONE:
            at = waiting.index(rank)
            parts[at] = made[rank]
            del parts[at + 1], waiting[at]
            if at:
                waiting[at - 1] = ranks((parts[at - 1], parts[at]), NONE)
            if at < len(waiting):
                waiting[at] = ranks((parts[at], parts[at + 1]), NONE)
        return parts

    def merge_long(self, raw: bytes) -> list[int]:
        """The same merges from a queue, so that a long fragment costs n log n."""
        parts: list[int] = [self.ids[raw[i : i + 1]] for i in range(len(raw))]
        after, before = list(range(1, len(raw) + 1)), list(range(-1, len(raw) - 1))
        ranks, queue = self.pair_ranks, []

        def offer(at: int) -> None:
            to = after[at]
            if to < len(parts) and (rank := ranks.get((parts[at], parts[to]))) is not None:
                heapq.heappush(queue, (rank, at, parts[at], parts[to]))

        for at in range(len(parts) - 1):
            offer(at)
        while queue:
            rank, at, left, right = heapq.heappop(queue)
            to = after[at]
            if parts[at] != left or to >= len(parts) or parts[to] != right:
                continue  # one side has since grown
            parts[at], parts[to] = self.made[rank], GONE
            after[at] = after[to]
            if after[at] < len(parts):
                before[after[at]] = at
            offer(at)
            if before[at] >= 0:
                offer(before[at])
        return [part for part in parts if part != GONE]

    def pre_token(self, piece: str) -> bytes:
        if (known := self.pieces.get(piece)) is not None:
            return known
        ids = [i for fragment in self.fragments(piece.encode()) for i in self.merge(fragment)]
        return self.remember(self.pieces, piece, struct.pack(f"<{len(ids)}I", *ids))

    def run(self, text: str) -> bytes:
        """Ids of a text without added tokens, by its pre-tokens."""
        return b"".join(map(self.pre_token, self.find(text)))

    def word(self, word: str) -> bytes:
        return self.remember(self.words, word, self.run(f" {word}"))

    @staticmethod
    def remember(memo: dict[str, bytes], key: str, packed: bytes) -> bytes:
        if len(key) <= MEMO_CHARS:
            if len(memo) >= MEMO:
                memo.clear()
            memo[key] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers.

        In front of a space that a word follows a pre-token always begins, so such words stand alone.
        """
        known, out = self.words.get, []
        for part in self.splitter.split(text) if self.splitter else (text,):
            if part in self.added:
                out.append(struct.pack("<I", self.added[part]))
            elif self.uneven(part):
                out.append(self.run(part))
            else:
                first, *words = part.split(" ")
                out.append(self.run(first))
                out.extend([known(word) or self.word(word) for word in words])
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        """The text of packed ids; ids that no token has stand for nothing."""
        words = self.by_id.get
        return b"".join(words(i, b"") for i in np.frombuffer(packed, "<u4").tolist()).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for each worker process and file."""
    return Codec(path)


def encode(
    docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, then: Callable[[Codec, bytes], tuple] | None = None, schema: str = ""
) -> DataFrame:
    """(key, n_tokens, token_bytes): ids as little-endian unsigned 32-bit integers.

    `then(codec, ids)` may give other columns, of `schema`, in place of token_bytes.
    """
    path = path or vocabulary_path()
    kind = docs.schema[key].dataType.simpleString()
    fields = T.StructType.fromDDL(schema) if then else T.StructType.fromDDL("token_bytes binary")
    made = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            packed = [own.encode(t or "") for t in batch.column(1).to_pylist()]
            rows = [then(own, p) if then else (p,) for p in packed]
            columns = [pa.array([row[i] for row in rows], field.type) for i, field in enumerate(made)]
            counts = pa.array([len(p) // 4 for p in packed], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, *columns], names=["key", "n_tokens", *made.names])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(trimmed(run), f"key {kind}, n_tokens bigint, {schema or 'token_bytes binary'}").withColumnRenamed("key", key)


def decode(rows: DataFrame, key: str = "doc_id", path: str | None = None) -> DataFrame:
    """(key, n_tokens, token_bytes, text) with the text that the ids stand for."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = pa.array([own.decode(p or b"") for p in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=["key", "n_tokens", "token_bytes", "text"])

    kind = rows.schema[key].dataType.simpleString()
    slim = rows.select(F.col(key).alias("key"), "n_tokens", "token_bytes")
    return slim.mapInArrow(trimmed(run), f"key {kind}, n_tokens bigint, token_bytes binary, text string").withColumnRenamed("key", key)


def ids_array(column: str = "token_bytes"):
    """Packed ids as array<int>."""
    at = "i * 8 + 1"
    word = f"substr(hex({column}), {at} + 6, 2) || substr(hex({column}), {at} + 4, 2) || substr(hex({column}), {at} + 2, 2) || substr(hex({column}), {at}, 2)"
    return F.expr(f"transform(sequence(0, cast(length({column}) / 4 as int) - 1, 1), i -> cast(conv({word}, 16, 10) as int))")
