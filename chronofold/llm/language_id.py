"""Language identification by compression.

For each language a raw-content zstandard dictionary is made from a bounded sample of labelled text.
A text belongs to the language whose dictionary compresses it best; texts are compressed in blocks,
so that the dictionary counts throughout a long text, and the block sizes add up. A prediction whose
margin over the second language is narrow is kept but marked as rejected (`accepted` false).

Cases: null texts and texts without a letter are `und` with score 0; a null language is never
learned; with no labelled row everything is `und`; equal sizes go to the language first in order;
rows that repeat are judged one by one; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
DICT_BYTES = 110_000  # bound of a language's dictionary
SAMPLE_DOCS = 600  # bound of the documents that a dictionary is made from
SLICE_CHARS = 400  # characters that each of them gives at most
BLOCK_CHARS = 2048
MARGIN = 0.01  # smallest advantage over the second language, as a part of its size
LETTER = regex.compile(r"\p{L}")
LEVEL = {"window_log": 18, "hash_log": 16, "chain_log": 16, "search_log": 3, "min_match": 3, "strategy": zstandard.STRATEGY_LAZY2}
FRAME = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """A dictionary for each language, from at most SAMPLE_DOCS documents of it.

    Rows are thinned by a hash of the text at a rate that the counts give, so no language's rows meet
    in one place; what comes to the driver is bounded by languages x SAMPLE_DOCS x SLICE_CHARS.
    """
    rows = labelled.filter(F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    rates = F.create_map(*[x for name, n in counts.items() for x in (F.lit(name), F.lit(min(1.0, 1.5 * SAMPLE_DOCS / n)))])
    draw = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) / 1e6
    middle = F.greatest(F.lit(1), (F.length("text") / 2).cast("int") - SLICE_CHARS // 2)
    piece = F.substring("text", middle, F.lit(SLICE_CHARS))
    taken = rows.filter(draw < F.element_at(rates, F.col("lang"))).select("lang", piece.alias("piece"), F.xxhash64("text").alias("h"))
    pieces: dict[str, list[tuple[int, str]]] = {}
    for row in taken.distinct().collect():
        pieces.setdefault(row["lang"], []).append((row["h"], row["piece"]))
    return {name: "\n".join(p for _, p in sorted(own)[:SAMPLE_DOCS]).lower().encode()[-DICT_BYTES:] for name, own in sorted(pieces.items())}


class Judge:
    """Compressors for all languages and what they say of a text."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = list(dictionaries)
        self.compressors, level = [], zstandard.ZstdCompressionParameters(**LEVEL, **FRAME)
        for raw in dictionaries.values():
            content = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=level)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=content, compression_params=level))

    def sizes(self, text: str) -> list[int]:
        text = text.lower()
        blocks = [text[i : i + BLOCK_CHARS].encode() for i in range(0, len(text), BLOCK_CHARS)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.compressors]

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.names or not LETTER.search(text):
            return UNKNOWN, 0.0, False
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        score = 1 / sum(2.0 ** max(-60, sizes[best] - s) for s in sizes)
        second = min((s for i, s in enumerate(sizes) if i != best), default=math.inf)
        return self.names[best], score, second - sizes[best] >= MARGIN * second if second < math.inf else True


def predict(docs: DataFrame, dictionaries: dict[str, bytes], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, accepted) for every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Judge(dictionaries)
        for batch in batches:
            found = [own.judge(t) for t in batch.column(1).to_pylist()]
            columns = zip(*found, strict=True) if found else ((), (), ())
            arrays = [pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["key", "lang_pred", "score", "accepted"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, lang_pred string, score double, accepted boolean").withColumnRenamed("key", key)
