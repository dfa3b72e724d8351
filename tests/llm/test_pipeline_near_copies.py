import hashlib
import random

import corpus_pipeline
from common import shingles
from pyspark.sql import functions as F

from chronofold.llm import near_dedup


def planted(n_pairs):
    """Pairs of texts that share 0.80 to 0.85 of their shingles, and pairs just below 0.80."""
    rnd, rows, above, below = random.Random(8), [], [], []
    for i in range(n_pairs):
        base = [f"w{rnd.randrange(10**7)}" for _ in range(94)]  # 90 shingles; k changed at the end give (90 - k) / (90 + k)
        cut = (8, 9, 10, 11)[i % 4]
        other = base[: len(base) - cut] + [f"x{rnd.randrange(10**7)}" for _ in range(cut)]
        a, b = " ".join(base), " ".join(other)
        shared = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
        assert shared < 0.85
        (above if shared >= 0.8 else below).append(2 * i + 1)
        rows += [(2 * i, a), (2 * i + 1, b)]
    return rows, above, below


def test_pairs_between_80_and_85_percent_are_copies_in_the_stage(spark):
    rows, above, below = planted(200)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("bigint")})
    left = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "unused").collect()}
    assert {k for k, _ in rows} - left == set(above) and above and below


def test_rows_that_share_a_key_are_told_apart(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")

    def left(rows):
        docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
        return sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs, "unused").collect())

    assert left([(1, a), (5, a), (5, c)]) == [(1, a), (5, c)]  # a unique text isn't dropped with its namesake
    assert left([(1, a), (1, a), (2, a)]) == [(1, a)]
    assert left([(5, a), (5, b), (7, b), (8, c), (8, c + " end")]) == [(5, a), (5, b), (8, min(c, c + " end", key=digest))]
    assert left([(1, ""), (1, ""), (2, " ")]) == [(1, ""), (1, ""), (2, " ")]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_keys_may_be_texts(spark):
    rows = [("x2", "one two three four five six"), ("x1", "one two three four five six"), ("y", "something else that is here now")]
    found = near_dedup.groups(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in found} == {("x1", "x1", True), ("x2", "x1", False), ("y", "y", True)}


def test_bands_follow_the_threshold():
    for percent in (80, 85, 90, 95):
        assert (1 - (percent / 100) ** near_dedup.ROWS) ** near_dedup.bands_for(percent) <= near_dedup.MISS
    assert near_dedup.bands_for(85) == 16 < near_dedup.bands_for(80)
