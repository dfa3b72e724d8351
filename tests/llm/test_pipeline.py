import hashlib

import corpus_pipeline
import pytest
from common import odd_rows, shingles
from pyspark.sql import functions as F

from chronofold.llm import bpe, decontamination, near_dedup, substring_dedup

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.store(stage(spark, docs, SF), name)
        out.append((name, before, docs))
    return {name: (before, after) for name, before, after in out}


def keys(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_stages_keep_the_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == list(stages)
    for name, (_, after) in stages.items():
        if name != "tokens":
            assert tuple(after.columns) == corpus_pipeline.COLUMNS


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    before, after = stages["toxicity"]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = keys(before) - keys(after)
    assert sum(labels.get(k) == 0 for k in gone) <= 3
    assert sum(t == 1 and k in gone for k, t in labels.items()) >= 0.9 * sum(labels.values())


def test_one_of_each_group_stays(stages):
    before, after = stages["near_dedup"]
    kept = keys(near_dedup.groups(before, percent=corpus_pipeline.NEAR_PERCENT).filter("kept"))
    assert keys(after) == kept and len(kept) < before.count()


def test_repeated_passages_are_cut(stages):
    before, after = stages["substring_dedup"]
    assert before.count() == after.count()
    lengths = {r["row"]["doc_id"]: (r["n_removed"], r["n_bytes"]) for r in substring_dedup.repeats(before).collect()}
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in after.collect():
        removed, size = lengths[r["doc_id"]]
        assert (r["text"] == texts[r["doc_id"]]) if not removed else size - removed - 6 <= len(r["text"].encode()) + 6 * 10
    assert sum(n for n, _ in lengths.values()) > 0


def test_leaks_go(spark, stages):
    before, after = stages["decontamination"]
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    leaks = keys(decontamination.matches(before, benchmark))
    assert leaks and keys(before) - keys(after) == leaks
    items = [r["text"] for r in benchmark.collect()]
    left = set().union(*(shingles(r["text"]) for r in after.collect()))
    assert sum(len(shingles(t) & left) == len(shingles(t)) for t in items) == 0


def test_tokens_decode_to_the_texts(stages):
    before, after = stages["tokens"]
    codec = bpe.codec(bpe.vocabulary_path())
    found = {r["doc_id"]: (r["n_tokens"], codec.decode(bytes(r["token_bytes"]))) for r in after.collect()}
    for r in before.collect():
        n, text = found[r["doc_id"]]
        assert text == (r["text"] or "") and hashlib.sha256(text.encode())


def test_odd_rows_pass_every_stage(spark):
    docs = odd_rows(spark).withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("bigint")})
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.store(stage(spark, docs, SF), name)
    assert {0, 1, 2, 3, 4} <= keys(docs) and None in keys(docs)
    empty = odd_rows(spark).withColumns({"source": F.lit("s"), "n_chars": F.lit(1).cast("bigint")}).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = corpus_pipeline.store(stage(spark, empty, SF), name)
    assert empty.count() == 0
