"""The corpus pipeline over `documents`: each stage is one corpus operator and takes effect on the rows.

A stage takes (spark, docs, sf_dir) and gives the columns of documents back; the last one gives
token rows. Between stages the rows are written and read again, so a lost executor costs one stage at
most. Cases follow the operators: null and empty texts pass every stage (they are neither toxic nor
near copies nor contaminated), rows that repeat are treated each (of equal keys and texts with a word,
near_dedup keeps one; of other texts under their key none goes with them), a very long text is
treated whole, an empty table stays empty, and columns beyond those of documents are dropped at the first
stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import bpe, decontamination, near_dedup, substring_dedup, toxicity
from chronofold.llm.queries import ORACLES as OPERATOR_SQL
from chronofold.llm.queries import QUERIES as OPERATORS
from chronofold.llm.shared import store

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
NEAR_PERCENT = 80  # similarity of word shingles from which the near_dedup stage takes two documents for copies


def _without(docs: DataFrame, keys: DataFrame, *names: str) -> DataFrame:
    """Rows whose `names` are not among `keys`; both grow with the corpus, so neither is broadcast."""
    return docs.join(keys.hint("merge"), list(names), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.learn(docs.select("doc_id", "text"), labels)
    return toxicity.keep(docs.select(*COLUMNS), model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, from NEAR_PERCENT on, stays: the one with the smallest key and digest.

    Rows are told apart by key and digest of the text, and of rows equal in both one stays.
    """
    docs = docs.select(*COLUMNS, F.sha2("text", 256).alias("digest"))
    groups = near_dedup.groups(docs.select("doc_id", "text", "digest"), percent=NEAR_PERCENT, carry="digest")
    linked = groups.filter("component is not null").groupBy("component", "doc_id", "digest").agg(F.count("*").alias("n"))
    placed = store(linked, "copies")
    stays = placed.groupBy("component").agg(F.min(F.struct("doc_id", "digest")).alias("stays"))
    fate = placed.join(stays, "component").withColumn("goes", F.struct("doc_id", "digest") != F.col("stays"))
    fate = store(fate.filter("goes or n > 1").select("doc_id", "digest", "goes"), "fate")
    rest = _without(docs, fate.filter("goes").select("doc_id", "digest"), "doc_id", "digest")
    twice = fate.filter("not goes").select("doc_id", "digest")
    if not twice.head(1):
        return rest.select(*COLUMNS)
    others = F.struct("lang", "source", "n_chars", "text")
    one = rest.join(twice.hint("merge"), ["doc_id", "digest"], "left_semi").groupBy("doc_id", "digest").agg(F.min(others).alias("row"))
    return _without(rest, twice, "doc_id", "digest").select(*COLUMNS).union(one.select("doc_id", "row.text", "row.lang", "row.source", "row.n_chars"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose passages that occur elsewhere too; n_chars follows."""
    left = substring_dedup.repeats(
        docs.withColumn("empty", F.col("text").isNull()), carry=("doc_id", "lang", "source", "n_chars", "empty"), as_text=True
    )
    text = F.when(~F.col("row.empty"), F.col("kept"))
    changed = F.when(F.col("n_removed") > 0, F.length("kept").cast("bigint")).otherwise(F.col("row.n_chars"))
    return left.select("row.doc_id", text.alias("text"), "row.lang", "row.source", changed.alias("n_chars"))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = decontamination.matches(docs.select("doc_id", "text"), benchmark)
    return _without(docs, store(found.select("doc_id").distinct(), "leaks"), "doc_id").select(*COLUMNS)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text: (doc_id, n_tokens, token_bytes, n_decoded), ids as little-endian 32-bit integers."""
    return bpe.encode(
        docs.select("doc_id", "text"), then=lambda codec, ids: (ids, len(codec.decode(ids))), schema="token_bytes binary, n_decoded bigint"
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", drop_benchmark_passages),
    ("tokens", to_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


ORACLE_SQL = None

QUERIES = OPERATORS | {"pipeline": run}
ORACLES = dict(OPERATOR_SQL)
