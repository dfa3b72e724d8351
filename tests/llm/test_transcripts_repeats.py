from common import odd_rows
from pyspark.sql import functions as F

from chronofold.llm import queries
from chronofold.llm import transcripts as t


def test_repeated_turns_and_nulls_keep_every_line(spark, tmp_path):
    rows = [(c, n, "user", f"line {n}\nmore") for c in (1, None) for n in (0, 0, 1, 2, 2, 300)]
    rows += [(1, None, "user", "no turn"), (1, 1, "assistant", "another of turn 1"), (2, None, None, None), (None, None, "user", "a\nb")]
    odd = odd_rows(spark).select(F.lit(7).cast("bigint").alias("conv_id"), F.col("doc_id").alias("turn"), F.lit("user").alias("role"), "text")
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").union(odd)
    lines = t.lines_of(turns).collect()
    assert len(lines) == sum(len((r["text"] or "").split("\n")) for r in turns.collect())
    for c in (1, 2, 7, None):
        own = sorted((r for r in lines if r["conv_id"] == c), key=lambda r: r["at"])
        assert [r["at"] for r in own] == list(range(len(own))) and own
        order = [-1 if r["turn"] is None else r["turn"] for r in own]
        assert order == sorted(order)
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r["conv_id"]: r["n_lines"] for r in queries.op5_chat(spark, str(tmp_path)).collect()}
    assert found == {c: sum(r["conv_id"] == c for r in lines) for c in (1, 2, 7, None)}
