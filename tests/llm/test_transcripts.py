import random

import numpy as np
from common import odd_rows
from pyspark.sql import functions as F

from chronofold.llm import transcripts as t


def toy_model(seed=1):
    rnd = np.random.default_rng(seed)
    can_start, can_step = t.possible()
    start = np.log(np.where(can_start, rnd.random(t.N), 0) + 1e-300)
    step = np.log(np.where(can_step, rnd.random((t.N, t.N)), 0) + 1e-300)
    return t.Model(start, step, np.log(rnd.dirichlet(np.ones(t.SYMBOLS), t.N)))


def plain_viterbi(model, symbols):
    now, back = model.start + model.emit[:, symbols[0]], []
    for s in symbols[1:]:
        options = now[:, None] + model.step
        back.append(options.argmax(0))
        now = options.max(0) + model.emit[:, s]
    path = [int(now.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1], now.max()


def path_score(model, symbols, path):
    total = model.start[path[0]] + model.emit[path[0], symbols[0]]
    return total + sum(model.step[a, b] + model.emit[b, s] for a, b, s in zip(path, path[1:], symbols[1:]))


def test_blocks_give_the_viterbi_path(spark, monkeypatch):
    monkeypatch.setattr(t, "BLOCK", 3)  # several levels of blocks
    rnd, model = random.Random(5), toy_model()
    texts = {c: [rnd.choice(["User: hi?", "A: " + "long " * 30, "plain line", "", "[system] be kind", "why?"]) for _ in range(n)] for c, n in enumerate([1, 3, 4, 29, 100])}
    rows = [(c, i, line) for c, lines in texts.items() for i, line in enumerate(lines)]
    found = t.decode(spark.createDataFrame(rows, "conv_id bigint, at bigint, line string"), model).collect()
    index = {state: i for i, state in enumerate(t.STATES)}
    for c, lines in texts.items():
        symbols = [t.observe(x)[0] for x in lines]
        own = [index[r["role"], r["begins"]] for r in sorted(found, key=lambda r: r["at"]) if r["conv_id"] == c]
        assert len(own) == len(lines) and abs(path_score(model, symbols, own) - plain_viterbi(model, symbols)[1]) < 1e-6


def test_markers():
    kinds = lambda x: (t.observe(x)[0] // (4 * (len(t.LENGTHS) + 1)), t.observe(x)[1])
    assert kinds("User: hello") == (2, "hello")
    assert kinds("**Assistant:** hello") == (3, "hello")
    assert kinds("[system] x") == (1, "x") and kinds("Q> why") == (2, "why")
    assert kinds("userland is fine")[0] == 0 and kinds("a plain line")[0] == 0


def test_roles_of_held_out_conversations(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    known = t.lines_of(t.mark(turns.select("conv_id", "turn", "role", "text"))).cache()
    model = t.learn(known.filter("conv_id % 5 <> 0"))
    decoded = t.decode(known.select("conv_id", "at", "line"), model)
    both = decoded.select("conv_id", "at", F.col("role").alias("found"), F.col("begins").alias("opens")).join(known, ["conv_id", "at"]).filter("conv_id % 5 = 0")
    n, right = both.count(), both.filter("found = role").count()
    assert right > 0.94 * n
    assert known.count() == decoded.count()
    rendered = t.messages(decoded).filter("conv_id = 0").orderBy("message").collect()
    assert rendered[0]["rendered"].startswith("<|") and rendered[0]["rendered"].endswith("\n<|end|>\n")
    known.unpersist()


def test_lines_are_numbered_through_blocks(spark, monkeypatch):
    monkeypatch.setattr(t, "BLOCK", 2)
    rows = [(1, i, "user", "\n".join(f"{i}.{j}" for j in range(i % 4 + 1))) for i in range(11)]
    lines = t.lines_of(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).orderBy("at").collect()
    assert [r["at"] for r in lines] == list(range(len(lines)))
    assert [r["line"] for r in lines] == [x for row in rows for x in row[3].split("\n")]


def test_odd_rows_and_an_empty_table(spark):
    turns = odd_rows(spark).filter("doc_id is not null").dropDuplicates(["doc_id"]).select(F.lit(7).cast("bigint").alias("conv_id"), F.col("doc_id").alias("turn"), F.col("lang").alias("role"), "text", "a", "b")
    lines = t.lines_of(turns.select("conv_id", "turn", "role", "text"))
    decoded = t.decode(lines.select("conv_id", "at", "line"), t.learn(lines))
    assert decoded.count() == lines.count() and t.messages(decoded).count() >= 1
    assert t.decode(lines.limit(0).select("conv_id", "at", "line"), toy_model()).count() == 0
