import math
import random

from common import odd_rows

from chronofold.llm import toxicity


def corpus(n, seed=3):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(["on", "the", "ra", "lo", "mi", "st", "en"]) for _ in range(rnd.randrange(1, 4)))
    texts, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rnd.randrange(20, 200))]
        if i % 3 == 0:
            for _ in range(4):
                words.insert(rnd.randrange(len(words)), rnd.choice(["idiot", "moron", "worthless", "disgusting"]))
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    return texts, labels


def test_unseen_misspellings_are_near_and_runs_count_once():
    texts, labels = corpus(240)
    model = toxicity.train(texts, labels)
    rest = "the raloen ston enmi rami lostra onthe miloen " * 4
    found = toxicity.scores(model, [rest, rest + " idiiot worthlesss", "moron", "", "ra " * 500, " \n"])
    assert found[0] < 0.5 and found[1] >= 0.5 and found[2] >= 0.5 and found[3] == found[5] == 0
    assert abs(found[4] - toxicity.scores(model, ["ra"])[0]) < 1e-9
    test, truth = corpus(90, 11)
    assert sum((s >= 0.5) == bool(t) for s, t in zip(toxicity.scores(model, test), truth)) >= 86


def test_a_text_scores_the_same_alone_and_among_others():
    texts, labels = corpus(60)
    model = toxicity.train(texts, labels)
    together = toxicity.scores(model, texts)
    assert max(abs(a - toxicity.scores(model, [t])[0]) for a, t in zip(together, texts)) < 1e-9


def test_odd_rows_and_empty_tables(spark):
    rows = odd_rows(spark)
    labels = rows.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic", "key", "text")
    model = toxicity.learn(rows, labels)
    found = toxicity.score(rows, model).collect()
    assert len(found) == 13 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    nothing = toxicity.learn(rows, labels.limit(0))
    assert {r["predicted"] for r in toxicity.score(rows, nothing).collect()} == {0}
    assert toxicity.score(rows.limit(0), model).count() == 0 and toxicity.keep(rows, nothing).count() == 13


def plain_score(model, text):
    """The best window by loops over words and characters."""
    every = text.lower().split()
    words = [w for w, before in zip(every, [None, *every]) if w != before]
    if not words:
        return 0.0
    sums, sizes = [], []
    for word in words:
        padded, total, n = f" {word} ", 0.0, 0
        for size in toxicity.GRAMS:
            for at in range(len(padded) - size + 1):
                h = size
                for c in padded[at : at + size]:
                    h = (h * 0x100000001B3 + ord(c)) % 2**64
                h = ((h ^ (h >> 31)) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - toxicity.BUCKET_BITS)
                total, n = total + model.bucket_logits[h], n + 1
        sums.append(total)
        sizes.append(n)
    half, best = toxicity.WINDOW // 2, -math.inf
    for low in range(0, max(1, len(words) - half), half):
        n = sum(sizes[low : low + toxicity.WINDOW])
        if n:
            best = max(best, sum(sums[low : low + toxicity.WINDOW]) / (n + toxicity.NEUTRAL))
    return 1 / (1 + math.exp(-(best + model.bias))) if best > -math.inf else 0.0


def test_scores_against_plain_windows():
    texts, labels = corpus(120)
    model = toxicity.train(texts, labels)
    rnd = random.Random(2)
    odd = ["", "a", "a a a", "x y", "Ünï cödé words", "on " * 7 + "idiot", *(" ".join(rnd.choices("on the ra idiot moron lo".split(), k=k)) for k in (7, 8, 9, 15, 16, 17, 24, 25, 33, 100))]
    for text, score in zip(texts + odd, toxicity.scores(model, texts + odd), strict=True):
        assert abs(score - plain_score(model, text)) < 1e-9, text


def test_the_sample_is_bounded_and_labels_learn(spark, monkeypatch):
    texts, labels = corpus(240)
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, "another text under one key")] * 5 + [(1, "long " * 40000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, label) for i, label in enumerate(labels)] * 2, "doc_id bigint, toxic int")
    model = toxicity.learn(docs, marks)
    found = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs.limit(240), model).collect()}
    assert sum(found[i] == label for i, label in enumerate(labels)) >= 230
    seen = []
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 20_000)
    for r in toxicity.sample(docs, marks).collect():
        seen.append((r["label"], len(r["text"])))
    for label in (0, 1):
        total = sum(n for mark, n in seen if mark == label)
        assert 10_000 < total <= 20_000
