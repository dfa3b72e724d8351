import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from common import odd_rows

from chronofold.llm import ngram_quality as q


def plain_model(texts):
    """p(character | context) of interpolated modified Kneser-Ney, by recursion over dictionaries."""
    grams = Counter()
    for t in texts:
        s = q.START * (q.ORDER - 1) + t + q.END
        grams.update(s[i - q.ORDER + 1 : i + 1] for i in range(q.ORDER - 1, len(s)))
    counts = {q.ORDER: grams}
    for k in range(q.ORDER - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discounts, totals, kinds = {}, {}, {}
    for k, table in counts.items():
        n = Counter(min(c, 5) for c in table.values())
        if not n[1] or not n[2]:
            d = [0.5, 0.5, 0.5]
        else:
            y = n[1] / (n[1] + 2 * n[2])
            d = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
        discounts[k] = [min(max(x, 0.05), i - 0.05) for i, x in zip((1, 2, 3), d)]
        totals[k], kinds[k] = Counter(), defaultdict(list)
        for g, c in table.items():
            totals[k][g[:-1]] += c
            kinds[k][g[:-1]].append(c)

    def p(k, gram):
        if k == 0:
            return 1 / (len(counts[1]) + 1)
        context = gram[:-1]
        if context not in totals[k]:
            return p(k - 1, gram[1:])
        d = lambda c: discounts[k][min(c, 3) - 1]
        c = counts[k].get(gram, 0)
        gamma = sum(map(d, kinds[k][context])) / totals[k][context]
        return (c - d(c) if c else 0) / totals[k][context] + gamma * p(k - 1, gram[1:])

    return p


def plain_perplexity(p, text):
    s = q.START * (q.ORDER - 1) + text + q.END
    logs = [math.log(p(q.ORDER, s[i - q.ORDER + 1 : i + 1])) for i in range(q.ORDER - 1, len(s))]
    return math.exp(-sum(logs) / len(logs))


TEXTS = ["the cat sat on the mat", "the dog sat on a log", "aaaa", "été à la plage", "日本 語", "the cat ate the dog", ""]


@pytest.mark.parametrize("rows", [1 << 21, 40])
def test_perplexity_equals_a_plain_model_with_one_shard_or_many(spark, monkeypatch, rows):
    monkeypatch.setattr(q, "SHARD_ROWS", rows)
    q._shard.cache_clear()
    schema = "doc_id bigint, text string"
    path, shards = q.shard(q.model(q.count(spark.createDataFrame(list(enumerate(TEXTS)), schema))))
    assert (shards > 3) == (rows == 40)
    p = plain_model([t for t in TEXTS if t])
    asked = TEXTS + ["the unknown ☃ thing", "zzzz", "mat", None]
    found = q.score(spark.createDataFrame(list(enumerate(asked)), schema), path, shards, ("doc_id",)).collect()
    for r in found:
        text = asked[r["row"]["doc_id"]]
        assert r["perplexity"] == (pytest.approx(plain_perplexity(p, text), rel=1e-4) if text else None)


def test_probabilities_sum_to_one():
    p = plain_model(TEXTS)
    letters = {c for t in TEXTS for c in t} | {q.END}
    for context in ("the ", "zzzz", q.START * 4):
        assert sum(p(q.ORDER, context + c) for c in letters) + p(q.ORDER, context + "☃") == pytest.approx(1)


def test_keys_of_strings_and_places_agree():
    codes, place, _ = q.sequence(["abcdefg", "xyz"])
    keys = q.keys_by_order(codes)
    assert (q.gram_keys(["abcde", "g" + q.END, "y"]) == np.array([keys[5][place[4]], keys[2][place[7]], keys[1][place[9]]])).all()


def test_clean_documents_stay_and_noise_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    noise = spark.createDataFrame([(-1, "%$#& {}|<> @@@ \\\\ ~~~ " * 40, "en"), (-2, "qzxj vkqw xxzq jjqz " * 30, "fr")], "doc_id bigint, text string, lang string")
    rows = q.judge(docs.select("doc_id", "text", "lang").unionByName(noise), labels.filter("quality = 1"))
    found = {r["doc_id"]: r["kept"] for r in rows.collect()}
    good = [r["doc_id"] for r in labels.filter("quality = 1").collect()]
    assert not found[-1] and not found[-2]
    assert sum(found[k] for k in good) >= 0.99 * len(good)


def test_odd_rows_and_empty_tables(spark):
    rows = odd_rows(spark)
    found = q.judge(rows, rows.filter("doc_id > 3")).collect()
    assert len(found) == 13
    assert all(r["kept"] is False and r["perplexity"] is None for r in found if r["doc_id"] in (0, 1))
    assert all(r["kept"] for r in q.judge(rows, rows.limit(0)).collect() if r["perplexity"] is not None)
    assert q.judge(rows.limit(0), rows).count() == 0
