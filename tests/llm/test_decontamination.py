import random
from collections import Counter

from common import WORD, lower, odd_rows

from chronofold.llm import decontamination


def bag(words):
    width = min(5, len(words))
    return Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(docs, items, percent=80):
    out = {}
    items = {i: WORD.findall(lower(t)) for i, t in items}
    known = {g for w in items.values() if w for g in bag(w)}
    for key, text in docs:
        words = WORD.findall(lower(text))
        for item, own in items.items():
            n = len(own)
            if not n or key is None:
                continue
            target = bag(own)
            for s in range(len(words) - n + 1):
                width = min(5, n)
                if not any(tuple(words[s + d : s + d + width]) in known for d in range(0, n - width + 1, max(1, (n - width) // 2))):
                    continue
                window = bag(words[s : s + n])
                low = sum((target & window).values())
                if 100 * low >= percent * sum((target | window).values()):
                    out[(key, item)] = max(out.get((key, item), 0), low / sum((target | window).values()))
    return out


def found(df):
    return {(r["doc_id"], r["item_id"]): r["similarity"] for r in df.collect()}


def test_exact_and_edited_passages(spark):
    rnd = random.Random(4)
    word = lambda: rnd.choice(["the", "of", f"w{rnd.randrange(3000)}"])
    items = [(i, " ".join(word() for _ in range(rnd.randrange(3, 80)))) for i in range(40)] + [(99, None), (98, ""), (97, "alone")]
    docs = []
    for i in range(120):
        words = [word() for _ in range(rnd.randrange(5, 300))]
        for _ in range(rnd.randrange(3)):
            passage = rnd.choice(items)[1]
            passage = (passage or "").split()
            if passage and rnd.random() < 0.5:
                passage[rnd.randrange(len(passage))] = "changed"
            at = rnd.randrange(len(words))
            words[at:at] = passage
        docs.append((i, " ".join(words)))
    schema = "{} bigint, text string"
    result = decontamination.matches(spark.createDataFrame(docs, schema.format("doc_id")), spark.createDataFrame(items, schema.format("item_id")))
    expected = brute(docs, items)
    assert len(expected) > 60
    assert {k: round(v, 9) for k, v in found(result).items()} == {k: round(v, 9) for k, v in expected.items()}


def test_documents_of_the_smallest_scale(spark, directory):
    docs, items = (spark.read.parquet(f"{directory}/{n}.parquet") for n in ("documents", "benchmark"))
    plain = lambda df: [tuple(r) for r in df.collect()]
    expected = brute(plain(docs.select("doc_id", "text")), plain(items.select("item_id", "text")))
    assert found(decontamination.matches(docs, items)).keys() == expected.keys()


def test_odd_rows_and_empty_tables(spark):
    rows = odd_rows(spark)
    items = rows.selectExpr("doc_id as item_id", "text", "key", "a")
    pairs = found(decontamination.matches(rows, items))
    assert pairs[(3, 3)] == 1.0 and all(k is not None for k in pairs)
    assert decontamination.matches(rows.limit(0), items).count() == 0
    assert decontamination.matches(rows, items.limit(0)).count() == 0
