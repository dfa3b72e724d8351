import random

from common import linked_groups, odd_rows

from chronofold.llm import near_dedup


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_groups_equal_all_pairs_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    result = near_dedup.groups(docs)
    assert found(result) == linked_groups(rows)
    assert result.filter("kept <> (doc_id = component_id)").count() == 0


def test_a_family_without_its_base_is_joined_through_others(spark):
    rnd = random.Random(1)
    base = [f"w{rnd.randrange(400)}" for _ in range(300)]
    rows = []
    for i in range(60):  # each copy has two edits of its own, so two copies share about 0.88
        words = list(base)
        for _ in range(2 + i % 3):
            words[rnd.randrange(300)] = f"edit{rnd.randrange(10**6)}"
        rows.append((1000 - i, " ".join(words)))
    rows += [(5000 + i, " ".join(f"u{rnd.randrange(10**6)}" for _ in range(80))) for i in range(40)]
    assert found(near_dedup.groups(spark.createDataFrame(rows, "doc_id bigint, text string"))) == linked_groups(rows)


def test_components_of_a_long_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(70)] + [(200, 200 + i) for i in range(1, 30)] + [(5, 5)]
    roots = near_dedup.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {r["node"]: r["root"] for r in roots} == {i: 0 for i in range(1, 71)} | {200 + i: 200 for i in range(1, 30)}


def test_pages_of_one_template(spark):
    rnd = random.Random(6)
    frame = [f"t{i}" for i in range(300)]

    def page():  # about 0.57 of the shingles are the template's
        return " ".join(frame[:150] + [f"u{rnd.randrange(10**9)}" for _ in range(110)] + frame[150:])

    rows = [(i, page()) for i in range(400)]
    rows += [(1000 + i, " ".join((t.split() + ["more"]))) for i, (_, t) in enumerate(rows[:40])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(near_dedup.groups(docs)) == linked_groups(rows)


def test_odd_rows(spark):
    rows = near_dedup.groups(odd_rows(spark)).collect()
    assert len(rows) == 13
    assert all(r["component_id"] == r["doc_id"] and r["kept"] for r in rows if r["n_shingles"] == 0 or r["doc_id"] is None)
    assert [r["n_shingles"] for r in rows if r["doc_id"] == 3] == [1, 1]


def test_an_empty_table(spark):
    assert near_dedup.groups(odd_rows(spark).limit(0)).count() == 0
