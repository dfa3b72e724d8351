import random

from test_decontamination import brute, found

from chronofold.llm import decontamination


def test_passages_cut_or_edited_down_to_the_threshold(spark):
    rnd = random.Random(11)
    new = lambda n: [f"w{rnd.randrange(10**8)}" for _ in range(n)]
    items, docs = [], []
    for i in range(240):
        size, less = ((13, 1), (22, 2), (58, 6), (130, 10))[i % 4]  # the last two reach exactly 0.8
        own = new(size)
        items.append((i, " ".join(own)))
        if size == 130:  # a run of inner words is replaced
            docs.append((i, new(3) + own[:60] + new(less) + own[60 + less :] + new(3)))
        elif i % 3 == 0:  # cut at both ends
            docs.append((i, new(9) + own[less // 2 : size - (less - less // 2)] + new(9)))
        elif i % 3 == 1:  # at the start of the document: one window reaches the threshold
            docs.append((i, own[less:] + new(less)))
        else:
            docs.append((i, new(less) + own[: size - less]))
    docs = [(i, " ".join(words)) for i, words in docs] + [(1000, " ".join(new(100)))]
    expected = {k: v for i in range(240) for k, v in brute([docs[i]], [items[i]]).items()}  # words are all distinct, so no other pair matches
    assert len(expected) == 240 and min(expected.values()) == 0.8
    schema = "{} bigint, text string"
    result = decontamination.matches(spark.createDataFrame(docs, schema.format("doc_id")), spark.createDataFrame(items, schema.format("item_id")))
    assert {k: round(v, 9) for k, v in found(result).items()} == {k: round(v, 9) for k, v in expected.items()}


def test_a_block_always_meets_within_the_radius():
    for percent in (60, 80, 95):
        edges, bits = decontamination.block_edges(percent), decontamination.radius(percent)
        assert edges[0] == 0 and edges[-1] == 64 and bits // (len(edges) - 1) <= decontamination.NEAR
    assert 20 <= decontamination.radius(80) <= 23
