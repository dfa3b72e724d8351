"""A family of near copies around the threshold: few pairs reach the full sets, and no link is lost."""

import random

from chronofold.llm import near_dedup


def test_family_is_linked_by_few_pairs(spark, monkeypatch):
    rng = random.Random(3)
    words, texts = [f"w{i}" for i in range(400)], {}
    for i in range(150):  # each has two words other than the one before it: links reach three texts on
        for at in rng.sample(range(400), 2):
            words[at] = f"x{i}-{at}"
        texts[i] = " ".join(words)
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in texts.items())}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = 0
    for a in texts:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
                links += 1
    seen, plain = [], near_dedup.confirm
    monkeypatch.setattr(near_dedup, "likely", lambda pairs, *rest: pairs.filter("false"))  # no star links anything
    monkeypatch.setattr(near_dedup, "confirm", lambda pairs, *rest: seen.append(pairs.count()) or plain(pairs, *rest))
    got = {r.doc_id: r.component_id for r in near_dedup.groups(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    assert got == {i: find(i) for i in texts}
    assert len(set(got.values())) < 10
    assert sum(seen) < 1.25 * links, (seen, links)

