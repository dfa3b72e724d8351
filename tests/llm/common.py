"""Plain versions that the operators are held against, and rows that are hard on them."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t ", "one", "one two three", "x " * 50, "\x00 nul \x1c\x85 tail", "日本 語 🙂 " * 20, "a" * 5000, ("long text with words " * 3000)]


def odd_rows(spark):
    """Nulls, empties, long texts, repeated rows, a null key, and columns whose names could clash."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "one"), (None, "no key at all in this row here"), (None, None)]
    extra = [(k, t, "x", 1, "y", 2.0, "z", "en") for k, t in rows]
    return spark.createDataFrame(extra, "doc_id bigint, text string, key string, a int, b string, score double, token_bytes string, lang string")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, width=5):
    words = WORD.findall(lower(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def linked_groups(rows, percent=85):
    """{key: smallest key reachable} by comparing all pairs."""
    sets = {k: shingles(t) for k, t in rows}
    keys, root = sorted(sets), {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {k: (len(sets[k]), find(k)) for k in keys}
