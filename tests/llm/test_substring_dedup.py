import random
from collections import Counter

import numpy as np
from common import odd_rows

from chronofold.llm import bytekit, substring_dedup
from chronofold.llm.substring_dedup import LENGTH


def brute(texts):
    """(bytes, removed, spans, kept) of each text, from a count of every window."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + LENGTH] for r in raws for i in range(len(r) - LENGTH + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - LENGTH + 1):
            if seen[r[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = True
        edges = np.diff(np.concatenate(([0], gone.astype(int))))
        out.append((len(r), int(gone.sum()), int((edges == 1).sum()), bytes(np.frombuffer(r, np.uint8)[~gone])))
    return out


def check(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["row"]["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in substring_dedup.repeats(rows).collect()}
    assert found == dict(enumerate(brute(texts)))
    return found


def test_documents_of_the_smallest_scale(spark, directory):
    texts = [r["text"] for r in spark.read.parquet(f"{directory}/documents.parquet").orderBy("doc_id").collect()]
    assert sum(n for _, n, _, _ in check(spark, texts).values()) > 10_000


def test_shared_passages_at_every_border(spark):
    rnd = random.Random(3)
    text = lambda n, letters="abcdefgh é日": "".join(rnd.choice(letters) for _ in range(n))
    passages = [text(n) for n in (100, 180, 195, 200, 201, 260, 500, 900)]
    rows = [None, "", "ab" * 400, "z" * 450, "z" * 199, "z" * 200]
    for _ in range(60):
        parts = [text(rnd.randrange(200))]
        for _ in range(rnd.randrange(4)):
            passage = rnd.choice(passages)
            cut = rnd.randrange(60)
            parts += [passage[cut:] if rnd.random() < 0.3 else passage, text(rnd.randrange(120))]
        rows.append("".join(parts))
    rows += [rows[-1], rows[10], text(300, "a b"), text(300, "ab")]
    check(spark, rows)


def test_a_text_longer_than_a_chunk_gives_the_same_windows():
    rnd = np.random.default_rng(2)
    data = rnd.integers(97, 123, bytekit.CHUNK * 2 + 777).astype(np.uint8)
    offsets = np.array([0, len(data)])
    windows = np.concatenate([at - o for _, anchor, most, fewest, _ in substring_dedup._all_anchors(data, offsets) for at, hi, lo in zip(anchor, most, fewest) for o in [np.arange(lo, hi + 1)]])
    assert sorted(windows.tolist()) == list(range(len(data) - LENGTH + 1))


def test_multikey_order():
    rnd = np.random.default_rng(5)
    words = rnd.integers(0, 3, (500, 4)).astype(np.uint64) << np.uint64(40)
    order, shared = substring_dedup.multikey_order(words)
    raw = [w.astype(">u8").tobytes() for w in words]
    assert [raw[i] for i in order] == sorted(raw)
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    assert shared.tolist()[1:] == [common(raw[order[i - 1]], raw[order[i]]) for i in range(1, 500)]


def test_odd_rows_and_an_empty_table(spark):
    rows = odd_rows(spark)
    found = substring_dedup.repeats(rows, carry=("doc_id", "key", "a"), as_text=True).select("row.*", "n_bytes", "n_removed", "kept").collect()
    assert len(found) == 13
    long = next(r for r in found if r["doc_id"] == 8)
    assert long["n_removed"] == 5000 and long["kept"] == ""
    assert substring_dedup.repeats(rows.limit(0)).count() == 0


def test_windows_across_the_borders_of_small_chunks(spark, monkeypatch):
    """A line and a passage of very many texts: chunks are cut inside their runs, and all borders are compared."""
    monkeypatch.setattr(substring_dedup, "HOT", 50)
    monkeypatch.setattr(substring_dedup, "BUFFER", 20)
    monkeypatch.setattr(substring_dedup, "CHUNK_RECORDS", 30)
    rnd = random.Random(9)
    text = lambda n: "".join(rnd.choice("abcdefgh \0") for _ in range(n))
    line, passage, mid = text(120), text(330), text(198)
    rows = [text(rnd.randrange(150)) + line + text(rnd.randrange(150)) for _ in range(400)]
    rows += [text(rnd.randrange(150)) + passage[rnd.randrange(40) :] + text(rnd.randrange(150)) for _ in range(300)]
    rows += [rnd.choice("abc") + mid + rnd.choice("abc") + text(90) for _ in range(60)]
    rows += rows[:5]
    found = check(spark, rows)
    assert sum(removed == 0 for _, removed, _, _ in found.values()) > 300


def test_a_hot_line_lies_in_many_chunks(spark, monkeypatch):
    """Records around one line of 120 bytes are cut into chunks; windows in records of several chunks are found."""
    monkeypatch.setattr(substring_dedup, "CHUNK_RECORDS", 100)
    rnd = random.Random(4)
    letters = lambda n, of="ijklmnop": "".join(rnd.choice(of) for _ in range(n)).encode()
    line, shared = letters(120, "abcdefgh"), letters(100)
    records = [(line + letters(80), letters(100)[: rnd.randrange(100)]) for _ in range(2000)]
    records += [(line + bytes([c]) * 80, shared[::-1]) for c in b"hjlnpt"]
    rows = [(s, f, i, i, 1, 1) for i, (s, f) in enumerate(records)]
    distinct = spark.createDataFrame(rows, "suffix binary, front binary, record1 long, record2 long, count int, hot int").repartition(8)
    inside = substring_dedup.marks(distinct).filter("offsets is not null").select("record1").distinct().count()
    assert inside < 6  # the others have their equals behind a border
    found = {r["record1"]: np.flatnonzero(np.unpackbits(np.frombuffer(r["offsets"], np.uint8), bitorder="little")) for r in substring_dedup.repeated_records(distinct).collect()}
    # 80 to 100 bytes of the shared front and 120 to 100 of the line
    assert {i: o.tolist() for i, o in found.items()} == {2000 + i: list(range(80, 101)) for i in range(6)}
