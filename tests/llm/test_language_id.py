import zstandard
from common import odd_rows

from chronofold.llm import language_id
from chronofold.llm.queries import op9_language

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    found = op9_language(spark, SF).filter("held_out")
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    both = found.join(truth, "doc_id").filter("lang is not null").collect()
    right = [r["lang_pred"] == r["lang"] for r in both]
    sure = [r["lang_pred"] == r["lang"] for r in both if r["accepted"]]
    assert sum(right) >= 0.95 * len(right) and sum(sure) >= 0.96 * len(sure) and len(sure) >= 0.9 * len(right)
    assert all(0 <= r["score"] <= 1 for r in both)


def test_odd_rows_and_empty_tables(spark):
    rows = odd_rows(spark)
    learned = language_id.learn(spark.createDataFrame([("the cat sat on the mat", "en"), ("le chat est sur la table", "fr"), ("x", None)], "text string, lang string"))
    assert sorted(learned) == ["en", "fr"]
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(rows, learned).collect()}
    assert found[0] == found[1] == found[2] == ("und", 0.0) and found[4][0] in ("en", "fr")
    assert {r["lang_pred"] for r in language_id.predict(rows, language_id.learn(rows.limit(0))).collect()} == {"und"}
    assert language_id.predict(rows.limit(0), learned).count() == 0


def test_a_long_text_is_judged_throughout():
    judge = language_id.Judge({"en": b"the cat sat on the mat and the dog ran " * 20, "fr": b"le chat est sur la table et il dort ici " * 20})
    text = "le chat est " * 20 + "the dog ran and the cat sat on the mat. " * 2000
    assert judge.judge(text)[0] == "en"


def test_predictions_equal_plain_compression(spark):
    """Every text under every language's dictionary, a new compressor for each block."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    learned = language_id.learn(docs.filter("doc_id % 5 <> 0"))
    some = docs.filter("doc_id % 9 = 0")
    texts = {r["doc_id"]: r["text"] for r in some.collect()}

    def size(raw, text):
        level = zstandard.ZstdCompressionParameters(**language_id.LEVEL, **language_id.FRAME)
        whole = text.lower()
        blocks = [whole[i : i + language_id.BLOCK_CHARS].encode() for i in range(0, len(whole), language_id.BLOCK_CHARS)]
        content = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return sum(len(zstandard.ZstdCompressor(dict_data=content, compression_params=level).compress(b)) for b in blocks)

    for r in language_id.predict(some, learned).collect():
        text = texts[r["doc_id"]]
        if not text or not any(c.isalpha() for c in text):
            assert r["lang_pred"] == language_id.UNKNOWN
            continue
        sizes = {name: size(raw, text) for name, raw in learned.items()}
        best = min(sizes, key=lambda n: (sizes[n], list(learned).index(n)))
        assert r["lang_pred"] == best
        assert abs(r["score"] - 1 / sum(2.0 ** max(-60, sizes[best] - s) for s in sizes.values())) < 1e-9
