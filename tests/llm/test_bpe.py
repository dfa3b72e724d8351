import random

import numpy as np
import pytest
from common import ODD, odd_rows
from tokenizers import Tokenizer

from chronofold.llm import bpe

LETTERS = ["a", "b", " ", "'", "s", "t", "1", "2", "!", "\n", "é", "日", " ", " ", "\x1f", "\x85", "👍", "re", "ll", "\t", "٣", "́", "<|endoftext|>", "the", " of", "\r\n", "("]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.vocabulary_path())


def same(codec, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    packed = codec.encode(text)
    return packed == np.array(ids, "<u4").tobytes() and codec.decode(packed) == library.decode(ids, skip_special_tokens=False)


def test_random_texts_as_the_library(library):
    codec, rnd = bpe.codec(bpe.vocabulary_path()), random.Random(8)
    texts = ["".join(rnd.choice(LETTERS) for _ in range(rnd.randrange(60))) for _ in range(4000)]
    texts += [t or "" for t in ODD] + ["ab" * 3000, "don't  stop 's", " " * 40 + "x", "x" + " " * 40]
    assert all(same(codec, library, t) for t in texts)


def test_long_and_short_fragments_merge_alike():
    codec, rnd = bpe.codec(bpe.vocabulary_path()), random.Random(2)
    for _ in range(400):
        raw = "".join(rnd.choice("thernaidg") for _ in range(rnd.randrange(1, bpe.SHORT))).encode()
        assert codec.merge(raw) == codec.merge_long(raw)


def test_no_token_spans_a_certain_cut():
    codec = bpe.codec(bpe.vocabulary_path())
    assert all(len(codec.fragments(word)) == 1 for word in codec.ids)
    assert len(codec.joined) < 1 << 15


def test_frames(spark, library):
    rows = odd_rows(spark)
    encoded = bpe.encode(rows)
    found = [(r["doc_id"], r["n_tokens"], r["text"]) for r in bpe.decode(encoded).collect()]
    assert sorted(found, key=str) == sorted(((r["doc_id"], len(library.encode(r["text"] or "", add_special_tokens=False).ids), r["text"] or "") for r in rows.select("doc_id", "text").collect()), key=str)
    ids = encoded.filter("doc_id = 4").select(bpe.ids_array().alias("ids")).first()["ids"]
    assert ids == library.encode(ODD[4], add_special_tokens=False).ids
    assert bpe.encode(rows.limit(0)).count() == 0
