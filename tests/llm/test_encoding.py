import base64
import os
import random

import pytest

from ridgeline.llm import encoding

pytestmark = pytest.mark.skipif(not os.path.exists(f"{encoding.TOKENIZERS}/byte_bpe_50k.json"), reason="no vocabulary files")

ODD = ["", None, "   ", "\n\n  \n", "don't I'LL we've it's", "a\x85b\xa0c　d", "é é é", "\U0001f468‍\U0001f469‍\U0001f467", "<|endoftext|>", "Ⅷ 12٣", "x" * 3000, "\x1c \x1d", "ǅ ß ﬁ", "\r\n\r\n x", " \t y"]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{encoding.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def texts():
    random.seed(6)
    pool = ["alpha", "betaGamma", "d_e", "123", "'s", "…", "日本", "\n", "  ", "{", "}"]
    return ODD + ["".join(random.choice(pool) + random.choice(["", " "]) for _ in range(random.randint(0, 80))) for _ in range(120)]


@pytest.mark.parametrize(("block", "parts"), [(50, 10_000), (50, 3), (300_000, 10_000)])
def test_ids_equal_the_library(spark, reference, block, parts):
    rows = [(i % 100 if i % 13 else None, t, "k", 1) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, block int").repartition(3)
    got = sorted((r.doc_id if r.doc_id is not None else -1, list(r.ids)) for r in encoding.encode_texts(df, "doc_id", block_words=block, word_blocks=parts).collect())
    assert got == sorted((k if k is not None else -1, reference(t)) for k, t, *_ in rows)
    counts = sorted(r.n_tokens for r in encoding.count_tokens(df, "doc_id", block_words=block).collect())
    assert counts == sorted(len(reference(t)) for _, t, *_ in rows)
    assert encoding.encode_texts(df.limit(0), "doc_id").count() == 0


def test_round_trip(spark):
    rows = list(enumerate(t for t in texts() if t is not None))
    ids = encoding.encode_texts(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id")
    assert {r.doc_id: r.text for r in encoding.decode_ids(ids, "doc_id").collect()} == dict(rows)
    odd = spark.createDataFrame([(1, None), (2, []), (3, [0])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in encoding.decode_ids(odd, "doc_id").collect()} == {1: None, 2: "", 3: "!"}


def test_token_table(spark):
    t = encoding.token_table(spark)
    assert t.count() == 50256 and bytes(t.where("id = 0").first().bytes) == b"!" and base64.b64encode(b"!")
