import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ridgeline.functions import text


# How these words are taken apart is part of what the index means.
CONTRACT = {
    "parseUserConfig": ["parse", "user", "config"], "parse_user_config": ["parse", "user", "config"], "HTTPServer": ["http", "server"],
    "parseHTTPResponse": ["parse", "http", "response"], "pkg.Method": ["pkg", "method"], "$userName": ["user", "name"], "user2Config": ["user2", "config"], "CONFIG": [],
}
OWN = {
    "shardRebalancePlan": ["shard", "rebalance", "plan"], "MAX_open_LIMITS": ["max", "open", "limits"], "toJSONLines": ["to", "json", "lines"], "a.b.c": ["a", "b", "c"],
    "row7Of9Total": ["row7", "of9", "total"], "__slots__": [], "ledger": [], "Z": [], "$": [], "": [],
}


@pytest.mark.parametrize(("word", "parts"), (CONTRACT | OWN).items())
def test_identifier_parts(spark, word, parts):
    df = spark.createDataFrame([(word,)], "w string")
    assert df.select(text.split_identifier(F.col("w"))).first()[0] == parts
    if word.strip("$"):
        assert text.query_terms(word) == list(dict.fromkeys([word.lower(), *parts]))


@given(st.text(max_size=60))
def test_query_terms_are_plain(asked):
    """Whatever is asked, operators and quotes of a query language included, the terms are words and nothing else."""
    assert all(t == t.lower() and re.fullmatch(text.TERM, t) for t in text.query_terms(asked + ' ("a" NEAR/3 b) -c* ^d e:f'))


def test_a_query_without_words_has_no_terms():
    assert text.query_terms("?! ()") == text.query_terms("") == []


def test_columns(spark):
    rows = [("openRowGroup(openRowGroup(x), openRowGroup)",), ("a b \n\tc　",), ("a\r\nb\nc\n",), (None,), ("",), ("café naïve\n",)]
    df = spark.createDataFrame(rows, "t string")
    t = F.col("t")
    got = df.select(text.identifier_tokens(t), text.ink_length(t), text.line_count(t), text.end_line(F.lit(1), t), text.preview(t, 2), text.fingerprint(t), text.terms(t)).collect()
    assert got[0][0] == ["open", "row", "group"]
    assert got[1][1] == 3
    assert (got[2][2], got[2][3], got[2][4]) == (4, 3, "a\nb")
    assert got[3][1] is None
    assert (got[4][1], got[4][2], got[4][3]) == (0, 1, 1)
    assert got[5][6] == ["caf", "na", "ve"]
    assert got[1][5] == "a b c"


def test_decoding_replaces_invalid_bytes(spark):
    samples = [b"ok", b"\xff\xfe", b"a\xe2\x82", "é".encode()]
    df = spark.createDataFrame([(bytearray(s),) for s in samples], "c binary")
    assert [r[0] for r in df.select(text.decoded(F.col("c"))).collect()] == [s.decode("utf-8", "replace") for s in samples]
