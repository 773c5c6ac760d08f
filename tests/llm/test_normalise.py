import pickle
import random
import unicodedata
from unittest.mock import Mock

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ridgeline.llm.normalise import Forms, canonical, confusables, look_alike_classes, look_alikes, normalise_texts, shows, unicode_version


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("ｆｕｌｌ １２", "full 12"), ("café", "café"), ("a​b­c﻿", "abc"), ("a b　c", "a b c"), ("раrу", "pary"), ("Ον", "Ov"), ("ﬁne", "fine"),
        ("a\r\nb\rc", "a\nb\nc"), ("K", "K"), ("e‍́", "é"), ("", ""),
    ],
)
def test_same_look(a, b):
    assert canonical(a, False) == canonical(b, False) == canonical(canonical(a, False), False)


@pytest.mark.parametrize(("a", "b"), [("Case", "case"), ("é", "e"), ("a b", "a  b"), ("a\nb", "a b"), ("x²", "x2"), ("\U0001f469‍\U0001f4bb", "\U0001f469\U0001f4bb"), ("a\tb", "a b"), ("l", "I")])
def test_different_look(a, b):
    assert canonical(a, False) != canonical(b, False)


def test_folding():
    assert canonical("Straße ＡＢ") == canonical("STRASSE ab") == "strasse ab" and canonical(None) is None
    assert canonical("x²") == "x2" and not shows(" ​\n­") and shows("​x") and not shows("")


@pytest.mark.parametrize("word", ["ΗΡΑ", "ηρα", "СОН", "век", "Москва", "Ὀδυσσεύς", "straße", "İstanbul", "ԱՐԱՐԱՏ", "сор", "Ꭰ", "日本"])
def test_words_of_one_script_keep_their_letters(word):
    other = word + " и " + "ΛΔ Ж"  # with real words of the scripts beside it
    assert canonical(other.upper()) == canonical(other.lower())
    assert canonical(word.upper()) == canonical(word.lower())
    assert canonical(f"{word} жук λξ").startswith(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", word).casefold()))


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(["абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "abcdefghijklmnopqrstuvwxyz"]).flatmap(lambda a: st.lists(st.text(alphabet=a, min_size=1, max_size=8), min_size=1, max_size=4)))
def test_case_makes_no_difference(words):
    x = " ".join(words)
    assert canonical(x.upper()) == canonical(x.lower())


def test_mixed_words_are_put_right():
    assert canonical("раypal Вank") == "paypal bank" and canonical("а cat") == "a cat" and canonical("а cat, но кот") == "а cat, но кот"
    assert canonical("non‑breaking") == canonical("non-breaking") and canonical("x\u0430", False) == "xa"


def test_the_public_table(spark):
    table = confusables(spark)
    assert unicode_version(spark) and len(table) > 300 and table["\u13aa"] == "A" and table["\u0430"] == "a" and table["\u041d"] == "H"
    assert all(not k.isascii() and v.isascii() and v.isalpha() for k, v in table.items())
    forms = Forms(table)
    assert forms.visual("\u13aa\u0430") == "Aa" and forms.visual("Il1O0") == "Il1O0" and pickle.loads(pickle.dumps(forms)).look_alike == table
    for w in ("век", "сон", "ηρα", "Москва"):
        assert forms.canonical(f"{w} жук λξ".upper()) == forms.canonical(f"{w} жук λξ".lower())


@pytest.mark.parametrize("builder", [Mock(side_effect=TypeError("'JavaPackage' object is not callable")), Mock(**{"return_value.build.return_value.getSkeleton.return_value": "A\nB"})])
def test_a_missing_or_broken_table_is_an_error(spark, builder):
    broken = Mock(**{"_jvm.com.ibm.icu.text.SpoofChecker.Builder": builder})
    with pytest.raises(RuntimeError, match="ICU library"):
        confusables(broken)
    for query in (look_alikes, look_alike_classes, normalise_texts):
        with pytest.raises(RuntimeError, match="ICU library"):
            query(Mock(sparkSession=broken, **{"withColumn.return_value.schema": None}))


def test_pairs_equal_brute_force(spark):
    random.seed(1)
    base = ["plain text one", "PLAIN text one", "café au lait", "naïve ﬁle", "", "   ", "日本 語"]
    swap = {"a": "а", "e": "е", " ": " ", "t": "ｔ", "é": "é", "i": "і"}
    rows = []
    for i in range(150):
        t = random.choice(base)
        t = "".join(swap.get(c, c) if random.random() < 0.2 else c for c in t)
        rows.append((i, t + ("​" if random.random() < 0.2 else ""), "k"))
    rows += [(500, None, ""), (501, "​", ""), (502, "­", ""), (None, "plain text one", ""), (503, "x", ""), (504, "x", "")]
    df = spark.createDataFrame(rows + rows[:10], "doc_id long, text string, form string")
    real = {i: t for i, t, _ in rows if i is not None and t is not None}
    want = {(a, b) for a in real for b in real if a < b and real[a] != real[b] and canonical(real[a], False) == canonical(real[b], False) and shows(canonical(real[a], False))}
    got = [(r.doc_a, r.doc_b) for r in look_alikes(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    assert look_alikes(df.limit(0)).count() == 0


def test_column(spark):
    df = spark.createDataFrame([(1, "ＡＢ", "old"), (2, None, "old"), (3, "", None), (4, "ＡＢ", "old")], "id long, text string, canonical string")
    assert [r.canonical for r in normalise_texts(df).orderBy("id").collect()] == ["ab", None, "", "ab"]
    assert normalise_texts(df.limit(0)).count() == 0


def test_classes_hold_the_pairs(spark):
    rows = [(1, "ab"), (2, "ａb"), (3, "ab"), (4, "x"), (5, "x"), (6, None), (7, "a​b"), (None, "ab")]
    df = spark.createDataFrame(rows + rows[:2], "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.variants, r.links) for r in look_alike_classes(df).collect()}
    assert got == {1: (1, 3, 2), 2: (1, 3, 3), 3: (1, 3, 2), 7: (1, 3, 3)}
    assert look_alikes(df).count() == sum(v[2] for v in got.values()) // 2
