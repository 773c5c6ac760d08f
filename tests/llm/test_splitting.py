import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ridgeline.llm.splitting import ink, split_oversized, split_text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab. \n\t　é́x", max_size=400), st.integers(3, 30), st.integers(0, 8))
def test_pieces_cover_and_fit(text, limit, overlap):
    if overlap >= limit:
        return
    spans = split_text(text, limit, overlap)
    if not text:
        assert spans == []
        return
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert len(spans) == 1 or ink(text) > limit
    for k, (a, z) in enumerate(spans):
        assert ink(text[a:z]) <= limit and a < z
        if k:
            b, y = spans[k - 1]
            assert b <= a <= y < z and ink(text[a:y]) <= overlap


def test_natural_boundaries_win():
    para = "One two three four five. Six seven eight nine ten.\nEleven twelve.\n\n"
    text = para * 20
    spans = split_text(text, 150, 0)
    assert all(text[z - 2 : z] == "\n\n" for _, z in spans)
    words = "word " * 400
    assert all(words[z - 1] == " " for _, z in split_text(words, 100, 20))
    assert [ink("x" * 250)] == [250] and len(split_text("x" * 250, 100, 10)) == 3
    with pytest.raises(ValueError, match="overlap"):
        split_text("x", 5, 5)


def test_overlap_is_the_end_of_the_piece_before():
    text = "\n".join(f"line {i} with some words" for i in range(400))
    spans = split_text(text)
    assert len(spans) > 2
    for (_, y), (a, _) in zip(spans, spans[1:]):
        assert 150 < ink(text[a:y]) <= 200


def test_frame(spark):
    big = "".join(f"line {i} some words here\n" for i in range(300))
    rows = [("p", 1, 5, big, "a"), ("p", 1, 5, big, "a"), ("p", 2, 0, big, "b"), ("p", 3, None, big, "c"), ("p", 4, 1, "small", None), ("p", 5, 1, None, None), (None, 6, 1, " " * 9000, None), ("p", 7, 1, "", None)]
    df = spark.createDataFrame(rows, "project string, chunk_id long, start_line int, text string, piece string")
    got = {}
    for r in split_oversized(df).orderBy("chunk_id", "piece").collect():
        got.setdefault(r.chunk_id, []).append(r)
    assert got.keys() == {1, 2, 3} and [r.piece for r in got[1]] == list(range(len(got[1])))
    assert got[1][0].start_line == 5 and got[2][0].start_line == 1 and got[1][-1].end_line == 304 and got[3][-1].end_line == 300
    lines = big.splitlines()
    for r in got[3]:
        assert r.n_chars == ink(r.text) <= 2000 and r.text.splitlines()[0] in lines[r.start_line - 1] and r.text.splitlines()[-1] in lines[r.end_line - 1]
    assert split_oversized(df.limit(0)).count() == 0
