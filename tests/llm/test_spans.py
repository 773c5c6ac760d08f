import collections
import random

import pytest
from pyspark.sql import functions as F

from ridgeline.llm import spans


def brute(rows, span):
    where = collections.defaultdict(set)
    for i, t in rows:
        for s in range(len(t) - span + 1):
            where[t[s : s + span]].add(i)
    out = {}
    for i, t in rows:
        covered = set()
        for s in range(len(t) - span + 1):
            if len(where[t[s : s + span]]) > 1:
                covered.update(range(s, s + span))
        if covered:
            out[i] = len(covered)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_shared_characters_equal_brute_force(spark, seed):
    random.seed(seed)
    base = ["".join(random.choice("abé\U0001f600") for _ in range(40)) for _ in range(5)]
    rows = [(i, "".join(random.choice(base)[random.randint(0, 20) : random.randint(20, 40)] for _ in range(random.randint(1, 12)))) for i in range(150)]
    rows += [(1000 + i, "=" * (30 + 10 * i)) for i in range(10)] + [(2000 + i, base[0] + base[1]) for i in range(40)]  # runs and a group of copies
    dirty = [*rows, rows[3], (7, None), (None, "x" * 500), (3000, "")]
    df = spark.createDataFrame([(*r, 0, "c") for r in dirty], "id long, text string, start int, anchor string").repartition(3)
    got = {r.id: r.shared_chars for r in spans.shared_characters(df, 40, 8).collect()}
    assert got == brute(set(rows), 40)
    assert spans.shared_characters(df.limit(0), 40, 8).count() == 0


def test_long_texts_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(spans, "STRETCH", 500)
    random.seed(3)
    t = "".join(random.choice("abcdef") for _ in range(3000))
    rows = [(1, t), (2, "x" + t[700:1400] + "y"), (3, "z" * 300)]
    cut = spans._cut(160, 64)
    import pyarrow as pa

    def units(rows):
        b = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["id", "text"])
        return [r for x in cut(iter([b])) for r in zip(*(x.column(c).to_pylist() for c in ("id", "anchor", "unit", "start", "length")))]

    small = units(rows)
    covered = {(i, s) for i, _, _, a, n in small for s in range(a, a + n - 159)}
    assert covered == {(i, s) for i, t in rows for s in range(len(t) - 159)}  # every window lies in a unit


def test_intervals(spark):
    a, b = "first part " * 16, "".join(chr(97 + i * 7 % 26) for i in range(400))
    got = {r.id: r for r in spans.shared_characters(spark.createDataFrame([(1, "x" + b + "y"), (2, b[:200] + "?" + b[200:]), (3, a)], "id long, text string").select("*", F.lit(1).alias("end"))).collect()}
    assert [tuple(s) for s in got[1].spans] == [(1, 401)] and [tuple(s) for s in got[2].spans] == [(0, 200), (201, 401)] and 3 not in got


def test_the_earliest_record_keeps_a_span(spark):
    random.seed(9)
    a, b, c = ("".join(random.choice("abcdefgh ") for _ in range(220)) for _ in range(3))
    rows = [(1, "x" + a), (2, a + b), (3, "y" + a + "z" + b + "!"), (4, c), (5, a[:150] + c), (6, None), (7, "short"), (7, "short")]
    got = {r.id: r for r in spans.without_repeats(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert {i: r.text for i, r in got.items()} == {1: "x" + a, 2: b, 3: "yz!", 4: c, 5: a[:150], 6: None, 7: "short"}
    assert [tuple(s) for s in got[3].removed] == [(1, 221), (222, 442)] and got[3].removed_chars == 440 and got[1].removed_chars == 0
    assert spans.without_repeats(spark.createDataFrame([], "id long, text string")).count() == 0


def test_windows_of_units_shared_whole_go_to_the_earliest(spark):
    random.seed(10)
    t = "".join(random.choice("abcdefgh ") for _ in range(600))
    rows = [(2, t[:300]), (5, t), (9, t), (11, t[100:500])]
    got = {r.id: r.text for r in spans.without_repeats(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert got == {2: t[:300], 5: t[300:], 9: "", 11: ""} or (got[2], got[9], got[11]) == (t[:300], "", "")
    # brute force: what is left of 5 is what no window shared with 2 covers
    assert got[5] == t[300:]
