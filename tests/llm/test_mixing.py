import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import encoding, mixing

pytestmark = pytest.mark.skipif(not os.path.exists(f"{encoding.TOKENIZERS}/{encoding.VOCABULARY}"), reason="no vocabulary files")
PLAN = "plan_id int, source string, weight double, max_repeats int, total_tokens long, share string"


def documents(n=300):
    random.seed(2)
    topics = {"cats": "cat purr paw whisker meow".split(), "cars": "engine wheel brake gear road".split(), "bread": "flour yeast oven crust dough".split()}
    out = []
    for i in range(n):
        s = random.choice(list(topics))
        out.append((i, " ".join(random.choice(topics[s]) for _ in range(random.randint(5, 60))), None if i % 10 == 0 else s, "x"))
    return out


def test_shares_are_reached(spark):
    docs = documents()
    df = spark.createDataFrame(docs + docs[:5] + [(900, None, "cats", ""), (901, "", "cats", ""), (None, "zzz", "cats", ""), (902, "blank source", "", "")], "doc_id long, text string, source string, tokens string")
    plans = spark.createDataFrame(
        [(1, "cats", 1.0, None, 2000, ""), (1, "cars", 2.0, 3, 2000, ""), (1, "bread", 1.0, 1, 2000, ""), (2, "cats", 5.0, 3, 10_000, ""), (2, "cars", 5.0, None, 10_000, ""), (2, "none", 1.0, 2, 10_000, ""),
         (2, "bread", 0.0, 1, 10_000, ""), (3, "cats", None, 1, 100, ""), (3, "cars", float("nan"), 1, 100, ""), (4, None, 1.0, 1, 100, "")],
        PLAN,
    )
    m = mixing.mix(df, plans)
    tokens = {r.doc_id: r.n_tokens for r in encoding.count_tokens(df.dropDuplicates(["doc_id"]), "doc_id").collect() if r.doc_id is not None}
    source = {d[0]: d[2] for d in docs}
    supply = {s: sum(tokens[i] for i, x in source.items() if x == s) for s in ("cats", "cars", "bread")}
    picked = [(r.plan_id, r.doc_id, r.repeats) for r in m.selection.collect()]
    shares = {(r.plan_id, r.source): r for r in m.shares.collect()}
    assert len(shares) == plans.count()
    for (p, s), r in shares.items():
        got = sum(tokens[i] * n for q, i, n in picked if q == p and source.get(i) == s)
        assert got == r.selected_tokens
        most = r.max_repeats
        assert all(n <= most for q, i, n in picked if q == p and source.get(i) == s)
        if not r.short:
            assert abs(got - r.target_tokens) <= max(tokens.values())
        else:
            assert got == supply.get(s, 0) * most
    assert len(picked) == len({(p, i) for p, i, _ in picked})
    want = {(p, s) for (p, s), r in shares.items() if r.weight > 0 and supply.get(s, 0) * r.max_repeats < r.target_tokens}
    assert {(r.plan_id, r.source) for r in mixing.unreachable(m).collect()} == want and (2, "cars") in want and (2, "none") in want
    # documents without a source stand in for the short one their text points to
    assert m.model is not None and m.model.accuracy > 0.9
    extra = [i for p, i, _ in picked if p == 2 and source.get(i) is None]
    assert extra and shares[2, "cars"].stand_in_tokens > 0
    report = mixing.fit_report(spark, m).first()
    assert report.sources == 4 and report.accuracy == m.model.accuracy and report.steps >= 1 and report.stand_in_steps >= 1


def test_soft_members_meet_targets_in_expectation():
    """The fit alone, on documents that belong to several domains: expected totals meet the targets, rates stay in bounds."""
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.4] * 4, 500)
    tokens = rng.integers(5, 90, 500).astype(float)
    mass = tokens @ p
    targets = np.array([[0.6, 0.2, 0.4, 0.3], [1.5, 1.1, 0.9, 1.2]]) * mass
    fit, expected = mixing._Fit(np.full((2, 5), 3.0), []), np.zeros((2, 4))
    for n in range(mixing.ROUNDS):
        fit.history.append((targets - expected) / mass)
        rate = fit.rates(p, np.zeros(500, int))
        expected = (rate * tokens) @ p
        assert rate.min() >= 0 and rate.max() <= 3
    assert np.abs(expected / targets - 1).max() < 0.02


def test_a_wrong_label_is_doubted(spark):
    docs = documents()
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, tokens string")
    model = mixing.fit_domains(df, ["bread", "cars", "cats"])
    words = df.limit(0).union(spark.createDataFrame([(1, "cat purr paw whisker meow " * 8, "cars", ""), (2, "cat paw purr", "cats", "")], df.schema)).select(mixing._features(F.col("text")).alias("at"))
    at = pa.concat_arrays(words.toArrow().combine_chunks().column("at").chunks)
    p = model.posteriors(at, np.array([1, 2]))
    assert p[1, 2] > 0.999 and p[0, 2] > p[1, 1] and np.allclose(p.sum(1), 1)


def test_names_beyond_the_bound_are_an_error(spark):
    d = spark.createDataFrame([(1, "x", "a")], "doc_id long, text string, source string")
    many = spark.createDataFrame([(1, f"s{i}", 1.0, 1, 10, "") for i in range(mixing.MAX_SOURCES + 1)], PLAN)
    with pytest.raises(ValueError, match="names more"):
        mixing.mix(d, many)


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string, source string")
    p = spark.createDataFrame([(1, "a", 1.0, 1, 10, "")], PLAN)
    m = mixing.mix(d, p)
    assert m.selection.count() == 0 and [r.source for r in mixing.unreachable(m).collect()] == ["a"]
    m = mixing.mix(spark.createDataFrame([(1, "x y", "a")], "doc_id long, text string, source string"), p.limit(0))
    assert m.selection.count() == 0 and m.shares.count() == 0
