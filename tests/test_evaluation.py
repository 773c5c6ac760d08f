import math

from ridgeline.operators import evaluation as ev


def test_mcnemar_and_bh(spark):
    assert ev.mcnemar_p(5, 0) == 0.0625 and ev.mcnemar_p(0, 0) == 1.0
    df = spark.createDataFrame([(0.01 * i,) for i in range(1, 6)], "p double")
    got = [r.p_adjusted for r in ev.adjust(df).orderBy("p").collect()]
    assert math.isclose(got[0], 0.05) and got == sorted(got)


def test_adjusting_equals_the_step_up_rule(spark):
    import random

    random.seed(3)
    p = [round(random.random(), 2) for _ in range(300)] + [0.0, 1.0, 0.05, 0.05]
    order = sorted(range(len(p)), key=lambda i: p[i])
    want, least = [0.0] * len(p), 1.0
    for k in range(len(p), 0, -1):
        least = min(least, p[order[k - 1]] * len(p) / k)
        want[order[k - 1]] = least
    df = spark.createDataFrame(list(enumerate(p)) + [(999, None)], "i long, p double")
    got = {r.i: r.p_adjusted for r in ev.adjust(df).collect()}
    assert got.pop(999) is None and all(math.isclose(got[i], w) for i, w in enumerate(want))


def test_metrics(spark):
    rows = [("a", 1, 1), ("a", 2, None), ("a", 3, 4), ("b", 1, 1), ("b", 2, 2), ("b", 3, 30)]
    df = spark.createDataFrame(rows, "arm string, qid long, rank int")
    m = {r.arm: r for r in ev.metrics(df).collect()}
    assert (m["a"].recall_at_1, m["a"].recall_at_10, m["a"].mrr) == (0.3333, 0.6667, 0.4167)
    d = ev.discordance(df, "a").first()
    assert (d.pairs, d.won, d.lost, d.delta) == (3, 1, 1, 0.0)
    b = ev.bootstrap(df.where("arm = 'a'").unionByName(df.where("arm = 'a'").replace("a", "c", "arm")), "a").first()
    assert (b.delta, b.low, b.high) == (0.0, 0.0, 0.0)


def test_round_robin(spark):
    df = spark.createDataFrame([("py", i) for i in range(10)] + [("go", 1), ("rs", 1), ("rs", 2)], "lang string, n int")
    got = [(r.lang, r.n) for r in ev.round_robin(df, "lang", "n", 6).collect()]
    assert sorted(got) == sorted([("go", 1), ("py", 0), ("rs", 1), ("py", 1), ("rs", 2), ("py", 2)])


def test_queries_are_stripped_from_the_text(spark):
    doc = '"""Reads the session of a user from the shared store when asked."""\n'
    files = [("p", "s.py", "python", doc + "class S: pass\n"), ("p", "d.md", "markdown", "intro\n## Storage\nHow the rows of a store are laid out on disk.\nmore\n\nnext\n"), ("p", "x.py", "python", "# short\n"), ("p", "n", "go", None),
             ("p", "c.go", "go", "// one two three four\n// five six seven eight nine\npackage x\n")]
    got = {r.positive: r for r in ev.derive_queries(spark.createDataFrame(files, "project string, path string, lang string, text string")).collect()}
    assert got.keys() == {"s.py", "d.md", "c.go"} and got["s.py"].stripped == "\nclass S: pass\n" and "session" not in got["s.py"].stripped
    frame = spark.createDataFrame(files, "project string, path string, lang string, text string")
    corpus = {r.path: r.text for r in ev.stripped_corpus(frame).collect()}
    assert corpus["s.py"] == got["s.py"].stripped and corpus["x.py"] == "# short\n" and corpus["n"] is None and len(corpus) == 5
    assert ev.overlap(frame, frame.where("lang = 'go'")).count() == 2 and ev.overlap(frame.where("lang = 'python'"), frame.where("lang = 'go'")).count() == 0
    assert got["d.md"].query.startswith("Storage How the rows") and got["d.md"].stripped == "\nnext\n" and got["c.go"].stripped == "package x\n"


def test_percentiles(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 101)] + [("a", None), ("b", 5.0)], "k string, v double")
    got = {r.k: r for r in ev.percentiles(df, "k", "v").collect()}
    assert (got["a"].median, got["a"].p95, got["b"].median, got["b"].p95) == (50.5, 95.0, 5.0, 5.0)
