import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.operators import dense, lexical, ranking

HIT = "qid long, project string, rel_path string, text string, rrf double, project_ord string, insert_ord int, name int"


def hits(spark, rows):
    return spark.createDataFrame(rows, HIT)


def cut_by_loop(rows, root, limit):
    """The pool cut as a loop over per-project queues."""
    order = sorted(rows, key=lambda r: (-r[4], r[5], r[6]))
    queues = {}
    for r in order:
        queues.setdefault(r[1], []).append(r)
    own = queues.pop(root, [])
    half = min(len(own), max(1, limit // 2))
    out, own = own[:half], own[half:]
    while len(out) < limit and (own or any(queues.values())):
        for q in queues.values():
            if q and len(out) < limit:
                out.append(q.pop(0))
        if own and len(out) < limit:
            out.append(own.pop(0))
    return [r[7] for r in out[:limit]]


def diverse_by_loop(rows, root, k, most):
    fp = lambda r: (r[2], " ".join(r[3].split())[:400])
    roots = {fp(r) for r in rows if r[1] == root}
    seen, count, out, held = set(), {}, [], []
    for r in rows:
        if (r[1] != root and fp(r) in roots) or fp(r) in seen:
            continue
        seen.add(fp(r))
        count[r[1], r[2]] = count.get((r[1], r[2]), 0) + 1
        (out if count[r[1], r[2]] <= most else held).append(r)
    return [r[7] for r in (out + held)[:k]]


def test_windows_equal_the_loops(spark):
    random.seed(5)
    rows, want_cut, want_div = [], {}, {}
    for q in range(150):
        n, own = random.randint(1, 25), []
        for i in range(n):
            p = random.choice("RABC")
            own.append((q, p, random.choice("xy"), random.choice(["a b", "a  b", "c"]), random.randint(1, 5) / 10, "" if p == "R" else p, i, i))
        rows += own
        want_cut[q] = cut_by_loop(own, "R", 8)
        want_div[q] = diverse_by_loop(own, "R", 6, 1)
    df = hits(spark, rows)
    got = {}
    for r in ranking.pool_cut(df, F.lit("R"), 8).orderBy("qid", "pool_pos").collect():
        got.setdefault(r.qid, []).append(r.name)
    assert got == want_cut
    got = {}
    for r in ranking.diversify(df, F.lit("R"), 6, 1, pos="name").orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.name)
    assert got == want_div


def test_members_are_all_present(spark):
    rows = [(1, "R", f"f{i}", "t", 0.99 - i / 100, "", i, i) for i in range(80)] + [(1, f"m{i}", "g", "t", 0.01, f"m{i}", i, 100 + i) for i in range(5)]
    out = ranking.pool_cut(hits(spark, rows), F.lit("R"), 60).collect()
    assert len(out) == 60 and {r.project for r in out} == {"R", "m0", "m1", "m2", "m3", "m4"}
    rows = [(1, "R", f"f{i}", "t", 0.9 - i / 100, "", i, i) for i in range(10)] + [(1, f"m{i:03d}", "g", "t", 0.95, f"m{i:03d}", i, 100 + i) for i in range(120)]
    out = ranking.pool_cut(hits(spark, rows), F.lit("R"), 60).orderBy("pool_pos").collect()
    assert [r.name for r in out[:10]] == list(range(10))


def test_rrf(spark):
    rows = [(1, "p", c, lane, i) for lane, ids in (("bm25", [7, 1, 2]), ("dense", [3, 7, 4])) for i, c in enumerate(ids)]
    got = ranking.rrf(spark.createDataFrame(rows, "qid long, project string, chunk_id long, lane string, pos int")).orderBy(F.desc("rrf")).collect()
    assert got[0].chunk_id == 7 and got[0].bm25 == 0 and got[0].dense == 1
    one = ranking.rrf(spark.createDataFrame([(1, "p", 9, "bm25", 0)], "qid long, project string, chunk_id long, lane string, pos int")).first()
    assert one.rrf == round(1 / 61, 6) and one.dense is None


def test_score_falls_through(spark):
    df = spark.createDataFrame([(0.0, 0.5), (None, 0.4), (float("nan"), 0.3), (-1.0, 0.2)], "a double, b double")
    assert [r[0] for r in df.select(ranking.score(F.col("a"), F.col("b"))).collect()] == [0.5, 0.4, 0.3, -1.0]


def test_bm25_orders_as_sqlite_does(spark):
    import sqlite3

    random.seed(2)
    words = ["alpha", "beta", "gamma", "delta", "util.js", "pkg_x", "common"]
    docs = [(i, " ".join(random.choice(words) for _ in range(random.randint(3, 30)))) for i in range(60)]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(text, tokens, header, tokenize=\"unicode61 remove_diacritics 0 tokenchars '_$.'\")")
    con.executemany("INSERT INTO f(rowid, text, tokens, header) VALUES (?, ?, '', 'h')", docs)
    want = dict(con.execute("SELECT rowid, rank FROM f WHERE f MATCH '\"alpha\" OR \"util.js\"'").fetchall())
    chunks = spark.createDataFrame([("p", i, t, None, "h") for i, t in docs], "project string, chunk_id long, text string, tokens array<string>, header string")
    q = spark.createDataFrame([(1, ["alpha", "util.js"])], "qid long, terms array<string>")
    got = {r.chunk_id: r.score for r in lexical.bm25(chunks, q).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_knn_equals_numpy_and_skips_bad_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [("p" if i % 2 else "q", i, [float(x) for x in rng.standard_normal(8)]) for i in range(50)] + [("p", 100, None), ("p", 101, [0.0] * 8), ("p", 102, [1.0]), ("p", 103, [float("nan")] * 8)]
    df = spark.createDataFrame(rows, "project string, chunk_id long, embedding array<float>")
    q = spark.createDataFrame([(1, rows[0][2])], "qid long, vector array<double>")
    got = {(r.project, r.chunk_id) for r in lexical.top_per_project(dense.knn(df, q, 8, 5), 5, "distance").collect()}
    want = set()
    for p in "pq":
        ids = [r for r in rows[:50] if r[0] == p]
        v = np.float32([r[2] for r in ids]).astype(float)
        a = np.array(rows[0][2])
        d = 1 - v @ a / (np.linalg.norm(v, axis=1) * np.linalg.norm(a))
        want |= {(p, ids[i][1]) for i in np.argsort(d)[:5]}
    assert got == want


def test_pooling_and_embedder(spark):
    h = np.arange(24, dtype=float).reshape(2, 4, 3) + 1
    mask = np.array([[1, 1, 0, 0], [1, 1, 1, 1]])
    assert np.allclose(dense.pool(h, mask)[0], h[0, 0] / np.linalg.norm(h[0, 0]))
    m = h[0, :2].mean(0)
    assert np.allclose(dense.pool(h, mask, "mean")[0], m / np.linalg.norm(m)) and dense.pool(h, mask, "mean", 2).shape == (2, 2)
    with pytest.raises(ValueError, match="pooling"):
        dense.pool(h, mask, "max")
    df = dense.embed_column(spark.createDataFrame([("abc",), (None,), ("abc",)], "t string"), "t", "v")
    v = [r.v for r in df.collect()]
    assert v[0] == v[2] and len(v[1]) == 64
    with pytest.raises(ValueError, match="side"):
        dense.embed_column(df, "t", "w", side="both")
