import numpy as np

from ridgeline.llm import neighbours as nb

SCHEMA = "id long, embedding array<float>, vector string"


def frame(spark, x, extra=()):
    return spark.createDataFrame([(i, [float(v) for v in r], "v") for i, r in enumerate(x)] + list(extra), SCHEMA)


def test_graph_recall():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = nb.Graph(x)
    found, _ = g.search(x[:300], 11, 64)
    s = x[:300] @ x.T
    want = np.argsort(-s, axis=1)[:, :11]
    assert len(g.links) > 2 and np.mean([len(set(a) & set(b)) / 11 for a, b in zip(found, want)]) >= 0.9
    near, sims = g.search(x[:300], 10, 16, np.arange(300))  # a node's own answer is exact and without itself
    assert [set(r) for r in near] == [set(r[1:]) for r in want] and (np.diff(sims) <= 0).all()
    small = nb.Graph(x[:1])
    assert small.search(x[:2], 3, 4)[0].tolist() == [[0, -1, -1], [0, -1, -1]]


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 64))
    x[750:1000] = x[:250] + rng.standard_normal((250, 64)) * 0.2  # near copies
    df = frame(spark, x)
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    near = {(i, j) for i in range(len(x)) for j in np.argsort(-s[i])[:10] if s[i, j] >= 0.9}
    got = {(r.id, r.neighbour) for r in nb.nearest(df, 10, 0.9, shard=200).collect()}
    assert got <= near and len(got) >= 0.95 * len(near) > 100
    asked = {}
    for r in nb.nearest(df, 10, width=48, every=50, shard=150).collect():
        asked.setdefault(r.id, set()).add(r.neighbour)
    assert asked.keys() == set(range(0, 1500, 50))
    share = np.mean([len(asked[i] & set(np.argsort(-s[i])[:10].tolist())) / 10 for i in asked])
    assert share >= 0.9
    told = nb.recall(nb.nearest(df, 10, width=48, every=50, shard=150), df, 10, 50).first()
    assert told.asked == 30 and abs(told.recall - share) < 1e-3


def test_crowded_shards_are_split(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal(64)
    x = np.vstack([base + rng.standard_normal((900, 64)) * 0.3, rng.standard_normal((100, 64))])
    df = frame(spark, x)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    got = {}
    for r in nb.nearest(df, 10, shard=20, width=64).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    assert len(got) == 1000 and np.mean([len(got[i] & set(np.argsort(-s[i])[:10].tolist())) / 10 for i in got]) >= 0.9


def test_copies_ties_and_unusable_vectors(spark):
    e = [1.0] + [0.0] * 63
    copies = [(100 + i, [x * (i + 1) for x in e], None) for i in range(30)]  # equal up to length
    bad = [(900, None, None), (901, [0.0] * 64, None), (902, [float("nan")] * 64, None), (903, [1.0] * 63, None), (None, e, None), (904, [float("inf")] + [0.0] * 63, None), (100, copies[0][1], None)]
    other = [(1, [0.0, 1.0] + [0.0] * 62, None)]
    df = spark.createDataFrame(copies + bad + other, SCHEMA)
    rows = nb.nearest(df, 10, 0.9).collect()
    got = {}
    for r in rows:
        got.setdefault(r.id, []).append(r.neighbour)
    assert got.keys() == {100 + i for i in range(30)} and all(sorted(v) == [j for j in range(100, 111) if j != k][:10] for k, v in got.items())
    assert nb.nearest(df.limit(0)).count() == 0
    assert nb.nearest(df.where("id = 1")).count() == 0


def test_shards_asked_do_not_grow_with_the_table(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((6000, 64)) + np.repeat(rng.standard_normal((10, 64)), 600, axis=0)
    x[3000:3400] = x[:400] + rng.standard_normal((400, 64)) * 0.25  # near copies
    df = frame(spark, x).repartition(4).cache()
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    near = {(i, j) for i in range(len(x)) for j in np.argsort(-s[i])[:10] if s[i, j] >= 0.9}

    def asked(**floor):
        c, _, margin = nb.fit_centroids(df, 200, 6000, sample=600, **floor)
        sims = u @ c.T
        return (sims >= sims.max(1, keepdims=True) - margin).sum(1).mean(), sims, margin, c

    few, sims, margin, c = asked(least=0.9, mutual=True)
    assert few <= 1.2 * nb.VISITS and len(near) > 500
    many, sims, margin, c = asked()  # all ten neighbours: as far as those of the whole table need
    assert few < many
    home, true = (u @ c.T).argmax(1), np.argsort(-s, axis=1)[:, :10]
    need = sims.max(1, keepdims=True) - np.take_along_axis(sims, home[true], 1)
    assert abs((need <= margin).mean() - nb.ROUTING) < 0.01
    got = {(r.id, r.neighbour) for r in nb.nearest(df, 10, 0.9, shard=30, sample=600).collect()}
    assert got <= near and len(got) >= 0.99 * len(near)


def test_pairs_above_a_floor_are_exact():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 64)).astype(np.float32)
    x[100:160] = x[0] + rng.standard_normal((60, 64)).astype(np.float32) * 0.1  # more than CANDIDATES above the floor
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    own = np.r_[np.arange(200), np.full(20, -1)]
    q = np.vstack([x[:200], x[280:]])
    row, col, sim = nb._above(x, q, own, 10, np.full(len(q), 0.9))
    s = q.astype(float) @ x.T.astype(float)
    s[np.arange(200), np.arange(200)] = -2
    want = {(i, j) for i in range(len(q)) for j in np.argsort(-s[i])[:10] if s[i, j] >= 0.9}
    assert set(zip(row.tolist(), col.tolist())) == want and np.allclose(sim, s[row, col]) and len(want) > 600
    assert not len(nb._above(x, q[:0], own[:0], 10, np.empty(0))[0])
