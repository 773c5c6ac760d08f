"""The most similar vectors for every vector.

Vectors are routed to shards by spherical k-means centroids (fitted on a bounded sample; every vector
is indexed). Each shard builds a hierarchical navigable small-world graph, kept as flat neighbour
arrays per layer, and answers the queries routed to it by batched beam search; the shards' results
are merged. Equal vectors are one node, so a group of copies never fills a shard. Shards have a size
bound, so the work of a vector doesn't grow with the table, but for the shards it asks. How many those
are is measured: as many as hold the share `routing` of true neighbours, those of the sample in a small
table, in a large one those of the whole table. With a floor for the similarity only neighbours above it
count, and a shard answers by block products, as all that is asked is which ones pass the floor.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.session import lowest, spread

DIMENSIONS = 64
K = 10
#: Vectors of the sample the centroids are fitted on, at most.
SAMPLE = 30_000
#: Vectors of the sample that tell how far a query must go, and the share of true neighbours that its shards hold.
CALIBRATION, ROUTING = 1_500, 0.97
#: Shards a vector may ask on average before the whole table is read to tell how far a query must go.
VISITS = 3
#: Vectors that the shards a query asks hold at least, if there are as many.
ENOUGH = 500
#: Vectors of a shard on average, and shards at most.
SHARD, MAX_SHARDS = 5_000, 4_096
#: A shard above this many times the average is split by salt; its queries visit all its parts.
CROWDED = 6
#: Links that a node chooses (it has twice as many at most), candidates for them, nodes of a layer to one of the next.
LINKS, CANDIDATES, RATIO = 16, 24, 16
#: Nodes of a beam whose links are followed at once.
FAN = 3
#: Rows that are routed at once.
ROUTE_BLOCK = 1_024
#: Queries of a block, and marks of nodes seen by a block (bytes), at most.
QUERY_BLOCK, MARKS = 1_024, 1 << 26

_VECTOR = "digest binary, vector binary"


def _usable(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, unit vectors) of the usable rows: all numbers there and finite, not all zero."""
    e = batch.column("embedding")
    offsets = e.offsets.to_numpy()
    valid = np.flatnonzero((np.diff(offsets) == DIMENSIONS) & e.is_valid().to_numpy(zero_copy_only=False) & batch.column("id").is_valid().to_numpy(zero_copy_only=False))
    flat = e.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    x = flat[offsets[valid][:, None] + np.arange(DIMENSIONS)] if len(valid) else np.empty((0, DIMENSIONS))
    with np.errstate(all="ignore"):
        norm = np.sqrt((x * x).sum(1))
    good = np.isfinite(x).all(1) & np.isfinite(norm) & (norm > 0)
    return valid[good], (x[good] / norm[good, None]).astype(np.float32)


def _digests(x: np.ndarray) -> list[bytes]:
    return [xxhash.xxh3_128_digest(row) for row in np.ascontiguousarray(x + np.float32(0))]


def _homes(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row, in blocks."""
    blocks = [(x[i : i + ROUTE_BLOCK] @ centroids.T).argmax(1) for i in range(0, len(x), ROUTE_BLOCK)]
    return np.concatenate(blocks) if blocks else np.empty(0, np.int64)


def fit_centroids(
    vectors: DataFrame, shards: int, total: int, routing: float = ROUTING, k: int = K, sample: int = SAMPLE, rounds: int = 10, least: float = -1.0, mutual: bool = False
) -> tuple[np.ndarray, np.ndarray, float]:
    """(centroids, share, margin) from at most `sample` rows of the smallest hash.

    Spherical k-means; `share` of the different vectors is nearest to each centroid. A query asks the
    shards whose centroid is at most `margin` less similar than its best one: the least margin by which
    CALIBRATION vectors reach the share `routing` of their k true neighbours within the sample. There
    neighbours are farther apart than in the whole table, so the whole table's are reached rather more:
    with many shards so much more that the shards asked grow with the table. Where they are more than
    VISITS, `_reach` measures the margin on the whole table instead.
    """
    rows = lowest(vectors.select("id", "embedding").where("id is not null and embedding is not null"), F.xxhash64("id"), sample, total)
    table = rows.toArrow().combine_chunks()
    batches = table.to_batches()
    x = np.concatenate([_usable(b)[1] for b in batches]) if batches else np.empty((0, DIMENSIONS), np.float32)
    if not len(x):
        return np.zeros((1, DIMENSIONS), np.float32), np.ones(1), 0.0
    rng = np.random.default_rng(7)
    x = np.unique(x, axis=0)
    x = x[rng.permutation(len(x))]
    c, best = x[:1], x @ x[0]
    for _ in range(min(shards, len(x)) - 1):  # far from the ones there are, at random
        away = np.maximum(1 - best, 1e-9).astype(np.float64)
        pick = x[rng.choice(len(x), p=away / away.sum())]
        c, best = np.vstack([c, pick]), np.maximum(best, x @ pick)
    for _ in range(rounds):
        home = _homes(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-12), c).astype(np.float32)
    home = _homes(x, c)
    n, need = max(0, min(k, len(x) - 1)), np.empty((0, 0), np.float32)
    if n:
        blocks = []
        for i in range(0, min(CALIBRATION, len(x)), 250):
            ask = x[i : min(i + 250, CALIBRATION)]
            s = ask @ x.T
            s[np.arange(len(ask)), np.arange(i, i + len(ask))] = -2
            true = np.argpartition(-s, n - 1, axis=1)[:, :n]
            near = ask @ c.T
            blocks.append(near.max(1)[:, None] - np.take_along_axis(near, home[true], 1))
        need = np.concatenate(blocks)
    margin = float(np.quantile(need, routing)) if need.size else 0.0
    if total > sample:
        margin = _reach(vectors, c, margin, total, routing, k, least, mutual)
    return c, np.bincount(home, minlength=len(c)) / len(x), margin + 1e-6


def _reach(vectors: DataFrame, centroids: np.ndarray, margin: float, total: int, routing: float, k: int, least: float, mutual: bool) -> float:
    """The margin of a query: `margin`, the sample's, while CALIBRATION other vectors ask at most VISITS
    shards by it on average. Beyond that the least one by which they reach the share `routing` of their k
    nearest other vectors of the whole table, of those of a similarity of at least `least`; but no less
    than what VISITS shards allow. With `mutual` a pair is reached if either of its vectors reaches the other."""
    rows = lowest(vectors.select("id", "embedding").where("id is not null and embedding is not null"), F.xxhash64("id", F.lit("reach")), CALIBRATION, total)
    batches = rows.toArrow().combine_chunks().to_batches()
    q = np.unique(np.concatenate([_usable(b)[1] for b in batches]), axis=0) if batches else np.empty((0, DIMENSIONS), np.float32)
    near = q @ centroids.T
    best, home = near.max(1, initial=-2), near.argmax(1)
    away = best[:, None] - near
    if (away <= margin).sum() <= VISITS * len(q):
        return margin
    allowed = float(np.partition(away, VISITS * len(q) - 1, axis=None)[VISITS * len(q) - 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sims, need = np.full((len(q), k), -2.0), np.zeros((len(q), k))
        for b in batches:
            _, x = _usable(b)
            x = np.unique(x, axis=0)
            for i in range(0, len(x), ROUTE_BLOCK):
                block = x[i : i + ROUTE_BLOCK]
                r, c, exact = _above(block, q, np.full(len(q), -1), k + 1, np.maximum(sims[:, -1], least))
                other = (q[r] != block[c]).any(1)
                r, c, exact = r[other], c[other], exact[other]
                place = np.arange(len(r)) - np.searchsorted(r, r)
                first = place < k
                r, c, place, exact = r[first], c[first], place[first], exact[first]
                new_s, new_n = np.full(sims.shape, -2.0), np.zeros(sims.shape)
                there = _homes(block[c], centroids)
                gap = best[r] - np.einsum("nd,nd->n", q[r], centroids[there])
                if mutual:
                    back = np.einsum("nd,nd->n", block[c], centroids[there]) - np.einsum("nd,nd->n", block[c], centroids[home[r]])
                    gap = np.minimum(gap, back)
                new_s[r, place], new_n[r, place] = exact, gap
                touched = np.unique(r)
                all_s, all_n = np.concatenate([sims[touched], new_s[touched]], 1), np.concatenate([need[touched], new_n[touched]], 1)
                order = np.argsort(-all_s, axis=1, kind="stable")
                all_s, all_n = np.take_along_axis(all_s, order, 1), np.take_along_axis(all_n, order, 1)
                all_s[:, 1:][all_s[:, 1:] == all_s[:, :-1]] = -2  # equal vectors of several batches
                order = np.argsort(-all_s, axis=1, kind="stable")[:, :k]
                sims[touched], need[touched] = np.take_along_axis(all_s, order, 1), np.take_along_axis(all_n, order, 1)
        r, c = np.nonzero(sims > -2)
        yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(-sims[r, c]), pa.array(need[r, c])], names=["q", "d", "need"])

    # equal vectors have equal similarities, so the set holds them once; k rows a vector reach the driver
    found = vectors.mapInArrow(run, "q long, d double, need double").groupBy("q").agg(F.slice(F.array_sort(F.collect_set(F.struct("d", "need"))), 1, k).alias("near"))
    need = found.select(F.explode("near.need").alias("need")).toArrow().column("need").to_numpy()
    return min(margin, max(allowed, float(np.quantile(need, routing)) if len(need) else 0.0))


def _route(centroids: np.ndarray, margin: float, sizes: np.ndarray, parts: dict[int, int], every: int | None):
    """Rows (shard, home, digest, vector) for the index and the queries; equal vectors of a batch once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = _usable(b)
            digests = _digests(x)
            first = {d: i for i, d in reversed(list(enumerate(digests)))}
            keep = np.fromiter(sorted(first.values()), np.int64)
            asks = np.ones(len(rows), bool)
            if every:
                ids = b.column("id").to_numpy()[rows]
                wanted = {digests[i] for i in np.flatnonzero(ids % every == 0)}
                asks = np.fromiter((d in wanted for d in digests), bool, len(digests))
            for at in range(0, len(keep), ROUTE_BLOCK):
                block = keep[at : at + ROUTE_BLOCK]
                sims = x[block] @ centroids.T
                home = sims.argmax(1)
                near = sims >= sims.max(1, keepdims=True) - margin
                lonely = np.flatnonzero(near @ sizes < ENOUGH)
                if len(lonely):  # small shards: on to the next ones until they hold enough vectors
                    order = np.argsort(-sims[lonely], axis=1)
                    held = np.cumsum(sizes[order], axis=1) - sizes[order]
                    more = np.zeros((len(lonely), sims.shape[1]), bool)
                    np.put_along_axis(more, order, held < ENOUGH, 1)
                    near[lonely] |= more
                out: tuple[list, list, list, list] = ([], [], [], [])
                for r, i in enumerate(block):
                    d, v, h = digests[i], x[i].tobytes(), int(home[r])
                    own = int.from_bytes(d[:4], "little") % parts.get(h, 1)
                    visits = {(h, own): 1 + 2 * bool(asks[i])}  # 1: indexed here, 2: asked here
                    if asks[i]:
                        for s in np.flatnonzero(near[r]).tolist():
                            for p in range(parts.get(s, 1)):
                                visits[s, p] = visits.get((s, p), 0) | 2
                    for (s, p), role in visits.items():
                        out[0].append(s << 32 | p)
                        out[1].append(role)
                        out[2].append(d)
                        out[3].append(v)
                kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["shard", "role", "digest", "vector"])

    return run


def _nearest(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n nearest other rows of each row of x, in blocks: (rows, similarities), nearest first."""
    n = max(0, min(n, len(x) - 1))
    near, sim = np.empty((len(x), n), np.int32), np.empty((len(x), n), np.float32)
    step = min(2048, max(64, (1 << 22) // max(len(x), 1)))  # a block of products stays below some 16 MB
    for i in range(0, len(x) if n else 0, step):
        s = x[i : i + step] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
        top = np.argpartition(-s, n - 1, axis=1)[:, :n]
        val = np.take_along_axis(s, top, 1)
        order = np.argsort(-val, axis=1, kind="stable")
        near[i : i + len(s)], sim[i : i + len(s)] = np.take_along_axis(top, order, 1), np.take_along_axis(val, order, 1)
    return near, sim


def _links(x: np.ndarray, near: np.ndarray, sim: np.ndarray) -> np.ndarray:
    """Flat neighbour array of one layer from its nodes' candidates: diverse links, both ways, padded by -1."""
    n, m = near.shape
    kept = np.zeros((n, m), bool)
    for i in range(0, n, 2048):
        v = x[near[i : i + 2048]]
        among = v @ v.transpose(0, 2, 1)
        k, own = kept[i : i + 2048], sim[i : i + 2048]
        count = np.zeros(len(k), np.int64)
        for j in range(m):
            # a candidate is linked unless it is nearer to a linked one than to the node itself; the closest always are
            blocked = ((among[:, j, :j] > own[:, j, None]) & k[:, :j]).any(1)
            k[:, j] = (count < LINKS) & (~blocked | (j < 4))
            count += k[:, j]
    a, j = np.nonzero(kept)
    b, s = near[a, j], sim[a, j]
    src, dst, val = np.r_[a, b], np.r_[b, a], np.r_[s, s]
    _, one = np.unique(src.astype(np.int64) * n + dst, return_index=True)
    src, dst, val = src[one], dst[one], val[one]
    best = np.lexsort((-val, src))
    src, dst = src[best], dst[best]
    place = np.arange(len(src)) - np.searchsorted(src, src)
    fits = place < 2 * LINKS
    flat = np.full((n, 2 * LINKS), -1, np.int32)
    flat[src[fits], place[fits]] = dst[fits]
    return flat


class Graph:
    """A hierarchical navigable small-world graph over unit vectors, in flat neighbour arrays.

    The nodes are put in a random order; layer 0 holds them all, each next layer the first one in
    RATIO of the one below, so that a node has one number in all its layers. The candidates of a
    node's links are its nearest in the layer, from block products: a shard is of bounded size, and
    there they cost less than a search at the time of insertion and miss none. The candidates of
    layer 0 are also the answer for a query that is itself a node.
    """

    def __init__(self, x: np.ndarray, seed: int = 11) -> None:
        self.order = np.random.default_rng(seed).permutation(len(x)).astype(np.int32)
        self.place = np.empty_like(self.order)
        self.place[self.order] = np.arange(len(x), dtype=np.int32)
        self.x = np.ascontiguousarray(x[self.order])
        sizes = [len(x)]
        while sizes[-1] > 4 * RATIO:
            sizes.append(math.ceil(sizes[-1] / RATIO))
        self.near, self.sims = _nearest(self.x, CANDIDATES)
        self.links = [_links(self.x, self.near, self.sims)] + [_links(self.x[:n], *_nearest(self.x[:n], CANDIDATES)) for n in sizes[1:]]

    def _descend(self, upper: list[np.ndarray], q: np.ndarray) -> np.ndarray:
        """Entry nodes for the layer below `upper` (from below to the top)."""
        if not upper:
            return np.zeros((len(q), 1), np.int32)
        top = len(upper[-1])
        entry = np.argsort(-(q @ self.x[:top].T), axis=1)[:, :2].astype(np.int32)
        for links in upper[-2::-1]:
            entry = self._beam(links, q, entry, 4)[0][:, :2]
        return entry

    def search(self, q: np.ndarray, k: int, width: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(rows of x, similarities) of the k best found for each query, padded by -1 and -2.

        `own`: the row of x that is the query itself, -1 without one; it isn't among its results, which
        are exact as far as CANDIDATES reaches.
        """
        near, sims = np.full((len(q), k), -1, np.int64), np.full((len(q), k), -2, np.float32)
        inside = np.zeros(len(q), bool) if own is None or k > CANDIDATES else own >= 0
        at = self.place[own[inside]] if inside.any() else np.empty(0, np.int32)
        m = min(k, self.near.shape[1])
        near[inside, :m], sims[inside, :m] = self.order[self.near[at, :m]], self.sims[at, :m]
        others = np.flatnonzero(~inside)
        step = max(64, min(QUERY_BLOCK, MARKS // max(len(self.x), 1)))
        for i in range(0, len(others), step):
            rows = others[i : i + step]
            found, s = self._beam(self.links[0], q[rows], self._descend(self.links[1:], q[rows]), max(width, k))
            near[rows], sims[rows] = np.where(found[:, :k] >= 0, self.order[found[:, :k]], -1), s[:, :k]
        return near, sims

    def _beam(self, links: np.ndarray, q: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The best `width` nodes that a beam of that width reaches from `entry` in one layer, best first."""
        n, x = len(q), self.x
        seen = np.zeros((n, len(links) + 1), bool)  # the last column takes the padding
        seen[:, -1] = True
        beam, sims = np.full((n, width), -1, np.int32), np.full((n, width), -2, np.float32)
        done = np.ones((n, width), bool)
        e = min(entry.shape[1], width)
        entry = entry[:, :e]
        if e > 1:
            entry = np.where((entry[:, :, None] == entry[:, None, :]).argmax(2) == np.arange(e), entry, -1)
        beam[:, :e], done[:, :e] = entry, entry < 0
        sims[:, :e] = np.where(entry >= 0, np.einsum("qmd,qd->qm", x[entry], q), -2)
        np.put_along_axis(seen, entry, True, 1)
        active = np.arange(n)
        while len(active):
            rows = np.arange(len(active))[:, None]
            pick = np.argsort(np.where(done[active], 3, -sims[active]), axis=1)[:, : min(FAN, width)]
            ask = np.where(done[active][rows, pick], -1, beam[active][rows, pick])
            done[active[:, None], pick] = True
            new = np.where(ask[:, :, None] >= 0, links[ask], -1).reshape(len(active), -1)
            new[seen[active[:, None], new]] = -1
            new = np.sort(new, axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            seen[active[:, None], new] = True
            r, c = np.nonzero(new >= 0)
            s = np.full(new.shape, -2, np.float32)
            s[r, c] = np.einsum("nd,nd->n", x[new[r, c]], q[active[r]])
            all_s, all_b = np.concatenate([sims[active], s], 1), np.concatenate([beam[active], new], 1)
            all_d = np.concatenate([done[active], new < 0], 1)
            best = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
            sims[active], beam[active], done[active] = all_s[rows, best], all_b[rows, best], all_d[rows, best]
            active = active[~done[active].all(1)]
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(beam, order, 1), np.take_along_axis(sims, order, 1)


def _above(x: np.ndarray, q: np.ndarray, own: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(queries, rows of x, similarities) of the pairs of at least the query's similarity in `least`, in
    blocks: the k best of each query, best first, and those as near as the last of them, as far as CANDIDATES reaches.

    `own`: the row of x that is the query itself, -1 without one; it isn't among its results.
    """
    n = max(k + 2, CANDIDATES)
    pairs = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    step = min(2048, max(64, (1 << 22) // max(len(x), 1)))
    for i in range(0, len(q), step):
        s = q[i : i + step] @ x.T
        itself = np.flatnonzero(own[i : i + step] >= 0)
        s[itself, own[i : i + step][itself]] = -2
        hit = s >= least[i : i + step, None] - 1e-4
        r, c = np.nonzero(hit)
        many = np.flatnonzero(np.bincount(r, minlength=len(s)) > n)
        if len(many):
            top = np.argpartition(-s[many], n - 1, axis=1)[:, :n]
            hit[many] = False
            hit[many[:, None], top] = True
            r, c = np.nonzero(hit)
        pairs.append((r + i, c))
    r, c = (np.concatenate(p) for p in zip(*pairs))
    exact = np.einsum("nd,nd->n", q[r].astype(np.float64), x[c].astype(np.float64))
    order = np.lexsort((-exact, r))
    order = order[exact[order] >= least[r[order]]]
    r, c, exact = r[order], c[order], exact[order]
    last = np.minimum(np.searchsorted(r, r) + k, np.searchsorted(r, r, "right")) - 1
    best = exact >= exact[last]
    return r[best], c[best], exact[best]


def _search(k: int, width: int, least: float):
    def run(group: pa.Table) -> pa.Table:
        digests, roles = group.column("digest").to_pylist(), group.column("role").to_numpy()
        x = np.frombuffer(b"".join(group.column("vector").to_pylist()), np.float32).reshape(-1, DIMENSIONS)
        home: dict[bytes, int] = {}
        asked: dict[bytes, int] = {}
        for i in np.argsort(np.asarray(digests, dtype="S16"), kind="stable"):  # equal vectors of several tasks once
            if roles[i] & 1:
                home.setdefault(digests[i], i)
            if roles[i] & 2:
                asked.setdefault(digests[i], i)
        index, queries = np.fromiter(home.values(), np.int64), np.fromiter(asked.values(), np.int64)
        if not len(index) or not len(queries):
            return pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary()), "sim": pa.array([], pa.float64())})
        at = {digests[i]: n for n, i in enumerate(index)}
        own = np.fromiter((at.get(digests[i], -1) for i in queries), np.int64, len(queries))
        if least > -1:
            row, col, exact = _above(x[index], x[queries], own, k, np.full(len(queries), least))
            i, j = queries[row], index[col]
        else:
            found, _ = Graph(x[index]).search(x[queries], k, width, own)
            row, col = np.nonzero(found >= 0)
            i, j = queries[row], index[found[row, col]]
            exact = np.einsum("nd,nd->n", x[i].astype(np.float64), x[j].astype(np.float64))
        keep = [p for p in np.flatnonzero(exact >= least) if digests[i[p]] != digests[j[p]]]
        return pa.table({"a": pa.array([digests[i[p]] for p in keep], pa.binary()), "b": pa.array([digests[j[p]] for p in keep], pa.binary()), "sim": pa.array(exact[keep])})

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, x = _usable(b)
        yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(rows)), pa.array(_digests(x), pa.binary())], names=["id", "digest"])


def nearest(
    vectors: DataFrame, k: int = K, least: float = -1.0, routing: float = ROUTING, width: int = 24,
    every: int | None = None, sample: int = SAMPLE, shard: int = SHARD,
) -> DataFrame:
    """(id, neighbour, similarity): for each row of `vectors` (id BIGINT, embedding ARRAY) the k most
    similar rows with another id, of those with a cosine similarity of at least `least`.

    Approximate: a query asks its own shard, whose answer is exact, and the others that are needed for
    the share `routing` of true neighbours (1: as many as any of the calibration needs): by a beam of
    `width`, or with a floor `least` above -1 by block products, which are exact too. Where all rows ask
    with a floor, a pair that one of its vectors finds counts for both. With `every`, only the ids divisible by it ask; all rows are indexed. Ties go to the
    smaller id.

    NULL, too short or long, all-zero, NaN-bearing and infinite vectors and NULL ids take no part;
    vectors needn't have unit length. Repeated rows count once; ids with several vectors ask with each
    and get one list per vector, merged. Equal vectors are found exactly.
    """
    vectors = spread(vectors.select(F.col("id").cast("long").alias("id"), "embedding"))
    members = vectors.mapInArrow(_members, "id long, digest binary").distinct()
    total = vectors.count()
    shards = max(1, min(MAX_SHARDS, math.ceil(total / shard)))
    mutual = least > -1 and not every
    centroids, share, margin = fit_centroids(vectors, shards, total, routing, k, sample, least=least, mutual=mutual)
    # at most MAX_SHARDS numbers; the sample tells which shards are crowded
    parts = {i: math.ceil(n / (CROWDED * shard)) for i, n in enumerate(share * total) if n > CROWDED * shard}
    routed = vectors.mapInArrow(_route(centroids, margin, share * total, parts, every), f"shard long, role int, {_VECTOR}")
    # a task's share stays the same as the table grows: a few shards each
    tasks = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(centroids) + sum(parts.values()))
    links = routed.repartition(tasks, "shard").groupBy("shard").applyInArrow(_search(k, max(width, k + 2), least), "a binary, b binary, sim double")
    if mutual:
        ways = F.array(F.struct("a", "b", "sim"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
        links = links.select(F.inline(ways)).withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(64)))
        # a vector that very many found is cut to its best in each of many tasks before it meets in one
        some = links.groupBy("a", "salt").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("sim")).alias("d"), "b"))), 1, 2 * k).alias("near"))
        links = some.select("a", F.explode("near").alias("n")).select("a", F.col("n.b").alias("b"), (-F.col("n.d")).alias("sim"))
    # the k smallest other ids of a vector are all of it that any list can hold
    heads = _heads(members, k)
    best = links.groupBy("a").agg(F.collect_set(F.struct((-F.col("sim")).alias("d"), "b")).alias("near"))  # at most 2 k x shards visited, or x salts
    near = best.select("a", F.explode(F.slice(F.array_sort("near"), 1, 2 * k)).alias("n")).select("a", F.col("n.b").alias("b"), F.col("n.d").alias("d"))
    others = near.join(heads.withColumnRenamed("digest", "b"), "b").select("a", "d", "ids")
    lists = (
        others.unionByName(heads.where("size(ids) > 1").select(F.col("digest").alias("a"), F.lit(-1.0).alias("d"), "ids"))
        .select("a", F.explode("ids").alias("id"), "d")
        .groupBy("a").agg(F.slice(F.array_sort(F.collect_set(F.struct("d", "id"))), 1, k + 1).alias("list"))
    )
    asking = members.where(F.col("id") % every == 0) if every else members
    own = asking.withColumnRenamed("digest", "a").join(lists, "a")
    picked = own.select("id", F.explode(F.expr(f"slice(filter(list, x -> x.id <> id), 1, {k})")).alias("n"))
    return picked.groupBy("id", F.col("n.id").alias("neighbour")).agg((-F.min("n.d")).alias("similarity")).where(F.col("similarity") >= least)


def _heads(members: DataFrame, k: int) -> DataFrame:
    """(digest, ids): the k + 1 smallest ids of each vector. Two steps, so that a group of copies is
    cut to k + 1 ids in each of many tasks before it meets in one."""
    salted = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    cut = lambda df, *by: df.groupBy(*by).agg(F.slice(F.array_sort(F.collect_set("id")), 1, k + 1).alias("ids"))
    one = cut(salted, "digest", "salt")
    return cut(one.select("digest", F.explode("ids").alias("id")), "digest")


def recall(found: DataFrame, vectors: DataFrame, k: int, every: int) -> DataFrame:
    """(asked, recall) of `found` against brute force, for the ids divisible by `every` against all rows.

    The asking vectors are a stated set, gathered by groups of QUERY_BLOCK; each group meets all rows
    as matrix products of Arrow batches, and a task keeps k a query. Ties count as found.
    """
    vectors = vectors.select(F.col("id").cast("long").alias("id"), "embedding").distinct()
    asking = vectors.where(F.col("id") % every == 0)
    got = {}
    for b in asking.toArrow().combine_chunks().to_batches():
        rows, x = _usable(b)
        got |= {int(i): v for i, v in zip(b.column("id").take(pa.array(rows)).to_pylist(), x)}
    ids = np.fromiter(got, np.int64, len(got))
    q = np.stack([got[i] for i in ids.tolist()]) if got else np.empty((0, DIMENSIONS), np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, who = np.full((len(q), k), -2.0), np.full((len(q), k), -1, np.int64)
        for b in batches:
            rows, x = _usable(b)
            own = b.column("id").to_numpy()[rows]
            for i in range(0, len(q), QUERY_BLOCK):
                s = q[i : i + QUERY_BLOCK].astype(np.float64) @ x.astype(np.float64).T
                s[ids[i : i + QUERY_BLOCK, None] == own] = -2
                all_s = np.concatenate([best[i : i + QUERY_BLOCK], s], 1)
                all_w = np.concatenate([who[i : i + QUERY_BLOCK], np.broadcast_to(own, s.shape)], 1)
                top = np.argpartition(-all_s, k - 1, axis=1)[:, :k]
                best[i : i + QUERY_BLOCK], who[i : i + QUERY_BLOCK] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_w, top, 1)
        r, c = np.nonzero(who >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(who[r, c]), pa.array(best[r, c])], names=["id", "neighbour", "similarity"])

    true = vectors.mapInArrow(run, "id long, neighbour long, similarity double")
    true = true.groupBy("id", "neighbour").agg(F.max("similarity").alias("similarity")).groupBy("id").agg(F.slice(F.sort_array(F.collect_list("similarity"), False), 1, k).alias("s"))
    mine = found.groupBy("id").agg(F.collect_list("similarity").alias("f"))
    hits = F.expr("size(filter(coalesce(f, array()), x -> x >= element_at(s, -1) - 1e-6))")
    return true.join(mine, "id", "left").agg(F.count(F.lit(1)).alias("asked"), F.round(F.sum(F.least(hits, F.size("s"))) / F.sum(F.size("s")), 4).alias("recall"))
