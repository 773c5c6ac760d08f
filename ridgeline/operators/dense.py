"""Vector search: exact cosine distance, pooling and pluggable embedders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine similarity of two arrays of one length."""
    return 1 - _dot(a, b) / F.sqrt(_dot(a, a) * _dot(b, b))


def usable(v: Column, dimensions: int) -> Column:
    """Vectors of the right length, all numbers finite, not all zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & (F.size(v) == dimensions) & fine & F.exists(v, lambda x: x != 0)


#: Query vectors that one search may bring.
MAX_QUERIES = 20_000


def knn(vectors: DataFrame, queries: DataFrame, dimensions: int = 64, n: int = 60) -> DataFrame:
    """(qid, project, chunk_id, distance): the n nearest chunks of each project to each query, exact.

    queries: (qid, vector), a stated set bounded by MAX_QUERIES; the vectors travel to the workers with
    the task. Each Arrow batch is one matrix product, and each task keeps its n best per query and
    project, so what is shuffled doesn't grow with the table but with tasks x projects x n. Unusable
    vectors take no part; repeated rows count once.
    """
    asked = [(r["qid"], np.asarray(r["vector"], np.float64)) for r in queries.select("qid", "vector").limit(MAX_QUERIES + 1).collect()]
    schema = "qid long, project string, chunk_id long, distance double"
    if len(asked) > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} query vectors; ask in several searches")
    if not asked:
        return vectors.sparkSession.createDataFrame([], schema)
    q = np.stack([v / np.linalg.norm(v) for _, v in asked])
    qids = np.array([i for i, _ in asked])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str | None, int] = {}
        best: list[tuple[np.ndarray, ...]] | None = None
        for b in batches:
            e = b.column("embedding")
            offsets = e.offsets.to_numpy()
            fit = np.flatnonzero(e.is_valid().to_numpy(zero_copy_only=False) & (np.diff(offsets) == dimensions))
            flat = e.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
            x = flat[offsets[fit][:, None] + np.arange(dimensions)] if len(fit) else np.empty((0, dimensions))
            with np.errstate(all="ignore"):
                norm = np.sqrt((x * x).sum(1))
            good = np.isfinite(x).all(1) & np.isfinite(norm) & (norm > 0)
            rows, x = fit[good], x[good] / norm[good, None]
            project = np.array([names.setdefault(p, len(names)) for p in b.column("project").take(pa.array(rows)).to_pylist()], np.int64)
            ids = b.column("chunk_id").to_numpy(zero_copy_only=False)[rows]
            d = 1 - q @ x.T
            best = best or [(np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64))] * len(q)
            for i in range(len(q)):
                best[i] = _keep(np.r_[best[i][0], d[i]], np.r_[best[i][1], project], np.r_[best[i][2], ids], n)
        back = list(names)
        for i, (d, p, c) in enumerate(best or ()):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), qids[i])), pa.array([back[k] for k in p], pa.string()), pa.array(c), pa.array(d)], names=["qid", "project", "chunk_id", "distance"])

    return vectors.where("chunk_id is not null").select("project", "chunk_id", "embedding").mapInArrow(run, schema).distinct()


def _keep(distance: np.ndarray, project: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n nearest different ids of each project."""
    order = np.lexsort((ids, distance, project))
    distance, project, ids = distance[order], project[order], ids[order]
    new = np.r_[True, (ids[1:] != ids[:-1]) | (project[1:] != project[:-1]) | (distance[1:] != distance[:-1])][: len(ids)]
    distance, project, ids = distance[new], project[new], ids[new]
    fits = np.arange(len(project)) - np.searchsorted(project, project) < n
    return distance[fits], project[fits], ids[fits]


def pool(hidden: np.ndarray, mask: np.ndarray, how: str = "cls", dimensions: int | None = None) -> np.ndarray:
    """Token states (texts, tokens, width) to unit vectors: the first token's state or the masked mean, cut to `dimensions`."""
    if how == "cls":
        out = hidden[:, 0]
    elif how == "mean":
        m = mask[..., None].astype(hidden.dtype)
        out = (hidden * m).sum(1) / np.clip(m.sum(1), 1e-9, None)
    else:
        raise ValueError(f"unknown pooling {how!r}")
    out = out[:, :dimensions]
    return out / np.clip(np.linalg.norm(out, axis=1, keepdims=True), 1e-12, None)


def hashed_ngrams(dimensions: int = 64) -> Callable[[list[str]], np.ndarray]:
    """The offline stand-in for a model: hashed character trigrams, unit length, the same everywhere."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions))
        framed = [f" {(t or '').lower()} " for t in texts]
        sizes = np.array([len(s) for s in framed], np.int64)
        ends = np.cumsum(sizes)
        # blocks of whole texts, so that memory follows the longest text and not the batch
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] - sizes[first] + _STRETCH, side="right")))
            codes = np.frombuffer("".join(framed[first:last]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            owner = np.repeat(np.arange(first, last), sizes[first:last])
            if len(codes) > 2:
                inside = owner[2:] == owner[:-2]
                h = _mixed((codes[:-2] * _MULTIPLIERS[0] + codes[1:-1]) * _MULTIPLIERS[1] + codes[2:])[inside]
                cell = owner[2:][inside] * dimensions + (h % np.uint64(dimensions)).astype(np.int64)
                sign = np.where(h >> np.uint64(63), 1.0, -1.0)
                out += np.bincount(cell, weights=sign, minlength=out.size).reshape(out.shape)
            first = last
        return out / np.clip(np.linalg.norm(out, axis=1, keepdims=True), 1e-12, None)

    return embed


_STRETCH = 1 << 20
_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


#: What is put before a text on each side; a provider may need other prefixes.
SIDES = {"query": "", "document": ""}


def embed_column(df: DataFrame, text: str, into: str, load: Callable[[], Callable[[list[str]], np.ndarray]] = hashed_ngrams, side: str = "document") -> DataFrame:
    """`df` with the vectors of a text column; `load` is called once a task and returns the model."""
    if side not in SIDES:
        raise ValueError(f"unknown side {side!r}; valid: {', '.join(sorted(SIDES))}")
    prefix = SIDES[side]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in batches:
            yield pd.Series(list(model([prefix + (x or "") for x in s]).astype(np.float32)))

    return df.withColumn(into, F.pandas_udf(run, "array<float>")(F.col(text)))


# so that Spark sees the iterator form of the function above
embed_column.__annotations__["return"] = DataFrame


def overlap_score(query: str, text: Column) -> Column:
    """The offline stand-in for a reranker: the share of the query's terms that the text holds."""
    from ridgeline.functions.text import index_terms, query_terms

    wanted = query_terms(query)
    if not wanted:
        return F.lit(0.0)
    return F.size(F.array_intersect(index_terms(text), F.array(*[F.lit(w) for w in wanted]))) / F.lit(float(len(wanted)))
