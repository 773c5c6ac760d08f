"""Hybrid search over a root project and its members, as one plan for any number of queries."""

from __future__ import annotations

import difflib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import fixed
from ridgeline.functions.paths import matches_any
from ridgeline.functions.text import query_terms
from ridgeline.operators import dense, lexical, ranking
from ridgeline.session import staged

MODES = ("hybrid", "lexical", "semantic")


class SearchError(ValueError):
    """A request that can't be answered; the message says what would be valid."""


def check(query: str, mode: str = "hybrid", k: int = fixed.DEFAULT_K, lang: str | None = None, known_langs: list[str] | None = None) -> int:
    """Validate a request; returns k clamped to 1…50."""
    if not query or not query.strip():
        raise SearchError("query is empty")
    if mode not in MODES:
        raise SearchError(f"unknown mode {mode!r}; valid: {', '.join(MODES)}")
    if lang and known_langs is not None and lang not in known_langs:
        near = difflib.get_close_matches(lang, known_langs, n=1, cutoff=0.6)
        raise SearchError(f"unknown language {lang!r}; " + (f"did you mean {near[0]!r}?" if near else f"valid: {', '.join(sorted(known_langs))}"))
    return max(1, min(int(k), fixed.MAX_K))


def searchable(registry: DataFrame) -> DataFrame:
    """Rows that a search may start from: enabled and indexed at least once."""
    return registry.where("enabled and indexed_at is not null")


def lanes(
    chunks: DataFrame, vectors: DataFrame, queries: DataFrame, mode: str = "hybrid", candidates: int = fixed.CANDIDATES, dimensions: int = 64,
    index: str | None = None, projects: list[str] | None = None,
) -> DataFrame:
    """(qid, project, chunk_id, lane, pos): the lanes that `mode` asks for; the other isn't computed.

    index: a folder that `lexical.write_index` has filled from the same chunks; without one the texts are read.
    """
    out = None
    if mode in ("hybrid", "lexical"):
        scored = lexical.bm25_stored(chunks.sparkSession, index, queries.select("qid", "terms"), projects) if index else lexical.bm25(chunks, queries.select("qid", "terms"))
        out = lexical.top_per_project(scored, candidates).select("qid", "project", "chunk_id", F.lit("bm25").alias("lane"), "pos")
    if mode in ("hybrid", "semantic"):
        near = dense.knn(vectors, queries.select("qid", "vector"), dimensions, candidates)
        d = lexical.top_per_project(near, candidates, "distance").select("qid", "project", "chunk_id", F.lit("dense").alias("lane"), "pos")
        out = d if out is None else out.unionByName(d)
    if out is None:
        raise SearchError(f"unknown mode {mode!r}; valid: {', '.join(MODES)}")
    return out


def searchable_root(registry: DataFrame, root: str) -> None:
    """Refuse a root that isn't registered, enabled and indexed."""
    if searchable(registry).where(F.col("path") == root).isEmpty():
        raise SearchError(f"{root} isn't an enabled, indexed project")


def search(
    chunks: DataFrame, files: DataFrame, vectors: DataFrame, queries: DataFrame, root: str, projects: list[str] | None = None, mode: str = "hybrid",
    k: int = fixed.DEFAULT_K, lang: str | None = None, path_glob: str | None = None, rerank: bool = True,
    max_per_file: int = fixed.MAX_PER_FILE, preview_lines: int = fixed.PREVIEW_LINES, body: bool = False, candidates: int = fixed.CANDIDATES, dimensions: int = 64,
    index: str | None = None, registry: DataFrame | None = None,
) -> DataFrame:
    """The results of each query (qid, text, terms, vector): columns of `ranking.payload`.

    projects: the scope, root included (None: all). The filters `lang` ('' and None: none) and
    `path_glob` act on the lanes' survivors, as a search does that fetches its top candidates first.
    index: see `lanes`. registry: the root must be searchable by it. Requests that can't be answered
    raise SearchError before anything is read.
    """
    known = sorted(r["lang"] for r in files.select("lang").distinct().collect() if r["lang"]) if lang else None  # one row a language
    for r in queries.select("text").limit(dense.MAX_QUERIES).collect():  # a stated set; a larger one is refused by the lanes
        k = check(r["text"], mode, k, lang, known)
    if registry is not None:
        searchable_root(registry, root)
    scope = None
    if projects is not None:
        scope = sorted({root, *projects})
        chunks, files, vectors = (df.where(F.col("project").isin(scope)) for df in (chunks, files, vectors))
    # at most queries x projects x 2 candidates, written out so that the planner sees their size and
    # broadcasts them to the chunks where they are few; candidates without a row are dropped
    fused = staged(ranking.rrf(lanes(chunks, vectors, queries, mode, candidates, dimensions, index, scope)), "candidates")
    rows = chunks.select("project", "chunk_id", F.col("path").alias("rel_path"), "start_line", "end_line", "text")
    langs = files.groupBy("project", F.col("path").alias("rel_path")).agg(F.max_by("lang", F.struct("seen_at", "lang")).alias("lang")) if "seen_at" in files.columns else files.select("project", F.col("path").alias("rel_path"), "lang")
    hits = rows.join(fused, ["project", "chunk_id"]).dropDuplicates(["qid", "project", "chunk_id"]).join(langs, ["project", "rel_path"])
    if lang:
        hits = hits.where(F.col("lang") == lang)
    if path_glob:
        hits = hits.where(matches_any(F.col("rel_path"), [path_glob]))
    # the root comes first, then the members by name
    hits = hits.withColumn("project_ord", F.when(F.col("project") == root, F.lit("")).otherwise(F.col("project")))
    cut = ranking.pool_cut(hits, F.lit(root), candidates)
    rank = F.lit(None).cast("double")
    if rerank:
        cut = ranking.reranked(cut, queries)
        rank = F.col("_re")
    cut = cut.withColumn("scores", F.struct("rrf", "bm25", "dense", rank.alias("rerank")))
    return ranking.payload(ranking.diversify(cut, F.lit(root), k, max_per_file), preview_lines, body)


def envelope(results: DataFrame, totals: DataFrame, took_ms: int) -> DataFrame:
    """(qid, searched, took_ms, results, hint): one row a query that found something, with what was searched and how long it took."""
    cols = [c for c in results.columns if c != "qid"]
    found = results.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", *[c for c in cols if c != "rank"]))).alias("results"))  # at most k a query
    total = totals.select(F.struct("projects", "files", "chunks").alias("searched"))
    hint = F.when(F.size("results") == 0, "no hit; try other words or mode")
    return found.crossJoin(F.broadcast(total)).select("qid", "searched", F.lit(took_ms).alias("took_ms"), "results", hint.alias("hint"))  # one row


def make_queries(spark: SparkSession, texts: list[tuple[int, str]], vectors: dict[int, list[float]] | None = None, embed=None) -> DataFrame:
    """(qid, text, terms, vector) from query texts; vectors given, or made by an embedder."""
    for _, t in texts:
        check(t)
    model = embed or dense.hashed_ngrams()
    rows = [(q, t, query_terms(t), [float(x) for x in (vectors[q] if vectors else model([t])[0])]) for q, t in texts]
    return spark.createDataFrame(rows, "qid long, text string, terms array<string>, vector array<double>")


def scope_totals(files: DataFrame, chunks: DataFrame, projects: list[str]) -> DataFrame:
    """(projects, files, chunks) searched; projects without a store don't count."""
    f = files.where(F.col("project").isin(projects)).groupBy("project").agg(F.countDistinct("path").alias("f"))
    c = chunks.where(F.col("project").isin(projects)).groupBy("project").agg(F.countDistinct("chunk_id").alias("c"))
    return f.join(c, "project", "full").agg(F.count(F.lit(1)).alias("projects"), F.sum(F.coalesce("f", F.lit(0))).alias("files"), F.sum(F.coalesce("c", F.lit(0))).alias("chunks"))
