"""Fusion of ranked lanes, the pool cut over projects, diversification and the result payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions import fixed, text
from ridgeline.session import broadcast_if_small


def rrf(lanes: DataFrame, by: tuple[str, ...] = ("qid", "project"), k: int = fixed.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (…by, chunk_id, lane, pos): rrf to 6 digits, and each lane's position or NULL.

    lane is 'bm25' or 'dense'. `insert_ord` is the order in which a list-by-list merge meets the hits.
    """
    pos = lambda lane: F.min(F.when(F.col("lane") == lane, F.col("pos"))).cast("int")
    fused = lanes.groupBy(*by, "chunk_id").agg(F.sum(F.lit(1.0) / (F.lit(k + 1) + F.col("pos"))).alias("rrf"), pos("bm25").alias("bm25"), pos("dense").alias("dense"))
    return fused.withColumn("rrf", F.round("rrf", 6)).withColumn("insert_ord", F.coalesce("bm25", F.lit(fixed.CANDIDATES) + F.col("dense")))


def pool_cut(hits: DataFrame, root: Column, limit: int = fixed.CANDIDATES, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Cut each query's hits to `limit`: the root project keeps up to half, then one of each member a round.

    hits need project, rrf, project_ord and insert_ord (ties). In a round the members come in the order
    of their best hit, then one left over of the root. Adds pool_pos from 0.
    """
    half = max(1, limit // 2)
    order = [F.desc("rrf"), F.asc("project_ord"), F.asc("insert_ord")]
    placed = hits.withColumns({
        "_own": F.coalesce(F.col("project") == root, F.lit(False)),
        "_rn": F.row_number().over(Window.partitionBy(*by, "project").orderBy(*order)),
    })
    # no project can give more than `limit`, so the global order is taken of at most projects x limit rows
    placed = placed.where(F.col("_rn") <= limit).withColumn("_g", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    placed = placed.withColumn("_best", F.min("_g").over(Window.partitionBy(*by, "project")))
    first = F.col("_own") & (F.col("_rn") <= half)
    placed = placed.withColumns({
        "_phase": F.when(first, 0).otherwise(1),
        "_round": F.when(F.col("_own") & ~first, F.col("_rn") - half).otherwise(F.col("_rn")),
        "_slot": F.when(first, F.lit(0)).when(F.col("_own"), F.lit(2147483647)).otherwise(F.col("_best")),
    })
    cut = placed.withColumn("pool_pos", F.row_number().over(Window.partitionBy(*by).orderBy("_phase", "_round", "_slot")) - 1)
    return cut.where(F.col("pool_pos") < limit).drop("_own", "_rn", "_g", "_best", "_phase", "_round", "_slot")


def reranked(cut: DataFrame, queries: DataFrame) -> DataFrame:
    """The cut in a new order: by the share of the query's terms (qid, terms) that a hit's text holds, in `_re`.

    It is the offline stand-in for a model that reads query and text together; equal shares keep their order.
    """
    asked = queries.select("qid", "terms")
    share = F.size(F.array_intersect(text.index_terms(F.col("text")), "terms")) / F.greatest(F.size("terms"), F.lit(1))
    told = cut.join(broadcast_if_small(asked), "qid").withColumn("_re", F.round(share, 6)).drop("terms")
    return told.withColumn("pool_pos", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("_re"), "pool_pos")) - 1)  # a pool is cut to its limit


def diversify(hits: DataFrame, root: Column, k: int = fixed.DEFAULT_K, max_per_file: int = fixed.MAX_PER_FILE, by: tuple[str, ...] = ("qid",), pos: str = "pool_pos") -> DataFrame:
    """Drop doubles (same rel_path and collapsed text; the root's own wins), hold back hits above
    `max_per_file` of a file to the end, cut to k. Adds `rank` from 1."""
    own = F.coalesce(F.col("project") == root, F.lit(False))
    marked = hits.withColumns({"_own": own, "_fp": text.fingerprint(F.col("text"))})
    fp = Window.partitionBy(*by, "rel_path", "_fp")
    marked = marked.withColumn("_root_has", F.max("_own").over(fp)).where(F.col("_own") | ~F.col("_root_has"))
    one = marked.withColumn("_rn", F.row_number().over(fp.orderBy(pos))).where("_rn = 1")
    held = F.row_number().over(Window.partitionBy(*by, "project", "rel_path").orderBy(pos)) > max_per_file
    ranked = one.withColumn("_held", held).withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("_held", pos)))
    return ranked.where(F.col("rank") <= k).drop("_own", "_fp", "_root_has", "_rn", "_held")


def score(rerank: Column, fused: Column) -> Column:
    """The score shown: the reranker's unless it is missing or 0, else the fused one."""
    return F.when(rerank.isNotNull() & ~F.isnan(rerank) & (rerank != 0), rerank).otherwise(fused)


def payload(hits: DataFrame, preview_lines: int = fixed.PREVIEW_LINES, body: bool = False) -> DataFrame:
    """Result rows: rank, project, path, rel_path, lines, lang, score, scores, and preview or body on request."""
    cols = ["rank", "project", F.concat_ws("/", "project", "rel_path").alias("path"), "rel_path", F.array("start_line", "end_line").alias("lines"), "lang",
            score(F.col("scores.rerank"), F.col("scores.rrf")).alias("score"), "scores"]
    if preview_lines > 0:
        cols.append(text.preview(F.col("text"), preview_lines).alias("preview"))
    if body:
        cols.append(F.col("text").alias("body"))
    keep = [c for c in ("qid",) if c in hits.columns]
    return hits.select(*keep, *cols)
