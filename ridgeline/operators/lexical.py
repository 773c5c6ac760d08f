"""BM25 over postings, per project: from chunks, or from postings that an index pass has written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.functions import fixed, text
from ridgeline.session import spread, staged


def _fields(chunks: DataFrame) -> Column:
    """All index terms of a chunk's text, tokens and header."""
    empty = F.array().cast("array<string>")
    tokens = F.transform(F.coalesce("tokens", empty), lambda t: F.lower(t))
    return F.concat(F.coalesce(text.index_terms(F.col("text")), empty), F.filter(tokens, lambda t: t.isNotNull()), F.coalesce(text.index_terms(F.col("header")), empty))


def term_lists(chunks: DataFrame, keys: tuple[str, ...] = ("project", "chunk_id")) -> DataFrame:
    """(keys, terms, doc_len), a row per distinct chunk."""
    chunks = spread(chunks.select(*keys, "text", "tokens", "header"))
    one = chunks.select(*keys, _fields(chunks).alias("terms")).dropDuplicates(list(keys))
    return one.withColumn("doc_len", F.size("terms"))


def postings(chunks: DataFrame) -> DataFrame:
    """(project, chunk_id, term, tf)."""
    return term_lists(chunks).select("project", "chunk_id", F.explode("terms").alias("term")).groupBy("project", "chunk_id", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """(project, n_docs, avgdl)."""
    return term_lists(chunks).groupBy("project").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("doc_len").alias("avgdl"))


#: Folders of stored postings by the hash of the term; a search reads those of its terms.
BUCKETS = 64
#: Terms that one search may ask for, over all its queries.
MAX_TERMS = 20_000


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def bucket_numbers(spark: SparkSession, words: list[str]) -> list[int]:
    """The buckets of some terms: by the same hash on the driver, or by a query where its library isn't there."""
    try:
        import xxhash
    except ImportError:
        rows = spark.createDataFrame([(w,) for w in words], "w string").select(bucket_of(F.col("w")).alias("b")).distinct()
        return sorted(r["b"] for r in rows.collect())
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    return sorted({signed(xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 42)) % BUCKETS for w in words})


def write_postings(lists: DataFrame, path: str, keys: tuple[str, ...] = ("project", "chunk_id")) -> None:
    """Write the postings (term, keys, tf, doc_len) of `lists` (keys, terms, doc_len) below `path`, by bucket and sorted
    by term, so that a search reads one folder a bucket and skips the row groups of other terms."""
    rows = lists.select(*keys, "doc_len", F.explode("terms").alias("term")).groupBy("term", *keys).agg(F.count(F.lit(1)).cast("int").alias("tf"), F.max("doc_len").alias("doc_len"))
    rows = rows.withColumn("bucket", bucket_of(F.col("term")))
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path)


def write_index(chunks: DataFrame, path: str) -> None:
    """The lexical index of a table of chunks: `path`/postings, and `path`/stats with (project, n_docs, avgdl)."""
    lists = staged(term_lists(chunks), "term-lists")
    write_postings(lists, f"{path}/postings")
    lists.groupBy("project").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("doc_len").alias("avgdl")).write.parquet(f"{path}/stats")


def asked_terms(queries: DataFrame) -> tuple[DataFrame, list[str]]:
    """((qid, term), the distinct terms) of queries (qid, terms ARRAY<STRING>): a stated set, bounded by MAX_TERMS."""
    pairs = sorted({(r["qid"], t) for r in queries.select("qid", "terms").limit(MAX_TERMS + 1).collect() for t in r["terms"] or () if t is not None})
    if len(pairs) > MAX_TERMS:
        raise ValueError(f"the queries ask for more than {MAX_TERMS} terms; ask in several searches")
    asked = queries.sparkSession.createDataFrame(pairs, "qid long, term string")
    return asked, sorted({t for _, t in pairs})


def _weighed(found: DataFrame, stats: DataFrame, asked: DataFrame) -> DataFrame:
    """(qid, project, chunk_id, score) of (project, chunk_id, term, tf, doc_len) rows that hold all of the asked terms' postings."""
    df = found.groupBy("project", "term").agg(F.count(F.lit(1)).alias("n_t"))
    idf = F.log((F.col("n_docs") - F.col("n_t") + 0.5) / (F.col("n_t") + 0.5))
    weight = df.join(stats, "project").select("project", "term", "avgdl", F.when(idf <= 0, F.lit(fixed.BM25_FLOOR)).otherwise(idf).alias("idf"))
    k1, b = fixed.BM25_K1, fixed.BM25_B
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / F.col("avgdl")))
    return (
        found.join(weight, ["project", "term"]).join(F.broadcast(asked), "term")  # at most MAX_TERMS rows
        .groupBy("qid", "project", "chunk_id").agg((-F.sum(part)).alias("score"))
    )


def stored_postings(spark: SparkSession, path: str, words: list[str]) -> DataFrame:
    """The postings of some terms: only their folders are listed, and the terms are pushed to the scan."""
    return spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(bucket_numbers(spark, words)) & F.col("term").isin(words)).drop("bucket")


def bm25_stored(spark: SparkSession, path: str, queries: DataFrame, projects: list[str] | None = None) -> DataFrame:
    """(qid, project, chunk_id, score) by the index that `write_index` has left in `path`; smaller is better.

    Reads the postings of the asked terms, of `projects` only if given, and a row a project of statistics.
    """
    asked, words = asked_terms(queries)
    found, stats = stored_postings(spark, path, words), spark.read.parquet(f"{path}/stats")
    if projects is not None:
        found, stats = found.where(F.col("project").isin(projects)), stats.where(F.col("project").isin(projects))
    return _weighed(found, stats, asked)


def bm25(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, project, chunk_id, score) of all chunks with a term of the query; smaller is better.

    Without an index: every text is read once, and the asked terms filter its terms where it is read.
    What is shuffled is each chunk's length and its occurrences of the terms asked for.
    """
    asked, words = asked_terms(queries)
    chunks = spread(chunks.select("project", "chunk_id", "text", "tokens", "header"))
    read = chunks.select("project", "chunk_id", _fields(chunks).alias("_terms"))
    lists = read.select("project", "chunk_id", F.size("_terms").alias("doc_len"), F.filter("_terms", lambda t: t.isin(words)).alias("_hits")).dropDuplicates(["project", "chunk_id"])
    stats = lists.groupBy("project").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("doc_len").alias("avgdl"))
    found = lists.select("project", "chunk_id", "doc_len", F.explode("_hits").alias("term")).groupBy("project", "chunk_id", "doc_len", "term").agg(F.count(F.lit(1)).alias("tf"))
    return _weighed(found, stats, asked)


def top_per_project(scored: DataFrame, n: int = fixed.CANDIDATES, score: str = "score", digits: int = 9) -> DataFrame:
    """The n best of each (qid, project) with `pos` from 0; ties by chunk_id."""
    w = Window.partitionBy("qid", "project").orderBy("_r", "chunk_id")
    return scored.withColumn("_r", F.round(score, digits)).withColumn("pos", F.row_number().over(w) - 1).where(F.col("pos") < n).drop("_r")
