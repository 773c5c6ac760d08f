"""Queries of the training-data problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import encoding, handwritten, mixing, neighbours, normalise, ranking, spans, splitting
from ridgeline.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hit of each search by the combined ranking."""
    return ranking.best_hits(table(spark, sf_dir, "hits"))


def _chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").select(F.col("chunk_id").alias("id"), "text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with a span of 160 or more characters that also stands in another chunk."""
    return spans.shared_stretches(_chunk_texts(spark, sf_dir)).select(F.col("id").alias("chunk_id")).distinct()


def p3_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every chunk the number of its characters, and of those in shared spans."""
    chunks = _chunk_texts(spark, sf_dir)
    sizes = chunks.groupBy("id").agg(F.coalesce(F.max(F.length("text")), F.lit(0)).alias("chars"))
    shared = spans.shared_characters(chunks)
    return sizes.join(shared, "id", "left").select(F.col("id").alias("chunk_id"), "chars", F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"))


def _kinds(spark: SparkSession, sf_dir: str):
    return handwritten.classify(table(spark, sf_dir, "files"), table(spark, sf_dir, "chunks"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that aren't hand-written."""
    return _kinds(spark, sf_dir)[0].where("kind is not null").select("file_id").distinct()


def p4_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with its kind (NULL: hand-written) and what it was told by."""
    return _kinds(spark, sf_dir)[0]


def p4_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classifiers against the markers, on repositories held out."""
    return handwritten.validation_report(spark, _kinds(spark, sf_dir)[1])


def _chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks_vec").select(F.col("chunk_id").alias("id"), "embedding")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks of a similarity of at least 0.90, one among the 10 most similar of the other."""
    near = neighbours.nearest(_chunk_vectors(spark, sf_dir), k=10, least=0.9)
    return near.select(F.least("id", "neighbour").alias("chunk_a"), F.greatest("id", "neighbour").alias("chunk_b")).distinct()


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 most similar chunks of every chunk, by the settings of p5_found."""
    near = neighbours.nearest(_chunk_vectors(spark, sf_dir), k=10)
    return near.select(F.col("id").alias("chunk_id"), "neighbour", F.round("similarity", 6).alias("similarity"))


def p5_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asked, recall): the share of the true ten nearest that p5_neighbours gives, for the ids divisible by 50 against all rows."""
    vectors = _chunk_vectors(spark, sf_dir)
    return neighbours.recall(neighbours.nearest(vectors, k=10, every=50), vectors, 10, 50)


def p3_without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk's text less what an earlier chunk has, with the intervals removed."""
    out = spans.without_repeats(_chunk_texts(spark, sf_dir))
    return out.select(F.col("id").alias("chunk_id"), "text", F.to_json("removed").alias("removed"), "removed_chars")


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all oversized chunks."""
    return splitting.split_oversized(table(spark, sf_dir, "chunks"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that the splitter has to cut."""
    return p6_pieces(spark, sf_dir).where("piece = 0").select("chunk_id").distinct()


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return encoding.encode_texts(table(spark, sf_dir, "documents"), "doc_id")


def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of documents, of tokens, and of documents whose decoded ids differ from their text."""
    documents = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = encoding.encode_texts(documents, "doc_id")
    back = encoding.decode_ids(ids, "doc_id").select(F.col("doc_id").alias("id"), F.col("text").alias("decoded"))
    sizes = ids.agg(F.sum(F.size("ids")).alias("tokens"))
    same = documents.join(back, F.col("doc_id") == F.col("id"))
    return same.agg(F.count(F.lit(1)).alias("documents"), F.count_if(~F.col("decoded").eqNullSafe(F.col("text"))).alias("different")).crossJoin(F.broadcast(sizes))


def _mixture(spark: SparkSession, sf_dir: str) -> mixing.Mixture:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_plans"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the plans whose target can't be reached."""
    return mixing.unreachable(_mixture(spark, sf_dir))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets and the shares really reached, for every row of the plans."""
    return _mixture(spark, sf_dir).shares


def p8_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents selected for each plan and how often."""
    return _mixture(spark, sf_dir).selection


def p8_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classifier's held-out accuracy and the gradient steps made."""
    return mixing.fit_report(spark, _mixture(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that look the same with different characters."""
    return normalise.look_alikes(table(spark, sf_dir, "documents"))


def p9_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The look-alike classes, a row per document."""
    return normalise.look_alike_classes(table(spark, sf_dir, "documents"))


def p9_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text in its one form, case folded."""
    return normalise.normalise_texts(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "canonical")


QUERIES = {
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_shared": p3_shared,
    "p3_without_repeats": p3_without_repeats,
    "p4_found": p4_found,
    "p4_kinds": p4_kinds,
    "p4_validation": p4_validation,
    "p5_found": p5_found,
    "p5_neighbours": p5_neighbours,
    "p5_recall": p5_recall,
    "p6_found": p6_found,
    "p6_pieces": p6_pieces,
    "p7_ids": p7_ids,
    "p7_round_trip": p7_round_trip,
    "p8_found": p8_found,
    "p8_shares": p8_shares,
    "p8_selection": p8_selection,
    "p8_fit": p8_fit,
    "p9_found": p9_found,
    "p9_classes": p9_classes,
    "p9_canonical": p9_canonical,
}

_SCORES = (("rrf", ""), ("rerank", ""), ("bm25", "-"), ("dense", "-"), ("bm25_raw", "-"), ("distance", "-"))

ORACLE = {
    "p2_found": f"""
        WITH h AS (SELECT qid, chunk_id, max(scores) AS scores FROM hits GROUP BY 1, 2),
             l AS (SELECT qid, chunk_id, unnest([{", ".join(f"struct_pack(n := '{n}', v := {s}CASE WHEN isnan(scores.{n}::DOUBLE) THEN NULL ELSE scores.{n}::DOUBLE END)" for n, s in _SCORES)}], recursive := true) FROM h),
             m AS (SELECT *, v - median(v) OVER (PARTITION BY qid, n) AS d FROM l),
             q AS (SELECT *, median(abs(d)) OVER (PARTITION BY qid, n) * 1.4826 AS mad, avg(abs(d)) OVER (PARTITION BY qid, n) * 1.2533 AS aad,
                          count(v) OVER (PARTITION BY qid, n) AS c FROM m),
             z AS (SELECT qid, chunk_id, coalesce(d / CASE WHEN mad > 0 THEN mad WHEN aad > 0 THEN aad END, 0) AS z FROM q WHERE c > 0),
             s AS (SELECT qid, chunk_id, round(exp(avg(ln(greatest(1e-9, least(1 - 1e-9, 1 / (1 + exp(-z))))))), 9) AS s FROM z GROUP BY 1, 2),
             a AS (SELECT h.qid, h.chunk_id, coalesce(s.s, 0) AS s FROM h LEFT JOIN s ON h.qid = s.qid AND h.chunk_id = s.chunk_id)
        SELECT qid, chunk_id FROM a QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, chunk_id) = 1""",
    "p5_found": """
        WITH v AS (SELECT DISTINCT chunk_id, embedding::DOUBLE[] AS e FROM chunks_vec
                   WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
             s AS (SELECT a.chunk_id AS a, b.chunk_id AS b, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.chunk_id <> b.chunk_id),
             t AS (SELECT a, b FROM s WHERE s >= 0.9 QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 10)
        SELECT DISTINCT least(a, b) AS chunk_a, greatest(a, b) AS chunk_b FROM t""",
    "p6_found": r"""
        SELECT DISTINCT chunk_id FROM chunks
        WHERE length(regexp_replace(text, '[\t\n\x{0b}\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]', '', 'g')) > 2000""",
}
