"""Retrieval quality: queries from documentation, recall and MRR, paired significance."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions import fixed

#: A position behind a line break of any kind.
_BEHIND_BREAK = r"(?<=[\n\x0b\f\x1c-\x1e\x85\u2028\u2029])|(?<=\r)(?!\n)"
_OTHER_BREAK = r"[\x0b\f\x1c-\x1e\x85\u2028\u2029]|\r(?!\n)"
#: Where documentation stands, each a pattern of everything up to its end: in a source file a string
#: at the start, a block comment anywhere in the head, or the comment lines at the start; in prose a
#: heading, the blank lines under it, and the paragraph there.
_MARK = r"(?:/{2,}|\#+|--)"
_TITLE = r"\#{1,6}\s+\S"
_STARTING_STRING = r"(?sU)\A\s*[rub]?(\"{3}|'{3})(.*?)\1"
_BLOCK = r"(?s)\A.*?/\*+(.*?)\*/"
_COMMENT_LINES = rf"(?U)\A(?:[^\S\n]*\n)*((?:[^\S\n]*{_MARK}[^\n]*(?:\n|\z))+)"
_TITLE_LINE = rf"(?U)\A(?:(?!{_TITLE})[^\n]*\n)*+\#{{1,6}}\s+(\S[^\n]*?)\s*\#*[^\S\n]*(?:\n|\z)"
_PARAGRAPH = rf"(?U)\A((?:[^\S\n]*\n)*+)((?:(?!{_TITLE})[^\n]*\S[^\n]*(?:\n|\z))*+)"


def documentation(text: Column, lang: Column) -> Column:
    """A struct (said, end) of the documentation that a text begins with: its words without mark-up, and
    the number of characters up to its end. Only the first lines are looked at. All in built-in functions."""
    lines = F.slice(F.split(F.coalesce(text, F.lit("")), _BEHIND_BREAK), 1, fixed.EVAL_HEAD_LINES)
    head = F.regexp_replace(F.array_join(lines, ""), _OTHER_BREAK, "\n")  # of the same length
    part = lambda of, pattern, group: F.regexp_extract(of, pattern, group)
    block = lambda said, whole: F.struct(said.alias("raw"), F.length(whole).alias("end"))
    comments = part(head, _COMMENT_LINES, 1)
    source = (
        F.when(head.rlike(_STARTING_STRING), block(part(head, _STARTING_STRING, 2), part(head, _STARTING_STRING, 0)))
        .when(head.rlike(_BLOCK), block(part(head, _BLOCK, 1), part(head, _BLOCK, 0)))
        .otherwise(block(F.regexp_replace(comments, rf"(?mU)^\s*{_MARK}\s?", ""), part(head, _COMMENT_LINES, 0)))
    )
    title = part(head, _TITLE_LINE, 0)
    under = F.substring(head, F.length(title) + 1, F.length(head))
    prose = F.when(title != "", block(F.concat_ws(" ", part(head, _TITLE_LINE, 1), part(under, _PARAGRAPH, 2)), F.concat(title, part(under, _PARAGRAPH, 0)))).otherwise(block(F.lit(""), F.lit("")))
    found = F.when(lang.isin(list(fixed.DOC_LANGUAGES)), prose).otherwise(source)
    said = F.trim(F.regexp_replace(F.regexp_replace(found["raw"], "(?U)" + "|".join(fixed.EVAL_NOISE), " "), r"(?U)\s+", " "))
    return F.struct(said.alias("said"), found["end"].alias("end"))


def derive_queries(files: DataFrame) -> DataFrame:
    """(project, positive, lang, query, stripped) of (project, path, lang, text): the first words of the
    documentation as a query, and the text without it. Documentation of too few words gives no row."""
    lang = F.coalesce("lang", F.lit(""))
    found = files.withColumn("_d", documentation(F.col("text"), lang)).withColumn("_w", F.split("_d.said", " ")).where(F.size("_w") >= fixed.EVAL_MIN_WORDS)
    return found.select(
        "project", F.col("path").alias("positive"), "lang", F.array_join(F.slice("_w", 1, fixed.EVAL_MAX_WORDS), " ").alias("query"),
        F.substring("text", F.col("_d.end") + 1, F.length("text")).alias("stripped"),
    )


def stripped_corpus(files: DataFrame) -> DataFrame:
    """(project, path, lang, text): every file, those that give a query without the documentation it comes from."""
    q = derive_queries(files).select("project", F.col("positive").alias("path"), "stripped").withColumn("_found", F.lit(True))
    both = files.select("project", "path", "lang", "text").join(q, ["project", "path"], "left")
    return both.select("project", "path", "lang", F.when(F.col("_found"), F.col("stripped")).otherwise(F.col("text")).alias("text"))


def overlap(code: DataFrame, docs: DataFrame) -> DataFrame:
    """(project, path) in both of two corpora, which should be none."""
    return code.select("project", "path").intersect(docs.select("project", "path"))


def round_robin(df: DataFrame, by: str, order: str, limit: int) -> DataFrame:
    """Take one of each `by` a round, in its order, until `limit`."""
    rn = F.row_number().over(Window.partitionBy(by).orderBy(order))
    # no group gives more than `limit`, so each is cut to that before the groups meet
    return df.withColumn("_rn", rn).where(F.col("_rn") <= limit).orderBy("_rn", by).limit(limit).drop("_rn")


def metrics(ranks: DataFrame) -> DataFrame:
    """(arm, n, recall_at_1, recall_at_10, mrr) of (arm, qid, rank); rank NULL is a miss."""
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    part = lambda c: F.round(F.sum(c) / n, 4)
    return ranks.groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"),
        part(F.when(F.col("rank") == 1, 1).otherwise(0)).alias("recall_at_1"),
        part(F.when(F.col("rank") <= fixed.EVAL_K, 1).otherwise(0)).alias("recall_at_10"),
        part(F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0))).alias("mrr"),
    )


def hit(rank: Column, k: int = fixed.EVAL_K) -> Column:
    return F.when(rank <= k, 1).otherwise(0)


def discordance(ranks: DataFrame, base: str) -> DataFrame:
    """(arm, pairs, won, lost, delta): every other arm against `base`, over the queries both have."""
    b = ranks.where(F.col("arm") == base).select("qid", hit(F.col("rank")).alias("b"))
    a = ranks.where(F.col("arm") != base).select("arm", "qid", hit(F.col("rank")).alias("a"))
    return a.join(b, "qid").groupBy("arm").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("a") > F.col("b")).alias("won"), F.count_if(F.col("a") < F.col("b")).alias("lost"),
        F.round(F.avg(F.col("a") - F.col("b")), 4).alias("delta"),
    )


def mcnemar_p(won: int, lost: int) -> float:
    """Two-sided exact p of the discordant pairs; 1 without any."""
    n = won + lost
    return 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(min(won, lost) + 1)) / 2**n)


def mcnemar(counts: DataFrame) -> DataFrame:
    """`counts` (…, won, lost) with p; a row per arm, so a Python function costs nothing."""

    def p(won: pd.Series, lost: pd.Series) -> pd.Series:
        return pd.Series([mcnemar_p(int(a), int(b)) for a, b in zip(won, lost)])

    p.__annotations__ = {"won": pd.Series, "lost": pd.Series, "return": pd.Series}
    return counts.withColumn("p", F.pandas_udf(p, "double")("won", "lost"))


def adjust(p_values: DataFrame, p: str = "p", by: str | None = None) -> DataFrame:
    """`p_adjusted` by Benjamini and Hochberg over all rows, or each `by`; NULL p stays out and gives NULL.

    Equal p are counted and placed once. The places come from sums over ranges of p and within each
    range, so no family is ordered in one task.
    """
    own = [by] if by else []
    counts = p_values.where(F.col(p).isNotNull()).groupBy(*own, p).agg(F.count(F.lit(1)).alias("_n")).withColumn("_cell", F.floor(F.col(p) * 4096).cast("int"))
    cells = counts.groupBy(*own, "_cell").agg(F.sum("_n").alias("_cn"))
    total = cells.groupBy(*own).agg(F.sum("_cn").alias("_m")) if own else cells.agg(F.sum("_cn").alias("_m"))
    family = Window.partitionBy(*own) if own else Window.partitionBy()  # at most 4,097 cells a family
    before = F.sum("_cn").over(family.orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_cn")
    placed = cells.withColumn("_before", before).select(*own, "_cell", "_before")
    w = Window.partitionBy(*own, "_cell").orderBy(p)
    ranked = counts.join(placed, [*own, "_cell"])
    ranked = ranked.join(total, own) if own else ranked.crossJoin(F.broadcast(total))  # one row
    k = F.col("_before") + F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = ranked.withColumn("_q", F.col(p) * F.col("_m") / k)
    least = ranked.groupBy(*own, "_cell").agg(F.min("_q").alias("_cq"))
    after = least.withColumn("_after", F.min("_cq").over(family.orderBy("_cell").rowsBetween(1, Window.unboundedFollowing))).select(*own, "_cell", "_after")
    inside = F.min("_q").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    done = ranked.withColumn("_inside", inside).join(after, [*own, "_cell"])
    final = done.select(*own, p, F.least(F.lit(1.0), F.col("_inside"), F.coalesce("_after", F.lit(1.0))).alias("p_adjusted"))
    return p_values.join(final, [*own, p], "left").select(*p_values.columns, "p_adjusted")


def bootstrap(ranks: DataFrame, base: str, resamples: int = fixed.RESAMPLES, seed: int = 0) -> DataFrame:
    """(arm, delta, low, high): the mean difference to `base` and its 95 % interval over resampled queries.

    A query counts by its difference alone (-1, 0 or 1), so the counts of the three are resampled
    (multinomial): what reaches one task is three numbers an arm, whatever the number of queries.
    """
    d = discordance(ranks, base)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            rows = []
            for r in t.itertuples():
                n = int(r.pairs)
                rng = np.random.default_rng(seed)
                draws = rng.multinomial(n, [r.won / n, r.lost / n, (n - r.won - r.lost) / n], resamples)
                means = np.sort((draws[:, 0] - draws[:, 1]) / n)
                rows.append((r.arm, (r.won - r.lost) / n, means[int(0.025 * resamples)], means[int(0.975 * resamples) - 1]))
            yield pd.DataFrame(rows, columns=["arm", "delta", "low", "high"])

    return d.mapInPandas(run, "arm string, delta double, low double, high double")


def percentiles(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, median, p95): the exact median, and the value at index floor(0.95 n) - 1 of the sorted ones."""
    w = Window.partitionBy(by).orderBy(value)
    ranked = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("_c"))
    ranked = ranked.withColumn("_end", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(Window.partitionBy(by)))
    at = lambda i: F.min(F.when(F.col("_end") > i, F.col(value)))
    n = F.col("_n")
    return ranked.groupBy(by).agg(
        F.max("_n").alias("n"), ((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2).alias("median"),
        at(F.greatest(F.floor(n * 0.95) - 1, F.lit(0))).alias("p95"),
    )
