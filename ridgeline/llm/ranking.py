"""One ranking from several differently scaled scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scale of the median absolute deviation to a standard deviation of normal values.
MAD_SCALE = 1.4826
#: Groups of up to this many rows get their medians from the exact `percentile` aggregate, whose
#: buffer holds a group's distinct values; larger ones from `histogram_medians`.
BUFFER_ROWS = 200_000
FLOOR = 1e-9


def _bucket(x: Column) -> Column:
    """A BIGINT that grows with the finite double `x`: 256 buckets an octave on either side of 0."""
    magnitude = F.when(x == 0, F.lit(0.0)).otherwise(F.log2(F.abs(x)) + 1100)
    return F.when(x < 0, -F.floor(magnitude * 256)).otherwise(F.floor(magnitude * 256)).cast("long")


def _narrow(counts: DataFrame, keys: Sequence[str], cell: Column) -> DataFrame:
    """The rows of `counts` (keys, value, _n, _before, _all) whose cell holds a middle rank.

    `_before` counts the rows of the key before the cells looked at; it is carried on to the chosen cells.
    """
    counts = counts.withColumn("_cell", cell)
    cells = counts.groupBy(*keys, "_cell").agg(F.sum("_n").alias("_cn"), F.max("_before").alias("_b"), F.max("_all").alias("_a"))
    w = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = cells.withColumn("_start", F.col("_b") + F.sum("_cn").over(w) - F.col("_cn"))
    lo, hi = F.floor((F.col("_a") - 1) / 2), F.floor(F.col("_a") / 2)
    middle = placed.where((F.col("_start") <= hi) & (F.col("_start") + F.col("_cn") > lo)).select(*keys, "_cell", "_start")
    return counts.join(middle, [*keys, "_cell"]).withColumn("_before", F.col("_start")).drop("_start")


def histogram_medians(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, median) of any group size, exact, without a group in one task.

    Equal values are counted (map-side combined). Two levels of cells narrow the values down to those
    about the middle ranks: 256 an octave, then 65,536 equal parts of the range of each cell chosen.
    Only the values of the parts that hold the middle ranks are ordered.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    sizes = counts.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    first = _narrow(counts.join(sizes, list(keys)).withColumn("_before", F.lit(0).cast("long")), keys, _bucket(F.col(value))).withColumnRenamed("_cell", "_first")
    within = [*keys, "_first"]
    ranges = first.groupBy(*within).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    part = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 65_535)).otherwise(F.lit(0)).cast("long")
    found = _narrow(first.join(ranges, within), within, part)
    cum = F.sum("_n").over(Window.partitionBy(*within, "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = found.withColumn("_end", F.col("_before") + cum).withColumn("_start", F.col("_end") - F.col("_n"))
    pick = lambda r: F.max(F.when((F.col("_start") <= r) & (F.col("_end") > r), F.col(value)))
    return ranked.groupBy(*keys).agg(((pick(F.floor((F.col("_all") - 1) / 2)) + pick(F.floor(F.col("_all") / 2))) / 2).alias("median"))


def _medians(wide: DataFrame, key: str, names: Sequence[str], buffer_rows: int) -> DataFrame:
    """One row per key with an exact median per column of `names`; large keys go the distributed way."""
    sizes = wide.groupBy(key).agg(F.count(F.lit(1)).alias("_size"))
    large = sizes.where(F.col("_size") > buffer_rows).select(key)
    exact = [F.percentile(n, F.lit(0.5)).alias(n) for n in names]
    if large.isEmpty():
        return wide.groupBy(key).agg(*exact)
    small = wide.join(large, key, "left_anti").groupBy(key).agg(*exact)
    long = wide.join(large, key, "left_semi").select(key, F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])).alias("_name", "_v"))
    found = histogram_medians(long, [key, "_name"], "_v")
    wide_again = found.groupBy(key).agg(*[F.max(F.when(F.col("_name") == n, F.col("median"))).alias(n) for n in names])
    return small.unionByName(wide_again)


def combine_scores(
    hits: DataFrame,
    key: str,
    scores: Mapping[str, tuple[Column, bool]],
    weights: Mapping[str, float] | None = None,
    buffer_rows: int = BUFFER_ROWS,
) -> DataFrame:
    """`hits` with a column `combined` in (0, 1): larger is better, no score counts by its range.

    scores: name -> (column, larger is better). Within each `key`, a score is standardised by its
    median and median absolute deviation (if that is 0: by the mean absolute deviation), squashed by
    the logistic function, so an outlier can't exceed 1, and the bounded values are combined by a
    weighted geometric mean (weights: 1 each by default).

    A column `combined` of the input is replaced. NULL, NaN and infinite scores are missing. A score that no hit of a key has takes no part there.
    A hit without a score that others of its key have gets the middle value 0.5 for it, neither
    better nor worse than the key's median. Constant scores give 0.5 to all. A key whose hits have no
    score at all gets `combined` NULL. Rows with a NULL key are one group. Repeated rows are the
    caller's to remove: each counts. Empty input gives an empty result.
    """
    names = list(scores)
    weights = {n: 1.0 for n in names} | dict(weights or {})
    val = lambda n: F.when(F.isnan(scores[n][0]) | (F.abs(scores[n][0]) == float("inf")), None).otherwise(scores[n][0].cast("double") * (1.0 if scores[n][1] else -1.0))
    free = "_"
    while any(c.startswith(free) for c in hits.columns):
        free += "_"
    k, own = f"{free}key", [f"{free}s{i}" for i in range(len(names))]
    base = hits.withColumns({k: F.coalesce(F.to_json(F.struct(F.col(key).alias("v"))), F.lit(""))} | {c: val(n) for c, n in zip(own, names)})
    mid = _medians(base.select(k, *own), k, own, buffer_rows).select(k, *[F.col(c).alias(f"{c}m") for c in own])
    dev = base.join(mid, k).withColumns({f"{c}d": F.col(c) - F.col(f"{c}m") for c in own})
    absolute = dev.select(k, *[F.abs(f"{c}d").alias(c) for c in own])
    mad = _medians(absolute, k, own, buffer_rows).select(k, *[F.col(c).alias(f"{c}q") for c in own])
    mean = absolute.groupBy(k).agg(*[F.avg(c).alias(f"{c}a") for c in own])
    scaled = dev.join(mad.join(mean, k), k)
    total, weight = F.lit(0.0), F.lit(0.0)
    for c, n in zip(own, names):
        spread = F.when(F.col(f"{c}q") > 0, F.col(f"{c}q") * MAD_SCALE).otherwise(F.when(F.col(f"{c}a") > 0, F.col(f"{c}a") * 1.2533))
        z = F.coalesce(F.col(f"{c}d") / spread, F.lit(0.0))
        bounded = F.greatest(F.lit(FLOOR), F.least(F.lit(1 - FLOOR), 1 / (1 + F.exp(-z))))
        present = F.col(f"{c}m").isNotNull()
        total = total + F.when(present, F.log(bounded) * weights[n]).otherwise(0.0)
        weight = weight + F.when(present, F.lit(weights[n])).otherwise(0.0)
    kept = [c for c in hits.columns if c != "combined"]
    return scaled.select(*kept, F.when(weight > 0, F.exp(total / weight)).alias("combined"))


def rank_hits(hits: DataFrame, buffer_rows: int = BUFFER_ROWS) -> DataFrame:
    """(qid, chunk_id, combined) of the distinct hits; a hit given several times counts once.

    All six scores count alike. Hits with a NULL `scores` have no score and stay, with the middle
    value for each. Of rows of one (qid, chunk_id) with different scores the greatest struct is kept.
    """
    one = hits.groupBy("qid", "chunk_id").agg(F.max("scores").alias("scores"))
    larger = {"rrf": True, "rerank": True, "bm25": False, "dense": False, "bm25_raw": False, "distance": False}
    cols = {n: (F.col(f"scores.{n}").cast("double"), up) for n, up in larger.items()}
    return combine_scores(one, "qid", cols, buffer_rows=buffer_rows).select("qid", "chunk_id", "combined")


def best_hits(hits: DataFrame, buffer_rows: int = BUFFER_ROWS) -> DataFrame:
    """(qid, chunk_id): the first of each search; ties go to the smaller chunk_id."""
    ranked = rank_hits(hits, buffer_rows)
    first = F.min(F.struct(-F.round(F.coalesce("combined", F.lit(0.0)), 9), F.col("chunk_id")))
    return ranked.groupBy("qid").agg(first.alias("f")).select("qid", F.col("f.chunk_id").alias("chunk_id"))
