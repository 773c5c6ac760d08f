"""The store: content diff, upsert and delete, derived labels, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.paths import lang_of

#: Settings a store is stamped with, in the order in which a mismatch is reported.
STAMPED = ("embed_model", "embed_dims", "chunk_chars", "chunk_overlap", "header_path", "md_splitter", "chunk_algo")


def current_files(files: DataFrame) -> DataFrame:
    """The latest scan of each (project, path); of equal times the greatest row."""
    rest = [c for c in files.columns if c not in ("project", "path")]
    order = ["seen_at", *[c for c in rest if c != "seen_at"]]
    return files.groupBy("project", "path").agg(F.max(F.struct(*order)).alias("r")).select("project", "path", *[F.col(f"r.{c}").alias(c) for c in rest])


def content_diff(current: DataFrame, stored: DataFrame) -> DataFrame:
    """(project, path, action): 'write' for new or changed digests, 'delete' for stored paths without a digest now.

    Both sides: (project, path, sha256). Only digests decide; modification times don't.
    """
    a = current.where("sha256 is not null").select("project", "path", F.col("sha256").alias("now"))
    b = stored.select("project", "path", F.col("sha256").alias("was"))
    both = a.unionByName(b, allowMissingColumns=True).groupBy("project", "path").agg(F.max("now").alias("now"), F.max("was").alias("was"))
    action = F.when(F.col("now").isNotNull() & ~F.col("now").eqNullSafe(F.col("was")), "write").when(F.col("now").isNull(), "delete")
    return both.select("project", "path", action.alias("action")).where("action is not null")


def scoped_diff(current: DataFrame, stored: DataFrame, named: DataFrame) -> DataFrame:
    """The diff of named paths only: all readable ones are written, even unchanged; stored ones that can't be read are deleted."""
    named = named.select("project", "path").distinct()
    writes = named.join(current.where("sha256 is not null").select("project", "path").distinct(), ["project", "path"], "left_semi").withColumn("action", F.lit("write"))
    gone = named.join(current.where("sha256 is not null"), ["project", "path"], "left_anti").join(stored, ["project", "path"], "left_semi")
    return writes.unionByName(gone.withColumn("action", F.lit("delete")))


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`stored` with the rows of the keys in `new` replaced by those of `new`."""
    return stored.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def delete(stored: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """`stored` without the rows of the keys in `gone`."""
    return stored.join(gone.select(*keys).distinct(), keys, "left_anti")


def write_partitions(df: DataFrame, path: str, by: str = "project") -> None:
    """Replace the partitions that `df` has rows of, each atomically; others stay."""
    df.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def relabelled(files: DataFrame) -> DataFrame:
    """Rows whose stored language isn't that of their path now: (project, path, lang, new_lang)."""
    return files.withColumn("new_lang", lang_of(F.col("path"))).where(~F.col("lang").eqNullSafe(F.col("new_lang"))).select("project", "path", "lang", "new_lang")


def orphans(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of `children` that `parents` doesn't have."""
    return children.select(*keys).distinct().join(parents.select(*keys).distinct(), keys, "left_anti")


def last_values(meta: DataFrame) -> DataFrame:
    """(project, key, value): the last write of each key, by ts."""
    return meta.groupBy("project", "key").agg(F.max_by("value", F.struct("ts", "value")).alias("value"))


def incompatible(stamp: dict[str, str] | None, settings: dict[str, str]) -> str | None:
    """Why a store stamped with other settings must be rebuilt; None if it fits or was never stamped."""
    for name in STAMPED:
        if stamp and name in stamp and stamp[name] != settings.get(name):
            return f"{name}: {stamp[name]} -> {settings.get(name)}"
    return None


def counts(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(project, files, chunks)."""
    f = files.groupBy("project").agg(F.countDistinct("path").alias("files"))
    c = chunks.groupBy("project").agg(F.countDistinct("chunk_id").alias("chunks"))
    return f.join(c, "project", "full").select("project", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("chunks", F.lit(0)).alias("chunks"))


def suppressed(paths: DataFrame, kept_by_own: Column, kept_in_effect: Column) -> DataFrame:
    """(project, suppressed): files that inherited excludes take away, never below 0."""
    n = F.greatest(F.lit(0), F.count_if(kept_by_own) - F.count_if(kept_in_effect))
    return paths.groupBy("project").agg(n.cast("long").alias("suppressed"))
