"""The change feed: events in micro-batches, grouped to one job a project, applied without harm if repeated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions.paths import indexable
from ridgeline.operators.registry import owners
from ridgeline.sources.corpus import git_ignored

EVENT = "seq long, change string, path string"
DEBOUNCE = "1500 milliseconds"


#: Paths of a job at most; a project with more changes gets several jobs.
JOB_PATHS = 10_000


def changed_paths(events: DataFrame, projects: DataFrame) -> DataFrame:
    """(project, rel): the distinct indexable paths of events (path), each with the project that owns it."""
    owned = owners(events.select("path").distinct(), projects).where("owner is not null")
    rel = owned.select(F.col("owner").alias("project"), F.expr("substring(path, length(owner) + 2)").alias("rel")).where("rel <> ''")
    return rel.where(indexable(F.col("rel")))


def jobs(events: DataFrame, projects: DataFrame, most: int = JOB_PATHS) -> DataFrame:
    """(project, paths): the changed paths as jobs of one project, of about `most` paths each at most."""
    paths = changed_paths(events, projects)
    parts = paths.groupBy("project").agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).alias("parts"))
    dealt = paths.join(parts, "project").withColumn("part", F.pmod(F.xxhash64("rel"), "parts"))
    return dealt.groupBy("project", "part").agg(F.sort_array(F.collect_set("rel")).alias("paths")).drop("part")


def coalesce_jobs(queue: DataFrame) -> DataFrame:
    """A queue (seq, project, paths) without repeated whole-project jobs (NULL paths); partial ones stay."""
    whole = queue.where("paths is null").groupBy("project").agg(F.min("seq").alias("seq")).withColumn("paths", F.lit(None).cast("array<string>"))
    return whole.select(*queue.columns).unionByName(queue.where("paths is not null"))


def watch(
    spark: SparkSession, log_dir: str, projects: DataFrame, apply: Callable[[str, list[str], int], None], checkpoint: str,
    on_error: Callable[[str, Exception], None] | None = None, once: bool = False, respect_gitignore: bool = True,
):
    """Follow a folder of JSON change events; `apply(project, paths, batch)` is called for each job of a batch.

    Paths that the project's git ignores are left out; a job of nothing else isn't run.

    A failing project is reported and the others go on. Delivery is at least once; `apply` decides by
    content, so a repeated batch changes nothing. With `once` all there is is processed, then it ends.
    """
    stream = spark.readStream.schema(EVENT).json(log_dir)

    def batch(df: DataFrame, number: int) -> None:
        for row in jobs(df, projects).toLocalIterator():  # a job at a time
            try:
                ignored = git_ignored(row["project"], row["paths"]) if respect_gitignore else set()
                named = [p for p in row["paths"] if p not in ignored]
                if named:
                    apply(row["project"], named, number)
            except Exception as e:  # noqa: BLE001
                if on_error is None:
                    raise
                on_error(row["project"], e)

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=DEBOUNCE)).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """(start, event_type, n): an extension, counts by event time with a watermark; works on streams and tables."""
    stream = events.withWatermark("ts", late) if events.isStreaming else events
    return stream.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


class Watch:
    """A change feed over the enabled projects. It is armed anew only when their set has changed; a project whose
    configuration can't be read is left out until it can."""

    def __init__(self, start: Callable[[list[str]], object], usable: Callable[[str], bool]) -> None:
        self._start, self._usable, self.armed, self._feed = start, usable, None, None

    def arm(self, enabled: list[str]) -> bool:
        """Follow these projects; True if the feed was started anew."""
        wanted = sorted(p for p in enabled if self._usable(p))
        if wanted == self.armed:
            return False
        if self._feed is not None:
            self._feed.stop()
        self._feed, self.armed = (self._start(wanted) if wanted else None), wanted
        return True
