"""Queries of the general training-data problem: processing only new or changed records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.operators.incremental import pending_actions
from ridgeline.session import fresh_dir, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths that the next run has to write or delete, through the incremental operator on a fresh state."""
    actions, _ = pending_actions(
        table(spark, sf_dir, "files"), table(spark, sf_dir, "store_writes"), table(spark, sf_dir, "index_runs"),
        fresh_dir(spark, "p1-state"),
    )
    return actions


def p1_second_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same result by an increment: a run on what there was half-way through the history, then one on all there is."""
    files, writes, runs = (table(spark, sf_dir, t) for t in ("files", "store_writes", "index_runs"))
    then = files.agg(F.percentile_approx(F.unix_micros("seen_at"), 0.9).alias("t"))
    earlier = files.join(F.broadcast(then), F.unix_micros("seen_at") <= F.col("t")).drop("t")  # one row
    done = runs.agg(F.percentile_approx(F.unix_micros("started_at"), 0.9).alias("t"))
    past = runs.join(F.broadcast(done), F.unix_micros("started_at") <= F.col("t")).drop("t")  # one row
    state = fresh_dir(spark, "p1-state")
    pending_actions(earlier, writes, past, state)
    return pending_actions(files, writes, runs, state)[0]


QUERIES = {"p1_found": p1_found, "p1_second_run": p1_second_run}

ORACLE = {
    "p1_found": """
        WITH f AS (SELECT project, path, arg_max(struct_pack(s := sha256), seen_at) AS d FROM files GROUP BY 1, 2),
             w AS (SELECT s.project, s.path, arg_max(struct_pack(op := s.op, s := s.sha256), (r.started_at, s.run_id, s.write_id)) AS x
                   FROM (SELECT DISTINCT * FROM store_writes) s JOIN index_runs r ON s.run_id = r.run_id WHERE r.status = 'ok' GROUP BY 1, 2),
             b AS (SELECT coalesce(f.project, w.project) AS project, coalesce(f.path, w.path) AS path, f.d.s AS disk,
                          w.x.op IS NOT DISTINCT FROM 'write' AS stored, w.x.s AS sha
                   FROM f FULL JOIN w ON f.project = w.project AND f.path = w.path),
             a AS (SELECT project, path, CASE WHEN disk IS NOT NULL AND NOT (stored AND sha IS NOT DISTINCT FROM disk) THEN 'write'
                                              WHEN disk IS NULL AND stored THEN 'delete' END AS action FROM b)
        SELECT * FROM a WHERE action IS NOT NULL""",
}
ORACLE["p1_second_run"] = ORACLE["p1_found"]
