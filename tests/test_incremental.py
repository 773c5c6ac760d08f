import datetime as dt

import pytest
from pyspark.sql import functions as F

from ridgeline.operators import incremental as inc

T = lambda h: dt.datetime(2026, 1, 1, h)
FILES = "project string, path string, sha256 string, mtime double, seen_at timestamp, action string"
WRITES = "write_id long, run_id long, project string, path string, op string, sha256 string"
RUNS = "run_id long, project string, started_at timestamp, finished_at timestamp, status string"


def tables(spark, files, writes, runs):
    return spark.createDataFrame([(*f, "x") for f in files], FILES), spark.createDataFrame(writes, WRITES), spark.createDataFrame(runs, RUNS)


BASE = (
    [("p", "same", "1", 1.0, T(1)), ("p", "same", "1", 1.0, T(1)), ("p", "new", "2", 1.0, T(1)), ("p", "gone", None, 1.0, T(2)), ("p", "gone", "9", 1.0, T(1)), ("p", "Same", "7", 1.0, T(1)), (None, "n", "3", 1.0, T(1))],
    [(1, 1, "p", "same", "write", "1"), (2, 1, "p", "gone", "write", "9"), (3, 2, "p", "new", "write", "2"), (4, 1, "p", "left", "write", "4"), (5, 3, "p", "left", "delete", None), (6, 1, "p", "lost", "write", "5")],
    [(1, "p", T(1), T(1), "ok"), (2, "p", T(2), None, "running"), (3, "p", T(3), T(3), "ok")],
)


def rows(df):
    return {(r.project, r.path, r.action) for r in df.collect()}


def test_actions_and_increments(spark, tmp_path):
    state = f"file://{tmp_path}/s"
    out, changed = inc.pending_actions(*tables(spark, *BASE), state, 8)
    want = {("p", "new", "write"), ("p", "gone", "delete"), ("p", "Same", "write"), (None, "n", "write"), ("p", "lost", "delete")}
    assert rows(out) == want and changed
    out, changed = inc.pending_actions(*tables(spark, *BASE), state, 8)
    assert rows(out) == want and changed == []
    # a run ends well: only the partition of its path is computed again, and its action goes
    files, writes, runs = BASE
    out, changed = inc.pending_actions(*tables(spark, files, writes, [runs[0], (2, "p", T(2), T(2), "ok"), runs[2]]), state, 8)
    assert rows(out) == want - {("p", "new", "write")} and len(changed) == 1
    # a path vanishes from both sides
    out, changed = inc.pending_actions(*tables(spark, files, [w for w in writes if w[3] != "lost"], runs), state, 8)
    assert rows(out) == want - {("p", "lost", "delete")}


def test_a_failed_run_is_made_up_for(spark, tmp_path, monkeypatch):
    state = f"file://{tmp_path}/s"
    inc.pending_actions(*tables(spark, *BASE), state, 8)
    more = (BASE[0] + [("p", "later", "8", 1.0, T(4))], *BASE[1:])

    def fail(*_):
        raise RuntimeError("lost before the commit")

    with monkeypatch.context() as m:
        m.setattr(inc, "_commit", fail)
        with pytest.raises(RuntimeError):
            inc.pending_actions(*tables(spark, *more), state, 8)
    out, changed = inc.pending_actions(*tables(spark, *more), state, 8)
    assert ("p", "later", "write") in rows(out) and len(changed) == 1 and out.count() == len(rows(out))


def count_by(parts):
    return parts["t"].groupBy("k").agg(F.sum("v").alias("v"))


def times_two(parts):
    return parts["t"].groupBy("k").agg((F.sum("v") * 2).alias("v"))


def table_of(spark, n=1000, changed=()):
    return spark.range(n).select(F.col("id").cast("string").alias("k"), F.when(F.col("id").isin(list(changed)), F.lit(-1)).otherwise(F.col("id")).alias("v"))


def result(df):
    got = [(r.k, r.v) for r in df.collect()]
    assert len(got) == len(set(got))
    return dict(got)


def test_another_number_of_partitions_version_or_schema_rebuilds(spark, tmp_path):
    state, want = f"file://{tmp_path}/s", {str(i): i for i in range(1000)}
    assert result(inc.refresh({"t": table_of(spark)}, ["k"], count_by, state, 16)[0]) == want
    out, parts = inc.refresh({"t": table_of(spark)}, ["k"], count_by, state, 8)
    assert result(out) == want and len(parts) == 8
    out, parts = inc.refresh({"t": table_of(spark)}, ["k"], count_by, state)  # the committed number
    assert result(out) == want and parts == []
    out, parts = inc.refresh({"t": table_of(spark)}, ["k"], times_two, state)
    assert result(out) == {k: 2 * v for k, v in want.items()} and len(parts) == 8
    out, parts = inc.refresh({"t": table_of(spark).withColumn("w", F.lit(1))}, ["k"], times_two, state)
    assert result(out) == {k: 2 * v for k, v in want.items()} and len(parts) == 8
    assert len([p for p in (tmp_path / "s").iterdir() if p.name.startswith("result-")]) == 1
    assert inc.code_version(count_by) != inc.code_version(times_two)


def test_few_changes_touch_few_partitions(spark, tmp_path):
    state = f"file://{tmp_path}/s"
    inc.refresh({"t": table_of(spark)}, ["k"], count_by, state)
    out, parts = inc.refresh({"t": table_of(spark, changed=range(10))}, ["k"], count_by, state)
    assert 0 < len(parts) <= 10 < inc.LEAST and result(out) == {str(i): -1 if i < 10 else i for i in range(1000)}
    near = table_of(spark).withColumn("p", (F.col("v") / 50).cast("int"))
    seen = near.where("p = 3").select(inc.partition_of(["p", "k"], 256, ["p"]).alias("x")).distinct().count()
    assert seen <= inc.SPREAD


@pytest.mark.parametrize("step", ["write", "_commit", "delete"])
def test_a_stop_between_any_two_writes(spark, tmp_path, monkeypatch, step):
    state = f"file://{tmp_path}/s"
    inc.refresh({"t": table_of(spark)}, ["k"], count_by, state, 16)

    def stop(*_):
        raise RuntimeError("stopped")

    def compute(parts):
        if step == "write":
            stop()
        return count_by(parts)

    with monkeypatch.context() as m:
        if step == "_commit":
            m.setattr(inc, "_commit", stop)
        elif step == "delete":
            m.setattr(inc._Folder, "delete", stop)
        with pytest.raises(RuntimeError):
            inc.refresh({"t": table_of(spark, changed=[1, 2])}, ["k"], compute, state, 16, version=inc.code_version(count_by))
    # the inputs are again what the last commit knows: what was replaced since is computed anew
    out, parts = inc.refresh({"t": table_of(spark)}, ["k"], count_by, state, 16)
    assert result(out) == {str(i): i for i in range(1000)} and parts
    assert inc.refresh({"t": table_of(spark)}, ["k"], count_by, state, 16)[1] == []


def test_empty_tables(spark, tmp_path):
    f, w, r = tables(spark, *BASE)
    out, _ = inc.pending_actions(f.limit(0), w.limit(0), r.limit(0), f"file://{tmp_path}/s", 4)
    assert out.count() == 0
    out, _ = inc.pending_actions(f, w.limit(0), r.limit(0), f"file://{tmp_path}/s", 4)
    assert {a for _, _, a in rows(out)} == {"write"}


def test_fingerprints_do_not_depend_on_order(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 7).alias("v"))
    a = {tuple(r) for r in inc.fingerprints(df, ["k"], 4).collect()}
    assert a == {tuple(r) for r in inc.fingerprints(df.orderBy(F.desc("k")).repartition(7), ["k"], 4).collect()}
    assert a != {tuple(r) for r in inc.fingerprints(df.withColumn("v", F.when(F.col("k") == "5", None).otherwise(F.col("v"))), ["k"], 4).collect()}
