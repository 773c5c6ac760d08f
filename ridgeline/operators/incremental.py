"""Processing only new or changed records.

The inputs are split into hash partitions of their key; rows with equal `cluster` columns lie in a few
of them, so that a change in one place touches few. A partition's fingerprint is its row count and the
sum of a row hash, which are additive: they need one pass with map-side combining and don't depend on
row order. A run recomputes the partitions whose fingerprint differs from the one committed last,
replaces each of them atomically by dynamic partition overwrite, and commits the new fingerprints last.

The commit also holds what the fingerprints mean: the number of partitions, the columns of the inputs
and the version of the computation. If one of them differs, everything is recomputed into a folder of
its own, which the commit then names. Before partitions are replaced their numbers are noted; a run
that ends in between has committed nothing, and the next one recomputes the noted partitions too, even
if the inputs are by then what they were before. So nothing is skipped, and an overwrite repeats nothing.
"""

from __future__ import annotations

import hashlib
import json
import math
import types
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

PART = "_part"
COMMITTED, INTENDED = "_fingerprints", "_intended"
#: Where no number is given: rows that a partition holds on average, and the least and greatest number of partitions.
ROWS, LEAST, MOST = 500_000, 256, 65_536
#: Partitions over which the rows of one cluster value are spread.
SPREAD = 4


def partition_of(keys: Sequence[str], partitions: int, cluster: Sequence[str] = ()) -> Column:
    """The partition of a row: by `keys`, or near other rows of its `cluster` value."""
    own = F.xxhash64(*keys)
    if not cluster or partitions < SPREAD:
        return F.pmod(own, F.lit(partitions)).cast("int")
    return F.pmod(F.xxhash64(*cluster) + F.pmod(own, F.lit(SPREAD)), F.lit(partitions)).cast("int")


def fingerprints(df: DataFrame, keys: Sequence[str], partitions: int, cluster: Sequence[str] = ()) -> DataFrame:
    """(_part, n, total) of `df` by partition. Every column counts; NULL differs from ''.

    `total` is a decimal, so that no number of rows overflows it.
    """
    cols = sorted(df.columns)
    row = F.xxhash64(*[F.col(f"`{c}`") for c in cols], *[F.col(f"`{c}`").isNull() for c in cols])
    return (
        df.select(partition_of(keys, partitions, cluster).alias(PART), row.cast("decimal(20,0)").alias("_h"))
        .groupBy(PART)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("_h").cast("string").alias("total"))
    )


def code_version(compute: Callable) -> str:
    """A digest of a function's code with its constants, defaults and captured values."""

    def parts(code: types.CodeType):
        yield code.co_code
        yield repr(code.co_names).encode()
        for c in code.co_consts:
            yield from parts(c) if isinstance(c, types.CodeType) else [repr(sorted(c, key=repr) if isinstance(c, frozenset) else c).encode()]

    h = hashlib.sha256()
    for p in parts(compute.__code__):
        h.update(p)
    h.update(repr((compute.__defaults__, [c.cell_contents for c in compute.__closure__ or () if isinstance(c.cell_contents, (str, int, float, tuple))])).encode())
    return h.hexdigest()[:16]


class _Folder:
    """A state folder through the file system that holds it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path, self._new = path, spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._new(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, below: str) -> list[str]:
        at = self._new(f"{self.path}/{below}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def delete(self, name: str) -> None:
        self._fs.delete(self._new(f"{self.path}/{name}"), True)

    def rename(self, source: str, target: str) -> None:
        dst = self._new(f"{self.path}/{target}")
        self._fs.mkdirs(dst.getParent())
        if self._fs.exists(dst) or not self._fs.rename(self._new(f"{self.path}/{source}"), dst):
            raise RuntimeError(f"another run has committed {dst}")


def _newest(folder: _Folder) -> str | None:
    """The committed fingerprint table with the highest number."""
    done = [n for n in folder.names(COMMITTED) if n.isdigit()]
    return max(done, key=int) if done else None


def _commit(spark: SparkSession, folder: _Folder, rows: list[tuple]) -> None:
    """Write beside, then rename: the new state is seen whole or not at all."""
    last = _newest(folder)
    tmp = f"{COMMITTED}/tmp-{uuid.uuid4().hex}"
    spark.createDataFrame(rows, f"{PART} int, input string, n long, total string").coalesce(1).write.parquet(f"{folder.path}/{tmp}")
    folder.rename(tmp, f"{COMMITTED}/{int(last or 0) + 1:012d}")
    if last:  # the one before isn't needed any more
        folder.delete(f"{COMMITTED}/{last}")


def refresh(
    inputs: dict[str, DataFrame],
    keys: Sequence[str],
    compute: Callable[[dict[str, DataFrame]], DataFrame],
    state_dir: str,
    partitions: int | None = None,
    version: str | None = None,
    cluster: Sequence[str] = (),
) -> tuple[DataFrame, list[int]]:
    """Bring the result kept in `state_dir` up to date; returns it and the partitions recomputed.

    `inputs` are DataFrames that all have the columns `keys`; `compute` maps them (restricted to some
    partitions) to the result, which must keep `keys` and may combine rows of equal keys only. NULL
    keys form a key of their own. Empty inputs give an empty result. `cluster` are those of the keys
    in which changes come together (a project, a day).

    partitions: None takes the number of the last commit, and for a new state one for ROWS rows. A
    number, input columns or a `version` (by default a digest of the code of `compute`) other than
    those committed rebuild the whole result. The returned DataFrame reads the state; it holds until
    the next run.
    """
    first = next(iter(inputs.values()))
    spark = first.sparkSession
    folder = _Folder(spark, state_dir)
    newest = _newest(folder)
    old: dict[tuple[int, str], tuple] = {}
    meta: dict = {}
    if newest:
        for r in spark.read.parquet(f"{state_dir}/{COMMITTED}/{newest}").collect():  # a row a partition and input
            if r[PART] < 0:
                meta = json.loads(r["input"])
            else:
                old[r[PART], r["input"]] = (r["n"], r["total"])
    if partitions is None:
        partitions = meta.get("partitions")
    if partitions is None:
        rows = sum(df.count() for df in inputs.values())
        partitions = min(MOST, max(LEAST, 1 << math.ceil(math.log2(max(1, rows / ROWS)))))
    what = {
        "partitions": partitions, "keys": list(keys), "cluster": list(cluster), "version": version or code_version(compute),
        "inputs": {n: sorted(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields) for n, df in inputs.items()},
    }
    rebuild = {k: v for k, v in meta.items() if k not in ("result", "schema")} != what
    out = f"result-{uuid.uuid4().hex}" if rebuild else meta["result"]
    prints = None
    for name, df in inputs.items():
        one = fingerprints(df, keys, partitions, cluster).withColumn("input", F.lit(name))
        prints = one if prints is None else prints.unionByName(one)
    # at most `partitions` rows per input, whatever the size of the data
    now = {(r[PART], r["input"]): (r["n"], r["total"]) for r in prints.collect()}
    if rebuild:
        changed = set(range(partitions))
    else:
        changed = {part for part, name in now.keys() | old.keys() if now.get((part, name)) != old.get((part, name))}
        changed |= {int(r["value"]) for n in folder.names(INTENDED) for r in spark.read.text(f"{state_dir}/{INTENDED}/{n}").collect()}
    todo = sorted(changed)
    part = partition_of(keys, partitions, cluster)
    if todo:
        intent = uuid.uuid4().hex
        if not rebuild:  # a rebuild writes to a folder that nobody reads before the commit
            spark.createDataFrame([(str(p),) for p in todo], "value string").coalesce(1).write.text(f"{state_dir}/{INTENDED}/{intent}")
        wanted = spark.createDataFrame([(p,) for p in todo], "_wanted int")
        # at most `partitions` numbers
        some = inputs if rebuild else {n: df.join(F.broadcast(wanted), part == F.col("_wanted"), "left_semi") for n, df in inputs.items()}
        result = compute(some).withColumn(PART, part).withColumn("_row", F.lit(True))
        schema = result.schema
        if not rebuild:
            # a row that marks each recomputed partition, so that one without a result is replaced as well
            marks = wanted.select(*[(F.col("_wanted") if f.name == PART else F.lit(f.name == "_row" and None).cast(f.dataType)).alias(f.name) for f in schema.fields])
            result = result.unionByName(marks)
        (
            result.hint("rebalance", PART)  # small partitions share a task, large ones are split
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(f"{state_dir}/{out}")
        )
        fields = StructType([f for f in schema.fields if f.name != PART])
        state = [(-1, json.dumps(what | {"result": out, "schema": fields.json()}), 0, "0")] + [(p, n, *v) for (p, n), v in now.items()]
        _commit(spark, folder, state)
        for n in folder.names(INTENDED):
            folder.delete(f"{INTENDED}/{n}")
        if rebuild:
            for n in [n for n in folder.names("") if n.startswith("result-") and n != out]:
                folder.delete(n)
    else:
        fields = StructType.fromJson(json.loads(meta["schema"]))
    kept = spark.read.schema(StructType([*fields.fields, StructField(PART, IntegerType())])).parquet(f"{state_dir}/{out}")
    return kept.where("_row").drop(PART, "_row"), todo


def _latest_actions(parts: dict[str, DataFrame]) -> DataFrame:
    """(project, path, action) from `files` and the rows of successful runs in `writes`; one shuffle."""
    null = lambda kind: F.lit(None).cast(kind)
    disk = F.struct(F.col("seen_at").alias("at"), F.col("sha256").alias("sha"))
    stored = F.struct(F.col("started_at").alias("at"), F.col("run_id").alias("run"), F.col("write_id").alias("id"), F.col("op").alias("op"), F.col("sha256").alias("sha"))
    rows = (
        parts["files"].select("project", "path", disk.alias("d"), null("struct<at:timestamp,run:bigint,id:bigint,op:string,sha:string>").alias("s"))
        .unionByName(parts["writes"].select("project", "path", null("struct<at:timestamp,sha:string>").alias("d"), stored.alias("s")))
    )
    last = rows.groupBy("project", "path").agg(F.max("d").alias("d"), F.max("s").alias("s"))
    on_disk = F.col("d.sha").isNotNull()
    is_stored = F.coalesce(F.col("s.op") == "write", F.lit(False))
    return last.select(
        "project", "path",
        F.when(on_disk & ~(is_stored & F.coalesce(F.col("s.sha") == F.col("d.sha"), F.lit(False))), "write")
        .when(~on_disk & is_stored, "delete").alias("action"),
    ).where("action is not null")


def pending_actions(files: DataFrame, store_writes: DataFrame, index_runs: DataFrame, state_dir: str, partitions: int | None = None) -> tuple[DataFrame, list[int]]:
    """What the next indexing run has to write or delete: (project, path, action), and the partitions recomputed.

    The present state of a path is its `files` row with the latest `seen_at` (ties: the greatest
    `sha256`); NULL `sha256` means not on disk. The stored state is the `store_writes` row of the
    'ok' run with the latest `started_at` (ties: the greatest run_id, then write_id). Rows of runs
    that are unknown or not 'ok' don't count. Repeated rows change nothing; rows with a NULL path are
    a path of their own; empty tables give no action; other columns are ignored.
    """
    from ridgeline.session import broadcast_if_small

    runs = index_runs.where("status = 'ok'").select("run_id", "started_at").groupBy("run_id").agg(F.max("started_at").alias("started_at"))
    writes = store_writes.select("write_id", "run_id", "project", "path", "op", "sha256").join(broadcast_if_small(runs, 20_000), "run_id")
    inputs = {"files": files.select("project", "path", "sha256", "mtime", "seen_at"), "writes": writes}
    return refresh(inputs, ["project", "path"], _latest_actions, state_dir, partitions, cluster=["project"])
