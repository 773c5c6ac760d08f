"""Session construction, table access and shared-folder staging."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str = "local[*]", app: str = "ridgeline", **conf: str) -> SparkSession:
    """A session with adaptive execution on, UTC time and Arrow transfer; `conf` overrides."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    return SparkSession.builder.master(master).appName(app).config(map=settings).getOrCreate()


def setting(name: str, default, environ: dict[str, str] | None = None):
    """A setting from the environment, of the type of its default: trimmed; a blank number or flag is the
    default, a blank text is blank; a number that can't be read is an error; 1, true, yes and on are true."""
    raw = (os.environ if environ is None else environ).get(name)
    value = None if raw is None else raw.strip()
    if value is None or (value == "" and not isinstance(default, str)):
        return default
    if isinstance(default, bool):
        return value.lower() in ("1", "true", "yes", "on")
    if isinstance(default, int):
        try:
            return int(value)
        except ValueError:
            raise ValueError(f"{name} must be a whole number, got {value!r}") from None
    return value


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, so that their Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_ridgeline_shipped", False):
        return
    home = Path(__file__).resolve().parent
    made = tempfile.mkdtemp(prefix="ridgeline-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    with zipfile.ZipFile(f"{made}/ridgeline.zip", "w") as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    context.addPyFile(f"{made}/ridgeline.zip")
    context._ridgeline_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from `spark.checkpoint.dir`.

    Where the session has none and runs on this machine alone, a temporary folder is made, set on the
    context, and removed when the process ends. On a cluster that is an error: a folder of the driver's
    machine is none of the executors'.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="ridgeline-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing else uses; removed when the driver ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    local = path.removeprefix("file://")
    if os.path.isdir(os.path.dirname(local)):
        atexit.register(shutil.rmtree, local, ignore_errors=True)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write `df` to the shared folder and read it back. Survives a lost executor."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, piece: int = 1 << 20) -> DataFrame:
    """`df` over more tasks if its files give fewer than the cluster has cores and than pieces of `piece`
    bytes; for work that is heavy per row. A large table has more splits than that and stays as it is."""
    jdf = df._jdf
    pieces = int(str(jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // piece + 1
    wanted = min(df.sparkSession.sparkContext.defaultParallelism, pieces)
    return df.repartition(wanted) if jdf.rdd().getNumPartitions() < wanted else df


def lowest(df: DataFrame, key: Column, n: int, total: int) -> DataFrame:
    """About the `n` rows with the smallest 64-bit hash `key`, of `total` rows: never more than n.

    Rows above the range that 2 n rows are expected in are dropped where they are read, so the one task
    that orders them doesn't get n rows from each of the others.
    """
    share = min(1.0, 2.0 * n / max(total, 1))
    kept = df.withColumn("_lowest", key)
    if share < 1:
        kept = kept.where(F.col("_lowest") < int(-(1 << 63) + share * (1 << 64)))
    return kept.orderBy("_lowest").limit(n).drop("_lowest")


def broadcast_if_small(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """`df` with a broadcast hint if it has at most `max_rows` rows, else `df` as it is.

    The count stops after max_rows + 1 rows, so the check costs little on a large side, which then
    takes part in an ordinary shuffled join.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
