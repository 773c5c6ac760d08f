"""The write path: one project's pass, the queue in front of it, and reports on the store."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ridgeline.functions import fixed
from ridgeline.functions.text import embed_text, identifier_tokens
from ridgeline.operators import chunking, dense, lexical, registry, store
from ridgeline.session import broadcast_if_small, staged
from ridgeline.sources import corpus

LOG = "project string, path string, op string, body_gen long, mtime double, size long, sha256 string, lang string, n_lines int, n_chunks long, n_terms long"
CHUNKS = "project string, path string, chunk_id long, ord int, start_line int, end_line int, n_chars int, sha256 string, text string, tokens array<string>, header string, embedding array<float>"
SETTINGS = {
    "embed_model": "hashed-trigrams", "embed_dims": "64", "chunk_chars": str(fixed.CHUNK_CHARS), "chunk_overlap": str(fixed.CHUNK_OVERLAP),
    "header_path": "1", "md_splitter": "0", "chunk_algo": "1",
}
FILE_COLUMNS = ["project", "path", "mtime", "size", "sha256", "lang", "n_lines"]
CHUNK_COLUMNS = [c.split()[0] for c in CHUNKS.split(", ")]
#: Generations after which a pass rewrites what is live as one.
MOST_GENERATIONS = 48


@dataclass
class Pass:
    """What one pass did."""

    project: str
    written: int = 0
    deleted: int = 0
    chunks_deleted: int = 0
    relabelled: int = 0
    rebuilt: str | None = None
    files: int = 0
    chunks: int = 0


@dataclass
class Store:
    """Tables of generations below one folder: a log of files, chunks with vectors, and postings.

    A pass writes only the files it writes or deletes, as a new generation of all tables, and then one
    commit file, renamed into place: readers see a generation whole or not at all, and nothing is ever
    deleted before what replaces it is committed. Of each file the last generation counts; its log row
    names the generation that its chunks and postings lie in. A generation without a commit, left by a
    pass that ended, is never read. After MOST_GENERATIONS the live rows are written as one generation.
    """

    spark: SparkSession
    root: str
    embed: Callable[[], Callable[[list[str]], np.ndarray]] = field(default=dense.hashed_ngrams)
    settings: dict[str, str] = field(default_factory=lambda: dict(SETTINGS))

    # ---- commits

    def _fs(self):
        new = self.spark._jvm.org.apache.hadoop.fs.Path
        return new(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration()), new

    def _names(self, below: str) -> list[str]:
        fs, new = self._fs()
        at = new(f"{self.root}/{below}")
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def commits(self) -> list[dict]:
        """The commits in order, from the last one that holds everything on; at most some MOST_GENERATIONS."""
        if not any(n.endswith(".json") for n in self._names("commits")):
            return []
        rows = self.spark.read.text(f"{self.root}/commits/*.json", wholetext=True).collect()
        found = sorted((json.loads(r["value"]) for r in rows), key=lambda c: c["gen"])
        base = max((c["gen"] for c in found if c.get("whole")), default=0)
        return [c for c in found if c["gen"] >= base]

    def _commit(self, gen: int, **what) -> None:
        fs, new = self._fs()
        made, done = new(f"{self.root}/commits/.{gen:012d}-{uuid.uuid4().hex}"), new(f"{self.root}/commits/{gen:012d}.json")
        out = fs.create(made, False)
        out.write(bytearray(json.dumps({"gen": gen} | what).encode()))
        out.close()
        if fs.exists(done) or not fs.rename(made, done):
            raise RuntimeError(f"another pass has committed generation {gen}")

    def _next(self) -> int:
        """A number that no generation has, committed or not."""
        used = [int(n.split(".")[0]) for n in self._names("commits") if n.endswith(".json")]
        used += [int(n.removeprefix("gen=")) for t in ("files", "chunks", "postings") for n in self._names(t) if n.startswith("gen=")]
        return max(used, default=0) + 1

    def meta(self, project: str) -> dict:
        """Settings, configuration signature and time of a project's last pass."""
        mine = [c["projects"][project] for c in self.commits() if project in c["projects"]]
        return mine[-1] if mine else {}

    # ---- what is live

    def _read(self, name: str, schema: str, commits: list[dict]) -> DataFrame:
        """The committed generations of a table, with `gen`; others aren't even listed."""
        kind = StructType.fromDDL(schema)
        there = set(self._names(name))
        paths = [f"{self.root}/{name}/gen={c['gen']}" for c in commits if f"gen={c['gen']}" in there]
        if not paths:
            return self.spark.createDataFrame([], kind.add("gen", "long"))
        return self.spark.read.schema(kind.add("gen", "long")).option("basePath", f"{self.root}/{name}").parquet(*paths)

    def log(self) -> DataFrame:
        """The last row of each file that is live: FILE_COLUMNS, body_gen, n_chunks, n_terms."""
        commits = self.commits()
        rows = self._read("files", LOG, commits)
        wiped = [(p, c["gen"]) for c in commits for p, m in c["projects"].items() if m.get("wiped")]
        if wiped:  # a rebuilt project's earlier generations are void
            since = self.spark.createDataFrame(wiped, "project string, since long").groupBy("project").agg(F.max("since").alias("since"))
            rows = rows.join(broadcast_if_small(since), "project", "left").where("since is null or gen >= since").drop("since")
        rest = [c for c in rows.columns if c not in ("project", "path", "gen")]
        last = rows.groupBy("project", "path").agg(F.max(F.struct("gen", *rest)).alias("r")).where("r.op = 'write'")
        return last.select("project", "path", *[F.col(f"r.{c}").alias(c) for c in rest]).drop("op")

    def files(self) -> DataFrame:
        return self.log().select(*FILE_COLUMNS)

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows (project, path, gen, …) of the generation that their file's last log row names."""
        return rows.join(self.log().select("project", "path", F.col("body_gen").alias("gen")), ["project", "path", "gen"], "left_semi").drop("gen")

    def chunks(self) -> DataFrame:
        return self._live(self._read("chunks", CHUNKS, self.commits()))

    def bm25(self, queries: DataFrame, projects: list[str] | None = None) -> DataFrame:
        """(qid, project, chunk_id, score) by the stored postings; texts aren't read."""
        asked, words = lexical.asked_terms(queries)
        found = self._read("postings", "term string, project string, path string, chunk_id long, tf int, doc_len int, bucket int", self.commits())
        found = self._live(found.where(F.col("bucket").isin(lexical.bucket_numbers(self.spark, words)) & F.col("term").isin(words)).drop("bucket"))
        stats = self.log().groupBy("project").agg(F.sum("n_chunks").alias("n_docs"), (F.sum("n_terms") / F.sum("n_chunks")).alias("avgdl"))
        if projects is not None:
            found, stats = found.where(F.col("project").isin(projects)), stats.where(F.col("project").isin(projects))
        return lexical._weighed(found, stats, asked)

    # ---- passes

    def index(
        self, current: DataFrame, named: DataFrame | None = None, full: bool = False, signatures: dict[str, str] | None = None, projects: list[str] | None = None,
    ) -> Pass:
        """Bring projects up to date with `current` (the columns of corpus.FILE), by content.

        projects: those that `current` lists whole, by default the ones it names; their other files are
        deleted. named (project, path): only these paths, written even if unchanged. A project stored
        with other settings is rebuilt; with `full` all are.
        """
        projects = sorted(r["project"] for r in current.select("project").distinct().collect()) if projects is None else projects
        key, done = ["project", "path"], Pass(projects[0] if len(projects) == 1 else "")
        meta = {p: m for c in self.commits() for p, m in c["projects"].items()}
        wiped = {}
        for p in projects:
            why = store.incompatible(meta.get(p, {}).get("settings"), self.settings)
            done.rebuilt = done.rebuilt or why
            if full or why:
                wiped[p] = True
        stored = self.log().where(F.col("project").isin(projects) & ~F.col("project").isin(list(wiped)))
        current = staged(current.select(*FILE_COLUMNS, "text"), "current")
        if named is None:
            diff = store.content_diff(current.select(*key, "sha256"), stored.select(*key, "sha256"))
        else:
            diff = store.scoped_diff(current, stored, named)
        diff = staged(diff, "diff")
        tally = {r["action"]: r["n"] for r in diff.groupBy("action").agg(F.count(F.lit(1)).alias("n")).collect()}
        done.written, done.deleted = tally.get("write", 0), tally.get("delete", 0)
        relabel = store.relabelled(stored.select(*FILE_COLUMNS).join(diff, key, "left_anti")).select(*key, "new_lang")
        done.relabelled = relabel.count()
        if tally or done.relabelled or wiped:
            gen = self._next()
            if done.deleted:
                done.chunks_deleted = stored.join(diff.where("action = 'delete'"), key, "left_semi").agg(F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("n")).first()["n"]
            self._write(gen, current, stored, diff, relabel)
            self._commit(gen, projects={p: {"settings": self.settings, "signature": (signatures or {}).get(p), "indexed_at": time.time(), "wiped": p in wiped} for p in projects})
            if len(self.commits()) > MOST_GENERATIONS:
                self.compact()
        elif any((signatures or {}).get(p) != meta.get(p, {}).get("signature") or p not in meta for p in projects):
            self._commit(self._next(), projects={p: {"settings": self.settings, "signature": (signatures or {}).get(p), "indexed_at": time.time()} for p in projects})
        mine = self.log().where(F.col("project").isin(projects)).agg(F.count(F.lit(1)).alias("f"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("c")).first()
        done.files, done.chunks = mine["f"], mine["c"]
        return done

    def _write(self, gen: int, current: DataFrame, stored: DataFrame, diff: DataFrame, relabel: DataFrame) -> None:
        key = ["project", "path"]
        new = current.join(diff.where("action = 'write'").select(*key), key, "left_semi")
        made = chunking.chunk_files(new.select(*key, "text"), int(self.settings["chunk_chars"]), int(self.settings["chunk_overlap"]))
        made = made.withColumn("chunk_id", F.xxhash64(*key, "ord")).withColumn("tokens", identifier_tokens(F.col("text"))).withColumn("_e", embed_text(F.col("header"), F.col("text")))
        made = dense.embed_column(made, "_e", "embedding", self.embed)
        made.select(CHUNK_COLUMNS).write.parquet(f"{self.root}/chunks/gen={gen}")
        chunks = self.spark.read.schema(CHUNKS).parquet(f"{self.root}/chunks/gen={gen}")
        lists = staged(lexical.term_lists(chunks, ("project", "path", "chunk_id")), "term-lists")
        lexical.write_postings(lists, f"{self.root}/postings/gen={gen}", ("project", "path", "chunk_id"))
        sizes = lists.groupBy(*key).agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("doc_len").cast("long").alias("n_terms"))
        rows = new.drop("text").join(sizes, key, "left").fillna(0, ["n_chunks", "n_terms"]).withColumns({"op": F.lit("write"), "body_gen": F.lit(gen).cast("long")})
        gone = diff.where("action = 'delete'").select(*key).withColumn("op", F.lit("delete"))
        again = stored.join(relabel, key).withColumn("lang", F.col("new_lang")).drop("new_lang").withColumn("op", F.lit("write"))
        log = rows.unionByName(gone, allowMissingColumns=True).unionByName(again, allowMissingColumns=True)
        kind = StructType.fromDDL(LOG)
        log.select(*[F.col(f.name).cast(f.dataType) for f in kind.fields]).write.parquet(f"{self.root}/files/gen={gen}")

    def compact(self) -> None:
        """Write what is live as one generation that voids the earlier ones, then remove those."""
        commits, gen = self.commits(), self._next()
        meta = {p: m | {"wiped": False} for c in commits for p, m in c["projects"].items()}
        self.chunks().select(CHUNK_COLUMNS).write.parquet(f"{self.root}/chunks/gen={gen}")
        postings = self._live(self._read("postings", "term string, project string, path string, chunk_id long, tf int, doc_len int, bucket int", commits))
        postings.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{self.root}/postings/gen={gen}")
        kind = StructType.fromDDL(LOG)
        log = self.log().withColumns({"op": F.lit("write"), "body_gen": F.lit(gen)})
        log.select(*[F.col(f.name).cast(f.dataType) for f in kind.fields]).write.parquet(f"{self.root}/files/gen={gen}")
        self._commit(gen, whole=True, projects=meta)
        fs, new = self._fs()
        for c in commits:  # the commit first, so that no reader finds one without its tables
            fs.delete(new(f"{self.root}/commits/{c['gen']:012d}.json"), False)
            for t in ("files", "chunks", "postings"):
                fs.delete(new(f"{self.root}/{t}/gen={c['gen']}"), True)

    def index_project(self, project: str, config: corpus.Config = corpus.Config(), named: list[str] | None = None, full: bool = False, roots: list[corpus.Config] = ()) -> Pass:
        """Bring a project's folder up to date. A changed configuration forces a full walk. A project that
        isn't there raises instead of deleting its rows."""
        if not Path(project).is_dir():
            raise FileNotFoundError(f"{project} is not there")
        project = str(Path(project).resolve())
        config = unite(config, *roots)
        if self.meta(project).get("signature") != config.signature():
            named = None
        only = None if named is None else self.spark.createDataFrame([(project, n) for n in named], "project string, path string")
        return self.index(corpus.read_project(self.spark, project, config), only, full, {project: config.signature()}, [project])

    def open(self, project: str) -> DataFrame:
        """A project's chunks; FileNotFoundError if it was never indexed (a search over several reads none of it instead)."""
        if not self.meta(project):
            raise FileNotFoundError(f"{project} has no store")
        return self.chunks().where(F.col("project") == project)

    def doctor(self, known: registry.Registry) -> list[dict]:
        """Projects that are missing on disk or never indexed, and stored projects that no row claims."""
        rows, out = known.load(), []
        stored = {r["project"] for r in self.files().select("project").distinct().collect()}  # one row a project
        for p, e in rows.items():
            if not Path(p).is_dir():
                out.append({"project": p, "problem": "missing"})
            elif e.indexed_at is None:
                out.append({"project": p, "problem": "never indexed"})
        return out + [{"project": p, "problem": "unclaimed"} for p in sorted(stored - rows.keys())]


def unite(own: corpus.Config, *roots: corpus.Config) -> corpus.Config:
    """A project's configuration with those of the roots that claim it: excludes united, flags or-ed, includes its own."""
    return corpus.Config(
        tuple(sorted({x for c in (own, *roots) for x in c.exclude})), own.include, any(c.respect_gitignore for c in (own, *roots)),
        any(c.use_default_ignores for c in (own, *roots)), own.federation_exclude,
    )


@dataclass
class Queue:
    """Jobs in order, one worker. A whole-project job already waiting isn't queued again; a failing project is noted and the rest goes on."""

    run: Callable[[str, list[str] | None], object]
    waiting: list[tuple[str, list[str] | None]] = field(default_factory=list)
    completed: int = 0
    failed: int = 0
    errors: dict[str, str] = field(default_factory=dict)
    current: str | None = None

    def submit(self, project: str, named: list[str] | None = None) -> bool:
        if named is None and (project, None) in self.waiting:
            return False
        self.waiting.append((project, named))
        return True

    def drain(self) -> None:
        while self.waiting:
            self.current, named = self.waiting.pop(0)
            try:
                self.run(self.current, named)
                self.completed += 1
                self.errors.pop(self.current, None)
            except Exception as e:  # noqa: BLE001
                self.failed += 1
                self.errors[self.current] = str(e)
        self.current = None

    def status(self) -> dict:
        return {"depth": len(self.waiting), "current": self.current, "completed": self.completed, "failed": self.failed, "errors": dict(self.errors)}


def reconcile(queue: Queue, known: registry.Registry) -> int:
    """Queue every enabled project; returns how many."""
    return sum(queue.submit(p) for p, e in sorted(known.load().items()) if e.enabled)


def sweep(known: registry.Registry, root: str, config: corpus.Config = corpus.Config()) -> list[str]:
    """Claim the members found under a root that don't carry its claim yet; never removes one."""
    rows, at = known.load(), str(Path(root).resolve())
    new = [m for m in corpus.discover_members(root, config) if at not in rows.get(m, registry.Entry(m)).roots]
    for m in new:
        known.claim(m, root=root)
    return new


@dataclass
class Progress:
    """A progress file for others to read, written at most every `every` seconds but always at the end."""

    path: Path
    every: float = 1.0
    state: dict = field(default_factory=dict)
    last: float = 0.0

    def begin(self, project: str, total: int, now: float | None = None) -> None:
        now = time.time() if now is None else now
        self.state = {"project": project, "phase": "starting", "done": 0, "total": total, "started_at": now, "updated_at": now, "pid": os.getpid()}
        self._write(now, True)

    def advance(self, n: int = 1, phase: str | None = None, now: float | None = None) -> None:
        now = time.time() if now is None else now
        self.state |= {"done": self.state["done"] + n, "updated_at": now} | ({"phase": phase} if phase else {})
        self._write(now, False)

    def finish(self, phase: str = "done") -> None:
        self.state |= {"phase": phase, "updated_at": time.time()}
        self._write(self.state["updated_at"], True)

    def _write(self, now: float, force: bool) -> None:
        if force or now - self.last >= self.every:
            self.last = now
            made = self.path.with_suffix(".new")
            made.write_text(json.dumps(self.state))
            os.replace(made, self.path)

    def snapshot(self) -> dict:
        """The state with percent, files_per_s and eta_s where they are defined."""
        s = dict(self.state)
        took = s.get("updated_at", 0) - s.get("started_at", 0)
        if s.get("total"):
            s["percent"] = round(100 * s["done"] / s["total"], 1)
        if took > 0 and s.get("done"):
            s["files_per_s"] = round(s["done"] / took, 2)
            s["eta_s"] = round((s["total"] - s["done"]) * took / s["done"], 1)
        return s


def append_ledger(path: Path, row: dict, limit: int = 4 << 20) -> None:
    """Append a JSON line; a file above `limit` bytes becomes the one earlier generation first."""
    if path.exists() and path.stat().st_size >= limit:
        os.replace(path, path.with_suffix(path.suffix + ".1"))
    with path.open("a") as f:
        f.write(json.dumps(row) + "\n")


def listing(known: registry.Registry) -> list[str]:
    """A line per project: d for direct, e for enabled, counts, path; in order of path."""
    return [f"{'d' if e.direct else '-'}{'e' if e.enabled else '-'} {e.file_count:6d} {e.chunk_count:7d} {p}" for p, e in sorted(known.load().items())]


def default_root(folder: str, known: registry.Registry) -> str | None:
    """The nearest enabled project that is the folder or contains it."""
    p = Path(folder).resolve()
    rows = known.load()
    return next((str(a) for a in (p, *p.parents) if str(a) in rows and rows[str(a)].enabled), None)
