import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from ridgeline.operators.registry import Registry
from ridgeline.plans import indexing
from ridgeline.plans.indexing import Progress, Queue, Store
from ridgeline.sources import corpus
from ridgeline.streaming import changes


@pytest.fixture
def repo(tmp_path):
    p = tmp_path / "repo"
    (p / "src").mkdir(parents=True)
    (p / "ignored").mkdir()
    (p / "src/app.py").write_text('def parseUserConfig(path):\n    """Read it."""\n    return path\n')
    (p / "src/util.js").write_text("function renderTable() {}\n")
    (p / ".gitignore").write_text("ignored/\n*.log\n")
    (p / "ignored/junk.py").write_text("x = 1\n")
    (p / "noise.log").write_text("x\n")
    (p / "blank.py").write_text(" \n\n")
    (p / "bin.py").write_bytes(b"a\0b")
    (p / ".env").write_text("KEY=1\n")
    subprocess.run(["git", "init", "-q", str(p)], check=True)
    return p


def test_listing(spark, repo):
    assert [r.path for r in corpus.list_files(spark, repo).collect()] == [".gitignore", "bin.py", "blank.py", "src/app.py", "src/util.js"]
    assert corpus.git_ignored(repo, ["ignored/junk.py", "src/app.py"]) == {"ignored/junk.py"}
    assert corpus.git_files("/") is None and "src/app.py" in corpus.walked_files(repo)
    rows = {r.path: r for r in corpus.read_project(spark, repo).collect()}
    assert rows.keys() == {".gitignore", "src/app.py", "src/util.js"} and rows["src/app.py"].lang == "python" and rows["src/app.py"].n_lines == 4
    with pytest.raises(ValueError, match="never"):
        corpus.list_files(spark, "/etc")


def test_passes(spark, repo, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    one = s.index_project(str(repo))
    assert (one.written, one.deleted, one.files) == (3, 0, 3) and one.chunks >= 3
    two = s.index_project(str(repo))
    assert (two.written, two.deleted, two.files, two.chunks) == (0, 0, 3, one.chunks)
    (repo / "src/app.py").write_text("def other(): pass\n")
    os.unlink(repo / "src/util.js")
    three = s.index_project(str(repo))
    assert (three.written, three.deleted, three.files) == (1, 1, 2)
    assert {r.text for r in s.chunks().where("path = 'src/app.py'").collect()} == {"def other(): pass\n"}
    four = s.index_project(str(repo), named=["src/app.py", "nowhere.py"])
    assert (four.written, four.deleted) == (1, 0)
    five = s.index_project(str(repo), corpus.Config(exclude=("src/*",)))
    assert (five.deleted, five.files) == (1, 1)
    assert s.index_project(str(repo)).written == 1
    s.settings["embed_dims"] = "32"
    six = s.index_project(str(repo))
    assert "embed_dims" in six.rebuilt and six.written == 2
    with pytest.raises(FileNotFoundError):
        s.index_project(str(tmp_path / "missing"))


def state(s):
    return {(r.path, r.sha256) for r in s.files().collect()}, {(r.path, r.ord, r.text) for r in s.chunks().collect()}


def test_a_stop_between_any_two_writes_loses_nothing(spark, repo, tmp_path, monkeypatch):
    s = Store(spark, f"file://{tmp_path}/store")
    s.index_project(str(repo))
    before = state(s)
    (repo / "src/app.py").write_text("def other(): pass\n")
    os.unlink(repo / "src/util.js")

    def stop(*_, **__):
        raise RuntimeError("stopped")

    from ridgeline.operators import lexical

    for where, name in ((indexing.chunking, "chunk_files"), (lexical, "write_postings"), (Store, "_commit")):
        with monkeypatch.context() as m:
            m.setattr(where, name, stop)
            with pytest.raises(RuntimeError):
                s.index_project(str(repo))
        assert state(s) == before  # what was there is still there, whole
    done = s.index_project(str(repo))
    assert (done.written, done.deleted, done.files) == (1, 1, 2)
    files, chunks = state(s)
    assert {p for p, _ in files} == {".gitignore", "src/app.py"} == {p for p, *_ in chunks}
    s.compact()
    assert state(s) == (files, chunks) and len(s.commits()) == 1
    assert s.index_project(str(repo)).written == 0


def test_a_small_edit_writes_a_small_generation(spark, repo, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    s.index_project(str(repo))
    (repo / "src/app.py").write_text("def other(): pass\n")
    s.index_project(str(repo), named=["src/app.py"])
    newest = max(s._names("chunks"))
    assert {r.path for r in spark.read.parquet(f"{s.root}/chunks/{newest}").collect()} == {"src/app.py"}
    with pytest.raises(FileNotFoundError):
        s.open("/nowhere")
    assert s.open(str(repo.resolve())).count() == s.chunks().count()


def test_stored_postings_score_like_the_texts(spark, repo, tmp_path):
    from ridgeline.operators import lexical

    s = Store(spark, f"file://{tmp_path}/store")
    s.index_project(str(repo))
    (repo / "src/app.py").write_text("def parse_table(): return renderTable\n")
    s.index_project(str(repo))
    q = spark.createDataFrame([(1, ["table", "parse", "nowhere"])], "qid long, terms array<string>")
    by = lambda df: sorted((r.qid, r.chunk_id, round(r.score, 9)) for r in df.collect())
    assert by(s.bm25(q)) == by(lexical.bm25(s.chunks(), q)) != []
    assert s.bm25(q, ["/none"]).count() == 0
    words = ["table", "é_日本", "", "x" * 500]
    own = spark.createDataFrame([(w,) for w in words], "w string").select(lexical.bucket_of(F.col("w")).alias("b")).distinct()
    assert lexical.bucket_numbers(spark, words) == sorted(r.b for r in own.collect())
    with pytest.raises(ValueError, match="terms"):
        lexical.asked_terms(spark.createDataFrame([(1, [str(i) for i in range(lexical.MAX_TERMS + 1)])], "qid long, terms array<string>"))


def test_a_watch_is_armed_anew_only_for_another_set():
    started = []

    class Feed:
        def stop(self):
            started.append("stop")

    w = changes.Watch(lambda projects: started.append(projects) or Feed(), lambda p: p != "broken")
    assert w.arm(["b", "a", "broken"]) and not w.arm(["a", "b"]) and w.arm(["a"]) and w.arm([])
    assert started == [["a", "b"], "stop", ["a"], "stop"]


def test_queue_goes_on_after_a_failure():
    def run(project, named):
        if project == "bad":
            raise ValueError("no")

    q = Queue(run)
    assert q.submit("a") and not q.submit("a") and q.submit("a", ["x"]) and q.submit("a", ["x"]) and q.submit("bad") and q.submit("c")
    q.drain()
    assert (q.completed, q.failed, q.errors, q.status()["depth"]) == (4, 1, {"bad": "no"}, 0)


def test_config():
    c = corpus.parse_config("index:\n  exclude: [a/*]\n  respect_gitignore: false\nfederation:\n  exclude: [x]\n")
    assert c.exclude == ("a/*",) and not c.respect_gitignore and c.federation_exclude == ("x",) and corpus.parse_config("") == corpus.Config()
    for bad, said in (("- a", "mapping"), ("indx: {}", "did you mean 'index'"), ("index: {exclud: []}", "did you mean 'exclude'"), ("index: {exclude: x}", "list"), ("index: {patterns: [a]}", "retired"), ("index: [a]", "index: must be a mapping"), ("index: {exclude: [no]}\nfederation: {exclude: 1}", "list of strings; .*list of strings"), ("index: {respect_gitignore: 1}", "true or false"), ("a: [", "<string>")):
        with pytest.raises(corpus.ConfigError, match=said):
            corpus.parse_config(bad)
    assert c.signature() == corpus.Config(("a/*",), (), False, True, ()).signature()
    a, b = corpus.Config(exclude=("b",), respect_gitignore=False), corpus.Config(exclude=("a",), include=("z",))
    assert indexing.unite(a, b) == corpus.Config(("a", "b"), (), True, True, ())


def test_members_progress_and_reports(spark, repo, tmp_path):
    root = tmp_path / "root"
    (root / "links").mkdir(parents=True)
    (root / "main.py").write_text("x\n")
    for i in range(3):
        (root / f"links/m{i}").symlink_to(repo)
    (root / "links/self").symlink_to(root)
    (root / "links/broken").symlink_to(tmp_path / "nowhere")
    assert corpus.discover_members(root) == [str(repo)]
    assert corpus.discover_members(root, corpus.Config(federation_exclude=("links/m*",))) == []
    known = Registry(tmp_path / "p.json")
    known.claim(str(root), direct=True)
    assert indexing.sweep(known, str(root)) == [str(repo)] and indexing.sweep(known, str(root)) == []
    assert indexing.default_root(str(repo / "src"), known) == str(repo) and len(indexing.listing(known)) == 2
    q = Queue(lambda p, n: None)
    assert indexing.reconcile(q, known) == 2
    s = Store(spark, f"file://{tmp_path}/store")
    s.index_project(str(repo))
    assert {d["problem"] for d in s.doctor(known)} == {"never indexed"}
    known.release(str(repo), root=str(root))
    assert {"project": str(repo), "problem": "unclaimed"} in s.doctor(known)
    p = Progress(tmp_path / "progress.json", every=100)
    p.begin("x", 10, now=100.0)
    p.advance(5, "embedding", now=110.0)
    assert json.loads(p.path.read_text())["done"] == 0 and p.snapshot()["percent"] == 50.0 and p.snapshot()["eta_s"] == 10.0
    p.finish()
    assert json.loads(p.path.read_text())["phase"] == "done"
    for i in range(3):
        indexing.append_ledger(tmp_path / "pins.jsonl", {"i": i}, limit=10)
    assert (tmp_path / "pins.jsonl.1").exists()


def test_transcripts(spark, tmp_path):
    d = tmp_path / "t"
    d.mkdir()
    (d / "a.jsonl").write_text('not json\n{"x": 1}\n{"cwd": "/w/a/sub"}\n{"cwd": "/w/b"}\n')
    (d / "b.jsonl").write_text('{"cwd": "/w/a"}\n')
    (d / "c.jsonl").write_text("{}\n")
    folders = corpus.session_folders(spark, str(d))
    assert sorted(r.cwd for r in folders.collect()) == ["/w/a", "/w/a/sub"]
    got = {r.how: (r.n, r.percent) for r in corpus.census(folders, spark.createDataFrame([("/w/a",)], "path string")).collect()}
    assert got == {"direct": (1, 50.0), "resolves-up": (1, 50.0)}


def test_change_stream(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    events = [{"seq": i, "change": "modified", "path": f"/w/a/src/f{i}.py"} for i in range(200)] + [{"seq": 200, "change": "added", "path": "/w/b/x.go"}, {"seq": 201, "change": "added", "path": "/w/a/.env"}, {"seq": 202, "change": "added", "path": "/v/y"}]
    (log / "1.json").write_text("\n".join(map(json.dumps, events + events[:5])))
    projects = spark.createDataFrame([("/w/a",), ("/w/b",)], "path string")
    got, errors = {}, []

    def apply(project, names, batch):
        if project == "/w/b":
            raise OSError("poison")
        got.setdefault(project, []).append(names)

    for _ in range(2):  # the second start finds nothing new
        changes.watch(spark, str(log), projects, apply, str(tmp_path / "state"), lambda p, e: errors.append(p), once=True).awaitTermination()
    assert {k: [len(n) for n in v] for k, v in got.items()} == {"/w/a": [200]} and errors == ["/w/b"]
    (log / "2.json").write_text(json.dumps({"seq": 1, "change": "deleted", "path": "/w/a/src/f1.py"}))
    changes.watch(spark, str(log), projects, apply, str(tmp_path / "state"), lambda p, e: None, once=True).awaitTermination()
    assert got["/w/a"][1] == ["src/f1.py"]
    big = changes.jobs(spark.createDataFrame([(f"/w/a/f{i}.py",) for i in range(95)], "path string"), projects, 10).collect()
    assert len(big) > 5 and sorted(p for j in big for p in j.paths) == sorted(f"f{i}.py" for i in range(95))
