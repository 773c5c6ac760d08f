import pytest

from ridgeline.plans import search as plan


def test_refusals_name_what_is_valid():
    langs = ["python", "go"]
    with pytest.raises(plan.SearchError, match="did you mean 'python'"):
        plan.check("q", lang="pyton", known_langs=langs)
    with pytest.raises(plan.SearchError, match="valid: go, python"):
        plan.check("q", lang="cobol", known_langs=langs)
    with pytest.raises(plan.SearchError, match="mode"):
        plan.check("q", mode="both")
    with pytest.raises(plan.SearchError, match="empty"):
        plan.check("  ")
    assert plan.check("q", k=0) == 1 and plan.check("q", k=500) == 50 and plan.check("q", lang="", known_langs=langs) == 10


def test_search_over_a_small_store(spark):
    files = spark.createDataFrame([("/r", "a.py", "python"), ("/r", "b.py", "python"), ("/m", "a.py", "python"), ("/m", "c.go", "go")], "project string, path string, lang string")
    body = {"a": "def parseUserConfig(path): return read(path)", "b": "def render table rows", "c": "func userConfig() string"}
    from ridgeline.operators import dense

    rows = [("/r", 1, "a.py", body["a"]), ("/r", 2, "b.py", body["b"]), ("/m", 3, "a.py", body["a"]), ("/m", 4, "c.go", body["c"])]
    chunks = spark.createDataFrame([(p, i, f, 0, 1, 1, t, None, f) for p, i, f, t in rows], "project string, chunk_id long, path string, ord int, start_line int, end_line int, text string, tokens array<string>, header string")
    model = dense.hashed_ngrams()
    vectors = spark.createDataFrame([(p, i, [float(x) for x in model([t])[0]]) for p, i, f, t in rows], "project string, chunk_id long, embedding array<float>")
    queries = plan.make_queries(spark, [(1, "parse user config")])
    for mode in plan.MODES:
        out = plan.search(chunks, files, vectors, queries, "/r", mode=mode, rerank=mode == "hybrid").orderBy("rank").collect()
        found = [(r.project, r.rel_path) for r in out]
        assert ("/m", "a.py") not in found  # the root owns the double
        if mode != "lexical":
            assert found[0] == ("/r", "a.py")
    assert {r.rel_path for r in plan.search(chunks, files, vectors, queries, "/r", lang="go").collect()} == {"c.go"}
    assert {r.rel_path for r in plan.search(chunks, files, vectors, queries, "/r", path_glob="b*").collect()} == {"b.py"}
    assert {r.project for r in plan.search(chunks, files, vectors, queries, "/r", projects=["/r"]).collect()} == {"/r"}
    assert plan.search(chunks.limit(0), files, vectors.limit(0), queries, "/r").count() == 0
    with pytest.raises(plan.SearchError, match="did you mean 'python'"):
        plan.search(chunks, files, vectors, queries, "/r", lang="pyton")
    with pytest.raises(plan.SearchError, match="empty"):
        plan.make_queries(spark, [(1, "  ")])
    known = spark.createDataFrame([("/r", True, 1.0), ("/m", True, None), ("/off", False, 1.0)], "path string, enabled boolean, indexed_at double")
    for root in ("/m", "/off", "/nowhere"):
        with pytest.raises(plan.SearchError, match="indexed"):
            plan.search(chunks, files, vectors, queries, root, registry=known)
    found = plan.search(chunks, files, vectors, queries, "/r", registry=known)
    row = plan.envelope(found, plan.scope_totals(files, chunks, ["/r", "/m"]), 7).first()
    assert (row.searched.projects, row.searched.chunks, row.took_ms, row.hint) == (2, 4, 7, None) and [r["rank"] for r in row.results] == list(range(1, len(row.results) + 1))


def test_intermediates_need_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from ridgeline import session

    conf = SimpleNamespace(get=lambda *_: None)
    remote = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077"), conf=conf)
    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_dir(remote)


def test_settings_from_the_environment():
    from ridgeline.session import setting

    env = {"N": " 7 ", "BAD": "x", "BLANK": " ", "F": "Yes", "OFF": "no", "S": " a "}
    assert (setting("N", 1, env), setting("BLANK", 3, env), setting("MISSING", 4, env)) == (7, 3, 4)
    assert setting("F", False, env) and not setting("OFF", True, env) and setting("BLANK", True, env)
    assert (setting("S", "d", env), setting("BLANK", "d", env), setting("MISSING", "d", env)) == ("a", "", "d")
    with pytest.raises(ValueError, match="BAD"):
        setting("BAD", 1, env)
