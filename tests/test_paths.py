import fnmatch
import random

import pytest
from pyspark.sql import functions as F

from ridgeline.functions import fixed, paths

REFUSED = [".env", "prod.env", "svc.env.enc", "laravel-env", "a/id_rsa", "k/server.key", "x-secret.json", "node_modules/a.js", "p/a/node_modules/x.js", "sub/go.sum", "app.min.js",
           "poetry.lock", "logo.svg", "d.pdf", "data.csv", "vendor/x.go", ".git/config", "Form.Designer.cs"]
KEPT = [".env.example", "src/app.py", "README.md", "Dockerfile", "src/vendors.go", "docs/env.md", "a/mykey.py", "build", "x/distance/y.ts"]


def test_verdicts(spark):
    df = spark.createDataFrame([(p,) for p in REFUSED + KEPT], "p string")
    got = {r[0]: r[1] for r in df.select("p", paths.indexable(F.col("p"))).collect()}
    assert not [p for p in REFUSED if got[p]] and not [p for p in KEPT if not got[p]]


def test_include_wins_back_excludes_only(spark):
    df = spark.createDataFrame([(p,) for p in ("wiki/a.md", "wiki/keep.md", ".env", "node_modules/k.js")], "p string")
    got = [r[0] for r in df.select(paths.indexable(F.col("p"), ["wiki/*"], ["wiki/keep*", ".env", "node_modules/*"])).collect()]
    assert got == [False, True, False, False]


def test_globs_match_as_fnmatch_does(spark):
    random.seed(3)
    globs = ["*.lock", "wiki/*", "a?c", "[ab]*", "[!ab]*", "x[", "*.tar.gz", "dir", "[]x]y", "a.b", "*"]
    names = ["".join(random.choice("abcx/.[]!y") for _ in range(random.randint(0, 6))) for _ in range(300)] + ["wiki/a/b", "a.lock", "dir", "x[", "]y"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    for g in globs:
        got = [r[0] for r in df.select(paths.matches_any(F.col("p"), [g])).collect()]
        assert got == [fnmatch.fnmatchcase(n, g) or fnmatch.fnmatchcase(n + "/", g) for n in names], g


def test_languages(spark):
    want = {"a/Dockerfile": "dockerfile", "ci/Jenkinsfile": "groovy", "Makefile": "make", "CMakeLists.txt": "cmake", "a.py": "python", "a.tar.gz": "", ".env": "", "x": "", "b.TSX": "typescript"}
    df = spark.createDataFrame([(k,) for k in want], "p string")
    assert {r[0]: r[1] for r in df.select("p", paths.lang_of(F.col("p"))).collect()} == want


def test_tables_are_whole_and_disjoint():
    sizes = (len(fixed.IGNORE_DIRS), len(fixed.IGNORE_NAMES), len(fixed.DEFAULT_IGNORES), len(fixed.SECRET_NAMES), len(fixed.SECRET_GLOBS), len(fixed.IMAGE_SUFFIXES), len(fixed.BINARY_SUFFIXES))
    assert sizes == (77, 21, 21, 37, 29, 30, 138)
    assert (len(fixed.SUFFIX_LANGUAGE), len(set(fixed.SUFFIX_LANGUAGE.values())), len(fixed.NAME_LANGUAGE)) == (173, 87, 25)
    assert not set(fixed.SUFFIX_LANGUAGE) & {*fixed.IMAGE_SUFFIXES, *fixed.BINARY_SUFFIXES}


def test_helpers(spark):
    assert paths.is_forbidden_root("/") and paths.is_forbidden_root("/etc/x") and not paths.is_forbidden_root("/tmp/repo")
    df = spark.createDataFrame([("/a/b/c", b"x\0y"), ("/a", b"plain")], "p string, c binary")
    r = df.select(paths.ancestors(F.col("p")), paths.looks_binary(F.col("c")), paths.within(F.col("p"), F.lit("/a/b"))).collect()
    assert r[0][0][1:] == ["/a", "/a/b", "/a/b/c"] and [x[1] for x in r] == [True, False] and [x[2] for x in r] == [True, False]
    u = spark.createDataFrame([("file:///a%20b/c+d",)], "u string").select(paths.uri_path(F.col("u"))).first()[0]
    assert u == "/a b/c+d"


@pytest.mark.parametrize("order", [1, -1])
def test_signature_ignores_order(order):
    a = paths.config_signature(["b", "a"][::order], ["y", "x"][::order], True, False)
    assert a == paths.config_signature(["a", "b"], ["x", "y"], True, False) != paths.config_signature(["a"], [], True, False)
