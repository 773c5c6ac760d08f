import random

import pytest

from ridgeline.llm import handwritten as hw


@pytest.mark.parametrize(
    ("path", "kind"),
    [
        ("a/node_modules/x/y.js", "third_party"), ("vendor/x.go", "third_party"), ("lib-1.2.3/x.py", "third_party"), ("vendor_portal/x.go", None), ("src/vendors/x.go", None),
        ("a.min.js", "minified"), ("a-min.css", "minified"), ("web/bundle.0123abcd.js", "minified"), ("api.pb.go", "generated"), ("x_pb2.py", "generated"), ("deep/go.sum", "generated"),
        ("generator_x.go", None), ("README.md", None), ("", None), (None, None),
    ],
)
def test_paths(path, kind):
    assert hw.path_kind(path) == kind


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("// Code generated by x. DO NOT EDIT.\nx", {"generated"}), ("#!/bin/sh\n# @generated SignedSource<<1>>\n", {"generated"}), ("\n-- AUTO-GENERATED. Regenerate with: make x\n", {"generated"}),
        ("# Diese Datei wurde automatisch erzeugt (x), bitte nicht von Hand ändern.\n", {"generated"}), ("// Vendored from git.x at commit 1\n", {"third_party"}),
        ("# x v1.2.3 - (c) the x contributors - released under the MIT licence\n", {"third_party"}), ("// Do not edit the x by hand here without a y; see the note.\n", set()),
        ("// Copyright 2026 the x maintainers. All rights reserved.\n", set()), ("# Manual changes will be lost.\n", {"generated"}), ("# the changes are described below\n", set()), ("x = 'Code generated by y. DO NOT EDIT.'\n", set()), ("def f():\n    # @generated files are skipped\n", set()), ("", set()),
    ],
)
def test_headers(text, kinds):
    assert hw.header_kinds(text) == kinds


def test_footers():
    assert hw.footer_kinds("x = 1\ny = 2\n\n// @generated by z\n") == {"generated"}
    assert hw.footer_kinds("// @generated by z\nx = 1\n") == set() and hw.footer_kinds("") == set() and hw.footer_kinds("// @generated by z") == {"generated"}
    assert hw.footer_kinds("x = 1\n// @generated by z\n" + "// more\n" * 40) == {"generated"}  # however long


def test_path_components():
    assert set(hw._path_features("lib-1.2.3/a.js")) & set(hw._path_features("kit-4.5.66/b.py")) and hw._path_features("") == hw._path_features(None)
    assert 0 <= hw.fold_of(None) < hw.FOLDS


def test_thresholds_weigh_precision():
    import numpy as np

    m, t = np.array([3.0, 2.0, 1.0, 0.5, -1.0]), np.array([True, True, False, True, False])
    assert 1.0 < hw._threshold(m, t) < 2.0 and hw._threshold(m, ~np.ones(5, bool)) == float("inf")


def corpus(n=60):
    random.seed(8)
    words = "load store rank scope member chunk vector query table header".split()
    name = lambda: f"{random.choice(words)}_{random.choice(words)}"
    files, chunks = [], []

    def add(i, path, text):
        files.append((f"p{i % 9}", i, path, "s"))
        half = text.find("\n", len(text) // 2) + 1 or len(text)
        for o, t in enumerate((text[:half], text[half:])):
            chunks.append((f"p{i % 9}", i * 10 + o, path, o, t, "extra"))

    truth = set()
    for i in range(n):
        add(i, f"src/f{i}.py", "".join(f"def {name()}(self, {name()}):\n    return {name()}({name()}) + {random.randint(0, 9)}\n\n" for _ in range(12)))
    for i in range(n, n + 25):  # minified, half of them named so
        body = ";".join(f"function {random.choice('abcxyz')}({random.choice('uvw')}){{return {random.choice('uvw')}?{random.choice('abc')}.{random.choice('de')}:{random.randint(1, 99)}}}" for _ in range(40))
        add(i, f"web/f{i}{'.min' if i % 2 else ''}.js", body)
        truth.add(i)
    for i in range(n + 25, n + 50):
        add(i, f"data/t{i}.js", "export default [\n" + "".join("  " + ", ".join(f"{random.random() * 100:.5f}" for _ in range(8)) + ",\n" for _ in range(30)) + "];\n")
        truth.add(i)
    for i in range(n + 50, n + 70):
        add(i, f"vendor/v{i}.py", f"def {name()}():\n    pass\n" * 5)
        truth.add(i)
    for i in range(n + 70, n + 74):  # nothing but a header tells
        add(i, f"src/g{i}.py", "# Code generated by maker. DO NOT EDIT.\n" + "".join(f"def {name()}(self, {name()}):\n    return {name()}({name()})\n\n" for _ in range(12)))
        truth.add(i)
    return files, chunks, truth


def test_classifier_finds_files_without_markers(spark):
    files, chunks, truth = corpus()
    f = spark.createDataFrame(files, "project string, file_id long, path string, kind string")
    c = spark.createDataFrame(chunks, "project string, chunk_id long, path string, ord int, text string, label string")
    dirty_f = f.union(f.limit(5)).union(spark.createDataFrame([(None, 900, None, None), ("p1", 901, "gone/no_chunks.py", None), ("p1", 902, "x/yarn.lock", None)], f.schema))
    dirty_c = c.union(c.limit(7)).union(spark.createDataFrame([("p1", 9001, "lost.py", None, None, None), ("p1", 9002, None, 0, "", None)], c.schema))
    out, model = hw.classify(dirty_f, dirty_c)
    rows = {r.file_id: r for r in out.collect()}
    found = {i for i, r in rows.items() if r.kind}
    assert found == truth | {902}
    assert len(rows) == len(files) + 3
    by = [r.told_by for i, r in rows.items() if i in truth]
    assert by.count("classifier") >= 0.9 * len(by)
    report = {r.kind: r for r in hw.validation_report(spark, model).collect()}
    assert report["minified"].recall >= 0.9 and report["data"].precision >= 0.9  # on repositories held out
    empty, none = hw.classify(f.limit(0), c.limit(0))
    assert empty.count() == 0 and none is None
