import os

import pytest
from pyspark.sql import functions as F

from auditweave import vocab
from auditweave.functions import text
from auditweave.sources import files as src
from auditweave.sources import roots


def frame(spark, rows):
    return spark.createDataFrame(rows, vocab.FILES)


@pytest.mark.parametrize(
    "path,language",
    [(f"dir/a{s}", name) for s, name in vocab.CODE_LANGUAGES.items()]
    + [("a.PY", "python"), ("a.xyz", "unknown"), (".py", "unknown"), ("Makefile", "unknown"), ("a.tar.go", "go")],
)
def test_language(spark, path, language):
    row = spark.createDataFrame([(path,)], "path string").select(text.language_of(F.col("path"))).first()
    assert row[0] == language


def test_admission_by_suffix_directory_and_size(spark):
    kept = [(f"src/a{s}", 10) for s in vocab.CODE_LANGUAGES] + [("x.egg-info/a.py", 10), ("a.py", 500_000), ("environment/a.py", 1)]
    gone = [("a.PY", 10), ("a.txt", 10), (".py", 10), ("a.py", 500_001), ("b/a.py.", 5)]
    gone += [(f"deep/{d}/x/a.py", 10) for d in vocab.SKIPPED_DIRS] + [(f"{d}/a.py", 10) for d in vocab.SKIPPED_DIRS]
    rows = frame(spark, [("p", path, size, "") for path, size in kept + gone])
    assert {(r.path, r.size_bytes) for r in src.admitted(rows).collect()} == set(kept)
    reasons = rows.select("path", "size_bytes", src.refusal(F.col("path"), F.col("size_bytes")).alias("why")).collect()
    assert {(r.path, r.size_bytes) for r in reasons if r.why is None} == set(kept)
    assert {r.why for r in reasons} == {None, "extension", "directory", "size"}


def test_line_cap_and_short_files(spark):
    long = "\n".join(f"line {i}" for i in range(500))
    rows = frame(spark, [("p", "long.py", 1, long), ("p", "ten.py", 1, "\n\n" + "\n".join("abcdefghij") + " \n"), ("p", "nine.py", 1, "\n".join("abcdefghi") + "\n\n\n")])
    got = {r.path: r for r in src.reviewable(rows, max_lines=100).collect()}
    assert got["long.py"].content == "\n".join(f"line {i}" for i in range(100))
    assert got["ten.py"].long_enough and not got["nine.py"].long_enough


def test_strip_matches_unicode_white_space(spark):
    samples = ["", " a ", " \x1da b\x85　", "\n\n", "a", "﻿a", " é\t"]
    got = spark.createDataFrame([(s,) for s in samples], "s string").select(text.strip(F.col("s"))).collect()
    assert [r[0] for r in got] == [s.strip() for s in samples]


def test_estimated_and_encoded_tokens(spark):
    rows = spark.createDataFrame([("",), ("abc",), ("abcde",)], "s string")
    assert [r[0] for r in rows.select(text.ESTIMATE.of(F.col("s"))).collect()] == [0, 1, 2]
    words = text.EncodedTokens(lambda: str.split)
    rows = spark.createDataFrame([("", ["a b", ""]), ("one two three", [])], "s string, l array<string>")
    got = rows.select(words.of(F.col("s")), words.of_each(F.col("l"))).collect()
    assert [(r[0], list(r[1])) for r in got] == [(0, [2, 0]), (3, [])]


def test_tree_source_decodes_and_prunes(spark, tmp_path):
    (tmp_path / "one" / "src").mkdir(parents=True)
    (tmp_path / "two").mkdir()
    (tmp_path / "one" / "src" / "a.py").write_bytes("é\r\nb\rc".encode() + b"\xff\xfe")
    (tmp_path / "two" / "b.js").write_bytes(b"x" * 60)
    tree = src.read_tree(spark, str(tmp_path))
    got = {(r.project, r.path): r for r in src.decoded(tree).collect()}
    raw = (tmp_path / "one" / "src" / "a.py").read_text(encoding="utf-8", errors="replace")
    assert got["one", "src/a.py"].content == raw
    assert got["two", "b.js"].size_bytes == 60
    single = src.read_tree(spark, str(tmp_path / "one"), project="named").select("project", "path").collect()
    assert [tuple(r) for r in single] == [("named", "src/a.py")]
    lean = src.admitted(tree, 50).select("project", "path")
    plan = lean._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,50)" in plan and "content" not in plan.split("ReadSchema")[1]
    assert [tuple(r) for r in lean.collect()] == [("one", "src/a.py")]


def test_read_errors(spark):
    rows = frame(spark, [("p", "a.py", 1, "x"), ("p", "b.py", 1, None)])
    assert [tuple(r) for r in src.read_errors(rows, rows).collect()] == [("p", "b.py", "Could not read: b.py")]


def test_manifest_order_and_root_only(spark):
    rows = frame(spark, [("a", "go.mod", 1, ""), ("a", "package.json", 1, ""), ("b", "sub/pom.xml", 1, ""), ("c", "Cargo.toml", 1, "")])
    got = {r.project: r.manifest_language for r in roots.manifest_languages(rows).collect()}
    assert got == {"a": "javascript", "b": "unknown", "c": "rust"}


@pytest.mark.parametrize("max_rows", [None, 0])
def test_nearest_roots(spark, monkeypatch, max_rows):
    if max_rows is not None:  # the shuffled, salted join gives the same
        original = roots.lookup_join
        monkeypatch.setattr(roots, "lookup_join", lambda *a, **k: original(*a, **{**k, "max_rows": 0, "salts": 3}))
    listing = spark.createDataFrame(
        [("/r/.git/HEAD",), ("/r/a/package.json",), ("/r/a/b/x.py",), ("/r/c/y.py",), ("/z/q.py",), ("q.py",)], "path string"
    )
    got = {r.path: r.root for r in roots.nearest_roots(listing, roots.marker_dirs(listing)).collect()}
    assert got["/r/a/b/x.py"] == "/r/a" and got["/r/c/y.py"] == "/r"
    assert got["/z/q.py"] == "/" and got["q.py"] == "/"
    assert len(got) == 6
