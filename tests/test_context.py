import random
import re

import pytest
from pyspark.sql import functions as F

from auditweave import catalogues, vocab
from auditweave.catalogues import Catalogue
from auditweave.functions import patterns as rx
from auditweave.functions import trigrams
from auditweave.operators import context as ctx
from auditweave.plans.joins import lookup_join

EVERY_PATTERN = [
    p for kind in (catalogues.FRAMEWORKS, catalogues.AUTH, catalogues.ROUTES, catalogues.MODELS) for ps in kind.values() for p in ps
] + catalogues.ROLES


def project(spark, *files):
    rows = [(p, path, len(body.encode()), body) for p, path, body in files]
    return spark.createDataFrame(rows, vocab.FILES)


def snapshots(spark, *files, **options):
    return {r.project: r for r in ctx.build_snapshot(project(spark, *files), **options).collect()}


EXAMPLES = {
    "django": ("from django.db import models", "python"), "flask": ("import flask", "python"),
    "fastapi": ("x = FastAPI()", "python"), "express": ("require('express')", "javascript"),
    "rails": ("class A < ApplicationController", "ruby"), "spring": ("@RestController", "java"),
    "laravel": ("use App\\Models", "php"), "nestjs": ("import '@nestjs/core'", "javascript"),
    "gin": ('"github.com/gin-gonic/gin"', "go"), "echo": ("e := echo.New()", "go"),
    "ruby": ("require 'sinatra'", "ruby"), "php": ("<?php", "php"),
}


def test_every_framework(spark):
    files = [(name, "a.py", body) for name, (body, _) in EXAMPLES.items()] + [("none", "a.py", "x"), ("mod", "a.py", "x"), ("mod", "go.mod", "")]
    got = snapshots(spark, *files)
    assert {n: (got[n].framework, got[n].language) for n in EXAMPLES} == {n: (n, l) for n, (_, l) in EXAMPLES.items()}
    assert (got["none"].framework, got["none"].language) == ("unknown", "unknown")
    assert (got["mod"].framework, got["mod"].language) == ("unknown", "go")


def test_first_file_then_first_framework(spark):
    got = snapshots(
        spark, ("p", "b.py", "from flask import x"), ("p", "a.py", "nothing"), ("p", "c.py", "import django"),
        ("q", "a.ts", "@Controller() @nestjs/"), ("r", "node_modules/a.py", "import django"),
    )
    assert got["p"].framework == "flask"
    assert got["q"].framework == "spring"
    assert got["r"].framework == "unknown" and got["r"].routes == []


def test_auth_routes_models_roles(spark):
    python = (
        "import flask\n@app.get('/a')\n@login_required\ndef f(): pass\n@app.get('/a')\npath('b/')\n"
        "class  User(db.Model):\n    pass\nclass Other(Base):\n"
    )
    got = snapshots(
        spark, ("p", "b/Guard.py", python), ("p", "a.py", "path( 'first/'\nrequireAuth"), ("p", "c.py", "AuthGuard @login_required"),
        ("p", "src/middleware.py", "auth stuff middleware"),
        ("go", "m.go", 'gin.New()\nr.GET("/x", h)\ntype User struct {\n'),
    )
    p = got["p"]
    assert p.routes == ["path( 'first/'", "@app.get('/a'", "path('b/'"]
    assert p.models == ["class  User(db.Model", "class Other(Base", "class  User(db.Model)", "class Other(Base)"]
    assert p.auth_summary == (
        "Auth mechanisms detected:\n  - decorator: found in 2 file(s)\n  - middleware: found in 1 file(s)\n"
        "  - guard: found in 1 file(s)\n  - dependency: found in 1 file(s)"
    )
    assert p.middleware == ["b/Guard.py", "src/middleware.py"]
    assert got["go"].routes == ['.GET("/x"'] and got["go"].models == ["type User struct {"]
    assert got["go"].auth_summary == ctx.NO_AUTH


def role_lines(body):
    seen = []
    for hit in re.finditer("|".join(f"(?:{p})" for p in catalogues.ROLES), body):
        line = body[max(0, hit.start() - 50) : hit.end() + 50].strip().split("\n")[0]
        if line not in seen:
            seen.append(line)
    return seen


def test_role_contexts_equal_brute_force(spark):
    rng = random.Random(5)
    words = ["admin", "is_admin", "staff", "role = ", "role  =", "Role.", "ADMIN", "x", "é", "😀", " ", "\n", "long" * 20, "has_role", "permission"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(0, 80))) for _ in range(120)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, content string")
    got = {r.i: r.roles for r in rows.select("i", ctx._role_contexts(catalogues.ROLES).alias("roles")).collect()}
    for i, body in enumerate(texts):
        assert got[i] == role_lines(body), body


def test_needed_texts_never_exclude_a_match(spark):
    for pattern in EVERY_PATTERN:
        plain = rx.plain_text(pattern)
        if plain is not None:
            assert re.fullmatch(pattern, plain)
    rng = random.Random(3)
    alphabet = ["class ", "Model", "Base", "@app.get('", "path ('", "x')", "auth", "middleware", "role=", "(", ")", "'", '"', "require", "express", "from "]
    for _ in range(20_000):
        body = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 8)))
        for pattern in (rng.choice(EVERY_PATTERN), "a|b", "(?i)CLASS", "clas?s", "x{0}Model", r"\.get\(", "[cx]lass", "(auth|role)="):
            needed = rx.needed_text(pattern)
            if needed is not None and re.search(pattern, body):
                assert needed in body, (pattern, body)
    assert rx.needed_text("(?i)abc") is None and rx.needed_text("abc|d") is None
    assert rx.needed_text(r"a\Qb") is None and rx.needed_text("ab?") == "a"


@pytest.mark.parametrize("rows", [None, 0])
def test_sample_takes_first_paths_in_both_joins(spark, monkeypatch, rows):
    if rows == 0:
        original = ctx.lookup_join
        monkeypatch.setattr(ctx, "lookup_join", lambda *a, **k: original(*a, **{**k, "max_rows": 0, "salts": 5}))
    files = [("big", f"f{i:04d}.py", "x") for i in range(300)] + [("small", "a.py", "y"), ("small", "b.txt", "y")]
    got = ctx.sample_files(project(spark, *files), limit=100).collect()
    assert sorted(r.path for r in got if r.project == "big") == [f"f{i:04d}.py" for i in range(100)]
    assert [r.path for r in got if r.project == "small"] == ["a.py"]


def test_sample_sizes(spark):
    with pytest.raises(ValueError):
        ctx.sample_files(project(spark, ("p", "a.py", "x")), 0)
    files = project(spark, *[("p", f"f{i}.py", f"@app.get('/r{i:04d}')\nimport fastapi") for i in range(1200)])
    assert ctx.sample_files(files, None).count() == 1200
    got = ctx.build_snapshot(files, limit=None).first()
    assert got.framework == "fastapi" and len(got.routes) == 1200


def test_texts_meet_in_no_window_and_no_list(spark):
    plan = ctx.build_snapshot(project(spark, ("p", "a.py", "x")), limit=None)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    for line in plan.splitlines():
        assert not ("collect_list" in line and "content" in line)


def test_role_contexts_are_linear(spark):
    """Sixty thousand hits in one file; quadratic work would not end within the test."""
    text = "if user.is_admin: x\n" * 60_000
    got = ctx.build_snapshot(project(spark, ("p", "a.py", text[:499_000]))).first()
    assert 0 < len(got.roles) < 10


def test_sample_plan_limits_before_the_shuffle_and_prunes_content(spark, tmp_path):
    project(spark, ("p", "a.py", "x")).write.parquet(str(tmp_path / "t"))
    plan = ctx.sample_files(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 100, Partial" in plan
    schemas = re.findall(r"ReadSchema: (\S+)", plan)
    assert any("content" not in s for s in schemas) and len(schemas) == 2


def test_rendering(spark):
    many = [f"/r{i:02d}" for i in range(33)]
    row = ("p", "flask", "python", "None.", many, ["M"] * 2, [f"role{i}" for i in range(20)], [f"m{i}" for i in range(12)])
    schema = "project string, framework string, language string, auth_summary string, routes array<string>, models array<string>, roles array<string>, middleware array<string>"
    frame = spark.createDataFrame([row, ("q", "f", "l", "s", [], [], [], [])], schema)
    got = {r.project: r.context for r in ctx.rendered_contexts(frame).collect()}
    assert got["p"] == "\n".join(
        ["=== CODEBASE SECURITY CONTEXT ===", "Framework: flask", "Language: python", "", "AUTHENTICATION:", "None.", "",
         "ROUTES (first 30):"] + [f"  {r}" for r in many[:30]] + ["  ... and 3 more", "", "DATA MODELS (first 20):", "  M", "  M", "",
         "ROLES/PERMISSIONS:"] + [f"  role{i}" for i in range(15)] + ["", "AUTH MIDDLEWARE:"] + [f"  m{i}" for i in range(10)] + [""]
    )
    assert got["q"].endswith("AUTHENTICATION:\ns\n")
    short = {r.project: r.context for r in ctx.rendered_contexts(frame, max_tokens=10).collect()}
    assert short["p"] == got["p"][:40] + "\n... (truncated)"
    view = {r.project: r for r in ctx.context_overview(frame).collect()}
    assert view["p"].routes_found == 33 and len(view["p"].routes) == 20 and view["q"].models == []


def test_catalogue_table_round_trip(spark):
    again = Catalogue.from_table(catalogues.DEFAULT_CATALOGUE.to_table(spark))
    for kind in ("frameworks", "auth", "routes", "models", "roles"):
        assert getattr(again, kind) == getattr(catalogues.DEFAULT_CATALOGUE, kind)
        assert list(getattr(again, kind)) == list(getattr(catalogues.DEFAULT_CATALOGUE, kind))


def test_own_catalogue(spark):
    own = Catalogue(frameworks={"mine": ["MARK"]}, framework_languages={"mine": "x"}, routes={"x": ["R[0-9]"]}, models={}, roles=[])
    got = snapshots(spark, ("p", "a.py", "MARK R1 R2 R1"), catalogue=own)["p"]
    assert (got.framework, got.language, got.routes, got.models, got.roles) == ("mine", "x", ["R1", "R2"], [], [])


def test_refresh_rebuilds_only_changed(spark):
    files = project(spark, ("a", "x.py", "import flask"), ("b", "x.py", "import flask"), ("new", "x.py", "import flask"))
    stored = ctx.empty_snapshot(spark.createDataFrame([("a",), ("b",), ("gone",)], "project string"))
    changed = spark.createDataFrame([("a",), ("new",), ("a",), ("gone",)], "project string")
    got = {r.project: r.framework for r in ctx.refresh_snapshot(stored, files, changed).collect()}
    assert got == {"a": "flask", "b": "unknown", "new": "flask"}
    defaults = ctx.empty_snapshot(spark.createDataFrame([("a",)], "project string")).first()
    assert defaults.auth_summary == ctx.NO_AUTH and defaults.routes == []


def test_files_are_not_shuffled_where_few_projects_are_cut(spark):
    rows = [(f"p{i % 5}", f"f{i}.py", 3, "x=1") for i in range(50)] + [(None, "n.py", 3, "x=1")]
    tree = spark.createDataFrame(rows, "project string, path string, size_bytes bigint, content string")
    many = tree.crossJoin(spark.range(25_000).select(F.col("id").cast("string").alias("name"))).withColumn("project", F.concat("project", "name"))
    plan = ctx.sample_files(many, 11)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    for limit in (1, 9, 10, 11):
        got = sorted((r.project, r.path) for r in ctx.sample_files(tree, limit).collect())
        assert got == sorted(x for p in range(5) for x in sorted((p_, f) for p_, f, _, _ in rows if p_ == f"p{p}")[:limit])


def test_a_large_lookup_is_not_broadcast(spark, tmp_path):
    """The salts make a table eight times as long as its stored size tells."""
    spark.range(1000).write.parquet(str(tmp_path / "keys"))
    small = spark.read.parquet(str(tmp_path / "keys"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        joined = lookup_join(spark.range(2000), small, "id", how, spread=["id"], max_rows=10)
        assert joined.count() == {"inner": 1000, "left": 2000, "left_semi": 1000, "left_anti": 1000}[how]
        assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()


def test_searched_kinds_equal_those_of_the_whole_search(spark):
    texts = ["from flask import Flask\n@app.get('/a')\nclass U(BaseModel): pass\n", "if user.is_admin: @login_required", "nothing", None]
    tree = spark.createDataFrame([(f"p{i % 3}", f"f{i}.py", 3, texts[i % 4]) for i in range(12)], "project string, path string, size_bytes bigint, content string")
    every = {r.project: r for r in ctx.project_features(tree).collect()}
    columns = {"framework": ("framework", "language"), "auth": ("auth_counts", "auth_files"), "routes": ("routes", "language"), "models": ("models",), "roles": ("roles",)}
    for kind, names in columns.items():
        for row in ctx.project_features(tree, kinds=(kind,)).collect():
            assert [row[n] for n in names] == [every[row.project][n] for n in names]
    assert any(r.roles for r in every.values()) and any(r.routes for r in every.values())


def test_beginnings_hide_no_match(spark):
    """Expressions with a look-ahead find what they find without it, also where the mark stands in the text."""
    assert trigrams.starts("(?:is_)?admin") == {"is", "ad"}
    assert [trigrams.starts(p) for p in (r"\vab", "[a[bc]]x", "[a&&b]x", "a|bc", r"\w+", "(?i)ab")] == [None] * 6
    words = ["is_admin", "admin", "superuser", "role = ", "Role.", "ADMIN", "has_role", "staffadmin", "permissionis_authorized", "adm", "é", "\n"]
    texts = [" ".join(words[(i * 7 + k * k) % len(words)] for k in range(i % 9 + 1)) for i in range(60)] + ["", "admin", "xadmin"]
    rows = spark.createDataFrame([(t,) for t in texts], "content string")
    old = rx.FLAGS + "|".join(f"(?:{p})" for p in catalogues.ROLES)
    hits = rows.select(F.regexp_extract_all("content", F.lit(old), F.lit(0)), F.regexp_extract_all("content", F.lit(rx.any_of(catalogues.ROLES)), F.lit(0)))
    assert rx.beginning(catalogues.ROLES) and all(a == b for a, b in hits.collect())
    marked = rows.select("content", F.concat("content", F.lit("z" * 60 + ctx.MARK)).alias("with_mark"))
    plain = [r[0] for r in marked.withColumn("content", F.concat("content", F.lit("z" * 60 + "y"))).select(ctx._role_contexts(catalogues.ROLES)).collect()]
    assert plain == [r[0] for r in marked.withColumn("content", F.col("with_mark")).select(ctx._role_contexts(catalogues.ROLES)).collect()]
