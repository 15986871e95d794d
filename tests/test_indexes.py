"""The trigram index and the manifests of trees."""

import dataclasses
import os
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditweave.catalogues import DEFAULT_CATALOGUE
from auditweave.functions import trigrams
from auditweave.functions.trigrams import needed
from auditweave.operators import context, search_index
from auditweave.operators import manifest as trees

FILES = "project string, path string, size_bytes bigint, content string"
TEXTS = {
    "flask": "from flask import Flask\n@app.route('/users/<id>')\ndef users(id): pass\n",
    "django": "from django.db import models\nclass User(models.Model):\n    pass\n",
    "express": "const express = require('express')\napp.get('/x', isAdmin, handler)\n",
    "plain": "nothing to see here, only words\n" * 3,
}


def files(spark, rows):
    return spark.createDataFrame([(p, path, len((text or "").encode()), text) for p, path, text in rows], FILES)


def trees_of(spark):
    rows = [(f"p{i}", f"src/{name}{i}.py", text) for i in range(8) for name, text in TEXTS.items() if (i + len(name)) % 3]
    rows += [("p0", "empty.py", ""), ("p0", "gone.py", None), ("p1", "short.py", "ab"), ("p2", "package.json", "{}")]
    return files(spark, rows)


def listed(snapshot):
    return sorted((r.asDict(recursive=True) for r in snapshot.collect()), key=str)


@pytest.mark.parametrize("pattern", search_index.catalogue_patterns(DEFAULT_CATALOGUE))
def test_pieces_of_every_pattern_are_certain(pattern):
    assert needed(pattern)


@pytest.mark.parametrize(
    "pattern, texts",
    [
        (r"(?:get|post)_user\d+", ["get_user7", "xpost_user12"]), (r"ab+cde", ["abcde", "abbbcde"]), (r"(abc){2,3}x", ["abcabcx", "abcabcabcx"]),
        (r"colou?rs", ["colors", "colours"]), (r"[ab]cde", ["acde", "bcde"]), (r"\broute\s*\(", ["route  ("]), (r"x*yzzy", ["xxyzzy", "yzzy"]),
        (r"^(?=a)abc$", ["abc"]), (r"(?:aaa|bbb|ccc|ddd)(?:eee|fff|ggg|hhh)(?:iii|jjj|kkk|lll)(?:mmm|nnn|ooo|ppp)(?:qqq|rrr)", ["aaafffiiipppqqq"]),
    ],
)
def test_matching_texts_hold_a_set_of_pieces(pattern, texts):
    sets = needed(pattern)
    for text in texts:
        assert re.search(pattern, text) and any(all(p in text for p in own) for own in sets)


@pytest.mark.parametrize("pattern", [r"\w+", "ab", "(?i)select", "a|longer", r"(?P<n>abc)", "(", r"abc|.*"])
def test_uncertain_patterns_have_no_pieces(pattern):
    assert needed(pattern) is None


@given(st.from_regex(r"(?:app|router)\.(?:get|put)\s*\(['\"][a-z/]{1,5}['\"]", fullmatch=True))
def test_generated_matches_hold_a_set_of_pieces(text):
    sets = needed(r"(?:app|router)\.(?:get|put)\s*\(['\"][a-z/]{1,5}['\"]")
    assert any(all(p in text for p in own) for own in sets)


def test_indexed_contexts_equal_those_of_all_files(spark):
    tree = trees_of(spark)
    index = search_index.index_of(tree)
    got = search_index.indexed_snapshot(tree, index, DEFAULT_CATALOGUE)
    assert listed(got) == listed(context.build_snapshot(tree))


def test_a_changed_file_replaces_its_postings(spark):
    tree = trees_of(spark)
    later = tree.where("path <> 'src/flask0.py'").withColumn("content", F.when(F.col("path") == "src/plain2.py", F.lit(TEXTS["django"])).otherwise(F.col("content")))
    changed = spark.createDataFrame([("p0", "src/flask0.py"), ("p2", "src/plain2.py"), ("p9", "never.py")], "project string, path string")
    got = search_index.update_index(search_index.index_of(tree), changed, later)
    assert sorted(got.collect()) == sorted(search_index.index_of(later).collect())


def test_unsearchable_patterns_ask_for_every_file(spark):
    tree = trees_of(spark)
    index = search_index.index_of(tree)
    assert search_index.candidates(index, tree, ["from flask", r"\w"]).count() == tree.count()
    assert search_index.candidates(index, tree, []).count() == 0
    found = {r.path for r in search_index.matches(index, tree, [r"from flask"]).collect()}
    assert found == {r.path for r in tree.where("content LIKE '%from flask%'").collect()}


def test_a_new_catalogue_rebuilds_only_what_can_match(spark):
    tree = trees_of(spark)
    index = search_index.index_of(tree)
    old = dataclasses.replace(DEFAULT_CATALOGUE, models={"python": []}, roles=[])
    stored = context.build_snapshot(tree, old).withColumn("auth_summary", F.concat("auth_summary", F.lit(" kept")))
    got = listed(search_index.recatalogued(stored, tree, index, old, DEFAULT_CATALOGUE))
    want = {r["project"]: r for r in listed(context.build_snapshot(tree))}
    touched = {r.project for r in search_index.candidates(index, tree, search_index.changed_patterns(old, DEFAULT_CATALOGUE)).collect()}
    assert 0 < len(touched) < len(want)
    for row in got:
        kept = row["auth_summary"].endswith(" kept")
        assert kept == (row["project"] not in touched)
        assert {**row, "auth_summary": row["auth_summary"].removesuffix(" kept")} == want[row["project"]]
    assert search_index.changed_patterns(old, old) == []
    assert search_index.changed_patterns(old, dataclasses.replace(old, manifests={})) is None
    more = dataclasses.replace(old, routes={**old.routes, "rust": ["#\\[get"]})
    assert set(old.routes["python"]) < set(search_index.changed_patterns(old, more))


def test_a_search_reads_its_shards_only(spark, tmp_path):
    """Files of the index that a search opens are those of the shards of its pieces."""
    rows = [("p", f"f{i}.py", " ".join(f"{chr(97 + (i * 7 + k * 5) % 26)}{chr(97 + (i + k * 11) % 26)}{k}w" for k in range(60))) for i in range(200)]
    tree = files(spark, [*rows, ("p", "hit.py", "from flask import Flask")])
    search_index.write_index(search_index.index_of(tree), str(tmp_path / "index"))
    index = search_index.read_index(spark, str(tmp_path / "index"))
    pieces = sorted({p for own in needed("flask") for p in own})
    shards = [r.shard for r in index.where(F.col("trigram").isin(pieces)).select("shard").distinct().collect()]
    sizes = {f"{os.path.basename(folder)}/{name}": os.path.getsize(f"{folder}/{name}")
             for folder, _, names in os.walk(tmp_path) for name in names if name.endswith(".parquet")}
    read = sum(size for name, size in sizes.items() if name.split("/")[0] in {f"shard={s}" for s in shards})
    assert 0 < read < sum(sizes.values()) / 4
    plan = index.where(F.col("shard").isin(shards))._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "shard" in plan.split("PartitionFilters: [")[1][:60]
    assert [r.path for r in search_index.candidates(index, tree, ["flask"]).collect()] == ["hit.py"]


def test_pieces_of_texts_equal_those_of_the_search(spark):
    texts = ["", "ab", "abc", "abcabc", "a\nb\r\x85", "\U0001f600", "a\U0001f600b\U0001d54fcd", "\U0001f600ab", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", trigrams.pieces(F.col("t")).alias("p")).collect()
    piece, place, names = trigrams.pieces_of([t or "" for t in texts])
    assert {(r.i, p) for r in rows for p in r.p or ()} == {(i, names[p]) for i, p in zip(place.tolist(), piece.tolist())}
    assert len(set(names)) == len(names)


def many_files(spark):
    """Files of which some share their number, with rare and frequent pieces."""
    rows = [(f"p{i % 9}", f"f{i}.py", f"from flask import x{i}\n" if i % 7 else f"express() {'wide' * (i % 5)}") for i in range(400)]
    return files(spark, [*rows, *rows[:40], ("p0", "empty.py", ""), ("p0", "gone.py", None), (None, "n.py", "from flask"), ("p1", None, "from flask")])


@pytest.mark.parametrize("blocks", [True, False])
def test_a_stored_index_holds_the_same_postings(spark, tmp_path, blocks):
    tree = many_files(spark).coalesce(2)
    index = search_index.index_of(tree)
    search_index.write_index(search_index.index_of(tree, blocks=blocks), str(tmp_path / "index"))
    read = search_index.read_index(spark, str(tmp_path / "index"))
    assert set(search_index.postings(read).collect()) == set(index.collect())
    for patterns in (["nowhere"], [r"express\(\)", "import x1"]):
        want = {r.file for r in tree.where(F.col("content").rlike("|".join(f"(?:{p})" for p in patterns))).select(search_index.file_key()).collect()}
        assert {r.file for r in search_index.candidate_keys(read, patterns).collect()} == want
    changed = spark.createDataFrame([("p1", "f1.py")], "project string, path string")
    later = tree.where("path IS NULL OR path <> 'f1.py'")
    assert set(search_index.update_index(read, changed, later).collect()) == set(search_index.index_of(later).collect())


def test_a_stored_index_is_small(spark, tmp_path):
    """A posting takes less than a byte where pieces are frequent; a number for each file would take eight."""
    tree = files(spark, [(f"p{i % 50}", f"src/{i}.py", TEXTS["express"] + TEXTS["django"] + str(i)) for i in range(4000)]).coalesce(1)
    search_index.write_index(search_index.index_of(tree, blocks=True), str(tmp_path / "index"))
    size = sum(os.path.getsize(f"{folder}/{name}") for folder, _, names in os.walk(tmp_path) for name in names if name.endswith(".parquet"))
    assert size < search_index.index_of(tree).count()


def test_blocks_are_made_without_an_exchange(spark):
    plan = search_index.index_of(many_files(spark), blocks=True)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan


def test_texts_of_matches_are_searched_by_number(spark, tmp_path):
    """Files without a project or path, and repeated ones, as a search of the texts finds them."""
    tree = many_files(spark)
    search_index.write_index(search_index.index_of(tree, blocks=True), str(tmp_path / "index"))
    got = search_index.matches(search_index.read_index(spark, str(tmp_path / "index")), tree, ["from flask"])
    want = tree.where("project IS NOT NULL AND path IS NOT NULL AND content LIKE '%from flask%'").select("project", "path")
    assert sorted(got.collect()) == sorted(want.collect())


def test_a_new_catalogue_looks_candidates_up_once(spark, tmp_path):
    """The names of the projects to build are stored, so the rows read no candidates of the changed patterns again."""
    tree = trees_of(spark)
    search_index.write_index(search_index.index_of(tree, blocks=True), str(tmp_path / "index"))
    index = search_index.read_index(spark, str(tmp_path / "index"))
    old = dataclasses.replace(DEFAULT_CATALOGUE, models={"python": []}, roles=[])
    rows = search_index.recatalogued(context.build_snapshot(tree, old), tree, index, old, DEFAULT_CATALOGUE)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" not in plan and "held" not in plan
    assert listed(rows) == listed(context.build_snapshot(tree))


def test_deleted_moved_and_edited_files_each_rebuild_one_project(spark):
    before = trees_of(spark)
    moved = F.when((F.col("project") == "p3") & F.col("path").startswith("src/django"), F.lit("lib/moved.py")).otherwise(F.col("path"))
    edited = F.when((F.col("project") == "p4") & F.col("path").startswith("src/flask"), F.lit(TEXTS["express"])).otherwise(F.col("content"))
    after = before.where("project <> 'p5' OR path NOT LIKE 'src/plain%'").where("project <> 'p6'").withColumn("path", moved).withColumn("content", edited)
    after = after.unionByName(files(spark, [("p9", "new.py", TEXTS["flask"])]))
    old, new = trees.file_manifest(before), trees.file_manifest(after)
    changes = {(r.project, r.path): (r.change, r.moved_from) for r in trees.changed_files(old, new).collect()}
    names = {r.project for r in trees.changed_projects(old, new).collect()}
    assert names == {p for p, _ in changes} >= {"p6", "p9"}
    assert changes[("p9", "new.py")] == ("added", None)
    assert all(change == "removed" for (p, _), (change, _) in changes.items() if p == "p6")
    stored = context.build_snapshot(before).withColumn("language", F.concat("language", F.lit("!")))
    got = listed(context.refresh_snapshot(stored, after, manifest=old))
    want = {r["project"]: r for r in listed(context.build_snapshot(after))}
    assert [r["project"] for r in got] == sorted(want)
    for row in got:
        assert row["language"].endswith("!") == (row["project"] not in names)
        assert {**row, "language": row["language"].removesuffix("!")} == want[row["project"]]


def test_moves_are_told_from_edits(spark):
    before = files(spark, [("p", "a.py", "same"), ("p", "b.py", "same"), ("p", "c.py", "old"), ("p", "d/e.py", "kept"), ("p", "n.py", None)])
    after = files(spark, [("p", "x.py", "same"), ("p", "c.py", "new"), ("p", "d/e.py", "kept"), ("p", "n.py", ""), ("q", "a.py", "same")])
    old, new = trees.file_manifest(before), trees.file_manifest(after)
    got = {(r.project, r.path, r.change, r.moved_from) for r in trees.changed_files(old, new).collect()}
    assert got == {("p", "x.py", "moved", "a.py"), ("p", "b.py", "removed", None), ("p", "c.py", "edited", None), ("p", "n.py", "edited", None), ("q", "a.py", "added", None)}
    assert {(r.project, r.directory) for r in trees.changed_directories(old, new).collect()} == {("p", ""), ("q", "")}
    assert trees.changed_files(old, old).count() == 0


def test_changed_files_reads_each_manifest_once(spark, tmp_path):
    """The texts behind a manifest are read once, whatever the kinds of change; a null project or size pairs with none."""
    schema = "project string, path string, size_bytes long, content_hash string"
    old = [("p", "a.py", 1, "x"), ("p", "b.py", 1, "x"), ("p", "c.py", 1, "y"), ("p", "d.py", None, "z"), (None, "n.py", 1, "x"), ("q", "a.py", 1, "x")]
    new = [("p", "m.py", 1, "x"), ("p", "c.py", 1, "x"), ("p", "e.py", None, "z"), (None, "n.py", 1, "x"), ("q", "a.py", 1, "x")]
    for name, rows in (("old", old), ("new", new)):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
    changes = trees.changed_files(*[spark.read.parquet(str(tmp_path / name)) for name in ("old", "new")])
    assert changes._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 2
    assert sorted(map(tuple, changes.collect()), key=str) == sorted([
        (None, "n.py", "added", None), (None, "n.py", "removed", None), ("p", "b.py", "removed", None), ("p", "c.py", "edited", None),
        ("p", "d.py", "removed", None), ("p", "e.py", "added", None), ("p", "m.py", "moved", "a.py")], key=str)


def test_a_refresh_makes_digests_once(spark, tmp_path):
    """What comes out of the comparison of manifests is stored, so the refreshed rows read no manifest and hash no text."""
    before = trees_of(spark)
    trees.file_manifest(before).write.parquet(str(tmp_path / "old"))
    after = before.where("project <> 'p5' OR path NOT LIKE 'src/plain%'")
    rows = context.refresh_snapshot(context.build_snapshot(before), after, manifest=spark.read.parquet(str(tmp_path / "old")))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "content_hash" not in plan and "md5(" not in plan
    assert listed(rows) == listed(context.build_snapshot(after))


def test_a_snapshot_counts_and_names_languages_in_one_pass(spark, tmp_path):
    """Texts are read once, paths once for the ranks and once for counts and manifests."""
    trees_of(spark).write.parquet(str(tmp_path / "tree"))
    plan = context.build_snapshot(spark.read.parquet(str(tmp_path / "tree")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 3


def test_a_refresh_moves_texts_only(spark, tmp_path):
    """Counts and manifests of the changed projects come from sums of all files, whose paths are not shuffled."""
    before = trees_of(spark)
    before.write.parquet(str(tmp_path / "tree"))
    tree = spark.read.parquet(str(tmp_path / "tree"))
    changed = spark.createDataFrame([("p1",), ("p2",), ("p2",), (None,), ("p9",)], "project string")
    stored = context.build_snapshot(before).withColumn("language", F.concat("language", F.lit("!")))
    rows = context.refresh_snapshot(stored, tree, changed)
    assert rows._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 3
    want = {r["project"]: r for r in listed(context.build_snapshot(before))}
    for row in (got := listed(rows)):
        assert row["language"].endswith("!") == (row["project"] not in ("p1", "p2"))
        assert {**row, "language": row["language"].removesuffix("!")} == want[row["project"]]
    assert [r["project"] for r in got] == sorted(want)


def test_a_refresh_takes_changes_or_a_manifest(spark):
    tree = trees_of(spark)
    with pytest.raises(ValueError):
        context.refresh_snapshot(context.build_snapshot(tree), tree)
