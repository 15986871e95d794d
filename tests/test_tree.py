import os

import pytest

from auditweave import vocab
from auditweave.sources import files as src
from auditweave.sources import tree


def grow(base):
    """Three projects: a deep one, a wide one and one with names that begin with a dot or an underscore."""
    want = {}
    for project, path, body in (
        *[("deep", "/".join(["d"] * n) + "/a.py", b"x" * n) for n in range(1, 9)],
        *[("wide", f"s{n % 7}/f{n}.py", b"w") for n in range(300)],
        ("odd", "__init__.py", b"i"), ("odd", ".github/run.py", b"g"), ("odd", "_in/_x.py", b""), ("odd", "a b/é.py", b"\xff"),
        ("odd", "node_modules/lib/x.js", b"n"),
    ):
        place = base / project / path
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_bytes(body)
        want[project, path] = body
    return want


@pytest.mark.parametrize("round_entries", [5, 100_000])
def test_listing_and_contents(spark, tmp_path, round_entries):
    want = grow(tmp_path)
    listing = tree.list_tree(spark, str(tmp_path), tasks=4, round_entries=round_entries)
    rows = [tuple(r) for r in listing.select("project", "path", "size_bytes").collect()]
    assert sorted(rows) == sorted((*key, len(body)) for key, body in want.items())
    got = {(r.project, r.path): bytes(r.raw) for r in tree.with_contents(listing, str(tmp_path), 4).collect()}
    assert got == want


def test_same_rows_as_the_driver_s_listing_where_that_sees_them(spark, tmp_path):
    grow(tmp_path)
    plain = "NOT path RLIKE '(^|/)[._]'"
    ours = tree.with_contents(tree.list_tree(spark, str(tmp_path)), str(tmp_path)).drop("error")
    theirs = src.read_tree(spark, str(tmp_path))
    assert sorted(map(tuple, ours.where(plain).collect())) == sorted(map(tuple, theirs.where(plain).collect()))


def test_skipped_directories_are_not_opened(spark, tmp_path):
    want = grow(tmp_path)
    (tmp_path / "odd" / "loop").symlink_to(tmp_path, target_is_directory=True)
    listing = tree.list_tree(spark, str(tmp_path / "odd"), project="p", skipped=vocab.SKIPPED_DIRS)
    assert {(r.project, r.path) for r in listing.collect()} == {
        ("p", path) for project, path in want if project == "odd" and "node_modules" not in path}


def test_errors_are_rows(spark, tmp_path):
    grow(tmp_path)
    listing = tree.list_tree(spark, str(tmp_path / "odd"), project="p")
    os.unlink(tmp_path / "odd" / "__init__.py")
    files = tree.with_contents(listing, str(tmp_path / "odd"))
    gone = files.where("raw IS NULL").collect()
    assert [(r.path, r.error) for r in gone] == [("__init__.py", "FileNotFoundError")]
    assert [tuple(r) for r in tree.errors_of(files).collect()] == [("p", "__init__.py", "Could not read: __init__.py")]
    walk = tree._lister(str(tmp_path), frozenset(), 10)
    import pandas as pd
    failed = pd.concat(walk(iter([pd.DataFrame({"place": [str(tmp_path / "absent")]})])))
    assert failed[["kind", "error"]].values.tolist() == [["failed", "FileNotFoundError"]]


def test_empty_and_absent_roots(spark, tmp_path):
    assert tree.list_tree(spark, str(tmp_path)).count() == 0
    assert tree.with_contents(tree.list_tree(spark, str(tmp_path)), str(tmp_path)).count() == 0
    with pytest.raises(ValueError):
        tree.list_tree(spark, str(tmp_path / "none"))
