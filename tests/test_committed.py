import json
import os

import pytest

from auditweave.sinks import committed, reports
from tests.test_reports import found, scanned


def parts(spark, *rows):
    return spark.createDataFrame(list(rows), "project string, part int, ordinal long, text string")


def test_documents_are_whole_and_in_order(spark, tmp_path):
    path = str(tmp_path / "r")
    made = reports.json_reports(found(spark), scanned(spark))
    committed.write_committed(made, path)
    for project in ("p", "q", "quiet"):
        assert committed.document_at(path, project) == reports.document_of(made, project)
    lines = committed.committed_lines(spark, path)
    assert sorted((r.project, r.text) for r in lines.collect()) == sorted((r.project, r.text) for r in made.collect())


def test_a_hot_project_is_written_by_several_tasks(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = parts(spark, *[("hot", 1, n, f'"{n}é"') for n in range(5000)], ("../up", 0, 0, "{}"), ("", 0, 0, "[]"), (None, 0, 0, "1"), ("a b%2F.", 0, 0, "2"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small tasks would be put together
    try:
        committed.write_committed(rows, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    folder = os.path.join(path, committed.current(path)["generation"], committed.folder_of("hot"))
    assert len(os.listdir(folder)) > 1
    assert committed.document_at(path, "hot") == "".join(f'"{n}é"' for n in range(5000))
    assert [committed.document_at(path, p) for p in ("../up", "", None, "a b%2F.")] == ["{}", "[]", "1", "2"]
    assert os.listdir(tmp_path) == ["r"]
    got = {r.project for r in committed.committed_lines(spark, path).collect()}
    assert got == {"hot", "../up", "", None, "a b%2F."}


def test_a_failed_write_leaves_the_old_report(spark, tmp_path):
    path = str(tmp_path / "r")
    committed.write_committed(parts(spark, ("p", 0, 0, "old")), path)
    broken = parts(spark, *[("p", 0, n, "new") for n in range(50)], ("p", 0, 99, None))
    with pytest.raises(Exception):  # a text that is null cannot be written
        committed.write_committed(broken, path)
    assert committed.document_at(path, "p") == "old"
    assert sorted(os.listdir(path)) == sorted([committed.CURRENT, committed.current(path)["generation"]])
    committed.write_committed(parts(spark, ("p", 0, 0, "newer")), path)
    assert committed.document_at(path, "p") == "newer"
    assert len(os.listdir(path)) == 2


def test_files_of_other_attempts_are_passed_over(spark, tmp_path):
    path = str(tmp_path / "r")
    committed.write_committed(parts(spark, ("p", 0, 0, "a")), path)
    folder = os.path.join(path, committed.current(path)["generation"], committed.folder_of("p"))
    with open(os.path.join(folder, "000000-twin.txt"), "w") as twin:
        twin.write("half")
    assert committed.document_at(path, "p") == "a"
    assert [r.text for r in committed.committed_lines(spark, path).collect()] == ["a"]


def test_empty_absent_and_wrong(spark, tmp_path):
    path = str(tmp_path / "r")
    with pytest.raises(FileNotFoundError):
        committed.document_at(path, "p")
    committed.write_committed(parts(spark), path)
    assert committed.committed_lines(spark, path).count() == 0
    with pytest.raises(Exception, match="overwrite"):
        parts(spark, ("p", 0, 0, "a")).select("project", "text").write.format(committed.FORMAT).mode("append").option("path", path).save()
    committed.write_committed(parts(spark, ("p", 0, 0, "a")), f"file:{path}")
    assert committed.document_at(f"file://{path}", "p") == "a"
    assert [r.text for r in committed.committed_lines(spark, f"file://{path}").collect()] == ["a"]
    with pytest.raises(ValueError):
        committed.current("store://reports")
    committed.write_committed(parts(spark), path)
    assert json.load(open(os.path.join(path, committed.CURRENT)))["rows"] == 0
