import json

import pytest

from auditweave.operators import findings as ops
from auditweave.plans.joins import at_most, lookup_join, shared_folder
from auditweave.sinks import reports
from auditweave.sources.reports import read_parts, read_reports, report_findings
from tests.test_reviews import finding, frame


def found(spark):
    rows = [finding(i, cls=c, title=f"T{i}", sev=s) for i, (c, s) in enumerate([("JWT_ISSUE", "CRITICAL"), ("IDOR", "HIGH"), ("JWT_ISSUE", "MEDIUM"), ("IDOR", "LOW"), ("SAFE", "INFO")])]
    return ops.deduplicate(frame(spark, *rows, finding(9, project="q")))


def scanned(spark):
    return spark.createDataFrame([("p", 4), ("q", 1), ("quiet", 2)], "project string, files_scanned long")


def test_files_scanned_counts_paths_less_errors(spark):
    files = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "c")], "project string, path string")
    errors = spark.createDataFrame([("p", "b", "e")], "project string, path string, error string")
    assert {tuple(r) for r in ops.files_scanned(files).collect()} == {("p", 2), ("q", 1)}
    assert {tuple(r) for r in ops.files_scanned(files, errors).collect()} == {("p", 1), ("q", 1)}


def documents(df):
    return {r.project: json.loads(r.document) for r in reports.documents(df).collect()}


def test_json_report(spark):
    errors = spark.createDataFrame([("p", "Could not read: z"), ("p", "Could not read: y"), ("quiet", "e")], "project string, error string")
    got = documents(reports.json_reports(found(spark), scanned(spark), errors))
    assert set(got) == {"p", "q", "quiet"}
    p = got["p"]
    assert list(p) == ["summary", "findings", "errors"]
    assert p["summary"] == {"files_scanned": 4, "total_findings": 5, "critical": 1, "high": 1, "medium": 1, "low": 1, "info": 1}
    assert [f["title"] for f in p["findings"]] == ["T0", "T1", "T2", "T3", "T4"]
    assert list(p["findings"][0]) == [
        "id", "vuln_class", "severity", "confidence", "file", "line_start", "line_end", "title", "description", "impact", "reproduction", "fix",
    ]
    assert p["errors"] == ["Could not read: y", "Could not read: z"]
    assert got["quiet"] == {"summary": {"files_scanned": 2, "total_findings": 0, "critical": 0, "high": 0, "medium": 0, "low": 0, "info": 0}, "findings": [], "errors": ["e"]}
    assert documents(reports.json_reports(found(spark), scanned(spark)))["p"]["errors"] == []


def test_sarif(spark):
    got = documents(reports.sarif_documents(found(spark), scanned(spark)))
    p = got["p"]
    assert p["version"] == "2.1.0" and len(p["runs"]) == 1
    run = p["runs"][0]
    assert [r["level"] for r in run["results"]] == ["error", "error", "warning", "note", "note"]
    assert [(r["id"], r["shortDescription"]["text"]) for r in run["tool"]["driver"]["rules"]] == [("JWT_ISSUE", "Jwt Issue"), ("IDOR", "Idor"), ("SAFE", "Safe")]
    first = run["results"][0]
    assert first["message"]["text"] == "T0\n\nd\n\nImpact: i\n\nFix: f"
    assert first["locations"][0]["physicalLocation"]["region"] == {"startLine": 10, "endLine": 15}
    quiet = got["quiet"]["runs"][0]
    assert quiet["results"] == [] and quiet["tool"]["driver"]["rules"] == []


@pytest.mark.parametrize("count", [50, 50_000])
def test_one_shape_and_order_at_every_size(spark, count):
    rows = spark.range(count).selectExpr(
        "'p' AS project", "concat('F', id) AS finding_id", "element_at(array('IDOR', 'JWT_ISSUE'), cast(id % 2 + 1 AS int)) AS vuln_class",
        "'HIGH' AS severity", "'HIGH' AS confidence", "'f' AS file", "id AS line_start", "id AS line_end", "concat('T', id) AS title",
        "'d' AS description", "'i' AS impact", "'r' AS reproduction", "'x' AS fix", "concat('s', id % 7) AS source_path",
        "cast(id AS int) AS chunk_index", "0 AS item_index")
    scans = spark.createDataFrame([("p", 3)], "project string, files_scanned long")
    parts = reports.json_reports(rows, scans)
    whole = json.loads(reports.document_of(parts, "p"))
    order = [int(f["id"][1:]) for f in whole["findings"]]
    assert whole["summary"]["total_findings"] == count and order == sorted(range(count), key=lambda i: (i % 7, i))
    assert parts.select("part", "ordinal").distinct().count() == parts.count() == count + 3
    run = json.loads(reports.document_of(reports.sarif_documents(rows, scans), "p"))["runs"]
    assert len(run) == 1 and len(run[0]["results"]) == count and [r["id"] for r in run[0]["tool"]["driver"]["rules"]] == ["IDOR", "JWT_ISSUE"]
    assert json.loads(reports.document_of(reports.finding_arrays(rows, scans), "p")) == whole["findings"]


def test_no_project_is_lost(spark):
    errors = spark.createDataFrame([("unread", 'Could not read: "z"\n')], "project string, error string")
    only = spark.createDataFrame([("other", 1)], "project string, files_scanned long")
    got = documents(reports.json_reports(found(spark), only, errors))
    assert set(got) == {"p", "q", "other", "unread"}
    assert got["unread"]["errors"] == ['Could not read: "z"\n'] and got["unread"]["summary"]["files_scanned"] == 0
    assert got["p"]["summary"]["files_scanned"] == 0 and len(got["p"]["findings"]) == 5
    assert set(documents(reports.sarif_documents(found(spark), only))) == {"p", "q", "other"}


@pytest.mark.parametrize("name,kind", [("out.sarif", "sarif"), ("OUT.SARIF", "sarif"), ("out.json", "json"), ("out", "json")])
def test_format_by_suffix(name, kind):
    assert reports.report_format(name) == kind


def test_round_trip_suppresses_everything(spark, tmp_path):
    path = str(tmp_path / "report.json")
    reports.write_report(found(spark), scanned(spark), path)
    again = read_parts(spark, path)
    assert again.count() == 6
    assert ops.without_known(found(spark), again).count() == 0
    counts = ops.suppressed_counts(ops.flag_known(found(spark), again)).collect()
    assert sum(r.suppressed for r in counts) == 6
    reports.write_report(found(spark), scanned(spark), str(tmp_path / "report.sarif"))
    for project in ("p", "q", "quiet"):
        files = sorted((tmp_path / "report.sarif" / f"project={project}").glob("part-*"))
        assert json.loads("".join(f.read_text() for f in files))["version"] == "2.1.0"
    reports.write_findings(found(spark), str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 6


def test_foreign_reports(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"findings": [{"vuln_class": "IDOR", "file": "v.py", "title": "T0"}, {"file": "x"}]}, indent=2))
    (tmp_path / "broken.json").write_text("{ not json")
    rows = report_findings(read_reports(spark, str(tmp_path), project="p", multi_line=True)).orderBy("file").collect()
    assert [(r.project, r.vuln_class, r.file, r.title, r.finding_id) for r in rows] == [("p", "IDOR", "v.py", "T0", ""), ("p", "", "x", "", "")]


def test_lookup_join_ways_agree(spark):
    big = spark.range(1000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id) END AS key", "id")
    small = spark.createDataFrame([("hot", 1), ("k1", 2), ("other", 3)], "key string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        wide = lookup_join(big, small, "key", how, spread=["id"])
        split = lookup_join(big, small, "key", how, spread=["id"], max_rows=1, salts=7)
        assert "Broadcast" in wide._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, wide.collect()), key=str) == sorted(map(tuple, split.collect()), key=str)
    assert at_most(small, 3) and not at_most(small, 2)
    assert shared_folder(spark)
