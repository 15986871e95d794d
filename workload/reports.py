"""Queries over the parts of reports, and a report that is committed and read back."""

import uuid

from pyspark.sql import functions as F

from auditweave.functions import findings as fx
from auditweave.plans.joins import shared_folder
from auditweave.sinks import committed, lookup, reports
from workload.base import ORACLES, query, whole
from workload.findings import COLUMNS, deduped
from workload.outputs import _OBJECT, _ORDER, _RESULT, _TITLE, REPORT_VIEWS, scanned, severe
from workload.views import SQL, baseline, raw_findings, with_views


def _elements(part: int, element: str, source: str, order: str) -> str:
    return f"""SELECT project, CAST({part} AS bigint) AS part, n - 1 AS ordinal, CASE WHEN n > 1 THEN ',' ELSE '' END || piece AS text
      FROM (SELECT project, {element} AS piece, row_number() OVER (PARTITION BY project {order}) AS n FROM {source})"""


def _fixed(part: int, text: str, source: str = "scanned") -> str:
    return f"SELECT project, CAST({part} AS bigint) AS part, CAST(0 AS bigint) AS ordinal, {text} AS text FROM {source}"


SQL["report_counts"] = """SELECT s.project, any_value(files_scanned) AS files_scanned, count(d.finding_id) AS t,
  count(d.finding_id) FILTER (severity = 'CRITICAL') AS c, count(d.finding_id) FILTER (severity = 'HIGH') AS h
  FROM scanned s LEFT JOIN severe d USING (project) GROUP BY s.project"""
_SUMMARY = (
    "CAST(to_json({'files_scanned': files_scanned, 'total_findings': t, 'critical': c, 'high': h, "
    "'medium': 0, 'low': 0, 'info': 0}) AS varchar)"
)
JSON_PARTS = " UNION ALL ".join((
    _fixed(0, f"""'{{"summary":' || {_SUMMARY} || ',"findings":['""", "report_counts"),
    _elements(1, f"CAST(to_json({_OBJECT}) AS varchar)", "severe", _ORDER),
    _fixed(2, """'],"errors":['"""),
    _elements(3, "CAST(to_json(error) AS varchar)", "error_rows", "ORDER BY error"),
    _fixed(4, "']}'"),
))
SQL["json_parts"] = JSON_PARTS
SQL["rule_lists"] = f"""SELECT s.project, coalesce(any_value(rules), '[]') AS rules FROM scanned s LEFT JOIN (
    SELECT project, CAST(to_json(list({{'id': vuln_class, 'shortDescription': {{'text': {_TITLE}}},
      'defaultConfiguration': {{'level': 'warning'}}}} ORDER BY seq)) AS varchar) AS rules
    FROM (SELECT project, vuln_class, min(seq) AS seq FROM (
      SELECT project, vuln_class, row_number() OVER (PARTITION BY project {_ORDER}) AS seq FROM severe) GROUP BY project, vuln_class)
    GROUP BY project) USING (project) GROUP BY s.project"""
_HEAD = (
    f"""'{{"$schema":"{reports.SARIF_SCHEMA}","version":"2.1.0","runs":[{{"tool":{{"driver":"""
    """{"name":"auditweave","version":"0.1.0","rules":' || rules || '}},"results":['"""
)
SARIF_PARTS = " UNION ALL ".join((
    _fixed(0, _HEAD, "rule_lists"),
    _elements(1, f"CAST(to_json({_RESULT}) AS varchar)", "severe", _ORDER),
    _fixed(2, "']}]}'"),
))
ARRAY_PARTS = " UNION ALL ".join((
    _fixed(0, "'['"), _elements(1, f"CAST(to_json({_OBJECT}) AS varchar)", "severe", _ORDER), _fixed(2, "']'")))


def errors(spark, sf_dir):
    """One error per file that has an answer, as if none could be read."""
    return raw_findings(spark, sf_dir).select("project", F.concat(F.lit("Could not read: "), F.col("file")).alias("error")).distinct()


def _parts(rows):
    return rows.select("project", F.col("part").cast("long").alias("part"), "ordinal", "text")


@query("json_report_parts", with_views("SELECT * FROM json_parts", *REPORT_VIEWS, "error_rows", "report_counts", "json_parts"))
def json_report_parts(spark, sf_dir):
    return _parts(reports.json_reports(severe(spark, sf_dir), scanned(spark, sf_dir), errors(spark, sf_dir)))


@query("sarif_parts", with_views(SARIF_PARTS, *REPORT_VIEWS, "rule_lists"))
def sarif_parts(spark, sf_dir):
    return _parts(reports.sarif_documents(severe(spark, sf_dir), scanned(spark, sf_dir)))


@query("finding_array_parts", with_views(ARRAY_PARTS, *REPORT_VIEWS))
def finding_array_parts(spark, sf_dir):
    return _parts(reports.finding_arrays(severe(spark, sf_dir), scanned(spark, sf_dir)))


@query("committed_reports", with_views("SELECT project, text FROM json_parts", *REPORT_VIEWS, "error_rows", "report_counts", "json_parts"))
def committed_reports(spark, sf_dir):
    """Reports written by the committing sink, read back from what its commit names."""
    path = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    committed.write_committed(json_report_parts(spark, sf_dir), path)
    return committed.committed_lines(spark, path).select("project", "text")


@query("table_lookup", ORACLES["finding_lookup"])
def table_lookup(spark, sf_dir):
    """``finding_lookup`` in a stored table that is laid out by ids."""
    path = f"{shared_folder(spark)}/lookup-{uuid.uuid4().hex}"
    lookup.write_lookup_table(deduped(spark, sf_dir), path)
    wanted = baseline(spark, sf_dir).select(fx.finding_id().alias("finding_id"))
    return whole(lookup.find_in_table(spark, path, wanted), *COLUMNS)
