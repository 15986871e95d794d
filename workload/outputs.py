"""Queries over reports and change events."""

from pyspark.sql import functions as F

from auditweave import vocab
from auditweave.operators import findings as ops
from auditweave.sinks import reports
from auditweave.sources.reports import report_findings
from auditweave.streaming import watch
from workload.base import query, whole
from workload.findings import DEDUP_VIEWS, ID, RANK, deduped
from workload.views import FINDINGS, SQL, changes, raw_findings, with_views

_FIELDS = ("vuln_class", "severity", "confidence", "file", "line_start", "line_end", "title", "description", "impact", "reproduction", "fix")
_OBJECT = "{'id': finding_id, " + ", ".join(f"'{c}': {c}" for c in _FIELDS) + "}"
_ORDER = "ORDER BY source_path, chunk_index, item_index"
_LEVEL = "CASE severity WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' ELSE 'note' END"
_MESSAGE = "title || chr(10) || chr(10) || description || chr(10) || chr(10) || 'Impact: ' || impact || chr(10) || chr(10) || 'Fix: ' || fix"
_RESULT = (
    f"{{'ruleId': vuln_class, 'level': {_LEVEL}, 'message': {{'text': {_MESSAGE}}}, 'locations': [{{'physicalLocation': "
    "{'artifactLocation': {'uri': file, 'uriBaseId': '%SRCROOT%'}, 'region': {'startLine': line_start, 'endLine': line_end}}}], "
    "'fingerprints': {'auditweave/id': finding_id}, 'properties': {'auditweave/vuln_class': vuln_class, "
    "'auditweave/confidence': confidence, 'auditweave/reproduction': reproduction}}"
)
_TITLE = (
    "CASE vuln_class WHEN 'IDOR' THEN 'Idor' WHEN 'AUTH_BYPASS' THEN 'Auth Bypass' WHEN 'PRIVILEGE_ESC' THEN 'Privilege Esc' "
    "WHEN 'MASS_ASSIGN' THEN 'Mass Assign' WHEN 'JWT_ISSUE' THEN 'Jwt Issue' WHEN 'LOGIC_FLAW' THEN 'Logic Flaw' ELSE 'Data Exposure' END"
)
SQL["severe"] = f"SELECT * FROM deduped WHERE {RANK} >= 4"
SQL["scanned"] = "SELECT project, count(DISTINCT file) AS files_scanned FROM raw_findings GROUP BY project"
SQL["error_rows"] = "SELECT project, 'Could not read: ' || file AS error FROM raw_findings GROUP BY project, file"
REPORT_VIEWS = (*DEDUP_VIEWS, "severe", "scanned")


def severe(spark, sf_dir):
    return ops.at_least_severity(deduped(spark, sf_dir), "HIGH")


def scanned(spark, sf_dir):
    return ops.files_with_findings(raw_findings(spark, sf_dir))


@query(
    "json_reports",
    with_views(
        f"""SELECT project, CAST(to_json({{'summary': {{'files_scanned': files_scanned, 'total_findings': t, 'critical': c,
              'high': h, 'medium': 0, 'low': 0, 'info': 0}}, 'findings': f, 'errors': e}}) AS varchar) AS document
            FROM scanned JOIN (SELECT project, count(*) AS t, count(*) FILTER (severity = 'CRITICAL') AS c,
                               count(*) FILTER (severity = 'HIGH') AS h, list({_OBJECT} {_ORDER}) AS f FROM severe GROUP BY project) USING (project)
            JOIN (SELECT project, list(error ORDER BY error) AS e FROM error_rows GROUP BY project) USING (project)""",
        *REPORT_VIEWS, "error_rows",
    ),
)
def json_reports(spark, sf_dir):
    errors = raw_findings(spark, sf_dir).select(
        "project", F.concat(F.lit("Could not read: "), F.col("file")).alias("error")
    ).distinct()
    return reports.documents(reports.json_reports(severe(spark, sf_dir), scanned(spark, sf_dir), errors))


@query(
    "finding_arrays",
    with_views(
        f"""SELECT project, CAST(to_json(list({_OBJECT} {_ORDER})) AS varchar) AS document
            FROM severe GROUP BY project""",
        *REPORT_VIEWS,
    ),
)
def finding_arrays(spark, sf_dir):
    return reports.documents(reports.finding_arrays(severe(spark, sf_dir), scanned(spark, sf_dir)))


@query("report_round_trip", with_views(f"SELECT project, finding_id, {', '.join(_FIELDS)} FROM severe", *REPORT_VIEWS))
def report_round_trip(spark, sf_dir):
    """Findings to a report and, read as an earlier report, back to findings."""
    whole_reports = reports.documents(reports.json_reports(severe(spark, sf_dir), scanned(spark, sf_dir)))
    again = whole_reports.select("project", F.from_json("document", vocab.REPORT).alias("r")).select("project", "r.*")
    return whole(report_findings(again).select("project", "finding_id", *_FIELDS))


@query(
    "sarif_results",
    with_views(f"SELECT project, finding_id, CAST(to_json({_RESULT}) AS varchar) AS result FROM deduped", *DEDUP_VIEWS),
)
def sarif_results(spark, sf_dir):
    return reports.sarif_results(deduped(spark, sf_dir))


@query(
    "sarif_rules",
    with_views(
        f"""SELECT project, vuln_class, {_TITLE} AS title, 'warning' AS level, arg_min(finding_id, item_index) AS first_finding
            FROM (SELECT * REPLACE (source_path || chr(31) || lpad(CAST(chunk_index AS string), 9, '0') || chr(31)
                  || lpad(CAST(item_index AS string), 12, '0') AS item_index) FROM severe) GROUP BY project, vuln_class""",
        *REPORT_VIEWS,
    ),
)
def sarif_rules(spark, sf_dir):
    rules = reports.sarif_rules(severe(spark, sf_dir))
    return rules.select("project", "vuln_class", "title", "level", F.col("first_seen.finding_id").alias("first_finding"))


@query(
    "sarif_documents",
    with_views(
        f"""SELECT project, CAST(to_json({{
              '$schema': 'https://raw.githubusercontent.com/oasis-tcs/sarif-spec/main/sarif-2.1/schema/sarif-schema-2.1.0.json',
              'version': '2.1.0', 'runs': [{{'tool': {{'driver': {{'name': 'auditweave', 'version': '0.1.0', 'rules': rules}}}}, 'results': results}}]}})
              AS varchar) AS document
            FROM (SELECT project, list({_RESULT} {_ORDER}) AS results FROM severe GROUP BY project)
            JOIN (SELECT project, list({{'id': vuln_class, 'shortDescription': {{'text': {_TITLE}}}, 'defaultConfiguration': {{'level': 'warning'}}}}
                    ORDER BY seq) AS rules
                  FROM (SELECT project, vuln_class, min(seq) AS seq FROM (
                          SELECT project, vuln_class, row_number() OVER (PARTITION BY project {_ORDER}) AS seq FROM severe)
                        GROUP BY project, vuln_class) GROUP BY project) USING (project)""",
        *REPORT_VIEWS,
    ),
)
def sarif_documents(spark, sf_dir):
    return reports.documents(reports.sarif_documents(severe(spark, sf_dir), scanned(spark, sf_dir)))


# --- change events -------------------------------------------------------------------------------

_ADMITTED = "kind IN ('modified', 'created') AND NOT is_directory AND size_bytes >= 50 AND path LIKE '%.py'"
SQL["admitted_changes"] = f"SELECT * FROM changes WHERE {_ADMITTED}"
QUIET_HOURS = 6
SQL["runs"] = f"""
  SELECT project, path, min(ts) AS first_change, max(ts) AS last_change,
         max(ts) + INTERVAL {QUIET_HOURS} HOUR AS fires_at, count(*) AS changes FROM (
    SELECT *, sum(opens) OVER (PARTITION BY project, path ORDER BY ts) AS run FROM (
      SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY project, path ORDER BY ts) <= INTERVAL {QUIET_HOURS} HOUR
                     THEN 0 ELSE 1 END AS opens FROM admitted_changes)) GROUP BY project, path, run"""
RUN_VIEWS = ("changes", "admitted_changes", "runs")


@query("admitted_changes", with_views("SELECT * FROM admitted_changes", "changes", "admitted_changes"))
def admitted_changes(spark, sf_dir):
    return watch.admitted_changes(changes(spark, sf_dir))


@query("debounced_changes", with_views("SELECT * FROM runs", *RUN_VIEWS))
def debounced_changes(spark, sf_dir):
    return watch.debounce(watch.admitted_changes(changes(spark, sf_dir)), f"{QUIET_HOURS} hours")


@query("debounced_history", with_views("SELECT * FROM runs", *RUN_VIEWS))
def debounced_history(spark, sf_dir):
    return watch.debounce_history(watch.admitted_changes(changes(spark, sf_dir)), QUIET_HOURS * 3_600_000)


@query(
    "missed_changes",
    with_views(
        """SELECT DISTINCT project, path, ts FROM admitted_changes c WHERE ts < (SELECT max(ts) FROM admitted_changes) - INTERVAL 3 DAY
           AND NOT EXISTS (SELECT 1 FROM runs r WHERE minute(r.first_change) % 10 <> 3 AND r.project = c.project AND r.path = c.path
             AND c.ts BETWEEN r.first_change AND r.last_change)""",
        *RUN_VIEWS,
    ),
)
def missed_changes(spark, sf_dir):
    """Changes of runs that never fired."""
    log = watch.admitted_changes(changes(spark, sf_dir))
    runs = watch.debounce_history(log, QUIET_HOURS * 3_600_000)
    return watch.missed_changes(log, runs.where(F.minute("first_change") % 10 != 3), "3 days", "12 hours")


@query(
    "watch_totals",
    with_views(
        """SELECT project, coalesce(files_scanned, 0) AS files_scanned, coalesce(findings, 0) AS findings
           FROM (SELECT project, count(*) AS files_scanned FROM runs GROUP BY project)
           FULL JOIN (SELECT project, count(*) AS findings FROM deduped GROUP BY project) USING (project)""",
        *RUN_VIEWS, *DEDUP_VIEWS,
    ),
)
def watch_totals(spark, sf_dir):
    fired = debounced_history(spark, sf_dir)
    scans = fired.groupBy("project").agg(F.count("*").alias("files_scanned"))
    return watch.watch_totals(scans, deduped(spark, sf_dir))
