"""Queries from answers to findings, counts and verdicts."""

import uuid

from pyspark.sql import functions as F

from auditweave.functions import findings as fx
from auditweave.operators import findings as ops
from auditweave.operators.responses import rejected_items, response_items, valid_findings
from auditweave.plans.joins import shared_folder
from auditweave.sinks import bucketed
from workload.base import query, whole
from workload.views import FINDINGS, PARSED, SQL, baseline, raw_findings, reviewed, with_views

RANK = "CASE severity WHEN 'CRITICAL' THEN 5 WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 2 WHEN 'INFO' THEN 1 ELSE 0 END"
CONF = "CASE confidence WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"
ID = (
    "'FND-' || upper(sha256(project || chr(31) || vuln_class || chr(31) || file || chr(31) "
    "|| CAST(CAST(floor(line_start / 10) AS bigint) AS string) || chr(31) || title)[1:16])"
)


def dedup_sql(source: str) -> str:
    return f"""SELECT * EXCLUDE (rn), {ID} AS finding_id FROM (
      SELECT *, row_number() OVER (PARTITION BY project, vuln_class, file, CAST(floor(line_start / 10) AS bigint), title
        ORDER BY {CONF} DESC, source_path, chunk_index, item_index) AS rn FROM {source}) WHERE rn = 1"""


SQL["deduped"] = dedup_sql("raw_findings")
DEDUP_VIEWS = (*FINDINGS, "deduped")
SQL["known_keys"] = "SELECT DISTINCT project, vuln_class, file, title FROM baseline"
SQL["flagged"] = """SELECT d.*, k.file IS NOT NULL AS known FROM deduped d
  LEFT JOIN known_keys k USING (project, vuln_class, file, title)"""
KNOWN_VIEWS = (*DEDUP_VIEWS, "baseline", "known_keys", "flagged")
COUNTS = "count(*) AS total_findings, " + ", ".join(
    f"count(*) FILTER (severity = '{s}') AS {s.lower()}" for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")
)
_COLUMNS = "project, finding_id, vuln_class, severity, confidence, file, line_start, line_end, title, description, impact, reproduction, fix"
COLUMNS = _COLUMNS.split(", ")


def deduped(spark, sf_dir):
    return ops.deduplicate(raw_findings(spark, sf_dir))


@query(
    "finding_expressions",
    with_views(
        f"""SELECT item_index, CAST({RANK} AS bigint) AS severity_rank, CAST({CONF} AS bigint) AS confidence_rank,
            CASE severity WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' ELSE 'note' END AS level,
            CASE vuln_class WHEN 'IDOR' THEN 'Idor' WHEN 'AUTH_BYPASS' THEN 'Auth Bypass' WHEN 'PRIVILEGE_ESC' THEN 'Privilege Esc'
              WHEN 'MASS_ASSIGN' THEN 'Mass Assign' WHEN 'JWT_ISSUE' THEN 'Jwt Issue' WHEN 'LOGIC_FLAW' THEN 'Logic Flaw' ELSE 'Data Exposure' END AS title,
            CAST(floor((line_start - 15) / 10) AS bigint) AS bucket, {ID} AS finding_id,
            title || chr(10) || chr(10) || description || chr(10) || chr(10) || 'Impact: ' || impact || chr(10) || chr(10) || 'Fix: ' || fix AS message
            FROM raw_findings""",
        *FINDINGS,
    ),
)
def finding_expressions(spark, sf_dir):
    rows = raw_findings(spark, sf_dir)
    return whole(rows.select(
        "item_index", fx.severity_rank(F.col("severity")).alias("severity_rank"),
        fx.confidence_rank(F.col("confidence")).alias("confidence_rank"), fx.sarif_level(F.col("severity")).alias("level"),
        fx.rule_title(F.col("vuln_class")).alias("title"), fx.line_bucket(F.col("line_start") - 15).alias("bucket"),
        fx.finding_id().alias("finding_id"), fx.sarif_message().alias("message"),
    ))


@query(
    "parsed_findings",
    with_views(
        """SELECT project, source_path, CAST(chunk_index AS bigint) AS chunk_index, CAST(item_index AS bigint) AS item_index, vuln_class,
           severity, confidence, file, line_start, line_end, title, description, impact, reproduction, fix FROM parsed""",
        *PARSED,
    ),
)
def parsed_findings(spark, sf_dir):
    return whole(valid_findings(response_items(reviewed(spark, sf_dir))))


@query(
    "rejected_items",
    with_views(
        """SELECT project, source_path, chunk_index, CAST(item_pos AS bigint) AS item_index, kind AS reason FROM answer_items
           WHERE answer NOT IN ('cut', 'object')
             AND kind IN ('bad_severity', 'bad_line', 'missing_key', 'bad_class', 'bad_confidence', 'not_object')
           UNION ALL
           SELECT project, source_path, chunk_index, NULL, CASE answer WHEN 'cut' THEN 'not_json' ELSE 'not_array' END FROM answer_items
           WHERE answer IN ('cut', 'object') GROUP BY project, source_path, chunk_index, answer""",
        *PARSED,
    ),
)
def rejects(spark, sf_dir):
    return whole(rejected_items(response_items(reviewed(spark, sf_dir))))


@query("deduplicated", with_views(f"SELECT {_COLUMNS} FROM deduped", *DEDUP_VIEWS))
def deduplicated(spark, sf_dir):
    return deduped(spark, sf_dir).select(*COLUMNS)


@query(
    "severe_findings",
    with_views(f"SELECT finding_id, severity FROM deduped WHERE {RANK} >= 4", *DEDUP_VIEWS),
)
def severe_findings(spark, sf_dir):
    return ops.at_least_severity(deduped(spark, sf_dir), "HIGH").select("finding_id", "severity")


@query(
    "confident_findings",
    with_views(f"SELECT finding_id, confidence FROM deduped WHERE {RANK} >= 2 AND {CONF} >= 2", *DEDUP_VIEWS),
)
def confident_findings(spark, sf_dir):
    found = ops.at_least_severity(deduped(spark, sf_dir), "LOW")
    return ops.at_least_confidence(found, "MEDIUM").select("finding_id", "confidence")


@query("new_findings", with_views(f"SELECT {_COLUMNS} FROM flagged WHERE NOT known", *KNOWN_VIEWS))
def new_findings(spark, sf_dir):
    return ops.without_known(deduped(spark, sf_dir), baseline(spark, sf_dir)).select(*COLUMNS)


@query("stored_baseline", with_views(f"SELECT {_COLUMNS}, known FROM flagged", *KNOWN_VIEWS))
def stored_baseline(spark, sf_dir):
    """The baseline as a table in buckets, of which the findings read what they meet."""
    path = f"{shared_folder(spark)}/baseline-{uuid.uuid4().hex}"
    earlier = baseline(spark, sf_dir)
    bucketed.write_baseline(earlier.where("severity = 'HIGH'"), path)
    bucketed.add_to_baseline(earlier, path)
    found = deduped(spark, sf_dir)
    return ops.flag_known(found, bucketed.baseline_for(found, path)).select(*COLUMNS, "known")


@query(
    "suppressed_counts",
    with_views(
        "SELECT project, count(*) FILTER (known) AS suppressed, count(*) FILTER (NOT known) AS remaining FROM flagged GROUP BY project",
        *KNOWN_VIEWS,
    ),
)
def suppressed_counts(spark, sf_dir):
    return ops.suppressed_counts(ops.flag_known(deduped(spark, sf_dir), baseline(spark, sf_dir)))


@query("severity_summary", with_views(f"SELECT project, {COUNTS} FROM deduped GROUP BY project", *DEDUP_VIEWS))
def severity_summary(spark, sf_dir):
    return ops.severity_summary(deduped(spark, sf_dir))


@query("class_summary", with_views(f"SELECT project, vuln_class, {COUNTS} FROM deduped GROUP BY project, vuln_class", *DEDUP_VIEWS))
def class_summary(spark, sf_dir):
    return ops.severity_summary(deduped(spark, sf_dir), by=("project", "vuln_class"))


@query(
    "scan_summary",
    with_views(
        f"""SELECT project, files_scanned, coalesce(total_findings, 0) AS total_findings, coalesce(critical, 0) AS critical,
            coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, coalesce(info, 0) AS info
            FROM (SELECT project, count(DISTINCT file) AS files_scanned FROM raw_findings GROUP BY project)
            LEFT JOIN (SELECT project, {COUNTS} FROM flagged WHERE NOT known AND {RANK} >= 4 GROUP BY project) USING (project)""",
        *KNOWN_VIEWS,
    ),
)
def scan_summary(spark, sf_dir):
    found = ops.at_least_severity(deduped(spark, sf_dir), "HIGH")
    scanned = ops.files_with_findings(raw_findings(spark, sf_dir))
    return ops.scan_summary(ops.without_known(found, baseline(spark, sf_dir)), scanned)


@query(
    "gate",
    with_views(
        f"""SELECT project, count(*) FILTER (n) AS blocking, count(*) FILTER (n) > 0 AS blocked FROM (
            SELECT project, {RANK} >= 5 AND NOT known AND confidence = 'HIGH' AS n FROM flagged) GROUP BY project""",
        *KNOWN_VIEWS,
    ),
)
def gate(spark, sf_dir):
    found = deduped(spark, sf_dir)
    fresh = ops.at_least_confidence(ops.without_known(found, baseline(spark, sf_dir)), "HIGH")
    return ops.gate(fresh, found, "CRITICAL")


@query(
    "hook_gate",
    with_views(f"SELECT project, count(*) AS blocking, true AS blocked FROM deduped WHERE {RANK} >= 4 GROUP BY project", *DEDUP_VIEWS),
)
def hook_gate(spark, sf_dir):
    return ops.hook_gate(deduped(spark, sf_dir), threshold="SEVERE")


@query(
    "finding_lookup",
    with_views(
        f"SELECT {_COLUMNS} FROM deduped WHERE finding_id IN (SELECT {ID} FROM baseline)", *DEDUP_VIEWS, "baseline"
    ),
)
def finding_lookup(spark, sf_dir):
    """The current findings with the ids of the earlier report."""
    wanted = baseline(spark, sf_dir).select(fx.finding_id().alias("finding_id"))
    return ops.find_by_id(deduped(spark, sf_dir), wanted).select(*COLUMNS)


@query(
    "file_results",
    with_views(f"SELECT project, file, {COUNTS} FROM deduped WHERE {RANK} >= 3 GROUP BY project, file", *DEDUP_VIEWS),
)
def file_results(spark, sf_dir):
    return ops.file_results(deduped(spark, sf_dir), threshold="MEDIUM")


@query(
    "severity_cube",
    with_views(
        f"""SELECT project, file, vuln_class, CAST(grouping(project, file, vuln_class) AS bigint) AS grouping, {COUNTS} FROM deduped
        GROUP BY GROUPING SETS ((project, file, vuln_class), (project, file), (project, vuln_class), (project), (vuln_class), ())""",
        *DEDUP_VIEWS,
    ),
)
def severity_cube(spark, sf_dir):
    sets = (("project", "file", "vuln_class"), ("project", "file"), ("project", "vuln_class"), ("project",), ("vuln_class",), ())
    return ops.severity_cube(deduped(spark, sf_dir), sets, ("project", "file", "vuln_class"))
