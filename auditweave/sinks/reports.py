"""JSON and SARIF reports.

A document is made of ordered parts: rows ``project, part, ordinal, text`` whose texts, one after the
other, are the document. The first part opens it, then comes one part per element, the last closes it.
So a project with any number of findings has one document of one shape, and no row or task holds it
whole. :func:`document_of` joins the parts of a project that the caller names.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditweave import vocab
from auditweave.functions.findings import finding_struct, rule_title, sarif_level, sarif_message
from auditweave.operators.findings import LINEAGE, scan_summary

TOOL_NAME = "auditweave"
TOOL_VERSION = "0.1.0"
# The names SARIF 2.1.0 prescribes.
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/main/sarif-2.1/schema/sarif-schema-2.1.0.json"
SARIF_VERSION = "2.1.0"
SOURCE_ROOT = "%SRCROOT%"


def report_format(path: str) -> str:
    """``sarif`` for a .sarif file name, else ``json``."""
    return "sarif" if path.lower().endswith(".sarif") else "json"


def _keys(*tables: DataFrame) -> DataFrame:
    """Every project that any of ``tables`` names."""
    return reduce(DataFrame.union, [t.select("project") for t in tables]).distinct()


def _fixed(projects: DataFrame, part: int, text: Column) -> DataFrame:
    return projects.select("project", F.lit(part).alias("part"), F.lit(0).cast("long").alias("ordinal"), text.alias("text"))


def _elements(rows: DataFrame, part: int, json: Column, order: Sequence[str]) -> DataFrame:
    """One part per row of ``rows`` in ``order``; all but the first of a project begin with a comma.

    Rows are counted per value of the first order column, and each such group starts its numbers after
    those before it, so a project with very many rows is numbered by many tasks.
    """
    placed = rows.select("project", F.col(order[0]).alias("_first"), F.struct(*order).alias("_order"), json.alias("_json"))
    sizes = placed.groupBy("project", "_first").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("project").orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col("project").alias("_project"), F.col("_first").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    same = F.col("project").eqNullSafe(F.col("_project")) & F.col("_first").eqNullSafe(F.col("_of"))
    inside = Window.partitionBy("project", "_first").orderBy("_order")
    ordinal = (F.col("_start") + F.row_number().over(inside) - 1).cast("long")
    numbered = placed.join(starts, same).select("project", F.lit(part).alias("part"), ordinal.alias("ordinal"), "_json")
    comma = F.when(F.col("ordinal") > 0, F.lit(",")).otherwise(F.lit(""))
    return numbered.select("project", "part", "ordinal", F.concat(comma, "_json").alias("text"))


def _finding_parts(findings: DataFrame, element: Column, order: Sequence[str]) -> DataFrame:
    return _elements(findings, 1, F.to_json(element), (*order, "finding_id"))


def _parts(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def finding_arrays(findings: DataFrame, projects: DataFrame, order: Sequence[str] = LINEAGE) -> DataFrame:
    """The findings of each project as a JSON array, in parts."""
    every = _keys(projects, findings)
    return _parts(
        _fixed(every, 0, F.lit("[")), _finding_parts(findings, finding_struct(), order), _fixed(every, 2, F.lit("]")))


def json_reports(
    findings: DataFrame,
    scanned: DataFrame,
    errors: DataFrame | None = None,
    order: Sequence[str] = LINEAGE,
) -> DataFrame:
    """``{summary, findings, errors}`` per project in parts; ``scanned`` holds ``project, files_scanned``.

    Every project with scanned files, findings or errors has a document; where nothing was scanned the
    count is zero. Pass stored findings: they are read for the elements and for the summary.
    """
    every = _keys(scanned, findings, *([] if errors is None else [errors]))
    counted = every.join(scanned.select("project", "files_scanned"), "project", "left").select(
        "project", F.coalesce("files_scanned", F.lit(0)).cast("long").alias("files_scanned"))
    summary = scan_summary(findings, counted)
    counts = F.to_json(F.struct(*[c for c in summary.columns if c != "project"]))
    parts = [
        _fixed(summary, 0, F.concat(F.lit('{"summary":'), counts, F.lit(',"findings":['))),
        _finding_parts(findings, finding_struct(), order),
        _fixed(every, 2, F.lit('],"errors":[')),
        _fixed(every, 4, F.lit("]}")),
    ]
    if errors is not None:
        listed = F.to_json(F.array("error"))
        quoted = F.substring(listed, F.lit(2), F.length(listed) - 2)  # the entry without its brackets
        parts.append(_elements(errors, 3, quoted, ("error",)))
    return _parts(*parts)


def sarif_result() -> Column:
    """One finding as a SARIF result."""
    location = F.struct(
        F.struct(
            F.struct(F.col("file").alias("uri"), F.lit(SOURCE_ROOT).alias("uriBaseId")).alias("artifactLocation"),
            F.struct(F.col("line_start").alias("startLine"), F.col("line_end").alias("endLine")).alias("region"),
        ).alias("physicalLocation")
    )
    return F.struct(
        F.col("vuln_class").alias("ruleId"),
        sarif_level(F.col("severity")).alias("level"),
        F.struct(sarif_message().alias("text")).alias("message"),
        F.array(location).alias("locations"),
        F.struct(F.col("finding_id").alias(f"{TOOL_NAME}/id")).alias("fingerprints"),
        F.struct(
            F.col("vuln_class").alias(f"{TOOL_NAME}/vuln_class"),
            F.col("confidence").alias(f"{TOOL_NAME}/confidence"),
            F.col("reproduction").alias(f"{TOOL_NAME}/reproduction"),
        ).alias("properties"),
    )


def sarif_results(findings: DataFrame) -> DataFrame:
    """One JSON result per finding, for line-wise output of any size."""
    return findings.select("project", "finding_id", F.to_json(sarif_result()).alias("result"))


def _rule(vuln_class: Column) -> Column:
    return F.struct(
        vuln_class.alias("id"),
        F.struct(rule_title(vuln_class).alias("text")).alias("shortDescription"),
        F.struct(F.lit("warning").alias("level")).alias("defaultConfiguration"),
    )


def sarif_rules(findings: DataFrame, order: Sequence[str] = LINEAGE) -> DataFrame:
    """The classes of each project with their place in the order of first appearance."""
    first = findings.groupBy("project", "vuln_class").agg(F.min(F.struct(*order, "finding_id")).alias("first_seen"))
    return first.select("project", "vuln_class", rule_title(F.col("vuln_class")).alias("title"), F.lit("warning").alias("level"), "first_seen")


def sarif_documents(findings: DataFrame, projects: DataFrame, order: Sequence[str] = LINEAGE) -> DataFrame:
    """SARIF 2.1.0 documents with one run each, in parts; valid also without findings."""
    every = _keys(projects, findings)
    seen = sarif_rules(findings, order).groupBy("project").agg(
        # At most one entry per class of the vocabulary.
        F.sort_array(F.collect_list(F.struct("first_seen", "vuln_class"))).alias("_classes"))
    rules = F.transform(F.coalesce("_classes", F.array()), lambda x: _rule(x["vuln_class"]))
    rules = F.when(F.col("_classes").isNull(), F.lit("[]")).otherwise(F.to_json(rules))
    head = F.concat(
        F.lit(f'{{"$schema":"{SARIF_SCHEMA}","version":"{SARIF_VERSION}","runs":[{{"tool":{{"driver":'
              f'{{"name":"{TOOL_NAME}","version":"{TOOL_VERSION}","rules":'),
        rules, F.lit('}},"results":['),
    )
    return _parts(
        _fixed(every.join(seen, "project", "left"), 0, head),
        _finding_parts(findings, sarif_result(), order),
        _fixed(every, 2, F.lit("]}]}")),
    )


def document_of(parts: DataFrame, project: str) -> str:
    """The whole document of one project that the caller knows to be small enough for the driver."""
    rows = parts.where(F.col("project") == project).orderBy("part", "ordinal").select("text").collect()
    return "".join(r["text"] for r in rows)


def documents(parts: DataFrame) -> DataFrame:
    """``project, document``: each document in one row, for projects whose documents fit one."""
    pieces = F.sort_array(F.collect_list(F.struct("part", "ordinal", "text")))
    return parts.groupBy("project").agg(F.array_join(F.transform(pieces, lambda x: x["text"]), "").alias("document"))


def write_parts(parts: DataFrame, path: str) -> None:
    """Directories per project; their files by name, and the lines in them, are the parts in order.

    Line ends between parts are white space of the document, so the lines together are the document.
    """
    ranged = parts.repartitionByRange("project", "part", "ordinal").sortWithinPartitions("project", "part", "ordinal")
    ranged.select("project", F.col("text").alias("value")).write.mode("overwrite").partitionBy("project").text(path)


def write_report(
    findings: DataFrame,
    scanned: DataFrame,
    path: str,
    errors: DataFrame | None = None,
    order: Sequence[str] = LINEAGE,
) -> None:
    """Write reports in the format that the suffix of ``path`` names."""
    if report_format(path) == "sarif":
        write_parts(sarif_documents(findings, scanned, order), path)
    else:
        write_parts(json_reports(findings, scanned, errors, order), path)


def write_findings(findings: DataFrame, path: str) -> None:
    """All findings as Parquet, one directory per project, for any amount of them."""
    fields = [f for f in vocab.FINDING_FIELDS.fieldNames() if f != "id"]
    findings.select("project", "finding_id", *fields).write.mode("overwrite").partitionBy("project").parquet(path)
