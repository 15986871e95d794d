"""Whole reviews: projects, diffs and single findings."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditweave import vocab
from auditweave.functions import text
from auditweave.operators import findings as ops
from auditweave.operators.chunking import chunk_text
from auditweave.operators.context import rendered_contexts
from auditweave.operators.diffs import chunk_diffs, split_files
from auditweave.operators.prompts import build_prompts, explain_prompts
from auditweave.operators.responses import response_items, valid_findings
from auditweave.plans.review import DIFF_CARRY
from auditweave.sources.files import admitted, reviewable

DIFF_SCOPE = ("diff_id",)
DIFF_LINEAGE = ("file_seq", *ops.LINEAGE)


def contexts_of(snapshot: DataFrame, projects: DataFrame) -> DataFrame:
    """Rendered contexts of ``projects`` only, so that their number bounds what a join sends."""
    return rendered_contexts(snapshot.join(projects, "project", "left_semi"))


def scan_prompts(
    files: DataFrame,
    snapshot: DataFrame,
    vuln_classes: Sequence[str] | str | None = None,
    max_tokens: int = vocab.CHUNK_TOKENS,
    overlap_tokens: int = vocab.CHUNK_OVERLAP,
    max_lines: int | None = vocab.MAX_FILE_LINES,
    min_lines: int = vocab.MIN_FILE_LINES,
    counter=text.ESTIMATE,
    max_bytes: int | None = vocab.MAX_FILE_BYTES,
) -> DataFrame:
    """Prompts of all admitted, long enough files of all projects."""
    todo = reviewable(admitted(files, max_bytes), max_lines, min_lines).filter("long_enough")
    chunks = chunk_text(todo, max_tokens, overlap_tokens, counter)
    projects = files.select("project").distinct()
    return build_prompts(chunks, contexts_of(snapshot, projects), vuln_classes, size_of=projects)


def diff_prompts(
    diffs: DataFrame,
    snapshot: DataFrame,
    vuln_classes: Sequence[str] | str | None = None,
    max_tokens: int = vocab.CHUNK_TOKENS,
    overlap_tokens: int = vocab.CHUNK_OVERLAP,
    counter=text.ESTIMATE,
    extra_context=None,
) -> DataFrame:
    """Prompts of all changed files; ``diffs`` has ``project, diff_id, diff_text`` and maybe ``file_path``.

    The project travels inside ``diff_id``, so that no join has to bring it back.
    """
    keyed = diffs.withColumn("diff_id", F.struct("project", "diff_id"))
    chunks = chunk_diffs(split_files(keyed), max_tokens, overlap_tokens, counter)
    chunks = chunks.withColumn("project", F.col("diff_id.project")).withColumn("diff_id", F.col("diff_id.diff_id"))
    projects = diffs.select("project").distinct()
    return build_prompts(chunks, contexts_of(snapshot, projects), vuln_classes, extra_context, size_of=projects)


def deduplicated_of(reviewed: DataFrame, diffs: bool = False) -> DataFrame:
    """Answers to validated findings without repeats, before any threshold.

    With ``diffs`` each diff is a review of its own: findings keep ``diff_id`` and ``file_seq`` and are
    compared inside their diff only. ``reviewed`` then comes from ``replay(…, carry=DIFF_CARRY)``.
    """
    carry = DIFF_CARRY if diffs else ()
    found = valid_findings(response_items(reviewed, carry))
    return ops.deduplicate(found, DIFF_LINEAGE, DIFF_SCOPE) if diffs else ops.deduplicate(found)


def findings_of(
    reviewed: DataFrame,
    severity: str | None = vocab.DEFAULT_SEVERITY,
    confidence: str | None = vocab.DEFAULT_CONFIDENCE,
    baseline: DataFrame | None = None,
    diffs: bool = False,
) -> DataFrame:
    """Answers to final findings: validated, deduplicated, above both thresholds, not known before.

    Project scans use a confidence threshold; file, diff and watch reviews pass ``None``.
    """
    found = deduplicated_of(reviewed, diffs)
    found = ops.at_least_confidence(ops.at_least_severity(found, severity), confidence)
    return found if baseline is None else ops.without_known(found, baseline)


def explain(findings: DataFrame, wanted: DataFrame) -> DataFrame:
    """Report requests for chosen findings of a stored report."""
    return explain_prompts(ops.find_by_id(findings, wanted))
