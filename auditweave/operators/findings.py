"""Deduplication, thresholds, baseline, counts and verdicts over findings."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditweave import vocab
from auditweave.functions.findings import confidence_rank, finding_id, line_bucket, severity_rank

LINEAGE = ("source_path", "chunk_index", "item_index")
BASELINE_KEYS = ("project", "vuln_class", "file", "title")


def deduplicate(findings: DataFrame, order: Sequence[str] = LINEAGE, scope: Sequence[str] = ()) -> DataFrame:
    """One finding per class, file, bucket of ten lines and title, with a stable ``finding_id``.

    ``scope`` names columns inside which findings are compared, ``("diff_id",)`` where each diff is a
    review of its own. The highest confidence wins, then the first in ``order``. The rank filter keeps one row per
    key in each input partition before the shuffle, so a key with many copies does no harm.
    """
    keyed = findings.withColumn("_bucket", line_bucket(F.col("line_start")))
    best = Window.partitionBy("project", *scope, "vuln_class", "file", "_bucket", "title").orderBy(
        confidence_rank(F.col("confidence")).desc(), *order
    )
    first = keyed.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") == 1)
    return first.withColumn("finding_id", finding_id(scope)).drop("_bucket", "_rank")


def _known(name: str, ranks: dict) -> int:
    if name not in ranks:
        raise ValueError(f"unknown threshold {name!r}, expected one of {', '.join(ranks)}")
    return ranks[name]


def at_least_severity(findings: DataFrame, threshold: str | None) -> DataFrame:
    """Apply after :func:`deduplicate`: a confident minor duplicate may replace a severe one."""
    if threshold is None:
        return findings
    return findings.filter(severity_rank(F.col("severity")) >= _known(threshold, vocab.SEVERITY_RANKS))


def at_least_confidence(findings: DataFrame, threshold: str | None) -> DataFrame:
    if threshold is None:
        return findings
    return findings.filter(confidence_rank(F.col("confidence")) >= _known(threshold, vocab.CONFIDENCE_RANKS))


def flag_known(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Mark findings whose class, file and title a baseline of the same project contains.

    The baseline may be as large as the findings, so the join is left to Catalyst, which
    broadcasts it only below its size limit and splits skewed keys otherwise.
    """
    marks = baseline.select(
        *[F.coalesce(k, F.lit("")).alias(f"_b_{k}") for k in BASELINE_KEYS]
    ).distinct().withColumn("_hit", F.lit(True))
    same = [F.coalesce(k, F.lit("")) == F.col(f"_b_{k}") for k in BASELINE_KEYS]
    joined = findings.join(marks, same, "left")
    return joined.withColumn("known", F.col("_hit").isNotNull()).drop("_hit", *[f"_b_{k}" for k in BASELINE_KEYS])


def without_known(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings that are new against the baseline."""
    marks = baseline.select(*[F.coalesce(k, F.lit("")).alias(f"_b_{k}") for k in BASELINE_KEYS])
    same = [F.coalesce(k, F.lit("")) == F.col(f"_b_{k}") for k in BASELINE_KEYS]
    return findings.join(marks.distinct(), same, "left_anti")


def suppressed_counts(flagged: DataFrame, by: Sequence[str] = ("project",)) -> DataFrame:
    return flagged.groupBy(*by).agg(
        F.count_if("known").alias("suppressed"), F.count_if(~F.col("known")).alias("remaining")
    )


def severity_summary(findings: DataFrame, by: Sequence[str] = ("project",)) -> DataFrame:
    """Total and one count per severity, zeros included."""
    return findings.groupBy(*by).agg(
        F.count("*").alias("total_findings"),
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in vocab.SEVERITY_RANKS],
    )


def scan_summary(findings: DataFrame, scanned: DataFrame) -> DataFrame:
    """One summary row per scanned project, also where nothing was found."""
    counts = ("total_findings", *[s.lower() for s in vocab.SEVERITY_RANKS])
    joined = scanned.join(severity_summary(findings), "project", "left")
    return joined.select(
        "project", "files_scanned", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts]
    )


def files_scanned(files: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Admitted files per project less those with a read error; short files count.

    Counts paths, so the contents are not read for it.
    """
    counted = files.groupBy("project").agg(F.count("*").alias("files_scanned"))
    if errors is None:
        return counted
    failed = errors.groupBy("project").agg(F.count("*").alias("_failed"))
    left = F.col("files_scanned") - F.coalesce("_failed", F.lit(0))
    return counted.join(failed, "project", "left").select("project", left.alias("files_scanned"))


def files_with_findings(findings: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Files scanned as a diff review counts them: distinct files before the severity filter."""
    return findings.groupBy("project", *scope).agg(F.count_distinct("file").alias("files_scanned"))


def gate(
    findings: DataFrame, projects: DataFrame | None = None, threshold: str | None = None, scope: Sequence[str] = ()
) -> DataFrame:
    """Verdict per project (and ``scope``, such as a diff): blocked if any finding (of at least ``threshold``) remains."""
    keys = ["project", *scope]
    counted = at_least_severity(findings, threshold).groupBy(*keys).agg(F.count("*").alias("blocking"))
    if projects is not None:
        counted = projects.select(*keys).distinct().join(counted, keys, "left")
    blocking = F.coalesce("blocking", F.lit(0).cast("long"))
    return counted.select(*keys, blocking.alias("blocking"), (blocking > 0).alias("blocked"))


def hook_gate(findings: DataFrame, projects: DataFrame | None = None, threshold: str = vocab.DEFAULT_GATE) -> DataFrame:
    """The verdict before a commit; an unknown threshold counts as HIGH."""
    known = threshold if threshold in vocab.SEVERITY_RANKS else vocab.DEFAULT_GATE
    return gate(findings, projects, known)


def find_by_id(findings: DataFrame, wanted: DataFrame) -> DataFrame:
    """Findings with the ids in ``wanted(finding_id)``; they keep these ids."""
    return findings.join(wanted.select("finding_id").distinct(), "finding_id", "left_semi")


def available_ids(findings: DataFrame) -> DataFrame:
    return findings.select("project", "finding_id", "title")


def file_results(findings: DataFrame, files: DataFrame | None = None, threshold: str | None = None) -> DataFrame:
    """Findings per file; with ``files`` also those without any."""
    shown = severity_summary(at_least_severity(findings, threshold), by=("project", "file"))
    if files is None:
        return shown
    names = files.select("project", F.col("path").alias("file"))
    joined = names.join(shown, ["project", "file"], "left")
    counts = [c for c in shown.columns if c not in ("project", "file")]
    return joined.select("project", "file", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts])


def severity_cube(findings: DataFrame, sets: Sequence[Sequence[str]], keys: Sequence[str]) -> DataFrame:
    """The counts of :func:`severity_summary` for several sets of ``keys`` in one pass and one exchange.

    A key that a set leaves out is null; ``grouping`` is the number whose bits, first key highest, are 1
    for the keys left out, so a null that stands in the data is told apart. An empty set gives the total.
    """
    counts = [F.count_if(F.col("severity") == s).alias(s.lower()) for s in vocab.SEVERITY_RANKS]
    columns = [F.col(k) for k in keys]
    grouped = findings.groupingSets([[F.col(k) for k in chosen] for chosen in sets], *columns)
    return grouped.agg(F.grouping_id().alias("grouping"), F.count("*").alias("total_findings"), *counts)
