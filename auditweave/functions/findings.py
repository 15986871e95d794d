"""Column expressions over findings."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditweave import vocab


def _lookup(key: Column, table: dict, default) -> Column:
    pairs = [F.lit(v) for item in table.items() for v in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def severity_rank(severity: Column) -> Column:
    return _lookup(severity, vocab.SEVERITY_RANKS, 0)


def confidence_rank(confidence: Column) -> Column:
    return _lookup(confidence, vocab.CONFIDENCE_RANKS, 0)


def sarif_level(severity: Column) -> Column:
    return _lookup(severity, vocab.SARIF_LEVELS, "note")


def rule_title(vuln_class: Column) -> Column:
    return F.initcap(F.lower(F.replace(vuln_class, F.lit("_"), F.lit(" "))))


def line_bucket(line: Column) -> Column:
    """Buckets of ten lines, rounding down for negative lines too."""
    return F.floor(line / 10)


def finding_id(scope: Sequence[str] = ()) -> Column:
    """Stable id from the deduplication key, so a retried task or a later scan repeats it.

    ``scope`` names further columns of that key, such as the diff of a diff review.
    """
    key = F.concat_ws(
        "\x1f",
        *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("project", *scope, "vuln_class", "file")],
        line_bucket(F.col("line_start")).cast("string"),
        F.coalesce(F.col("title"), F.lit("")),
    )
    return F.concat(F.lit("FND-"), F.upper(F.substring(F.sha2(key, 256), 1, 16)))


def sarif_message() -> Column:
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in vocab.FINDING_TEXTS}
    return F.concat_ws(
        "\n\n",
        text["title"],
        text["description"],
        F.concat(F.lit("Impact: "), text["impact"]),
        F.concat(F.lit("Fix: "), text["fix"]),
    )


def finding_struct(id_column: str = "finding_id") -> Column:
    """One finding in the key order of the exported JSON."""
    return F.struct(
        F.col(id_column).alias("id"),
        *[F.col(f) for f in vocab.FINDING_FIELDS.fieldNames()[1:]],
    )
