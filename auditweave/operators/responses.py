"""From raw answers to validated findings and rejected items."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditweave import vocab
from auditweave.functions import text

FENCE = "```"
REQUIRED_TEXTS = ("title", "description", "impact", "reproduction", "fix")


def json_part(response: Column) -> Column:
    """The part of an answer that should be a JSON array: no fence lines, no prose around it."""

    def unfenced(cleaned: Column) -> Column:
        lines = F.filter(F.split(cleaned, "\n", -1), lambda l: ~text.strip(l).startswith(FENCE))
        return F.when(cleaned.startswith(FENCE), F.array_join(lines, "\n")).otherwise(cleaned)

    def sliced(body: Column) -> Column:
        first = F.instr(body, "[")
        last = F.length(body) - F.length(F.substring_index(body, "]", -1))
        found = (first > 0) & (last > first)
        return F.when(found, F.substring(body, first, last - first + 1)).otherwise(body)

    return text.bind(text.bind(text.strip(response), unfenced), sliced)


_KEYS = ("vuln_class", "severity", "confidence", "line_start", "line_end", *REQUIRED_TEXTS)
_FIELDS = "struct<" + ", ".join(f"{k}: variant" for k in (*_KEYS, "file")) + ">"


def _get(key: str, kind: str) -> Column:
    return F.try_variant_get(f"_fields.{key}", "$", kind)


def response_items(responses: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Every array element of every answer with its fields and, where invalid, a ``reason``.

    Takes ``project, file_path, chunk_index, line_start, response``; the columns in ``carry``, such as
    ``diff_id``, travel with every item. Answers that are no JSON
    array give one row without an item; empty arrays give none.
    """
    keys = ("project", *carry, "file_path", "chunk_index", "line_start")
    parsed = responses.select(
        *[F.col(k) if k != "line_start" else F.col(k).alias("_chunk_start") for k in keys],
        F.try_parse_json(json_part(F.col("response"))).alias("_json"),
    )
    # One pass per item: an absent key gives null, a JSON null does not; no object gives no fields.
    items = F.transform(
        F.try_variant_get("_json", "$", "array<variant>"), lambda item: F.try_variant_get(item, "$", _FIELDS)
    )
    listed = parsed.withColumn("_items", items)
    rows = listed.select(
        "project", *carry, F.col("file_path").alias("source_path"), "chunk_index", "_chunk_start",
        F.when(F.col("_json").isNull(), F.lit("not_json")).when(F.col("_items").isNull(), F.lit("not_array")).alias("_broken"),
        F.posexplode_outer("_items").alias("item_index", "_fields"),
    )
    # Empty arrays leave no trace. Said after the explosion, lest the answer be parsed for it again.
    rows = rows.filter(F.col("item_index").isNotNull() | F.col("_broken").isNotNull())
    present = F.lit(True)
    for key in _KEYS:
        present = present & F.col(f"_fields.{key}").isNotNull()
    # A missing or empty file (also 0, false, [] and {}) means the file of the chunk.
    named = _get("file", "string")
    file = F.when(named.isNull() | named.isin("", "0", "0.0", "false", "[]", "{}"), F.col("source_path")).otherwise(named)
    shift = F.when(F.col("_chunk_start") > 1, F.col("_chunk_start") - 1).otherwise(F.lit(0)).cast("long")
    fields = rows.select(
        "project", *carry, "source_path", "chunk_index", "item_index", "_broken",
        F.col("_fields").isNotNull().alias("_object"),
        F.coalesce(present, F.lit(False)).alias("_present"),
        *[_get(k, "string").alias(k) for k in ("vuln_class", "severity", "confidence")],
        file.alias("file"),
        *[(_get(k, "int").cast("long") + shift).alias(k) for k in ("line_start", "line_end")],
        *[_get(k, "string").alias(k) for k in REQUIRED_TEXTS],
    )

    def outside(column: str, accepted) -> Column:
        return ~F.coalesce(F.col(column).isin(*accepted), F.lit(False))

    reason = (
        F.when(F.col("_broken").isNotNull(), F.col("_broken"))
        .when(~F.col("_object"), F.lit("not_object"))
        .when(~F.col("_present"), F.lit("missing_key"))
        .when(outside("vuln_class", vocab.ACCEPTED_CLASSES), F.lit("bad_class"))
        .when(outside("severity", vocab.SEVERITY_RANKS), F.lit("bad_severity"))
        .when(outside("confidence", vocab.CONFIDENCE_RANKS), F.lit("bad_confidence"))
        .when(F.col("line_start").isNull() | F.col("line_end").isNull(), F.lit("bad_line"))
    )
    return fields.withColumn("reason", reason).drop("_broken", "_object", "_present")


def valid_findings(items: DataFrame) -> DataFrame:
    return items.filter(F.col("reason").isNull()).drop("reason")


def rejected_items(items: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    return items.filter(F.col("reason").isNotNull()).select(
        "project", *carry, "source_path", "chunk_index", "item_index", "reason"
    )
