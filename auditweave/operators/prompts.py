"""Review and explanation prompts."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditweave.catalogues import HINTS, hint_texts
from auditweave.functions import text
from auditweave.functions.findings import finding_struct
from auditweave.plans.joins import lookup_join

# A context has at most about 8,000 characters, so this many stay below 200 MB.
MAX_BROADCAST_CONTEXTS = 5_000

SYSTEM_PROMPT = (
    "You review source code for exploitable security defects in its logic. Ignore style, speed and\n"
    "good practice. Work out who can reach the code, which data it touches, where permission is\n"
    "tested and how a caller could get round the test. Report only defects with a practical attack.\n"
    "Answer with a JSON array and nothing else; an empty array means no defect. Each element has the\n"
    "keys id, vuln_class (IDOR, AUTH_BYPASS, PRIVILEGE_ESC, MASS_ASSIGN, JWT_ISSUE, LOGIC_FLAW or\n"
    "DATA_EXPOSURE), severity (CRITICAL, HIGH, MEDIUM, LOW or INFO), confidence (HIGH, MEDIUM or LOW),\n"
    "file, line_start, line_end, title, description, impact, reproduction and fix."
)
EXPLAIN_SYSTEM_PROMPT = (
    "A code review has confirmed a defect. Turn it into a document that a team can act on without asking\n"
    "back: every claim names the code or the request that supports it, and open questions are said to be\n"
    "open. Format: markdown."
)
OUTPUT_RULE = (
    "Answer with a JSON array of findings only, without prose or code fences; [] if there are none.\n"
    "Every finding has the keys named in the system prompt."
)
# Section titles of the prompts.
GUIDANCE_TITLE = "=== VULNERABILITY ANALYSIS GUIDANCE ==="
OUTPUT_TITLE = "=== OUTPUT INSTRUCTION ==="
EXPLAIN_SECTIONS = {
    "Executive Summary": "Who is affected, how bad it is and what has to happen by when; no terms of the trade.",
    "Technical Analysis": "The lines at fault, the assumption that they make and the input that breaks it.",
    "Attack Scenario": "Numbered steps of one attacker: starting rights, each call with its values, what it yields.",
    "Proof of Concept": "The smallest script or request that shows the defect on a test system, and its expected output.",
    "Business Impact": "Records, accounts and functions within reach, how many, and duties of notice that follow.",
    "Remediation": "A patch as a diff, places of the same pattern to check, and what the patch leaves open.",
    "Verification": "One automated test that fails now and passes after the patch, and one for regular use.",
}


def review_prompt(
    vuln_classes: Sequence[str] | str | None = None,
    extra_context: Column | None = None,
    hints: Mapping[str, str] = HINTS,
) -> Column:
    """Prompt text of a chunk row that carries ``context``."""
    guidance = [part for hint in hint_texts(vuln_classes, hints) for part in (hint, "")]
    kind = F.when(F.col("is_diff"), F.lit("=== REVIEWING DIFF ===")).otherwise(F.lit("=== REVIEWING FILE ==="))
    note = F.lit(None).cast("string") if extra_context is None else F.when(
        extra_context != "", F.concat(F.lit("Context: "), extra_context)
    )
    return F.concat_ws(
        "\n",
        F.concat(F.nullif(F.col("context"), F.lit("")), F.lit("\n")),
        kind,
        F.concat(F.lit("File: "), F.col("file_path")),
        F.concat(F.lit("Language: "), text.language_of(F.col("file_path"))),
        note,
        F.lit(""), F.lit("=== CODE ==="), F.col("content"), F.lit(""),
        F.lit("\n".join([
            GUIDANCE_TITLE, "Look for these classes of defects in particular:", "",
            *guidance, OUTPUT_TITLE, OUTPUT_RULE,
        ])),
    )


def build_prompts(
    chunks: DataFrame,
    contexts: DataFrame,
    vuln_classes: Sequence[str] | str | None = None,
    extra_context: Column | None = None,
    hints: Mapping[str, str] = HINTS,
    size_of: DataFrame | None = None,
) -> DataFrame:
    """Chunks with ``prompt`` and ``prompt_id``. A chunk without a stored context gets none.

    ``size_of`` is a cheap table with a row per context, for the size check of the join.
    """
    rows = lookup_join(
        chunks, contexts, "project", "left", spread=["file_path", "chunk_index"],
        size_of=size_of, max_rows=MAX_BROADCAST_CONTEXTS,
    )
    prompts = rows.withColumn("prompt", review_prompt(vuln_classes, extra_context, hints))
    return prompts.withColumn("prompt_id", F.sha2("prompt", 256)).drop("context", "content")


def explain_prompts(findings: DataFrame) -> DataFrame:
    """One report request per finding."""
    sections = "\n\n".join(f"## {title}\n{rule}" for title, rule in EXPLAIN_SECTIONS.items())
    prompt = F.concat(
        F.lit("This finding of a code review is confirmed:\n\n```json\n"),
        F.to_json(finding_struct()),
        F.lit("\n```\n\nWrite a full report with exactly these sections:\n\n" + sections + "\n"),
    )
    return findings.select("project", "finding_id", prompt.alias("prompt")).withColumn(
        "prompt_id", F.sha2("prompt", 256)
    )
