"""Queries over whole reviews: stubbed batch calls, retries, replay, scans of projects and diffs."""

import json
import re
import uuid

from pyspark.sql import functions as F

from auditweave.functions import text
from auditweave.operators import context as ctx
from auditweave.operators import findings as ops
from auditweave.operators.chunking import chunk_text
from auditweave.operators.context import rendered_contexts
from auditweave.operators.prompts import EXPLAIN_SYSTEM_PROMPT, build_prompts, explain_prompts
from auditweave.plans import review as rv
from auditweave.plans.joins import shared_folder
from auditweave.plans.scan import DIFF_SCOPE, deduplicated_of, diff_prompts, findings_of, scan_prompts
from auditweave.sinks import bucketed
from workload.base import query, whole
from workload.context import PROMPT_VIEWS, _prompt_sql, _SRC_CHUNKS, _SRC_LANG, src_prompts
from workload.diffs import DIFF_CHUNK_VIEWS, MAX_TOKENS as DIFF_TOKENS
from workload.files import CHUNK_VIEWS, MAX_TOKENS, OVERLAP, _STRIPPED
from workload.findings import COUNTS, DEDUP_VIEWS, ID, RANK, deduped
from workload.views import CLASSES, CONFIDENCES, SEVERITIES, SQL, diffs, pick, src_files, with_views

# --- a reviewer without a model ----------------------------------------------------------------


def _stub_client():
    """Answers with the number of code lines; fails on prompts with an odd number of them."""

    def call(system: str, prompt: str) -> str:
        code = prompt.split("=== CODE ===\n", 1)[1].split("\n\n=== VULNERABILITY ANALYSIS", 1)[0]
        lines = code.count("\n") + 1
        if lines % 2:
            raise RuntimeError(f"no answer for {lines} lines")
        return json.dumps([{"lines": lines}]) + "\n"

    return call


STUB = rv.per_prompt(_stub_client, "system")


@query(
    "batch_review",
    with_views(
        f"""SELECT sha256(prompt) AS prompt_id, CAST(1 AS bigint) AS attempt,
              CASE WHEN lines % 2 = 0 THEN '[{{"lines": ' || lines || '}}]' END AS response,
              CASE WHEN lines % 2 = 1 THEN 'no answer for ' || lines || ' lines' END AS error
            FROM (SELECT p.prompt, CAST(c.line_end - c.line_start + 1 AS bigint) AS lines
                  FROM ({_prompt_sql(_SRC_CHUNKS, [], _SRC_LANG)}) p
                  JOIN src_files s ON s.project = p.project AND s.path = p.file_path
                  JOIN doc_chunks c ON c.doc_id = s.doc_id AND c.chunk_index = p.chunk_index)""",
        *PROMPT_VIEWS,
    ),
)
def batch_review(spark, sf_dir):
    files = src_files(spark, sf_dir)
    contexts = rendered_contexts(ctx.empty_snapshot(files))
    prompts = build_prompts(chunk_text(files, MAX_TOKENS, OVERLAP), contexts, ["NONE"])
    return whole(rv.review(prompts.withColumn("attempt", F.lit(1)), STUB))


# Stored attempts: a prompt was tried as often as the index of its first chunk modulo 4 says, and
# the last try succeeded where the document is English. Equal chunks of a file share a prompt.
def _stored(prompts):
    first = prompts.groupBy("prompt_id").agg(
        F.min("chunk_index").alias("first"), F.max(F.col("file_path").contains(".py")).alias("ok")
    )
    tried = F.pmod("first", F.lit(4)).cast("int")
    tries = F.explode(F.when(tried > 0, F.sequence(F.lit(1), tried))).alias("attempt")
    rows = first.select("prompt_id", "first", "ok", tries)
    done = F.col("ok") & (F.col("attempt") == F.pmod("first", F.lit(4)))
    return rows.select(
        "prompt_id", "attempt", F.when(done, F.concat(F.lit("answer "), F.col("first").cast("string"))).alias("response"),
        F.when(~done, F.lit("timeout")).alias("error"),
    )


SQL["prompt_rows"] = f"""
  SELECT project, file_path, CAST(chunk_index AS bigint) AS chunk_index, sha256(prompt) AS prompt_id, contains(file_path, '.py') AS ok
  FROM ({_prompt_sql(_SRC_CHUNKS, [], _SRC_LANG)})"""
SQL["prompt_ids"] = "SELECT prompt_id, min(chunk_index) AS first, bool_or(ok) AS ok FROM prompt_rows GROUP BY prompt_id"
STORED_VIEWS = (*PROMPT_VIEWS, "prompt_rows", "prompt_ids")


def _bare_prompts(spark, sf_dir):
    return src_prompts(spark, sf_dir, ["NONE"])


@query(
    "pending_prompts",
    with_views(
        """SELECT prompt_id, first AS chunk_index, first % 4 + 1 AS attempt FROM prompt_ids
           WHERE first % 4 = 0 OR (NOT ok AND first % 4 < 3)""",
        *STORED_VIEWS,
    ),
)
def pending_prompts(spark, sf_dir):
    prompts = _bare_prompts(spark, sf_dir)
    return whole(rv.pending(prompts, _stored(prompts)).select("prompt_id", "chunk_index", "attempt"))


@query(
    "review_errors",
    with_views(
        """SELECT project, file_path, chunk_index, prompt_id, CAST(3 AS bigint) AS attempts, 'timeout' AS error
           FROM prompt_rows p JOIN prompt_ids i USING (prompt_id) WHERE NOT i.ok AND first % 4 = 3""",
        *STORED_VIEWS,
    ),
)
def review_errors(spark, sf_dir):
    prompts = _bare_prompts(spark, sf_dir)
    return whole(rv.review_errors(prompts, _stored(prompts)))


@query(
    "replayed_answers",
    with_views(
        """SELECT project, file_path, chunk_index, 'answer ' || first AS response
           FROM prompt_rows p JOIN prompt_ids i USING (prompt_id) WHERE i.ok AND first % 4 > 0""",
        *STORED_VIEWS,
    ),
)
def replayed_answers(spark, sf_dir):
    prompts = _bare_prompts(spark, sf_dir)
    return whole(rv.replay(prompts, _stored(prompts)).drop("line_start"))


@query(
    "bucketed_answers",
    with_views(
        """SELECT project, file_path, chunk_index, 'answer ' || first AS response
           FROM prompt_rows p JOIN prompt_ids i USING (prompt_id) WHERE i.ok AND first % 4 > 0 AND project LIKE '%1'""",
        *STORED_VIEWS,
    ),
)
def bucketed_answers(spark, sf_dir):
    """Some projects are reviewed again from the stored answers of all."""
    prompts = _bare_prompts(spark, sf_dir)
    path = f"{shared_folder(spark)}/answers-{uuid.uuid4().hex}"
    bucketed.write_answers(_stored(prompts), path)
    again = prompts.where(F.col("project").like("%1"))
    return whole(rv.replay(again, bucketed.answers_for(again, path)).drop("line_start"))


@query(
    "review_progress",
    with_views(
        """SELECT CAST(attempt AS bigint) AS attempt, count(*) FILTER (ok AND attempt = first % 4) AS answered,
                  count(*) FILTER (NOT (ok AND attempt = first % 4)) AS failed
           FROM (SELECT *, unnest(range(1, first % 4 + 1)) AS attempt FROM prompt_ids) GROUP BY attempt""",
        *STORED_VIEWS,
    ),
)
def review_progress(spark, sf_dir):
    """Answers and failures of each attempt."""
    return whole(rv.progress_of(_stored(_bare_prompts(spark, sf_dir))))


def _reporting_client():
    """Answers a report request with the id of its finding."""

    def call(system: str, prompt: str) -> str:
        return "# Report on " + json.loads(prompt.split("```json\n", 1)[1].split("\n```", 1)[0])["id"]

    return call


@query(
    "explain_answers",
    with_views(
        "SELECT project, finding_id, '# Report on ' || finding_id AS report FROM deduped", *DEDUP_VIEWS
    ),
)
def explain_answers(spark, sf_dir):
    """The report of every finding: requests, a reviewer without a model, texts by finding."""
    requests = explain_prompts(deduped(spark, sf_dir))
    answered = rv.review(requests.withColumn("attempt", F.lit(1)), rv.per_prompt(_reporting_client, EXPLAIN_SYSTEM_PROMPT))
    return rv.explained(requests, answered)


@query(
    "exact_tokens",
    with_views(
        "SELECT project, path, CAST(len(regexp_extract_all(content, '[A-Za-z]+')) AS bigint) AS tokens FROM src_files", "src_files"
    ),
)
def exact_tokens(spark, sf_dir):
    """Tokens of every file by a user's own encoder, here runs of letters."""
    counter = text.EncodedTokens(lambda: re.compile("[A-Za-z]+").findall)
    return src_files(spark, sf_dir).select("project", "path", counter.of(F.col("content")).alias("tokens"))


# --- whole scans ---------------------------------------------------------------------------------

# A stored answer per prompt: one finding at the start of the chunk, one that overlapping chunks
# share, and a broken item.
_ANSWER = f"""'[' ||
  '{{"vuln_class":"' || {pick(CLASSES, "line_end")} || '","severity":"' || {pick(SEVERITIES, "line_end")} || '","confidence":"'
  || {pick(CONFIDENCES, "line_start")} || '","file":"","line_start":1,"line_end":2,"title":"Start","description":"d","impact":"i","reproduction":"r","fix":"f"}},'
  || '{{"vuln_class":"IDOR","severity":"HIGH","confidence":"' || {pick(CONFIDENCES, "chunk_index")}
  || '","file":"shared.py","line_start":7,"line_end":9,"title":"Shared","description":"d","impact":"i","reproduction":"r","fix":"f"}},'
  || '{{"vuln_class":"IDOR"}}]'"""


def _answered(prompts, by):
    """An answer of its own for every chunk, also where chunks share a prompt."""
    return prompts.select("prompt_id", *by, F.lit(1).alias("attempt"), F.expr(_ANSWER).alias("response"), F.lit(None).cast("string").alias("error"))


def _expected(chunks: str, scope: str = "") -> str:
    return f"""
      SELECT project, {scope}file_path AS source_path, chunk_index, 0 AS item_index, {pick(CLASSES, "line_end")} AS vuln_class,
             {pick(SEVERITIES, "line_end")} AS severity, {pick(CONFIDENCES, "line_start")} AS confidence, file_path AS file,
             line_start, line_start + 1 AS line_end, 'Start' AS title FROM {chunks}
      UNION ALL
      SELECT project, {scope}file_path, chunk_index, 1, 'IDOR', 'HIGH', {pick(CONFIDENCES, "chunk_index")}, 'shared.py',
             line_start + 6, line_start + 8, 'Shared' FROM {chunks}"""


_BEST = """SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY project, vuln_class, file, CAST(floor(line_start / 10) AS bigint), title
    ORDER BY CASE confidence WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END DESC, source_path, chunk_index, item_index) AS rn
  FROM {0}) WHERE rn = 1"""
_CONFIDENT = "confidence IN ('HIGH', 'MEDIUM')"

SQL["long_docs"] = f"""SELECT * FROM src_files s JOIN (SELECT doc_id AS d FROM documents
  WHERE len(string_split({_STRIPPED}, chr(10))) >= 10) ON d = s.doc_id
  WHERE path LIKE '%.py' OR path LIKE '%.js'"""
SQL["scan_chunks"] = """SELECT project, path AS file_path, c.chunk_index, c.line_start, c.line_end
  FROM doc_chunks c JOIN long_docs l ON l.doc_id = c.doc_id"""
SQL["scan_found"] = _expected("scan_chunks")
SQL["scan_best"] = _BEST.format("scan_found")
SCAN_VIEWS = ("src_files", *CHUNK_VIEWS, "long_docs", "scan_chunks", "scan_found", "scan_best")


def scan_findings(spark, sf_dir):
    files = src_files(spark, sf_dir)
    snapshot = ctx.build_snapshot(files)
    prompts = scan_prompts(files, snapshot, max_tokens=MAX_TOKENS, overlap_tokens=OVERLAP)
    return findings_of(rv.replay(prompts, _answered(prompts, rv.CHUNK_KEYS), by=rv.CHUNK_KEYS), "MEDIUM", "MEDIUM")


@query(
    "project_scan",
    with_views(
        f"""SELECT project, files_scanned, coalesce(total_findings, 0) AS total_findings, coalesce(critical, 0) AS critical,
            coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, coalesce(info, 0) AS info
            FROM (SELECT project, count(*) AS files_scanned FROM src_files WHERE path LIKE '%.py' OR path LIKE '%.js' GROUP BY project)
            LEFT JOIN (SELECT project, {COUNTS} FROM scan_best WHERE {_CONFIDENT} AND {RANK} >= 3 GROUP BY project) USING (project)""",
        *SCAN_VIEWS,
    ),
)
def project_scan(spark, sf_dir):
    """Files to context, chunks, prompts, replayed answers, findings and one summary per project."""
    from auditweave.sources.files import admitted

    scanned = ops.files_scanned(admitted(src_files(spark, sf_dir)))
    return ops.scan_summary(scan_findings(spark, sf_dir), scanned)


@query(
    "scan_findings",
    with_views(
        f"""SELECT project, file, vuln_class, severity, confidence, CAST(line_start AS bigint) AS line_start,
            CAST(line_end AS bigint) AS line_end, {ID} AS finding_id FROM scan_best WHERE {_CONFIDENT} AND {RANK} >= 3""",
        *SCAN_VIEWS,
    ),
)
def scanned_findings(spark, sf_dir):
    return scan_findings(spark, sf_dir).select(
        "project", "file", "vuln_class", "severity", "confidence", "line_start", "line_end", "finding_id"
    )


SQL["diff_chunk_files"] = """SELECT d.project, diff_id, file_seq, h.file_path, c.chunk_index, c.line_start, c.line_end
  FROM diff_chunk_rows c JOIN diffs d USING (diff_id) JOIN file_heads h USING (diff_id, file_seq)"""
SQL["diff_found"] = _expected("diff_chunk_files", "diff_id, file_seq, ")
SQL["diff_best"] = _BEST.format("diff_found").replace("BY project,", "BY project, diff_id,").replace("source_path, chunk", "file_seq, source_path, chunk")
DIFF_ID = ID.replace("project || chr(31)", "project || chr(31) || diff_id || chr(31)", 1)
DIFF_VIEWS = (*DIFF_CHUNK_VIEWS, "diff_chunk_files", "diff_found", "diff_best")


def diff_answers(spark, sf_dir):
    """Answers to the prompts of all diffs, with the diff that each belongs to."""
    changed = diffs(spark, sf_dir)
    prompts = diff_prompts(changed, ctx.empty_snapshot(changed), max_tokens=DIFF_TOKENS)
    return rv.replay(prompts, _answered(prompts, rv.DIFF_CHUNK_KEYS), rv.DIFF_CARRY, rv.DIFF_CHUNK_KEYS)


@query(
    "diff_review",
    with_views(
        f"""SELECT project, diff_id, file, vuln_class, severity, confidence, CAST(line_start AS bigint) AS line_start,
            CAST(line_end AS bigint) AS line_end, {DIFF_ID} AS finding_id FROM diff_best WHERE {RANK} >= 2""",
        *DIFF_VIEWS,
    ),
)
def diff_review(spark, sf_dir):
    """Diffs to files, packed chunks, prompts, replayed answers and findings, each diff by itself."""
    found = findings_of(diff_answers(spark, sf_dir), "LOW", confidence=None, diffs=True)
    return found.select("project", "diff_id", "file", "vuln_class", "severity", "confidence", "line_start", "line_end", "finding_id")


@query(
    "diff_gate",
    with_views(
        f"""SELECT project, diff_id, coalesce(blocking, 0) AS blocking, coalesce(blocking, 0) > 0 AS blocked
            FROM diffs LEFT JOIN (SELECT project, diff_id, count(*) AS blocking FROM diff_best WHERE {RANK} >= 5 GROUP BY project, diff_id)
            USING (project, diff_id)""",
        *DIFF_VIEWS,
    ),
)
def diff_gate(spark, sf_dir):
    """A verdict for every diff."""
    found = findings_of(diff_answers(spark, sf_dir), "LOW", confidence=None, diffs=True)
    return ops.gate(found, diffs(spark, sf_dir), "CRITICAL", DIFF_SCOPE)


@query(
    "diff_scanned",
    with_views("SELECT project, diff_id, count(DISTINCT file) AS files_scanned FROM diff_best GROUP BY project, diff_id", *DIFF_VIEWS),
)
def diff_scanned(spark, sf_dir):
    """Files scanned by each diff review: those with findings before the severity filter."""
    return ops.files_with_findings(deduplicated_of(diff_answers(spark, sf_dir), diffs=True), DIFF_SCOPE)
