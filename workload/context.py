"""Queries over project contexts and prompts."""

from pyspark.sql import functions as F

from auditweave import catalogues
from auditweave.catalogues import Catalogue
from auditweave.operators import context as ops
from auditweave.operators.prompts import (
    EXPLAIN_SECTIONS, GUIDANCE_TITLE, OUTPUT_RULE, OUTPUT_TITLE, build_prompts, explain_prompts,
)
from auditweave.operators.chunking import chunk_text
from auditweave.operators.findings import deduplicate
from workload.base import joined, query, whole
from workload.files import ADMITTED, CHUNK_VIEWS, MAX_TOKENS, OVERLAP
from workload.findings import DEDUP_VIEWS
from workload.views import SQL, code_files, raw_findings, sql_text, src_files, web_files, with_views

LIMIT = 5
SQL["ranked_code"] = f"""
  SELECT *, row_number() OVER (PARTITION BY project ORDER BY path) AS file_ord FROM code_files
  WHERE {ADMITTED} AND size_bytes <= 500000"""


def _re(patterns) -> str:
    return sql_text("|".join(f"(?:{p})" for p in patterns))


@query(
    "project_sample",
    with_views(f"SELECT project, path, md5(content) AS content FROM ranked_code WHERE file_ord <= {LIMIT}", "code_files", "ranked_code"),
)
def project_sample(spark, sf_dir):
    sampled = ops.sample_files(code_files(spark, sf_dir), LIMIT)
    return sampled.withColumn("content", F.md5("content"))


SQL["sampled_code"] = "SELECT * FROM ranked_code WHERE file_ord <= 100"
_FW = "CASE " + " ".join(
    f"WHEN regexp_matches(content, {_re(p)}) THEN '{n}'" for n, p in catalogues.FRAMEWORKS.items()
) + " END"
SQL["file_frameworks"] = f"SELECT project, path, {_FW} AS fw FROM sampled_code"
_FW_LANG = "CASE f.fw " + " ".join(f"WHEN '{n}' THEN '{l}'" for n, l in catalogues.FRAMEWORK_LANGUAGES.items()) + " END"
SQL["project_langs"] = f"""
  SELECT project, coalesce(f.fw, 'unknown') AS framework, coalesce({_FW_LANG}, manifest_language) AS language
  FROM manifest_langs LEFT JOIN (SELECT project, arg_min(fw, path) FILTER (fw IS NOT NULL) AS fw
                                 FROM file_frameworks GROUP BY project) f USING (project)"""
BASE = ("code_files", "ranked_code", "sampled_code", "manifests", "manifest_langs", "file_frameworks", "project_langs")


def features(spark, sf_dir, *kinds):
    return ops.project_features(code_files(spark, sf_dir), kinds=kinds)


@query("frameworks", with_views("SELECT * FROM project_langs", *BASE))
def frameworks(spark, sf_dir):
    return features(spark, sf_dir, "framework").select("project", "framework", "language")


_AUTH_FLAGS = ", ".join(f"regexp_matches(content, {_re(p)}) AS {n}" for n, p in catalogues.AUTH.items())
_AUTH_ANY = " OR ".join(catalogues.AUTH)
SQL["auth_flags"] = f"SELECT project, path, {_AUTH_FLAGS} FROM sampled_code"
_AUTH_LINES = " || ".join(
    f"(CASE WHEN n_{n} > 0 THEN chr(10) || '  - {n}: found in ' || n_{n} || ' file(s)' ELSE '' END)" for n in catalogues.AUTH
)
SQL["auth_rows"] = f"""
  SELECT project, {", ".join(f"coalesce(count(*) FILTER ({n}), 0) AS n_{n}" for n in catalogues.AUTH)},
         coalesce(string_agg(path, '|' ORDER BY path) FILTER ({_AUTH_ANY}), '') AS auth_files,
         coalesce(string_agg(path, '|' ORDER BY path) FILTER (({_AUTH_ANY})
           AND (contains(lower(path), 'middleware') OR contains(lower(path), 'guard'))), '') AS middleware
  FROM manifest_langs LEFT JOIN auth_flags USING (project) GROUP BY project"""
SQL["auth_texts"] = f"""
  SELECT *, CASE WHEN {_AUTH_LINES} = '' THEN 'No authentication patterns detected.'
                 ELSE 'Auth mechanisms detected:' || {_AUTH_LINES} END AS auth_summary FROM auth_rows"""
AUTH_VIEWS = ("auth_flags", "auth_rows", "auth_texts")


@query("auth_mechanisms", with_views("SELECT * FROM auth_texts", *BASE, *AUTH_VIEWS))
def auth_mechanisms(spark, sf_dir):
    from auditweave.functions.text import guards_access

    rows = features(spark, sf_dir, "auth")
    return rows.select(
        "project", *[F.col(f"auth_counts.{c}").alias(f"n_{c}") for c in catalogues.AUTH], joined("auth_files"),
        F.array_join(F.filter("auth_files", guards_access), "|").alias("middleware"),
        ops.auth_summary(list(catalogues.AUTH)).alias("auth_summary"),
    )


def _hit_view(kinds: dict, trim: bool) -> str:
    parts = []
    for language, patterns in kinds.items():
        others = ", ".join(f"'{o}'" for o in kinds if o != "python")
        where = f"language NOT IN ({others})" if language == "python" else f"language = '{language}'"
        for p, regex in enumerate(patterns):
            parts.append(
                f"SELECT project, path, {p} AS p, unnest(h) AS hit, unnest(range(len(h))) AS m FROM (SELECT project, path, "
                f"regexp_extract_all(content, {sql_text(regex)}) AS h FROM sampled_code JOIN project_langs USING (project) WHERE {where})"
            )
    hit = "trim(hit)" if trim else "hit"
    return f"""
      SELECT project, string_agg(hit, '|' ORDER BY seq) AS found, count(*) AS n FROM (
        SELECT project, hit, min(seq) AS seq FROM (
          SELECT project, {hit} AS hit, row_number() OVER (PARTITION BY project ORDER BY path, p, m) AS seq
          FROM ({" UNION ALL ".join(parts)})) GROUP BY project, hit) GROUP BY project"""


SQL["route_rows"] = _hit_view(catalogues.ROUTES, trim=False)
SQL["model_rows"] = _hit_view(catalogues.MODELS, trim=True)


def _positions(view: str, source: str, patterns) -> dict[str, str]:
    """Role contexts from match offsets: running lengths of the pieces between and in the hits."""
    regex = _re(patterns)
    return {
        f"{view}_pieces": f"""
          SELECT project, path, content, i, coalesce(hits[i], '') AS hit, gaps[i] AS gap FROM (
            SELECT *, unnest(range(1, len(gaps) + 1)) AS i FROM (
              SELECT project, path, content, regexp_extract_all(content, {regex}) AS hits,
                     string_split_regex(content, {regex}) AS gaps FROM {source}))""",
        f"{view}_at": f"""
          SELECT *, sum(length(gap)) OVER w + coalesce(sum(length(hit)) OVER v, 0) AS hit_at FROM {view}_pieces
          WINDOW w AS (PARTITION BY project, path ORDER BY i),
                 v AS (PARTITION BY project, path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
        f"{view}_lines": f"""
          SELECT project, path, i, string_split(regexp_replace(
            substring(content, CAST(greatest(0, hit_at - 50) + 1 AS bigint),
                      CAST(hit_at + length(hit) + 50 - greatest(0, hit_at - 50) AS bigint)), '^\\s+|\\s+$', '', 'g'), chr(10))[1] AS line
          FROM {view}_at WHERE hit <> ''""",
        view: f"""
          SELECT project, string_agg(line, '|' ORDER BY seq) AS found, count(*) AS n FROM (
            SELECT project, line, min(seq) AS seq FROM (
              SELECT project, line, row_number() OVER (PARTITION BY project ORDER BY path, i) AS seq FROM {view}_lines)
            GROUP BY project, line) GROUP BY project""",
    }


_ROLE_VIEWS = _positions("role_rows", "sampled_code", catalogues.ROLES)
SQL.update(_ROLE_VIEWS)
HITS = ("route_rows", "model_rows", *_ROLE_VIEWS)


@query(
    "routes_and_models",
    with_views(
        """SELECT project, coalesce(r.found, '') AS routes, coalesce(m.found, '') AS models
           FROM project_langs LEFT JOIN route_rows r USING (project) LEFT JOIN model_rows m USING (project)""",
        *BASE, "route_rows", "model_rows",
    ),
)
def routes_and_models(spark, sf_dir):
    return features(spark, sf_dir, "routes", "models").select("project", joined("routes"), joined("models"))


@query(
    "role_contexts",
    with_views(
        "SELECT project, coalesce(found, '') AS roles FROM project_langs LEFT JOIN role_rows USING (project)", *BASE, *_ROLE_VIEWS
    ),
)
def role_contexts(spark, sf_dir):
    return features(spark, sf_dir, "roles").select("project", joined("roles"))


# Web pages with a catalogue of their own: links as routes, headings as models.
WEB = Catalogue(
    frameworks={"static": ["<!DOCTYPE html>"]},
    framework_languages={"static": "html"},
    routes={"python": ['href="(/[^"]*)"']},
    models={"python": ["<h1>[^<]*</h1>"]},
    roles=['class="ad"', r"track\(", "</nav>"],
)
SQL["sampled_web"] = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY path) AS file_ord FROM web_files
  WHERE size_bytes <= 500000) WHERE file_ord <= 100"""
_WEB_ROLES = _positions("web_roles", "sampled_web", WEB.roles)
SQL.update(_WEB_ROLES)


def _web_hits(regex: str) -> str:
    return f"""
      SELECT project, string_agg(hit, '|' ORDER BY seq) AS found FROM (
        SELECT project, hit, min(seq) AS seq FROM (
          SELECT project, hit, row_number() OVER (PARTITION BY project ORDER BY path, m) AS seq FROM (
            SELECT project, path, unnest(h) AS hit, unnest(range(len(h))) AS m FROM (
              SELECT project, path, regexp_extract_all(content, {sql_text(regex)}) AS h FROM sampled_web)))
        GROUP BY project, hit) GROUP BY project"""


SQL["web_routes"] = _web_hits(WEB.routes["python"][0])
SQL["web_models"] = _web_hits(WEB.models["python"][0])


@query(
    "web_contexts",
    with_views(
        """SELECT project, 'static' AS framework, 'html' AS language, md5(r.found) AS routes, md5(m.found) AS models, md5(w.found) AS roles
           FROM web_routes r JOIN web_models m USING (project) JOIN web_roles w USING (project)""",
        "web_files", "sampled_web", "web_routes", "web_models", *_WEB_ROLES,
    ),
)
def web_contexts(spark, sf_dir):
    rows = ops.build_snapshot(web_files(spark, sf_dir), WEB)
    return rows.select("project", "framework", "language", *[F.md5(joined(c)).alias(c) for c in ("routes", "models", "roles")])


SQL["snapshot"] = """
  SELECT project, framework, language, auth_summary, coalesce(r.found, '') AS routes, coalesce(m.found, '') AS models,
         coalesce(o.found, '') AS roles, middleware
  FROM project_langs JOIN auth_texts USING (project) LEFT JOIN route_rows r USING (project)
       LEFT JOIN model_rows m USING (project) LEFT JOIN role_rows o USING (project)"""
SNAPSHOT = (*BASE, *AUTH_VIEWS, *HITS, "snapshot")


@query("snapshot", with_views("SELECT * FROM snapshot", *SNAPSHOT))
def snapshot(spark, sf_dir):
    rows = ops.build_snapshot(code_files(spark, sf_dir))
    return rows.select(
        "project", "framework", "language", "auth_summary", *[joined(c) for c in ("routes", "models", "roles", "middleware")]
    )


def _section(title: str, column: str, shown: int, rest: bool) -> str:
    items = f"string_split({column}, '|')"
    more = f"(CASE WHEN len({items}) > {shown} THEN '  ... and ' || (len({items}) - {shown}) || ' more' || chr(10) ELSE '' END)" if rest else "''"
    return (
        f"(CASE WHEN {column} = '' THEN '' ELSE '{title}' || chr(10) || "
        f"array_to_string(list_transform({items}[1:{shown}], lambda x: '  ' || x || chr(10)), '') || {more} || chr(10) END)"
    )


# The text ends with the last section's empty line, hence without its line end.
SQL["whole_contexts"] = f"""
  SELECT project, language, rtrim_one[1:length(rtrim_one) - 1] AS context FROM (
    SELECT project, language, '=== CODEBASE SECURITY CONTEXT ===' || chr(10) || 'Framework: ' || framework || chr(10)
      || 'Language: ' || language || chr(10) || chr(10) || 'AUTHENTICATION:' || chr(10) || auth_summary || chr(10) || chr(10)
      || {_section('ROUTES (first 30):', 'routes', 30, True)} || {_section('DATA MODELS (first 20):', 'models', 20, True)}
      || {_section('ROLES/PERMISSIONS:', 'roles', 15, False)} || {_section('AUTH MIDDLEWARE:', 'middleware', 10, False)} AS rtrim_one
    FROM snapshot)"""
CONTEXT_TOKENS = 150
SQL["contexts"] = f"""
  SELECT project, CASE WHEN length(context) > {CONTEXT_TOKENS * 4} THEN context[1:{CONTEXT_TOKENS * 4}] || chr(10) || '... (truncated)'
                       ELSE context END AS context FROM whole_contexts"""


@query(
    "rendered_contexts",
    with_views(
        """SELECT project, md5(c.context) AS short_text, md5(w.context) AS full_text FROM contexts c JOIN whole_contexts w USING (project)""",
        *SNAPSHOT, "whole_contexts", "contexts",
    ),
)
def rendered_contexts(spark, sf_dir):
    rows = ops.build_snapshot(code_files(spark, sf_dir))
    return rows.select(
        "project", F.md5(ops.render_context(CONTEXT_TOKENS)).alias("short_text"), F.md5(ops.render_context()).alias("full_text")
    )


@query(
    "context_overview",
    with_views(
        """SELECT project, framework, language, auth_summary[1:200] AS auth_summary,
             CAST(CASE routes WHEN '' THEN 0 ELSE len(string_split(routes, '|')) END AS bigint) AS routes_found,
             CAST(CASE models WHEN '' THEN 0 ELSE len(string_split(models, '|')) END AS bigint) AS models_found,
             CAST(CASE roles WHEN '' THEN 0 ELSE len(string_split(roles, '|')) END AS bigint) AS roles_found,
             array_to_string(string_split(routes, '|')[1:20], '|') AS routes,
             array_to_string(string_split(models, '|')[1:15], '|') AS models FROM snapshot""",
        *SNAPSHOT,
    ),
)
def context_overview(spark, sf_dir):
    rows = ops.context_overview(ops.build_snapshot(code_files(spark, sf_dir)))
    return whole(rows.withColumn("routes", joined("routes")).withColumn("models", joined("models")))


_JSON_LIST = "(CASE {0} WHEN '' THEN CAST([] AS varchar[]) ELSE string_split({0}, '|') END)"


@query(
    "context_json",
    with_views(
        "SELECT project, md5(CAST(to_json({'framework': framework, 'language': language, 'auth_summary': auth_summary, "
        + ", ".join(f"'{c}': {_JSON_LIST.format(c)}" for c in ("routes", "models", "roles", "middleware"))
        + "}) AS varchar)) AS context_json FROM snapshot",
        *SNAPSHOT,
    ),
)
def context_json(spark, sf_dir):
    rows = ops.context_json(ops.build_snapshot(code_files(spark, sf_dir)))
    return rows.withColumn("context_json", F.md5("context_json"))


@query(
    "snapshot_refresh",
    with_views(
        """SELECT project, framework, language, routes FROM snapshot WHERE project IN
             (SELECT 'c' || CAST(o_custkey AS string) FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01 00:00:00')
           UNION ALL SELECT project, 'unknown', 'unknown', '' FROM snapshot WHERE project NOT IN
             (SELECT 'c' || CAST(o_custkey AS string) FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01 00:00:00')""",
        *SNAPSHOT,
    ),
)
def snapshot_refresh(spark, sf_dir):
    """An empty stored table in which the projects with recent orders are rebuilt."""
    files = code_files(spark, sf_dir)
    recent = spark.read.parquet(f"{sf_dir}/orders.parquet").filter(
        F.col("o_orderdate") >= F.lit("1999-01-01 00:00:00").cast("timestamp")
    ).select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("project"))
    stored = ops.empty_snapshot(files)
    rows = ops.refresh_snapshot(stored, files, recent)
    return rows.select("project", "framework", "language", joined("routes"))


# --- prompts ----------------------------------------------------------------------------------


def _prompt_sql(chunks: str, hints: list[str], language: str) -> str:
    tail = "\n".join(
        [GUIDANCE_TITLE, "Look for these classes of defects in particular:", "", *[x for h in hints for x in (h, "")], OUTPUT_TITLE, OUTPUT_RULE]
    )
    return f"""SELECT project, file_path, chunk_index,
      (CASE WHEN context IS NULL THEN '' ELSE context || chr(10) || chr(10) END)
      || '=== REVIEWING FILE ===' || chr(10) || 'File: ' || file_path || chr(10) || 'Language: ' || {language} || chr(10) || chr(10)
      || '=== CODE ===' || chr(10) || content || chr(10) || chr(10) || {sql_text(tail)} AS prompt FROM ({chunks})"""


_SRC_LANG = "CASE lang WHEN 'en' THEN 'python' WHEN 'fr' THEN 'javascript' WHEN 'de' THEN 'go' ELSE 'unknown' END"
SQL["src_contexts"] = """SELECT DISTINCT project, '=== CODEBASE SECURITY CONTEXT ===' || chr(10) || 'Framework: unknown' || chr(10) || 'Language: unknown'
  || chr(10) || chr(10) || 'AUTHENTICATION:' || chr(10) || 'No authentication patterns detected.' || chr(10) AS context FROM src_files"""
_SRC_CHUNKS = """SELECT s.project, s.path AS file_path, c.chunk_index, c.content, c.line_start, c.line_end, d.lang, x.context
  FROM doc_chunks c JOIN src_files s USING (doc_id) JOIN documents d USING (doc_id) LEFT JOIN src_contexts x USING (project)"""
PROMPT_VIEWS = ("src_files", *CHUNK_VIEWS, "src_contexts")


def src_prompts(spark, sf_dir, vuln_classes=None):
    files = src_files(spark, sf_dir)
    contexts = ops.rendered_contexts(ops.empty_snapshot(files))
    return build_prompts(chunk_text(files, MAX_TOKENS, OVERLAP), contexts, vuln_classes)


@query(
    "review_prompts",
    with_views(
        f"""SELECT project, file_path, CAST(chunk_index AS bigint) AS chunk_index, sha256(prompt) AS prompt_id,
            CAST(length(prompt) AS bigint) AS prompt_length FROM ({_prompt_sql(_SRC_CHUNKS, list(catalogues.HINTS.values()), _SRC_LANG)})""",
        *PROMPT_VIEWS,
    ),
)
def review_prompts(spark, sf_dir):
    rows = src_prompts(spark, sf_dir)
    return whole(rows.select("project", "file_path", "chunk_index", "prompt_id", F.length("prompt").alias("prompt_length")))


FOCUS = "JWT_ISSUE,IDOR,NO_SUCH_CLASS"


@query(
    "focused_prompts",
    with_views(
        f"""SELECT project, file_path, CAST(chunk_index AS bigint) AS chunk_index, sha256(prompt) AS prompt_id
            FROM ({_prompt_sql(_SRC_CHUNKS, [catalogues.HINTS["JWT_ISSUE"], catalogues.HINTS["IDOR"]], _SRC_LANG)})""",
        *PROMPT_VIEWS,
    ),
)
def focused_prompts(spark, sf_dir):
    return whole(src_prompts(spark, sf_dir, FOCUS).select("project", "file_path", "chunk_index", "prompt_id"))


SQL["code_chunks"] = "SELECT project, path AS file_path, 0 AS chunk_index, content, context FROM code_files LEFT JOIN contexts USING (project)"


@query(
    "context_prompts",
    with_views(
        "SELECT project, file_path, CAST(chunk_index AS bigint) AS chunk_index, sha256(prompt) AS prompt_id FROM ("
        + _prompt_sql(
            "SELECT * FROM code_chunks", list(catalogues.HINTS.values()),
            "CASE regexp_extract(file_path, '\\.[a-z]+$') WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.java' THEN 'java' ELSE 'unknown' END",
        ) + ")",
        *SNAPSHOT, "whole_contexts", "contexts", "code_chunks",
    ),
)
def context_prompts(spark, sf_dir):
    files = code_files(spark, sf_dir)
    contexts = ops.rendered_contexts(ops.build_snapshot(files), CONTEXT_TOKENS)
    prompts = build_prompts(chunk_text(files), contexts, size_of=files.select("project").distinct())
    return whole(prompts.select("project", "file_path", "chunk_index", "prompt_id"))


_FINDING_JSON = "CAST(to_json({'id': finding_id, " + ", ".join(
    f"'{c}': {c}" for c in (
        "vuln_class", "severity", "confidence", "file", "line_start", "line_end", "title", "description", "impact", "reproduction", "fix",
    )
) + "}) AS varchar)"
_EXPLAIN_TAIL = "\n```\n\nWrite a full report with exactly these sections:\n\n" + "\n\n".join(
    f"## {t}\n{r}" for t, r in EXPLAIN_SECTIONS.items()
) + "\n"


@query(
    "explain_prompts",
    with_views(
        f"""SELECT project, finding_id, sha256({sql_text("This finding of a code review is confirmed:" + chr(10) + chr(10) + "```json" + chr(10))}
            || {_FINDING_JSON} || {sql_text(_EXPLAIN_TAIL)}) AS prompt_id FROM deduped""",
        *DEDUP_VIEWS,
    ),
)
def explaining_prompts(spark, sf_dir):
    return explain_prompts(deduplicate(raw_findings(spark, sf_dir))).drop("prompt")
