"""Queries over source files: admission, reading, chunks, manifests and roots."""

from pyspark.sql import functions as F

from auditweave.functions import text
from auditweave.operators.chunking import chunk_text
from auditweave.sources import files as src
from auditweave.sources import roots
from workload.base import query, whole
from workload.views import SQL, code_files, sql_text, src_files, web_files, with_views

SUFFIX = r"regexp_extract(path, '[^/](\.[^./]+)$', 1)"
CODE = "('.py', '.js', '.ts', '.jsx', '.tsx', '.go', '.rb', '.php', '.java', '.cs', '.rs', '.vue', '.svelte')"
DIRS = (
    "['node_modules', '.git', '__pycache__', 'venv', '.venv', 'env', '.env', 'dist', 'build', '.next', '.nuxt', "
    "'vendor', 'target', 'bin', 'obj', '.tox', '.mypy_cache', '.pytest_cache', 'egg-info', '.eggs']"
)
ADMITTED = f"{SUFFIX} IN {CODE} AND NOT list_has_any(string_split(path, '/'), {DIRS})"
SQL["admitted_src"] = f"SELECT * FROM src_files WHERE {ADMITTED} AND size_bytes <= 20000"
MAX_BYTES = 20_000


@query("admitted_files", with_views("SELECT project, path, size_bytes FROM admitted_src", "src_files", "admitted_src"))
def admitted_files(spark, sf_dir):
    return src.admitted(src_files(spark, sf_dir), MAX_BYTES).select("project", "path", "size_bytes")


@query(
    "refused_files",
    with_views(
        f"""SELECT project, reason, count(*) AS files FROM (
          SELECT project, CASE WHEN {SUFFIX} NOT IN {CODE} THEN 'extension'
            WHEN list_has_any(string_split(path, '/'), {DIRS}) THEN 'directory'
            WHEN size_bytes > {MAX_BYTES} THEN 'size' ELSE 'none' END AS reason
          FROM (SELECT * FROM src_files UNION ALL SELECT *, 0 FROM web_files UNION ALL SELECT *, 0 FROM code_files))
        GROUP BY project, reason""",
        "src_files", "web_files", "code_files",
    ),
)
def refused_files(spark, sf_dir):
    every = src_files(spark, sf_dir).drop("doc_id").unionByName(web_files(spark, sf_dir)).unionByName(code_files(spark, sf_dir))
    reason = F.coalesce(src.refusal(F.col("path"), F.col("size_bytes"), MAX_BYTES), F.lit("none"))
    return every.groupBy("project", reason.alias("reason")).agg(F.count("*").alias("files"))


@query(
    "line_cap",
    """SELECT doc_id, md5(array_to_string(string_split(text, chr(10))[1:12], chr(10))) AS kept,
       CAST(least(len(string_split(text, chr(10))), 12) AS bigint) AS lines FROM documents""",
)
def line_cap(spark, sf_dir):
    capped = src.reviewable(src_files(spark, sf_dir), max_lines=12)
    return whole(capped.select("doc_id", F.md5("content").alias("kept"), text.line_count(F.col("content")).alias("lines")))


_STRIPPED = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"


@query(
    "short_files",
    f"""SELECT source AS project, count(*) AS files_scanned,
        count(*) FILTER (len(string_split({_STRIPPED}, chr(10))) >= 10) AS reviewed FROM documents GROUP BY source""",
)
def short_files(spark, sf_dir):
    rows = src.reviewable(src_files(spark, sf_dir))
    return rows.groupBy("project").agg(F.count("*").alias("files_scanned"), F.count_if("long_enough").alias("reviewed"))


@query(
    "files_scanned",
    with_views("SELECT project, count(*) AS files_scanned FROM admitted_src GROUP BY project", "src_files", "admitted_src"),
)
def files_scanned(spark, sf_dir):
    from auditweave.operators.findings import files_scanned as counted

    return counted(src.admitted(src_files(spark, sf_dir), MAX_BYTES))


@query(
    "read_errors",
    with_views(
        """SELECT project, path, 'Could not read: ' || path AS error FROM src_files
           WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
        "src_files",
    ),
)
def read_errors(spark, sf_dir):
    """The listing names every document; only labelled documents have a readable body."""
    listing = src_files(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id")
    return src.read_errors(listing.select("project", "path"), listing.join(labels, "doc_id", "left_semi"))


@query(
    "text_expressions",
    f"""SELECT doc_id, md5({_STRIPPED}) AS stripped, CAST(ceil(length(text) / 4.0) AS bigint) AS tokens,
        CASE lang WHEN 'en' THEN 'python' WHEN 'fr' THEN 'javascript' WHEN 'de' THEN 'go' ELSE 'unknown' END AS language
        FROM documents""",
)
def text_expressions(spark, sf_dir):
    content = F.col("content")
    return src_files(spark, sf_dir).select(
        "doc_id", F.md5(text.strip(content)).alias("stripped"), text.ESTIMATE.of(content).alias("tokens"),
        text.language_of(F.col("path")).alias("language"),
    )


# Chunk borders from the same four numbers, with the lines regrouped by a join on line ranges.
MAX_TOKENS, OVERLAP = 200, 20
SQL["chunk_sizes"] = f"""
  SELECT *, greatest(1, CAST(floor(tokens / n) AS bigint)) AS charge,
         greatest(1, CAST(floor({OVERLAP} / (tokens / n)) AS bigint)) AS again
  FROM (SELECT doc_id, text, len(string_split(text, chr(10))) AS n, ceil(length(text) / 4.0) AS tokens FROM documents)"""
SQL["chunk_steps"] = f"""
  SELECT *, greatest(1, CAST(floor({MAX_TOKENS} / charge) AS bigint)) AS hold,
         greatest(1, greatest(1, CAST(floor({MAX_TOKENS} / charge) AS bigint)) - again) AS step
  FROM chunk_sizes"""
SQL["chunk_counts"] = f"""
  SELECT *, CASE WHEN tokens <= {MAX_TOKENS} THEN 1
                 ELSE 1 + CAST(ceil(greatest(0, n - hold) / step) AS bigint) END AS total FROM chunk_steps"""
SQL["doc_chunks"] = f"""
  SELECT doc_id, i AS chunk_index, total AS total_chunks, first AS line_start, last AS line_end,
         array_to_string(string_split(text, chr(10))[first:last], chr(10)) AS content
  FROM (SELECT *, CASE WHEN total = 1 THEN n ELSE least(n, hold + i * step) END AS last,
               CASE WHEN i = 0 THEN 1 ELSE greatest(1, hold + (i - 1) * step - again + 1) END AS first
        FROM (SELECT *, unnest(range(CAST(total AS bigint))) AS i FROM chunk_counts))"""
CHUNK_VIEWS = ("chunk_sizes", "chunk_steps", "chunk_counts", "doc_chunks")


@query(
    "text_chunks",
    with_views(
        """SELECT doc_id, CAST(chunk_index AS bigint) AS chunk_index, CAST(total_chunks AS bigint) AS total_chunks,
           CAST(line_start AS bigint) AS line_start, CAST(line_end AS bigint) AS line_end, md5(content) AS content
           FROM doc_chunks""",
        *CHUNK_VIEWS,
    ),
)
def text_chunks(spark, sf_dir):
    chunks = chunk_text(src_files(spark, sf_dir), MAX_TOKENS, OVERLAP, keys=("doc_id",))
    return whole(chunks.drop("is_diff").withColumn("content", F.md5("content")))


_ORDERED_MANIFESTS = (
    "package.json", "requirements.txt", "pyproject.toml", "go.mod", "Gemfile",
    "composer.json", "pom.xml", "build.gradle", "Cargo.toml",
)
_MANIFEST_LANGUAGES = ("javascript", "python", "python", "go", "ruby", "php", "java", "java", "rust")
SQL["manifests"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{n}', '{l}')" for i, (n, l) in enumerate(zip(_ORDERED_MANIFESTS, _MANIFEST_LANGUAGES))
) + ") AS m(ord, name, lang)"
SQL["manifest_langs"] = """
  SELECT project, coalesce(arg_min(lang, ord), 'unknown') AS manifest_language
  FROM code_files LEFT JOIN manifests ON path = name GROUP BY project"""


@query("manifest_languages", with_views("SELECT * FROM manifest_langs", "code_files", "manifests", "manifest_langs"))
def manifest_languages(spark, sf_dir):
    return roots.manifest_languages(code_files(spark, sf_dir))


# Absolute paths: customers live below their nation; some nations and segments hold a root marker.
_LISTING = """SELECT '/home/n' || CAST(c_nationkey AS string) || '/' || lower(c_mktsegment) || '/c' || CAST(c_custkey AS string) || '/' ||
  (CASE c_mktsegment WHEN 'MACHINERY' THEN 'package.json' WHEN 'BUILDING' THEN '.git/HEAD' ELSE 'main.py' END) AS path FROM customer
  UNION ALL SELECT '/home/n' || CAST(n_nationkey AS string) || (CASE n_regionkey WHEN 0 THEN '/pyproject.toml' ELSE '/readme.txt' END) FROM nation"""


@query(
    "project_roots",
    f"""WITH listing AS ({_LISTING}),
      marks AS (SELECT DISTINCT regexp_replace(path, '/(package\\.json|pyproject\\.toml|\\.git/HEAD)$', '') AS dir
                FROM listing WHERE regexp_matches(path, '/(package\\.json|pyproject\\.toml|\\.git/HEAD)$'))
      SELECT path, coalesce((SELECT arg_max(dir, length(dir)) FROM marks WHERE starts_with(listing.path, dir || '/')), '/') AS root
      FROM listing""",
)
def project_roots(spark, sf_dir):
    for name in ("customer", "nation"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    listing = spark.sql(_LISTING)
    return roots.nearest_roots(listing, roots.marker_dirs(listing))
