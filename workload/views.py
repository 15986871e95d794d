"""Views that read the given tables as source files, diffs, answers and change events.

Every view exists twice with the same definition: as a DataFrame and as SQL text for the check.
They map columns; they leave no row of their table out.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workload.base import table

CLASSES = ("IDOR", "AUTH_BYPASS", "PRIVILEGE_ESC", "MASS_ASSIGN", "JWT_ISSUE", "LOGIC_FLAW", "DATA_EXPOSURE")
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")
CONFIDENCES = ("LOW", "MEDIUM", "HIGH")

SQL: dict[str, str] = {}


def with_views(body: str, *names: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names) + "\n" + body


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def pick(names: tuple[str, ...], number: str) -> str:
    """SQL of both dialects: one of ``names`` by ``number`` modulo their count."""
    cases = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names))
    return f"CASE CAST({number} AS bigint) % {len(names)} {cases} END"


# --- documents as source files ---------------------------------------------------------------

_SRC_PATH = (
    "(CASE lang WHEN 'de' THEN 'vendor' ELSE 'app' END) || '/f' || CAST(doc_id AS string) || "
    "(CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.js' WHEN 'de' THEN '.go' ELSE '.txt' END)"
)
SQL["src_files"] = (
    f"SELECT source AS project, {_SRC_PATH} AS path, strlen(text) AS size_bytes, text AS content, doc_id FROM documents"
)


def src_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("project"), F.expr(_SRC_PATH).alias("path"),
        F.octet_length("text").cast("long").alias("size_bytes"), F.col("text").alias("content"), "doc_id",
    )


# --- pages as source files -------------------------------------------------------------------

_HOST = "^https?://([^/]+)"
SQL["web_files"] = (
    f"SELECT regexp_extract(url, '{_HOST}', 1) AS project, 'p' || CAST(page_id AS string) || '.vue' AS path, "
    "strlen(html) AS size_bytes, html AS content FROM pages"
)


def web_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        F.regexp_extract("url", _HOST, 1).alias("project"),
        F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".vue")).alias("path"),
        F.octet_length("html").cast("long").alias("size_bytes"), F.col("html").alias("content"),
    )


# --- orders as small services, customers as their projects -----------------------------------

TEMPLATES = {
    "O": (
        ".py",
        "from fastapi import FastAPI, Depends\n"
        "app = FastAPI()\n\n"
        '@app.get("/orders/{key}")\n'
        "def show(order_id: int, user=Depends(get_current_user)):\n"
        "    return Order.get(order_id)\n\n"
        '@app.post("/orders/{cust}/pay")\n'
        "def pay(total={price}):\n"
        "    if user.is_admin or role = 'staff':\n"
        "        audit({key})\n\n"
        "class Order{key}(BaseModel):\n"
        "    owner: int\n",
    ),
    "F": (
        ".js",
        "const app = require('express')();\n"
        "app.get('/carts/{key}', requireAuth, show);\n"
        "router.post('/carts/{cust}', save);\n"
        "const Cart = mongoose.model('Cart{key}');\n"
        "if (has_role(user, 'moderator')) {\n"
        "  drop({key}, {price});\n"
        "}\n",
    ),
    "P": (
        ".java",
        "@RestController\n"
        "@UseGuards(AuthGuard)\n"
        "public class Ship{key} {\n"
        '  @GetMapping("/ships/{key}")\n'
        "  @Entity\n"
        "  boolean ok = check_permission(Role.ADMIN, {price});\n"
        "}\n",
    ),
}
_FOLDERS = {
    "1-URGENT": "src/middleware/", "2-HIGH": "src/guards/", "3-MEDIUM": "src/api/",
    "4-NOT SPECIFIED": "node_modules/", "5-LOW": "src/web/",
}
_MANIFEST = {
    "MACHINERY": "go.mod", "BUILDING": "pom.xml", "AUTOMOBILE": "Gemfile",
    "FURNITURE": "package.json", "HOUSEHOLD": "README",
}


def _case(column: str, choices: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {sql_text(v)}" for k, v in choices.items()) + " END"


_CODE_PATH = (
    _case("o_orderpriority", _FOLDERS) + " || 'o' || CAST(o_orderkey AS string) || "
    + _case("o_orderstatus", {k: v[0] for k, v in TEMPLATES.items()})
)


def _filled(template: str) -> str:
    return (
        f"replace(replace(replace({template}, '{{key}}', CAST(o_orderkey AS string)), "
        "'{cust}', CAST(o_custkey AS string)), '{price}', CAST(CAST(round(o_totalprice) AS bigint) AS string))"
    )


_CODE_TEXT = _filled(_case("o_orderstatus", {k: v[1] for k, v in TEMPLATES.items()}))
_MANIFEST_PATH = _case("c_mktsegment", _MANIFEST)
SQL["code_files"] = f"""
  SELECT project, path, strlen(content) AS size_bytes, content FROM (
    SELECT 'c' || CAST(o_custkey AS string) AS project, {_CODE_PATH} AS path, {_CODE_TEXT} AS content FROM orders
    UNION ALL
    SELECT 'c' || CAST(c_custkey AS string), {_MANIFEST_PATH}, c_name FROM customer)"""


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The templates hold quotes and line ends, which differ between SQL dialects; take them as literals.
    text = F.lit(None).cast("string")
    for status, (_, template) in TEMPLATES.items():
        text = F.when(F.col("o_orderstatus") == status, F.lit(template)).otherwise(text)
    for mark, value in (
        ("{key}", F.col("o_orderkey").cast("string")),
        ("{cust}", F.col("o_custkey").cast("string")),
        ("{price}", F.round("o_totalprice").cast("bigint").cast("string")),
    ):
        text = F.replace(text, F.lit(mark), value)
    orders = table(spark, sf_dir, "orders").select(
        F.expr("'c' || CAST(o_custkey AS string)").alias("project"), F.expr(_CODE_PATH).alias("path"),
        text.alias("content"),
    )
    manifests = table(spark, sf_dir, "customer").select(
        F.expr("'c' || CAST(c_custkey AS string)").alias("project"), F.expr(_MANIFEST_PATH).alias("path"),
        F.col("c_name").alias("content"),
    )
    return orders.unionByName(manifests).select(
        "project", "path", F.octet_length("content").cast("long").alias("size_bytes"), "content"
    )


# --- events as findings, answers and changes --------------------------------------------------

_FINDING = {
    "project": "'p' || CAST(CAST(floor(user_id / 15) AS bigint) AS string)",
    "vuln_class": pick(CLASSES, "event_id"),
    "severity": pick(SEVERITIES, "event_id"),
    "confidence": pick(CONFIDENCES, "k"),
    "file": "'svc/u' || CAST(user_id AS string) || '.py'",
    "line_start": "CAST(k % 30 AS bigint)",
    "line_end": "CAST(k % 30 + 5 AS bigint)",
    "title": "'Issue in ' || event_type",
    "description": "'seen at ' || CAST(k AS string)",
    "impact": "'event ' || CAST(event_id AS string)",
    "reproduction": "'call as user ' || CAST(user_id AS string)",
    "fix": "'check ' || event_type",
    "source_path": "'svc/u' || CAST(user_id AS string) || '.py'",
    "chunk_index": "CAST(floor(event_id / 1000) AS bigint)",
    "item_index": "event_id",
}
_FINDING_LIST = ", ".join(f"{sql} AS {name}" for name, sql in _FINDING.items())
SQL["keyed_events"] = "SELECT *, CAST(json_extract_string(props, '$.k') AS bigint) AS k FROM events"
SQL["raw_findings"] = f"SELECT {_FINDING_LIST}, ts FROM keyed_events"
# The report of an earlier scan: what the first week of events had shown.
SQL["baseline"] = "SELECT * FROM raw_findings WHERE ts < TIMESTAMP '2024-01-08 00:00:00'"
FINDINGS = ("keyed_events", "raw_findings")


def keyed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))


def raw_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed_events(spark, sf_dir).select(*[F.expr(sql).alias(n) for n, sql in _FINDING.items()], "ts")


def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_findings(spark, sf_dir).filter(F.col("ts") < F.lit("2024-01-08 00:00:00").cast("timestamp"))


# One JSON item per event. Some are broken in a way that depends on k, and the answer around
# the items depends on the user: plain, fenced, in prose, cut off, or no array.
ITEM_KIND = (
    "CASE k WHEN 7 THEN 'bad_severity' WHEN 13 THEN 'bad_line' WHEN 21 THEN 'text_line' WHEN 34 THEN 'float_line' "
    "WHEN 40 THEN 'missing_key' WHEN 47 THEN 'bad_class' WHEN 55 THEN 'no_file' WHEN 62 THEN 'bad_confidence' "
    "WHEN 70 THEN 'not_object' WHEN 81 THEN 'safe' ELSE 'good' END"
)
ANSWER_KINDS = ("plain", "fenced", "prose", "plain", "cut", "object", "fenced")
ANSWER_KIND = pick(ANSWER_KINDS, "user_id")
_ITEM = """
  CASE kind WHEN 'not_object' THEN CAST(event_id AS string) ELSE
  '{"id":"X-1","vuln_class":"' || (CASE kind WHEN 'bad_class' THEN 'XSS' WHEN 'safe' THEN 'SAFE' ELSE vuln_class END)
  || '","severity":"' || (CASE kind WHEN 'bad_severity' THEN lower(severity) ELSE severity END)
  || '","confidence":' || (CASE kind WHEN 'bad_confidence' THEN '3' ELSE '"' || confidence || '"' END)
  || ',"file":"' || (CASE kind WHEN 'no_file' THEN '' ELSE file END)
  || '","line_start":' || (CASE kind WHEN 'bad_line' THEN 'null' WHEN 'text_line' THEN '" ' || CAST(line_start AS string) || ' "'
       WHEN 'float_line' THEN CAST(line_start AS string) || '.75' ELSE CAST(line_start AS string) END)
  || ',"line_end":' || CAST(line_end AS string)
  || (CASE kind WHEN 'missing_key' THEN '' ELSE ',"title":"' || title || '"' END)
  || ',"description":"' || description || '","impact":"' || impact || '","reproduction":"' || reproduction
  || '","fix":"' || fix || '"}' END
"""


def reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers per file and thousand events, built from the events of that file."""
    items = keyed_events(spark, sf_dir).select(
        "*", F.expr(ITEM_KIND).alias("kind"), *[F.expr(sql).alias(n) for n, sql in _FINDING.items()]
    )
    arrays = items.withColumn("_item", F.expr(_ITEM)).groupBy("project", "source_path", "chunk_index", "user_id").agg(
        F.expr("'[' || listagg(_item, ',\n') WITHIN GROUP (ORDER BY event_id) || ']'").alias("_array")
    )
    kind = F.expr(ANSWER_KIND)
    answer = (
        F.when(kind == "fenced", F.concat(F.lit("\n```json\n"), F.col("_array"), F.lit("\n```  \n")))
        .when(kind == "prose", F.concat(F.lit("These are the findings:\n"), F.col("_array"), F.lit("\nEnd of list.")))
        .when(kind == "cut", F.concat(F.lit("[{\"vuln_class\": \"ID"), F.replace("_array", F.lit("]"), F.lit(""))))
        .when(kind == "object", F.lit('{"findings": "none"}'))
        .otherwise(F.col("_array"))
    )
    return arrays.select(
        "project", F.col("source_path").alias("file_path"), "chunk_index",
        (F.col("chunk_index") * 100 + 1).alias("line_start"), answer.alias("response"),
    )


# What parsing those answers must give, straight from the events.
SQL["answer_items"] = f"""
  SELECT {_FINDING_LIST}, {ITEM_KIND} AS kind, {ANSWER_KIND} AS answer,
         row_number() OVER (PARTITION BY user_id, CAST(floor(event_id / 1000) AS bigint) ORDER BY event_id) - 1 AS item_pos
  FROM keyed_events"""
SQL["parsed"] = """
  SELECT project, source_path, chunk_index, item_pos AS item_index,
         CASE kind WHEN 'safe' THEN 'SAFE' ELSE vuln_class END AS vuln_class, severity, confidence, file,
         line_start + chunk_index * 100 AS line_start, line_end + chunk_index * 100 AS line_end,
         title, description, impact, reproduction, fix
  FROM answer_items
  WHERE answer NOT IN ('cut', 'object')
    AND kind NOT IN ('bad_severity', 'bad_line', 'missing_key', 'bad_class', 'bad_confidence', 'not_object')"""
PARSED = ("keyed_events", "answer_items", "parsed")

_CHANGE = {
    "project": _FINDING["project"],
    "path": "'svc/u' || CAST(user_id AS string) || (CASE event_type WHEN 'view' THEN '.md' ELSE '.py' END)",
    "size_bytes": "CAST(floor(value * 10) AS bigint)",
    "kind": "CASE event_type WHEN 'purchase' THEN 'deleted' WHEN 'click' THEN 'created' ELSE 'modified' END",
    "is_directory": "event_type = 'error'",
}
SQL["changes"] = "SELECT ts, " + ", ".join(f"{sql} AS {name}" for name, sql in _CHANGE.items()) + " FROM events"


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("ts", *[F.expr(sql).alias(n) for n, sql in _CHANGE.items()])


# --- documents as diffs -----------------------------------------------------------------------

HUNK_LINES = 8
SQL["diffs"] = f"""
  SELECT doc_id AS diff_id, source AS project,
    'diff --git a/app/f' || doc_id % 7 || '.py b/app/f' || doc_id % 7 || '.py' || chr(10)
    || '--- a/app/f' || doc_id % 7 || '.py' || chr(10) || '+++ b/app/f' || doc_id % 7 || '.py' || chr(10)
    || list_aggregate(list_transform(string_split(text, chr(10)), lambda l, i:
         (CASE WHEN (i - 1) % {HUNK_LINES} = 0
               THEN '@@ -' || i || ',{HUNK_LINES} +' || (i + 10) || ',{HUNK_LINES} @@ part' || chr(10) ELSE '' END)
         || (CASE (i - 1) % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE ' ' END) || l), 'string_agg', chr(10))
    || chr(10) || 'diff --git a/img/f' || doc_id || '.bin b/img/f' || doc_id || '.bin' || chr(10)
    || 'new file mode 100644' || chr(10) || 'Binary files differ' AS diff_text
  FROM documents"""


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("doc_id").cast("string")

    def marked(line, i):
        number = (i + 1).cast("string")
        head = F.concat(
            F.lit("@@ -"), number, F.lit(f",{HUNK_LINES} +"), (i + 11).cast("string"), F.lit(f",{HUNK_LINES} @@ part\n")
        )
        mark = F.when(i % 3 == 0, F.lit("+")).when(i % 3 == 1, F.lit("-")).otherwise(F.lit(" "))
        return F.concat(F.when(i % HUNK_LINES == 0, head).otherwise(F.lit("")), mark, line)

    code = F.concat(F.lit("app/f"), (F.col("doc_id") % 7).cast("string"), F.lit(".py"))  # many diffs touch one path
    image = F.concat(F.lit("img/f"), name, F.lit(".bin"))
    body = F.array_join(F.transform(F.split("text", "\n", -1), marked), "\n")
    text = F.concat(
        F.lit("diff --git a/"), code, F.lit(" b/"), code, F.lit("\n--- a/"), code, F.lit("\n+++ b/"), code, F.lit("\n"),
        body, F.lit("\ndiff --git a/"), image, F.lit(" b/"), image,
        F.lit("\nnew file mode 100644\nBinary files differ"),
    )
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("diff_id"), F.col("source").alias("project"), text.alias("diff_text")
    )
