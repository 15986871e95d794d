"""Queries over unified diffs. The SQL side parses the same diffs with windows over exploded lines."""

from pyspark.sql import functions as F

from auditweave.operators import diffs as ops
from workload.base import query, whole
from workload.views import SQL, diffs, with_views

MAX_TOKENS = 150
_COUNT = "(length({t}) - length(replace({t}, {m}, ''))) // length({m})"


def _times(mark: str) -> str:
    return _COUNT.format(t="diff_text", m=f"(chr(10) || '{mark}')")


SQL["diff_rows"] = """
  SELECT diff_id, project, pos, line FROM (
    SELECT diff_id, project, unnest(string_split(diff_text, chr(10))) AS line,
           unnest(range(len(string_split(diff_text, chr(10))))) AS pos FROM diffs)"""
SQL["filed_rows"] = """
  SELECT *, sum(CASE WHEN starts_with(line, 'diff --git ') THEN 1 ELSE 0 END) OVER w - 1 AS file_seq,
         regexp_matches(line, '^@@ -[0-9]+(,[0-9]+)? \\+[0-9]+(,[0-9]+)? @@') AS is_head
  FROM diff_rows WINDOW w AS (PARTITION BY diff_id ORDER BY pos)"""
SQL["hunk_rows"] = """
  SELECT *, sum(CASE WHEN is_head THEN 1 ELSE 0 END) OVER w - 1 AS hunk_seq FROM filed_rows
  WINDOW w AS (PARTITION BY diff_id, file_seq ORDER BY pos)"""
SQL["file_heads"] = """
  SELECT diff_id, file_seq,
         coalesce(max(CASE WHEN hunk_seq = -1 AND starts_with(line, '+++ b/') THEN line[7:] END),
                  max(CASE WHEN hunk_seq = -1 THEN nullif(regexp_extract(line, '^diff --git a/.+ b/(.+)', 1), '') END)) AS file_path,
         bool_or(hunk_seq = -1 AND starts_with(line, 'new file')) AS is_new_file,
         bool_or(hunk_seq = -1 AND starts_with(line, 'deleted file')) AS is_deleted,
         string_agg(line, chr(10) ORDER BY pos) AS diff_text, max(hunk_seq) AS last_hunk
  FROM hunk_rows GROUP BY diff_id, file_seq"""
SQL["body_rows"] = """
  SELECT r.*, h.pos AS head_pos, h.line AS header,
         CAST(regexp_extract(h.line, '^@@ -([0-9]+)', 1) AS bigint) AS old_start,
         CAST(regexp_extract(h.line, '\\+([0-9]+)', 1) AS bigint) AS new_start
  FROM hunk_rows r JOIN hunk_rows h USING (diff_id, file_seq, hunk_seq) WHERE h.is_head"""
SQL["numbered_rows"] = """
  SELECT *, coalesce(sum(CASE WHEN kind IN ('+', ' ') THEN 1 ELSE 0 END) OVER w, 0) AS new_before,
         coalesce(sum(CASE WHEN kind IN ('-', ' ') THEN 1 ELSE 0 END) OVER w, 0) AS old_before
  FROM (SELECT *, line[1:1] AS kind FROM body_rows WHERE NOT is_head AND line[1:1] IN ('+', '-', ' '))
  WINDOW w AS (PARTITION BY diff_id, file_seq, hunk_seq ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
LINE_VIEWS = ("diffs", "diff_rows", "filed_rows", "hunk_rows", "body_rows", "numbered_rows")
SQL["hunks"] = """
  SELECT diff_id, file_seq, hunk_seq, any_value(header) AS header, any_value(new_start) AS line_start,
         any_value(new_start) + count(*) FILTER (kind IN ('+', ' ')) - 1 AS line_end,
         any_value(header) || chr(10) || string_agg(line, chr(10) ORDER BY (CASE kind WHEN '+' THEN 0 WHEN '-' THEN 1 ELSE 2 END), pos)
           || chr(10) AS hunk_text
  FROM numbered_rows GROUP BY diff_id, file_seq, hunk_seq"""


@query(
    "diff_entries",
    with_views(
        f"""SELECT diff_id, 'app/f' || diff_id % 7 || '.py' AS file_path,
          {_times('+')} - {_times('+++')} AS lines_added, {_times('-')} - {_times('---')} AS lines_removed FROM diffs""",
        "diffs",
    ),
)
def diff_entries(spark, sf_dir):
    name = F.concat(F.lit("app/f"), (F.col("diff_id") % 7).cast("string"), F.lit(".py"))
    rows = diffs(spark, sf_dir).select(
        "diff_id", name.alias("a_path"), F.lit(None).cast("string").alias("b_path"), F.col("diff_text").cast("binary").alias("diff_text")
    )
    return whole(ops.diff_entries(rows).drop("diff_text"))


@query(
    "diff_files",
    with_views(
        """SELECT diff_id, CAST(file_seq AS bigint) AS file_seq, file_path, is_new_file, is_deleted,
           md5(diff_text || (CASE file_seq WHEN 0 THEN chr(10) ELSE '' END)) AS diff_text FROM file_heads""",
        "diffs", "diff_rows", "filed_rows", "hunk_rows", "file_heads",
    ),
)
def diff_files(spark, sf_dir):
    files = ops.split_files(diffs(spark, sf_dir))
    return whole(files.withColumn("diff_text", F.md5("diff_text")))


@query(
    "diff_lines",
    with_views(
        """SELECT diff_id, CAST(file_seq AS bigint) AS file_seq, CAST(hunk_seq AS bigint) AS hunk_seq,
           CAST(pos - head_pos AS bigint) AS pos, kind,
           CAST(CASE kind WHEN '-' THEN old_start + old_before ELSE new_start + new_before END AS bigint) AS line_no,
           md5(line[2:]) AS text FROM numbered_rows""",
        *LINE_VIEWS,
    ),
)
def diff_lines(spark, sf_dir):
    lines = ops.diff_lines(ops.split_files(diffs(spark, sf_dir)))
    return whole(lines.drop("file_path").withColumn("text", F.md5("text")))


@query(
    "diff_line_counts",
    with_views(
        "SELECT diff_id, count(*) FILTER (kind = '+') AS added, count(*) FILTER (kind = '-') AS removed FROM numbered_rows GROUP BY diff_id",
        *LINE_VIEWS,
    ),
)
def diff_line_counts(spark, sf_dir):
    lines = ops.diff_lines(ops.split_files(diffs(spark, sf_dir)))
    return lines.groupBy("diff_id").agg(
        F.count_if(F.col("kind") == "+").alias("added"), F.count_if(F.col("kind") == "-").alias("removed")
    )


@query(
    "diff_hunks",
    with_views(
        """SELECT diff_id, CAST(file_seq AS bigint) AS file_seq, CAST(hunk_seq AS bigint) AS hunk_seq, header,
           CAST(line_start AS bigint) AS line_start, CAST(line_end AS bigint) AS line_end, md5(hunk_text) AS hunk_text FROM hunks""",
        *LINE_VIEWS, "hunks",
    ),
)
def diff_hunks(spark, sf_dir):
    hunks = ops.diff_hunks(ops.split_files(diffs(spark, sf_dir)))
    return whole(hunks.drop("file_path").withColumn("hunk_text", F.md5("hunk_text")))


# Packing on the SQL side: fold the hunk sizes of a file into the list of group numbers.
SQL["packed"] = f"""
  SELECT diff_id, file_seq, unnest(hunk_seqs) AS hunk_seq, unnest(groups) AS grp FROM (
    SELECT diff_id, file_seq, hunk_seqs, list_reduce(
        list_transform(sizes, lambda s: {{'sum': s, 'grp': 0, 'all': [0]}}),
        lambda a, x: CASE WHEN a.sum + x.sum > {MAX_TOKENS}
          THEN {{'sum': x.sum, 'grp': a.grp + 1, 'all': list_append(a.all, a.grp + 1)}}
          ELSE {{'sum': a.sum + x.sum, 'grp': a.grp, 'all': list_append(a.all, a.grp)}} END).all AS groups
    FROM (SELECT diff_id, file_seq, list(CAST(ceil(length(hunk_text) / 4.0) AS bigint) ORDER BY hunk_seq) AS sizes,
                 list(hunk_seq ORDER BY hunk_seq) AS hunk_seqs FROM hunks GROUP BY diff_id, file_seq))"""
SQL["packed_chunks"] = """
  SELECT *, coalesce(lead(first_start) OVER w - 1, last_end) AS line_end,
         first_start AS line_start,
         count(*) OVER (PARTITION BY diff_id, file_seq) AS total FROM (
    SELECT diff_id, file_seq, grp, arg_min(line_start, hunk_seq) AS first_start, arg_max(h.line_end, hunk_seq) AS last_end,
           string_agg(hunk_text, chr(10) ORDER BY hunk_seq) AS content
    FROM hunks h JOIN packed USING (diff_id, file_seq, hunk_seq) GROUP BY diff_id, file_seq, grp)
  WINDOW w AS (PARTITION BY diff_id, file_seq ORDER BY grp)"""
SQL["diff_chunk_rows"] = """
  SELECT diff_id, CAST(file_seq AS bigint) AS file_seq, CAST(grp AS bigint) AS chunk_index, total AS total_chunks,
         CAST(line_start AS bigint) AS line_start, CAST(line_end AS bigint) AS line_end, content FROM packed_chunks
  UNION ALL
  SELECT diff_id, CAST(file_seq AS bigint), 0, 1, 1, len(string_split(diff_text, chr(10))), diff_text
  FROM file_heads WHERE last_hunk = -1"""
DIFF_CHUNK_VIEWS = (*LINE_VIEWS, "hunks", "file_heads", "packed", "packed_chunks", "diff_chunk_rows")


@query(
    "diff_chunks",
    with_views(
        """SELECT diff_id, file_seq, chunk_index, CAST(total_chunks AS bigint) AS total_chunks, line_start,
           CAST(line_end AS bigint) AS line_end, md5(content) AS content FROM diff_chunk_rows""",
        *DIFF_CHUNK_VIEWS,
    ),
)
def diff_chunks(spark, sf_dir):
    chunks = ops.chunk_diffs(ops.split_files(diffs(spark, sf_dir)), MAX_TOKENS)
    return whole(chunks.drop("file_path", "is_diff").withColumn("content", F.md5("content")))
