"""Unified diffs: entries, files, hunks, numbered lines and packed chunks.

Everything happens inside the row that holds the diff, so no step shuffles.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditweave import vocab
from auditweave.functions import text
from auditweave.operators.chunking import chunk_array

# The line formats of a unified diff. (?d) makes "\n" the only line end.
FILE_BORDER = r"(?md)^(?=diff --git )"
HUNK_BORDER = r"(?md)^(?=@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@)"
HUNK_HEAD = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
NEW_PATH = r"(?md)^\+\+\+ b/(.+)$"
OLD_PATH = r"(?md)^--- a/(.+)$"
GIT_PATH = r"(?d)^diff --git a/.+ b/(.+)"


def _found(body: Column, pattern: str) -> Column:
    return F.nullif(text.strip(F.regexp_extract(body, pattern, 1)), F.lit(""))


def diff_entries(changes: DataFrame) -> DataFrame:
    """One row per changed file with its path and its counts of added and removed lines.

    Takes ``diff_id, a_path, b_path, diff_text`` (text or bytes); entries with a blank patch go.
    """
    patch = F.coalesce(F.make_valid_utf8(F.col("diff_text").cast("string")), F.lit(""))

    def starting(mark: str) -> Column:
        def times(token: str) -> Column:
            return F.size(F.split(F.col("diff_text"), token.replace("+", r"\+"), -1)) - 1

        return times(f"\n{mark}") - times(f"\n{mark * 3}")

    path = F.coalesce(F.nullif("b_path", F.lit("")), F.nullif("a_path", F.lit("")), F.lit("unknown"))
    rest = [c for c in changes.columns if c not in ("a_path", "b_path", "diff_text")]
    rows = changes.select(*rest, path.alias("file_path"), patch.alias("diff_text"))
    return rows.filter(text.strip(F.col("diff_text")) != "").select(
        *rest, "file_path", "diff_text",
        starting("+").alias("lines_added"), starting("-").alias("lines_removed"),
    )


def split_files(diffs: DataFrame) -> DataFrame:
    """One row per file of each diff: ``diff_id, file_seq, file_path, is_new_file, is_deleted, diff_text``.

    Text before the first ``diff --git`` line belongs to no file and is left out if files follow.
    A given ``file_path`` is kept for diffs of one file; otherwise the header names the path.
    """
    given = F.col("file_path") if "file_path" in diffs.columns else F.lit(None).cast("string")

    def file_sections(sections: Column) -> Column:
        git = F.filter(sections, lambda s: s.startswith("diff --git "))
        return text.bind(git, lambda g: F.when(F.size(g) > 0, g).otherwise(sections))

    files = text.bind(F.split("diff_text", FILE_BORDER, -1), file_sections)
    rows = diffs.select("diff_id", given.alias("_given"), files.alias("_files"))
    rows = rows.select(
        "diff_id", F.when(F.size("_files") == 1, F.nullif("_given", F.lit(""))).alias("_given"),
        F.posexplode("_files").alias("file_seq", "diff_text"),
    )
    head = F.split("diff_text", HUNK_BORDER, 2)[0]
    rows = rows.withColumn("_head", F.when(head.rlike(HUNK_HEAD), F.lit("")).otherwise(head))
    named = F.coalesce(
        "_given", _found(F.col("_head"), NEW_PATH), _found(F.col("_head"), OLD_PATH),
        _found(F.col("_head"), GIT_PATH), F.lit("unknown"),
    )
    is_new = F.col("_head").rlike(r"(?md)^new file")
    return rows.select(
        "diff_id", "file_seq", named.alias("file_path"), is_new.alias("is_new_file"),
        (~is_new & F.col("_head").rlike(r"(?md)^deleted file")).alias("is_deleted"), "diff_text",
    )


def _hunk_texts(diff: Column) -> Column:
    return F.filter(F.split(diff, HUNK_BORDER, -1), lambda h: h.rlike(HUNK_HEAD))


def _start(head: Column, group: int) -> Column:
    return F.regexp_extract(head, HUNK_HEAD, group).try_cast("long")


def _hunk(raw: Column) -> Column:
    """Facts of one hunk: header, line range and its text with added, removed, kept lines in turn."""

    def sides(lines: Column) -> Column:
        def starting(mark: str, name: str) -> Column:
            return F.filter(lines, lambda l, i: (i > 0) & l.startswith(mark)).alias(name)

        return F.struct(
            lines[0].alias("head"), starting("+", "added"), starting("-", "removed"), starting(" ", "kept")
        )

    def facts(side: Column) -> Column:
        head, added, removed, kept = (side[n] for n in ("head", "added", "removed", "kept"))
        new_start = _start(head, 3)
        ordered = F.concat(F.array(head), added, removed, kept)
        return F.struct(
            head.alias("header"),
            new_start.alias("line_start"),
            (new_start + F.size(added) + F.size(kept) - 1).alias("line_end"),
            F.concat(F.array_join(ordered, "\n"), F.lit("\n")).alias("hunk_text"),
        )

    return text.bind(text.bind(F.split(raw, "\n", -1), sides), facts)


def diff_hunks(files: DataFrame) -> DataFrame:
    """One row per hunk of each file of a diff."""
    hunks = F.transform(_hunk_texts(F.col("diff_text")), _hunk)
    keys = ("diff_id", "file_seq", "file_path")
    rows = files.select(*keys, F.posexplode(hunks).alias("hunk_seq", "_h"))
    return rows.select(*keys, "hunk_seq", "_h.*")


def diff_lines(files: DataFrame) -> DataFrame:
    """One row per added, removed or kept line with its number and its position in the hunk.

    Added and kept lines are consecutive in the new file, removed and kept ones in the old file;
    so a line's number is its rank among the lines of its side, without a running window.
    """

    def numbered(body: Column, marks: tuple[str, ...], start: Column) -> Column:
        side = F.filter(body, lambda l: l["kind"].isin(*marks))
        return F.transform(
            side,
            lambda l, i: F.struct(l["pos"].alias("pos"), l["kind"].alias("kind"), (start + i).alias("line_no"), l["text"].alias("text")),
        )

    def lines_of(bound: Column) -> Column:
        body, head = bound["body"], bound["head"]
        new = numbered(body, ("+", " "), _start(head, 3))
        old = numbered(body, ("-", " "), _start(head, 1))
        return F.concat(new, F.filter(old, lambda l: l["kind"] == "-"))

    body = F.transform(
        F.split("_raw", "\n", -1),
        lambda l, i: F.struct(i.alias("pos"), F.substring(l, 1, 1).alias("kind"), F.substring(l, 2, F.length(l)).alias("text")),
    )
    bound = F.struct(F.substring_index("_raw", "\n", 1).alias("head"), body.alias("body"))
    keys = ("diff_id", "file_seq", "file_path")
    hunks = files.select(*keys, F.posexplode(_hunk_texts(F.col("diff_text"))).alias("hunk_seq", "_raw"))
    rows = hunks.select(*keys, "hunk_seq", F.explode(text.bind(bound, lines_of)).alias("_l"))
    return rows.select(*keys, "hunk_seq", "_l.*")


def _pack(hunks: Column, tokens: Column, max_tokens: int) -> Column:
    """Chunks of consecutive hunks. Only chunk starts are accumulated, never the hunks."""
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array(F.lit(0)).alias("starts"), F.lit(0).alias("i"))

    def add(acc: Column, size: Column) -> Column:
        full = (acc["i"] > 0) & (acc["sum"] + size > max_tokens)
        return F.struct(
            F.when(full, size).otherwise(acc["sum"] + size).alias("sum"),
            F.when(full, F.array_append(acc["starts"], acc["i"])).otherwise(acc["starts"]).alias("starts"),
            (acc["i"] + 1).alias("i"),
        )

    def chunks(packed: Column) -> Column:
        hunks, starts = packed["hunks"], packed["starts"]

        def chunk(first: Column, i: Column) -> Column:
            following = F.coalesce(F.get(starts, i + 1), F.size(hunks))
            own = F.slice(hunks, first + 1, following - first)
            next_start = F.get(hunks, following)["line_start"]
            return F.struct(
                i.alias("chunk_index"),
                F.get(hunks, first)["line_start"].alias("line_start"),
                F.coalesce(next_start - 1, F.get(hunks, following - 1)["line_end"]).alias("line_end"),
                F.array_join(F.transform(own, lambda h: h["hunk_text"]), "\n").alias("content"),
            )

        return F.transform(starts, chunk)

    starts = F.aggregate(tokens, start, add, lambda acc: acc["starts"])
    return text.bind(F.struct(hunks.alias("hunks"), starts.alias("starts")), chunks)


def chunk_diffs(
    files: DataFrame,
    max_tokens: int = vocab.CHUNK_TOKENS,
    overlap_tokens: int = vocab.CHUNK_OVERLAP,
    counter=text.ESTIMATE,
) -> DataFrame:
    """Chunks of a file's diff: whole hunks in order, and plain text chunks where there is no hunk."""
    keys = ("diff_id", "file_seq", "file_path")
    raw, diff = _hunk_texts(F.col("diff_text")), F.col("diff_text")

    def texts(hunks: Column) -> Column:
        return F.transform(hunks, lambda h: h["hunk_text"])

    if counter.in_lambdas:
        rows = files

        def packed(hunks: Column) -> Column:
            sizes = F.transform(counter.of_each(texts(hunks)), lambda t: t.cast("long"))
            return _pack(hunks, sizes, max_tokens)

        whole = counter.of(diff)
        hunks = F.transform(raw, _hunk)
    else:
        parsed = files.select(*keys, "diff_text", F.transform(raw, _hunk).alias("_hunks"))
        rows = parsed.withColumn("_sizes", counter.of_each(texts(F.col("_hunks")))).withColumn("_whole", counter.of(diff))

        def packed(hunks: Column) -> Column:
            return _pack(hunks, F.col("_sizes"), max_tokens)

        whole, hunks = F.col("_whole"), F.col("_hunks")

    bare = chunk_array(diff, whole, max_tokens, overlap_tokens)
    chunks = text.bind(hunks, lambda h: F.when(F.size(h) > 0, packed(h)).otherwise(bare))
    rows = rows.select(*keys, chunks.alias("_chunks"))
    rows = rows.select(*keys, F.size("_chunks").alias("total_chunks"), F.explode("_chunks").alias("_c"))
    return rows.select(
        *keys, "_c.chunk_index", "total_chunks", "_c.line_start", "_c.line_end", "_c.content",
        F.lit(True).alias("is_diff"),
    )
