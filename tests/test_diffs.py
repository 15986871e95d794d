from pyspark.sql import functions as F

from auditweave.functions import text
from auditweave.operators import diffs as ops

ONE = """diff --git a/app/x.py b/app/x.py
index 1..2 100644
--- a/app/x.py
+++ b/app/x.py
@@ -10,4 +10,5 @@ def f():
 kept
-old
+new one
+new two
 end
@@ -40 +41,2 @@
--- removed dashes
+@@ looks like a head
\\ No newline at end of file
"""
TWO = ONE + """diff --git a/gone.py b/gone.py
deleted file mode 100644
--- a/gone.py
+++ /dev/null
@@ -1,2 +0,0 @@
-a
-b
diff --git a/pic.png b/pic.png
new file mode 100644
Binary files differ"""


def files(spark, *texts, path=None):
    rows = spark.createDataFrame([(i, path, t) for i, t in enumerate(texts)], "diff_id long, file_path string, diff_text string")
    return ops.split_files(rows)


def test_files_of_a_diff(spark):
    rows = sorted(files(spark, TWO).collect(), key=lambda r: r.file_seq)
    assert [(r.file_path, r.is_new_file, r.is_deleted) for r in rows] == [
        ("app/x.py", False, False), ("gone.py", False, True), ("pic.png", True, False),
    ]
    assert "".join(r.diff_text for r in rows) == TWO


def test_given_path_and_plain_patch(spark):
    patch = ONE.split("\n", 2)[2]
    assert [r.file_path for r in files(spark, patch).collect()] == ["app/x.py"]
    assert [r.file_path for r in files(spark, patch, path="given.py").collect()] == ["given.py"]
    assert [r.file_path for r in files(spark, "no header").collect()] == ["unknown"]
    assert [r.file_path for r in files(spark, "commit 1\n\n" + ONE).collect()] == ["app/x.py"]


def test_lines_are_numbered_on_their_side(spark):
    rows = ops.diff_lines(files(spark, ONE)).orderBy("hunk_seq", "pos").collect()
    assert [(r.hunk_seq, r.kind, r.line_no, r.text) for r in rows] == [
        (0, " ", 10, "kept"), (0, "-", 11, "old"), (0, "+", 11, "new one"), (0, "+", 12, "new two"), (0, " ", 13, "end"),
        (1, "-", 40, "-- removed dashes"), (1, "+", 41, "@@ looks like a head"),
    ]


def test_hunks(spark):
    rows = ops.diff_hunks(files(spark, TWO)).orderBy("file_seq", "hunk_seq").collect()
    assert [(r.line_start, r.line_end) for r in rows] == [(10, 13), (41, 41), (0, -1)]
    assert rows[0].hunk_text == "@@ -10,4 +10,5 @@ def f():\n+new one\n+new two\n-old\n kept\n end\n"


def hunk(start, size):
    return f"@@ -{start} +{start} @@\n+" + "x" * (size * 4 - 2 - len(f"@@ -{start} +{start} @@\n"))


def test_hunks_are_packed_in_order(spark):
    sizes = [15, 14, 13, 39, 11, 11, 40, 12]
    diff = "\n".join(hunk(100 + 10 * i, s) for i, s in enumerate(sizes))
    tokens = [r.t for r in ops.diff_hunks(files(spark, diff)).orderBy("hunk_seq").select(text.ESTIMATE.of(F.col("hunk_text")).alias("t")).collect()]
    assert tokens == sizes
    groups, total = [[]], 0
    for i, s in enumerate(sizes):
        if groups[-1] and total + s > 30:
            groups.append([])
            total = 0
        groups[-1].append(i)
        total += s
    for counter in (text.ESTIMATE, text.EncodedTokens(lambda: lambda t: "x" * -(-len(t) // 4))):
        rows = ops.chunk_diffs(files(spark, diff), 30, counter=counter).orderBy("chunk_index").collect()
        assert [r.content.count("@@ -") for r in rows] == [len(g) for g in groups]
        firsts = [100 + 10 * g[0] for g in groups]
        assert [r.line_start for r in rows] == firsts
        assert [r.line_end for r in rows] == [f - 1 for f in firsts[1:]] + [170]
        assert {r.total_chunks for r in rows} == {len(groups)}


def test_no_hunks_is_a_text_chunk(spark):
    rows = ops.chunk_diffs(files(spark, "", "Binary files differ")).orderBy("diff_id").collect()
    assert [(r.content, r.line_start, r.line_end, r.is_diff) for r in rows] == [("", 1, 1, True), ("Binary files differ", 1, 1, True)]


def test_entries(spark):
    rows = spark.createDataFrame(
        [(1, "a.py", "b.py", bytearray(ONE.encode() + b"\xff")), (2, "a.py", None, bytearray(b"+x")), (3, None, None, bytearray(b"-")), (4, "q", "q", bytearray(b" \n")), (5, "q", "q", None)],
        "diff_id long, a_path string, b_path string, diff_text binary",
    )
    got = {r.diff_id: r for r in ops.diff_entries(rows).collect()}
    assert {i: r.file_path for i, r in got.items()} == {1: "b.py", 2: "a.py", 3: "unknown"}
    text_ = ONE + "�"
    assert got[1].diff_text == text_
    assert got[1].lines_added == text_.count("\n+") - text_.count("\n+++")
    assert got[1].lines_removed == text_.count("\n-") - text_.count("\n---")


def test_no_shuffle(spark):
    plan = ops.chunk_diffs(files(spark, ONE))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
