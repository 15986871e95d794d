import random

import pytest
from pyspark.sql import functions as F

from auditweave.functions import text
from auditweave.operators.chunking import chunk_text


def walk(content, max_tokens, overlap):
    """Fill chunks line by line at the average price; a new chunk starts with the last lines of the one before."""
    tokens, lines = -(-len(content) // 4), content.split("\n")
    if tokens <= max_tokens:
        return [(1, len(lines), content)]
    average = tokens / len(lines)
    price, again = max(1, int(average)), max(1, int(overlap / average))
    done, held = [], []
    for number in range(1, len(lines) + 1):
        if held and (len(held) + 1) * price > max_tokens:
            done.append(held)
            held = held[-again:]
        held = held + [number]
    return [(h[0], h[-1], "\n".join(lines[h[0] - 1 : h[-1]])) for h in done + [held]]


def chunks_of(spark, texts, max_tokens, overlap, counter=text.ESTIMATE):
    rows = spark.createDataFrame([("p", f"f{i}.py", t) for i, t in enumerate(texts)], "project string, path string, content string")
    got = {}
    for r in chunk_text(rows, max_tokens, overlap, counter).collect():
        got.setdefault(r.file_path, []).append(r)
    return {k: sorted(v, key=lambda r: r.chunk_index) for k, v in got.items()}


@pytest.mark.parametrize("max_tokens,overlap", [(100, 10), (20, 200), (7, 3), (1, 0), (50, 49)])
def test_chunks_equal_brute_force(spark, max_tokens, overlap):
    rng = random.Random(max_tokens * 1000 + overlap)
    texts = ["", "x", "\n", "a\nb\nc"] + [
        "\n".join("w" * rng.randint(0, rng.choice([3, 30, 300])) for _ in range(rng.randint(1, 60))) for _ in range(40)
    ]
    got = chunks_of(spark, texts, max_tokens, overlap)
    for i, content in enumerate(texts):
        rows = got[f"f{i}.py"]
        assert [(r.line_start, r.line_end, r.content) for r in rows] == walk(content, max_tokens, overlap)
        assert [r.chunk_index for r in rows] == list(range(len(rows)))
        assert {r.total_chunks for r in rows} == {len(rows)}
        covered = {n for r in rows for n in range(r.line_start, r.line_end + 1)}
        assert covered == set(range(1, content.count("\n") + 2))


def test_small_text_is_one_chunk(spark):
    rows = chunks_of(spark, ["print('hello')\n", ""], 8000, 200)
    assert [(r.line_start, r.line_end, r.total_chunks) for r in rows["f0.py"]] == [(1, 2, 1)]
    assert rows["f1.py"][0].content == "" and rows["f1.py"][0].line_end == 1


def test_many_lines_make_ordered_chunks(spark):
    content = "\n".join(f"line {i}: value = compute({i})" for i in range(400))
    rows = chunks_of(spark, [content], 100, 10)["f0.py"]
    assert len(rows) > 1 and all(r.content.strip() for r in rows)
    starts = [r.line_start for r in rows]
    assert starts == sorted(set(starts))


def test_encoded_counter(spark):
    words = text.EncodedTokens(lambda: str.split)
    rows = chunks_of(spark, ["a b\nc d\ne f"], 4, 1, words)["f0.py"]
    assert [(r.line_start, r.line_end) for r in rows] == [(1, 2), (2, 3)]


def test_no_shuffle(spark):
    rows = spark.range(3).select(F.lit("p").alias("project"), F.col("id").cast("string").alias("path"), F.lit("a\nb").alias("content"))
    assert "Exchange" not in chunk_text(rows)._jdf.queryExecution().executedPlan().toString()
