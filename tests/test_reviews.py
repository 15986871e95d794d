import json
import random
import uuid

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from auditweave import catalogues, vocab
from auditweave.operators import context as ctx
from auditweave.operators import findings as ops
from auditweave.operators.chunking import chunk_text
from auditweave.operators.prompts import SYSTEM_PROMPT, build_prompts, explain_prompts
from auditweave.operators.responses import rejected_items, response_items, valid_findings
from auditweave.plans import review as rv
from auditweave.plans import scan

RESPONSE = "project string, file_path string, chunk_index int, line_start long, response string"


def item(**changes):
    base = {
        "id": "X-1", "vuln_class": "IDOR", "severity": "HIGH", "confidence": "HIGH", "file": "views.py", "line_start": 5, "line_end": 8,
        "title": "Missing check", "description": "d", "impact": "i", "reproduction": "r", "fix": "f",
    }
    base.update(changes)
    return {k: v for k, v in base.items() if v != "DROP"}


def parsed(spark, *responses, start=1):
    rows = spark.createDataFrame([("p", "chunk.py", i, start, r) for i, r in enumerate(responses)], RESPONSE)
    items = response_items(rows)
    good = sorted(valid_findings(items).collect(), key=lambda r: (r.chunk_index, r.item_index))
    bad = sorted(rejected_items(items).collect(), key=lambda r: (r.chunk_index, r.item_index or 0))
    return good, bad


def test_shapes_of_answers(spark):
    array = json.dumps([item(), item(title="Two")])
    good, bad = parsed(
        spark, array, f"```json\n{array}\n```", f"```\n{array}\n   ```  ", f"Here they are:\n{array}\nEnd.", "[]", "not json", '{"key": 1}', "",
        f"  \n{array}\n", json.dumps(item()), "5", '"[x]"', "[1, 2", json.dumps([item()], indent=2), None,
    )
    counts = {}
    for r in good:
        counts[r.chunk_index] = counts.get(r.chunk_index, 0) + 1
    assert counts == {0: 2, 1: 2, 2: 2, 3: 2, 8: 2, 13: 1}
    assert {r.chunk_index: r.reason for r in bad} == {
        5: "not_json", 6: "not_array", 7: "not_json", 9: "not_array", 10: "not_array", 11: "not_json", 12: "not_json", 14: "not_json",
    }


def test_validation_of_items(spark):
    cases = {
        "ok": (item(), None), "text line": (item(line_start="42"), None), "spaces": (item(line_start=" 42 "), None),
        "float": (item(line_start=42.7), None), "bool": (item(line_end=True), None), "float text": (item(line_start="42.7"), "bad_line"),
        "null line": (item(line_start=None), "bad_line"), "no line": (item(line_end="DROP"), "missing_key"),
        "lower": (item(severity="high"), "bad_severity"), "class": (item(vuln_class="XSS"), "bad_class"), "safe": (item(vuln_class="SAFE"), None),
        "confidence": (item(confidence=3), "bad_confidence"), "no title": (item(title="DROP"), "missing_key"), "null title": (item(title=None), None),
        "object text": (item(fix={"a": 1}), None), "number": (7, "not_object"), "null": (None, "not_object"), "list": ([1], "not_object"),
    }
    good, bad = parsed(spark, json.dumps([c for c, _ in cases.values()]))
    names = list(cases)
    assert {names[r.item_index]: r.reason for r in bad} == {n: why for n, (_, why) in cases.items() if why}
    by_name = {names[r.item_index]: r for r in good}
    assert set(by_name) == {n for n, (_, why) in cases.items() if not why}
    assert [by_name[n].line_start for n in ("text line", "spaces", "float")] == [42, 42, 42]
    assert by_name["bool"].line_end == 1 and by_name["null title"].title is None and by_name["object text"].fix == '{"a":1}'
    assert len(good) + len(bad) == len(cases)


def test_default_file_and_rebase(spark):
    body = json.dumps([item(), item(file=""), item(file=None), item(file="DROP"), item(file=False)])
    good, _ = parsed(spark, body, start=100)
    assert [r.file for r in good] == ["views.py"] + ["chunk.py"] * 4
    assert {(r.line_start, r.line_end) for r in good} == {(104, 107)}
    huge, _ = parsed(spark, json.dumps([item(line_start=2**31 - 1)]), start=100)
    assert huge[0].line_start == 2**31 - 1 + 99
    assert parsed(spark, json.dumps([item()]), start=1)[0][0].line_start == 5


FINDING = (
    "project string, vuln_class string, severity string, confidence string, file string, line_start long, line_end long, title string, "
    "description string, impact string, reproduction string, fix string, source_path string, chunk_index int, item_index int"
)


def finding(n, cls="IDOR", file="v.py", line=10, title="T", conf="HIGH", sev="HIGH", project="p"):
    return (project, cls, sev, conf, file, line, line + 5, title, "d", "i", "r", "f", file, 0, n)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), FINDING)


def kept(spark, *rows):
    return sorted(r.item_index for r in ops.deduplicate(frame(spark, *rows)).collect())


def test_dedup_cases(spark):
    assert kept(spark, finding(0), finding(1)) == [0]
    assert kept(spark, finding(0), finding(1, line=15)) == [0]
    assert kept(spark, finding(0, line=9), finding(1, line=10), finding(2, line=19)) == [0, 1]
    assert kept(spark, finding(0, line=-1), finding(1, line=1)) == [0, 1]
    assert kept(spark, finding(0), finding(1, cls="SAFE"), finding(2, file="m.py"), finding(3, title="U"), finding(4, project="q")) == [0, 1, 2, 3, 4]
    assert kept(spark, finding(0, conf="LOW"), finding(1, line=12), finding(2)) == [1]
    assert kept(spark) == []
    assert kept(spark, finding(0, title=None), finding(1, title=None)) == [0]


def test_dedup_is_idempotent_stable_and_severity_comes_later(spark):
    rng = random.Random(1)
    rows = [
        finding(i, rng.choice(vocab.VULN_CLASSES), rng.choice("ab"), rng.randint(0, 40), rng.choice("TU"), rng.choice(["LOW", "MEDIUM", "HIGH"]), rng.choice(list(vocab.SEVERITY_RANKS)))
        for i in range(400)
    ]
    once = ops.deduplicate(frame(spark, *rows))
    expected = {}
    for r in rows:
        key = (r[1], r[4], r[5] // 10, r[7])
        if key not in expected or vocab.CONFIDENCE_RANKS[r[3]] > vocab.CONFIDENCE_RANKS[expected[key][3]]:
            expected[key] = r
    assert {r.item_index for r in once.collect()} == {r[-1] for r in expected.values()}
    again = ops.deduplicate(once.drop("finding_id"))
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in once.collect()}
    assert once.select("finding_id").distinct().count() == once.count()
    pair = frame(spark, finding(0, sev="CRITICAL", conf="LOW"), finding(1, sev="LOW", conf="HIGH"))
    assert ops.at_least_severity(ops.deduplicate(pair), "HIGH").count() == 0


def test_hot_key_is_cut_before_the_shuffle(spark, tmp_path):
    frame(spark, *[finding(i) for i in range(50)]).write.parquet(str(tmp_path / "f"))
    plan = ops.deduplicate(spark.read.parquet(str(tmp_path / "f")))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange hashpartitioning") < plan.index("Partial")


def test_thresholds_and_summary(spark):
    rows = ops.deduplicate(frame(spark, *[finding(i, title=s, sev=s, conf=c) for i, (s, c) in enumerate(zip(vocab.SEVERITY_RANKS, ["HIGH", "HIGH", "MEDIUM", "LOW", "LOW"]))]))
    assert [ops.at_least_severity(rows, s).count() for s in ("HIGH", "CRITICAL", "INFO", None)] == [2, 1, 5, 5]
    assert [ops.at_least_confidence(rows, c).count() for c in ("HIGH", "MEDIUM", None)] == [2, 3, 5]
    with pytest.raises(ValueError):
        ops.at_least_severity(rows, "SEVERE")
    scanned = spark.createDataFrame([("p", 3), ("quiet", 1)], "project string, files_scanned long")
    got = {r.project: tuple(r)[1:] for r in ops.scan_summary(rows, scanned).collect()}
    assert got == {"p": (3, 5, 1, 1, 1, 1, 1), "quiet": (1, 0, 0, 0, 0, 0, 0)}
    verdicts = {r.project: (r.blocking, r.blocked) for r in ops.gate(rows, scanned, "CRITICAL").collect()}
    assert verdicts == {"p": (1, True), "quiet": (0, False)}
    assert ops.hook_gate(rows, threshold="nonsense").first().blocking == 2
    files = spark.createDataFrame([("p", "v.py"), ("p", "clean.py")], "project string, path string")
    assert {r.file: r.total_findings for r in ops.file_results(rows, files).collect()} == {"v.py": 5, "clean.py": 0}


def test_baseline(spark):
    rows = ops.deduplicate(frame(spark, finding(0), finding(1, line=50), finding(2, title="New"), finding(3, title=None), finding(4, project="q")))
    old = frame(spark, finding(9, line=999), finding(8, title=None))
    assert sorted(r.item_index for r in ops.without_known(rows, old).collect()) == [2, 4]
    counts = {r.project: (r.suppressed, r.remaining) for r in ops.suppressed_counts(ops.flag_known(rows, old)).collect()}
    assert counts == {"p": (3, 1), "q": (0, 1)}


def chunks(spark):
    files = spark.createDataFrame([("p", "a.py", "def f():\n    pass"), ("q", "b.js", "let x")], "project string, path string, content string")
    return chunk_text(files)


def test_prompt_content(spark):
    contexts = spark.createDataFrame([("p", "CONTEXT OF P")], "project string, context string")
    got = {r.project: r for r in build_prompts(chunks(spark), contexts, extra_context=F.lit("why")).collect()}
    prompt = got["p"].prompt
    assert prompt.startswith("CONTEXT OF P\n\n=== REVIEWING FILE ===\nFile: a.py\nLanguage: python\nContext: why\n\n=== CODE ===\ndef f():\n    pass\n\n")
    assert all(h in prompt for h in catalogues.HINTS.values())
    assert got["q"].prompt.startswith("=== REVIEWING FILE ===\nFile: b.js\nLanguage: javascript\n")
    chosen = build_prompts(chunks(spark), contexts, "LOGIC_FLAW,nonsense,IDOR").first().prompt
    assert chosen.index(catalogues.HINTS["LOGIC_FLAW"]) < chosen.index(catalogues.HINTS["IDOR"])
    assert catalogues.HINTS["JWT_ISSUE"] not in chosen and "Context:" not in chosen
    diff = build_prompts(chunks(spark).withColumn("is_diff", F.lit(True)), contexts).first().prompt
    assert "=== REVIEWING DIFF ===" in diff
    assert catalogues.hint_texts(["nothing"]) == [] and all(c in SYSTEM_PROMPT for c in vocab.VULN_CLASSES)


def test_salted_lookup_gives_the_same_prompts(spark, monkeypatch):
    from auditweave.operators import prompts as module

    contexts = spark.createDataFrame([("p", "C")], "project string, context string")
    plain = {tuple(r) for r in build_prompts(chunks(spark), contexts).collect()}
    monkeypatch.setattr(module, "MAX_BROADCAST_CONTEXTS", 0)
    assert {tuple(r) for r in build_prompts(chunks(spark), contexts).collect()} == plain


def failing_client():
    def call(system, prompt):
        if "b.js" in prompt:
            raise RuntimeError("down")
        return " " + json.dumps([item(file="")]) + "\n"

    return call


def test_review_retries_resumes_and_replays(spark, tmp_path):
    prompts = build_prompts(chunks(spark), ctx.rendered_contexts(ctx.empty_snapshot(chunks(spark).select("project"))))
    twice = prompts.unionByName(prompts.withColumn("project", F.lit("copy")))
    path = str(tmp_path / "answers")
    responses = rv.review_to_table(twice, rv.per_prompt(failing_client, SYSTEM_PROMPT), path, tasks=2)
    rows = responses.collect()
    assert sorted((r.attempt, r.response is None) for r in rows) == [(1, False), (1, True), (2, True), (3, True)]
    assert rv.pending(twice, responses).count() == 0
    progress = Observation("answers")
    rv.observed(responses, progress).write.format("noop").mode("overwrite").save()
    assert progress.get == {"answered": 1, "failed": 3}
    run_id = rows[0].run_id
    rv.review_to_table(twice, rv.per_prompt(failing_client, SYSTEM_PROMPT), path, run_id=run_id)
    assert rv.read_responses(spark, path).count() == 4
    # A later run asks the failed prompt again, and only that.
    rv.review_to_table(twice, rv.per_prompt(failing_client, SYSTEM_PROMPT), path, run_id="later")
    later = rv.read_responses(spark, path).filter("run_id = 'later'").collect()
    assert sorted((r.attempt, r.response) for r in later) == [(4, None), (5, None), (6, None)]
    assert rv.review_errors(twice, rv.read_responses(spark, path), run_id="later").count() == 2
    errors = rv.review_errors(twice, responses).collect()
    assert {(r.project, r.attempts, r.error) for r in errors} == {("q", 3, "down"), ("copy", 3, "down")}
    found = scan.findings_of(rv.replay(twice, responses)).collect()
    assert {(r.project, r.file, r.line_start) for r in found} == {("p", "a.py", 5), ("copy", "a.py", 5)}


def test_chunks_of_one_prompt_keep_their_own_answers(spark):
    """Files and diffs with equal prompts: each chunk's stored answer reaches that chunk, in any order of the rows."""
    for carry, by in (((), rv.CHUNK_KEYS), (rv.DIFF_CARRY, rv.DIFF_CHUNK_KEYS)):
        chunks = spark.range(40).select(
            F.lit("p").alias("project"), *[(F.col("id") % 2).alias(c) for c in carry], F.lit("a.py").alias("file_path"),
            F.col("id").cast("int").alias("chunk_index"), (F.col("id") * 10 + 1).alias("line_start"), F.lit("same").alias("prompt_id"))
        answered = chunks.select("prompt_id", *by, F.lit(1).alias("attempt"), F.concat(F.lit("a"), F.col("chunk_index").cast("string")).alias("response"))
        got = rv.replay(chunks, answered, carry, by).collect()
        assert sorted((r.chunk_index, r.response) for r in got) == [(i, f"a{i}") for i in range(40)]


def test_answers_of_one_attempt_are_taken_alike_in_every_order(spark):
    rows = [("x", 1, f"r{i}", None) for i in range(9)]
    for given in (rows, rows[::-1]):
        assert [r.response for r in rv.answers(spark.createDataFrame(given, vocab.RESPONSES).coalesce(1)).collect()] == ["r8"]


def test_a_job_that_dies_keeps_finished_buckets(spark, tmp_path):
    files = spark.createDataFrame([("p", f"f{i}.py", 9, f"code {i}") for i in range(24)], vocab.FILES)
    prompts = build_prompts(chunk_text(files), ctx.rendered_contexts(ctx.empty_snapshot(files)))
    path, calls = str(tmp_path / "answers"), tmp_path / "calls"
    calls.mkdir()

    def client():
        def call(system, prompt):
            (calls / uuid.uuid4().hex).touch()
            return "[]"

        return call

    def dying(batches):
        for batch in batches:
            if batch["prompt"].str.contains("code 23").any():
                raise SystemError("lost")
            yield from rv.per_prompt(client, "s")(iter([batch]))

    with pytest.raises(Exception, match="lost"):
        rv.review_to_table(prompts, dying, path, tasks=1, run_id="r", buckets=12)
    before = rv.read_responses(spark, path).count()
    assert 0 < before < 24
    asked = len(list(calls.iterdir()))
    got = rv.review_to_table(prompts, rv.per_prompt(client, "s"), path, run_id="r", buckets=12)
    assert got.count() == 24 and len(list(calls.iterdir())) - asked == 24 - before


def test_few_prompts_read_few_answers(spark, tmp_path):
    path = str(tmp_path / "answers")
    rows = spark.range(300).selectExpr("sha2(cast(id AS string), 256) AS prompt_id", "1 AS attempt", "'[]' AS response", "null AS error", "'r' AS run_id")
    rows.withColumn("prefix", rv._prefix()).write.partitionBy("prefix").parquet(path)
    one = spark.range(1).selectExpr("sha2(cast(id AS string), 256) AS prompt_id")
    chosen = rv.responses_to(one, path)
    assert chosen.count() == 1
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert "prefix" in filters


def test_diffs_keep_their_scope(spark):
    rows = [("p", d, 0, "x.py", 0, 1, json.dumps([item(file="")])) for d in (1, 2)] + [("p", 2, 1, "x.py", 0, 1, json.dumps([item(file="")]))]
    answered = spark.createDataFrame(rows, "project string, diff_id long, file_seq int, file_path string, chunk_index int, line_start int, response string")
    found = scan.findings_of(answered, diffs=True)
    assert sorted((r.diff_id, r.file_seq) for r in found.collect()) == [(1, 0), (2, 0)]
    assert found.select("finding_id").distinct().count() == 2
    verdicts = ops.gate(found, answered, "INFO", scan.DIFF_SCOPE).collect()
    assert sorted((r.diff_id, r.blocking) for r in verdicts) == [(1, 1), (2, 1)]
    assert scan.findings_of(answered).count() == 1


def test_only_contexts_of_the_batch_are_sent(spark, tmp_path):
    ctx.empty_snapshot(spark.range(5000).selectExpr("concat('p', id) AS project")).write.parquet(str(tmp_path / "s"))
    snapshot = spark.read.parquet(str(tmp_path / "s"))
    files = spark.createDataFrame([("p7", "a.py", 9, "x\n" * 20)], vocab.FILES)
    plan = scan.scan_prompts(files, snapshot)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
    assert scan.contexts_of(snapshot, files.select("project")).count() == 1


def test_whole_scan_and_explain(spark, tmp_path):
    body = "\n".join(f"line {i}" for i in range(12))
    rows = [("p", "a.py", len(body), body), ("p", "short.py", 3, "x\ny"), ("p", "a.md", len(body), body)]
    files = spark.createDataFrame(rows, vocab.FILES)
    prompts = scan.scan_prompts(files, ctx.build_snapshot(files))
    assert [r.file_path for r in prompts.collect()] == ["a.py"]
    answers = rv.review_to_table(prompts, rv.per_prompt(failing_client, SYSTEM_PROMPT), str(tmp_path / "r"))
    found = scan.findings_of(rv.replay(prompts, answers))
    wanted = found.select("finding_id")
    request = scan.explain(found, wanted).first()
    assert '"title":"Missing check"' in request.prompt and "## Verification" in request.prompt
    assert explain_prompts(found).count() == 1 and ops.available_ids(found).count() == 1
    diff = spark.createDataFrame([("p", 1, "--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n-a\n+b\n")], "project string, diff_id long, diff_text string")
    got = scan.diff_prompts(diff, ctx.empty_snapshot(diff), extra_context=F.lit("ticket")).first()
    assert (got.project, got.diff_id, got.file_path) == ("p", 1, "x.py") and "Context: ticket" in got.prompt
