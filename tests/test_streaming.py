import datetime as dt
import json
import os
import random
import time
import uuid

from pyspark.sql import functions as F

from auditweave import vocab
from auditweave.operators import context as ctx
from auditweave.plans import review as rv
from auditweave.streaming import watch
from tests.test_reviews import item

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def change(seconds, path="a.py", size=100, kind="modified", directory=False, project="p"):
    return (project, path, START + dt.timedelta(seconds=seconds), size, kind, directory)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), vocab.CHANGES)


def wait_for(condition, seconds=30):
    end = time.monotonic() + seconds
    while not condition() and time.monotonic() < end:
        time.sleep(0.5)
    assert condition()


def test_admission_of_changes(spark):
    rows = table(
        spark, change(0), change(1, kind="created"), change(2, kind="deleted"), change(3, directory=True), change(4, size=49), change(5, size=50),
        change(6, path="a.txt"), change(7, path="build/a.py"), change(8, kind="moved"), change(9, size=900_000),
    )
    got = {(r.ts.replace(tzinfo=dt.timezone.utc) - START).seconds for r in watch.admitted_changes(rows).collect()}
    assert got == {0, 1, 5, 9}


def test_runs_inside_at_and_beyond_the_quiet_time(spark):
    rows = table(spark, change(0), change(0.5), change(1.3), change(2.1), change(2.901), change(0, path="b.py"))
    for runs in (watch.debounce(rows), watch.debounce_history(rows)):
        got = sorted((r.path, r.changes) for r in runs.collect())
        assert got == [("a.py", 1), ("a.py", 4), ("b.py", 1)]
    first = watch.debounce(rows).filter("changes = 4").first()
    assert first.last_change - first.first_change == dt.timedelta(seconds=2.1)
    assert first.fires_at - first.last_change == dt.timedelta(seconds=0.8)


def test_history_equals_sessions_with_a_hot_path(spark):
    rng = random.Random(2)
    rows = [change(rng.randint(0, 600_000) / 1000, path="hot.py" if rng.random() < 0.4 else f"f{rng.randint(0, 9)}.py") for _ in range(3000)]
    log = table(spark, *rows)
    assert {tuple(r) for r in watch.debounce(log).collect()} == {tuple(r) for r in watch.debounce_history(log).collect()}


def put(spark, folder, name, second, *rows):
    """One file per micro-batch, with increasing modification times."""
    path = os.path.join(folder, name)
    with open(path, "w") as out:
        for project, file, ts, size, kind, directory in rows:
            out.write(json.dumps({"project": project, "path": file, "ts": ts.strftime("%Y-%m-%dT%H:%M:%S.%fZ"), "size_bytes": size, "kind": kind, "is_directory": directory}) + "\n")
    os.utime(path, (1_700_000_000 + second, 1_700_000_000 + second))


def stream(spark, folder):
    return spark.readStream.schema(vocab.CHANGES).option("maxFilesPerTrigger", 1).json(folder)


def test_watch_reviews_changed_files(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    os.mkdir(folder)
    body = "def f():\n    pass\n"
    files = spark.createDataFrame([("p", "a.py", 20, body), ("p", "b.py", 20, body), ("p", "never.py", 20, body)], vocab.FILES)
    asked, name = [], f"watch-{uuid.uuid4().hex}"

    def client():
        def call(system, prompt):
            return json.dumps([item(file="", severity="LOW" if "b.py" in prompt else "HIGH", confidence="LOW")])

        return call

    def current(projects):
        asked.append([r.project for r in projects.collect()])
        return files.join(projects, "project", "left_semi")

    def run():
        writer = watch.watch(
            stream(spark, folder), current, lambda projects: ctx.empty_snapshot(files), rv.per_prompt(client, "s"), out,
            name=name, lateness="0 seconds", severity="MEDIUM",
        )
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        return query

    put(spark, folder, "1.json", 1, change(0), change(0.4), change(0.5, path="b.py"), change(0.5, path="c.txt"))
    put(spark, folder, "2.json", 2, change(100), change(100, path="b.py"))
    put(spark, folder, "3.json", 3, change(300, path="a.py"))
    put(spark, folder, "4.json", 4, change(1, path="a.py"))
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "1")
    listener = watch.LateRows(spark, out, name)
    spark.streams.addListener(listener)
    assert watch.late_rows(spark, out) == 0
    run()
    wait_for(lambda: watch.late_rows(spark, out) == 1)
    spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    scans, found = watch.read_watch(spark, out, "scans"), watch.read_watch(spark, out, "findings")
    totals = watch.watch_totals(scans, found).first()
    assert (totals.project, totals.files_scanned, totals.findings) == ("p", 4, 2)
    assert {r.file for r in found.collect()} == {"a.py"}
    answers = rv.read_responses(spark, f"{out}/responses").collect()
    assert sorted((r.attempt, r.error) for r in answers) == [(1, None), (1, None)], answers  # each content is asked once
    put(spark, folder, "5.json", 5, change(1000, path="a.py"))
    run()  # goes on from its checkpoint
    totals = watch.watch_totals(watch.read_watch(spark, out, "scans"), watch.read_watch(spark, out, "findings")).first()
    assert (totals.files_scanned, totals.findings) == (5, 3) and {tuple(a) for a in asked} <= {("p",), ()} and ["p"] in asked
    assert watch.late_rows(spark, out) == 1
    spark.streams.removeListener(listener)
    # The late change is in the log, no run has it, and one review of it is enough.
    for _ in range(2):
        watch.keep_changes(stream(spark, folder), out, f"log-{name}").trigger(availableNow=True).start().awaitTermination()
    log = watch.read_watch(spark, out, "changes")
    assert log.count() == 8  # three admitted of the first file, two of the second and one of each other
    late = watch.missed_changes(log, watch.read_watch(spark, out, "runs"), "0 seconds").collect()
    assert [(r.path, r.ts.replace(tzinfo=dt.timezone.utc)) for r in late] == [("a.py", START + dt.timedelta(seconds=1))]
    for turn, more in (("late-1", 1), ("late-1", 1), ("late-2", 0)):
        fired = watch.review_missed(spark, files, ctx.empty_snapshot(files), rv.per_prompt(client, "s"), out, turn, "0 seconds", severity="MEDIUM")
        assert [(r.path, r.changes) for r in fired.collect()] == [("a.py", 1)] * more
    totals = watch.watch_totals(watch.read_watch(spark, out, "scans"), watch.read_watch(spark, out, "findings")).first()
    assert (totals.files_scanned, totals.findings) == (6, 4)


def test_changes_outside_of_every_run_are_missed(spark):
    rows = [change(s) for s in (0, 0.5, 7200.2, 7201, 9000, 20000)] + [change(0.2, path="b.py"), change(0.2, path="b.py"), change(7300, path="b.py")]
    log = table(spark, *rows)
    at = lambda s: START + dt.timedelta(seconds=s)
    # The first run lies in three buckets, the second in one.
    runs = spark.createDataFrame([("p", "a.py", at(0.5), at(7200.2)), ("p", "a.py", at(20000), at(20000))], "project string, path string, first_change timestamp, last_change timestamp")
    got = sorted((r.path, (r.ts.replace(tzinfo=dt.timezone.utc) - START).total_seconds()) for r in watch.missed_changes(log, runs, "1 hour").collect())
    assert got == [("a.py", 0.0), ("a.py", 7201.0), ("a.py", 9000.0), ("b.py", 0.2), ("b.py", 7300.0)]
    assert watch.missed_changes(log.limit(0), runs, "1 hour").count() == 0
    assert watch.missed_changes(log, runs.limit(0), "0 seconds").count() == 7


def test_totals_as_a_stream(spark, tmp_path):
    for name, schema in (("scans", "project string, files_scanned long"), ("findings", "project string")):
        os.mkdir(tmp_path / name)
    spark.createDataFrame([("p", 2), ("q", 1)], "project string, files_scanned long").write.mode("append").json(str(tmp_path / "scans"))
    spark.createDataFrame([("p",), ("p",)], "project string").write.mode("append").json(str(tmp_path / "findings"))
    scans = spark.readStream.schema("project string, files_scanned long").json(str(tmp_path / "scans"))
    found = spark.readStream.schema("project string").json(str(tmp_path / "findings"))
    query = (
        watch.watch_totals(scans, found).writeStream.outputMode("complete").format("memory").queryName("totals")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = {r.project: (r.files_scanned, r.findings) for r in spark.table("totals").select("*", F.lit(1)).collect()}
    assert got == {"p": (2, 2), "q": (1, 0)}
