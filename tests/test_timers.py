import functools
import json
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from auditweave import vocab
from auditweave.operators import context as ctx
from auditweave.plans import review as rv
from auditweave.streaming import timers, watch
from tests.test_reviews import item
from tests.test_streaming import change, put, stream, table, wait_for


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, timers.ROCKSDB)
    yield spark
    spark.conf.set(key, before)


def to_table(fired, folder, stop=False, **options):
    """Run what is there to the end and append the runs that fire to a table."""
    query = fired.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
    query = query.trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(120)
    finally:
        query.stop()


def in_order(rows):
    return sorted((r.project, r.path, r.first_change, r.last_change, r.fires_at, r.changes) for r in rows)


def test_runs_of_a_batch_and_their_merge():
    import numpy as np
    assert timers.runs_of(np.array([5, 1, 20, 12]), 7, 0) == [(1, 12, 3, 0), (20, 20, 1, 0)]
    assert timers.merged([(20, 20, 1, 3), (1, 5, 2, 9), (12, 13, 1, 1)], 7) == [(1, 20, 4, 9)]


def test_replayed_log_equals_history_over_restarts(rocksdb, tmp_path):
    spark, folder = rocksdb, str(tmp_path / "in")
    os.mkdir(folder)
    rng = random.Random(4)
    rows = [change(rng.randint(0, 60_000) / 1000, path="hot.py" if rng.random() < 0.4 else f"f{rng.randint(0, 4)}.py") for _ in range(400)]
    rows.sort(key=lambda r: r[2].timestamp() + rng.random())  # out of order by up to a second
    end = change(1000, path="end.py")
    for n in range(2):
        put(spark, folder, f"{n}.json", n, *rows[n * 200 : (n + 1) * 200])
        fired = timers.debounce_timers(stream(spark, folder), lateness="3 seconds")
        to_table(fired, str(tmp_path))  # each run goes on from the state of the last
    put(spark, folder, "2.json", 2, end)
    to_table(timers.debounce_timers(stream(spark, folder), lateness="3 seconds"), str(tmp_path))
    got = spark.read.parquet(str(tmp_path / "out"))
    want = watch.debounce_history(table(spark, *rows))
    assert in_order(got.collect()) == in_order(want.collect())
    state = spark.read.format("statestore").option("stateVarName", "open").load(str(tmp_path / "checkpoint"))
    assert state.select(F.col("key.path")).distinct().collect() == [("end.py",)]  # what fired left no state


def test_arrivals_fire_without_a_watermark(rocksdb, tmp_path):
    spark, folder, name = rocksdb, str(tmp_path / "in"), f"timers_{uuid.uuid4().hex}"
    os.mkdir(folder)
    put(spark, folder, "0.json", 0, change(0), change(500), change(3, path="b.py"))
    fired = timers.debounce_timers(stream(spark, folder), quiet="2 seconds", clock="arrivals")
    query = fired.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        wait_for(lambda: spark.table(name).count() == 2, 60)
        assert sorted((r.path, r.changes) for r in spark.table(name).collect()) == [("a.py", 2), ("b.py", 1)]
        put(spark, folder, "1.json", 1, change(-9000))  # however old: a change that arrives is reviewed
        wait_for(lambda: spark.table(name).count() == 3, 60)
    finally:
        query.stop()


def test_watch_reviews_without_waiting_for_the_watermark(rocksdb, tmp_path):
    spark, folder, out = rocksdb, str(tmp_path / "in"), str(tmp_path / "out")
    os.mkdir(folder)
    files = spark.createDataFrame([(p, "a.py", 20, "def f():\n    pass\n") for p in ("p", "never")], vocab.FILES)

    def client():
        return lambda system, prompt: json.dumps([item(file="", severity="HIGH")])

    put(spark, folder, "0.json", 0, change(0), change(0.1))
    query = watch.watch(
        stream(spark, folder), lambda projects: files.join(projects, "project", "left_semi"), lambda projects: ctx.empty_snapshot(files),
        rv.per_prompt(client, "s"), out, name=f"timed-{uuid.uuid4().hex}", lateness="1 hour",
        runs_of=functools.partial(timers.debounce_timers, clock="arrivals"),
    ).start()
    try:
        def reviewed():
            paths = os.path.isdir(f"{out}/runs") and [d for d in os.listdir(f"{out}/runs") if os.path.exists(f"{out}/runs/{d}/_SUCCESS")]
            return bool(paths) and watch.read_watch(spark, out, "runs").count() == 1

        wait_for(reviewed, 90)
    finally:
        query.stop()
    assert [(r.project, r.file) for r in watch.read_watch(spark, out, "findings").collect()] == [("p", "a.py")]


def test_other_clocks_are_refused(spark):
    with pytest.raises(ValueError):
        timers.debounce_timers(table(spark, change(0)), clock="sun")
