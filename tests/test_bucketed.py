import threading
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from auditweave.operators import findings as ops
from auditweave.plans import review as rv
from auditweave.sinks import bucketed

KEYS = "project string, vuln_class string, file string, title string"


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def marks(spark, *rows):
    return spark.createDataFrame(list(rows), KEYS)


def above_scans(df):
    """Operators above each scan of a table in buckets in the executed plan, from the root down."""
    df.collect()
    found = []

    def walk(node, names):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan(), names)
        if name.endswith("QueryStage"):
            return walk(node.plan(), names)
        if name.startswith("Scan") and "bucketed_" in name:
            found.append(names)
        for i in range(node.children().size()):
            walk(node.children().apply(i), [*names, name])

    walk(df._jdf.queryExecution().executedPlan(), [])
    return found


@pytest.mark.parametrize("buckets", [3, 8, 20])
def test_the_stored_side_is_not_moved(spark, no_broadcast, tmp_path, buckets):
    path = str(tmp_path / "it's a table")
    rows = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("prompt_id"), F.lit(1).alias("attempt"), F.lit("a").alias("response"))
    bucketed.write_answers(rows, path, buckets)
    wanted = spark.range(0, 6000, 7).select(F.concat(F.lit("k"), "id").alias("prompt_id"))
    hot = wanted.union(spark.range(4000).select(F.lit("k7").alias("prompt_id")))
    found = bucketed.answers_for(hot, path)
    assert sorted(r.prompt_id for r in found.collect()) == sorted(f"k{i}" for i in range(0, 3000, 7))
    (above,) = above_scans(found)
    assert not [name for name in above if "Exchange" in name]
    assert len([f for f in (tmp_path / "it's a table" / "rows").iterdir() if f.suffix == ".parquet"]) <= buckets


def test_baseline_in_buckets_marks_the_same(spark, no_broadcast, tmp_path):
    known = marks(spark, ("p", "IDOR", "a.py", "t"), ("p", "IDOR", "a.py", "t"), ("p", None, "a.py", None), (None, "", "", ""))
    later = marks(spark, ("p", "IDOR", "a.py", "t"), ("q", "IDOR", "a.py", "t"))
    rows = [("p", "IDOR", "a.py", "t"), ("p", "", "a.py", None), ("q", "IDOR", "a.py", "t"), ("r", "IDOR", "a.py", "t"),
            (None, None, None, None), ("p", "IDOR", "a.py", "T")]
    found = marks(spark, *rows)
    path = str(tmp_path / "b")
    bucketed.write_baseline(known, path, 4)
    bucketed.add_to_baseline(later, path)
    assert bucketed.read_bucketed(spark, path).count() == 4
    stored = bucketed.baseline_for(found, path)
    for of in (ops.without_known, lambda f, b: ops.flag_known(f, b)):
        assert sorted(map(str, of(found, stored).collect())) == sorted(map(str, of(found, known.union(later)).collect()))


def test_empty_tables_other_sessions_and_taken_folders(spark, tmp_path):
    path = str(tmp_path / "b")
    bucketed.write_baseline(marks(spark), path, 4)
    found = marks(spark, ("p", "IDOR", "a.py", "t"))
    assert bucketed.baseline_for(found, path).count() == 0
    with pytest.raises(FileExistsError):
        bucketed.write_baseline(found, path, 4)
    bucketed.add_to_baseline(found, path)
    assert bucketed.baseline_for(marks(spark), path).count() == 0
    other = spark.newSession()
    assert [tuple(r) for r in bucketed.read_bucketed(other, path).collect()] == [("p", "IDOR", "a.py", "t")]
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]


def test_odd_names_and_types(spark, tmp_path):
    path = str(tmp_path / "b")
    rows = spark.sql("SELECT 'a' AS `k.1`, array(named_struct('x y', 1)) AS `v``2`, CAST(NULL AS decimal(9,2)) AS project")
    bucketed.write_bucketed(rows, path, ["k.1"], 2)
    bucketed.append_bucketed(rows, path)
    again = bucketed.read_bucketed(spark, path)
    assert again.schema.simpleString() == rows.schema.simpleString()
    assert bucketed.rows_for(path, rows.select("`k.1`")).collect() == rows.union(rows).collect()


def test_calls_in_flight_are_bounded(spark):
    lock, state = threading.Lock(), {"now": 0, "most": 0, "clients": 0}

    def client():
        state["clients"] += 1

        def call(system, prompt):
            with lock:
                state["now"] += 1
                state["most"] = max(state["most"], state["now"])
            time.sleep(0.02)
            with lock:
                state["now"] -= 1
            if prompt == "p5":
                raise RuntimeError()
            return f" {prompt} "

        return call

    def batch(first):
        ids = [f"p{i}" for i in range(first, first + 12)]
        return pd.DataFrame({"prompt_id": ids, "attempt": 1, "prompt": ids})

    for workers in (1, 4):
        state["most"] = 0
        out = pd.concat(rv.per_prompt(client, "s", workers)(iter([batch(0), batch(12)])))
        assert state["most"] == workers
        assert list(out["prompt_id"]) == [f"p{i}" for i in range(24)]
        assert list(out["response"].fillna("-")) == ["-" if i == 5 else f"p{i}" for i in range(24)]
        assert list(out["error"].dropna()) == ["RuntimeError"]
    assert state["clients"] == 2


def test_slots_are_cores_of_a_task():
    profile = rv.call_slots(3)
    assert profile.taskResources["cpus"].amount == 3.0
