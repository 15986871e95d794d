"""Run registered queries and their SQL side by side and compare the rows."""

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def database(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir, function, sql):
    """None if equal, else a description of the difference."""
    got = function(spark, sf_dir)
    left = _rows(got.columns, [tuple(r) for r in got.collect()])
    relation = con.sql(sql)
    right = _rows(relation.columns, relation.fetchall())
    if sorted(got.columns) != sorted(relation.columns):
        return f"columns {sorted(got.columns)} != {sorted(relation.columns)}"
    if left != right:
        return (
            f"{sum(left.values())} rows vs {sum(right.values())}; only ours {list((left - right).items())[:2]}; "
            f"only SQL {list((right - left).items())[:2]}"
        )
    return None if left else "no rows"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
    import __spark_entry__ as entry

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = database(sf_dir)
    sqls = entry.oracle_sql()
    for name, function in entry.queries().items():
        if names and name not in names:
            continue
        begin = time.time()
        try:
            if name in sqls:
                result = compare(spark, con, sf_dir, function, sqls[name]) or "ok"
            else:
                result = f"rows only: {function(spark, sf_dir).count()}"
        except Exception as failure:
            result = "FAILED " + str(failure)[:1500]
        print(f"{name:28s} {time.time() - begin:6.2f}s {result}", flush=True)
