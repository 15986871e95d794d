"""Connected components of links between numbers, by large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditweave.llm.base import Scratch
from auditweave.plans.joins import stored

ROUNDS = 60


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star round: neighbours of a node are linked to the smallest number that it knows.

    The large star moves a node's greater neighbours, the small star itself and its smaller ones. The
    smallest number is a partial aggregate and comes back by a join, so no node's links meet in a list.
    """
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    moved = near.join(least, "a")
    if large:
        out = moved.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("least").alias("b")).union(moved.select("a", F.col("least").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b: bigint); a component is its smallest node.

    Null ends and links of a node to itself are ignored; an empty table gives no rows. Each round is
    written to the shared folder, so the plan stays short and a lost executor costs one round. A round
    is deleted as soon as the next one is written.
    """
    spark = links.sparkSession
    before = Scratch(spark)
    links = before.stored(links.where("a <> b").distinct(), "links")
    state = None
    for _ in range(rounds):
        after = Scratch(spark)
        links = after.stored(_star(_star(links, large=True), large=False), "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        before.drop()
        before = after
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = stored(ends.union(ends.select(F.col("component").alias("node"), "component")).distinct(), "components")
    before.drop()
    return found
