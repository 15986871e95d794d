"""Prefix trie of conversations, with subtree totals by time-forward processing."""

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditweave.llm.base import Scratch
from auditweave.plans.joins import stored

WORD = r"[^\x20\x09-\x0D]+"
FAMILY = 20
HEADS = 4
#: Turns whose running sums are made in one window.
BLOCK_TURNS = 1_024
#: Conversations below the root of a shard, at most; nodes with more are in shards of ``FANOUT`` times as many.
SHARD_CONVS = 4_096
FANOUT = 1_024
ROOT = "root"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def ordered(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The turns in order, as (conv_id, part, at, one, two, words), and their runs (conv_id, part, first, before, n).

    A turn is its two hashes of role and text. All turns are range-partitioned, so a conversation with any
    share of the rows lies in many parts; a turn's place is ``at - first + before`` of its run.
    """
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).where("conv_id IS NOT NULL")
    by = ("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    rows = scratch.stored(rows.select(
        "conv_id", F.shiftright("at", 33).alias("part"), "at", F.xxhash64(F.lit(1), "role", "text").alias("one"),
        F.xxhash64(F.lit(2), "role", "text").alias("two"), F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("words")), "turns")
    runs = rows.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return rows, scratch.stored(runs.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "runs")


def rebuilt(turns: DataFrame, scratch: Scratch, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as the first of their family does, as rows of turns and (conv_id, length).

    Conversation c takes the first h = crc32(c) % ``heads`` turns of c - c % ``family`` and its own turns after
    its first h. Rows: conv_id, depth (from 1), one, two, words, last (whether it ends there).
    """
    rows, runs = ordered(turns, scratch)
    convs = runs.groupBy("conv_id").agg(F.sum("n").alias("n"))
    lead = F.col("conv_id") - F.col("conv_id") % family
    convs = convs.select("conv_id", "n", lead.alias("lead"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h"))
    leads = convs.where("conv_id = lead").select("lead", F.col("n").alias("lead_n"))
    convs = convs.join(leads, "lead", "left").withColumn("head", F.least("h", F.coalesce("lead_n", F.lit(0))))
    convs = scratch.stored(convs.withColumn("length", F.col("head") + F.greatest(F.lit(0), F.col("n") - F.col("h"))), "conversations")
    facts = runs.join(convs.select("conv_id", "h", "head", "length"), "conv_id").drop("n")
    placed = rows.join(scratch.stored(facts, "runs"), ["conv_id", "part"]).withColumn("place", F.col("at") - F.col("first") + F.col("before"))
    placed = scratch.stored(placed.select("conv_id", "place", "h", "head", "length", "one", "two", "words"), "placed")
    own = placed.where("place >= h").withColumn("depth", F.col("head") + F.col("place") - F.col("h") + 1)
    begins = placed.where((F.col("place") < heads - 1) & (F.col("conv_id") % family == 0))
    begins = begins.select(F.col("conv_id").alias("lead"), "place", "one", "two", "words")
    taken = convs.join(begins, "lead").where("place < h").withColumn("depth", F.col("place") + 1)
    columns = ["conv_id", "depth", "one", "two", "words", (F.col("depth") == F.col("length")).alias("last")]
    return own.select(*columns).union(taken.select(*columns)), convs.select("conv_id", "length")


def paths(rows: DataFrame, scratch: Scratch, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """(conv_id, depth, node, parent, words, last): the nodes that each conversation passes.

    A node is named by the sums of two hashes of (depth, turn) over its turns. Sums run in blocks of depths and
    then over the blocks, so a conversation of any length is spread over tasks.
    """
    for sum_, hashed in (("one", F.xxhash64(F.lit(1), "depth", "one", "two")), ("two", F.xxhash64(F.lit(2), "depth", "two", "one"))):
        rows = rows.withColumn(f"own_{sum_}", hashed.cast("decimal(20,0)"))
    rows = rows.withColumn("block", F.floor((F.col("depth") - 1) / block_turns)).drop("one", "two")
    rows = scratch.stored(rows, "hashed")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    later = rows.select("conv_id").where("block > 0").distinct()
    sums = rows.join(later, "conv_id", "left_semi").groupBy("conv_id", "block").agg(F.sum("own_one").alias("one"), F.sum("own_two").alias("two"))
    carried = sums.select("conv_id", "block", *[F.sum(c).over(before).cast("decimal(38,0)").alias(f"before_{c}") for c in ("one", "two")])
    carried = scratch.stored(carried.where("block > 0"), "carried")
    within = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(carried, ["conv_id", "block"], "left")
    none = F.lit(0).cast("decimal(38,0)")
    now = {c: F.sum(f"own_{c}").over(within) + F.coalesce(f"before_{c}", none) for c in ("one", "two")}
    rows = rows.select("conv_id", "depth", "words", "last", "own_one", "own_two", *[s.alias(c) for c, s in now.items()])

    def name(depth: Column, one: Column, two: Column) -> Column:
        return F.md5(F.concat_ws(":", depth, one, two).cast("binary"))

    node = name(F.col("depth"), F.col("one"), F.col("two"))
    parent = name(F.col("depth") - 1, F.col("one") - F.col("own_one"), F.col("two") - F.col("own_two"))
    parent = F.when(F.col("depth") == 1, F.lit(ROOT)).otherwise(parent)
    return scratch.stored(rows.select("conv_id", "depth", node.alias("node"), parent.alias("parent"), "words", "last"), "paths")


def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Subtree totals of the nodes of each shard, which come deepest level first and by name within a level.

    Time-forward processing: a node sends its totals to its parent through a priority queue that is ordered
    as the nodes are, and takes what was sent to it from the head. A level of a shard has disjoint nodes
    of at least two conversations each, or of a fan-out-th of the shard's, so the queue holds no more
    messages than half the shard's conversations, or its fan-out; the nodes themselves are sorted by Spark.
    """
    queue, names = [], ["node", "parent", "leaves", "saved", "top"]
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            place, leaves, saved = (-row["depth"], row["node"]), row["leaves"], row["saved"]
            while queue and queue[0][:2] == place:
                _, _, more, kept = heapq.heappop(queue)
                leaves, saved = leaves + more, saved + kept
            top = row["node"] == row["shard"]
            if not top:
                heapq.heappush(queue, (1 - row["depth"], row["parent"], leaves, saved))
            out.append((row["node"], row["parent"], leaves, saved, top))
        if out:
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def totals(nodes: DataFrame, steps: DataFrame, members: int, scratch: Scratch, shard_convs: int = SHARD_CONVS, fanout: int = FANOUT) -> DataFrame:
    """(node, leaves, saved) of the subtrees of all ``nodes`` with at least two conversations.

    A shard is a part of the trie whose root has at most ``shard_convs`` conversations and whose parent has more.
    Each is swept in one task, then the nodes above are, in shards of ``fanout`` times as many conversations,
    with the totals of the roots below as messages; and so on up to the root of the trie.
    """
    limits = [shard_convs]
    while limits[-1] < members:
        limits.append(limits[-1] * fanout)
    level = F.lit(len(limits) - 1)
    for i in reversed(range(len(limits) - 1)):
        level = F.when(F.col("n_convs") <= limits[i], F.lit(i)).otherwise(level)
    shared = nodes.where("n_convs > 1").withColumn("level", level)
    above = shared.select(F.col("node").alias("parent"), F.col("level").alias("level_above"))
    shared = scratch.stored(shared.join(above, "parent", "left").select(
        "node", "parent", "conv_id", "depth", "level", "level_above", F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("own")), "shared")
    # On the way of a conversation each level begins once, so its top there is the shard of what follows.
    tops = shared.where("level <> level_above").select("node", "level")
    tops = scratch.stored(steps.join(tops, "node").select("conv_id", "level", F.col("node").alias("shard")), "shards")
    shared = scratch.stored(shared.join(tops, ["conv_id", "level"], "left").withColumn("shard", F.coalesce("shard", F.lit(ROOT))), "sharded")
    sent = nodes.where("n_convs = 1").groupBy("parent").agg(F.count(F.lit(1)).alias("sent_leaves")).withColumn("sent_saved", F.lit(0).cast("bigint"))
    done = None
    for i in range(len(limits)):
        rows = shared.where(F.col("level") == i).join(sent.withColumnRenamed("parent", "node"), "node", "left")
        rows = rows.select("shard", "depth", "node", "parent", (F.col("leaf") + F.coalesce("sent_leaves", F.lit(0))).alias("leaves"),
                           (F.col("own") + F.coalesce("sent_saved", F.lit(0))).alias("saved"))
        rows = rows.repartition("shard").sortWithinPartitions("shard", F.desc("depth"), "node")
        found = scratch.stored(rows.mapInArrow(swept, "node string, parent string, leaves bigint, saved bigint, top boolean"), "totals")
        ups = found.where("top").groupBy("parent").agg(F.sum("leaves").alias("sent_leaves"), F.sum("saved").alias("sent_saved"))
        sent = sent.union(ups).groupBy("parent").agg(F.sum("sent_leaves").alias("sent_leaves"), F.sum("sent_saved").alias("sent_saved"))
        sent = scratch.stored(sent, "sent")
        done = found if done is None else done.union(found)
    return done.select("node", "leaves", "saved")


def _joined_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each node, joined by commas; rows are sorted and no list is held."""
    now, state = None, None
    for batch in batches:
        out = []
        for node, conv in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()):
            if node == now:
                state.update(b",%d" % conv)
                continue
            if now is not None:
                out.append((now, state.hexdigest()))
            now, state = node, hashlib.sha256(b"%d" % conv)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["node", "ends"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], names=["node", "ends"])


def prefix_trie(turns: DataFrame, family: int = FAMILY, heads: int = HEADS, shard_convs: int = SHARD_CONVS, fanout: int = FANOUT,
                block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations of ``turns`` (conv_id, turn, role, text).

    Columns conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256; see :func:`rebuilt` for what a conversation begins with. A node's conversations are
    counted by partial aggregates and its totals come from :func:`totals`. The hash of the ids that end in a
    node reads them in their order, so a node's ids pass through one task, one at a time.

    Nulls: turns of a null conv_id take no part, null turns come first, a null role or text is empty.
    Ties: rows of one turn are in the order of role and text; repeated rows are turns of their own.
    A conversation without turns left is a member of the root. Empty table: no rows, not even a root.
    Other columns are not read.
    """
    scratch = Scratch(turns.sparkSession)
    rows, convs = rebuilt(turns, scratch, family, heads)
    steps = paths(rows, scratch, block_turns)
    nodes = steps.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("words").alias("words"),
        F.count(F.lit(1)).alias("n_convs"), F.count_if("last").alias("n_ends"), F.min(F.when(F.col("last"), F.col("conv_id"))).alias("end"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.count_if(F.col("length") == 0).alias("n_ends"),
                     F.min(F.when(F.col("length") == 0, F.col("conv_id"))).alias("end")).where("n_convs > 0")
    root = root.select(F.lit(ROOT).alias("node"), "conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("string").alias("parent"),
                       F.lit(0).cast("bigint").alias("words"), "n_convs", "n_ends", "end")
    nodes = scratch.stored(nodes.select(*root.columns).union(root), "nodes")
    children = nodes.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children")).where("node IS NOT NULL")
    nodes = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = scratch.stored(nodes, "nodes")
    found = totals(nodes, steps.select("conv_id", "node"), convs.count(), scratch, shard_convs, fanout)
    ends = steps.where("last").select("node", "conv_id").union(convs.where("length = 0").select(F.lit(ROOT).alias("node"), "conv_id"))
    many = ends.join(nodes.where("n_ends > 1").select("node"), "node", "left_semi")
    many = many.repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(_joined_hashes, "node string, ends string")
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    hashed = F.when(F.col("n_ends") == 0, F.lit(NO_ENDS)).when(F.col("n_ends") == 1, F.sha2(F.col("end").cast("string").cast("binary"), 256))
    out = nodes.join(scratch.stored(found, "found"), "node", "left").join(scratch.stored(many, "ends"), "node", "left").join(above, "parent", "left")
    out = stored(out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("leaves", F.lit(1)).alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).alias("saved_tokens"), hashed.otherwise(F.col("ends")).alias("ends_sha256")), "trie")
    scratch.drop()
    return out
