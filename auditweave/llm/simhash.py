"""SimHash fingerprints and a Gray-order hierarchical index for near duplicates."""

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditweave.llm.base import map_texts, packed_rows, sorted_groups, unpacked_rows
from auditweave.llm.components import components
from auditweave.plans.joins import stored

SHINGLE = 3
BITS = 64
DISTANCE = 2
BLOCK_BITS = 16
SEED = 42
FANOUT = 16
#: Groups of more fingerprints are divided once more; after that a group shares 42 bits at least.
GROUP_ROWS = 20_000


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """The SimHash of a text as a signed 64-bit number.

    A-Z are lower-cased, words are what lies between ASCII white space, and every shingle counts as
    often as it occurs. A bit is set if over half the hashes have it. No words: 0.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False)) if len(tokens) >= words else [b" ".join(tokens)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype=np.uint64)
    counts = np.zeros(BITS, dtype=np.int64)
    for part in np.array_split(hashes, max(1, len(hashes) // 65_536)):
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes)).view(">i8")[0])


def fingerprinted(docs: DataFrame, column: str, name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of ``column`` as a further bigint column ``name``."""
    return map_texts(docs, column, f"{name} bigint", lambda: lambda texts: [pa.array(map(fingerprint, texts), type=pa.int64())])


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the sequence of reflected Gray codes."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def close_pairs(codes: np.ndarray, distance: int = DISTANCE, fanout: int = FANOUT, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of index pairs (i, j) of distinct ``codes`` that differ in at most ``distance`` bits.

    The codes are sorted by Gray rank, so neighbours share bits. Every ``fanout`` neighbours get an upper
    node that factors out the bits in which they all agree (a mask and a pattern), and so on up to one
    root. A pair of nodes is pruned with all below it as soon as the differences of their shared bits
    exceed ``distance``.
    """
    if len(codes) < 2:
        return
    order = np.argsort(gray_rank(codes), kind="stable")
    ands, ors = [codes[order]], [codes[order]]
    while len(ands[-1]) > 1:
        starts = np.arange(0, len(ands[-1]), fanout)
        ands.append(np.bitwise_and.reduceat(ands[-1], starts))
        ors.append(np.bitwise_or.reduceat(ors[-1], starts))
    top = len(ands) - 1
    work = [(top, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
    while work:
        level, left, right = work.pop()
        if len(left) > most:
            half = len(left) // 2
            work += [(level, left[:half], right[:half]), (level, left[half:], right[half:])]
            continue
        shared = ~(ands[level] ^ ors[level])
        apart = np.bitwise_count((ands[level][left] ^ ands[level][right]) & shared[left] & shared[right])
        left, right = left[apart <= distance], right[apart <= distance]
        if level == 0:
            keep = left < right
            if keep.any():
                yield order[left[keep]], order[right[keep]]
        elif len(left):
            size = len(ands[level - 1])
            a = (left[:, None] * fanout + np.arange(fanout)).repeat(fanout, axis=1)
            b = np.tile(right[:, None] * fanout + np.arange(fanout), (1, fanout))
            keep = (a < size) & (b < size) & (a <= b)
            work.append((level - 1, a[keep], b[keep]))


def _stars(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (code, root) that join the same codes as all close pairs of one group."""
    parent = np.arange(len(codes))
    for left, right in close_pairs(codes):
        while True:
            a, b = parent[left], parent[right]
            low, high = np.minimum(a, b), np.maximum(a, b)
            if (low == high).all():
                break
            np.minimum.at(parent, high, low)
            while (parent != parent[parent]).any():
                parent = parent[parent]
    moved = parent != np.arange(len(codes))
    return codes[moved], codes[parent[moved]]


def _group_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Star links of every (mask, pattern) group, one group at a time."""
    for group in sorted_groups(batches, "mask", "pattern"):
        a, b = _stars(np.sort(group.column("fingerprint").to_numpy()).view(np.uint64))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def _masks() -> list[int]:
    """Masks of two of the four 16-bit blocks: with two differing bits, some such pair of blocks is equal."""
    blocks = [((1 << BLOCK_BITS) - 1) << (BLOCK_BITS * i) for i in range(BITS // BLOCK_BITS)]
    return [a | b for a, b in itertools.combinations(blocks, len(blocks) - DISTANCE)]


def _finer(mask: int) -> list[int]:
    """Three masks that each add a third of the free bits: two differing bits leave one third equal."""
    free = [1 << i for i in range(BITS) if not mask >> i & 1]
    return [mask | sum(free[i :: DISTANCE + 1]) for i in range(DISTANCE + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _exploded(codes: DataFrame, masks: Column) -> DataFrame:
    rows = codes.select("fingerprint", F.explode(masks).alias("mask"))
    return rows.withColumn("pattern", F.col("fingerprint").bitwiseAND(F.col("mask")))


def close_links(codes: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links (a, b) that connect the distinct ``codes`` (fingerprint) exactly as all pairs within reach do.

    The upper nodes of the index are masked patterns: codes that agree under one of six masks of 32 bits
    meet in a group, and no pair within reach is missed. Groups of one are dropped. A group of more than
    ``group_rows`` codes is divided by three finer masks first. Each group is searched by ``close_pairs``
    and gives a spanning set of links, not all pairs.
    """
    rows = _exploded(codes, F.array(*[F.lit(_signed(m)) for m in _masks()]))
    sizes = rows.groupBy("mask", "pattern").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    sizes = stored(sizes, "patterns")  # a join with a stored table can split a large group
    rows = rows.join(sizes, ["mask", "pattern"])
    finer = F.lit(None)
    for m in _masks():
        finer = F.when(F.col("mask") == _signed(m), F.array(*[F.lit(_signed(f)) for f in _finer(m)])).otherwise(finer)
    chosen = F.when(F.col("rows") > group_rows, finer).otherwise(F.array("mask"))
    rows = rows.select("fingerprint", F.explode(chosen).alias("mask"))
    rows = rows.withColumn("pattern", F.col("fingerprint").bitwiseAND(F.col("mask")))
    rows = rows.repartition("mask", "pattern").sortWithinPartitions("mask", "pattern")
    return rows.mapInArrow(_group_links, "a bigint, b bigint")


def near_groups(ids: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Per distinct fingerprint of ``ids`` (doc_id, fingerprint): its group and the group's smallest doc_id.

    Columns fingerprint, group, component_id. Fingerprints within 2 bits are linked, and groups are
    connected components. Null ids are passed over by the smallest (null if a group has no other).
    """
    codes = stored(ids.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "fingerprints")
    found = components(close_links(codes.select("fingerprint"), group_rows))
    codes = codes.join(found, codes["fingerprint"] == found["node"], "left")
    codes = codes.select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("group"))
    least = codes.groupBy("group").agg(F.min("least").alias("component_id"))
    return codes.join(least, "group").select("fingerprint", "group", "component_id")


def simhash_components(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    Nulls: a null text has no words; a null id stays null and is never the smallest. Empty texts and texts
    without words have fingerprint zero and are linked like any other. Repeated rows each give a row.
    Empty table: no rows. Other columns are not read.
    """
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = stored(fingerprinted(plain, "text").drop("text"), "simhash")
    out = ids.join(near_groups(ids).drop("group"), "fingerprint")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one of each group of near duplicates, the one of the smallest doc_id.

    All columns stay. Of repeated rows with that id one stays; groups without any id keep one row.
    """
    pair = F.concat_ws(":", F.hex("fingerprint"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))
    marked = fingerprinted(packed_rows(docs, "doc_id"), "text").withColumn("pair", pair)
    ids = stored(marked.select("doc_id", "fingerprint"), "simhash")
    groups = near_groups(ids)
    winners = ids.distinct().join(groups, "fingerprint").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = Window.partitionBy("group").orderBy("fingerprint")
    winners = winners.withColumn("place", F.row_number().over(first)).where("place = 1").select(pair.alias("pair"))
    # Join and window share one partitioning, so texts are shuffled once.
    one = Window.partitionBy("pair").orderBy(F.xxhash64("row", "text"))
    kept = marked.join(winners, "pair", "left_semi").withColumn("place", F.row_number().over(one))
    return unpacked_rows(kept.where("place = 1"), docs)
