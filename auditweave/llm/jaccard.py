"""Jaccard join of word n-grams by a grouped prefix join."""

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditweave.llm.base import Scratch, map_texts, sorted_groups, split_batch
from auditweave.llm.components import components
from auditweave.plans.joins import stored

WORDS = 4
#: Least share of common shingles, in hundredths.
LEAST = 85
#: Counters of shingle frequencies, whatever the number of shingles: the size of what tasks are sent.
SLOT_BITS = 17
#: Shingles on either side of a comparison in one task.
BLOCK_SHINGLES = 1_000_000
SEED = 42
_FOLD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)


def _folded(words: list[np.ndarray]) -> np.ndarray:
    """One number for each row of words, which depends on their order and count."""
    total = np.full(len(words[0]), len(words), dtype=np.uint64)
    for word in words:
        total = (total ^ word) * _FOLD[0]
        total ^= total >> np.uint64(31)
        total *= _FOLD[1]
        total ^= total >> np.uint64(29)
    return total


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the different shingles of a text.

    A-Z are lower-cased, and words are what lies between ASCII white space. Fewer words than a shingle
    has are one shingle, no words none.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter((xxhash.xxh64_intdigest(t, SEED) for t in tokens), dtype=np.uint64, count=len(tokens))
    wide = min(words, len(hashes))
    return np.unique(_folded([hashes[i : len(hashes) - wide + 1 + i] for i in range(wide)]))


def set_id(shingles: np.ndarray) -> int | None:
    """A signed 64-bit number for a set; null for the empty one."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)).view(np.int64)) if len(shingles) else None


def slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def prefix(shingles: np.ndarray, counts: np.ndarray, least: int = LEAST) -> np.ndarray:
    """The rarest shingles of a set: sets as alike as ``least`` have one of them in common.

    The order is by the counter of a shingle and the shingle itself, the same for all sets.
    """
    n = len(shingles)
    order = np.lexsort((shingles, counts[slots(shingles)]))
    return shingles[order[: n - -(-least * n // 100) + 1]]


def _identified(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per row its id, mark, set and number of shingles; at the end of a task its counters of shingles."""
    names = ["doc_id", "mark", "node", "n", "slot", "held"]

    def run(batches):
        counts = np.zeros(1 << SLOT_BITS, dtype=np.int64)
        for whole in batches:
            for batch in split_batch(whole, "text", 4_000_000):
                nodes, sizes = [], []
                for text in batch.column("text").to_pylist():
                    own = shingle_set(text, words)
                    nodes.append(set_id(own))
                    sizes.append(len(own))
                    np.add.at(counts, slots(own), 1)
                none = pa.nulls(batch.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(nodes, pa.int64()),
                                                  pa.array(sizes, pa.int64()), none, none], names=names)
        used = np.flatnonzero(counts)
        for begin in range(0, len(used), 65_536):
            some = used[begin : begin + 65_536]
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(some), pa.array(counts[some])], names=names)

    return run


def _prefixes(words: int, counts: np.ndarray, least: int) -> Callable[[list], list[pa.Array]]:
    def compute(texts):
        nodes, sizes, families, kept = [], [], [], []
        for text in texts:
            own = shingle_set(text, words)
            first = prefix(own, counts, least)
            nodes.append(set_id(own))
            sizes.append(len(own))
            families.append(set_id(np.append(first, np.uint64(len(own)))))
            kept.append(first.view(np.int64))
        return [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(families, pa.int64()), pa.array(kept, pa.list_(pa.int64()))]

    return compute


def _sets(words: int) -> Callable[[list], list[pa.Array]]:
    def compute(texts):
        sets = [shingle_set(text, words) for text in texts]
        return [pa.array([set_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]

    return compute


def _alike(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows (a, b, left, right) whose sets are similar enough."""

    def run(batches):
        for batch in batches:
            keep = []
            for one, other in zip(batch.column("left"), batch.column("right")):
                left, right = (np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in (one, other))
                at = np.minimum(np.searchsorted(right, left), len(right) - 1)
                both = int((right[at] == left).sum())
                keep.append(100 * both >= least * (len(left) + len(right) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, type=pa.bool_()))

    return run


def passing(left: list, right: list, counts: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``left`` and of ``right`` (lists of group, size, prefix) can be similar to one of another group.

    Of two sets, let z be the one whose prefix ends first in the order of shingles. What they share up to
    there is in both prefixes, and beyond it z has only the rest of its shingles. Most pairs that share
    just a passage cannot reach the similarity by that bound.
    """
    of, sizes = (np.array([r[i] for r in right]) for i in (0, 1))
    lengths = np.array([len(r[2]) for r in right])
    ends = np.array([r[2][-1] for r in right], dtype=np.uint64)
    end_counts = counts[slots(ends)]
    search = _Search([r[2] for r in right])
    one, two = np.zeros(len(left), dtype=bool), np.zeros(len(right), dtype=bool)
    for i, (group, size, own) in enumerate(left):
        count = counts[slots(own[-1:])][0]
        first = (count < end_counts) | ((count == end_counts) & (own[-1] <= ends))
        most = search.common(own) + np.where(first, size - len(own), sizes - lengths)
        fit = ((100 + least) * most >= least * (size + sizes)) & (np.minimum(size, sizes) * 100 >= np.maximum(size, sizes) * least) & (of != group)
        one[i] = fit.any()
        two |= fit
    return one, two


class _Search:
    """How many shingles a set has in common with each of many, by one sorted list of theirs."""

    def __init__(self, sets: list[np.ndarray]):
        shingles = np.concatenate(sets)
        owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(shingles, kind="stable")
        self.shingles, self.owners, self.count = shingles[order], owners[order], len(sets)

    def common(self, own: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.shingles, own), np.searchsorted(self.shingles, own, side="right")
        runs = high - low
        places = np.repeat(low - np.append(0, np.cumsum(runs)[:-1]), runs) + np.arange(runs.sum())
        return np.bincount(self.owners[places], minlength=self.count)


def block_links(left: list, right: list, least: int = LEAST) -> list[tuple[int, int]]:
    """Links that join the groups of ``left`` and ``right`` (lists of node, group, set) as all similar pairs do.

    The shingles of the right side are one sorted list with their owners, so one search per left set
    counts what it has in common with all of them. Pairs that are already joined give no link.
    """
    parent = {group: group for _, group, _ in left + right}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    sizes = np.array([len(s) for _, _, s in right])
    search, out = _Search([s for _, _, s in right]), []
    for node, group, own in left:
        both = search.common(own)
        for i in np.flatnonzero(100 * both >= least * (len(own) + sizes - both)).tolist():
            one, other = root(group), root(right[i][1])
            if one != other:
                parent[one] = other
                out.append((node, right[i][0]))
    return out


def _cells(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[list, list]]:
    """The minor members of each cell and all, as lists of ``columns``; the last is a set of shingles."""
    for rows in sorted_groups(batches, "block", "i", "j"):
        sides = [[], []]
        for minor, *facts, own in zip(*(rows.column(c).to_pylist() for c in ("minor", *columns))):
            own = np.frombuffer(own, dtype=np.uint64) if isinstance(own, bytes) else np.array(own, dtype=np.int64).view(np.uint64)
            sides[not minor].append((*facts, own))
        if all(sides):
            yield tuple(sides)


def _linked_blocks(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for sides in _cells(batches, "node", "component", "shingles"):
            found = block_links(*sides, least)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])

    return run


def _passing_blocks(counts: np.ndarray, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The members of each block that can be similar to one of another component."""

    def run(batches):
        for rows in sorted_groups(batches, "block", "i", "j"):
            block = rows.column("block")[0].as_py()
            for sides in _cells(iter(rows.to_batches()), "node", "component", "n", "prefix"):
                kept = passing(*([r[1:] for r in side] for side in sides), counts, least)
                nodes = {r[0] for side, fit in zip(sides, kept) for r, f in zip(side, fit) if f}
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(nodes), pa.int64()), pa.array(list(nodes), pa.int64())], names=["block", "node"])

    return run


def _passing_pairs(counts: np.ndarray, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for batch in batches:
            sides = ([(i, n, np.array(p, dtype=np.int64).view(np.uint64)) for n, p in zip(batch.column(f"n_{x}").to_pylist(), batch.column(f"prefix_{x}").to_pylist())]
                     for i, x in enumerate("ab"))
            keep = [passing([left], [right], counts, least)[0][0] for left, right in zip(*sides)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, type=pa.bool_()))

    return run


def size_classes(n: Column, least: int = LEAST) -> Column:
    """The two classes of a size: sets that can be similar have one in common, and few others have."""
    own = F.floor(F.log(n.cast("double")) / math.log(100 / least) - 1e-9).cast("int")
    return F.array(own, own + 1)


def _met(nodes: DataFrame, scratch: Scratch, least: int) -> DataFrame:
    """(block, center, node, n): sets that can be similar meet in a block, each set once.

    Sets with the same size and prefix are one family. Families that share a shingle of their prefixes and
    a class of size are in the block of the smallest of them, so a block has one row per member however many
    shingles they share, and its center is the smallest set of that family.
    """
    own = Scratch(nodes.sparkSession)
    families = nodes.groupBy("family").agg(F.min("node").alias("center"), F.count(F.lit(1)).alias("members"), F.first("n").alias("n"),
                                           F.first("prefix").alias("prefix"))
    families = own.stored(families, "families")
    posts = families.select(F.explode("prefix").alias("token"), "family", "n")
    shared = posts.groupBy("token").agg(F.count(F.lit(1)).alias("held")).where("held > 1").select("token")
    shared = own.stored(shared, "shared")  # a join with a stored table can split a frequent shingle
    posts = own.stored(posts.join(shared, "token").select("token", "family", F.explode(size_classes(F.col("n"), least)).alias("class")), "posts")
    leads = posts.groupBy("token", "class").agg(F.min("family").alias("block"), F.count(F.lit(1)).alias("held")).where("held > 1").drop("held")
    pairs = posts.join(own.stored(leads, "leads"), ["token", "class"]).select("block", "family")
    # What else is in a block of one family: sets of equal size and prefix.
    alone = families.where("members > 1").select(F.col("family").alias("block"), "family")
    pairs = own.stored(pairs.union(alone).distinct(), "blocks")
    centers = families.select(F.col("family").alias("block"), "center")
    met = scratch.stored(pairs.join(centers, "block").join(nodes.select("family", "node", "n"), "family").drop("family"), "met")
    own.drop()
    return met


def _sets_of(texts: DataFrame, nodes: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of the ``wanted`` nodes, from the text of their mark."""
    picked = nodes.select("node", "mark").join(wanted, "node", "left_semi").select("mark").distinct()
    sets = map_texts(texts.join(picked, "mark", "left_semi"), "text", "node bigint, shingles binary", lambda: _sets(words))
    return sets.select("node", "shingles").dropDuplicates(["node"])


def _cut(placed: DataFrame, columns: list[str], block_shingles: int, scratch: Scratch) -> DataFrame:
    """``columns`` of the members ``placed`` (block, node, n, component, minor) of blocks, dealt to cells (block, i, j).

    The minor members of a block meet all its members in parts of ``block_shingles`` shingles on either side.
    """
    parts = placed.groupBy("block").agg(
        F.count_if("minor").alias("minors"), F.count(F.lit(1)).alias("members"),
        F.ceil(F.sum(F.when(F.col("minor"), F.col("n"))) / block_shingles).cast("int").alias("rows"),
        F.ceil(F.sum("n") / block_shingles).cast("int").alias("columns"))
    parts = scratch.stored(parts.where("minors > 0 AND members > 1").select("block", "rows", "columns"), "parts")
    placed = placed.join(parts, "block")
    own = {side: F.pmod(F.xxhash64("node"), F.col(side)).cast("int") for side in ("rows", "columns")}
    every = {side: F.explode(F.sequence(F.lit(0), F.col(side) - 1)) for side in ("rows", "columns")}
    left = placed.where("minor").select("block", *columns, F.lit(True).alias("minor"), own["rows"].alias("i"), every["columns"].alias("j"))
    right = placed.select("block", *columns, F.lit(False).alias("minor"), every["rows"].alias("i"), own["columns"].alias("j"))
    return left.union(right)


def similar_groups(texts: DataFrame, nodes: DataFrame, counts: np.ndarray, scratch: Scratch, words: int = WORDS, least: int = LEAST,
                   block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(node, component) of the sets ``nodes`` (node, n, mark, family, prefix) that are similar to others.

    ``texts`` has the text of each mark. Pairs are filtered by their sizes and prefixes; sets are made for
    what passes only. Each member of a block is first verified against its center. What is then not
    joined with the center, the minor members, is compared with all members of its block, in parts of
    ``block_shingles`` shingles on either side. So a block of many versions of one text takes one row
    per version, and no similar pair is missed. Only links that join two groups are kept, never all pairs.
    """
    met = _met(nodes, scratch, least)
    ends = [nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("prefix").alias(f"prefix_{x}")) for x in "ab"]
    stars = met.where("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    stars = stars.join(ends[0], "a").join(ends[1], "b").select("a", "b", "n_a", "n_b", "prefix_a", "prefix_b")
    stars = scratch.stored(stars.mapInArrow(_passing_pairs(counts, least), "a bigint, b bigint"), "stars")
    sides = stars.select(F.col("a").alias("node")).union(stars.select("b")).distinct()
    sets = scratch.stored(_sets_of(texts, nodes, sides, words), "sets")
    pairs = stars.join(sets.toDF("a", "left"), "a").join(sets.toDF("b", "right"), "b").select("a", "b", "left", "right")
    links = scratch.stored(pairs.mapInArrow(_alike(least), "a bigint, b bigint"), "links")
    known = components(links)
    placed = met.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    centers = known.toDF("center", "main")
    # In a block of two the center has seen the other.
    larger = scratch.stored(met.groupBy("block").agg(F.count(F.lit(1)).alias("members")).where("members > 2").select("block"), "larger")
    placed = placed.join(larger, "block").join(centers, "center", "left").withColumn("minor", F.col("component") != F.coalesce("main", "center"))
    placed = scratch.stored(placed.select("block", "node", "n", "component", "minor"), "placed")
    cells = _cut(placed, ["node", "component", "n"], block_shingles, scratch).join(nodes.select("node", "prefix"), "node")
    cells = cells.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j")
    alive = scratch.stored(cells.mapInArrow(_passing_blocks(counts, least), "block bigint, node bigint").distinct(), "alive")
    if alive.isEmpty():
        return known
    placed = scratch.stored(placed.join(alive, ["block", "node"]), "placed")
    sets = scratch.stored(_sets_of(texts, nodes, alive.select("node").distinct(), words), "sets")
    cells = _cut(placed, ["node", "component"], block_shingles, scratch).join(sets, "node")
    cells = cells.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j")
    more = scratch.stored(cells.mapInArrow(_linked_blocks(least), "a bigint, b bigint"), "links")
    return known if more.isEmpty() else components(links.union(more))


def jaccard_components(docs: DataFrame, words: int = WORDS, least: int = LEAST, **options) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Documents link from ``least`` hundredths of common different shingles on; component_id is the
    smallest doc_id that links reach. Shingles and sets are compared by 64-bit hashes.

    Nulls: a null text has no shingles; a null id stays null and is never the smallest (null if a
    component has no other). Texts without words have an empty set, are linked with nothing and keep
    their own id. Repeated rows each give a row, and equal sets are linked. Empty table: no rows. Other
    columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    plain = plain.withColumn("mark", F.xxhash64("doc_id", "text"))
    schema = "doc_id bigint, mark bigint, node bigint, n bigint, slot bigint, held bigint"
    first = scratch.stored(plain.mapInArrow(_identified(words), schema), "shingles")
    counts = np.zeros(1 << SLOT_BITS, dtype=np.int64)
    # One row per counter at most.
    held = first.where("slot IS NOT NULL").groupBy("slot").agg(F.sum("held").alias("held")).toArrow()
    counts[held.column("slot").to_numpy()] = held.column("held").to_numpy()
    ids = first.where("slot IS NULL").select("doc_id", "mark", "node", "n")
    least_ids = scratch.stored(ids.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"), F.min("mark").alias("mark")), "ids")
    texts = plain.select("mark", "text")
    kept = texts.join(least_ids.select("mark"), "mark", "left_semi")
    prefixes = map_texts(kept, "text", "node bigint, n bigint, family bigint, prefix array<bigint>", lambda: _prefixes(words, counts, least))
    nodes = scratch.stored(prefixes.drop("text").dropDuplicates(["node"]), "nodes")
    found = similar_groups(texts, nodes, counts, scratch, words, least, **options)
    placed = least_ids.join(found, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    smallest = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    smallest = scratch.stored(placed.join(smallest, "component").select("node", "component_id"), "smallest")
    out = ids.join(smallest, "node", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    out = stored(out, "jaccard")
    scratch.drop()
    return out
