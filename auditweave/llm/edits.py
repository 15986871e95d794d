"""Document fingerprints by a randomised edit embedding, with bit-sampled banding and verification."""

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditweave.llm.base import split_batch
from auditweave.llm.components import components
from auditweave.plans.joins import stored

BITS = 512
SEED = 11
STEPS = 4096
#: Fewer walks than this go on one by one.
FEW = 24
FACTOR = 0x9E3779B1
BANDS = 48
BAND_BITS = 24
LIKENESS = 0.8


@functools.cache
def _random(block: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """For steps of one block: the random word of each step, and the bits whose sample moves to that step.

    A sample moves to step j (from 1) with probability 1/j, so after L steps it lies at each of them
    with probability 1/L; texts with walks of about equal length sample the same steps.
    """
    rng = np.random.default_rng((SEED, block))
    words = rng.integers(0, 2**32, STEPS, dtype=np.uint32)
    chance = 1.0 / (block * STEPS + np.arange(1, STEPS + 1))
    counts = rng.binomial(BITS, chance)
    return words, [rng.choice(BITS, n, replace=False) if n else _NONE for n in counts]


_NONE = np.zeros(0, dtype=np.int64)
_SALTS = np.random.default_rng((SEED, 1 << 40)).integers(0, 2**32, BITS, dtype=np.uint32)


def _mixed(codes: np.ndarray) -> np.ndarray:
    """A random-looking 32-bit word for each character code."""
    codes = (codes ^ (codes >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    codes = (codes ^ (codes >> np.uint32(12))) * np.uint32(0x297A2D39)
    return codes ^ (codes >> np.uint32(15))


def fingerprints(texts: list[str]) -> np.ndarray:
    """Packed fingerprints (rows of BITS / 8 bytes) of whole texts.

    All texts share one random walk: at step j a walk reads its character, and a random bit of (j,
    character) says whether it goes on to the next one. What it reads, step by step, is the embedding;
    an edit shifts the rest of a walk only until both meet again, so a few edits change few symbols. Bit
    k is a random bit of the symbol at a random step. An empty text has no step and no bit set.
    """
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    words = np.append(_mixed(codes.copy()), np.uint32(0))
    ends = np.cumsum(sizes)
    bits = np.zeros((len(texts), BITS), dtype=np.uint8)
    rows = np.flatnonzero(sizes)
    at, stop = (ends - sizes)[rows], ends[rows]
    step = 0
    factor, top = np.uint32(FACTOR), np.uint32(31)
    while len(rows) > FEW:
        noise, moves = _random(step // STEPS)
        for word, moved in zip(noise, moves, strict=True):
            read = words[at]
            if len(moved):
                bits[rows[:, None], moved] = ((read[:, None] ^ _SALTS[moved]) * factor) >> top
            at = at + (((read ^ word) * factor) >> top)
            going = at < stop
            if not going.all():
                rows, at, stop = rows[going], at[going], stop[going]
        step += STEPS
    for row, begin, end in zip(rows.tolist(), at.tolist(), stop.tolist(), strict=True):
        _walk(words[begin:end].tolist(), bits[row], step)
    return np.packbits(bits, axis=1)


def _walk(read: list[int], bits: np.ndarray, step: int) -> None:
    """One walk from ``step`` on."""
    at, size = 0, len(read)
    while True:
        noise, moves = _random(step // STEPS)
        for word, moved in zip(noise.tolist(), moves, strict=True):
            if len(moved):
                bits[moved] = ((np.uint32(read[at]) ^ _SALTS[moved]) * np.uint32(FACTOR)) >> np.uint32(31)
            at += ((read[at] ^ word) * FACTOR & 0xFFFFFFFF) >> 31
            if at == size:
                return
        step += STEPS


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal fingerprints, 0 if as many bits differ as by chance."""
    apart = np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)
    return np.maximum(0.0, 1.0 - 2.0 * apart / BITS)


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the start of ``following``."""
    part = len(text) // 3
    return text[: len(text) - part] + following[:part]


OUT = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double")
FIRST, LAST = "first", "last"
RESULT = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _results(ids: list, texts: list[str], following: list[str], prints: np.ndarray, next_prints: np.ndarray) -> list[tuple]:
    changed = [edited(t, n) for t, n in zip(texts, following, strict=True)]
    changed_prints = fingerprints(changed)
    near, after = likeness(prints, changed_prints), likeness(prints, next_prints)
    return [
        (ids[i], len(texts[i]), hashlib.sha256(changed[i].encode("utf-8", "surrogatepass")).hexdigest(), prints[i].tobytes().hex(),
         changed_prints[i].tobytes().hex(), float(near[i]), float(after[i]))
        for i in range(len(texts))
    ]


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=names)


NAMES = [f.strip().split(" ")[0] for f in OUT.split(",")]


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of the rows whose following document is in the same partition; its first and last row besides."""
    part = TaskContext.get().partitionId()
    kinds = [*RESULT, pa.string(), pa.int32(), pa.string()]
    names = [*NAMES, "edge", "part", "text"]
    before: tuple | None = None
    for whole in batches:
        for batch in split_batch(whole, "text", 16_000_000):
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            prints = fingerprints(texts)
            rows = []
            if before is None:
                rows.append((ids[0], *[None] * 6, FIRST, part, texts[0]))
                following, next_prints, own = texts[:-1], prints[:-1], slice(1, None)
            else:
                following, next_prints, own = [before[1], *texts[:-1]], np.vstack([before[2], prints[:-1]]), slice(None)
            rows += [(*r, None, part, None) for r in _results(ids[own], texts[own], following, prints[own], next_prints)]
            before = ids[-1], texts[-1], prints[-1:]
            yield _batch(rows, names, kinds)
    if before is not None:
        yield _batch([(before[0], *[None] * 6, LAST, part, before[1])], names, kinds)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            ids, texts, following = (batch.column(c).to_pylist() for c in ("doc_id", "text", "following"))
            yield _batch(_results(ids, texts, following, fingerprints(texts), fingerprints(following)), NAMES, RESULT)


def edit_report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text) its fingerprint, that of its edited text, and their likeness (columns OUT).

    The next document is the one of the next smaller doc_id, after the last the first. Documents are
    sorted in ranges; each task pairs its own neighbours, and only the two rows at the ends of each range
    are joined with those of other ranges.

    Nulls: a null text is empty, a null id is the smallest. Ties and repeated rows: rows of one id are in
    the order of a hash of their texts. Empty table: no rows. One row: it is its own next. Other columns
    are not read.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranges = rows.repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order)
    found = stored(ranges.mapInArrow(_within, f"{OUT}, edge string, part int, text string"), "edits")
    last = found.where(F.col("edge") == LAST).select(F.col("part").alias("of_part"), F.col("text").alias("following"))
    first = found.where(F.col("edge") == FIRST).select("doc_id", "text", "part")
    # One short row for each range: which range comes before it, and for the first one the last.
    every = Window.orderBy("part")
    before = found.where(F.col("edge") == FIRST).select(
        "part", F.coalesce(F.lag("part").over(every), F.max("part").over(Window.partitionBy(F.lit(1)))).alias("of_part"))
    across = first.join(before, "part").join(last, "of_part").select("doc_id", "text", "following").mapInArrow(_across, OUT)
    return found.where("edge IS NULL").select(*NAMES).unionByName(across)


def _hamming(a: Column, b: Column) -> Column:
    """Differing bits of two fingerprints in hexadecimal, by words of 60 bits."""
    total = F.lit(0)
    for i in range(0, BITS // 4, 15):
        x, y = (F.conv(F.substring(c, i + 1, 15), 16, 10).cast("bigint") for c in (a, b))
        total = total + F.bit_count(x.bitwiseXOR(y))
    return total


def near_documents(prints: DataFrame, least: float = LIKENESS, bands: int = BANDS, band_bits: int = BAND_BITS) -> DataFrame:
    """Groups of alike fingerprints: (fingerprint, group) for the distinct ``fingerprint`` texts of ``prints``.

    Each band samples ``band_bits`` bits. Fingerprints with the same sampled bits meet, and each is
    verified against the smallest of its bucket. What that leaves in different components is then
    verified pair by pair in its buckets, so groups are the connected components of all alike pairs that
    meet; only alike pairs leave a bucket, and none is capped. Nulls are left out.
    """
    rng = np.random.default_rng((SEED, 2))
    codes = prints.where("fingerprint IS NOT NULL").select("fingerprint").distinct()
    codes = stored(codes.withColumn("node", F.xxhash64("fingerprint")), "prints")
    # A hexadecimal digit is a sample of four bits.
    keys = [F.concat_ws("", F.lit(f"{band}:"), *[F.substring("fingerprint", int(i) + 1, 1) for i in rng.choice(BITS // 4, band_bits // 4, replace=False)])
            for band in range(bands)]
    rows = stored(codes.select("fingerprint", "node", F.explode(F.array(*keys)).alias("key")), "bands")
    def alike(a: str, b: str) -> Column:
        return 1 - 2 * _hamming(F.col(a), F.col(b)) / BITS >= least

    leads = rows.groupBy("key").agg(F.min(F.struct("fingerprint", "node")).alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    leads = stored(leads.select("key", "lead"), "leads")  # a join with a stored table can split a large bucket
    met = stored(rows.join(leads, "key"), "met")
    found = met.where(F.col("node") != F.col("lead.node")).where(alike("fingerprint", "lead.fingerprint"))
    links = stored(found.select(F.col("node").alias("a"), F.col("lead.node").alias("b")).distinct(), "alike")
    known = components(links)
    placed = met.select("key", "node", "fingerprint").join(known, "node", "left")
    placed = placed.select("key", "node", "fingerprint", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    placed = stored(placed.join(mixed.select("key"), "key"), "mixed")
    one, two = placed.toDF("key", "a", "a_print", "of_a"), placed.toDF("of_key", "b", "b_print", "of_b")
    near = (F.col("key") == F.col("of_key")) & (F.col("a") < F.col("b")) & (F.col("of_a") != F.col("of_b")) & alike("a_print", "b_print")
    links = links.unionByName(one.join(two, near).select("a", "b").distinct())
    groups = components(links)
    return codes.join(groups, "node", "left").select("fingerprint", F.coalesce("component", "node").alias("group"))
