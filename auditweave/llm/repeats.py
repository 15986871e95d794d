"""Removal of long byte strings that occur more than once, by expanding intervals of a BWT."""

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditweave.llm.base import Scratch, packed_rows, split_batch, unpacked_rows
from auditweave.plans.joins import stored

LENGTH = 400
#: Bytes of segments whose suffixes are sorted at once.
BLOCK_BYTES = 1_000_000
#: A group of more different segments is divided before its suffixes are sorted.
GROUP_SEGMENTS = 2_000
#: Starts to a cell after a group was divided once, and twice.
FINER = (16, 1)
CELLS = "group bigint, key binary, copies bigint, lo int, hi int, at int"
CELL_KINDS = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]


def gram_bytes(length: int) -> int:
    """Bytes of the strings that mark places: the largest power of two up to a third of ``length``."""
    return 1 << (max(3, length) // 3).bit_length() - 1


def place_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each place, by doubling. The last ``gram`` - 1 places have none."""
    values = np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64)[data]
    factor, size = 0x9E3779B97F4A7C15, 1
    while size < gram:
        values = values[: len(values) - size] * np.uint64(factor) + values[size:]
        factor = factor * factor % 2**64
        size *= 2
    values ^= values >> np.uint64(29)
    values *= np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


def cells_of(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Cells of the starts of strings of ``length`` bytes: arrays (text, group, lo, hi, at).

    Each start belongs to the least marking string inside its string (the first of equal ones), and
    neighbouring starts with the same one form a cell. Equal strings have the same marking string at the
    same distance, so they lie in cells of one group.
    """
    gram = gram_bytes(length)
    window = length - gram + 1
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(sizes)
    out = []
    step = 1 << 22
    for base in range(0, max(0, len(data) - length + 1), step):
        part = data[base : base + step + length - 1]
        hashes = place_hashes(part, gram)
        least = (hashes & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(hashes), dtype=np.uint64)
        reach = 1
        while reach * 2 <= window:
            least = np.minimum(least[: len(least) - reach], least[reach:])
            reach *= 2
        if reach < window:
            least = np.minimum(least[: len(least) - (window - reach)], least[window - reach :])
        at = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        start = base + np.arange(len(at))
        text = np.searchsorted(ends, start, side="right")
        inside = start + length <= ends[np.minimum(text, len(ends) - 1)]
        first = inside.copy()
        first[1:] &= (at[1:] != at[:-1]) | ~inside[:-1] | (text[1:] != text[:-1])
        last = inside.copy()
        last[:-1] &= first[1:] | ~inside[1:]
        lo, hi = np.flatnonzero(first), np.flatnonzero(last)
        own = text[lo]
        begin = ends[own] - sizes[own]
        out.append((own, hashes[at[lo]].view(np.int64), lo + base - begin, hi + base - begin, at[lo] + base - begin))
    if not out:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of ``text`` (symbols below 512), sorted by their first ``depth`` symbols at least."""
    size = len(text)
    padded = np.concatenate([text, np.zeros(7, dtype=text.dtype)]).astype(np.int64)
    keys = np.zeros(size, dtype=np.int64)
    for i in range(7):
        keys = (keys << 9) | padded[i : i + size]
    order = np.argsort(keys, kind="stable")
    fresh = np.ones(size, dtype=bool)
    sorted_keys = keys[order]
    fresh[1:] = sorted_keys[1:] != sorted_keys[:-1]
    heads = np.flatnonzero(fresh)
    rank = np.zeros(size + 1, dtype=np.int64)
    rank[order] = heads[np.cumsum(fresh) - 1] + 1
    sorted_by = 7
    alone = fresh & np.append(fresh[1:], True)
    open_places = np.flatnonzero(~alone)
    while sorted_by < depth and len(open_places):
        own = order[open_places]
        keys = rank[own] * (size + 1) + rank[np.minimum(own + sorted_by, size)]
        moved = np.argsort(keys, kind="stable")
        own, keys = own[moved], keys[moved]
        order[open_places] = own
        fresh = np.ones(len(own), dtype=bool)
        fresh[1:] = keys[1:] != keys[:-1]
        rank[own] = open_places[np.flatnonzero(fresh)][np.cumsum(fresh) - 1] + 1
        open_places = open_places[~(fresh & np.append(fresh[1:], True))]
        sorted_by *= 2
    return order


def repeated_starts(segments: list[bytes], length: int) -> np.ndarray:
    """For each place of the concatenated ``segments``, whether the ``length`` bytes from there recur in them.

    The suffix order is cut at ``length`` symbols, which leaves all shorter intervals as they are. From
    the whole interval on, each interval of a string w is extended backward by every symbol c before it:
    the places of c in the Burrows-Wheeler transform map it to the interval of cw. All intervals of one
    length are extended together, so common prefixes come by increasing value: an end that is met first
    at length l has the common prefix l, and only such intervals go on. At ``length`` the expansion
    stops; ends never met have a common prefix of ``length`` or more.
    """
    parts = []
    for segment in segments:
        parts += [np.frombuffer(segment, dtype=np.uint8).astype(np.uint16) + np.uint16(2), np.ones(1, dtype=np.uint16)]
    text = np.concatenate([*parts, np.zeros(1, dtype=np.uint16)])
    size = len(text)
    order = suffix_array(text, length)
    transform = text[order - 1]
    by_symbol = np.argsort(transform, kind="stable")
    symbols = transform[by_symbol]
    back = np.empty(size, dtype=np.int64)
    back[by_symbol] = np.arange(size)
    common = np.full(size + 1, -1, dtype=np.int16)
    common[0] = common[size] = 0
    low, high = np.zeros(1, dtype=np.int64), np.full(1, size - 1, dtype=np.int64)
    for value in range(length):
        sizes = high - low + 1
        owner = np.repeat(np.arange(len(low)), sizes)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[owner]
        both = np.sort(back[inside] << 32 | owner)
        places, owner = both >> 32, both & 0xFFFFFFFF
        symbol = symbols[places]
        ends = np.ones(len(places), dtype=bool)
        ends[:-1] = (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1])
        high = places[ends]
        low = places[np.append(0, np.flatnonzero(ends)[:-1] + 1)] if len(high) else high
        first_met = common[high + 1] < 0
        low, high = low[first_met], high[first_met]
        common[high + 1] = value
        if not len(low):
            break
    linked = common[1:size] < 0
    recurs = np.zeros(size, dtype=bool)
    recurs[:-1] |= linked
    recurs[1:] |= linked
    flags = np.zeros(size, dtype=bool)
    flags[order[recurs]] = True
    return flags


def true_runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of each run of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True))


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(3)
    for batch in batches:
        bodies = [press.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(bodies, type=pa.binary())], names=["key", "body"])


def distinct_texts(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The different texts of ``docs`` (text) with their number of rows: key, copies, body (compressed).

    They are written once, bucketed by key, so that later joins on the key shuffle no text.
    """
    spark = docs.sparkSession
    keyed = docs.select(text_key("text").alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bodies = keyed.mapInArrow(_compressed, "key binary, body binary")
    texts = bodies.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.first("body").alias("body"))
    name = f"texts_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts.write.bucketBy(buckets, "key").option("path", scratch.path("texts")).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay; the frame knows its buckets
    return out


def text_key(column: str):
    """A 128-bit key of a text; null is empty."""
    return F.unhex(F.md5(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")))


def _bodies(batch: pa.RecordBatch) -> list[bytes]:
    unpress = zstandard.ZstdDecompressor()
    return [unpress.decompress(b) for b in batch.column("body").to_pylist()]


def _parts(batches: Iterator[pa.RecordBatch], most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` compressed bytes."""
    for batch in batches:
        yield from split_batch(batch, "body", most)


def all_cells(texts: DataFrame, length: int) -> DataFrame:
    """The cells of all texts (columns CELLS)."""

    def run(batches):
        for batch in _parts(batches):
            own, group, lo, hi, at = cells_of(_bodies(batch), length)
            of_text = [batch.column(c).take(pa.array(own)) for c in ("key", "copies")]
            places = [pa.array(x.astype(np.int32)) for x in (lo, hi, at)]
            yield pa.RecordBatch.from_arrays([pa.array(group), *of_text, *places], names=["group", "key", "copies", "lo", "hi", "at"])

    return texts.mapInArrow(run, CELLS)


def recurring(cells: DataFrame, scratch: Scratch) -> DataFrame:
    """The cells whose group has several, counting copies.

    The groups are written first: a join with a stored table can split a group with very many cells.
    """
    several = cells.groupBy("group").agg(F.sum("copies").alias("n")).where("n > 1").select("group")
    return cells.join(scratch.stored(several, "groups"), "group")


def with_texts(cells: DataFrame, texts: DataFrame, columns: list[str], run: Callable, schema: str) -> DataFrame:
    """``run`` over each text with the array ``cells`` of its own cells. Only the cells are shuffled."""
    lists = cells.groupBy("key").agg(F.collect_list(F.struct(*columns)).alias("cells"))
    return texts.join(lists, "key").mapInArrow(run, schema)


def _digest(segment: bytes, before: int) -> bytes:
    return xxhash.xxh3_128_digest(segment, seed=before & 0xFFFFFFFF)


def segments_known(cells: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """The cells with copies and a digest of all bytes that their strings cover."""

    def run(batches):
        for batch in _parts(batches):
            rows = []
            for key, copies, body, own in zip(batch.column("key").to_pylist(), batch.column("copies").to_pylist(),
                                              _bodies(batch), batch.column("cells").to_pylist(), strict=True):
                for c in own:
                    segment = body[c["lo"] : c["hi"] + length]
                    rows.append((c["group"], key, copies, c["lo"], c["hi"], c["at"], _digest(segment, c["at"] - c["lo"])))
            yield _batch(rows, ["group", "key", "copies", "lo", "hi", "at", "digest"], [*CELL_KINDS, pa.binary()])

    return with_texts(cells, texts, ["group", "lo", "hi", "at"], run, f"{CELLS}, digest binary")


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=names)


def divided(cells: DataFrame, texts: DataFrame, length: int, width: int) -> DataFrame:
    """Cells cut into cells of ``width`` starts, counted from the marking string.

    Their group is a hash of all bytes that the strings of such a cell share. At width 1 that is the
    string itself, so equal strings, and no others, meet in a group.
    """

    def run(batches):
        for batch in _parts(batches):
            rows = []
            for key, copies, body, own in zip(batch.column("key").to_pylist(), batch.column("copies").to_pylist(),
                                              _bodies(batch), batch.column("cells").to_pylist(), strict=True):
                for c in own:
                    at = c["at"]
                    for part in range((at - c["hi"]) // width, (at - c["lo"]) // width + 1):
                        top, low = at - part * width, at - part * width - width + 1
                        lo, hi = max(c["lo"], low), min(c["hi"], top)
                        core = body[top : low + length]
                        rows.append((_signed(xxhash.xxh3_64_intdigest(core, seed=part)), key, copies, lo, hi, at))
            yield _batch(rows, ["group", "key", "copies", "lo", "hi", "at"], CELL_KINDS)

    return with_texts(cells, texts, ["lo", "hi", "at"], run, CELLS)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def expanded(classes: DataFrame, texts: DataFrame, length: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Runs of recurring starts of each class of equal cells: group, digest, first, last (from its lo).

    ``classes`` has group, digest and one member (key, lo, hi). Segments of a group meet in a task; whole
    groups are gathered into blocks of about ``block_bytes``, and each block is expanded by itself.
    """

    def cut(batches):
        for batch in _parts(batches):
            rows = []
            for body, own in zip(_bodies(batch), batch.column("cells").to_pylist(), strict=True):
                rows += [(c["group"], c["digest"], body[c["lo"] : c["hi"] + length]) for c in own]
            yield _batch(rows, ["group", "digest", "segment"], [pa.int64(), pa.binary(), pa.binary()])

    def block(rows):
        flags = repeated_starts([r[2] for r in rows], length)
        out, at = [], 0
        for group, digest, segment in rows:
            own = flags[at : at + len(segment) - length + 1]
            out += [(group, digest, first, last) for first, last in true_runs(own)]
            at += len(segment) + 1
        return _batch(out, ["group", "digest", "first", "last"], [pa.int64(), pa.binary(), pa.int32(), pa.int32()])

    def run(batches):
        rows, total = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("group", "digest", "segment")), strict=True):
                if total >= block_bytes and row[0] != rows[-1][0]:
                    yield block(rows)
                    rows, total = [], 0
                rows.append(row)
                total += len(row[2])
        if rows:
            yield block(rows)

    segments = with_texts(classes, texts, ["group", "digest", "lo", "hi"], cut, "group bigint, digest binary, segment binary")
    placed = segments.repartition("group").sortWithinPartitions("group")
    return placed.mapInArrow(run, "group bigint, digest binary, first int, last int")


def recurring_starts(texts: DataFrame, scratch: Scratch, length: int = LENGTH, group_segments: int = GROUP_SEGMENTS,
                     block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Runs (key, first, last) of starts of strings of ``length`` bytes that also start elsewhere.

    Cells of one group are compared. Cells with equal bytes form a class; a class of several cells recurs
    as a whole. Classes of a group with different bytes are compared by their suffixes. A group of more
    than ``group_segments`` classes is divided first, at last into groups of equal strings, which need
    counting only; so no group grows with the corpus.
    """
    cells = scratch.stored(all_cells(texts, length), "cells")
    found = None
    for width in (*FINER, None):
        known = scratch.stored(segments_known(recurring(cells, scratch), texts, length), "segments")
        classes = known.groupBy("group", "digest").agg(
            F.sum("copies").alias("n"), F.min(F.struct("key", "lo", "hi", "at")).alias("one"))
        classes = scratch.stored(classes, "classes")
        groups = scratch.stored(classes.groupBy("group").agg(F.count(F.lit(1)).alias("classes"), F.min("n").alias("least")), "groups")
        classes = scratch.stored(classes.join(groups, "group").select("group", "digest", "n", "classes", "least", "one.*"), "classes")
        large = classes.where(F.col("classes") > group_segments)
        unsettled = classes.where((F.col("classes") <= group_segments) & (F.col("least") == 1))
        recur = expanded(unsettled, texts, length, block_bytes)
        recur = recur.join(classes.where("n > 1").select("group", "digest"), ["group", "digest"], "left_anti")
        recur = recur.union(classes.where((F.col("n") > 1) & (F.col("classes") <= group_segments)).select(
            "group", "digest", F.lit(0).alias("first"), (F.col("hi") - F.col("lo")).alias("last")))
        members = known.select("group", "digest", "key", "lo")
        runs = members.join(recur, ["group", "digest"]).select(
            "key", (F.col("lo") + F.col("first")).alias("first"), (F.col("lo") + F.col("last")).alias("last"))
        found = runs if found is None else found.union(runs)
        if width is None or large.isEmpty():
            return found
        hot = known.join(large.select("group").distinct(), "group")
        cells = scratch.stored(divided(hot, texts, length, width), "cells")
    return found


def removed(docs: DataFrame, length: int = LENGTH, group_segments: int = GROUP_SEGMENTS, block_bytes: int = BLOCK_BYTES,
            with_text: bool = False) -> DataFrame:
    """Per distinct text of ``docs``: key, n_bytes, n_removed, n_spans, kept_sha256; with_text: kept_text too, null
    where nothing is removed.

    Every byte covered by a string of ``length`` bytes that also starts elsewhere (in any text, the same
    included, or in another copy of it) is removed; strings are judged on the input. In ``kept_text`` a
    character whose bytes are cut is left out.
    """
    scratch = Scratch(docs.sparkSession)
    texts = distinct_texts(docs, scratch)
    runs = recurring_starts(texts, scratch, length, group_segments, block_bytes)
    lists = runs.groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("runs"))

    def run(batches):
        for batch in _parts(batches):
            rows = []
            for key, copies, body, own in zip(batch.column("key").to_pylist(), batch.column("copies").to_pylist(),
                                              _bodies(batch), batch.column("runs").to_pylist(), strict=True):
                if copies > 1 and len(body) >= length:
                    own = [{"first": 0, "last": len(body) - length}]
                kept, at, spans, gone = [], 0, 0, 0
                for begin, end in sorted((r["first"], r["last"] + length) for r in own or []):
                    if begin > at or spans == 0:
                        kept.append(body[at:begin])
                        spans += 1
                        gone += end - begin
                    else:
                        gone += max(0, end - at)
                    at = max(at, end)
                kept = b"".join([*kept, body[at:]])
                rows.append((key, len(body), gone, spans, hashlib.sha256(kept).hexdigest(),
                             kept.decode("utf-8", "ignore") if with_text and gone else None))
            yield _batch(rows, ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"],
                         [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()])

    schema = "key binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_text string"
    out = texts.join(lists, "key", "left").mapInArrow(run, schema)
    out = stored(out if with_text else out.drop("kept_text"), "removed")
    scratch.drop()
    return out


def repeat_report(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, text (what is left).

    The hash is of the remaining bytes; in ``text`` a character that lost a byte is left out.

    Nulls: a null text is empty, a null id stays null. Empty and short texts lose nothing. Repeated rows
    and equal texts of ``length`` bytes or more lose all, as each string also starts in the other.
    Empty table: no rows. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key("text").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.join(removed(docs.select("text"), length, with_text=True, **options), "key")
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.coalesce("kept_text", "text").alias("text"))


def without_repeats(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """``docs`` with recurring strings cut from ``text``; rows that lose all their text go. All columns stay.

    Nulls, empty and short texts stay as they are, and so do null ids. Repeated rows and equal texts lose all and
    go. Empty table: no rows. Columns may have any name.
    """
    rows = packed_rows(docs).withColumn("key", text_key("text"))
    cut = removed(docs.select("text"), length, with_text=True, **options).where("n_removed > 0")
    cut = cut.select("key", "kept_text")
    rows = rows.join(cut, "key", "left").where(F.col("kept_text").isNull() | F.col("kept_text").rlike(r"\S"))
    return unpacked_rows(rows, docs, F.coalesce("kept_text", F.col("text")))
