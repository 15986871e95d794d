"""A trigram index of files: which of them a pattern can match, without reading their texts."""

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditweave import vocab
from auditweave.catalogues import DEFAULT_LANGUAGE, Catalogue
from auditweave.functions import patterns as rx
from auditweave.functions import trigrams
from auditweave.operators.context import build_snapshot
from auditweave.plans.joins import lookup_join
from auditweave.plans.joins import stored as stored_once
from auditweave.sources.files import admitted, file_key, files_of

SHARDS = 64
#: Bytes of texts, or postings, after which a task closes a block of files.
BLOCK_BYTES = 2_000_000
BLOCK_POSTINGS = 2_000_000
#: In place of a shard: the rows that hold the files of a block.
FILES = -1
BLOCKS = "shard int, trigram string, block bigint, held binary"
#: How ``held`` begins: a bit for each file of the block, or places in it of two or four bytes.
BITS, SHORT, LONG = b"\0", b"\2", b"\4"


def index_of(files: DataFrame, shards: int = SHARDS, blocks: bool = False) -> DataFrame:
    """(shard, trigram, file): one row per file (project, path, content) and different piece of its text.

    A row per posting, no lists: a piece that is in every file has as many rows as any other needs. A null or
    short text has no rows. With ``blocks`` the same postings come in the form in which they are stored,
    (shard, trigram, block, held): every task makes blocks of its own files, and no row per posting is made.
    """
    if blocks:
        texts = files.select(file_key(), F.col("content").cast("binary").alias("content")).where("content IS NOT NULL")
        return texts.mapInArrow(_indexer(shards), BLOCKS)
    rows = files.select(file_key(), F.explode(trigrams.pieces(F.col("content"))).alias("trigram"))
    return rows.select((F.crc32(F.col("trigram").cast("binary")) % shards).cast("int").alias("shard"), "trigram", "file")


def write_index(index: DataFrame, path: str) -> None:
    """Store an index so that a search reads the shards and row groups of its pieces only.

    Files are stored in blocks. A block lists its files once, and a row per piece holds their places in that list, so a
    posting takes a bit or two bytes instead of a number of eight. An index that comes in blocks is written
    without an exchange; other postings are dealt by their file first. A frequent piece has a row per
    block, spread over the files of all tasks.
    """
    if "block" not in index.columns:
        together = index.select("shard", "trigram", "file").repartition("file").sortWithinPartitions("file")
        index = together.mapInArrow(_blocks, BLOCKS)
    by = ("shard", "trigram", "block")
    index.sortWithinPartitions(*by).write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(shard, trigram, block, held) of a stored index; :func:`postings` has its rows as :func:`index_of` gives them."""
    return spark.read.schema("trigram string, block bigint, held binary, shard int").parquet(path).select("shard", "trigram", "block", "held")


def postings(index: DataFrame) -> DataFrame:
    """(shard, trigram, file) of an index, stored or not."""
    return index.groupBy("block").applyInArrow(_postings, "shard int, trigram string, file bigint") if "block" in index.columns else index


def _indexer(shards: int):
    """A function that cuts the files of a task (file, content) into blocks."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        files, texts, size = [], [], 0

        def closed() -> pa.RecordBatch:
            piece, place, names = trigrams.pieces_of(texts)
            return _block(np.array(files, np.int64), piece, place, names, [zlib.crc32(n.encode()) % shards for n in names], number)

        for batch in batches:
            for file, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                files.append(file)
                texts.append(raw.decode("utf-8", "replace"))
                size += len(raw)
                if size >= BLOCK_BYTES:
                    yield closed()
                    files, texts, size, number = [], [], 0, number + 1
        if files:
            yield closed()

    return blocks


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the postings of a task, in order of their files, into blocks."""
    number = TaskContext.get().partitionId() << 32
    waiting, count, most = [], 0, BLOCK_POSTINGS
    for batch in batches:
        waiting.append(batch)
        count += batch.num_rows
        if count >= most:
            table = pa.Table.from_batches(waiting)
            files = table["file"].to_numpy()
            others = np.flatnonzero(files != files[-1])
            whole = int(others[-1]) + 1 if len(others) else 0
            if whole:
                yield _block_of(table.slice(0, whole), number)
                number += 1
            # The last file may go on in the next batch.
            waiting, count = table.slice(whole).to_batches(), table.num_rows - whole
            most = max(BLOCK_POSTINGS, 2 * count)
    if count:
        yield _block_of(pa.Table.from_batches(waiting), number)


def _block_of(table: pa.Table, number: int) -> pa.RecordBatch:
    pieces = pa.concat_arrays(table["trigram"].chunks).dictionary_encode()
    piece = pieces.indices.to_numpy().astype(np.int64)
    shards = np.empty(len(pieces.dictionary), np.int32)
    shards[piece] = table["shard"].to_numpy()
    rows = table["file"].to_numpy()
    begins = np.append(True, rows[1:] != rows[:-1])
    files = rows[begins]
    posted = np.sort(piece * len(files) + np.cumsum(begins) - 1)
    posted = posted[np.diff(posted, prepend=-1) > 0]
    return _block(files, posted // len(files), posted % len(files), pieces.dictionary.to_pylist(), shards, number)


def _block(files: np.ndarray, piece: np.ndarray, place: np.ndarray, names: list[str], shards: Iterable[int], number: int) -> pa.RecordBatch:
    """The rows of a block: ``piece`` and ``place`` are its postings in order, by numbers in ``names`` and ``files``."""
    starts = np.flatnonzero(np.diff(piece, prepend=-1))
    ends = np.append(starts, len(piece))[1:]
    kind, width = (SHORT, 2) if len(files) <= 1 << 16 else (LONG, 4)
    places = place.astype(f"<u{width}").tobytes()
    held = []
    for start, end in zip(starts.tolist(), ends.tolist()):
        if (end - start) * width * 8 < len(files):
            held.append(kind + places[start * width : end * width])
        else:
            bits = np.zeros(len(files), np.uint8)
            bits[place[start:end]] = 1
            held.append(BITS + np.packbits(bits).tobytes())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([*map(int, shards), FILES], pa.int32()),
            pa.array([*names, ""], pa.string()),
            pa.array(np.full(len(held) + 1, number, np.int64)),
            pa.array([*held, files.astype("<i8").tobytes()], pa.binary()),
        ],
        names=["shard", "trigram", "block", "held"],
    )


def _bits(held: bytes, files: int) -> np.ndarray:
    """A bit for each file of a block."""
    if held[:1] == BITS:
        return np.frombuffer(held, np.uint8, offset=1)
    bits = np.zeros(files, np.uint8)
    bits[np.frombuffer(held, "<u2" if held[:1] == SHORT else "<u4", offset=1)] = 1
    return np.packbits(bits)


def _opened(table: pa.Table) -> tuple[np.ndarray, dict[str, tuple[int, bytes]]]:
    """The files of a block, and the shard and places of each piece."""
    rows = list(zip(*(table[c].to_pylist() for c in ("shard", "trigram", "held"))))
    files = next(np.frombuffer(held, "<i8") for shard, _, held in rows if shard == FILES)
    return files, {trigram: (shard, held) for shard, trigram, held in rows if shard != FILES}


def _postings(table: pa.Table) -> pa.Table:
    files, rows = _opened(table)
    found = {trigram: files[np.unpackbits(_bits(held, len(files)), count=len(files)).astype(bool)] for trigram, (_, held) in rows.items()}
    sizes = [len(f) for f in found.values()]
    shards = np.repeat(np.array([shard for shard, _ in rows.values()], np.int32), sizes)
    places = pa.array(np.repeat(np.arange(len(found)), sizes))
    return pa.table({
        "shard": shards, "trigram": pa.array(list(found), pa.string()).take(places),
        "file": np.concatenate([*found.values(), np.empty(0, np.int64)]).astype(np.int64)})


def _holders(ways: list[frozenset[str]]):
    """A function that finds the files of a block that hold all pieces of one of ``ways``."""

    def find(table: pa.Table) -> pa.Table:
        files, rows = _opened(table)
        bits = {trigram: _bits(held, len(files)) for trigram, (_, held) in rows.items()}
        hit = np.zeros((len(files) + 7) // 8, np.uint8)
        for way in ways:
            if all(piece in bits for piece in way):
                hit |= np.bitwise_and.reduce([bits[piece] for piece in way])
        return pa.table({"file": files[np.unpackbits(hit, count=len(files)).astype(bool)]})

    return find


def update_index(index: DataFrame, changed: DataFrame, files: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The index after ``changed`` (project, path) files were edited, added or deleted; ``files`` has the new texts.

    Rows of other files are taken over without reading their texts.
    """
    index = postings(index)
    keys = changed.select(file_key()).distinct()
    kept = lookup_join(index, keys, "file", "left_anti", spread=["trigram"])
    now = lookup_join(files.withColumn("_file", file_key()), keys.toDF("_file"), "_file", "left_semi", spread=["path"]).drop("_file")
    return kept.select(*index.columns).unionByName(index_of(now, shards))


def candidate_keys(index: DataFrame, patterns: Iterable[str], shards: int = SHARDS) -> DataFrame | None:
    """(file): numbers of the files that one of ``patterns`` can match, or null where every file is a candidate.

    A file is a candidate if it holds all pieces of one way to match. The pieces come from the patterns, so
    they are few, and only their shards are read. In a stored index the rows of a block meet in one task, which
    compares bits; no row per file and piece is made.
    """
    ways = {}
    for pattern in dict.fromkeys(patterns):
        sets = trigrams.needed(pattern)
        if sets is None:
            return None
        for pieces in sets:
            ways.setdefault(pieces, len(ways))
    spark = index.sparkSession
    rows = [(way, piece, len(pieces)) for pieces, way in ways.items() for piece in sorted(pieces)]
    used = sorted({zlib.crc32(piece.encode()) % shards for _, piece, _ in rows})
    asked = sorted({piece for _, piece, _ in rows})
    if not rows:
        held = spark.createDataFrame([], "file bigint")
    elif "block" in index.columns:
        read = index.where(F.col("shard").isin(used) & F.col("trigram").isin(asked) | (F.col("shard") == FILES))
        held = read.groupBy("block").applyInArrow(_holders(list(ways)), "file bigint")
    else:
        wanted = spark.createDataFrame(rows, "way int, trigram string, pieces int")
        read = index.where(F.col("shard").isin(used) & F.col("trigram").isin(asked))
        counted = read.join(F.broadcast(wanted), "trigram").groupBy("way", "file", "pieces").agg(F.count(F.lit(1)).alias("held"))
        held = counted.where("held = pieces").select("file").distinct()
    # Stored, since the size check of a join would search the index once more.
    return stored_once(held, "candidates")


def candidates(index: DataFrame, files: DataFrame, patterns: Iterable[str], shards: int = SHARDS) -> DataFrame:
    """(project, path) of the ``files`` that one of ``patterns`` can match; texts of ``files`` are not read.

    Where a pattern has no certain piece, every file is a candidate; see :func:`candidate_keys`.
    """
    names = files.select("project", "path")
    keys = candidate_keys(index, patterns, shards)
    if keys is None:
        return names
    # A number is of one file, so its rows need no salts.
    return lookup_join(names.withColumn("file", file_key()), keys, "file", "left_semi", spread=["path"], salts=1).select("project", "path")


def matches(index: DataFrame, files: DataFrame, patterns: list[str]) -> DataFrame:
    """(project, path) of the ``files`` that one of ``patterns`` matches; only texts of candidates are searched."""
    found = files_of(files, candidate_keys(index, patterns))
    return found.where(rx.found(F.col("content"), patterns)).select("project", "path")


def catalogue_patterns(catalogue: Catalogue) -> list[str]:
    """Every pattern of a catalogue."""
    kinds = (catalogue.frameworks, catalogue.auth, catalogue.routes, catalogue.models)
    return [p for kind in kinds for patterns in kind.values() for p in patterns] + list(catalogue.roles)


def changed_patterns(old: Catalogue, new: Catalogue) -> list[str] | None:
    """Patterns whose matches can change a context when ``new`` takes the place of ``old``; null if all contexts can."""
    if (old.framework_languages, old.manifests) != (new.framework_languages, new.manifests):
        return None
    out = []
    for kind in ("frameworks", "auth", "routes", "models"):
        before, after = dict(getattr(old, kind)), dict(getattr(new, kind))
        if kind in ("routes", "models") and set(before) != set(after):
            # Projects of that language fell or will fall back to the default language.
            out += [*before.get(DEFAULT_LANGUAGE, ()), *after.get(DEFAULT_LANGUAGE, ())]
        common = [name for name in before if name in after]
        if common != [name for name in after if name in before]:
            out += [p for name in common for p in (*before[name], *after[name])]
        for name in before.keys() | after.keys():
            if list(before.get(name, ())) != list(after.get(name, ())):
                out += [*before.get(name, ()), *after.get(name, ())]
    if list(old.roles) != list(new.roles):
        out += [*old.roles, *new.roles]
    return list(dict.fromkeys(out))


def indexed_snapshot(files: DataFrame, index: DataFrame, catalogue: Catalogue, limit: int | None = vocab.SAMPLE_FILES,
                     projects: DataFrame | None = None) -> DataFrame:
    """The same rows as ``build_snapshot``; texts that no pattern can match are not read."""
    return build_snapshot(files, catalogue, limit, candidate_keys(index, catalogue_patterns(catalogue)), projects)


def recatalogued(stored: DataFrame, files: DataFrame, index: DataFrame, old: Catalogue, new: Catalogue,
                 limit: int | None = vocab.SAMPLE_FILES) -> DataFrame:
    """The snapshot by the ``new`` catalogue from the ``stored`` one by the ``old``.

    Only projects with a file that a changed pattern can match are built again, and of these only the files
    that some pattern can match are read. All other rows are taken over.
    """
    changed = changed_patterns(old, new)
    if changed is None:
        return indexed_snapshot(files, index, new, limit)
    if not changed:
        return stored
    # Stored, since every read of the files below would look the candidates up once more.
    names = stored_once(candidates(index, admitted(files), changed).select("project").distinct(), "touched")
    kept = lookup_join(stored, names, "project", "left_anti", spread=["framework"])
    return kept.unionByName(indexed_snapshot(files, index, new, limit, names))
