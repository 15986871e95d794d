"""Harmonic packing of documents into token sequences of a fixed capacity."""

import functools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditweave.llm.base import parts_for, split_batch
from auditweave.plans.joins import stored

CAPACITY = 1024
CUTS = 3
BLOCK_PIECES = 200_000
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, per_bin int"
PACKED = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


@functools.cache
def byte_bpe(ranks_path: str | None = None) -> Callable[[str], np.ndarray]:
    """The public byte-level BPE as a function from a text to ids; by default the 50k vocabulary.

    The rank file and the ``tokenizers`` file of this vocabulary give the same ids, which the tests
    check; ranks are read by the faster library. The end-of-text string is one id in both.
    """
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    end = {"<|endoftext|>": 50256}
    encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=end)
    return lambda text: encoding.encode_to_numpy(text, allowed_special="all")


def cut(length: int, capacity: int = CAPACITY, cuts: int = CUTS) -> list[tuple[int, int]]:
    """Cut ``length`` tokens into (tokens, pieces of that class to a bin).

    Full sequences first. A rest is cut ``cuts`` times at the largest reciprocal of the capacity that
    fits, so that nearly all tokens lie in pieces that fill their bins; what is left after that is one
    short piece.
    """
    pieces = [(capacity, 1)] * (length // capacity)
    rest = length % capacity
    for _ in range(cuts):
        if rest == 0:
            break
        per_bin = -(-capacity // rest)
        while capacity // per_bin > rest:
            per_bin += 1
        size = capacity // per_bin
        pieces.append((size, capacity // size))
        rest -= size
    if rest:
        pieces.append((rest, capacity // rest))
    return pieces


def tokenized(docs: DataFrame, encoder: Callable[[], Callable[[str], np.ndarray]] = byte_bpe, end_id: int = 0,
              capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document (columns PIECES); a null text counts as empty, so it has one token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for whole in batches:
            for batch in split_batch(whole, "text", 8_000_000):
                rows = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    ids = np.append(np.asarray(encode(text or ""), dtype="<u4"), np.uint32(end_id)).astype("<u4")
                    start = 0
                    for size, per_bin in cut(len(ids), capacity):
                        rows.append((doc_id, start, size, zlib.crc32(ids[start : start + size].tobytes()), len(ids), per_bin))
                        start += size
                columns = list(zip(*rows, strict=True)) if rows else [()] * 6
                kinds = [pa.int64()] * 5 + [pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "per_bin"],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def first_fit(pieces: pd.DataFrame, capacity: int = CAPACITY) -> pd.DataFrame:
    """Put the pieces of one block that fill no bin of their class into shared bins, longest first."""
    pieces = pieces.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
    room: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = [], []
    for size in pieces["length"]:
        chosen = next((by_room[r].pop() for r in range(size, capacity) if by_room[r]), None)
        if chosen is None:
            chosen = len(room)
            room.append(capacity)
        bins.append(chosen)
        offsets.append(capacity - room[chosen])
        room[chosen] -= size
        by_room[room[chosen]].append(chosen)
    block = int(pieces["block"].iloc[0])
    out = pieces[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].copy()
    out["sequence_id"] = (np.int64(block) * 2048 << 32) + np.array(bins, dtype="int64")
    out["offset"] = np.array(offsets, dtype="int64")
    return out


def pack(docs: DataFrame, encoder: Callable[[], Callable[[str], np.ndarray]] = byte_bpe, end_id: int = 0,
         capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens (columns PACKED).

    Harmonic packing: a piece whose length lies in (capacity/(k+1), capacity/k] is of class k, and k
    pieces of a class share a bin. Pieces are dealt by a hash into blocks of about ``block_pieces``, so
    no class is met as a whole by one task, and every block fills the bins of its classes by itself.
    Fewer than k pieces of a class are left in a block; they share bins, longest first, so that each
    block ends with about one bin that is not full.

    Nulls: a null text is empty, a null id stays null. Empty texts: one end token. Ties and repeated
    rows: each row is packed by itself. Empty table: no rows. Other columns are not read.
    """
    pieces = stored(tokenized(docs, encoder, end_id, capacity), "packing")
    blocks = parts_for(pieces.count(), block_pieces)
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(blocks)))
    in_class = Window.partitionBy("block", "per_bin")
    ranked = dealt.withColumn("rank", F.row_number().over(in_class.orderBy("doc_id", "start", "ids_crc32")) - 1)
    ranked = ranked.withColumn("bin", F.floor(F.col("rank") / F.col("per_bin")))
    ranked = ranked.withColumn("fills", (F.col("bin") + 1) * F.col("per_bin") <= F.count(F.lit(1)).over(in_class))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    in_bin = Window.partitionBy("block", "per_bin", "bin").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    full = ranked.where("fills").select(
        *names,
        (F.shiftleft(F.col("block") * 2048 + F.col("per_bin"), 32) + F.col("bin")).alias("sequence_id"),
        F.coalesce(F.sum("length").over(in_bin), F.lit(0)).cast("bigint").alias("offset"),
    )
    rest = ranked.where("NOT fills").groupBy("block").applyInPandas(lambda rows: first_fit(rows, capacity), PACKED)
    return full.unionByName(rest)
