"""Approximate nearest neighbours by multiprobe p-stable hashing."""

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditweave.llm.base import parts_for
from auditweave.plans.joins import stored

SEED = 5
TABLES = 3
WIDTH = 1.0
NEAREST = 5
#: Rows that the number of hashes and probes is fitted on, at most, and those of them that are searched.
SAMPLE_ROWS = 4_096
SAMPLE_QUERIES = 256
BUCKET_ROWS = 500
MOST_PROBES = 600
LEAST_RECALL = 0.96
#: Cells of one hash: -8 to 7; what lies beyond is in the outermost.
CELLS = 16
SPREAD = 4
#: Vectors that one task compares with the queries of a bucket; a larger bucket is split.
BLOCK_ROWS = 4_096


@dataclass
class Hashing:
    """p-stable hashes floor(a.x + b) of unit vectors: ``hashes`` of them to a key, ``probes`` keys to a query."""

    dim: int
    hashes: int
    probes: int
    spread: float
    tables: int = TABLES
    width: float = WIDTH

    def places(self, units: np.ndarray) -> np.ndarray:
        """Places of ``units`` (rows) on the lines of every table: tables x rows x hashes."""
        rng = np.random.default_rng((SEED, self.dim))
        lines = rng.standard_normal((self.tables, self.dim, 12))[:, :, : self.hashes]
        shifts = rng.random((self.tables, 1, 12))[:, :, : self.hashes]
        return np.einsum("nd,tdh->tnh", units, lines) / self.width + shifts

    @staticmethod
    def key(cells: np.ndarray) -> np.ndarray:
        """One number for the cells (last axis) of a bucket."""
        cells = np.clip(cells, -CELLS // 2, CELLS // 2 - 1).astype(np.int64) + CELLS // 2
        return (cells << (4 * np.arange(cells.shape[-1]))).sum(axis=-1)

    def probed(self, places: np.ndarray) -> np.ndarray:
        """Keys of the buckets to visit for each row of ``places`` (rows x hashes), likeliest first.

        A neighbour's place on a line is normal around the query's, so a perturbed cell has the
        probability of its interval, and a bucket the product of its cells. Lines are added one by one
        and the best ``probes`` kept, which loses none of the best in the end.
        """
        rows, hashes = places.shape
        base = np.floor(places)
        within = places - base
        moves = np.arange(-SPREAD, SPREAD + 1)
        edges = np.append(moves, SPREAD + 1) - within[:, :, None]
        below = _normal(edges / self.spread)
        chance = np.log(np.maximum(np.diff(below, axis=-1), 1e-12))
        best = np.zeros((rows, 1))
        cells = np.zeros((rows, 1, 0))
        for line in range(hashes):
            total = (best[:, :, None] + chance[:, None, line, :]).reshape(rows, -1)
            kept = np.argsort(-total, axis=1, kind="stable")[:, : self.probes]
            best = np.take_along_axis(total, kept, axis=1)
            before = np.take_along_axis(cells, (kept // len(moves))[:, :, None], axis=1)
            own = base[:, line, None] + moves[kept % len(moves)]
            cells = np.concatenate([before, own[:, :, None]], axis=2)
        return self.key(cells)


def _normal(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, by a logistic approximation that is exact enough to rank by."""
    return 1 / (1 + np.exp(-np.clip(1.5976 * x + 0.070566 * x**3, -60, 60)))


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """Rows with an id and a vector that is not null, empty or zero and holds finite numbers only."""
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col("vec_id").isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))


def fit(vectors: DataFrame, rows: int, dim: int, tables: int = TABLES) -> Hashing:
    """Choose hashes and probes on a bounded sample of ``vectors`` (vec_id, v): the finest buckets that reach the recall.

    Neighbours inside a sample are farther than those in the whole table, so what finds them there finds
    nearer ones more often. If none reaches it, the coarsest with the most probes is taken.
    """
    picked = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("v").collect()
    units = unit_rows(np.array([r["v"] for r in picked], dtype=np.float64).reshape(len(picked), dim))
    queries = units[:SAMPLE_QUERIES]
    nearness = queries @ units.T
    np.fill_diagonal(nearness, -2)
    count = min(NEAREST, max(1, len(units) - 1))
    near = np.argsort(-nearness, axis=1, kind="stable")[:, :count]
    apart = math.sqrt(max(1e-4, float(np.median(2 - 2 * np.take_along_axis(nearness, near, axis=1)))))
    finest = min(12, max(1, round(math.log2(max(2, rows / BUCKET_ROWS)) / 2)))
    for hashes in range(finest, 0, -1):
        hashing = Hashing(dim, hashes, MOST_PROBES, apart / WIDTH, tables)
        places = hashing.places(units)
        keys = hashing.key(np.floor(places))
        rank = np.full(near.shape, MOST_PROBES, dtype=np.int64)
        for table in range(tables):
            probed = hashing.probed(places[table, : len(queries)])
            hit = probed[:, None, :] == keys[table][near][:, :, None]
            rank = np.minimum(rank, np.where(hit.any(axis=2), hit.argmax(axis=2), MOST_PROBES))
        needed = int(np.sort(rank.ravel())[min(rank.size - 1, math.ceil(LEAST_RECALL * rank.size))]) + 1
        if needed <= MOST_PROBES:
            return Hashing(dim, hashes, needed, apart / WIDTH, tables)
    return Hashing(dim, 1, MOST_PROBES, apart / WIDTH, tables)


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def buckets(vectors: DataFrame, hashing: Hashing, probing: bool) -> DataFrame:
    """(table, bucket) of each of ``vectors`` (vec_id, v): its own, or those that it probes, with id and vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                batch = whole.slice(begin, 512)
                places = hashing.places(unit_rows(_matrix(batch, hashing.dim)))
                for table in range(hashing.tables):
                    keys = hashing.probed(places[table]) if probing else hashing.key(np.floor(places[table]))[:, None]
                    row = np.repeat(np.arange(batch.num_rows), keys.shape[1])
                    cells = pd.DataFrame({"row": row, "bucket": keys.ravel()}).drop_duplicates()
                    own = pa.array(cells["row"].to_numpy())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(cells), table, dtype=np.int32)), pa.array(cells["bucket"].to_numpy()),
                         batch.column("vec_id").take(own), batch.column("v").take(own)], names=["table", "bucket", "vec_id", "v"])

    kind = vectors.schema["v"].dataType.simpleString()
    return vectors.mapInArrow(run, f"table int, bucket bigint, vec_id bigint, v {kind}")


def nearest_in_block(points: pd.DataFrame, queries: pd.DataFrame, nearest: int = NEAREST) -> pd.DataFrame:
    """The ``nearest`` points of one bucket block for each query that visits it, by exact cosine.

    A matrix product names those that can be among them, and their cosines are then computed one by one
    in a fixed order of additions, so equal vectors have equal scores.
    """
    out = []
    if len(points) and len(queries):
        right, left = (np.vstack(x["v"].to_numpy()).astype(np.float64) for x in (points, queries))
        ids = points["vec_id"].to_numpy()
        right_size, left_size = (np.sqrt((x * x).sum(axis=1)) for x in (right, left))
        for begin in range(0, len(left), 256):
            rough = (left[begin : begin + 256] @ right.T) / right_size / left_size[begin : begin + 256, None]
            rough[queries["vec_id"].to_numpy()[begin : begin + 256, None] == ids] = -9.0
            bound = np.partition(rough, max(0, rough.shape[1] - nearest), axis=1)[:, max(0, rough.shape[1] - nearest)]
            for i in range(len(rough)):
                chosen = np.flatnonzero((rough[i] >= bound[i] - 1e-9) & (rough[i] > -5))
                q = begin + i
                score = (right[chosen] * left[q]).sum(axis=1) / (right_size[chosen] * left_size[q])
                best = np.lexsort((ids[chosen], -score))[:nearest]
                out.append(pd.DataFrame({"query_id": queries["vec_id"].iloc[q], "vec_id": ids[chosen][best], "score": score[best]}))
    columns = {"query_id": "int64", "vec_id": "int64", "score": "float64"}
    return pd.concat(out).astype(columns) if out else pd.DataFrame({c: pd.Series(dtype=k) for c, k in columns.items()})


def in_blocks(points: DataFrame, visits: DataFrame, where: list[str], nearest: int) -> DataFrame:
    """(query_id, vec_id, score) of the ``nearest`` points of each block ``where`` for each query that visits it."""
    return points.groupBy(*where).cogroup(visits.groupBy(*where)).applyInPandas(
        lambda a, b: nearest_in_block(a, b, nearest), "query_id bigint, vec_id bigint, score double")


def in_buckets(good: DataFrame, queries: DataFrame, hashing: Hashing, nearest: int, block_rows: int) -> DataFrame:
    """The best points of every bucket block that ``queries`` probe."""
    points = buckets(good, hashing, probing=False)
    visits = buckets(queries, hashing, probing=True)
    full = points.groupBy("table", "bucket").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    full = stored(full, "buckets")  # a join with a stored table can split a large bucket
    split = full.where("blocks > 1").toDF("table", "bucket", "split_blocks")
    block = F.pmod(F.xxhash64("vec_id"), F.coalesce("split_blocks", F.lit(1))).cast("int")
    points = points.join(split, ["table", "bucket"], "left").select("table", "bucket", block.alias("block"), "vec_id", "v")
    every_block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    visits = visits.join(full, ["table", "bucket"]).select("table", "bucket", every_block.alias("block"), "vec_id", "v")
    visits = visits.toDF("table", "bucket", "block", "vec_id", "v")
    return in_blocks(points, visits, ["table", "bucket", "block"], nearest)


def in_all_blocks(good: DataFrame, queries: DataFrame, blocks: int, nearest: int) -> DataFrame:
    """The best points of every block of all rows for ``queries``, without hashing."""
    points = good.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "v")
    visits = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "v")
    return in_blocks(points, visits, ["block"], nearest)


def ranked(found: DataFrame, nearest: int) -> DataFrame:
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest)


def search(vectors: DataFrame, column: str = "embedding", every: int = 50, nearest: int = NEAREST, tables: int = TABLES,
           hashing: Hashing | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The ``nearest`` other rows of each row of ``vectors`` (vec_id) whose id ``every`` divides, by largest cosine.

    Columns query_id, rank (from 1), vec_id, score. Rows are put into one bucket of each table, queries
    visit the likeliest ones; a bucket of over ``block_rows`` rows is split, and each block keeps its own
    best for each query before anything is shuffled again. Queries that found fewer rows than ``nearest`` are
    sent alone through coarser buckets with most probes, and at last through all rows.

    Nulls: rows with a null id or a null, empty, zero or not finite vector take no part, nor do vectors of
    another length than most. Ties go to the smaller id. Repeated rows count once. Empty table: no rows.
    Fewer candidates than ``nearest``: all of them. Other columns are not read.
    """
    spark = vectors.sparkSession
    good = usable(vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col(column).alias("v")), "v")
    sizes = good.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if sizes is None:
        return empty
    good = good.where(F.size("v") == sizes["dim"])
    hashing = hashing or fit(good, sizes["count"], sizes["dim"], tables)
    queries = good.where(F.col("vec_id") % every == 0)
    found = in_buckets(good, queries, hashing, nearest, block_rows)
    while True:
        best = stored(ranked(found, nearest), "nearest")
        counts = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
        short = queries.select(F.col("vec_id").alias("query_id")).distinct().join(counts, "query_id", "left")
        short = stored(short.where(F.coalesce("n", F.lit(0)) < nearest), "short")
        if short.isEmpty() or not short.where(F.coalesce("n", F.lit(0)) < good.select("vec_id").distinct().count() - 1).count():
            return best.select("query_id", "rank", "vec_id", "score")
        again = good.join(short, good["vec_id"] == short["query_id"], "left_semi")
        if hashing.hashes > 1:
            hashing = replace(hashing, hashes=hashing.hashes // 2, probes=MOST_PROBES)
            more = in_buckets(good, again, hashing, nearest, block_rows)
        else:
            more = in_all_blocks(good, again, parts_for(sizes["count"], block_rows), nearest)
        found = best.select("query_id", "vec_id", "score").unionByName(more)
