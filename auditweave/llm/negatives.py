"""Exact hard negatives: candidates of each anchor cluster in the order of an angular upper bound, walked until certified."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditweave.llm.base import Scratch, parts_for, sorted_groups
from auditweave.plans.joins import stored

SEED = 12
EVERY = 50
POSITIVES = 5
NEGATIVES = 3
#: A negative scores between these hundredths of the positive's score.
LOWEST, HIGHEST = 50, 95
RELABEL_EVERY, LABELS = 7, 10
SCALE = 256
#: Anchors that clusters are fitted on, at most; every anchor is then put into one.
SAMPLE_ANCHORS = 4_096
CLUSTER_ANCHORS = 256
MOST_CLUSTERS = 32
#: Rows of one comparison on either side; the first step of a walk and how much longer each next one is.
BLOCK_ANCHORS = 1_024
BLOCK_ROWS = 8_192
FIRST_STEP = 4_096
GROWTH = 4
#: Rows with a larger squared length could have scores that no long holds.
MOST_SQUARE = float(1 << 62)
SLACK = 1e-9


def floored(vectors: DataFrame, column: str) -> DataFrame:
    """(vec_id, label, v): rows that take part, one per id, with moved labels and whole components (as doubles)."""
    whole = F.transform("raw", lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    finite = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col(column).alias("raw"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("raw") > 0) & finite)
    moved = F.when(F.col("vec_id") % RELABEL_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    rows = rows.select("vec_id", moved.alias("label"), whole.alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x)
    rows = rows.where(square <= MOST_SQUARE)
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row")).select("vec_id", "row.*")


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _lengths(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows * rows).sum(axis=1))


def _angles(rows: np.ndarray, lengths: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Angles between rows and unit centers; zero rows are at angle 0."""
    cosines = (rows @ centers.T) / np.where(lengths > 0, lengths, 1.0)[:, None]
    return np.where((lengths > 0)[:, None], np.arccos(np.clip(cosines, -1.0, 1.0)), 0.0)


def fit_centers(anchors: DataFrame, count: int, dim: int, clusters: int | None = None) -> np.ndarray:
    """Unit centers of clusters of anchors, by spherical k-means on a bounded sample."""
    picked = anchors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ANCHORS).select("v").toArrow()
    rows = _matrix(picked.column("v"), dim)
    lengths = _lengths(rows)
    units = rows[lengths > 0] / lengths[lengths > 0, None]
    wanted = clusters or min(MOST_CLUSTERS, parts_for(count, CLUSTER_ANCHORS))
    if not len(units):
        return np.eye(1, dim)
    rng = np.random.default_rng(SEED)
    centers = units[rng.permutation(len(units))[:wanted]]
    for _ in range(12):
        own = np.argmax(units @ centers.T, axis=1)
        for i in range(len(centers)):
            total = units[own == i].sum(axis=0)
            size = np.sqrt(total @ total)
            centers[i] = total / size if size > 0 else centers[i]
    return centers


def _clustered(centers: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The cluster of each anchor, its length and its angle to the center."""

    def run(batches):
        for batch in batches:
            rows = _matrix(batch.column("v"), centers.shape[1])
            lengths = _lengths(rows)
            angles = _angles(rows, lengths, centers)
            own = np.argmin(angles, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(lengths), pa.array(angles[np.arange(len(own)), own])],
                                             names=[*batch.schema.names, "cluster", "length", "angle"])

    return run


def _bounded(centers: np.ndarray, widest: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per row its bound in each cluster: no anchor of length 1 in it has a larger inner product with the row.

    The angle to an anchor is at least the angle to the center less the widest angle of the cluster.
    """

    def run(batches):
        for batch in batches:
            rows = _matrix(batch.column("v"), centers.shape[1])
            lengths = _lengths(rows)
            apart = np.maximum(0.0, _angles(rows, lengths, centers) - widest - 1e-7)
            bounds = lengths[:, None] * np.cos(apart)
            bounds += SLACK * (lengths[:, None] + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(bounds), pa.list_(pa.float64()))], names=[*batch.schema.names, "bounds"])

    return run


def inner_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in doubles where no sum can leave their whole range, else in longs."""
    reach = _lengths(left).max() * _lengths(right).max()
    if reach < 2.0**52:
        return (left @ right.T).astype(np.int64)
    return left.astype(np.int64) @ right.astype(np.int64).T


def _first(order_by: np.ndarray, ids: np.ndarray, which: np.ndarray, most: int) -> np.ndarray:
    """Indices of the ``most`` best of ``which``: larger values first, ties by the smaller id."""
    if len(which) > most:
        least = np.partition(order_by[which], len(which) - most)[len(which) - most]
        which = which[order_by[which] >= least]
    return which[np.lexsort((ids[which], -order_by[which]))][:most]


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.Table]]:
    """The anchors and the candidates of each cell."""
    for cell in sorted_groups(batches, "cluster", "block", "part"):
        anchor = cell.column("anchor")
        yield cell.filter(anchor), cell.filter(pa.compute.invert(anchor))


def _positives(dim: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for anchors, rows in _sides(batches):
            if not anchors.num_rows or not rows.num_rows:
                continue
            scores = inner_products(_matrix(anchors.column("v"), dim), _matrix(rows.column("v"), dim))
            ids, labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
            out = []
            for i, (anchor, label) in enumerate(zip(anchors.column("vec_id").to_pylist(), anchors.column("label").to_pylist())):
                best = _first(scores[i], ids, np.flatnonzero((labels == label) & (ids != anchor)), most)
                out += zip([anchor] * len(best), ids[best].tolist(), scores[i][best].tolist())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["anchor_id", "positive_id", "positive_score"])

    return run


def _negatives(dim: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]

    def run(batches):
        for anchors, rows in _sides(batches):
            if not anchors.num_rows or not rows.num_rows:
                continue
            scores = inner_products(_matrix(anchors.column("v"), dim), _matrix(rows.column("v"), dim))
            ids, labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
            out = []
            columns = (anchors.column(c).to_pylist() for c in ("vec_id", "label", "positives"))
            for i, (anchor, label, positives) in enumerate(zip(*columns)):
                for p in positives:
                    # In Python's whole numbers: a hundredfold score may leave the range of a long.
                    low, high = -(-LOWEST * p["score"] // 100), HIGHEST * p["score"] // 100
                    fit = np.flatnonzero((labels != label) & (scores[i] >= low) & (scores[i] <= high))
                    best = _first(scores[i], ids, fit, most)
                    out += ((anchor, p["id"], p["score"], n, s) for n, s in zip(ids[best].tolist(), scores[i][best].tolist()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    return run


def _by_cluster(values: np.ndarray) -> Column:
    """The value of a row's cluster; clusters are few."""
    kind = "int" if values.dtype.kind == "i" else "double"
    return F.element_at(F.array(*[F.lit(v.item()).cast(kind) for v in values]), F.col("cluster") + 1)


class Walk:
    """The lists of all clusters, cut into steps, and what the anchors still walking meet in a step.

    A list is the candidates by falling bound. It is never gathered: a step is a range of bounds per cluster,
    and its rows, counted first, meet the walking anchors in cells of bounded size.
    """

    def __init__(self, rows: DataFrame, dim: int, scratch: Scratch, every: int, clusters: int | None, first_step: int, block_rows: int):
        self.dim, self.scratch, self.block_rows = dim, scratch, block_rows
        anchors = rows.where(F.col("vec_id") % every == 0)
        counts = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("vec_id") % every == 0).alias("anchors")).first()
        self.rows, self.count = counts["rows"], counts["anchors"]
        if not self.count:
            return
        centers = fit_centers(anchors, self.count, dim, clusters)
        placed = anchors.select("vec_id", "label", "v").mapInArrow(_clustered(centers), "vec_id bigint, label bigint, v array<double>, cluster int, length double, angle double")
        self.anchors = scratch.stored(placed, "anchors")
        widest, sizes = np.zeros(len(centers)), np.zeros(len(centers), dtype=np.int64)
        for row in self.anchors.groupBy("cluster").agg(F.max("angle").alias("widest"), F.count(F.lit(1)).alias("n")).collect():
            widest[row["cluster"]], sizes[row["cluster"]] = row["widest"], row["n"]
        self.blocks = np.maximum(1, -(-sizes // BLOCK_ANCHORS)).astype(np.int32)
        bounded = rows.select("vec_id", "label", "v").mapInArrow(_bounded(centers, widest), "vec_id bigint, label bigint, v array<double>, bounds array<double>")
        self.candidates = scratch.stored(bounded, "candidates")
        ends, end = [], first_step
        while end < self.rows:
            ends.append(1 - end / self.rows)
            end = end * GROWTH + first_step
        self.limits = [np.full(len(centers), np.inf)]
        if ends:
            shares = F.array(*[F.lit(e) for e in ends])
            cuts = self.candidates.agg(*[F.percentile_approx(F.col("bounds")[i], shares, F.lit(10_000)).alias(str(i)) for i in range(len(centers))]).first()
            self.limits += [np.array(c) for c in zip(*cuts)]
        self.limits.append(np.full(len(centers), -np.inf))

    def steps(self) -> range:
        return range(len(self.limits) - 1)

    def below(self, step: int) -> Column:
        """The largest score that an anchor can still meet after ``step``, as a column of its cluster and length."""
        rest = self.limits[step + 1]
        return F.when(F.lit(step == len(self.limits) - 2), F.lit(float("-inf"))).otherwise(
            F.col("length") * _by_cluster(np.where(np.isfinite(rest), rest, 0.0)) * (1 + SLACK) + SLACK)

    def cells(self, step: int, walking: DataFrame) -> DataFrame:
        """The rows of a step and the ``walking`` anchors of its cluster, sorted by cell (cluster, block, part)."""
        active = np.zeros(len(self.blocks), dtype=bool)
        for row in walking.select("cluster").distinct().collect():
            active[row["cluster"]] = True
        upper, lower = self.limits[step], self.limits[step + 1]
        wanted = [F.when(F.lit(bool(on)), (F.col("bounds")[i] <= float(up)) & ((F.col("bounds")[i] > float(low)) | F.lit(bool(np.isneginf(low)))))
                  for i, (on, up, low) in enumerate(zip(active, upper, lower))]
        clusters = F.array_compact(F.array(*[F.when(w, F.lit(i)) for i, w in enumerate(wanted)]))
        rows = self.candidates.select("vec_id", "label", "v", F.explode(clusters).alias("cluster"))
        parts = np.ones(len(self.blocks), dtype=np.int32)
        for row in self.candidates.select(F.explode(clusters).alias("cluster")).groupBy("cluster").count().collect():
            parts[row["cluster"]] = parts_for(row["count"], self.block_rows)
        part = F.pmod(F.xxhash64("vec_id"), _by_cluster(parts)).cast("int").alias("part")
        every_block = F.explode(F.sequence(F.lit(0), _by_cluster(self.blocks) - 1)).alias("block")
        positives = F.lit(None).cast("array<struct<id:bigint,score:bigint>>").alias("positives")
        rows = rows.select("cluster", every_block, part, F.lit(False).alias("anchor"), "vec_id", "label", "v", positives)
        block = F.pmod(F.xxhash64("vec_id"), _by_cluster(self.blocks)).cast("int").alias("block")
        own = walking.select("cluster", block, F.explode(F.sequence(F.lit(0), _by_cluster(parts) - 1)).alias("part"), F.lit(True).alias("anchor"),
                             "vec_id", "label", "v", F.col("positives") if "positives" in walking.columns else positives)
        return rows.union(own).repartition("cluster", "block", "part").sortWithinPartitions("cluster", "block", "part")


def _best(found: DataFrame, of: list[str], score: str, ids: str, most: int) -> DataFrame:
    order = Window.partitionBy(*of).orderBy(F.desc(score), ids)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _walk_positives(walk: Walk, most: int) -> DataFrame:
    best, walking = None, walk.anchors
    for step in walk.steps():
        found = walk.cells(step, walking).mapInArrow(_positives(walk.dim, most), "anchor_id bigint, positive_id bigint, positive_score bigint")
        found = found if best is None else best.drop("rank").unionByName(found)
        best = walk.scratch.stored(_best(found, ["anchor_id"], "positive_score", "positive_id", most), "positives")
        full = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("n"), F.min("positive_score").alias("last"))
        sure = (F.coalesce("n", F.lit(0)) >= most) & (F.col("last") > walk.below(step))
        walking = walk.scratch.stored(walking.join(full, "vec_id", "left").where(~F.coalesce(sure, F.lit(False))).drop("n", "last"), "walking")
        if walking.isEmpty():
            break
    return best


def _walk_negatives(walk: Walk, positives: DataFrame, most: int) -> DataFrame:
    lists = positives.where("positive_score >= 0").groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))).alias("positives"))
    best, walking = None, walk.scratch.stored(walk.anchors.join(lists, "vec_id"), "walking")
    schema = "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
    for step in walk.steps():
        found = walk.cells(step, walking).mapInArrow(_negatives(walk.dim, most), schema)
        found = found if best is None else best.drop("rank").unionByName(found)
        best = walk.scratch.stored(_best(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", most), "negatives")
        full = best.groupBy(F.col("anchor_id").alias("vec_id"), F.col("positive_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("negative_score").alias("last"))
        open_ = walking.select("*", F.explode("positives").alias("p")).select("*", F.col("p.id").alias("id"), F.col("p.score").alias("score"), walk.below(step).alias("rest"))
        sure = (F.coalesce("n", F.lit(0)) >= most) & (F.col("last") > F.col("rest"))
        sure = sure | (F.col("rest") * 100 < F.col("score") * float(LOWEST) * (1 - SLACK))
        open_ = open_.join(full, ["vec_id", "id"], "left").where(~F.coalesce(sure, F.lit(False)))
        kept = open_.groupBy("vec_id").agg(F.collect_list("p").alias("positives"))
        walking = walk.scratch.stored(walk.anchors.join(kept, "vec_id"), "walking")
        if walking.isEmpty():
            break
    return best


def hard_negatives(vectors: DataFrame, column: str = "embedding", every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   clusters: int | None = None, first_step: int = FIRST_STEP, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For each anchor of ``vectors`` (vec_id, label) and each of its positives the hardest rows of other labels.

    Columns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score. Anchors are the
    rows whose id ``every`` divides; the score of a row is its inner product with the anchor, in whole
    numbers. Positives are the first rows of the anchor's label, negatives the first of other labels that score
    between LOWEST and HIGHEST hundredths of the positive.

    Anchors are clustered by angle. No anchor of a cluster scores more with a row than the lengths of both and
    the angle of the row to the cluster allow, so all its anchors walk the rows by that bound, in growing
    steps. An anchor stops as soon as its last place scores more than the bound of the rest, which certifies
    its rows; if it has too few, it walks to the end. Rows and anchors of a step meet in cells of bounded size.

    Nulls: rows with a null id, label, vector or component, or one that is not finite, take no part, nor do
    empty vectors, vectors of another length than most and such whose scores a long may not hold. A zero
    vector scores 0. Ties go to the smaller id. Rows of one id count once, the smallest by label and vector.
    A negative positive_score has no negatives. Empty table or no anchors: no rows. Other columns are not read.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = scratch.stored(floored(vectors, column), "vectors")
    empty = vectors.sparkSession.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    most = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    walk = most and Walk(rows.where(F.size("v") == most["dim"]), most["dim"], scratch, every, clusters, first_step, block_rows)
    out = empty
    if walk and walk.count:
        mined = _walk_negatives(walk, _walk_positives(walk, positives), negatives)
        out = stored(mined.select(*empty.columns), "hard-negatives")
    scratch.drop()
    return out
