"""Manifests and project roots, found from paths alone."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditweave import vocab
from auditweave.catalogues import DEFAULT_CATALOGUE, Catalogue
from auditweave.plans.joins import lookup_join


def manifest_languages(files: DataFrame, catalogue: Catalogue = DEFAULT_CATALOGUE, also: Sequence[Column] = ()) -> DataFrame:
    """One row per project: the language of the first manifest that lies in its root directory; ``also`` are more aggregates."""
    names = list(catalogue.manifests)
    languages = F.array(*[F.lit(v) for v in catalogue.manifests.values()])
    position = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("path"))
    first = F.min(F.when(position > 0, position))
    return files.groupBy("project").agg(*also, first.cast("int").alias("_first")).withColumn(
        "manifest_language", F.coalesce(F.get(languages, F.col("_first") - 1), F.lit("unknown"))
    ).drop("_first")


def marker_dirs(paths: DataFrame, markers=vocab.ROOT_MARKERS) -> DataFrame:
    """Directories that hold a root marker, from a listing of absolute paths."""
    names = "|".join(m.replace(".", r"\.") for m in markers)
    at = F.regexp_extract("path", rf"^(.*?)/({names})(/|\z)", 1)
    return paths.filter(F.col("path").rlike(rf"/({names})(/|\z)")).select(at.alias("dir")).distinct()


def nearest_roots(paths: DataFrame, markers: DataFrame) -> DataFrame:
    """Deepest ancestor directory of each path that is listed in ``markers(dir)``, else ``/``.

    Each directory is resolved once, and its files take its answer. Ancestors near the top are shared
    by almost all directories, hence the size-checked lookup.
    """
    above = F.regexp_extract("path", r"(?s)^(.*)/", 1)
    placed = paths.select("path", F.when(F.contains("path", F.lit("/")), above).alias("_dir"))
    segments = F.split("_dir", "/", -1)
    ancestors = F.transform(
        F.sequence(F.lit(1), F.size(segments)),
        lambda depth: F.struct(depth.alias("depth"), F.array_join(F.slice(segments, 1, depth), "/").alias("dir")),
    )
    dirs = placed.filter(F.col("_dir").isNotNull()).select("_dir").distinct()
    climbed = dirs.select("_dir", F.explode(ancestors).alias("a")).select("_dir", "a.depth", "a.dir")
    hits = lookup_join(climbed, markers.select("dir", F.lit(True).alias("_mark")), "dir", "left", spread=["_dir"])
    deepest = hits.groupBy("_dir").agg(F.max(F.when(F.col("_mark"), F.col("depth"))).alias("_depth"))
    root = F.array_join(F.slice(segments, 1, F.col("_depth")), "/")
    return placed.join(deepest, "_dir", "left").select(
        "path", F.when(F.coalesce(root, F.lit("")) == "", F.lit("/")).otherwise(root).alias("root")
    )
