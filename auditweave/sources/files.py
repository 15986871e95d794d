"""Source files: scan, admission, decoding and errors."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditweave import vocab
from auditweave.functions import text
from auditweave.plans.joins import lookup_join


def _resolved(spark: SparkSession, root: str) -> str:
    """``root`` as the scan names it: absolute, with its scheme, ending in a slash."""
    if any(c in root for c in "*?[]{}"):
        raise ValueError(f"a root is one directory, not a pattern: {root}")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(root)
    place = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop)
    return place.toString().rstrip("/") + "/"


def read_tree(spark: SparkSession, root: str, project: str | None = None) -> DataFrame:
    """Every file below the directory ``root`` with undecoded ``raw`` content.

    Without a ``project`` name the first directory below the root names it. Filters on
    ``size_bytes`` reach the scan, and a plan that does not use ``raw`` opens no file. Files that
    cannot be read have no row; :func:`tree_errors` names them. The driver lists the files, and
    Spark's scan leaves out names that begin with a dot or an underscore; :mod:`auditweave.sources.tree` does neither.
    """
    base = _resolved(spark, root)
    rows = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("ignoreCorruptFiles", "true")
        .option("ignoreMissingFiles", "true")
        .load(root)
    )
    inside = F.substring(F.col("path"), F.lit(len(base) + 1), F.length("path"))
    wrong = F.raise_error(F.concat(F.col("path"), F.lit(f" is not below {base}")))
    relative = F.when(F.startswith("path", F.lit(base)), inside).otherwise(wrong)
    if project is None:
        name = F.substring_index(relative, "/", 1)
        path = F.substring(relative, F.length(name) + 2, F.length(relative))
    else:
        name, path = F.lit(project), relative
    return rows.select(
        name.alias("project"),
        path.alias("path"),
        F.col("length").alias("size_bytes"),
        F.col("content").alias("raw"),
    )


def tree_errors(spark: SparkSession, root: str, project: str | None = None) -> DataFrame:
    """One error row per file below ``root`` that the listing has and the scan cannot read."""
    listing = read_tree(spark, root, project).select("project", "path")
    return read_errors(listing, read_tree(spark, root, project).select("project", "path", F.col("raw").alias("content")))


def refusal(path: Column, size: Column, max_bytes: int | None = vocab.MAX_FILE_BYTES) -> Column:
    """Why a file is not reviewed, or null."""
    reason = F.when(~text.is_code(path), F.lit("extension")).when(text.in_skipped_dir(path), F.lit("directory"))
    return reason if max_bytes is None else reason.when(size > max_bytes, F.lit("size"))


def is_admitted(max_bytes: int | None = vocab.MAX_FILE_BYTES) -> Column:
    """Whether a file has a code suffix, lies outside skipped directories and has up to ``max_bytes`` (None: any size)."""
    path = F.col("path")
    chosen = text.is_code(path) & ~text.in_skipped_dir(path)
    return chosen if max_bytes is None else (F.col("size_bytes") <= max_bytes) & chosen


def admitted(files: DataFrame, max_bytes: int | None = vocab.MAX_FILE_BYTES) -> DataFrame:
    """The files that :func:`is_admitted` tells."""
    return files.filter(is_admitted(max_bytes))


def file_key() -> Column:
    """A number for a file. Two files of one number only make a candidate too many."""
    return F.xxhash64("project", "path").alias("file")


def files_of(files: DataFrame, keys: DataFrame | None) -> DataFrame:
    """The ``files`` with a project and a path whose number is in ``keys`` (file); null stands for every number."""
    named = files.where(F.col("project").isNotNull() & F.col("path").isNotNull())
    if keys is None:
        return named
    # A number is of one file, so its rows need no salts.
    return lookup_join(named.withColumn("_file", file_key()), keys.toDF("_file"), "_file", "left_semi", spread=["path"], salts=1).drop("_file")


def decoded(files: DataFrame) -> DataFrame:
    """Replace ``raw`` bytes by text."""
    return files.withColumn("content", text.decode_source(F.col("raw"))).drop("raw")


def reviewable(
    files: DataFrame,
    max_lines: int | None = vocab.MAX_FILE_LINES,
    min_lines: int = vocab.MIN_FILE_LINES,
) -> DataFrame:
    """Cap long files (None: leave them whole) and flag those with enough lines for a review.

    Short files keep their row, since they count as scanned. ``truncated`` tells which files were cut.
    """
    cut = F.lit(False) if max_lines is None else F.coalesce(text.line_count(F.col("content")) > max_lines, F.lit(False))
    capped = files.withColumns({"content": text.cap_lines(F.col("content"), max_lines), "truncated": cut})
    enough = text.line_count(text.strip(F.col("content"))) >= min_lines
    return capped.withColumn("long_enough", F.coalesce(enough, F.lit(False)))


def read_errors(listing: DataFrame, files: DataFrame) -> DataFrame:
    """One error row per listed file without readable content.

    A source that marks such files with null content needs no second table: pass it twice.
    """
    readable = files.filter(F.col("content").isNotNull()).select("project", "path")
    return listing.join(readable, ["project", "path"], "left_anti").select(
        "project", "path", F.concat(F.lit("Could not read: "), F.col("path")).alias("error")
    )
