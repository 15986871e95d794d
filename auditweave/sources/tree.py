"""File trees listed and read by tasks: the driver holds neither names nor contents."""

import os
from collections.abc import Iterable, Iterator

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditweave.plans.joins import stored

#: Entries after which a task hands the directories that it has not opened to the next round.
ROUND_ENTRIES = 20_000
#: Rows and bytes of contents that a task passes on at once.
BATCH_ROWS = 2_000
BATCH_BYTES = 32_000_000

ENTRIES = "place string, kind string, size_bytes bigint, error string"
LISTING = ("project", "path", "size_bytes", "place", "error")


def _opened(place: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of an absolute path or URI, and the path in it."""
    return arrow_fs.FileSystem.from_uri(place) if "://" in place else (arrow_fs.LocalFileSystem(), os.path.abspath(place))


def _children(files: arrow_fs.FileSystem, directory: str) -> list[tuple[str, str, int | None]]:
    """``(path, kind, size)`` of the entries of one directory; links to directories are not followed."""
    out = []
    for entry in files.get_file_info(arrow_fs.FileSelector(directory)):
        if entry.type == arrow_fs.FileType.File:
            out.append((entry.path, "file", entry.size))
        elif entry.type == arrow_fs.FileType.Directory:
            if not (isinstance(files, arrow_fs.LocalFileSystem) and os.path.islink(entry.path)):
                out.append((entry.path, "directory", None))
    return out


def _lister(root: str, skipped: frozenset[str], most: int):
    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, _ = _opened(root)
        columns = ["place", "kind", "size_bytes", "error"]
        seen, rows = 0, []
        for frame in frames:
            waiting = list(frame["place"])
            while waiting:
                directory = waiting.pop()
                if seen >= most:
                    rows.append((directory, "directory", None, None))
                else:
                    try:
                        found = _children(files, directory)
                    except OSError as error:
                        rows.append((directory, "failed", None, type(error).__name__))
                        found = []
                    seen += len(found) + 1
                    for path, kind, size in found:
                        if kind == "file":
                            rows.append((path, kind, size, None))
                        elif os.path.basename(path) not in skipped:
                            waiting.append(path)
                while len(rows) >= BATCH_ROWS:
                    yield pd.DataFrame(rows[:BATCH_ROWS], columns=columns).astype({"size_bytes": "Int64"})
                    del rows[:BATCH_ROWS]
        if rows:
            yield pd.DataFrame(rows, columns=columns).astype({"size_bytes": "Int64"})

    return walk


def list_tree(
    spark: SparkSession,
    root: str,
    project: str | None = None,
    skipped: Iterable[str] = (),
    tasks: int | None = None,
    round_entries: int = ROUND_ENTRIES,
) -> DataFrame:
    """``project, path, size_bytes, place, error`` of every file below the directory ``root``, listed by tasks.

    A round deals the directories that are still closed to ``tasks`` tasks by a hash. A task walks down from
    its own until it has seen ``round_entries`` entries and hands the rest back, so one deep project spreads
    over all tasks. Each round is a table in the shared folder; the driver sees only whether directories are
    left. Names that begin with a dot or an underscore count as any other. Directories named in ``skipped``
    are not opened. Links to directories are not followed. A directory that cannot be listed is one row with
    an ``error`` and null size. Without a ``project`` name the first directory below the root names it; files
    right below the root then have their own name as project and an empty path, as in ``read_tree``.

    ``root`` is a path that all executors see, or a URI that Arrow opens. A root that does not exist raises.
    """
    files, base = _opened(root)
    if files.get_file_info(base).type != arrow_fs.FileType.Directory:
        raise ValueError(f"not a directory: {root}")
    tasks = tasks or spark.sparkContext.defaultParallelism
    base = base.rstrip("/") + "/"
    walk = _lister(root, frozenset(skipped), round_entries)
    closed = spark.createDataFrame([(base.rstrip("/") or "/",)], "place string")
    rounds = []
    while True:
        dealt = closed.repartition(tasks, F.xxhash64("place"))
        rounds.append(stored(dealt.mapInPandas(walk, ENTRIES), "tree"))
        closed = rounds[-1].where("kind = 'directory'").select("place")
        if closed.isEmpty():
            break
    found = rounds[0].where("kind <> 'directory'")
    for later in rounds[1:]:
        found = found.unionByName(later.where("kind <> 'directory'"))
    inside = F.substring(F.col("place"), F.lit(len(base) + 1), F.length("place"))
    if project is None:
        name = F.substring_index(inside, "/", 1)
        path = F.substring(inside, F.length(name) + 2, F.length(inside))
    else:
        name, path = F.lit(project), inside
    return found.select(name.alias("project"), path.alias("path"), "size_bytes", "place", "error")


def with_contents(listing: DataFrame, root: str, tasks: int | None = None) -> DataFrame:
    """The files of a (filtered) listing with their ``raw`` bytes; ``error`` says why a file has none.

    Files are dealt by a hash of their place, so a project with a third of all bytes is read by all tasks. A
    task holds one file and one batch at a time. Rows that have an error already keep it.
    """
    tasks = tasks or listing.sparkSession.sparkContext.defaultParallelism

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, _ = _opened(root)
        for frame in frames:
            rows, held = [], 0
            for row in frame.itertuples(index=False):
                raw, error = None, None if pd.isna(row.error) else row.error
                if error is None:
                    try:
                        with files.open_input_stream(row.place) as stream:
                            raw = stream.read()
                    except OSError as failed:
                        error = type(failed).__name__
                rows.append((row.project, row.path, row.size_bytes, raw, error))
                held += len(raw or b"")
                if held >= BATCH_BYTES:
                    yield _contents(rows)
                    rows, held = [], 0
            if rows:
                yield _contents(rows)

    dealt = listing.select(*LISTING).repartition(tasks, F.xxhash64("place"))
    return dealt.mapInPandas(read, "project string, path string, size_bytes bigint, raw binary, error string")


def _contents(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["project", "path", "size_bytes", "raw", "error"]).astype({"size_bytes": "Int64"})


def errors_of(files: DataFrame) -> DataFrame:
    """``project, path, error`` of the directories and files that could not be read."""
    return files.where("error IS NOT NULL").select(
        "project", "path", F.concat(F.lit("Could not read: "), F.col("path")).alias("error"))
