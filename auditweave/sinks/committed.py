"""A report sink that commits: after a crash a report is either the old one or the new one.

A write puts its files into a folder of its own, ``<path>/gen-<id>/``, one file per task and project. A task
names its files after its attempt, so a failed attempt or a speculative twin leaves files that no commit
names. The commit of the driver replaces ``<path>/current.json``, which names the folder and one attempt per
task: a single rename. Readers begin there.
"""

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

CURRENT = "current.json"
FORMAT = "committed_report"


@dataclass
class Written(WriterCommitMessage):
    """What a task tells the driver: its place in the order and the name of its attempt, whatever its rows."""

    task: int
    attempt: str
    rows: int


def shared(path: str) -> str:
    """A folder's path without ``file:``; a store without atomic renames is refused."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        raise ValueError(f"a folder that driver and executors mount is needed, got {path}")
    return path


def current(path: str) -> dict | None:
    """The commit that readers see, or None."""
    try:
        with open(os.path.join(shared(path), CURRENT), encoding="utf-8") as file:
            return json.load(file)
    except FileNotFoundError:
        return None


class ReportWriter(DataSourceWriter):
    def __init__(self, path: str, columns: list[str], overwrite: bool):
        if not overwrite:
            raise ValueError("a report is replaced as a whole: use mode overwrite")
        if columns != ["project", "text"]:
            raise ValueError(f"columns project and text are needed, got {columns}")
        self.path, self.generation = shared(path), f"gen-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Written:
        context = TaskContext.get()
        task = context.partitionId()
        attempt = f"{task:06d}-{uuid.uuid4().hex}"
        count, project, out = 0, None, None
        try:
            for row in rows:
                if out is None or row.project != project:
                    if out is not None:
                        out.close()
                    project = row.project
                    folder = os.path.join(self.path, self.generation, folder_of(project))
                    os.makedirs(folder, exist_ok=True)
                    out = open(os.path.join(folder, f"{attempt}.txt"), "a", encoding="utf-8")
                out.write(row.text + "\n")
                count += 1
        finally:
            if out is not None:
                out.close()
        return Written(task, attempt, count)

    def commit(self, messages: list[Written | None]) -> None:
        done = sorted((m for m in messages if m is not None), key=lambda m: m.task)
        before = current(self.path)
        os.makedirs(os.path.join(self.path, self.generation), exist_ok=True)
        draft = os.path.join(self.path, f"{self.generation}.json")
        with open(draft, "w", encoding="utf-8") as file:
            json.dump({"generation": self.generation, "attempts": [m.attempt for m in done], "rows": sum(m.rows for m in done)}, file)
            file.flush()
            os.fsync(file.fileno())
        os.replace(draft, os.path.join(self.path, CURRENT))
        if before is not None:
            shutil.rmtree(os.path.join(self.path, before["generation"]), ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(os.path.join(self.path, self.generation), ignore_errors=True)


class CommittedReport(DataSource):
    """``df.select("project", "text").write.format("committed_report").mode("overwrite").save(path)``.

    Rows go to the files in their order; sort them by project inside tasks and by task, as :func:`write_committed`
    does. ``path`` is a folder that driver and executors share.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> ReportWriter:
        return ReportWriter(self.options["path"], schema.fieldNames(), overwrite)


def folder_of(project: str | None) -> str:
    """The folder of a project; the name is quoted, so any name is one folder, and null has its own."""
    return "null" if project is None else "p-" + quote(project, safe="").replace(".", "%2E")


def write_committed(parts: DataFrame, path: str) -> None:
    """Replace the report at ``path`` by ``parts`` (project, part, ordinal, text), all of it or nothing.

    Parts are dealt by ranges of their order, so a project with a third of all parts is written by many tasks.
    Texts must not hold line ends, as JSON has none. Empty parts: a report without documents.
    """
    parts.sparkSession.dataSource.register(CommittedReport)
    order = ("project", "part", "ordinal")
    ranged = parts.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.select("project", "text").write.format(FORMAT).mode("overwrite").option("path", path).save()


def committed_lines(spark: SparkSession, path: str) -> DataFrame:
    """``project, attempt, text``: every line of the report that is committed at ``path``.

    Files of attempts that the commit does not name are passed over. ``project`` is null for the null project.
    """
    commit = current(path)
    if commit is None:
        raise FileNotFoundError(f"no committed report at {path}")
    schema = "project string, attempt string, text string"
    if not commit["rows"]:
        return spark.createDataFrame([], schema)
    rows = spark.read.option("recursiveFileLookup", "true").text(f"file://{os.path.abspath(os.path.join(shared(path), commit['generation']))}")
    place = F.split(F.col("_metadata.file_path"), "/")
    attempt = F.regexp_replace(F.element_at(place, -1), r"\.txt$", "")
    # The listing quotes the folder's name once more.
    folder = F.url_decode(F.element_at(place, -2))
    named = rows.select(folder.alias("folder"), attempt.alias("attempt"), F.col("value").alias("text"))
    kept = named.join(F.broadcast(spark.createDataFrame([(a,) for a in commit["attempts"]], "attempt string")), "attempt", "left_semi")
    name = F.when(F.col("folder") != "null", F.url_decode(F.substring(F.col("folder"), F.lit(3), F.length("folder"))))
    return kept.select(name.alias("project"), "attempt", "text")


def document_at(path: str, project: str | None) -> str:
    """The committed document of one project, read on the driver."""
    commit = current(path)
    if commit is None:
        raise FileNotFoundError(f"no committed report at {path}")
    folder = os.path.join(shared(path), commit["generation"], folder_of(project))
    named = set(commit["attempts"])
    out = []
    for name in sorted(os.listdir(folder)):
        if name.removesuffix(".txt") in named:
            with open(os.path.join(folder, name), encoding="utf-8") as file:
                out.extend(line.rstrip("\n") for line in file)
    return "".join(out)
