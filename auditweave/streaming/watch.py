"""Reviews of changed files as a stream: admission, quiet time, micro-batch review, totals."""

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQueryListener

from auditweave import vocab
from auditweave.functions import text
from auditweave.operators.chunking import chunk_text
from auditweave.operators.prompts import build_prompts
from auditweave.plans.joins import MAX_BROADCAST_ROWS, at_most, shared_folder, stored
from auditweave.plans.review import Reviewer, replay, review_to_table
from auditweave.plans.scan import contexts_of, findings_of

CHANGE_KINDS = ("modified", "created")
LATENESS = "10 minutes"
RUN = ("project", "path", "first_change", "last_change")
LATE = "run_id string, batch_id long, dropped long"


def admitted_changes(changes: DataFrame, min_bytes: int = vocab.MIN_CHANGE_BYTES) -> DataFrame:
    """Changes of code files outside skipped directories with at least ``min_bytes``."""
    path = F.col("path")
    return changes.filter(
        F.col("kind").isin(*CHANGE_KINDS)
        & ~F.col("is_directory")
        & (F.col("size_bytes") >= min_bytes)
        & text.is_code(path)
        & ~text.in_skipped_dir(path)
    )


def debounce(changes: DataFrame, quiet: str = vocab.DEBOUNCE, lateness: str = LATENESS) -> DataFrame:
    """One row per run of changes of a path that is followed by ``quiet`` time without any.

    Rows of a stream later than ``lateness`` are dropped and counted. A table goes through
    :func:`debounce_history`, which needs no task that holds all changes of a path.
    """
    if not changes.isStreaming:
        return debounce_history(changes, _milliseconds(changes.sparkSession, quiet))
    timed = changes.withWatermark("ts", lateness)
    runs = timed.groupBy(F.session_window("ts", quiet).alias("run"), "project", "path").agg(
        F.max("ts").alias("last_change"), F.count("*").alias("changes")
    )
    return runs.select(
        "project", "path", F.col("run.start").alias("first_change"), "last_change",
        F.col("run.end").alias("fires_at"), "changes",
    )


def _milliseconds(spark: SparkSession, duration: str) -> int:
    """The length of an interval text such as ``800 milliseconds``."""
    moment = F.timestamp_micros(F.lit(0))
    return spark.range(1).select((F.unix_micros(moment + F.expr(f"INTERVAL {duration}")) / 1000).cast("long")).first()[0]


def debounce_history(changes: DataFrame, quiet_ms: int = 800) -> DataFrame:
    """The runs of :func:`debounce` over a stored change log of any size.

    Changes within one slot of the quiet time belong to the same run, so they are first merged
    per slot. A path with a third of all changes thus spreads over its slots, and only one row
    per slot reaches the window that chains slots to runs.
    """
    quiet = quiet_ms * 1000
    kind = changes.schema["ts"].dataType
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    slots = changes.groupBy("project", "path", F.floor(micros / quiet).alias("_slot")).agg(
        F.min(micros).alias("_first"), F.max(micros).alias("_last"), F.count("*").alias("_n")
    )
    in_time = Window.partitionBy("project", "path").orderBy("_first")
    before = F.lag("_last").over(in_time)
    opens = F.when(F.col("_first") - before <= quiet, 0).otherwise(1)
    marked = slots.withColumn("_opens", opens)
    runs = marked.withColumn("_run", F.sum("_opens").over(in_time))
    merged = runs.groupBy("project", "path", "_run").agg(
        F.min("_first").alias("_from"), F.max("_last").alias("_to"), F.sum("_n").alias("changes")
    )
    return merged.select(
        "project", "path",
        F.timestamp_micros("_from").cast(kind).alias("first_change"),
        F.timestamp_micros("_to").cast(kind).alias("last_change"),
        F.timestamp_micros(F.col("_to") + quiet).cast(kind).alias("fires_at"), "changes",
    )


def review_changed(
    fired: DataFrame,
    files: DataFrame,
    snapshot: DataFrame,
    reviewer: Reviewer,
    responses_path: str,
    severity: str | None = vocab.DEFAULT_SEVERITY,
    vuln_classes=None,
    max_tokens: int = vocab.CHUNK_TOKENS,
    overlap_tokens: int = vocab.CHUNK_OVERLAP,
    tasks: int | None = None,
    max_lines: int | None = vocab.MAX_FILE_LINES,
) -> DataFrame:
    """Findings of the current contents of the fired paths: no line minimum, no confidence filter.

    ``max_lines`` cuts long files as in a scan; ``None`` reviews them whole.
    """
    names = fired.select("project", "path").distinct()
    if at_most(names, MAX_BROADCAST_ROWS):
        names = F.broadcast(names)
    current = files.join(names, ["project", "path"], "left_semi")
    capped = current.withColumn("content", text.cap_lines(F.col("content"), max_lines))
    projects = fired.select("project").distinct()
    prompts = build_prompts(
        chunk_text(capped, max_tokens, overlap_tokens), contexts_of(snapshot, projects), vuln_classes, size_of=projects
    )
    responses = review_to_table(prompts, reviewer, responses_path, tasks)
    return findings_of(replay(prompts, responses), severity, confidence=None)


def watch(
    changes: DataFrame,
    files: Callable[[DataFrame], DataFrame],
    snapshot: Callable[[DataFrame], DataFrame],
    reviewer: Reviewer,
    out: str,
    name: str = "watch",
    quiet: str = vocab.DEBOUNCE,
    lateness: str = LATENESS,
    runs_of: Callable[[DataFrame, str, str], DataFrame] = debounce,
    **options,
) -> DataStreamWriter:
    """A writer for ``start()`` that reviews changed files batch by batch into tables below ``out``.

    Set ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` in the session, so that a
    hot path sends one row from each input partition. ``files`` and ``snapshot`` get the projects in which something
    fired as a table with one column, ``project``, and give the current tables of these; a semi join keeps that off
    the driver. A repeated batch overwrites its own directory and finds its answers already stored, so nothing is
    counted or asked twice. ``runs_of`` tells when a path fires: ``partial(timers.debounce_timers, clock="arrivals")``
    does not wait for the watermark.
    """
    spark = changes.sparkSession

    def run(fired: DataFrame, batch_id: int) -> None:
        fired.persist()
        try:
            scans = fired.groupBy("project").agg(F.count("*").alias("files_scanned"))
            scans.write.mode("overwrite").parquet(f"{out}/scans/batch_id={batch_id}")
            projects = fired.select("project").distinct()
            found = review_changed(fired, files(projects), snapshot(projects), reviewer, f"{out}/responses", **options)
            found.write.mode("overwrite").parquet(f"{out}/findings/batch_id={batch_id}")
            fired.select(*RUN).write.mode("overwrite").parquet(f"{out}/runs/batch_id={batch_id}")
        finally:
            fired.unpersist()

    runs = runs_of(admitted_changes(changes), quiet, lateness)
    return (
        runs.writeStream.outputMode("append")
        .queryName(name)
        .option("checkpointLocation", f"{shared_folder(spark)}/streams/{name}")
        .foreachBatch(run)
    )


def watch_totals(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Files scanned and findings so far, per project; on streams use ``complete`` mode."""
    both = scans.select("project", F.col("files_scanned"), F.lit(0).cast("long").alias("findings")).unionByName(
        findings.select("project", F.lit(0).cast("long").alias("files_scanned"), F.lit(1).cast("long").alias("findings"))
    )
    return both.groupBy("project").agg(
        F.sum("files_scanned").alias("files_scanned"), F.sum("findings").alias("findings")
    )


def read_watch(spark: SparkSession, out: str, table: str) -> DataFrame:
    """A table of the stream; its batches are named by texts, as late reviews have names of their own."""
    rows = spark.read.parquet(f"{out}/{table}")
    return rows.withColumn("batch_id", F.col("batch_id").cast("string")) if "batch_id" in rows.columns else rows


def keep_changes(changes: DataFrame, out: str, name: str = "changes") -> DataStreamWriter:
    """A writer for ``start()`` that appends every admitted change to ``{out}/changes``, late ones too.

    It has no state and no watermark, so it drops nothing; a restarted query goes on where the last one ended.
    """
    rows = admitted_changes(changes).select("project", "path", "ts")
    return (
        rows.writeStream.outputMode("append")
        .queryName(name)
        .option("checkpointLocation", f"{shared_folder(changes.sparkSession)}/streams/{name}")
        .format("parquet")
        .option("path", f"{out}/changes")
    )


def missed_changes(changes: DataFrame, runs: DataFrame, lateness: str = LATENESS, bucket: str = "1 hour") -> DataFrame:
    """(project, path, ts) of the ``changes`` that no fired run covers although their time is over.

    ``changes`` is the log of :func:`keep_changes`, ``runs`` (project, path, first_change, last_change) what fired.
    A change within ``lateness`` of the newest one may still belong to an open run and is left for the next
    call; one older than that came after the watermark, so the stream dropped it. Both sides meet by
    path and ``bucket`` of time, so a path with any share of the changes is spread over its buckets. A run
    is in every bucket that it touches.
    """
    width = _milliseconds(changes.sparkSession, bucket) * 1000
    wait = _milliseconds(changes.sparkSession, lateness) * 1000
    micros = {c: F.unix_micros(F.col(c).cast("timestamp")) for c in ("ts", "first_change", "last_change")}
    rows = changes.select("project", "path", "ts").distinct().withColumn("_at", micros["ts"])
    newest = rows.agg(F.max("_at").alias("_newest"))
    over = rows.join(F.broadcast(newest), F.col("_at") < F.col("_newest") - wait).drop("_newest")
    over = over.withColumn("_bucket", F.floor(F.col("_at") / width))
    touched = F.sequence(F.floor(micros["first_change"] / width), F.floor(micros["last_change"] / width))
    fired = runs.select("project", "path", micros["first_change"].alias("_from"), micros["last_change"].alias("_to"), F.explode(touched).alias("_bucket"))
    inside = (F.col("_at") >= F.col("_from")) & (F.col("_at") <= F.col("_to"))
    fired = fired.withColumnsRenamed({c: f"_run{c}" if c == "_bucket" else f"_run_{c}" for c in ("project", "path", "_bucket")})
    same = (F.col("project") == F.col("_run_project")) & (F.col("path") == F.col("_run_path")) & (F.col("_bucket") == F.col("_run_bucket"))
    return over.join(fired, same & inside, "left_anti").select("project", "path", "ts")


def review_missed(spark: SparkSession, files: DataFrame, snapshot: DataFrame, reviewer: Reviewer, out: str, run_id: str,
                  lateness: str = LATENESS, quiet: str = vocab.DEBOUNCE, **options) -> DataFrame:
    """Review the files of changes that :func:`watch` dropped as late; returns their runs.

    Their runs and findings are added to the tables of the stream as ``batch_id={run_id}``, so the next call
    does not find them again, and a repeated call overwrites its own. Runs are written last: a call that dies
    before is simply repeated. An answer that is already stored is not asked for again.
    """
    runs = read_watch(spark, out, "runs")
    missed = missed_changes(read_watch(spark, out, "changes"), runs.where(F.col("batch_id") != F.lit(run_id)), lateness)
    fired = stored(debounce_history(missed, _milliseconds(spark, quiet)), "missed")
    found = review_changed(fired, files, snapshot, reviewer, f"{out}/responses", **options)
    found.write.mode("overwrite").parquet(f"{out}/findings/batch_id={run_id}")
    scans = fired.groupBy("project").agg(F.count("*").alias("files_scanned"))
    scans.write.mode("overwrite").parquet(f"{out}/scans/batch_id={run_id}")
    fired.select(*RUN).write.mode("overwrite").parquet(f"{out}/runs/batch_id={run_id}")
    return fired


class LateRows(StreamingQueryListener):
    """Appends the rows that each batch of the query ``name`` dropped after the watermark to ``{out}/late``.

    Progress that a query keeps in memory covers its last batches only and begins anew with a restart;
    the table has all of them. Register it with ``spark.streams.addListener`` before the start.
    """

    def __init__(self, spark: SparkSession, out: str, name: str):
        self.spark, self.out, self.name = spark, out, name

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if progress.name != self.name:
            return
        dropped = sum(state.numRowsDroppedByWatermark for state in progress.stateOperators)
        if dropped:
            row = [(str(progress.runId), progress.batchId, dropped)]
            frame = self.spark.createDataFrame(row, LATE).coalesce(1)
            frame.write.mode("append").parquet(f"{self.out}/late")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def late_rows(spark: SparkSession, out: str) -> int:
    """Rows dropped so far because they came after the watermark, over all batches and restarts."""
    try:
        counts = spark.read.schema(LATE).parquet(f"{out}/late")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0
    return counts.groupBy("run_id", "batch_id").agg(F.max("dropped").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
