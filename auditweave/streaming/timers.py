"""Quiet times of changed paths by timers: a run of changes fires by itself, not with a window."""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from auditweave import vocab
from auditweave.streaming.watch import LATENESS, _milliseconds

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RUNS = "first bigint, last bigint, changes bigint, seen bigint"
FIRED = "project string, path string, first_us bigint, last_us bigint, changes bigint"


def merged(runs: list[tuple], quiet_us: int) -> list[tuple]:
    """Runs ``(first, last, changes, seen)`` in order of time; those at most ``quiet_us`` apart are one."""
    out: list[tuple] = []
    for first, last, changes, seen in sorted(runs):
        if out and first - out[-1][1] <= quiet_us:
            before = out[-1]
            out[-1] = (before[0], max(before[1], last), before[2] + changes, max(before[3], seen))
        else:
            out.append((first, last, changes, seen))
    return out


def runs_of(micros: np.ndarray, quiet_us: int, seen: int) -> list[tuple]:
    """The runs of one batch of times of one path."""
    micros = np.sort(micros)
    starts = np.flatnonzero(np.diff(micros, prepend=micros[0] - quiet_us - 1) > quiet_us)
    ends = np.append(starts[1:], len(micros))
    return [(int(micros[a]), int(micros[b - 1]), int(b - a), seen) for a, b in zip(starts, ends, strict=True)]


class QuietTimer(StatefulProcessor):
    """Open runs of a path and one timer, at the end of the quiet time of the run that ends first.

    By the clock of events a run fires once the watermark has passed its quiet time, when no admitted row
    can join it any more. By the clock of arrivals there is one open run; each batch with changes of the path
    restarts the timer, and the run fires when it expires. A path without open runs has no state.
    """

    def __init__(self, quiet_us: int, arrivals: bool):
        self.quiet_us, self.arrivals = quiet_us, arrivals

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", RUNS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.arrivals else 0
        runs = [tuple(r) for r in self.open.get()] if self.open.exists() else []
        for frame in rows:
            if len(frame):
                runs = self._joined(runs + runs_of(frame["micros"].to_numpy(np.int64), self.quiet_us, now))
        self._keep(runs)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = timerValues.getCurrentProcessingTimeInMs() if self.arrivals else timerValues.getCurrentWatermarkInMs()
        runs = [tuple(r) for r in self.open.get()] if self.open.exists() else []
        fired = [r for r in runs if self._expiry(r) <= due]
        self._keep([r for r in runs if self._expiry(r) > due])
        if fired:
            yield pd.DataFrame({
                "project": [key[0]] * len(fired), "path": [key[1]] * len(fired), "first_us": [r[0] for r in fired],
                "last_us": [r[1] for r in fired], "changes": [r[2] for r in fired],
            })

    def close(self) -> None:
        pass

    def _joined(self, runs: list[tuple]) -> list[tuple]:
        if self.arrivals and runs:
            first, last, changes, seen = zip(*runs, strict=True)
            return [(min(first), max(last), sum(changes), max(seen))]
        return merged(runs, self.quiet_us)

    def _expiry(self, run: tuple) -> int:
        """The millisecond at which ``run`` is over: the first after its quiet time."""
        return run[3] + math.ceil(self.quiet_us / 1000) if self.arrivals else (run[1] + self.quiet_us) // 1000 + 1

    def _keep(self, runs: list[tuple]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        if runs:
            self.open.put(runs)
            self.handle.registerTimer(min(map(self._expiry, runs)))
        elif self.open.exists():
            self.open.clear()


def debounce_timers(changes: DataFrame, quiet: str = vocab.DEBOUNCE, lateness: str = LATENESS, clock: str = "events") -> DataFrame:
    """The runs of ``watch.debounce`` from a stream of changes, fired by timers; columns are the same.

    ``clock="events"``: equal to ``watch.debounce_history`` over the same log, as far as the watermark (the
    newest change less ``lateness``) has passed the runs. ``clock="arrivals"``: a path fires ``quiet`` time after the last
    of its changes arrived, without waiting for the watermark, so no change is ever late. Rows without a time or
    key column null: nulls are keys like any other, rows with a null ``ts`` are left out.

    State lies in RocksDB, which the session has to name (``spark.sql.streaming.stateStore.providerClass`` =
    ``timers.ROCKSDB``). It has one row per open run: a path has at most ``lateness / quiet`` of them. The changes
    of one path in one batch pass through one task in pieces, and only their runs are held.
    """
    if clock not in ("events", "arrivals"):
        raise ValueError(f"clock is events or arrivals, not {clock}")
    arrivals = clock == "arrivals"
    quiet_us = 1000 * _milliseconds(changes.sparkSession, quiet)
    kind = changes.schema["ts"].dataType
    rows = changes.where("ts IS NOT NULL").select(
        "project", "path", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    timed = rows if arrivals else rows.withWatermark("ts", lateness)
    fired = timed.groupBy("project", "path").transformWithStateInPandas(
        QuietTimer(quiet_us, arrivals), FIRED, "append", "processingTime" if arrivals else "eventTime")
    return fired.select(
        "project", "path",
        F.timestamp_micros("first_us").cast(kind).alias("first_change"),
        F.timestamp_micros("last_us").cast(kind).alias("last_change"),
        F.timestamp_micros(F.col("last_us") + quiet_us).cast(kind).alias("fires_at"), "changes",
    )
