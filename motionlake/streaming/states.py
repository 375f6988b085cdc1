"""Task state and uploads as arbitrary stateful processing: a value per task and event-time timers of their own for each end.

Both need the RocksDB state store, which prepared() sets for queries that start later in the session.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import MAX_UPLOAD_BYTES, RESULT_TTL_HOURS, TASK_TIMEOUT_SEC, VIDEO_EXTENSIONS
from .tasks import OUT, STATE, folded

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
UPLOADS = "task_id string, at double, name string, field string, length bigint, code string"
HELD = "at double, name string, field string, length bigint, open int"
FILES = "path string, modificationTime timestamp, length bigint, content binary"  # fixed by the source
ENDED = ("success", "failed")
c = F.col


def prepared(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return spark


class TaskProcessor(StatefulProcessor):
    """The rules of tasks.task_states, update by update. One timer fails what takes too long, another forgets what has ended."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("task", STATE)

    def row(self, key: tuple, state: tuple) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *state)], columns=["task_id", "status", "progress", "step", "started", "updated"])

    def kept(self, state: tuple) -> None:
        self.state.update(state)
        if state[0] in ENDED:
            self.handle.registerTimer(int(1000 * (state[4] + RESULT_TTL_HOURS * 3600)))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        before = tuple(self.state.get()) if self.state.exists() else None
        now = folded(before, pd.concat(list(rows)).sort_values(["at", "seq"]))
        limit = int(1000 * (now[3] + TASK_TIMEOUT_SEC))
        if before is None and now[0] not in ENDED:
            self.handle.registerTimer(limit)
        if before is not None and before[0] not in ENDED and now[0] in ENDED:
            self.handle.deleteTimer(limit)
        if before is None or before[0] not in ENDED:
            self.kept(now)
        yield self.row(key, now)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        status, progress, step, started, _ = tuple(self.state.get())
        if status in ENDED:
            self.state.clear()
            return
        now = ("failed", progress, step, started, started + TASK_TIMEOUT_SEC)
        self.kept(now)
        yield self.row(key, now)

    def close(self) -> None:
        pass


def task_stream(log: DataFrame, lateness: str = "10 seconds") -> DataFrame:
    """The state of every task that a micro-batch touches or a timer ends; as tasks.task_stream, with a timer for each end."""
    prepared(log.sparkSession)
    timed = log.withColumn("event_time", F.timestamp_millis((c("at") * 1000).cast("long"))).withWatermark("event_time", lateness)
    return timed.groupBy("task_id").transformWithStateInPandas(TaskProcessor(), OUT, "update", "EventTime")


class UploadProcessor(StatefulProcessor):
    """One upload per task. A file in `video` is taken at once; one in `file` waits for it until its timer. Later ones are ignored."""

    def __init__(self, wait: float):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("upload", HELD)

    def taken(self, key: tuple, at: float, name: str, field: str, length: int) -> pd.DataFrame:
        kind = name.rpartition(".")[2].lower() if "." in name else ""
        code = "BAD_FORMAT" if kind not in VIDEO_EXTENSIONS else "EMPTY" if length <= 0 else "FILE_TOO_LARGE" if length > MAX_UPLOAD_BYTES else None
        self.state.update((at, name, field, length, 0))
        return pd.DataFrame([(key[0], at, name, field, length, code)], columns=["task_id", "at", "name", "field", "length", "code"])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = tuple(self.state.get()) if self.state.exists() else None
        if held is not None and not held[4]:
            return
        new = list(pd.concat(list(rows))[["at", "name", "field", "length"]].itertuples(index=False, name=None))
        new = [(float(at), name, field, int(length)) for at, name, field, length in new]
        best = min([*new, *([held[:4]] if held else [])], key=lambda r: (r[2] != "video", r[1]))
        if best[2] == "video":
            if held is not None:
                self.handle.deleteTimer(int(1000 * (held[0] + self.wait)))
            yield self.taken(key, *best)
            return
        first = held[0] if held else min(r[0] for r in new)
        if held is None:
            self.handle.registerTimer(int(1000 * (first + self.wait)))
        self.state.update((first, *best[1:], 1))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        at, name, field, length, open_ = tuple(self.state.get())
        if open_:
            yield self.taken(key, at, name, field, length)

    def close(self) -> None:
        pass


def arriving_files(spark: SparkSession, folder: str, archive: str | None = None) -> DataFrame:
    """task_id, field, name, length, event_time of files that arrive as folder/task/field/name; contents are not read. Empty files give no row, as Spark's file source passes them over.

    With archive given a file is moved there once a later batch has begun, so the folder stays small; it must not lie in the folder.
    """
    reader = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    part = lambda k: F.regexp_extract("path", "([^/]+)/([^/]+)/([^/]+)$", k)
    files = reader.load(folder).select("path", "length", c("modificationTime").alias("event_time"))
    return files.select(part(1).alias("task_id"), part(2).alias("field"), part(3).alias("name"), "length", "event_time")


def upload_stream(files: DataFrame, wait: float = 30.0, lateness: str = "10 seconds") -> DataFrame:
    """files: task_id, field, name, length, event_time. The upload that each task runs on, with an error code where it is rejected."""
    prepared(files.sparkSession)
    rows = files.withColumn("at", F.unix_micros("event_time") / 1e6).withWatermark("event_time", lateness)
    return rows.groupBy("task_id").transformWithStateInPandas(UploadProcessor(wait), UPLOADS, "append", "EventTime")
