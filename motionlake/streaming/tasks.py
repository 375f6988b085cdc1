"""Task state as a keyed stream: progress never falls, terminal states stay, old work times out.

The log has one row per update: task_id, at (seconds), seq, kind (create, progress,
fail or succeed), step, progress. In a batch the state is a window over the log; in a
stream the same rules run as a keyed state. A terminal state is final in both: a success that
is reported after a timeout does not undo it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import RESULT_TTL_HOURS, TASK_TIMEOUT_SEC

c = F.col
STATE = "status string, progress double, step int, started double, updated double"
OUT = "task_id bigint, status string, progress double, step int, started double, updated double"


def task_states(log: DataFrame, now: float | None = None) -> DataFrame:
    """One row per task: status, progress, step, started, updated.

    Updates after the first terminal one are ignored. With now given, unfinished
    tasks older than the timeout have failed.
    """
    by = Window.partitionBy("task_id").orderBy("at", "seq")
    ended = F.coalesce(F.max(c("kind").isin("fail", "succeed").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    live = log.withColumn("late", ended == 1).where(~c("late"))
    last = F.max(F.struct("at", "seq", "kind"))
    out = live.groupBy("task_id").agg(
        last["kind"].alias("kind"), F.max("progress").alias("progress"), F.max("step").alias("step"),
        F.min("at").alias("started"), F.max("at").alias("updated"),
    )
    status = F.when(c("kind") == "succeed", "success").when(c("kind") == "fail", "failed").when(c("kind") == "progress", "processing").otherwise("pending")
    if now is not None:
        stale = ~c("kind").isin("succeed", "fail") & (F.lit(now) - c("started") > TASK_TIMEOUT_SEC)
        status = F.when(stale, "failed").otherwise(status)
    progress = F.when(c("kind") == "succeed", 1.0).otherwise(F.coalesce("progress", F.lit(0.0)))
    return out.select("task_id", status.alias("status"), progress.alias("progress"), F.coalesce("step", F.lit(0)).alias("step"), "started", "updated")


def kept(states: DataFrame, now: float) -> DataFrame:
    """Without the terminal tasks whose time is up."""
    old = c("status").isin("success", "failed") & (F.lit(now) - c("updated") > RESULT_TTL_HOURS * 3600)
    return states.where(~old)


def throttled(log: DataFrame, least: float = 0.02) -> DataFrame:
    """Progress rows that lead the last one reported by at least `least`: a fold in a stream over each task's rows in order, one number of state."""
    row = log.where("kind = 'progress' AND progress IS NOT NULL")
    row = row.select("task_id", c("at").cast("double").alias("at"), c("seq").cast("bigint").alias("seq"), c("progress").cast("double").alias("progress"))

    def reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last = object(), -1.0
        for b in batches:
            keep = []
            for k, (t, p) in enumerate(zip(b.column(0).to_pylist(), b.column(3).to_pylist())):
                if t != task:
                    task, last = t, -1.0
                if p - last >= least:
                    last = p
                    keep.append(k)
            yield b.take(pa.array(keep, pa.int64()))

    kind = row.schema["task_id"].dataType.simpleString()
    met = row.repartition("task_id").sortWithinPartitions("task_id", "at", "seq", "progress")
    return met.mapInArrow(reported, f"task_id {kind}, at double, seq bigint, progress double")


def eta(elapsed, progress):
    return F.when(progress > 0, F.greatest(elapsed / progress - elapsed, F.lit(0.0)))


def folded(state: tuple | None, rows: pd.DataFrame) -> tuple:
    """The state after rows, which are in order."""
    status, progress, step, started, updated = state or ("pending", 0.0, 0, float(rows["at"].iloc[0]), 0.0)
    for r in rows.itertuples():
        if status in ("success", "failed"):
            break
        if pd.notna(r.progress):
            progress = max(progress, float(r.progress))
        if pd.notna(r.step):
            step = max(step, int(r.step))
        status = {"succeed": "success", "fail": "failed", "progress": "processing"}.get(r.kind, status)
        progress = 1.0 if status == "success" else progress
        updated = float(r.at)
    return status, progress, step, started, updated


def task_stream(log: DataFrame, lateness: str = "10 seconds") -> DataFrame:
    """The state of every task that a micro-batch touches.

    Time is the log's: an unfinished task fails once the log has passed TASK_TIMEOUT_SEC after its start, however
    often it has reported since; a finished one is forgotten RESULT_TTL_HOURS after its end.
    """

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            status, progress, step, started, updated = state.get
            if status in ("success", "failed"):
                state.remove()
                return
            now = ("failed", progress, step, started, started + TASK_TIMEOUT_SEC)
        else:
            rows = pd.concat(list(parts)).sort_values(["at", "seq"])
            now = folded(state.get if state.exists else None, rows)
        state.update(now)
        terminal = now[0] in ("success", "failed")
        end = now[4] + RESULT_TTL_HOURS * 3600 if terminal else now[3] + TASK_TIMEOUT_SEC
        state.setTimeoutTimestamp(max(int(1000 * end), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], *now)], columns=["task_id", "status", "progress", "step", "started", "updated"])

    timed = log.withColumn("event_time", F.timestamp_millis((c("at") * 1000).cast("long"))).withWatermark("event_time", lateness)
    return timed.groupBy("task_id").applyInPandasWithState(update, OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)
