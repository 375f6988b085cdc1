"""Stateful streams against the batch rules, batch by batch, and over a restart."""

import os
import time

import pytest
from pyspark.sql import functions as F

from motionlake.plans import report
from motionlake.streaming import states, tasks

LOG = "task_id bigint, at double, seq bigint, kind string, step int, progress double"


def drained(query, more=1):
    for _ in range(more):
        query.processAllAvailable()


def test_task_states_after_every_batch(spark, tmp_path):
    hour = 3600.0
    logs = [
        [(1, 1000.0, 1, "create", 0, None), (2, 1001.0, 2, "create", 0, None), (2, 1002.0, 3, "progress", 2, 0.5)],
        [(1, 1050.0, 5, "progress", 1, 0.2), (1, 1049.0, 4, "progress", 1, 0.4), (2, 1060.0, 6, "succeed", 4, None)],
        [(2, 1061.0, 7, "fail", 4, None), (3, 1062.0, 8, "create", 0, None), (3, 1063.0, 9, "fail", 1, 0.1)],
    ]
    (tmp_path / "log").mkdir()
    stream = states.task_stream(spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log")), "1 seconds")
    sink = stream.writeStream.format("memory").queryName("by_state").outputMode("update").option("checkpointLocation", str(tmp_path / "cp"))

    def add(rows):
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))

    def last():
        best = {}
        for r in spark.table("by_state").collect():
            if r.task_id not in best or r.updated >= best[r.task_id].updated:
                best[r.task_id] = r
        return {k: (r.status, r.progress, r.step, r.started, r.updated) for k, r in best.items()}

    def waited(check):
        end = time.time() + 60
        while not check() and time.time() < end:
            time.sleep(0.5)
        assert check()

    q = sink.start()
    try:
        seen = []
        for rows in logs:
            add(rows)
            seen += rows
            # an update after the end leaves the state; its row shows the state again
            want = {r.task_id: (r.status, r.progress, r.step, r.started, r.updated) for r in tasks.task_states(spark.createDataFrame(seen, LOG)).collect()}
            waited(lambda: last() == want)  # noqa: B023
        # time passes by the log: task 1 is too slow, and 168 hours later the ended ones are forgotten
        add([(9, 1200.0, 10, "create", 0, None)])
        waited(lambda: last()[1] == ("failed", 0.4, 1, 1000.0, 1120.0))
        add([(9, 1201.0, 11, "succeed", 4, None)])
        waited(lambda: last()[9][0] == "success")
        far = 1201.0 + 169 * hour
        add([(8, far, 12, "create", 0, None)])
        waited(lambda: 8 in last())
        add([(8, far + 1, 13, "succeed", 0, None)])
        waited(lambda: last()[8][0] == "success")
        add([(2, far + 2, 14, "create", 0, None)])  # its number is free again
        waited(lambda: last()[2][0] == "pending" and last()[2][3] == far + 2)
    finally:
        q.stop()


def put(folder, task, field, name, size, at):
    place = folder / task / field
    place.mkdir(parents=True, exist_ok=True)
    with open(place / name, "wb") as f:
        f.truncate(size)
    os.utime(place / name, (at, at))


def test_uploads_over_a_restart(spark, tmp_path):
    folder, archive = tmp_path / "in", tmp_path / "done"
    folder.mkdir()
    now = 1_700_000_000

    def run():
        stream = states.upload_stream(states.arriving_files(spark, f"file://{folder}", f"file://{archive}"), 30.0, "1 seconds")
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        try:
            q.awaitTermination(90)
        finally:
            q.stop()

    put(folder, "a", "file", "a.mp4", 5, now)
    put(folder, "b", "file", "b.mov", 5, now)
    put(folder, "c", "video", "c.txt", 5, now)
    put(folder, "d", "video", "d.mp4", 41 << 20, now)
    run()
    put(folder, "a", "video", "z.mp4", 7, now + 5)  # in time: taken before the one in `file`
    run()
    put(folder, "e", "video", "e.mp4", 9, now + 100)  # moves time on
    put(folder, "c", "video", "c.mp4", 9, now + 100)  # the task has its upload
    run()
    put(folder, "f", "video", "f.MP4", 9, now + 200)
    run()
    got = sorted((r.task_id, r.name, r.field, r.length, r.code) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [
        ("a", "z.mp4", "video", 7, None), ("b", "b.mov", "file", 5, None), ("c", "c.txt", "video", 5, "BAD_FORMAT"),
        ("d", "d.mp4", "video", 41 << 20, "FILE_TOO_LARGE"), ("e", "e.mp4", "video", 9, None), ("f", "f.MP4", "video", 9, None),
    ]
    assert list(archive.rglob("a.mp4")) and not list(folder.rglob("a.mp4"))


def test_counters(spark):
    targets = spark.createDataFrame([(1, 0), (1, 5), (2, 0), (3, 1)], "task_id bigint, frame_index int")
    frames = spark.createDataFrame([(1, 0), (1, 0), (1, 1), (2, 0)], "task_id bigint, frame_index int")
    out, told = report.counted_frames(targets, frames)
    assert sorted((r.task_id, r.frame_index, r.found) for r in out.collect()) == [(1, 0, True), (1, 5, False), (2, 0, True), (3, 1, False)]
    assert {(r.name, r.metric): r.value for r in report.counters(spark, [told]).collect()} == {("frames", "asked"): 4, ("frames", "found"): 2, ("frames", "absent"): 2}
    none, told = report.counted_frames(targets.limit(0), frames, "none")
    assert none.count() == 0 and told.get["asked"] == 0
