"""The motion operators: fixtures with known results, and queries against their SQL."""

import math
import random
import time
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from motionlake import queries
from motionlake.dims import metric_specs, risk_rules
from motionlake.functions import geo, text
from motionlake.operators import club, joins, refine, risk, segment
from motionlake.operators.series import Series, increasing
from motionlake.plans import report, service
from motionlake.sources import synth, tables
from motionlake.streaming import tasks

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def swing(spark):
    who = spark.createDataFrame([(0,), (1,)], "task_id bigint")
    frames = synth.frames(who)
    still = synth.frames(spark.createDataFrame([(9,)], "task_id bigint"), n=8)
    both = who.unionByName(spark.createDataFrame([(9,)], "task_id bigint"))
    return tables.scratch(frames.unionByName(still)), synth.videos(both)


@pytest.fixture(scope="module")
def analysis(swing):
    return report.Analysis(*swing)


def test_segmentation_of_the_fixture(analysis):
    rows = {r.task_id: r for r in analysis.swings.select("task_id", "idx", "est", "code", "S").collect()}
    assert rows[0].idx == [20, 27, 35, 42, 46, 51, 58, 74] and abs(rows[0].S - 0.075642) < 1e-6
    assert [k for k, e in enumerate(rows[0].est) if e] == [4] and rows[0].code is None
    assert rows[9].code == "NO_SWING"
    assert {r.task_id for r in analysis.errors.collect()} == {9}


def test_reanchor(analysis):
    new = lambda x: analysis.swings.select("task_id", x.alias("new"))
    moved = {r.task_id: r for r in segment.reanchored(analysis.rows, analysis.swings, new(F.get("idx", F.lit(5)) + 2)).select("task_id", "idx", "moved").collect()}
    assert moved[0].moved and moved[0].idx[5] == 53 and not moved[9].moved
    same = segment.reanchored(analysis.rows, analysis.swings, new(F.lit(5))).where("task_id = 0").first()
    assert not same.moved and same.idx == [20, 27, 35, 42, 46, 51, 58, 74]


def test_metrics_and_risks(analysis):
    m = {(r.phase, r.metric_key): r for r in analysis.metrics.where("task_id = 0").collect()}
    assert len(m) == 33 and m["top", "shoulder_turn"].value > 0 and m["global", "tempo_ratio"].value == 2.4
    assert m["address", "knee_flexion"].value == 168.0 and m["takeaway", "shoulder_turn"].status == "critical_low"
    assert [r.rule_id for r in analysis.risks.where("task_id = 0").collect()] == ["RISK-016"]


@pytest.mark.parametrize("rule,phase,key,hit,miss", [
    ("RISK-001", "top", "hip_turn", 62.1, 62.0), ("RISK-005", "top", "x_factor", 17.9, 18.0), ("RISK-011", "address", "knee_flexion", 174.1, 165.0),
    ("RISK-014", "impact", "spine_tilt_change", 10.0, 9.9), ("RISK-017", "finish", "balance_hold", 0.5, 0.6),
])
def test_rule_boundaries(spark, rule, phase, key, hit, miss):
    view = "down_the_line" if rule == "RISK-014" else "face_on"
    rows = [(1, view, 1, phase, key, "°", hit, 0.0, 8.0), (2, view, 1, phase, key, "°", miss, 0.0, 8.0)]
    m = spark.createDataFrame(rows, "task_id int, view string, phase_no int, phase string, metric_key string, unit string, value double, ref_min double, ref_max double")
    assert [(r.task_id, r.rule_id) for r in risk.risks(m, risk_rules(spark)).collect()] == [(1, rule)]
    assert risk.risks(m, risk_rules(spark), enabled=False).count() == 0


def test_rules_are_sound(spark):
    assert risk.self_check(risk_rules(spark), metric_specs(spark)).count() == 0
    assert metric_specs(spark).count() == 36 and risk.active(risk_rules(spark)).count() == 10
    assert risk.active(risk_rules(spark), ("RISK-003",)).count() == 11


def test_scalars(spark):
    one = spark.range(1)
    p = lambda x, y, z=0.0: geo.point(F.lit(x), F.lit(y), F.lit(z))
    get = lambda col: one.select(col.alias("v")).first().v
    assert get(geo.angle_3p(p(1.0, 0.0), p(0.0, 0.0), p(0.0, 1.0))) == pytest.approx(90)
    assert get(geo.angle_3p(p(0.0, 0.0), p(0.0, 0.0), p(0.0, 1.0))) is None
    assert get(geo.line_angle(p(0.0, 0.0), p(1.0, -1.0))) == pytest.approx(45)
    assert get(geo.rotation_xz(p(0.0, 0.0, 1.0), p(1.0, 0.0, 0.0))) == pytest.approx(-90)
    assert get(geo.displacement_pct(p(3.0, 4.0), p(0.0, 0.0), F.lit(0.0))) is None
    assert get(text.judge5(F.lit(5.0), F.lit(10.0), F.lit(12.0), F.lit(True))) == "critical_low"
    assert get(text.judge5(F.lit(5.0), F.lit(10.0), F.lit(12.0), F.lit(False))) == "low"
    assert get(text.rendered(F.lit("{a} {b}"), {"a": F.lit("x")})) == "x {b}"
    assert get(text.wrapped(F.lit("aaaa字字"), 2.2)) == ["aaaa", "字字"]
    assert get(text.version_key(F.lit("2.10.1")) > text.version_key(F.lit("2.9")))
    assert get(text.extension(F.lit("A.MP4"))) == "mp4" and get(text.camera_view(F.lit(" AUTO "))) == "auto"
    assert get(text.sanitised(F.lit(None).cast("double"), F.lit("°"), F.lit(1.0), F.lit(2.0), F.lit(False))) == 1.5
    assert get(text.sanitised(F.lit(None).cast("double"), F.lit("°"), F.lit(1.0), F.lit(2.0), F.lit(True))) is None
    assert get(report.parsed_envelope(F.lit("{oops"), "string")).code == 5000


def folded(t, width):
    """Line by line, one character after the other."""
    out = []
    for k, part in enumerate(parts := t.split("\n")):
        line, used = "", 0
        for x in part:
            w = 100 if ord(x) > 0x2E80 else 55
            if line and used + w > width:
                out, line, used = [*out, line], "", 0
            line, used = line + x, used + w
        out += [line] if line or (not part and k < len(parts) - 1) else []
    return out


def test_wrapping_equals_the_fold(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab c\n字漢😀é\u2e80\u2e81") for _ in range(rng.choice((0, 1, 7, 40, 300)))) for _ in range(300)]
    for width in (0.3, 1.0, 2.2, 20.0):
        limit = round(100 * width)
        want = [folded(t, limit) for t in texts]
        for piece, window in ((text.PIECE, text.WINDOW), (1, 1), (50, 5), (500, 64)):
            batches = [pa.array(texts[:200]), pa.array([], pa.string()), pa.array(texts[200:])]
            assert [x for made in text.wrapping(limit, piece, window)(iter(batches)) for x in made.to_pylist()] == want
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").coalesce(1)
    both = rows.select("k", text.wrapped(F.col("t"), 20.0).alias("a"), text.wrapped(F.upper("t"), 2.2).alias("b")).where(F.size("a") >= 0)
    assert [(r.a, r.b) for r in both.orderBy("k").collect()] == [(folded(t, 2000), folded(t.upper(), 220)) for t in texts]


def test_wrapping_holds_little_of_a_batch():
    def peak(n, size):
        batch = pa.array(["lorem ipsum dolor " * (size // 18)] * n)
        tracemalloc.start()
        before, most, lines = pa.total_allocated_bytes(), 0, 0
        for made in text.wrapping(2000)(iter([batch])):
            most, lines = max(most, pa.total_allocated_bytes() - before), lines + len(made.flatten())
        most += tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert lines == n * -(-len(batch[0].as_py()) // 36)
        return most

    peak(1, 1000)
    assert peak(4000, 3000) < 1.2 * peak(1000, 3000) < 12e6  # 12 and 3 MB of text in a batch
    assert peak(1, 4_000_000) < 10 * 4e6  # a single text: its lines, but not its measures


def test_wrapping_odd_texts_against_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    texts = [None, "", " ", "a" * 37, "字" * 21 + "😀x", "a\n\nb\t\x0b\x0cc\r\nd", "é" * 40, "x\xa0\u2028\u3000y" * 9, "a\x1cb\x85c" * 9]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(queries.ORACLE_SQL["q_line_wrap"]).fetchall()
    assert sorted(map(tuple, queries.q_line_wrap(spark, str(tmp_path)).collect())) == sorted(want)


def test_increasing_equals_the_fold(spark):
    rng = random.Random(1)
    n, rows, want = 40, [], {}
    for t in range(300):
        v = [rng.randrange(-3, 45) for _ in range(8)]
        rows += [(t, k, x) for k, x in enumerate(v)]
        s = [min(max(v[0], 0), n - 1), *v[1:]]
        for k in range(1, 8):
            s[k] = max(s[k], s[k - 1] + 1)
        if s[7] > n - 1:
            s[7] = n - 1
            for k in range(6, -1, -1):
                s[k] = min(s[k], s[k + 1] - 1)
        want[t] = s
    out = increasing(spark.createDataFrame(rows, "t int, k int, x int"), ["t"], "k", "x", F.lit(n))
    got = {}
    for r in out.orderBy("t", "k").collect():
        got.setdefault(r.t, []).append(r.fixed)
    assert got == want


def test_joins(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 9, "b"), (2, 1, "c")], "k int, at int, name string")
    right = spark.createDataFrame([(1, 4, 40), (1, 8, 80), (1, 11, 110)], "k int, at int, v int")
    got = {r.name: r.v for r in joins.asof_backward(left, right, ["k"], "at", ["v"]).collect()}
    assert got == {"a": 40, "b": 80, "c": None}
    near = {r.name: r.r for r in joins.nearest(left, right.withColumnRenamed("at", "r"), ["k"], "at", "r").collect()}
    assert near == {"a": 4, "b": 8, "c": None}
    pts = [(1, "a", 1, 0.0, 0.0), (1, "a", 2, 1.0, 0.0), (1, "b", 1, 0.9, 0.0), (1, "b", 2, 3.0, 0.0)]
    pairs = joins.greedy_matches(spark.createDataFrame(pts, "k int, side string, id bigint, x double, y double"), ["k"], 3.5).collect()
    assert {(r.a, r.b) for r in pairs} == {(2, 1), (1, 2)}


def test_refinement(spark, analysis):
    rows = [(0, 50 + k, m, 10.0, 10.0, None, None, None) for k, m in enumerate([0.0, 1.0, 2.0, 9.0, 2.0, 1.0, 0.0])]
    f = spark.createDataFrame(rows, "task_id bigint, i int, motion_raw double, centroid_x double, centroid_y double, shaft_y double, ball_x double, ball_y double")
    s = refine.motion_signal(f)
    best = refine.selected(refine.scored(refine.candidates(s), F.lit(0.3)))
    assert [r.peak for r in best.collect()] == [53]
    got = refine.accepted(best, analysis.swings).first()
    assert (got.old, got.new, got.delta, got.available) == (51, 52, 1, True)
    assert refine.refine_frames(analysis.rows, analysis.swings).where("task_id = 0").count() == 12
    assert refine.reanchor_frames(analysis.rows, analysis.swings).count() > 8


def test_sources(spark, swing, tmp_path):
    frames, _ = swing
    path = str(tmp_path / "cache")
    assert tables.load_landmarks(spark, path).count() == 0
    tables.save_landmarks(frames.where("task_id = 0"), path)
    back = tables.load_landmarks(spark, path)
    assert back.count() == 120 and math.isclose(back.where("i = 3").first().vis[0], 0.95, rel_tol=1e-6)
    v = spark.createDataFrame([(1, 30.0, 1000, 4, 3, 0), (2, 30.0, 10, 4, 3, 0), (3, None, 10, 4, 3, 0), (4, 30.0, 90, 4, 3, 90)],
                              "task_id int, fps double, frame_count int, width int, height int, orientation int")
    got = {r.task_id: (r.code, r.sample_step) for r in tables.probed(v).collect()}
    assert got == {1: ("BAD_DURATION", 3), 2: ("BAD_DURATION", 1), 3: ("BAD_FORMAT", 1), 4: ("BAD_ORIENTATION", 1)}
    raw = spark.createDataFrame([(1, "3"), (1, "x"), (1, "-1"), (1, "3")], "task_id int, frame string")
    assert [r.frame for r in tables.clean_indices(raw).collect()] == [3]


def test_cleaned_and_turned_landmarks(spark, swing):
    frames, videos = swing
    one = frames.where("task_id = 0 AND i < 12")
    holes = one.withColumn("norm", F.when(F.col("i") == 5, F.transform("norm", lambda p: F.struct(F.lit(float("nan")).alias("x"), p["y"].alias("y"), p["z"].alias("z")))).otherwise(F.col("norm")))
    got = {r.i: r.norm for r in tables.cleaned_landmarks(holes, videos).collect()}
    raw = {r.i: r.norm for r in one.collect()}
    x = [raw[i][15].x for i in range(12)]
    x[5] = (x[4] + x[6]) / 2
    want = [sum(x[min(max(i + d, 0), 11)] for d in (-1, 0, 1)) / 3 for i in range(12)]
    assert [got[i][15].x for i in range(12)] == pytest.approx(want) and len(got[0]) == 33
    p = spark.createDataFrame([([(0.2, 0.3, 1.0)],)], "p array<struct<x:double,y:double,z:double>>")
    at = lambda d: tuple(round(v, 6) for v in p.select(tables.turned(F.col("p"), F.lit(d)).alias("q")).first().q[0])
    assert at(90) == (0.7, 0.2, 1.0) and at(180) == (0.8, 0.7, 1.0) and at(270) == (0.3, 0.8, 1.0) and at(45) == (0.2, 0.3, 1.0)


def test_report_and_lookup(spark, analysis, swing):
    import json

    doc = json.loads(analysis.report().where("task_id = 0").first().report)
    assert [p["phase_no"] for p in doc["phases"]] == list(range(1, 9)) and doc["risk_count"] == 1 and len(doc["global"]) == 3
    asked = spark.createDataFrame([(0, 500), (0, 47)], "task_id bigint, frame int")
    totals = spark.createDataFrame([(0, 120)], "task_id bigint, total int")
    got = {r.frame: r for r in report.frame_lookup(asked, analysis.events, swing[0], totals).collect()}
    assert got[47].actual == 47 and got[47].phase == "downswing" and not got[47].out_of_range
    assert got[500].actual == 119 and got[500].out_of_range


def test_task_state_batch_and_stream(spark, tmp_path):
    schema = "task_id bigint, at double, seq bigint, kind string, step int, progress double"
    rows = [(1, 0.0, 1, "create", 0, None), (1, 1.0, 2, "progress", 2, 0.5), (1, 2.0, 3, "progress", 1, 0.3), (1, 3.0, 4, "succeed", 4, None), (1, 4.0, 5, "fail", 4, None),
            (2, 0.0, 6, "create", 0, None), (2, 5.0, 7, "progress", 1, 0.2)]
    log = spark.createDataFrame(rows, schema)
    got = {r.task_id: (r.status, r.progress, r.step) for r in tasks.task_states(log).collect()}
    assert got == {1: ("success", 1.0, 4), 2: ("processing", 0.2, 1)}
    assert {r.task_id: r.status for r in tasks.task_states(log, now=200.0).collect()}[2] == "failed"
    assert [r.seq for r in tasks.throttled(log).where("task_id = 1").collect()] == [2]
    log.coalesce(1).write.parquet(str(tmp_path / "log"))
    stream = tasks.task_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "log")))
    q = stream.writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "cp"))
    q = q.trigger(processingTime="1 second").start()
    try:  # timers keep the stream running, so it never counts as done
        end = time.time() + 90
        while spark.table("states").count() < 2 and time.time() < end:
            time.sleep(0.5)
    finally:
        q.stop()
    assert {r.task_id: (r.status, r.progress, r.step) for r in spark.table("states").collect()} == got


def test_club_track(spark):
    one = spark.range(1)
    get = lambda col: one.select(col.alias("v")).first().v
    p = lambda x, y: geo.point(F.lit(x), F.lit(y))
    assert get(club.grip(p(1.0, 1.0), p(3.0, 3.0)))["x"] == 2.0 and get(club.grip(p(float("nan"), 1.0), p(3.0, 3.0))) is None
    fan = lambda x, y: get(club.in_fan(p(x, y), p(0.0, 0.0), p(0.0, 1.0), F.lit(25.0), F.lit(10.0)))
    assert fan(0.0, 9.0) and fan(2.0, 6.0) and not fan(0.0, 11.0) and not fan(9.0, 1.0)
    assert get(club.in_fan(p(99.0, 0.0), p(0.0, 0.0), p(0.0, 0.0), F.lit(25.0), F.lit(10.0)))
    px = spark.createDataFrame([(1, 5, [(float(k * 10), float(k), 0.0) for k in range(33)])], "task_id int, frame_index int, px array<struct<x:double,y:double,z:double>>")
    bones = club.segments(px)
    assert bones.count() == 12
    lines = spark.createDataFrame([(1, 5, 110.0, 11.0, 150.0, 15.0), (1, 5, 0.0, 500.0, 1.0, 600.0)], "task_id int, frame_index int, ax double, ay double, bx double, by double")
    lengths = spark.createDataFrame([(1, 100.0)], "task_id int, club_px double")
    assert [r.ay for r in club.off_skeleton(lines, bones, lengths).collect()] == [500.0]
    frames = spark.createDataFrame([(1, 1, 0.1), (1, 2, 3.0), (1, 3, 0.1), (1, 4, None)], "task_id int, frame_index int, speed double")
    found = spark.createDataFrame(
        [(1, 1, "hough", 1.0, 1.0, 0.9), (1, 1, "framediff", 2.0, 2.0, 0.95), (1, 2, "hough", 1.0, 1.0, 0.9), (1, 2, "framediff", 2.0, 2.0, 0.5), (1, 3, "framediff", 2.0, 2.0, 0.04)],
        "task_id int, frame_index int, branch string, head_x double, head_y double, confidence double",
    )
    got = {r.frame_index: r.method for r in club.chosen(frames, found).collect()}
    assert got == {1: "hough", 2: "framediff", 3: "none", 4: "none"}
    seen = spark.createDataFrame([(1, 1, 0.0, 0.0, None, None), (1, 2, 0.0, 0.0, 1.0, 0.0), (1, 3, 0.0, 1.0, None, None)], "task_id int, frame_index int, grip_x double, grip_y double, dir_x double, dir_y double")
    way = {r.frame_index: (round(r.pred_x, 4), round(r.pred_y, 4), r.fan_deg) for r in club.predicted(seen).collect()}
    assert way == {1: (0.0, 1.0, 45.0), 2: (0.0, 1.0, 45.0), 3: (0.9578, 0.2873, 25.0)}
    none = club.tracks(frames.select("task_id").distinct(), club.chosen(frames, found.limit(0)), spark.createDataFrame([], "task_id int, frame_index int, phase string"))
    assert [(r.confidence, r.available, r.n_found) for r in none.collect()] == [(0.0, False, 0)]


def test_club_plan(analysis):
    for budget, most in ((None, 28), (480 * 854 * 3 * 20, 20), (480 * 854 * 3 * 4, 8)):
        r = club.planned(analysis.rows, analysis.swings, budget).where("task_id = 0").first()
        assert {20, 27, 35, 42, 46, 51, 58, 74} <= set(r.anchors) and len(r.anchors) <= 14 and len(r.targets) <= most
        assert r.anchors == sorted(set(r.anchors)) and set(r.anchors) <= set(r.targets)


def test_service(spark, analysis, tmp_path):
    assert service.health(spark).first().status == "ok"
    files = spark.createDataFrame(
        [(1, "a.mp4", 10, "video/mp4", "file"), (1, "b.mov", 10, None, "video"), (2, "x.exe", 10, None, "file"), (3, "c.mp4", 0, None, "file"), (4, "d.mp4", 9, "text/plain", "file"), (5, "e.mp4", 1 << 30, "", "video")],
        "task_id int, name string, length bigint, content_type string, field string",
    )
    good, bad = service.submitted(files, F.lit(7.0))
    assert [(r.task_id, r.kind, r.at) for r in good.collect()] == [(1, "create", 7.0)]
    assert {r.task_id: (r.code, r.api_code, r.http) for r in bad.collect()} == {2: ("BAD_FORMAT", 10002, 400), 3: ("EMPTY", 10002, 400), 4: ("BAD_FORMAT", 10002, 400), 5: ("FILE_TOO_LARGE", 10001, 400)}
    states = spark.createDataFrame([(0, "success"), (9, "failed"), (5, "processing")], "task_id bigint, status string")
    asked = spark.createDataFrame([(0,), (9,), (5,), (77,)], "task_id bigint")
    got = {r.task_id: (r.code, r.http, r.report is not None) for r in service.results(asked, states, analysis.report()).collect()}
    assert got == {0: (None, 200, True), 9: ("INTERNAL", 500, False), 5: ("PENDING", 409, False), 77: ("NOT_FOUND", 404, False)}
    assert service.coded(spark.createDataFrame([("TOO_DARK",)], "code string"), legacy=True).first().api_code == 4001
    view = {r.phase_no: (r.least, r.most, r.shown_first) for r in service.phase_view(analysis.events.where("task_id = 0"), analysis.videos).collect()}
    assert view[1] == (0, 50, False) and view[4] == (12, 72, True) and view[8] == (44, 104, False)
    present = spark.createDataFrame([("/v/a.mp4",)], "path string")
    assert [r.name for r in service.cases(spark, [("a", "/v/a.mp4"), ("b", "/v/b.mp4")], present).collect()] == ["a"]
    service.dump_reports(analysis.report(), str(tmp_path / "reports"))
    assert service.read_reports(spark, str(tmp_path / "reports")).first().risk_count == 1
    lines = [r.line for r in service.markdown_rows(spark.createDataFrame([(2, "x|y"), (1, None)], "a int, b string"), ["a", "b"], ["a"]).collect()]
    assert lines == ["| a | b |", "|-|-|", "| 1 | - |", "| 2 | x\\|y |"]
    faults = spark.createDataFrame([("a.avi", 5.0, 1), ("a.mp4", 1.0, 1), ("a.mp4", 5.0, 1 << 30), ("a.mp4", 5.0, 1)], "name string, duration double, length bigint")
    assert [r.fault for r in service.first_fault(faults).collect()] == ["BAD_FORMAT", "BAD_DURATION", "FILE_TOO_LARGE", None]


def test_stream_times_out_by_the_log(spark, tmp_path):
    """Task 1 reports every minute and never ends; task 2 moves the log on."""
    schema = "task_id bigint, at double, seq bigint, kind string, step int, progress double"
    logs = [
        [(1, 1000.0, 1, "create", 0, None), (1, 1060.0, 2, "progress", 1, 0.1)],
        [(1, 1110.0, 3, "progress", 1, 0.2), (2, 1119.0, 4, "create", 0, None)],
        [(2, 1200.0, 5, "progress", 1, 0.1)],
        [(2, 1210.0, 6, "progress", 1, 0.2)],
    ]
    (tmp_path / "log").mkdir()
    stream = tasks.task_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "log")))
    q = stream.writeStream.format("memory").queryName("timed").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for k, rows in enumerate(logs):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
            end = time.time() + 60
            while spark.table("timed").where(F.col("updated") >= rows[-1][1]).count() == 0 and time.time() < end:
                time.sleep(0.5)
        end = time.time() + 60
        while spark.table("timed").where("status = 'failed'").count() == 0 and time.time() < end:
            time.sleep(0.5)
    finally:
        q.stop()
    failed = spark.table("timed").where("status = 'failed'").collect()
    assert [(r.task_id, r.updated, r.progress) for r in failed] == [(1, 1120.0, 0.2)]


def test_series_passthrough(spark):
    s = Series(spark.createDataFrame([(1, 0, 3.0), (1, 1, None)], "k int, i int, v double"), ["k"], ["i"])
    assert [r.f for r in s.gap_filled("v", "f").df.orderBy("i").collect()] == [3.0, 3.0]
    assert [r.m for r in s.moving_average("v", "m", 5).df.orderBy("i").collect()] == [3.0, None]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.ORACLE_SQL[name])
    cols = [d[0] for d in want.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    key = lambda row: tuple((x is None, str(x)) for x in row)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)
    for a, b in zip(got, sorted(want.fetchall(), key=key), strict=True):
        assert all(x == y or (isinstance(x, float) and abs(x - y) < 1e-3) for x, y in zip(a, b)), (a, b)
