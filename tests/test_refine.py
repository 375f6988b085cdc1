"""Choice and acceptance of a refined impact, case by case."""

import pytest
from pyspark.sql import functions as F

from motionlake.operators import masks, refine

KIND = "task_id bigint, i int, motion double, most double, centroid_x double, centroid_y double, shaft_y double, ball_x double, ball_y double, band_top double, band_bottom double"


def rows_of(spark, rows):
    """(task, i, motion, centroid_y, shaft_y)"""
    return spark.createDataFrame([(t, i, m, 10.0, 50.0, y, s, None, None, 100.0, 200.0) for t, i, m, y, s in rows], KIND)


def scores(df, weight=0.3):
    return {(r.task_id, r.i): r.score for r in refine.scored(df, F.lit(weight)).collect()}


def test_score_terms(spark):
    df = rows_of(spark, [(1, 1, 5.0, 150.0, None), (1, 2, 10.0, 90.0, None), (1, 3, 10.0, 250.0, 49.0), (1, 4, 10.0, 250.0, 50.0), (1, 5, 10.0, None, 190.0)])
    assert scores(df) == pytest.approx({(1, 1): 0.25, (1, 2): 0.0, (1, 3): 1.0, (1, 4): 1.3, (1, 5): 0.0})
    assert scores(df, 0.15)[1, 4] == pytest.approx(1.15)
    ball = df.withColumns({"ball_x": F.lit(50.0), "ball_y": F.lit(210.0)})
    assert scores(ball)[1, 1] == pytest.approx(0.25 * 1.25) and scores(ball)[1, 4] == pytest.approx(1.3 * 1.25)
    far = df.withColumns({"ball_x": F.lit(50.0), "ball_y": F.lit(210.01)})
    assert scores(far)[1, 1] == pytest.approx(0.25)


def chosen(spark, rows):
    """(task, i, score, shaft_y)"""
    df = spark.createDataFrame([(t, i, s, y, 1.0, 2.0) for t, i, s, y in rows], "task_id bigint, i int, score double, shaft_y double, motion double, most double")
    return {r.task_id: (r.peak, r.method) for r in refine.selected(refine.anchored(df)).collect()}


def test_anchor_narrows_only_if_credible(spark):
    sweep = [(1, 50, 0.8, 700.0), (1, 53, 0.75, None), (1, 57, 1.0, None)]  # 0.8 is enough
    weak = [(2, 50, 0.69, 700.0), (2, 57, 1.0, None)]
    edge = [(3, 50, 0.7, 700.0), (3, 57, 1.0, None)]
    reach = [(4, 50, 0.1, 700.0), (4, 54, 0.9, None), (4, 57, 1.0, None)]  # 54 is out of reach, so 0.1 stands alone
    none = [(5, 50, 0.0, 700.0), (5, 51, 0.0, None)]
    lowest = [(6, 50, 0.9, 700.0), (6, 56, 0.8, 701.0)]
    assert chosen(spark, sweep + weak + edge + reach + none + lowest) == {
        1: (50, "motion+shaft"), 2: (57, "motion"), 3: (50, "motion+shaft"), 4: (57, "motion"), 6: (56, "motion+shaft"),
    }


def test_ties(spark):
    later = [(1, 50, 0.5, None), (1, 52, 0.5 + 1e-12, None), (1, 51, 0.5, None)]
    shaft_first = [(2, 50, 0.5, 700.0), (2, 52, 0.5, None)]
    lower = [(3, 50, 0.5, 700.0), (3, 52, 0.5, 710.0)]
    earlier = [(4, 50, 0.5, 700.0), (4, 52, 0.5, 700.0)]
    assert {k: v[0] for k, v in chosen(spark, later + shaft_first + lower + earlier).items()} == {1: 52, 2: 50, 3: 52, 4: 50}


def test_acceptance(spark):
    swings = [(t, [10, 20, 30, 40, 45, 51, 60, 70], 30.0, 120) for t in range(9)]
    df = spark.createDataFrame(swings, "task_id bigint, idx array<int>, fe double, n int")
    peaks = {0: 53, 1: 51, 2: 52, 3: 64, 4: 63, 5: 42, 6: 43, 7: 39, 8: 38}
    best = spark.createDataFrame(list(peaks.items()), "task_id bigint, peak int")
    got = {r.task_id: (r.new, r.delta, r.available, r.warn) for r in refine.accepted(best, df).collect()}
    assert got[0] == (52, 1, True, False)
    assert not got[1][2]  # the peak is where the impact was
    assert got[2] == (51, 0, True, False)  # the peak leads back to it: confirmed
    assert not got[3][2] and got[4] == (62, 11, True, True)
    assert not got[5][2] and got[5][0] is None  # 41 is one frame after the top, nothing is moved up to 42
    assert got[6] == (42, -9, True, True)
    assert not got[7][2] and not got[8][2]


def test_window_must_be_whole(spark):
    swings = spark.createDataFrame([(t, [10, 20, 30, 40, 45, 51, 60, 70], 30.0, 120, None) for t in (1, 2, 3)], "task_id bigint, idx array<int>, fe double, n int, code string")
    rows = [(1, i, 1.0) for i in range(0, 120)] + [(2, i, 1.0) for i in range(0, 120) if i != 55] + [(3, 90, 1.0)]
    got = refine.in_window(spark.createDataFrame(rows, "task_id bigint, i int, motion_raw double"), swings).collect()
    assert {r.task_id for r in got} == {1} and sorted(r.i for r in got) == list(range(49, 60))


def test_features_from_images(spark):
    """A bright block that jumps between frames 3 and 4 in the ground band is the motion's peak, and its middle the centroid."""
    tiles = []
    for f in range(6):
        for ty in range(4):
            for tx in range(4):
                on = (ty, tx) == ((3, 1) if f < 4 else (3, 2))
                tiles.append((7, f, ty, tx, [200 if on else 10] * 64))
    df = spark.createDataFrame(tiles, "task_id bigint, frame_index bigint, ty int, tx int, pixels array<smallint>")
    told = spark.createDataFrame([(7, "down_the_line", 32, 32, 25.0, 0.5, 0.72)], "task_id bigint, view string, width bigint, height bigint, body_px double, ankle_x double, ankle_y double")
    ground = masks.ground_region(told)
    shafts = spark.createDataFrame([(7, 4, 3.0, 5.0, 9.0, 27.0), (7, 4, 3.0, 5.0, 9.0, 25.0)], "task_id bigint, frame_index bigint, ax double, ay double, bx double, by double")
    balls = spark.createDataFrame([(7, 16.0, 28.0)], "task_id bigint, ball_x double, ball_y double")
    got = {r.i: r for r in refine.pixel_features(df, ground, balls, shafts).collect()}
    assert sorted(got) == list(range(6)) and [i for i, r in got.items() if r.motion_raw > 0] == [4]
    r = got[4]
    assert (r.band_top, r.band_bottom, r.shaft_y, r.ball_x) == (24.0, 32.0, 27.0, 16.0)
    assert r.motion_raw == pytest.approx(190 * 128 / (32 * 8)) and (r.centroid_x, r.centroid_y) == (15.5, 27.5)
    assert got[2].centroid_y is None and got[2].shaft_y is None
