"""Image operators against plain loops over pixels."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionlake.operators import components, lines, masks, raster
from motionlake.operators.raster import SIDE, TILES
from motionlake.sources import tables
from motionlake.sources.rasters import tiles_from_vectors


def tiles_of(spark, images, missing=()):
    """images: {(task, frame): array}; sizes are multiples of SIDE."""
    rows = []
    for (task, frame), image in images.items():
        for ty in range(image.shape[0] // SIDE):
            for tx in range(image.shape[1] // SIDE):
                if (task, frame, ty, tx) not in missing:
                    part = image[ty * SIDE : (ty + 1) * SIDE, tx * SIDE : (tx + 1) * SIDE]
                    rows.append((task, frame, ty, tx, [int(v) for v in part.ravel()]))
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, TILES).repartition(3)


def noise(seed, shape=(24, 32), most=256):
    return np.random.default_rng(seed).integers(0, most, shape)


def test_region_motion(spark):
    images = {(t, f): noise(10 * t + f, most=60) for t in (1, 2) for f in (0, 1, 2, 4)}
    images[2, 2] = images[2, 1]  # nothing moves
    region = {1: [(5, 3, 30), (6, 0, 9), (6, 12, 13), (23, 31, 99)], 2: [(0, 0, 32), (8, 7, 9), (9, 40, 50), (-1, 0, 5)]}
    rows = [(t, y, a, b) for t, parts in region.items() for y, a, b in parts]
    got = raster.region_motion(tiles_of(spark, images), spark.createDataFrame(rows, "task_id bigint, y int, x0 int, x1 int"))
    got = {(r.task_id, r.frame_index): tuple(r)[2:] for r in got.collect()}
    want = {}
    for (t, f), image in images.items():
        if (t, f - 1) in images:
            inside = np.zeros(image.shape, bool)
            for y, a, b in region[t]:
                if y >= 0:
                    inside[y, a:b] = True
            diff = np.abs(image - images[t, f - 1])
            ys, xs = np.nonzero((diff > 20) & inside)
            want[t, f] = (diff[inside].mean(), xs.mean() if len(xs) else None, ys.mean() if len(ys) else None)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])
    assert got[2, 2] == (0.0, None, None)


def test_gradients(spark):
    image = noise(3)
    for missing in ((), {(1, 0, 1, 2), (1, 0, 0, 0)}):
        got = {(r.ty, r.tx): np.array(r.pixels).reshape(SIDE, SIDE) for r in raster.gradients(tiles_of(spark, {(1, 0): image}, missing)).collect()}
        gone = {(ty, tx) for _, _, ty, tx in missing}
        there = lambda y, x: 0 <= y < 24 and 0 <= x < 32 and (y // SIDE, x // SIDE) not in gone

        def value(y, x, dy, dx):
            for b, a in ((dy, dx), (0, dx), (dy, 0)):
                if there(y + b, x + a):
                    return image[y + b, x + a]
            return image[y, x]

        assert len(got) == 12 - len(gone)
        for (ty, tx), part in got.items():
            for i in range(SIDE):
                for j in range(SIDE):
                    p = lambda dy, dx: int(value(ty * SIDE + i, tx * SIDE + j, dy, dx))  # noqa: E731, B023
                    gx = p(-1, 1) + 2 * p(0, 1) + p(1, 1) - p(-1, -1) - 2 * p(0, -1) - p(1, -1)
                    gy = p(1, -1) + 2 * p(1, 0) + p(1, 1) - p(-1, -1) - 2 * p(-1, 0) - p(-1, 1)
                    assert part[i, j] == abs(gx) + abs(gy)


def flood(image, least):
    seen, out = set(), []
    on = {(int(y), int(x)) for y, x in zip(*np.nonzero(image >= least))}
    for start in sorted(on):
        if start in seen:
            continue
        part, todo = [], [start]
        seen.add(start)
        while todo:
            y, x = todo.pop()
            part.append((y, x))
            for b in (-1, 0, 1):
                for a in (-1, 0, 1):
                    if (y + b, x + a) in on and (y + b, x + a) not in seen:
                        seen.add((y + b, x + a))
                        todo.append((y + b, x + a))
        out.append(part)
    return out


def spiral(n=24):
    image, y, x, dy, dx = np.zeros((n, n), int), 0, 0, 0, 1
    for _ in range(n * n):
        image[y, x] = 255
        ahead = (y + 2 * dy, x + 2 * dx)
        if not (0 <= y + dy < n and 0 <= x + dx < n) or (0 <= ahead[0] < n and 0 <= ahead[1] < n and image[ahead]):
            dy, dx = dx, -dy
            if image[min(n - 1, max(0, y + 2 * dy)), min(n - 1, max(0, x + 2 * dx))] and image[y + dy, x + dx]:
                break
        y, x = y + dy, x + dx
    return image


def test_components(spark):
    images = {(1, 0): noise(5), (1, 1): noise(6), (2, 0): spiral(), (2, 1): np.zeros((8, 8), int), (3, 0): np.full((16, 16), 255)}
    got = {}
    for r in components.component_sizes(tiles_of(spark, images), 150).collect():
        got.setdefault((r.task_id, r.frame_index), []).append((r.area, round(r.x, 6), round(r.y, 6), r.x0, r.y0, r.x1, r.y1))
    for k, image in images.items():
        want = []
        for part in flood(image, 150):
            ys, xs = np.array(part).T
            want.append((len(part), round(xs.mean(), 6), round(ys.mean(), 6), xs.min(), ys.min(), xs.max() + 1, ys.max() + 1))
        assert sorted(got.get(k, [])) == sorted(want)
    assert not tables._places or all("motionlake" in path for _, path in tables._places.values())


def disc(image, y, x, r):
    yy, xx = np.mgrid[: image.shape[0], : image.shape[1]]
    image[(yy - y) ** 2 + (xx - x) ** 2 <= r * r] = 255


def test_balls_exactly_one(spark):
    none, one, two, bar = (np.zeros((48, 48), int) for _ in range(4))
    disc(one, 20, 30, 7)
    disc(two, 20, 30, 7), disc(two, 36, 10, 6)
    bar[20:23, 2:46] = 255
    one[45:47, 3:40] = 255  # long, so no ball
    parts = components.component_sizes(tiles_of(spark, {(1, 0): none, (2, 0): one, (3, 0): two, (4, 0): bar}), 200)
    assert [tuple(r) for r in components.balls(parts).collect()] == [(2, 0, 30.0, 20.0)]
    assert 0.9 < {r.task_id: r.roundness for r in parts.where("area > 100 and y < 25").collect()}[2] <= 1.01


def test_moved_head_band_fan_and_ties(spark):
    image = np.zeros((48, 48), int)
    image[30:34, 22:26] = 255  # in the band, below the grip: area 16
    image[2:6, 22:26] = 255  # in the band, above it
    image[44:48, 40:48] = 255  # larger, too far
    image[30:34, 29:33] = 255  # as large, begins later in the line
    parts = components.component_sizes(tiles_of(spark, {(1, 0): image, (2, 0): np.zeros((8, 8), int)}), 200)
    frames = spark.createDataFrame([(t, 0, 23.5, 16.0, 20.0, 0.0, 1.0, 45.0) for t in (1, 2)], "task_id bigint, frame_index bigint, grip_x double, grip_y double, club_px double, dir_x double, dir_y double, fan_deg double")
    (r,) = components.moved_head(parts, frames).collect()
    assert (r.task_id, r.head_x, r.head_y, r.area) == (1, 23.5, 31.5, 16)
    assert r.confidence == pytest.approx(0.85 * (0.45 * 16 / 40 + 0.55))


def test_lines_votes_peaks_and_segments(spark):
    image = np.zeros((64, 64), int)
    for t in range(40):  # 45 degrees down, with a hole of two pixels and one of nine
        if t not in (10, 11) and not 20 <= t < 29:
            image[10 + t, 12 + t] = 255
    image[60, 4:30] = 255
    tiles = tiles_of(spark, {(1, 0): image})
    cells = lines.votes(tiles, 128)
    got = {(r.angle, r.offset): r.votes for r in cells.collect()}
    want = {}
    for y, x in zip(*np.nonzero(image)):
        for a in range(180):
            co, si = lines.direction(a)
            key = (a, (int(x) * co + int(y) * si + 8192) // 16384)
            want[key] = want.get(key, 0) + 1
    assert got == want
    best = lines.peaks(cells, 18, reach=5)
    found = {(r.angle, r.offset) for r in best.collect()}
    assert any(88 <= a <= 92 and o == 60 for a, o in found) and any(130 <= a <= 140 for a, _ in found)
    segs = lines.segments(best, components.runs(tiles, 128), 3, 8).collect()
    ends = {((s.ax, s.ay), (s.bx, s.by)) for s in segs}
    assert ((4, 60), (29, 60)) in ends and ((12, 10), (31, 29)) in ends and ((41, 39), (51, 49)) in ends


def test_peaks_against_all_pairs(spark):
    rng = random.Random(7)
    cells = {(rng.randrange(12), rng.randrange(12)): rng.randrange(1, 9) for _ in range(70)}
    df = spark.createDataFrame([(1, 0, a, o, v) for (a, o), v in cells.items()], "task_id bigint, frame_index bigint, angle int, offset bigint, votes bigint")
    for reach in (1, 2):
        got = {(r.angle, r.offset) for r in lines.peaks(df, 3, reach).collect()}
        order = lambda k: (cells[k], -k[0], -k[1])
        want = {k for k, v in cells.items() if v >= 3 and all(order(k) >= order(q) for q in cells if abs(q[0] - k[0]) <= reach and abs(q[1] - k[1]) <= reach)}
        assert got == want


def test_edge_strength_and_heads(spark):
    image = noise(9, (32, 32))
    tiles = tiles_of(spark, {(1, 0): image})
    told = [(1, 0, 1, 3.0, 4.0, 28.0, 25.5), (1, 0, 2, 20.0, 20.0, 60.0, -9.0), (1, 0, 3, float("nan"), 1.0, 2.0, 2.0)]
    df = spark.createDataFrame(told, "task_id bigint, frame_index bigint, k int, ax double, ay double, bx double, by double")
    got = {r.k: r.edge for r in lines.edge_strength(df, tiles, ["k"]).collect()}
    for _, _, k, ax, ay, bx, by in told:
        total = 0
        for j in range(24):
            x, y = ax + (bx - ax) * j / 23, ay + (by - ay) * j / 23
            if math.isfinite(x) and math.isfinite(y) and 0 <= round(x) < 32 and 0 <= round(y) < 32:
                total += image[round(y), round(x)]
        assert got[k] == pytest.approx(total / 24 / image.max())
    aim = [(1, 0, 1, 5.0, 5.0, 1.0, 1.0, 20.0), (1, 0, 2, 5.0, 5.0, 0.0, 0.0, 20.0), (1, 0, 3, 31.0, 31.0, 1.0, 0.0, 40.0)]
    df = spark.createDataFrame(aim, "task_id bigint, frame_index bigint, k int, grip_x double, grip_y double, dir_x double, dir_y double, club_px double")
    heads = {r.k: (r.t, r.head_x, r.head_y) for r in lines.axial_heads(df, tiles, tiles, ["k"]).collect()}
    assert heads.keys() == {1, 3}
    best = None
    for j in range(7):
        t = 17.0 + j
        x = y = 5 + t / math.sqrt(2)
        v = image[round(y), round(x)]
        s = math.exp(-0.5 * ((t - 20) / 1.8) ** 2) * (0.6 * v / image.max() + 0.4 * v / 255)
        if best is None or s > best[0] + 1e-9:
            best = (s, t, x, y)
    assert heads[1] == pytest.approx(best[1:]) and heads[3][0] == pytest.approx(34.0)


def test_line_heads_leave_out_the_body(spark):
    segs = [(1, 0, 20.0, 21.0, 20.0, 40.0, 0.9), (1, 0, 21.0, 21.0, 22.0, 48.0, 0.9), (1, 0, 20.0, 19.0, 20.0, 2.0, 1.0), (1, 0, 40.0, 20.0, 40.0, 45.0, 1.0)]
    found = spark.createDataFrame(segs, "task_id bigint, frame_index bigint, ax double, ay double, bx double, by double, edge double")
    frames = spark.createDataFrame([(1, 0, 20.0, 20.0, 30.0, 0.0, 1.0)], "task_id bigint, frame_index bigint, grip_x double, grip_y double, club_px double, dir_x double, dir_y double")
    (r,) = lines.line_heads(found, frames).collect()
    assert (r.far_x, r.far_y) == (22.0, 48.0) and 0 < r.confidence <= 1
    body = spark.createDataFrame([(1, 0, 34, 22, 24), (1, 0, 35, 22, 24)], "task_id bigint, frame_index bigint, y int, x0 int, x1 int")
    (r,) = lines.line_heads(found, frames, body).collect()
    assert (r.far_x, r.far_y) == (20.0, 40.0)


def cells_of(rows, *keys):
    out = set()
    for r in rows:
        out |= {(*(r[k] for k in keys), r.y, x) for x in range(r.x0, r.x1)}
    return out


def test_polygons_unions_and_discs(spark):
    rng = random.Random(8)
    shapes = [(i, [(rng.uniform(-3, 20), rng.choice([rng.uniform(-3, 20), float(rng.randrange(20))])) for _ in range(rng.randrange(2, 7))]) for i in range(30)]
    df = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in p]) for i, p in shapes], "id bigint, p array<struct<x:double,y:double>>")
    inside = masks.filled(df, ["id"], F.col("p"))
    want = set()
    for i, p in shapes:
        for y in range(-5, 25):
            for x in range(-5, 25):
                n = 0
                for (ax, ay), (bx, by) in zip(p, p[1:] + p[:1]):
                    if ay != by and min(ay, by) <= y < max(ay, by):
                        n += ax + (y - ay) * (bx - ax) / (by - ay) <= x
                if n % 2:
                    want.add((i, y, x))
    assert cells_of(inside.collect(), "id") == want
    one = masks.united(inside, ["id"]).collect()
    assert cells_of(one, "id") == want and sum(r.x1 - r.x0 for r in one) == len(want)
    grown = cells_of(masks.dilated(inside, ["id"], F.lit(2)).collect(), "id")
    reach = [(b, a) for b in range(-2, 3) for a in range(-2, 3) if abs(a) <= math.floor(math.sqrt(4 - b * b))]
    assert grown == {(i, y + b, x + a) for i, y, x in want for b, a in reach}


def test_body_mask_and_ground(spark):
    nan = float("nan")
    px = [(nan, nan)] * 33
    for k, p in {0: (40, 10), 11: (30, 20), 12: (50, 20), 23: (33, 50), 24: (47, 50), 25: (33, 70)}.items():
        px[k] = p
    rows = [(1, 0, [{"x": float(x), "y": float(y)} for x, y in px]), (2, 0, [{"x": nan, "y": nan}] * 33)]
    df = spark.createDataFrame(rows, "task_id bigint, frame_index bigint, px array<struct<x:double,y:double>>")
    got = cells_of(masks.body_mask(df, F.lit(80), F.lit(100)).collect(), "task_id")
    assert {t for t, _, _ in got} == {1}
    for y, x in ((35, 40), (10, 40), (60, 33), (20, 30), (50, 47), (72, 33)):
        assert (1, y, x) in got
    for y, x in ((0, 0), (90, 40), (60, 60), (35, 75)):
        assert (1, y, x) not in got
    assert all(0 <= y < 100 and 0 <= x < 80 for _, y, x in got)
    told = [(1, "face_on", 100, 200, 150.0, 0.5, 0.9), (2, "down_the_line", 100, 200, 150.0, 0.5, 0.9), (3, "face_on", 100, 200, 150.0, nan, 0.9), (4, "face_on", 100, 200, 150.0, 0.5, 1.4), (5, "face_on", 0, 0, 1.0, 0.5, 0.9)]
    ground = masks.ground_region(spark.createDataFrame(told, "task_id bigint, view string, width bigint, height bigint, body_px double, ankle_x double, ankle_y double"))
    found = {}
    for r in ground.collect():
        found.setdefault(r.task_id, []).append((r.y, r.x0, r.x1))
    assert {k: (min(v)[0], max(v)[0], min(v)[1], min(v)[2]) for k, v in found.items()} == {1: (183, 199, 20, 80), 2: (183, 199, 0, 100)}


def test_tiles_from_vectors(spark):
    rows = [(0, [0.001 * i for i in range(64)]), (130, [-0.5] * 64), (5, [0.1] * 9), (6, [None] * 64), (7, None)]
    got = {(r.task_id, r.frame_index, r.ty, r.tx): r.pixels for r in tiles_from_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert got.keys() == {(0, 0, 0, 0), (1, 0, 0, 2)} and got[1, 0, 0, 2] == [244] * 64


def test_no_join_of_components_is_a_broadcast(spark, monkeypatch):
    plans, real = [], components.scratch
    monkeypatch.setattr(components, "scratch", lambda df: plans.append(df._jdf.queryExecution().toString()) or real(df))
    image = np.zeros((8, 8), int)
    image[1:3, 1:4] = image[5, 5] = 255
    assert components.component_sizes(tiles_of(spark, {(1, 0): image}), 200).count() == 2
    assert plans and not any("BroadcastHashJoin" in p for p in plans)
