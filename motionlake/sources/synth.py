"""A deterministic swing for every task, from keyframes, in DataFrame operations only."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import point

FPS, FRAMES, WIDTH, HEIGHT = 30.0, 120, 480, 854

# Fixed values: (time, value) keys of each series; the times of top and impact may shift.
ADDRESS, TOP, IMPACT, MID, FINISH = 0.70, 1.45, 1.80, 2.05, 2.40
KEYS = {
    "shoulder": [(ADDRESS, 0), (TOP, -78), (IMPACT, -6), (MID, 40), (FINISH, 92)],
    "hip": [(ADDRESS, 0), (TOP, -52), (IMPACT, 18), (MID, 48), (FINISH, 84)],
    "hand_x": [(ADDRESS, 0.12), (TOP, -0.42), (IMPACT, 0.10), (FINISH, 0.42)],
    "hand_y": [(ADDRESS, 0.12), (TOP, -0.88), (IMPACT, 0.14), (FINISH, -0.92)],
    "hand_z": [(ADDRESS, -0.40), (TOP, -0.06), (IMPACT, -0.42), (FINISH, 0.02)],
    "shift": [(ADDRESS, 0), (TOP, -0.010), (IMPACT, 0.060), (MID, 0.090), (FINISH, 0.110)],
    "spine_z": [(ADDRESS, -0.380), (TOP, -0.360), (IMPACT, -0.330), (MID, -0.240), (FINISH, -0.100)],
    "spine_x": [(ADDRESS, 0), (TOP, -0.050), (IMPACT, -0.100), (MID, -0.140), (FINISH, -0.100)],
    "lead": [(ADDRESS, 172), (TOP, 160), (IMPACT, 170), (MID, 166), (FINISH, 152)],
    "trail": [(ADDRESS, 168), (TOP, 108), (IMPACT, 142), (MID, 164), (FINISH, 160)],
}


def eased(t: Column, keys: list[tuple], late: Column) -> Column:
    """Smoothstep between keys, constant beyond them; late shifts all keys after the address."""
    at = [F.lit(k) if k == ADDRESS else F.lit(k) + late for k, _ in keys]
    out = F.when(t <= at[0], F.lit(float(keys[0][1])))
    for (_, v0), (_, v1), a, b in zip(keys, keys[1:], at, at[1:]):
        u = (t - a) / F.greatest(b - a, F.lit(1e-9))
        out = out.when(t <= b, F.lit(float(v0)) + F.lit(float(v1 - v0)) * u * u * (3 - 2 * u))
    return out.otherwise(F.lit(float(keys[-1][1])))


def _joint(a: Column, b: Column, angle: Column) -> Column:
    """The joint between a and b that opens by angle: off the midpoint, across the chord."""
    dx, dy, dz = (b[k] - a[k] for k in "xyz")
    size = F.sqrt(dx * dx + dy * dy + dz * dz)
    # chord x (0, 1, 0)
    sx, sz = -dz, dx
    side = F.sqrt(sx * sx + sz * sz)
    off = size / 2 * F.tan(F.radians((180 - angle) / 2))
    share = F.when(side > 1e-9, off / side).otherwise(0.0)
    return point((a["x"] + b["x"]) / 2 + sx * share, (a["y"] + b["y"]) / 2, (a["z"] + b["z"]) / 2 + sz * share)


def _plus(a: Column, x: Column, y: Column, z: Column) -> Column:
    return point(a["x"] + x, a["y"] + y, a["z"] + z)


def frames(
    tasks: DataFrame, late: Column | None = None, lates: tuple[float, ...] = (0.0,), n: int = FRAMES, fps: float = FPS, step: int = 1
) -> DataFrame:
    """tasks: task_id. One row per task and sampled frame, in the shape of the landmark table.

    A swing depends on late alone, one of lates (their place in it is given by the column late). So each is made
    once, len(lates) * n rows, which are broadcast to tasks that are dealt out by task_id as all later steps want them.
    """
    spark = tasks.sparkSession
    asked = tasks.select("task_id", (F.lit(0) if late is None else late).cast("int").alias("late_no"))
    asked = asked.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "task_id")
    shapes = spark.createDataFrame([(k, float(x)) for k, x in enumerate(lates)], "late_no int, late double")
    rows = shapes.select("late_no", "late", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    rows = rows.withColumn("frame_index", (F.col("i") * step).cast("int")).withColumn("ts", F.col("frame_index") / fps)
    t = F.col("ts")
    rows = rows.withColumns({k: eased(t, v, F.col("late")) for k, v in KEYS.items()})
    c = F.col
    zero = F.lit(0.0)
    turned = lambda a, half: point(F.cos(F.radians(a)) * half, zero, F.sin(F.radians(a)) * half)
    rows = rows.withColumns({"vs": turned(c("shoulder"), 0.20), "vh": turned(c("hip"), 0.15)})
    mid = point(c("spine_x"), F.lit(-0.55), c("spine_z"))
    rows = rows.withColumn("mid", mid)
    neg = lambda v: (-v["x"], -v["y"], -v["z"])
    pos = lambda v: (v["x"], v["y"], v["z"])
    hand = point(c("hand_x"), c("hand_y"), c("hand_z"))
    unit = F.sqrt(c("vs.x") * c("vs.x") + c("vs.z") * c("vs.z"))
    grip = lambda s: _plus(hand, s * 0.03 * c("vs.x") / unit, zero, s * 0.03 * c("vs.z") / unit)
    origin = point(zero, zero, zero)
    rows = rows.withColumns(
        {
            "p11": _plus(c("mid"), *pos(c("vs"))), "p12": _plus(c("mid"), *neg(c("vs"))),
            "p0": _plus(c("mid"), zero, F.lit(-0.28), F.lit(-0.06)),
            "p15": grip(F.lit(1.0)), "p16": grip(F.lit(-1.0)),
            "p23": _plus(origin, *pos(c("vh"))), "p24": _plus(origin, *neg(c("vh"))),
            "p27": point(F.lit(0.22), F.lit(0.92), zero), "p28": point(F.lit(-0.22), F.lit(0.92), zero),
        }
    )
    rows = rows.withColumns(
        {
            "p13": _joint(c("p11"), c("p15"), c("lead")), "p14": _joint(c("p12"), c("p16"), c("trail")),
            "p25": _joint(c("p23"), c("p27"), F.lit(168.0)), "p26": _joint(c("p24"), c("p28"), F.lit(168.0)),
        }
    )
    placed = {0, 11, 12, 13, 14, 15, 16, 23, 24, 25, 26, 27, 28}
    points = [c(f"p{k}") if k in placed else origin for k in range(33)]
    world = F.array(*points)
    seen = lambda p: point(0.5 + (p["x"] + c("shift")) / 2.0, 0.55 + p["y"] / 2.6, p["z"])
    norm = F.array(*[seen(p) for p in points])  # point by point, so that points nobody asks for are not made
    made = rows.select(
        "late_no", "i", "frame_index", "ts", F.lit(True).alias("detected"), norm.alias("norm"), world.alias("world"),
        F.array_repeat(F.lit(0.95), 33).alias("vis"),
    )
    return asked.join(F.broadcast(made), "late_no").drop("late_no")


def videos(tasks: DataFrame, n: int = FRAMES, fps: float = FPS) -> DataFrame:
    return tasks.select(
        "task_id", F.lit(fps).alias("fps"), F.lit(round(n / fps, 3)).alias("duration"), F.lit(WIDTH).alias("width"),
        F.lit(HEIGHT).alias("height"), F.lit(n).alias("frame_count"), F.lit(1).alias("sample_step"), F.lit("auto").alias("chosen_view"),
    )


