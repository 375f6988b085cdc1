"""Segmentation of a swing into eight phases, as windows over the rows of a task.

All windows share the partitioning by task, so there is one exchange. Each step adds columns
that are the same in all rows of a task, under the names of its results; `code` is the first
error of a task (null if there is none), so that one bad swing stops no other. At the end the
rows of a task fold into one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .. import config as C
from ..dims import PHASES
from ..sources.tables import hashed, sorted_side
from .series import Series, smoothing_width

c = F.col
NO_SWING = "NO_SWING"
KEY = ["task_id"]


def group() -> WindowSpec:
    return Window.partitionBy(*KEY)


def rounds(x: Column) -> Column:
    """Half to even. Not bround, which goes by way of decimal text."""
    return F.rint(x).cast("int")


def frames_of(seconds: float, least: int) -> Column:
    return F.greatest(F.lit(least), rounds(c("fe") * seconds))


# ---- over the rows of a task, between two places


def first_where(lo: Column, hi: Column, cond: Column) -> Column:
    return F.min(F.when(c("i").between(lo, hi) & cond, c("i"))).over(group())


def last_where(lo: Column, hi: Column, cond: Column) -> Column:
    return F.max(F.when(c("i").between(lo, hi) & cond, c("i"))).over(group())


def arg_max(value: str, lo: Column, hi: Column) -> Column:
    """First place of the greatest value."""
    return -F.max(F.when(c("i").between(lo, hi), F.struct(c(value).alias("v"), (-c("i")).alias("m")))).over(group())["m"]


def arg_min(value: str, lo: Column, hi: Column) -> Column:
    return F.min(F.when(c("i").between(lo, hi), F.struct(c(value).alias("v"), c("i").alias("m")))).over(group())["m"]


def at(value: str, place: Column) -> Column:
    return F.max(F.when(c("i") == place, c(value))).over(group())


def series_of(frames: DataFrame, videos: DataFrame) -> DataFrame:
    """The series that segmentation reads, in units of the frame's width. Frames that are dealt by task stay where they are."""
    v = videos.select("task_id", "fps", "width", "height")
    p = lambda k, x: F.get("norm", F.lit(k))[x]
    ratio = F.when((c("width") > 0) & (c("height") > 0), c("height") / c("width")).otherwise(1.0)
    rows = frames.select(
        "task_id", "i", "frame_index", "ts",
        p(C.L_SHOULDER, "x").alias("lsx"), p(C.L_SHOULDER, "y").alias("lsy"), p(C.R_SHOULDER, "x").alias("rsx"), p(C.R_SHOULDER, "y").alias("rsy"),
        p(C.L_WRIST, "x").alias("wx"), p(C.L_WRIST, "y").alias("wy"), p(C.L_HIP, "y").alias("lhy"), p(C.R_HIP, "y").alias("rhy"),
    ).join(hashed(v), "task_id")
    return rows.select(
        "task_id", "fps", "width", "height", "i", "frame_index", "ts",
        F.hypot(c("lsx") - c("rsx"), (c("lsy") - c("rsy")) * ratio).alias("shoulder_width"), c("wx").alias("wrist_x"), (c("wy") * ratio).alias("wrist_y"),
        ((c("lsy") + c("rsy")) / 2 * ratio).alias("shoulder_y"), ((c("lhy") + c("rhy")) / 2 * ratio).alias("hip_y"),
    )


def body_scale(width: Column) -> Column:
    """The unit of lengths: the median of the shoulders' width. An aggregate, or over a window."""
    return F.median(width)


def wrist_travel(y: Column) -> Column:
    """From the highest place to the lowest, without the last twentieth. An aggregate."""
    return F.percentile(y, F.lit(0.95)) - F.min(y)


def no_swing(scale: Column, n: Column, fe: Column, peak: Column, travel: Column, least_peak: float = C.V_PEAK_MIN, least_travel: float = C.MIN_WRIST_TRAVEL) -> Column:
    """Whether a series is no swing at all: no scale, too short, too slow or too small."""
    return (
        F.coalesce(scale < C.MIN_SCALE, F.lit(True)) | (n < F.greatest(F.lit(10), rounds(fe * 0.5)))
        | F.coalesce(peak < least_peak, F.lit(True)) | (travel < least_travel * scale)
    )


def signals(frames: DataFrame, videos: DataFrame) -> DataFrame:
    """Per row: n, dt, fe, S, wrist_y, shoulder_y, h, speed, still_before and still_after, and the first guards in code."""
    g = group()
    moved = ["wrist_x", "wrist_y", "shoulder_y", "hip_y"]
    s = Series(series_of(frames, videos), KEY, ["i"]).filled([*moved, "shoulder_width"])
    s = s.add("n", F.count(F.lit(1)).over(s.group).cast("int")).add("step", c("frame_index") - F.lag("frame_index").over(s.by))
    df = s.df.withColumn("S", body_scale(c("shoulder_width")).over(g)).withColumn("step", F.median(F.when(c("step") > 0, c("step"))).over(g))
    step = F.greatest(F.lit(1), F.coalesce(rounds(c("step")), F.lit(1)))
    df = df.withColumn("dt", F.when(c("fps") > 0, step / c("fps")).otherwise(1 / 30)).withColumn("fe", F.when(c("dt") > 0, 1 / c("dt")).otherwise(1.0))
    df = df.withColumn("w", smoothing_width(c("fe"), C.SMOOTH_SEC))
    s = Series(df, KEY, ["i"]).scaled("w").scaled_averaged(moved, "w", "n")  # from here on all windows share its order
    scale = F.when(c("S") >= C.MIN_SCALE, c("S"))
    prev, nxt = lambda x: F.coalesce(F.lag(x).over(s.by), c(x)), lambda x: F.coalesce(F.lead(x).over(s.by), c(x))
    apart = F.hypot(nxt("wrist_x") - prev("wrist_x"), nxt("wrist_y") - prev("wrist_y"))
    span = nxt("i") - prev("i")
    s = s.add("h", (c("hip_y") - c("wrist_y")) / scale).add("speed", F.when(span > 0, apart / (span * c("dt")) / scale).otherwise(0.0))
    s = s.scaled_averaged(["speed"], "w", "n")
    moving = F.when(~F.coalesce(c("speed") < C.V_STILL, F.lit(False)), c("i"))
    s = s.add("moving", moving)
    before, after = F.coalesce("moving", s.known("moving", "lag")), F.coalesce("moving", s.known("moving", "lead"))
    s = s.add("still_before", c("i") - F.coalesce(before, F.lit(-1))).add("still_after", F.coalesce(after, c("n")) - c("i"))  # lengths of the still run up to and from here
    travel = F.percentile("wrist_y", F.lit(0.95)).over(g) - F.min("wrist_y").over(g)
    bad = no_swing(c("S"), c("n"), c("fe"), F.max("speed").over(g), travel)
    return s.add("code", F.when(bad, NO_SWING)).df.drop("shoulder_width", "wrist_x", "hip_y", "step", "w", "__at", "moving")


def _fails(df: DataFrame, bad: Column) -> DataFrame:
    return df.withColumn("code", F.coalesce("code", F.when(F.coalesce(bad, F.lit(True)), NO_SWING)))


def anchors(df: DataFrame) -> DataFrame:
    """top, address, impact, finish with *_est."""
    n = c("n")
    lo = F.greatest(F.lit(0), F.least(rounds(n * C.TOP_MARGIN), n - 1))
    df = df.withColumn("lo", lo).withColumn("peak", arg_max("speed", F.lit(0), n - 1))
    hi = F.greatest(c("lo") + 1, F.least(rounds(n * (1 - C.TOP_MARGIN)), n))
    far = c("peak") - c("lo") >= frames_of(C.MIN_TOP_ADDRESS_SEC, 2)
    df = df.withColumn("hi", F.when(far, F.greatest(c("lo") + 1, F.least(hi, c("peak")))).otherwise(hi))
    df = df.withColumn("high", arg_max("h", c("lo"), c("hi") - 1)).withColumn("reach", frames_of(C.TOP_REFINE_SEC, 1))
    near = arg_min("speed", F.greatest(c("lo"), c("high") - c("reach")), F.least(c("hi"), c("high") + c("reach") + 1) - 1)
    df = df.withColumn("top", F.coalesce(near, c("high"))).drop("lo", "hi", "high", "reach", "peak")
    df = _fails(df, c("top") <= 0)

    # the last still run before the top with hands low at its end
    need = frames_of(C.STILL_SEC_ADDRESS, 2)
    ends = (c("still_before") >= need) & ((c("i") == c("top") - 1) | (c("still_after") == 1)) & (c("h") <= C.ADDRESS_H_MAX)
    df = df.withColumn("found", last_where(need - 1, c("top") - 1, ends)).withColumn("rest", arg_min("speed", F.lit(0), c("top") - 1))
    df = df.withColumn("address", F.coalesce("found", "rest")).withColumn("address_est", c("found").isNull())
    df = _fails(df, c("top") - c("address") < frames_of(C.MIN_TOP_ADDRESS_SEC, 3))

    df = df.withColumn("gap", frames_of(C.MIN_IMPACT_TOP_SEC, 2)).withColumn("h0", at("h", c("address")))
    span = F.greatest(c("gap") + 1, rounds(c("fe") * C.MAX_DOWNSWING_SEC))
    df = df.withColumn("hi", F.greatest(F.least(n, c("top") + 1 + span), F.least(n, c("top") + 2)))
    df = df.withColumn("cross", first_where(c("top") + 1, c("hi") - 1, c("h") <= c("h0") + C.IMPACT_H_TOL)).withColumn("reach", frames_of(C.IMPACT_WIN_SEC, 1))
    close = arg_max("speed", F.greatest(c("top") + 1, c("cross") - c("reach")), F.least(c("hi"), c("cross") + c("reach") + 1) - 1)
    df = df.withColumn("close", close).withColumn("rest", arg_max("speed", c("top") + 1, c("hi") - 1))
    df = df.withColumn("impact", F.when(c("cross").isNotNull(), c("close")).otherwise(c("rest")))
    df = _fails(df.withColumn("impact_est", c("cross").isNull()), c("impact") - c("top") < c("gap"))

    need = frames_of(C.STILL_SEC_FINISH, 2)
    df = df.withColumn("found", first_where(c("impact") + 1, n - need, c("still_after") >= need)).withColumn("rest", arg_min("speed", c("impact") + 1, n - 1))
    late = (n - 1 - c("impact") >= rounds(c("fe") * C.FINISH_FALLBACK_SEC)) & (c("impact") < n - 1)
    df = df.withColumn("finish", F.coalesce("found", F.when(late, c("rest")).otherwise(n - 1))).withColumn("finish_est", c("found").isNull())
    return df.drop("found", "gap", "hi", "cross", "reach", "close", "rest", "h0")


def intermediates(df: DataFrame) -> DataFrame:
    """takeaway, backswing, downswing, follow_through with *_est, from the anchors."""
    ratio = lambda a, b, r: rounds(c(a) + (c(b) - c(a)) * r)
    r2, r3, r5, r7 = C.FALLBACK_RATIOS

    def chosen(df: DataFrame, name: str, otherwise: Column) -> DataFrame:
        return df.withColumn(name, F.coalesce("found", otherwise)).withColumn(f"{name}_est", c("found").isNull()).drop("found")

    low = first_where(c("address"), c("top"), c("h") < C.H_HIP)
    df = df.withColumn("low", F.when(c("top") > c("address"), low)).withColumn("raised", first_where(c("top"), c("impact"), c("h") > C.H_DOWNSWING))
    df = df.withColumn("least", arg_min("h", c("impact"), c("finish")))
    df = df.withColumn("found", first_where(c("low") + 1, c("top"), c("h") >= C.H_HIP)).withColumn("h0", at("h", c("least")))
    df = chosen(df, "takeaway", ratio("address", "top", r2))
    over = first_where(c("takeaway"), c("top"), c("wrist_y") <= c("shoulder_y"))
    df = chosen(df.withColumn("found", F.when(c("top") > c("takeaway"), over)), "backswing", ratio("address", "top", r3))
    df = df.withColumn("under", first_where(c("raised") + 1, c("impact"), c("h") <= C.H_DOWNSWING))
    df = chosen(df.withColumn("found", F.when(c("under") < c("impact"), c("under"))), "downswing", ratio("top", "impact", r5))
    df = df.withColumn("up", first_where(c("least") + 1, c("finish"), c("h") >= c("h0") + C.FOLLOW_RISE))
    inside = F.when((c("up") > c("impact")) & (c("up") < c("finish")), c("up"))
    df = chosen(df.withColumn("found", inside), "follow_through", ratio("impact", "finish", r7))
    return df.drop("low", "raised", "least", "h0", "under", "up")


def ordered(df: DataFrame) -> DataFrame:
    """idx and est: the eight places made strictly increasing; moved ones count as estimated. Out of order in the video is an error."""
    n = c("n")
    raw = {"address": F.least(F.greatest(c("address"), F.lit(0)), n - 1)}
    df = df.withColumns({f"r_{p}": raw.get(p, c(p)) for p in PHASES}).withColumn("top_est", F.lit(False))
    df = df.withColumn("u_0", c("r_address"))
    for k, p in enumerate(PHASES[1:], 1):
        df = df.withColumn(f"u_{k}", F.greatest(c(f"r_{p}"), c(f"u_{k - 1}") + 1))
    over = c("u_7") > n - 1
    df = df.withColumns({f"x_{k}": F.when(over, F.least(c(f"u_{k}"), n - 8 + k)).otherwise(c(f"u_{k}")) for k in range(8)})
    df = df.withColumn("idx", F.array(*[c(f"x_{k}") for k in range(8)]))
    df = df.withColumn("est", F.array(*[c(f"{p}_est") | (c(f"x_{k}") != c(f"r_{p}")) for k, p in enumerate(PHASES)]))
    df = df.drop(*[f"{a}_{k}" for a in "ux" for k in range(8)], *[f"r_{p}" for p in PHASES], *[x for p in PHASES for x in (p, f"{p}_est")])
    return _fails(df, F.get("idx", F.lit(0)) < 0)


def folded(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per task: its facts, idx, est, code, the eight frames in `at`, and how long the finish is held."""
    last, first = F.get("idx", F.lit(7)), F.get("idx", F.lit(0))
    broken = F.min(F.when((c("i") >= last) & ~F.coalesce(c("speed") < C.V_STILL, F.lit(False)), c("i")))
    facts = ["fps", "width", "height", "n", "dt", "fe", "S", "idx", "est", "code", *(keep or [])]
    out = df.groupBy("task_id").agg(
        F.first(F.struct(*facts)).alias("s"), F.max("speed").alias("peak_speed"), F.max("h").alias("highest"), broken.alias("broken"),
        F.array_sort(F.collect_list(F.when(F.array_contains("idx", c("i")), F.struct("i", "frame_index", "ts")))).alias("at"),
    ).select("task_id", "s.*", "peak_speed", "highest", "broken", "at")
    out = out.withColumn("held", F.coalesce("broken", "n") - last).drop("broken")
    frame = lambda k: F.get("at", F.lit(k))["frame_index"]
    mixed_up = F.size("at") < 8
    for k in range(7):
        mixed_up = mixed_up | (frame(k + 1) <= frame(k))
    return _fails(out, mixed_up).withColumn("first", first).withColumn("last", last)


def segmented(frames: DataFrame, videos: DataFrame) -> DataFrame:
    """One row per task: facts, idx, est, code."""
    return folded(ordered(intermediates(anchors(signals(frames, videos)))))


def events(swings: DataFrame) -> DataFrame:
    """Eight rows per task without an error."""
    rows = swings.where("code is null").select("task_id", F.posexplode(F.arrays_zip("idx", "est", "at")).alias("k", "e"))
    names = F.array(*[F.lit(p) for p in PHASES])
    return rows.select(
        "task_id",
        (c("k") + 1).alias("phase_no"),
        F.get(names, c("k")).alias("phase"),
        c("e.idx").alias("array_index"),
        c("e.at.frame_index").alias("frame_index"),
        F.round(c("e.at.ts"), 3).alias("timestamp"),
        c("e.est").alias("estimated"),
    )


def reanchored(rows: DataFrame, swings: DataFrame, impacts: DataFrame) -> DataFrame:
    """swings with the impact moved to `new` (of impacts: task_id, new) where it lies strictly between top and finish and keeps the order.

    rows are the signals. Adds moved; other swings stay as they are.
    """
    k = lambda j, col="idx": F.get(col, F.lit(j))
    able = c("code").isNull() & (c("new") > k(3)) & (c("new") < k(7)) & (c("new") != k(5))
    asked = swings.join(sorted_side(impacts.select("task_id", "new")), "task_id").where(able)
    asked = asked.select("task_id", k(0).alias("address"), k(3).alias("top"), c("new").alias("impact"), k(7).alias("finish"),
                         k(0, "est").alias("address_est"), F.lit(False).alias("impact_est"), k(7, "est").alias("finish_est"))
    redone = folded(ordered(intermediates(rows.withColumn("code", F.lit(None).cast("string")).join(hashed(asked), "task_id"))))
    good = redone.where("code is null").select("task_id", F.struct(*[x for x in swings.columns if x != "task_id"]).alias("redone"))
    met = swings.join(sorted_side(good), "task_id", "left")
    return met.select(
        "task_id", *[F.when(c("redone").isNotNull(), c("redone")[x]).otherwise(c(x)).alias(x) for x in swings.columns if x != "task_id"],
        c("redone").isNotNull().alias("moved"),
    )
