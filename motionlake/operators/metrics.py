"""Metrics of the eight phases and of the whole swing, judged against the spec dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .. import config as C
from ..dims import DTL, FACE, PHASES
from ..functions import geo as G
from ..functions.text import judge5, sanitised
from ..sources.tables import hashed, sorted_side

c = F.col


def task() -> WindowSpec:
    return Window.partitionBy("task_id")


def world(k: int, row: str = "") -> Column:
    return F.get(c(f"{row}world"), F.lit(k))


def pixel(k: int, row: str = "") -> Column:
    p = F.get(c(f"{row}norm"), F.lit(k))
    return G.point(p["x"] * c("width"), p["y"] * c("height"))


def spine(row: str = "") -> Column:
    return G.minus(
        G.midpoint(world(C.L_SHOULDER, row), world(C.R_SHOULDER, row)), G.midpoint(world(C.L_HIP, row), world(C.R_HIP, row))
    )


def forward_tilt(row: str = "") -> Column:
    return F.when(c("view") == DTL, F.abs(G.tilt_xy(spine(row)))).otherwise(G.tilt_yz(spine(row)))


def hip_mid(row: str = "") -> Column:
    return G.midpoint(pixel(C.L_HIP, row), pixel(C.R_HIP, row))


def detected_view(ratio: Column, width: Column, height: Column) -> Column:
    """The shoulder-to-height ratio decides where it is known, else the frame's format."""
    by_ratio = F.when(ratio < C.VIEW_RATIO_DTL, DTL).when(ratio.isNotNull(), FACE)
    return F.coalesce(by_ratio, F.when(width > height, DTL).otherwise(FACE))


def task_facts(frames: DataFrame, swings: DataFrame, videos: DataFrame) -> DataFrame:
    """One row per task without an error: view, warning, scales, whole-swing values.

    Frames meet their task's row and are folded in the same partitioning. They are neither sorted nor moved for it, and
    are narrowed to a few numbers before they are folded.
    """
    v = videos.select("task_id", "fps", "width", "height", "chosen_view")
    own = swings.where("code is null").drop("fps", "width", "height").join(sorted_side(v), "task_id")
    place, frame = (lambda k: F.get("idx", F.lit(k))), (lambda k: F.get("at", F.lit(k))["frame_index"])
    own = own.select(
        "task_id", "fps", "width", "height", "chosen_view", "code", "first", "last",
        (c("held") * c("dt")).alias("balance_hold_sec"),
        ((c("held") > 0) & (c("last") + c("held") >= c("n"))).alias("cut_short"),
        ((place(3) - c("first")) / F.greatest(F.lit(1), place(5) - place(3))).alias("tempo_ratio"),
        F.when(c("fps") > 0, (frame(7) - frame(0)) / c("fps")).alias("swing_duration"),
    )
    rows = frames.select("task_id", "i", "norm", "world").join(hashed(own), "task_id")
    shoulders = F.hypot(pixel(C.L_SHOULDER)["x"] - pixel(C.R_SHOULDER)["x"], pixel(C.L_SHOULDER)["y"] - pixel(C.R_SHOULDER)["y"])
    wide = G.distance(world(C.L_SHOULDER), world(C.R_SHOULDER))
    tall = F.abs((pixel(C.L_ANKLE)["y"] + pixel(C.R_ANKLE)["y"]) / 2 - pixel(C.NOSE)["y"])
    keys = ["task_id", "fps", "width", "height", "chosen_view", "code", "first", "last", "balance_hold_sec", "cut_short", "tempo_ratio", "swing_duration"]
    rows = rows.select(*keys, "i", shoulders.alias("shoulders"), wide.alias("wide"), tall.alias("high"), pixel(C.NOSE).alias("at_nose"))
    base = c("i") == c("first")
    facts = rows.groupBy(*keys).agg(
        F.max(F.when(base, c("wide"))).alias("s_world"), F.median("wide").alias("s_median"),
        F.max(F.when(base, c("shoulders"))).alias("px"), F.percentile(F.when(c("shoulders") > 0, c("shoulders")), F.lit(0.9)).alias("px90"),
        F.max(F.when(base, c("high"))).alias("tall"), F.max(F.when(base, c("at_nose"))).alias("nose"),
        F.collect_list(F.when(c("i").between(c("first"), c("last")), c("at_nose"))).alias("noses"),
    )
    ratio = F.when((c("px") > C.EPS) & (c("tall") > C.EPS), c("px") / c("tall"))
    seen = detected_view(ratio, c("width"), c("height"))
    facts = facts.withColumn("seen", seen)
    asked = c("chosen_view").isin(FACE, DTL)
    s_px = F.when(c("px") >= 0.6 * c("px90"), c("px")).otherwise(F.coalesce(F.when(c("px90") > 0, c("px90")), F.lit(1.0)))
    facts = facts.withColumn("view", F.when(asked, c("chosen_view")).otherwise(c("seen"))).withColumn("s_px", s_px)
    facts = facts.withColumn("s_world", F.coalesce(F.when(c("s_world") > 1e-6, c("s_world")), c("s_median"), F.lit(1.0)))
    by_height = F.when((c("view") == DTL) & (c("tall") > 0), c("tall") * C.SHOULDER_TO_HEIGHT)
    facts = facts.withColumn("scale_px", F.coalesce(by_height, c("s_px")))
    drift = F.array_max(F.transform("noses", lambda p: G.displacement_pct(p, c("nose"), c("scale_px"))))
    return facts.withColumn("max_head_drift_pct", F.greatest(F.coalesce(drift, F.lit(0.0)), F.lit(0.0))).withColumn(
        "view_mismatch", asked & (c("chosen_view") != c("seen"))
    ).drop("noses", "nose", "s_median", "px", "px90")


def of_frame() -> dict[str, Column]:
    """What a metric needs of its own frame: numbers and a few points."""
    arm = lambda *k: G.angle_3p(*(world(x) for x in k))
    left, right = arm(C.L_HIP, C.L_KNEE, C.L_ANKLE), arm(C.R_HIP, C.R_KNEE, C.R_ANKLE)
    plane = G.line_angle(pixel(C.L_SHOULDER), pixel(C.L_WRIST))
    seen = (F.get("vis", F.lit(C.L_SHOULDER)) >= C.LOW_VISIBILITY) & (F.get("vis", F.lit(C.L_WRIST)) >= C.LOW_VISIBILITY)
    return {
        "forward": forward_tilt(), "lateral": G.tilt_xy(spine()), "line": G.line_tilt(world(C.L_SHOULDER), world(C.R_SHOULDER)),
        "stance": F.when(c("s_world") > C.EPS, F.abs(world(C.L_ANKLE)["x"] - world(C.R_ANKLE)["x"]) / c("s_world")),
        "knees": F.coalesce((left + right) / 2, left, right),
        "lead": arm(C.L_SHOULDER, C.L_ELBOW, C.L_WRIST), "trail": arm(C.R_SHOULDER, C.R_ELBOW, C.R_WRIST),
        "plane": F.when(seen, F.when(plane > 90, 180 - plane).otherwise(plane)),
        "own": F.struct(
            G.minus(world(C.L_SHOULDER), world(C.R_SHOULDER)).alias("shoulders"), G.minus(world(C.L_HIP), world(C.R_HIP)).alias("hips"),
            pixel(C.NOSE).alias("nose"), hip_mid().alias("hip"),
        ),
    }


def implementations() -> dict[str, Column]:
    """Name of an implementation -> its column, over a phase row of of_frame() with the address row's points in `a` and its task's facts."""
    turn = lambda k: G.rotation_xz(c(f"own.{k}"), c(f"a.{k}"))
    shoulder, hip = turn("shoulders"), turn("hips")
    at_phase = lambda p, v: F.max(F.when(c("phase") == p, v)).over(task())
    xf = shoulder - hip
    xf_top, xf_down = at_phase("top", xf), at_phase("downswing", xf)
    rise = at_phase("address", c("forward")) - at_phase("impact", c("forward"))
    return {
        "spine_forward_tilt": c("forward"), "stance_width_ratio": c("stance"), "shoulder_line_tilt": c("line"), "knee_flex": c("knees"),
        "shoulder_turn": shoulder, "hip_turn": hip, "x_factor": xf,
        "lead_arm_straight": c("lead"), "trail_elbow_flex": c("trail"), "trail_arm_extend": c("trail"),
        "head_drift_pct": G.displacement_pct(c("own.nose"), c("a.nose"), c("scale_px")),
        "pelvis_shift_pct": G.signed_shift_pct(c("own.hip"), c("a.hip"), c("scale_px")),
        "x_factor_retention": F.when(F.abs(xf_top) >= 1e-3, xf_down / xf_top * 100).otherwise(100.0),
        "hip_open": -hip, "hip_to_target": -hip, "shoulder_open": -shoulder, "shoulder_square": -shoulder,
        "spine_tilt_delta": F.when(rise.isNotNull(), F.greatest(rise, F.lit(0.0))),
        "spine_lateral_tilt": c("lateral"),
        "balance_hold_sec": c("balance_hold_sec"), "tempo_ratio": c("tempo_ratio"), "swing_duration": c("swing_duration"),
        "max_head_drift_pct": c("max_head_drift_pct"), "swing_plane": c("plane"),
    }


def dispatched(names: list[str], measured: str = "m") -> Column:
    """Of the struct of all measured values the one that a spec's impl_key names; null if none has that name."""
    return F.coalesce(*[F.when(c("impl_key") == k, c(f"{measured}.{k}")) for k in names])


def stage_metrics(frames: DataFrame, swings: DataFrame, videos: DataFrame, specs: DataFrame) -> DataFrame:
    """One row per task, phase (or global) and spec of its view: value, status, filled."""
    places = swings.where("code is null").select("task_id", "idx")
    facts = task_facts(frames, swings, videos).join(sorted_side(places), "task_id")
    # by task alone, as the frames lie: by task and place all of them would move
    rows = frames.select("task_id", "i", "norm", "world", "vis").join(hashed(facts), "task_id").where(F.array_contains("idx", c("i")))
    rows = rows.withColumn("phase_no", F.array_position("idx", c("i")).cast("int"))
    names = F.array(*[F.lit(p) for p in PHASES])
    told = ["scale_px", "balance_hold_sec", "tempo_ratio", "swing_duration", "max_head_drift_pct"]
    rows = rows.select("task_id", "phase_no", F.get(names, c("phase_no") - 1).alias("phase"), "view", *told, *[v.alias(k) for k, v in of_frame().items()])
    base = F.first(F.when(c("phase") == "address", c("own")), True)
    rows = rows.withColumn("a", base.over(task().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    measured = implementations()
    wide = rows.select("task_id", "phase", "phase_no", "view", F.struct(*[v.alias(k) for k, v in measured.items()]).alias("m"))
    # the address row stands for the whole swing as well
    pair = lambda p, no: F.struct(p.alias("phase"), no.alias("phase_no"))
    here, whole = pair(c("phase"), c("phase_no")), pair(F.lit("global"), F.lit(9))
    wide = wide.select("task_id", "view", "m", F.inline(F.when(c("phase") == "address", F.array(here, whole)).otherwise(F.array(here))))
    long = wide.join(F.broadcast(specs), "phase").where(F.array_contains("views", c("view")))  # 36 rows
    long = long.withColumn("raw", dispatched(list(measured)))
    judged = long.withColumn("value", sanitised(c("raw"), c("unit"), c("ref_min"), c("ref_max"), c("allow_drop"))).where("value is not null")
    return judged.select(
        "task_id", "view", "phase_no", "phase", "spec_no", c("key").alias("metric_key"), "unit", "value", "ref_min", "ref_max",
        judge5(c("value"), c("ref_min"), c("ref_max"), c("critical")).alias("status"), c("raw").isNull().alias("filled"),
    )
