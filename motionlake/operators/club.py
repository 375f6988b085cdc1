"""The club track on rows of features: what is left once candidate lines have been measured in pixels.

lines: task_id, frame_index, branch (hough or framediff), ax, ay, bx, by (end points), head_x, head_y,
confidence. Candidates are few per frame, and frames are at most CLUB_MAX_FRAMES per task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..dims import DTL
from ..functions import geo as G
from .series import Series

c = F.col
WINDOW_SAMPLES = 16
KEY_PHASES = ("address", "top", "downswing", "impact")
VELOCITY_BLEND = 0.30
LEAST_CONFIDENCE = 0.05
SMOOTH_PLACES = 3
INTERPOLATED_SHARE = 0.5


def finite(p: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return ~(bad(p["x"]) | bad(p["y"]))


def grip(left_wrist: Column, right_wrist: Column) -> Column:
    """Null if a wrist is not finite."""
    return F.when(finite(left_wrist) & finite(right_wrist), G.midpoint(left_wrist, right_wrist))


def length_prior(view: Column, height_px: Column, shoulder_px: Column) -> Column:
    """By height in side view, else by shoulder width; the other one as a back-up; null below CLUB_MIN_PX."""
    by_height, by_width = height_px * C.CLUB_RATIO_DTL, shoulder_px * C.CLUB_RATIO_FACE
    usable = lambda x: F.when(~F.isnan(x) & (x < float("inf")) & (x >= C.CLUB_MIN_PX), x)
    side = view == DTL
    first, second = F.when(side, by_height).otherwise(by_width), F.when(side, by_width).otherwise(by_height)
    return F.coalesce(usable(first), usable(second))


def in_fan(p: Column, apex: Column, direction: Column, half_deg: Column, radius: Column) -> Column:
    """Within radius of the apex and half_deg of the direction; everywhere where the fan has no direction or extent."""
    away = G.minus(p, apex)
    open_ = (G.norm(direction) < C.EPS) | (radius <= 1.0)
    inside = (G.norm(away) <= radius) & (F.coalesce(G.angle_between(away, direction), F.lit(0.0)) <= half_deg)
    return F.coalesce(open_, F.lit(True)) | inside


def segments(points: DataFrame) -> DataFrame:
    """points: task_id, frame_index, px (array of 33 points). The bones of a pixel or more, with finite ends."""
    bone = F.explode(F.array(*[F.struct(F.get("px", F.lit(a)).alias("sa"), F.get("px", F.lit(b)).alias("sb")) for a, b in C.SKELETON]))
    rows = points.select("task_id", "frame_index", bone.alias("s")).select("task_id", "frame_index", "s.*")
    return rows.where(finite(c("sa")) & finite(c("sb")) & (F.hypot(c("sa.x") - c("sb.x"), c("sa.y") - c("sb.y")) >= 1.0))


def off_skeleton(lines: DataFrame, bones: DataFrame, lengths: DataFrame) -> DataFrame:
    """The lines that do not run along a bone of their frame: at most COLLINEAR_DEG apart and its middle near the line."""
    rows = lines.join(lengths.select("task_id", "club_px"), "task_id")
    b = bones.select(c("task_id").alias("t"), c("frame_index").alias("f"), "sa", "sb")
    p, q = G.point(c("ax"), c("ay")), G.point(c("bx"), c("by"))
    along = F.coalesce(G.angle_between_lines(G.minus(q, p), G.minus(c("sb"), c("sa"))) <= C.COLLINEAR_DEG, F.lit(False))
    near = G.point_line_distance(G.midpoint(c("sa"), c("sb")), p, q) <= C.COLLINEAR_DISTANCE * c("club_px")
    return rows.join(b, (c("task_id") == c("t")) & (c("frame_index") == c("f")) & along & near, "left_anti")


def spread(a: Column, n: Column) -> Column:
    """n elements of an array evenly, the ends included; all of it if it has no more."""
    at = lambda j: F.when(n > 1, F.bround(j * (F.size(a) - 1) / (n - 1))).otherwise(0).cast("int")
    some = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda j: F.get(a, at(j)))
    return F.when(F.size(a) <= n, a).when(n <= 0, F.array().cast("array<int>")).otherwise(F.array_distinct(some))


def trimmed(anchors: Column, keep: Column, budget: Column) -> Column:
    """Within budget, all of keep and the others evenly."""
    kept = F.array_intersect(anchors, keep)
    others = spread(F.array_except(anchors, keep), F.greatest(F.lit(0), budget - F.size(kept)))
    return F.array_sort(F.array_union(kept, others))


def targets(anchors: Column) -> Column:
    """The anchors and the frame before each."""
    return F.array_sort(F.array_union(anchors, F.filter(F.transform(anchors, lambda a: a - 1), lambda a: a >= 0)))


def planned(rows: DataFrame, swings: DataFrame, budget_bytes: int | None = None) -> DataFrame:
    """task_id, anchors, targets: the event frames, frames between top and impact, and what fits the budgets. rows: task_id, i, frame_index.

    Over the byte budget anchors between the events go one by one; then the frames before the anchors go too.
    """
    own = swings.where("code is null").select(
        "task_id", (F.greatest(F.lit(1), c("width") * c("height") * 3)).cast("bigint").alias("frame_bytes"),
        F.transform("at", lambda x: x["frame_index"]).alias("events"), F.get("idx", F.lit(3)).alias("top"), F.get("idx", F.lit(5)).alias("hit"),
    )
    met = rows.select("task_id", "i", "frame_index").join(own.select("task_id", "top", "hit"), "task_id")
    met = met.where(c("i").between(F.least("top", "hit"), F.greatest("top", "hit")))
    between = met.groupBy("task_id").agg(F.array_sort(F.collect_list("frame_index")).alias("between"))
    own = own.join(between, "task_id")
    whole = F.array_sort(F.array_union("events", spread(c("between"), F.lit(WINDOW_SAMPLES))))
    out = own.withColumn("anchors", whole)
    out = out.withColumn("anchors", trimmed(c("anchors"), c("events"), F.lit(max(8, C.CLUB_MAX_FRAMES // 2))))
    if budget_bytes is None:
        return out.select("task_id", "anchors", targets(c("anchors")).alias("targets"))
    over = lambda a: F.size(targets(a)) * c("frame_bytes") > budget_bytes
    less = F.aggregate(
        F.sequence(F.lit(1), F.lit(C.CLUB_MAX_FRAMES)), c("anchors"),
        lambda a, _: F.when(over(a) & (F.size(a) > F.size("events")), trimmed(a, c("events"), F.size(a) - 1)).otherwise(a),
    )
    out = out.withColumn("anchors", less)
    return out.select("task_id", "anchors", F.when(over(c("anchors")), c("events")).otherwise(targets(c("anchors"))).alias("targets"))


def chosen(frames: DataFrame, found: DataFrame) -> DataFrame:
    """frames: task_id, frame_index, speed. The detection of each frame, or none.

    Fast frames take the frame difference first, others the line; the other branch where that one is empty.
    """
    whole = F.struct("confidence", "branch", "head_x", "head_y")
    best_of = lambda k: F.max(F.when(c("branch") == k, whole)).alias(k)
    of = found.groupBy("task_id", "frame_index").agg(best_of("hough"), best_of("framediff"))
    rows = frames.join(of, ["task_id", "frame_index"], "left")
    fast = F.coalesce(~F.isnan("speed") & (c("speed") >= C.SPEED_SWITCH), F.lit(False))
    best = F.when(fast, F.coalesce("framediff", "hough")).otherwise(F.coalesce("hough", "framediff"))
    best = F.when(best["confidence"] >= LEAST_CONFIDENCE, best)
    return rows.select(
        *frames.columns, best["head_x"].alias("head_x"), best["head_y"].alias("head_y"),
        F.coalesce(best["confidence"], F.lit(0.0)).alias("confidence"), F.coalesce(best["branch"], F.lit("none")).alias("method"),
    )


def predicted(seen: DataFrame) -> DataFrame:
    """seen: task_id, frame_index, grip_x, grip_y, dir_x, dir_y (null where nothing was found). Adds pred_x, pred_y, fan_deg.

    The last direction found, bent by the grip's way since; straight down before the first. A fold over a task's few frames.
    """
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in seen.schema) + ", pred_x double, pred_y double, fan_deg double"

    def unit(x: float, y: float) -> tuple[float, float] | None:
        size = (x * x + y * y) ** 0.5
        return (x / size, y / size) if size > C.EPS else None

    def folded(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame_index")
        out, last = [], None
        for r in rows.itertuples():
            if last is None:
                out.append((0.0, 1.0, C.FAN_HALF_DEG[0]))
            else:
                way = unit(r.grip_x - last[2], r.grip_y - last[3])
                bent = way and unit(last[0] + VELOCITY_BLEND * way[0], last[1] + VELOCITY_BLEND * way[1])
                out.append((*(bent or last[:2]), C.FAN_HALF_DEG[1]))
            if pd.notna(r.dir_x):
                last = (r.dir_x, r.dir_y, r.grip_x, r.grip_y)
        rows[["pred_x", "pred_y", "fan_deg"]] = pd.DataFrame(out, index=rows.index)
        return rows

    return seen.groupBy("task_id").applyInPandas(folded, kind)


def smoothed(detections: DataFrame) -> DataFrame:
    """Heads filled by place and averaged over three; what was filled counts half. Tasks without a head stay as they are."""
    s = Series(detections, ["task_id"], ["frame_index"]).numbered("k")
    s = s.add("n", F.count(F.lit(1)).over(s.group)).add("any", F.count("head_x").over(s.group) > 0)
    for axis in ("head_x", "head_y"):
        s = s.gap_filled(axis, f"{axis}_f", "k")
        own = c(f"{axis}_f")  # three places are added in their order, so that rounding is the same everywhere
        s = s.add(f"{axis}_m", (F.coalesce(F.lag(own).over(s.by), own) + own + F.coalesce(F.lead(own).over(s.by), own)) / SMOOTH_PLACES)
    missing = c("head_x").isNull() & c("any")
    out = s.df.withColumn("confidence", F.when(missing, c("confidence") * INTERPOLATED_SHARE).otherwise(c("confidence")))
    out = out.withColumn("method", F.when(missing, F.lit("interp")).otherwise(c("method")))
    for axis in ("head_x", "head_y"):
        value = F.when(c("n") >= SMOOTH_PLACES, c(f"{axis}_m")).otherwise(c(f"{axis}_f"))
        out = out.withColumn(axis, F.when(c("any"), value))
    return out.select(*detections.columns)


def tracks(tasks: DataFrame, detections: DataFrame, events: DataFrame) -> DataFrame:
    """One row for every task: confidence (median at the key phases, else of all), available, n_found. Nothing fails: without detections it is 0."""
    key = events.where(c("phase").isin(*KEY_PHASES)).select("task_id", "frame_index").distinct().withColumn("key", F.lit(True))
    rows = detections.join(key, ["task_id", "frame_index"], "left")
    whole = rows.groupBy("task_id").agg(
        F.median(F.when(c("key"), c("confidence"))).alias("at_key"), F.median("confidence").alias("of_all"), F.count(F.when(c("method") != "none", 1)).alias("found")
    )
    out = tasks.select("task_id").join(whole, "task_id", "left")
    sure = F.when(c("found") > 0, F.coalesce("at_key", "of_all"))
    out = out.withColumn("confidence", F.coalesce(sure, F.lit(0.0)))
    return out.select("task_id", "confidence", (c("confidence") > 0).alias("available"), F.coalesce("found", F.lit(0)).alias("n_found"))

