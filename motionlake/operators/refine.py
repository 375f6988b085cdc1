"""Refinement of the impact from motion features: peaks, scores and guarded acceptance.

motion_features: task_id, i, motion_raw, centroid_x, centroid_y, shaft_y, ball_x,
ball_y. These come from pixels and are made elsewhere; all below is relational.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..dims import DTL
from ..sources.tables import hashed, sorted_side
from .raster import region_motion
from .segment import folded, intermediates, ordered, reanchored, rounds
from .series import Series, top_k

c = F.col


def search_window(impact: Column, fe: Column, n: Column) -> tuple[Column, Column]:
    """First and last place around an impact that may hold the real one."""
    back = F.greatest(F.lit(1), rounds(fe * C.SEARCH_BACK_SEC))
    ahead = F.greatest(F.lit(1), rounds(fe * C.SEARCH_FORWARD_SEC))
    return F.greatest(F.lit(0), impact - back), F.least(n - 1, impact + ahead)


def refine_frames(rows: DataFrame, swings: DataFrame) -> DataFrame:
    """task_id, frame_index: the frames of the window and the frame before each. rows: task_id, i, frame_index."""
    lo, hi = search_window(F.get("idx", F.lit(5)), c("fe"), c("n"))
    near = swings.where("code is null").select("task_id", F.greatest(F.lit(0), lo - 1).alias("lo"), hi.alias("hi"))
    met = rows.select("task_id", "i", "frame_index").join(hashed(near), "task_id").where(c("i").between(c("lo"), c("hi")))
    return met.select("task_id", "frame_index").distinct()


def reanchor_frames(rows: DataFrame, swings: DataFrame) -> DataFrame:
    """Frames that any impact in the window could lead to. rows are the signals; each try is a swing of its own."""
    lo, hi = search_window(F.get("idx", F.lit(5)), c("fe"), c("n"))
    k = {p: F.get("idx", F.lit(j)) for p, j in (("address", 0), ("top", 3), ("finish", 7))}
    tries = swings.where("code is null").select("task_id", F.explode(F.sequence(lo, hi)).alias("impact"), *[v.alias(p) for p, v in k.items()])
    tries = tries.where((c("impact") > c("top")) & (c("impact") < c("finish")))
    tries = tries.withColumns({f"{p}_est": F.lit(False) for p in ("address", "impact", "finish")})
    each = rows.withColumn("code", F.lit(None).cast("string")).join(tries, "task_id").withColumn("task_id", F.struct("task_id", c("impact").alias("try")))
    found = folded(ordered(intermediates(each))).select(c("task_id.task_id").alias("task_id"), F.explode("at").alias("e"))
    return found.select("task_id", "e.frame_index").distinct()


def motion_signal(features: DataFrame) -> DataFrame:
    """Adds n and motion: smoothed over three places where there are more than three, 0 at the first."""
    s = Series(features, ["task_id"], ["i"]).numbered("k").add("m0", F.when(c("k") == 0, 0.0).otherwise(F.coalesce("motion_raw", F.lit(0.0))))
    s = s.add("n", F.count(F.lit(1)).over(s.group)).moving_average("m0", "m1", 3, "k")
    s = s.add("motion", F.when(c("k") == 0, 0.0).when(c("n") > 3, c("m1")).otherwise(c("m0")))
    return s.add("most", F.max("motion").over(s.group)).df


def candidates(signal: DataFrame) -> DataFrame:
    """At most three places: the strongest peaks, each moved to the raw maximum beside it."""
    peaks = Series(signal, ["task_id"], ["k"]).peaks("motion", c("most") * C.MOTION_MIN_RATIO, "k").where("most > 0")
    best = top_k(peaks, ["task_id"], [c("motion").desc(), c("k")], C.TOP_K)
    at = Series(signal, ["task_id"], ["k"]).recentred(best, "m0", 1, 1, "k").withColumnRenamed("at", "k")
    return at.join(signal, ["task_id", "k"])


def in_window(features: DataFrame, swings: DataFrame) -> DataFrame:
    """The features of each swing's search window; none of a swing that lacks a frame of it."""
    lo, hi = search_window(F.get("idx", F.lit(5)), c("fe"), c("n"))
    own = swings.where("code is null").select("task_id", lo.alias("__lo"), hi.alias("__hi"))
    met = features.join(hashed(own), "task_id").where(c("i").between(c("__lo"), c("__hi")))
    met = met.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("task_id")))
    return met.where(c("__n") == c("__hi") - c("__lo") + 1).drop("__lo", "__hi", "__n")


def scored(rows: DataFrame, shaft_weight: Column) -> DataFrame:
    """Motion share x nearness to the ground x bonus for a ball nearby x bonus for a shaft that ends near the ground.

    Nearness is the centroid's place in the band (columns band_top and band_bottom; without them from 0 to the task's
    lowest centroid). A shaft counts from half a band above the band. Without a centroid the score is 0.
    """
    by = Window.partitionBy("task_id")
    banded = "band_top" in rows.columns
    top = c("band_top") if banded else F.lit(0.0)
    size = c("band_bottom") - c("band_top") if banded else F.max("centroid_y").over(by)
    share = F.least(F.greatest((c("centroid_y") - top) / F.nullif(size, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    ground = F.when(c("centroid_y").isNull(), 0.0).when(size > 0, share).otherwise(1.0 if banded else 0.0)
    ball = F.hypot(c("centroid_x") - c("ball_x"), c("centroid_y") - c("ball_y")) <= C.BALL_REACH_PX
    low = F.coalesce(c("shaft_y") >= top - size / 2, F.lit(True)) if banded else F.lit(True)
    shaft = F.when(c("shaft_y").isNotNull() & low, shaft_weight).otherwise(0.0)
    score = c("motion") / c("most") * ground * F.when(ball, 1.0 + C.BALL_WEIGHT).otherwise(1.0) * (1 + shaft)
    return rows.withColumn("score", score)


def anchored(rows: DataFrame) -> DataFrame:
    """The candidates to choose from: those about the lowest shaft, if the best of them comes near the best of all; else all.

    Sweeps of the club make the strongest motion some frames after contact; the lowest shaft end keeps them out.
    """
    by = Window.partitionBy("task_id")
    low = F.max(F.when(c("shaft_y").isNotNull(), F.struct("shaft_y", (-c("i")).alias("m")))).over(by)
    out = rows.withColumn("__near", F.abs(c("i") + low["m"]) <= C.ANCHOR_WINDOW)
    best_in = F.max(F.when(c("__near"), c("score"))).over(by)
    sure = F.coalesce((F.max("score").over(by) > C.EPS) & (best_in >= C.ANCHOR_MIN_RATIO * F.max("score").over(by)), F.lit(False))
    return out.withColumn("__sure", sure).where(~c("__sure") | c("__near")).withColumn("anchored", c("__sure")).drop("__near", "__sure")


def selected(rows: DataFrame) -> DataFrame:
    """The best per task: score, then a shaft, then the lower and earlier shaft, else the later frame. Scores are compared to nine digits.

    A task whose scores are all 0 has no row.
    """
    has = c("shaft_y").isNotNull()
    key = F.struct(F.round("score", 9).alias("s"), has.alias("h"), F.coalesce("shaft_y", F.lit(0.0)).alias("y"), F.when(has, -c("i")).otherwise(c("i")).alias("l"), c("i"), (c("motion") / c("most")).alias("share"))
    best = rows.groupBy("task_id").agg(F.max(key).alias("b")).where(c("b.s") > C.EPS)
    return best.select("task_id", c("b.i").alias("peak"), c("b.s").alias("score"), c("b.share").alias("confidence"), F.when(c("b.h"), "motion+shaft").otherwise("motion").alias("method"))


def accepted(best: DataFrame, swings: DataFrame) -> DataFrame:
    """task_id, old, new, delta, available, warn: one frame ahead of the peak.

    Rejected, not moved, where that comes too soon after the top for a body or leaves the video, where the peak is
    not 1 to 12 frames from the old impact, or the new place more than 12. A peak that leads back to the old impact is accepted: it confirms it.
    """
    rows = best.join(sorted_side(swings.select("task_id", "idx", "fe", "n")), "task_id")
    old, top = F.get("idx", F.lit(5)), F.get("idx", F.lit(3))
    gap = F.greatest(F.lit(2), rounds(c("fe") * C.MIN_IMPACT_TOP_SEC))
    new = c("peak") + C.IMPACT_OFFSET
    able = (new >= 0) & (new < c("n")) & (new - top >= gap)
    moved = able & F.abs(c("peak") - old).between(C.MIN_SHIFT, C.MAX_SHIFT) & (F.abs(new - old) <= C.MAX_SHIFT)
    out = rows.select("task_id", old.alias("old"), F.when(moved, new).alias("new"))
    return out.withColumn("delta", c("new") - c("old")).withColumn("available", c("new").isNotNull()).withColumn("warn", F.abs(c("delta")) >= C.WARN_SHIFT)


def refined(rows: DataFrame, swings: DataFrame, features: DataFrame, views: DataFrame | None = None) -> DataFrame:
    """swings with the impact where the motion features put it, if they do so credibly. Adds moved, delta and warn.

    rows are the signals; views: task_id, view (front view where a task has none). A shaft counts less in side view.
    A second gate holds the shift within MIN_SHIFT and MAX_SHIFT before phases are found anew.
    """
    found = candidates(motion_signal(in_window(features, swings)))
    found = found.withColumn("view", F.lit(None).cast("string")) if views is None else found.join(sorted_side(views.select("task_id", "view")), "task_id", "left")
    weight = F.when(c("view") == DTL, C.SHAFT_WEIGHT_DTL).otherwise(C.SHAFT_WEIGHT_FACE)
    best = selected(anchored(scored(found, weight)))
    found = accepted(best, swings).where(c("available") & F.abs(c("delta")).between(C.MIN_SHIFT, C.MAX_SHIFT))
    out = reanchored(rows, swings, found).join(sorted_side(found.select("task_id", "delta", "warn")), "task_id", "left")
    return out.withColumns({"delta": F.when(c("moved"), c("delta")).otherwise(0), "warn": c("moved") & F.coalesce("warn", F.lit(False))})


def pixel_features(tiles: DataFrame, regions: DataFrame, balls: DataFrame | None = None, shafts: DataFrame | None = None) -> DataFrame:
    """motion_features out of images: tiles and regions as in raster, frame numbers as places in the swing.

    balls: task_id, ball_x, ball_y; shafts: task_id, frame_index, ax, ay, bx, by (the shaft's segment; its lower end counts).
    The band is the region's extent. The first frame of a task has no motion.
    """
    band = regions.groupBy("task_id").agg(F.min("y").cast("double").alias("band_top"), (F.max("y") + 1).cast("double").alias("band_bottom"))
    frames = tiles.select("task_id", "frame_index").distinct().join(band, "task_id")
    out = frames.join(region_motion(tiles, regions), ["task_id", "frame_index"], "left").fillna(0.0, ["motion_raw"])
    none = F.lit(None).cast("double")
    out = out.join(balls.select("task_id", "ball_x", "ball_y"), "task_id", "left") if balls is not None else out.withColumns({"ball_x": none, "ball_y": none})
    if shafts is None:
        out = out.withColumn("shaft_y", none)
    else:
        low = shafts.groupBy("task_id", "frame_index").agg(F.max(F.greatest("ay", "by")).cast("double").alias("shaft_y"))
        out = out.join(low, ["task_id", "frame_index"], "left")
    return out.withColumnRenamed("frame_index", "i")
