"""Connected components of images, as joins of runs.

A line of an image is a few runs of set pixels; runs of neighbouring lines that touch (diagonals count)
are joined, and labels spread along these links: each run takes the least label among its
neighbours, then the label of its label, until none changes. The rows are runs and links, not pixels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo as G
from ..sources.tables import dropped, scratch, sorted_side
from .raster import SIDE, pixels_of

# Fixed values.
BAND, LEAST_AREA, DIFF_SHARE = (0.40, 1.30), 6, 0.85
BALL_RADIUS, BALL_SLACK, BALL_ROUND, BALL_AREA = (5, 25), (0.8, 1.2), 0.7, 12

FRAME = ["task_id", "frame_index"]
SHIFT = 1 << 24  # a run's own label is y * SHIFT + x0
c = F.col


def runs(tiles: DataFrame, least: int) -> DataFrame:
    """task_id, frame_index, y, x0, x1: stretches of pixels of `least` or more, over the borders of tiles."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wide = np.zeros((b.num_rows * SIDE, SIDE + 2), np.int8)
            wide[:, 1:-1] = (pixels_of(b.column(4)) >= least).reshape(-1, SIDE)
            step = np.diff(wide, axis=1)
            (row, x0), (_, x1) = np.nonzero(step == 1), np.nonzero(step == -1)
            tile = row // SIDE
            ty, tx = (b.column(k).to_numpy().astype(np.int64)[tile] * SIDE for k in (2, 3))
            of = pa.array(tile)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(of), b.column(1).take(of), pa.array(ty + row % SIDE), pa.array(tx + x0), pa.array(tx + x1)], [*FRAME, "y", "x0", "x1"]
            )

    kind = tiles.schema["task_id"].dataType.simpleString()
    each = tiles.select(*FRAME, "ty", "tx", "pixels").mapInArrow(found, f"task_id {kind}, frame_index bigint, y bigint, x0 bigint, x1 bigint")
    by = Window.partitionBy(*FRAME, "y").orderBy("x0")
    cut = each.withColumn("new", F.coalesce(c("x0") > F.lag("x1").over(by), F.lit(True)).cast("int"))
    return cut.withColumn("k", F.sum("new").over(by)).groupBy(*FRAME, "y", "k").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("k")


def labelled(pieces: DataFrame) -> DataFrame:
    """Runs with label: the least y * SHIFT + x0 of their component. All its joins grow with the images, so none is a broadcast."""
    own = pieces.withColumn("run", c("y") * SHIFT + c("x0"))
    up = own.select(*FRAME, (c("y") + 1).alias("y"), c("x0").alias("u0"), c("x1").alias("u1"), c("run").alias("other"))
    links = own.join(sorted_side(up), [*FRAME, "y"]).where("x0 <= u1 AND u0 <= x1").select(*FRAME, "run", "other")
    links = scratch(links.unionByName(links.select(*FRAME, c("other").alias("run"), c("run").alias("other"))))
    now = scratch(own.withColumn("label", c("run")))
    while True:
        seen = now.select(*FRAME, c("run").alias("other"), c("label").alias("near"))
        least = links.join(sorted_side(seen), [*FRAME, "other"]).groupBy(*FRAME, "run").agg(F.min("near").alias("near"))
        step = now.join(sorted_side(least), [*FRAME, "run"], "left").withColumn("next", F.least("label", F.coalesce("near", "label")))
        step = scratch(step.drop("near"))
        # a label is a run as well, and that run may know a smaller one
        jump = step.select(*FRAME, c("run").alias("next"), c("next").alias("far"))
        spread = scratch(step.join(sorted_side(jump), [*FRAME, "next"]).withColumn("moved", F.least("next", "far") < c("label")).withColumn("label", F.least("next", "far")).drop("next", "far"))
        done = spread.where("moved").isEmpty()
        dropped(now, step)
        now = spread
        if done:
            dropped(links)
            return now.drop("moved", "run")


def measured(pieces: DataFrame) -> DataFrame:
    """task_id, frame_index, label, area, x, y (centre), x0, y0, x1, y1 (box), roundness (1: a disc), of each component.

    Sums over runs in whole numbers: roundness is area^2 / (2 pi (variance of x + variance of y) area).
    """
    n, a, z = c("x1") - c("x0"), c("x0"), c("x1") - 1
    squares = lambda m: m * (m + 1) * (2 * m + 1) / 6
    sums = pieces.groupBy(*FRAME, "label").agg(
        F.sum(n).alias("area"), F.sum((a + z) * n).alias("twice_x"), F.sum(c("y") * n).alias("sum_y"),
        F.sum((squares(z) - squares(a - 1)).cast("bigint") + c("y") * c("y") * n).alias("sum_2"),
        F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), (F.max("y") + 1).alias("y1"),
    )
    x, y = c("twice_x") / 2 / c("area"), c("sum_y") / c("area")
    out = sums.withColumns({"x": x, "y": y}).withColumn("spread", c("sum_2") - (c("x") * c("x") + c("y") * c("y")) * c("area"))
    # a pixel is a square of its own: a twelfth for each axis
    inner = c("spread") + c("area") / 6
    return out.withColumn("roundness", c("area") * c("area") / (2 * math.pi * inner)).select(*FRAME, "label", "area", "x", "y", "x0", "y0", "x1", "y1", "roundness")


def moved_head(parts: DataFrame, frames: DataFrame) -> DataFrame:
    """frames with head_x, head_y, area and confidence of the largest component in the band about the grip and within the fan.

    frames: task_id, frame_index, grip_x, grip_y, club_px, dir_x, dir_y, fan_deg. Frames without one have no row.
    Ties go to the component that begins first.
    """
    met = parts.join(sorted_side(frames), FRAME)
    to = G.point(c("x") - c("grip_x"), c("y") - c("grip_y"))
    far = G.norm(to)
    met = met.withColumn("align", G.angle_between(to, G.point(c("dir_x"), c("dir_y"))))
    met = met.where((c("area") >= LEAST_AREA) & far.between(BAND[0] * c("club_px"), BAND[1] * c("club_px")) & (c("align") <= c("fan_deg")))
    best = Window.partitionBy(*FRAME).orderBy(c("area").desc(), "label")
    met = met.withColumn("k", F.row_number().over(best)).where("k = 1")
    share = lambda v: G.clamp(v, 0.0, 1.0)
    sure = 0.45 * share(c("area") / F.greatest(F.lit(1.0), c("club_px") * 2)) + 0.55 * share(1 - c("align") / F.greatest(F.lit(1.0), c("fan_deg")))
    return met.select(*FRAME, c("x").alias("head_x"), c("y").alias("head_y"), "area", share(DIFF_SHARE * sure).alias("confidence"))


def balls(parts: DataFrame, radius: tuple[float, float] = BALL_RADIUS, least_area: int = BALL_AREA, least_round: float = BALL_ROUND) -> DataFrame:
    """task_id, frame_index, ball_x, ball_y where exactly one component is round and of a ball's size; else no row."""
    size = F.sqrt(c("area") / math.pi)
    good = parts.where((c("area") >= least_area) & (c("roundness") >= least_round) & size.between(radius[0] * BALL_SLACK[0], radius[1] * BALL_SLACK[1]))
    one = good.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("x"), F.max("y").alias("y")).where("n = 1")
    return one.select(*FRAME, F.bround("x").alias("ball_x"), F.bround("y").alias("ball_y"))


def component_sizes(tiles: DataFrame, least: int) -> DataFrame:
    return measured(labelled(runs(tiles, least)))
