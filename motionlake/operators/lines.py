"""Straight lines in images: votes, peaks, segments, and the measures of one line against the pixels."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo as G
from .raster import SIDE, pixels_of, sampled

# Fixed values.
ANGLES, FIXED_POINT = 180, 1 << 14
SAMPLES, HEAD_SPAN, EDGE_SHARE, BRIGHT_SHARE = 24, 0.15, 0.6, 0.4
FRAME = ["task_id", "frame_index"]
c = F.col


def direction(angle: int) -> tuple[int, int]:
    """Cosine and sine of so many degrees, in whole numbers: offsets of lines are exact wherever they are computed."""
    return round(math.cos(math.radians(angle)) * FIXED_POINT), round(math.sin(math.radians(angle)) * FIXED_POINT)


def votes(tiles: DataFrame, least: int, angles: int = ANGLES) -> DataFrame:
    """task_id, frame_index, angle, offset, votes: how many pixels of `least` or more lie on each line.

    A pixel votes for one offset per angle. A tile spans few offsets, so it counts first and sends a row for each
    line it touches; the second sum is Spark's.
    """
    cos, sin = np.array([direction(a) for a in range(0, 180, 180 // angles)], np.int64).T

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tile, y, x = np.nonzero(pixels_of(b.column(4)) >= least)
            ty, tx = (b.column(k).to_numpy().astype(np.int64) * SIDE for k in (2, 3))
            offset = ((x + tx[tile])[:, None] * cos + (y + ty[tile])[:, None] * sin + FIXED_POINT // 2) // FIXED_POINT
            keys = np.stack([np.repeat(tile, len(cos)), np.tile(np.arange(len(cos)), len(tile)), offset.ravel()])
            (t, a, o), n = np.unique(keys, axis=1, return_counts=True) if keys.size else (keys, np.zeros(0, int))
            of = pa.array(t)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(of), b.column(1).take(of), pa.array((a * (180 // angles)).astype(np.int32)), pa.array(o), pa.array(n.astype(np.int64))], [*FRAME, "angle", "offset", "votes"]
            )

    kind = tiles.schema["task_id"].dataType.simpleString()
    rows = tiles.select(*FRAME, "ty", "tx", "pixels").mapInArrow(counted, f"task_id {kind}, frame_index bigint, angle int, offset bigint, votes bigint")
    return rows.groupBy(*FRAME, "angle", "offset").agg(F.sum("votes").alias("votes"))


def peaks(cells: DataFrame, least: int, reach: int = 1, step: int = 1) -> DataFrame:
    """The cells with `least` votes or more that none within reach on either axis beats; of equal ones the first by angle, then offset.

    The window over offsets holds a cell's own angle; those of the angles beside it come in as rows of their own. Angles
    do not wrap: the line at 179 degrees and that at 0 have offsets of opposite sign.
    """
    strong = cells.where(c("votes") >= least)
    spread = strong.select("*", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("d"))
    spread = spread.select(*FRAME, (c("angle") + c("d") * step).alias("at"), "offset", F.struct("votes", (-c("angle")).alias("a"), (-c("offset")).alias("o")).alias("cell"), (c("d") == 0).alias("own"))
    near = Window.partitionBy(*FRAME, "at").orderBy("offset").rangeBetween(-reach, reach)
    best = spread.withColumn("best", F.max("cell").over(near)).where(c("own") & (c("best") == c("cell")))
    return best.select(*FRAME, c("at").alias("angle"), "offset", c("cell.votes").alias("votes"))


def segments(lines: DataFrame, pieces: DataFrame, most_gap: int, least_length: int) -> DataFrame:
    """task_id, frame_index, angle, offset, votes, ax, ay, bx, by: stretches of set pixels along each line, with gaps up to most_gap.

    pieces: the runs of the frames (components.runs). The pixels of a line are those that voted for it; they are ordered along it.
    """
    turns = [direction(a) for a in range(180)]
    of = lambda k: F.get(F.array(*[F.lit(t[k]) for t in turns]), c("angle"))
    told = lines.withColumns({"cos": of(0), "sin": of(1)})
    met = told.join(pieces, FRAME).select(*lines.columns, "cos", "sin", "y", F.explode(F.sequence(c("x0"), c("x1") - 1)).alias("x"))
    met = met.where(F.floor((c("x") * c("cos") + c("y") * c("sin") + FIXED_POINT // 2) / FIXED_POINT) == c("offset"))
    along = F.when(F.abs("sin") >= F.abs("cos"), c("x")).otherwise(c("y"))
    by = Window.partitionBy(*FRAME, "angle", "offset").orderBy("t", "x", "y")
    rows = met.withColumn("t", along).withColumn("new", F.coalesce(c("t") - F.lag("t").over(by) > most_gap + 1, F.lit(True)).cast("int"))
    rows = rows.withColumn("part", F.sum("new").over(by))
    ends = rows.groupBy(*lines.columns, "part").agg(F.min(F.struct("t", "x", "y")).alias("a"), F.max(F.struct("t", "x", "y")).alias("b"))
    out = ends.select(*lines.columns, c("a.x").alias("ax"), c("a.y").alias("ay"), c("b.x").alias("bx"), c("b.y").alias("by"))
    return out.where(F.hypot(c("ax") - c("bx"), c("ay") - c("by")) >= least_length)


def edge_strength(lines: DataFrame, strength: DataFrame, keys: list[str], n: int = SAMPLES) -> DataFrame:
    """keys, edge: the mean of n samples at even distances along each line (ax, ay, bx, by, ends included), over the frame's strongest pixel.

    Samples meet the tiles they lie in; what leaves a frame counts as 0.
    """
    most = strength.groupBy(*FRAME).agg(F.max(F.array_max("pixels")).alias("most"))
    points = lines.select(*FRAME, *keys, "ax", "ay", "bx", "by", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("__k"))
    at = lambda a, b: c(a) + (c(b) - c(a)) * c("__k") / (n - 1)
    seen = sampled(points, strength, at("ax", "bx"), at("ay", "by"), "v")
    total = seen.groupBy(*FRAME, *keys).agg(F.sum("v").alias("total"))
    return total.join(most, FRAME, "left").select(*FRAME, *keys, (c("total") / n / F.when(c("most") > 0, c("most")).otherwise(1)).alias("edge"))


def axial_heads(lines: DataFrame, gray: DataFrame, strength: DataFrame, keys: list[str]) -> DataFrame:
    """keys, t, head_x, head_y: along each direction, the place near the club's length with the best mix of edge and brightness.

    lines: task_id, frame_index, keys, grip_x, grip_y, dir_x, dir_y, club_px. Places are a step of a 24th of the span (one
    pixel at least) apart; a normal prior holds them to the length; the first of equal places counts. A line without direction has no row.
    """
    most = strength.groupBy(*FRAME).agg(F.max(F.array_max("pixels")).alias("most"))
    span = HEAD_SPAN * c("club_px")
    step = F.greatest(F.lit(1.0), span / 24)
    rows = lines.withColumns({"span": span, "step": step, "size": F.hypot("dir_x", "dir_y")}).where("size > 1e-9 AND club_px > 0")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.floor((2 * c("span") + 1e-9) / c("step")).cast("int"))).alias("__k"))
    rows = rows.withColumn("t", c("club_px") - c("span") + c("__k") * c("step"))
    rows = rows.withColumns({"px": c("grip_x") + c("dir_x") / c("size") * c("t"), "py": c("grip_y") + c("dir_y") / c("size") * c("t")})
    seen = sampled(sampled(rows, gray, c("px"), c("py"), "bright"), strength, c("px"), c("py"), "edge").join(most, FRAME, "left")
    z = (c("t") - c("club_px")) / F.greatest(F.lit(1.0), c("span") * 0.6)
    score = F.exp(-0.5 * z * z) * (EDGE_SHARE * c("edge") / F.when(c("most") > 0, c("most")).otherwise(1) + BRIGHT_SHARE * c("bright") / 255)
    best = seen.withColumn("score", F.round(score, 9)).groupBy(*FRAME, *keys).agg(F.max(F.struct("score", (-c("__k")).alias("k"), "t", "px", "py")).alias("b"))
    return best.select(*FRAME, *keys, c("b.t").alias("t"), c("b.px").alias("head_x"), c("b.py").alias("head_y"))


def line_heads(found: DataFrame, frames: DataFrame, bodies: DataFrame | None = None, grip_share: float = 0.08, most_deg: float = 25.0) -> DataFrame:
    """The best segment of each frame, with far end, direction and confidence.

    found: segments with edge; frames: task_id, frame_index, grip_x, grip_y, club_px, dir_x, dir_y. A segment counts if its
    line passes the grip, its far end lies about the predicted direction and its middle is off the body (bodies: intervals per frame).
    """
    met = found.join(frames, FRAME)
    p, q, grip = G.point(c("ax"), c("ay")), G.point(c("bx"), c("by")), G.point(c("grip_x"), c("grip_y"))
    far = F.when(G.distance(p, grip) >= G.distance(q, grip), p).otherwise(q)
    met = met.withColumns({"length": G.distance(p, q), "off": G.point_line_distance(grip, p, q), "far": far, "mx": F.bround((c("ax") + c("bx")) / 2), "my": F.bround((c("ay") + c("by")) / 2)})
    met = met.withColumn("align", G.angle_between(G.minus(c("far"), grip), G.point(c("dir_x"), c("dir_y"))))
    met = met.where((c("length") >= 1e-9) & (c("off") <= grip_share * c("club_px")) & (c("align") <= most_deg))
    if bodies is not None:
        b = bodies.select(c("task_id").alias("t"), c("frame_index").alias("f"), c("y").alias("b_y"), "x0", "x1")
        met = met.join(b, (c("task_id") == c("t")) & (c("frame_index") == c("f")) & (c("my") == c("b_y")) & (c("mx") >= c("x0")) & (c("mx") < c("x1")), "left_anti")
    share = lambda v: G.clamp(v, 0.0, 1.0)
    size = share(c("length") / F.greatest(F.lit(1.0), c("club_px")))
    align, edge = share(1 - c("align") / max(1.0, most_deg)), share(c("edge"))
    near = share(1 - c("off") / F.greatest(F.lit(1.0), grip_share * c("club_px")))
    met = met.withColumns({"score": size * F.greatest(edge, F.lit(0.05)) * F.greatest(align, F.lit(0.05)), "confidence": share(0.35 * size + 0.30 * align + 0.20 * edge + 0.15 * near)})
    best = Window.partitionBy(*FRAME).orderBy(F.round("score", 9).desc(), "ax", "ay", "bx", "by")
    met = met.withColumn("k", F.row_number().over(best)).where("k = 1")
    return met.select(*FRAME, "ax", "ay", "bx", "by", c("far.x").alias("far_x"), c("far.y").alias("far_y"), (c("far.x") - c("grip_x")).alias("dir_x"), (c("far.y") - c("grip_y")).alias("dir_y"), "confidence")
