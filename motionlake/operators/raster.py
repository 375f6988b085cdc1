"""Images as rows of square tiles: task_id, frame_index, ty, tx, pixels (SIDE x SIDE small integers, line by line).

A frame is never one value: tiles are dealt out, worked on in Arrow batches, and what they give is
summed over the frame. A region of an image is a table of intervals (see masks): task_id, y, x0, x1, where x1 is not in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIDE = 8
TILES = "task_id bigint, frame_index bigint, ty int, tx int, pixels array<smallint>"
DIFF_LEAST = 20  # fixed value: a pixel has moved if it differs by more

c = F.col


def pixels_of(column: pa.ListArray) -> np.ndarray:
    """n x SIDE x SIDE of a column of tiles without nulls."""
    return column.flatten().to_numpy().reshape(-1, SIDE, SIDE)


def with_previous(tiles: DataFrame) -> DataFrame:
    """The tiles whose frame has one just before it, with the tile of that one as `before`."""
    by = Window.partitionBy("task_id", "ty", "tx").orderBy("frame_index")
    out = tiles.withColumns({"before": F.lag("pixels").over(by), "__last": F.lag("frame_index").over(by)})
    return out.where(c("__last") == c("frame_index") - 1).drop("__last")


def region_tiles(region: DataFrame) -> DataFrame:
    """task_id, ty, tx, parts: the intervals of each tile, a few per line of it."""
    tx = F.explode(F.sequence(F.floor(c("x0") / SIDE), F.floor((c("x1") - 1) / SIDE)))
    each = region.where("x0 < x1").select("task_id", F.floor(c("y") / SIDE).cast("int").alias("ty"), tx.alias("tx"), "y", "x0", "x1").withColumn("tx", c("tx").cast("int"))
    part = F.struct((c("y") % SIDE).cast("int").alias("y"), F.greatest(c("x0") - c("tx") * SIDE, F.lit(0)).cast("int").alias("x0"), F.least(c("x1") - c("tx") * SIDE, F.lit(SIDE)).cast("int").alias("x1"))
    return each.where("y >= 0").groupBy("task_id", "ty", "tx").agg(F.collect_list(part).alias("parts"))


def region_motion(tiles: DataFrame, region: DataFrame, least: int = DIFF_LEAST) -> DataFrame:
    """task_id, frame_index, motion_raw, centroid_x, centroid_y: mean difference to the frame before in the
    task's region, and the middle of what has moved there (null: nothing has). Frames without one before have no row.

    Tiles send five integers each, and these are summed. A region tile that a frame lacks counts for nothing.
    """
    met = with_previous(tiles).join(region_tiles(region), ["task_id", "ty", "tx"])
    met = met.select("task_id", "frame_index", "ty", "tx", "pixels", "before", "parts")
    sums = ["n", "total", "hits", "sum_x", "sum_y"]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line, column = np.mgrid[:SIDE, :SIDE]
        for b in batches:
            now, old = (pixels_of(b.column(k)).astype(np.int64) for k in (4, 5))
            parts = b.column(6)
            flat = parts.flatten()
            of = np.repeat(np.arange(b.num_rows), np.diff(parts.offsets.to_numpy()))
            y, x0, x1 = (flat.field(k).to_numpy() for k in ("y", "x0", "x1"))
            row = (of * SIDE + y) * (SIDE + 1)
            edges = np.bincount(row + x0, minlength=b.num_rows * SIDE * (SIDE + 1)) - np.bincount(row + x1, minlength=b.num_rows * SIDE * (SIDE + 1))
            inside = np.cumsum(edges.reshape(-1, SIDE, SIDE + 1), axis=2)[:, :, :-1] > 0
            diff = np.abs(now - old) * inside
            hit = diff > least
            ty, tx = (b.column(k).to_numpy().astype(np.int64) * SIDE for k in (2, 3))
            hits = hit.sum(axis=(1, 2))
            out = [inside.sum(axis=(1, 2)), diff.sum(axis=(1, 2)), hits, (hit * column).sum(axis=(1, 2)) + tx * hits, (hit * line).sum(axis=(1, 2)) + ty * hits]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, pa.int64()) for x in out)], ["task_id", "frame_index", *sums])

    rows = met.mapInArrow(measured, f"task_id {met.schema['task_id'].dataType.simpleString()}, frame_index bigint, {', '.join(f'{s} bigint' for s in sums)}")
    whole = rows.groupBy("task_id", "frame_index").agg(*[F.sum(s).alias(s) for s in sums])
    mean = lambda a, b: c(a) / F.nullif(c(b), F.lit(0))
    return whole.select("task_id", "frame_index", mean("total", "n").alias("motion_raw"), mean("sum_x", "hits").alias("centroid_x"), mean("sum_y", "hits").alias("centroid_y"))


def differences(tiles: DataFrame) -> DataFrame:
    """Tiles of absolute differences to the frame before."""
    apart = F.zip_with("pixels", "before", lambda a, b: F.abs(a - b).cast("smallint"))
    return with_previous(tiles).withColumn("pixels", apart).drop("before")


def gradients(tiles: DataFrame) -> DataFrame:
    """Tiles of edge strength: |gx| + |gy| of the 3 x 3 Sobel masks, the border pixels of the frame (or of a missing tile) repeated outwards.

    Each tile needs one line or column of its eight neighbours; these are sent to it, so no frame is put together.
    """
    to = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]))
    sent = tiles.select("*", to.alias("to")).select(
        "task_id", "frame_index", (c("ty") + c("to.dy")).cast("int").alias("ty"), (c("tx") + c("to.dx")).cast("int").alias("tx"),
        ((1 - c("to.dy")) * 3 + 1 - c("to.dx")).cast("int").alias("side"), "pixels",
    )
    parts = sent.groupBy("task_id", "frame_index", "ty", "tx").agg(F.collect_list(F.struct("side", "pixels")).alias("parts"))
    parts = parts.where(F.exists("parts", lambda p: p["side"] == 4))

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(4)
            flat = lists.flatten()
            of = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            side, pixels = flat.field("side").to_numpy(), pixels_of(flat.field("pixels")).astype(np.int64)
            wide = np.full((b.num_rows, SIDE + 2, SIDE + 2), -1, np.int64)
            strip = {-1: slice(-1, None), 0: slice(None), 1: slice(0, 1)}  # of the neighbour
            place = {-1: slice(0, 1), 0: slice(1, -1), 1: slice(-1, None)}  # in the wider tile
            for k in range(9):
                dy, dx = k // 3 - 1, k % 3 - 1
                at = np.flatnonzero(side == k)
                wide[of[at], place[dy], place[dx]] = pixels[at][:, strip[dy], strip[dx]]
            for y in (0, SIDE + 1):  # what no neighbour sent repeats the border beside it
                row, own = wide[:, y], wide[:, 1 if y == 0 else SIDE]
                wide[:, y] = np.where(row < 0, own, row)
            for x in (0, SIDE + 1):
                col, own = wide[:, :, x], wide[:, :, 1 if x == 0 else SIDE]
                wide[:, :, x] = np.where(col < 0, own, col)
            gx = sum(w * (wide[:, 2:, :] if dy == 1 else wide[:, :-2, :] if dy == -1 else wide[:, 1:-1, :]) for dy, w in ((-1, 1), (0, 2), (1, 1)))
            gy = sum(w * (wide[:, :, 2:] if dx == 1 else wide[:, :, :-2] if dx == -1 else wide[:, :, 1:-1]) for dx, w in ((-1, 1), (0, 2), (1, 1)))
            strength = np.abs(gx[:, :, 2:] - gx[:, :, :-2]) + np.abs(gy[:, 2:, :] - gy[:, :-2, :])
            values = pa.array(strength.astype(np.int16).ravel())
            out = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * SIDE * SIDE), values)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], out], ["task_id", "frame_index", "ty", "tx", "pixels"])

    kind = parts.schema["task_id"].dataType.simpleString()
    return parts.mapInArrow(filtered, TILES.replace("task_id bigint", f"task_id {kind}"))


def sampled(points: DataFrame, tiles: DataFrame, x: Column, y: Column, out: str) -> DataFrame:
    """points (task_id, frame_index, ...) with the pixel next to (x, y); 0 outside of the image and where x or y is not finite.

    Points meet the tile they lie in, never a table of pixels.
    """
    whole = lambda v: F.when(F.abs(v) < 1e9, F.bround(v).cast("bigint"))
    rows = points.withColumns({"__x": whole(x), "__y": whole(y)})
    at = lambda v: F.floor(c(v) / SIDE).cast("int")
    rows = rows.withColumns({"ty": at("__y"), "tx": at("__x")})
    met = rows.join(tiles.select("task_id", "frame_index", "ty", "tx", "pixels"), ["task_id", "frame_index", "ty", "tx"], "left")
    place = (c("__y") - c("ty") * SIDE) * SIDE + c("__x") - c("tx") * SIDE
    return met.withColumn(out, F.coalesce(F.get("pixels", place.cast("int")).cast("double"), F.lit(0.0))).select(*points.columns, out)
