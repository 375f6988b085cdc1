"""Regions as intervals: keys, y, x0, x1 (x1 is not in it). A region of n lines is n short rows, whatever its area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C

c = F.col


def filled(polygons: DataFrame, keys: list[str], points: Column) -> DataFrame:
    """keys, y, x0, x1: the pixels inside polygons by the even-odd rule, line by line.

    points: an array of (x, y), closed by itself. Each edge meets the lines between its ends, the lower end
    left out; the crossings of a line, in order, are pairs of entry and exit. A polygon without a line has no row.
    """
    ring = polygons.select(*keys, points.alias("p")).select(*keys, F.posexplode("p").alias("k", "a"), "p")
    ends = ring.select(*keys, "a", F.get("p", (c("k") + 1) % F.size("p")).alias("b")).where("a.y <> b.y")
    low, high = F.least("a.y", "b.y"), F.greatest("a.y", "b.y")
    lines = ends.select("*", F.ceil(low).alias("lo"), (F.ceil(high) - 1).alias("hi")).where("lo <= hi")
    lines = lines.select("*", F.explode(F.sequence("lo", "hi")).alias("y"))
    x = c("a.x") + (c("y") - c("a.y")) * (c("b.x") - c("a.x")) / (c("b.y") - c("a.y"))
    cross = lines.select(*keys, "y", x.alias("x"))
    by = Window.partitionBy(*keys, "y").orderBy("x")
    pairs = cross.withColumns({"n": F.row_number().over(by), "x1": F.lead("x").over(by)}).where("n % 2 = 1 AND x1 IS NOT NULL")
    return pairs.select(*keys, "y", F.ceil("x").alias("x0"), F.ceil("x1").alias("x1")).where("x0 < x1")


def united(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """The same pixels in intervals that do not touch."""
    by = Window.partitionBy(*keys, "y").orderBy("x0", "x1")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    opens = intervals.withColumn("new", (c("x0") > F.coalesce(F.max("x1").over(before), c("x0") - 1)).cast("int"))
    numbered = opens.withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "y", "run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("run")


def dilated(intervals: DataFrame, keys: list[str], radius: Column) -> DataFrame:
    """Grown by a disc."""
    each = intervals.withColumn("r", radius.cast("int")).select(*keys, "y", "x0", "x1", "r", F.explode(F.sequence(-c("r"), c("r"))).alias("dy"))
    wide = F.floor(F.sqrt((c("r") * c("r") - c("dy") * c("dy")).cast("double")))
    return united(each.select(*keys, (c("y") + c("dy")).alias("y"), (c("x0") - wide).alias("x0"), (c("x1") + wide).alias("x1")), keys)


def clipped(intervals: DataFrame, width: Column, height: Column) -> DataFrame:
    out = intervals.withColumns({"x0": F.greatest(c("x0"), F.lit(0)), "x1": F.least(c("x1"), width)})
    return out.where((c("x0") < c("x1")) & (c("y") >= 0) & (c("y") < height))


def thick_line(a: Column, b: Column, width: Column) -> Column:
    """The corners of a line of some width; null where it has no direction or an end is unknown."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    size = F.hypot(dx, dy)
    ox, oy = -dy / size * width / 2, dx / size * width / 2
    corner = lambda p, s: F.struct((p["x"] + s * ox).alias("x"), (p["y"] + s * oy).alias("y"))
    return F.when(size >= C.EPS, F.array(corner(a, 1), corner(b, 1), corner(b, -1), corner(a, -1)))


def body_mask(frames: DataFrame, width: Column, height: Column, thickness: Column | None = None) -> DataFrame:
    """task_id, frame_index, y, x0, x1: torso, limbs and head of a skeleton, grown by the limbs' thickness.

    frames: task_id, frame_index, px (33 points in pixels). Points that are not finite leave out what they bear.
    thickness: 2.2 percent of the image's diagonal, 3 at least, where none is given.
    """
    keys = ["task_id", "frame_index"]
    thick = F.greatest(F.lit(3), F.bround(F.hypot(width.cast("double"), height.cast("double")) * 0.022)) if thickness is None else thickness
    finite = lambda p: (F.abs(p["x"]) < 1e9) & (F.abs(p["y"]) < 1e9)
    whole = F.transform("px", lambda p: F.when(finite(p), F.struct(F.bround(p["x"]).alias("x"), F.bround(p["y"]).alias("y"))))
    rows = frames.select(*keys, whole.alias("px")).withColumn("__t", thick)
    at = lambda k: F.get("px", k if isinstance(k, Column) else F.lit(k))
    torso = rows.select(*keys, "__t", F.array(*[at(k) for k in (C.L_SHOULDER, C.R_SHOULDER, C.R_HIP, C.L_HIP)]).alias("shape")).where(F.forall("shape", lambda p: p.isNotNull()))
    bones = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in C.SKELETON]))
    limbs = rows.select(*keys, "__t", "px", bones.alias("bone")).select(*keys, "__t", at(c("bone.a")).alias("a"), at(c("bone.b")).alias("b"))
    limbs = limbs.select(*keys, "__t", thick_line(c("a"), c("b"), c("__t")).alias("shape")).where("shape IS NOT NULL")
    each = torso.unionByName(limbs).withColumn("part", F.xxhash64("shape"))
    solid = filled(each, [*keys, "part"], c("shape")).drop("part")
    nose = rows.select(*keys, "__t", at(C.NOSE).alias("n")).where("n IS NOT NULL")
    head = dilated(nose.select(*keys, "__t", c("n.y").cast("bigint").alias("y"), c("n.x").cast("bigint").alias("x0"), (c("n.x") + 1).cast("bigint").alias("x1")), [*keys, "__t"], F.greatest(F.lit(2), c("__t")))
    both = united(solid.unionByName(head.drop("__t")), keys)
    grown = dilated(both.join(rows.select(*keys, "__t"), keys), [*keys, "__t"], c("__t")).drop("__t")
    return clipped(grown, width, height)


def ground_region(address: DataFrame) -> DataFrame:
    """task_id, y, x0, x1: the band below the ankles, to the image's lower edge; in front view its middle part.

    address: task_id, view, width, height, body_px, ankle_x, ankle_y (the middle of the ankles, 0 to 1).
    Without a finite ankle, a size or a line below it there is no region.
    """
    w, h = c("width"), c("height")
    top = F.greatest(F.lit(0), F.least(F.bround(c("ankle_y") * h + C.ROI_TOP_MARGIN * c("body_px")).cast("bigint"), h - 1))
    half = F.bround(w * F.when(c("view") == "face_on", C.ROI_FRONT_WIDTH).otherwise(1.0) / 2).cast("bigint")
    middle = F.bround(c("ankle_x") * w).cast("bigint")
    x0, x1 = F.greatest(F.lit(0), middle - half), F.least(w, middle + half)
    rows = address.where((w > 0) & (h > 0) & (F.abs("ankle_x") < 1e9) & (F.abs("ankle_y") < 1e9)).select("task_id", top.alias("top"), h.alias("h"), w.alias("w"), x0.alias("x0"), x1.alias("x1"))
    rows = rows.where("top < h - 1").withColumns({"x0": F.when(c("x0") < c("x1"), c("x0")).otherwise(0), "x1": F.when(c("x0") < c("x1"), c("x1")).otherwise(c("w"))})
    return rows.select("task_id", F.explode(F.sequence(c("top"), c("h") - 1)).alias("y"), c("x0").cast("bigint").alias("x0"), c("x1").cast("bigint").alias("x1"))
