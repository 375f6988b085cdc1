"""Geometry on struct columns (x, y, z) and plain columns. NULL where a value is undefined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EPS, ROTATION_SIGN, TARGET_X

AXES = ("x", "y", "z")


def point(x: Column, y: Column, z: Column | None = None) -> Column:
    z = F.lit(0.0) if z is None else z
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def minus(a: Column, b: Column) -> Column:
    return F.struct(*[(a[k] - b[k]).alias(k) for k in AXES])


def midpoint(a: Column, b: Column) -> Column:
    return F.struct(*[((a[k] + b[k]) / 2).alias(k) for k in AXES])


def clamp(v: Column, lo: float, hi: float) -> Column:
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(lo)), F.lit(hi)))


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column) -> Column:
    return norm(minus(a, b))


def angle_between(u: Column, v: Column) -> Column:
    """0-180 degrees."""
    size = norm(u) * norm(v)
    return F.when((norm(u) >= EPS) & (norm(v) >= EPS), F.degrees(F.acos(clamp(dot(u, v) / size, -1.0, 1.0))))


def angle_3p(a: Column, b: Column, c: Column) -> Column:
    return angle_between(minus(a, b), minus(c, b))


def rotation_xz(v: Column, base: Column) -> Column:
    flat = lambda p: F.sqrt(p["x"] * p["x"] + p["z"] * p["z"])
    turn = F.degrees(F.atan2(base["x"] * v["z"] - base["z"] * v["x"], base["x"] * v["x"] + base["z"] * v["z"]))
    return F.when((flat(v) >= EPS) & (flat(base) >= EPS), turn * ROTATION_SIGN)


def tilt_yz(v: Column) -> Column:
    return F.degrees(F.atan2(F.abs(v["z"]), F.abs(v["y"])))


def tilt_xy(v: Column) -> Column:
    return F.degrees(F.atan2(v["x"], -v["y"])) * -TARGET_X


def line_tilt(a: Column, b: Column) -> Column:
    return F.degrees(F.atan2(b["y"] - a["y"], F.abs(b["x"] - a["x"])))


def displacement_pct(a: Column, b: Column, scale: Column) -> Column:
    """Over x and y."""
    return F.when(F.abs(scale) >= EPS, F.hypot(a["x"] - b["x"], a["y"] - b["y"]) / F.abs(scale) * 100)


def signed_shift_pct(a: Column, b: Column, scale: Column) -> Column:
    return F.when(F.abs(scale) >= EPS, (a["x"] - b["x"]) / F.abs(scale) * 100 * TARGET_X)


def line_angle(a: Column, b: Column) -> Column:
    """0-180 degrees from the horizontal; the image's y points down."""
    return F.pmod(F.degrees(F.atan2(-(b["y"] - a["y"]), b["x"] - a["x"])), F.lit(180.0))


def point_line_distance(p: Column, a: Column, b: Column) -> Column:
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    size = F.hypot(dx, dy)
    away = F.abs(dx * (p["y"] - a["y"]) - dy * (p["x"] - a["x"]))
    return F.when(size < EPS, F.hypot(p["x"] - a["x"], p["y"] - a["y"])).otherwise(away / size)


def project_along(origin: Column, v: Column, d: Column) -> Column:
    size = norm(v)
    return F.struct(*[F.when(size < EPS, origin[k]).otherwise(origin[k] + d * v[k] / size).alias(k) for k in AXES])


def angle_between_lines(u: Column, v: Column) -> Column:
    """0-90 degrees."""
    size = norm(u) * norm(v)
    return F.when((norm(u) >= EPS) & (norm(v) >= EPS), F.degrees(F.acos(F.least(F.lit(1.0), F.abs(dot(u, v)) / size))))


def line_fit(x: Column, y: Column) -> Column:
    """Direction of the total least squares line, in radians: an aggregate."""
    return 0.5 * F.atan2(2 * F.covar_pop(x, y), F.var_pop(x) - F.var_pop(y))
