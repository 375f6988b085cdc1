"""Joins by order: as-of, nearest, range, and greedy one-to-one matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import dropped, scratch


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """left with the values of the last right row of its key at or before it.

    One union, one exchange, one sort: no range join and no pair is formed.
    """
    tagged = right.select(*keys, at, F.lit(0).alias("__side"), F.struct(*values).alias("__v"))
    cols = [c for c in left.columns if c not in (*keys, at)]
    rows = left.select(*keys, at, F.lit(1).alias("__side"), F.struct(*(cols or [F.lit(0).alias("__none")])).alias("__l"))
    both = tagged.unionByName(rows, allowMissingColumns=True)
    upto = Window.partitionBy(*keys).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("__v", F.last("__v", True).over(upto)).where("__side = 1")
    return met.select(*keys, at, *[F.col(f"__l.{c}").alias(c) for c in cols], *[F.col(f"__v.{c}").alias(c) for c in values])


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str) -> DataFrame:
    """left with right_at of the nearest right row of its key; the earlier wins a tie. Same shape as the as-of join."""
    tagged = right.select(*keys, F.col(right_at).alias("__at"), F.lit(0).alias("__side"))
    rows = left.select(*keys, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__l"))
    both = tagged.unionByName(rows, allowMissingColumns=True)
    by = Window.partitionBy(*keys)
    place = F.when(F.col("__side") == 0, F.col("__at"))
    before = F.last(place, True).over(by.orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(place, True).over(by.orderBy("__at", "__side").rowsBetween(0, Window.unboundedFollowing))
    met = both.withColumn("__b", before).withColumn("__a", after).where("__side = 1")
    near = F.when(F.col("__a").isNull() | (F.col("__at") - F.col("__b") <= F.col("__a") - F.col("__at")), F.col("__b"))
    return met.select("__l.*", F.coalesce(near, "__a").alias(right_at))


def within(left: DataFrame, right: DataFrame, keys: list[str], lo: Column, hi: Column, at: str, width: int) -> DataFrame:
    """Range join on keys and buckets of width (about hi - lo): a hot key meets only what lies near."""
    bucket = lambda x: F.floor(x / F.lit(width)).cast("long")
    asked = left.withColumn("__b", F.explode(F.sequence(bucket(lo), bucket(hi))))
    return asked.join(right.withColumn("__b", bucket(F.col(at))), [*keys, "__b"]).where(F.col(at).between(lo, hi)).drop("__b")


def set_sides(rows: DataFrame, keys: list[str], left: Column, right: Column) -> DataFrame:
    """op, keys: which keys are in the union, the difference and the intersection of the rows of two conditions, in one aggregation."""
    sides = rows.groupBy(*keys).agg(F.coalesce(F.bool_or(left), F.lit(False)).alias("__l"), F.coalesce(F.bool_or(right), F.lit(False)).alias("__r"))
    a, b = F.col("__l"), F.col("__r")
    ops = {"union": a | b, "except": a & ~b, "intersect": a & b}
    named = F.filter(F.array(*[F.when(k, F.lit(n)) for n, k in ops.items()]), lambda x: x.isNotNull())
    return sides.select(F.explode(named).alias("op"), *keys)


def greedy_matches(points: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """One-to-one nearest matches of side 'a' with side 'b' (x, y) per key, nearest pair first, then the lower ids.

    points: keys, side, id, x, y. Points meet in square cells as wide as the radius, so only neighbours form pairs. A pair that is the
    first of both its points is taken, its points leave, and so on: the same as one after the other, in few rounds, and no
    key is ever gathered.
    """
    width = max(radius, 1e-9)
    cell = lambda v: F.floor(F.col(v) / width).cast("bigint")
    side = lambda k: points.where(F.col("side") == k).select(*keys, F.col("id").alias(k), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y"))
    left = side("a").withColumns({"__i": cell("ax"), "__j": cell("ay")})
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    right = side("b").withColumn("__d", near).withColumns({"__i": cell("bx") + F.col("__d.i"), "__j": cell("by") + F.col("__d.j")})
    pairs = left.join(right, [*keys, "__i", "__j"]).withColumn("distance", F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")))
    rest = scratch(pairs.where(F.col("distance") <= radius).select(*keys, "a", "b", "distance"))
    order, taken = F.struct("distance", "a", "b"), []
    while not rest.isEmpty():
        first = lambda k: F.min(order).over(Window.partitionBy(*keys, k))
        both = rest.withColumns({"__a": first("a"), "__b": first("b")})
        taken.append(scratch(both.where((F.col("__a") == order) & (F.col("__b") == order)).select(*rest.columns)))
        left_over = rest.join(taken[-1], [*keys, "a"], "left_anti").join(taken[-1], [*keys, "b"], "left_anti")
        before, rest = rest, scratch(left_over)
        dropped(before)
    out = rest
    for t in taken:
        out = out.unionByName(t)
    return out
