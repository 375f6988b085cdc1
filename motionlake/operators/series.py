"""Operators on keyed, ordered series, as window functions.

Each takes the key columns and the (unique) order columns. All of them share the
partitioning by key, so a chain of them has one exchange and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

First, Last = Window.unboundedPreceding, Window.unboundedFollowing


class Series:
    """A frame with its keys and order; adds columns and returns a Series again."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[str]):
        self.df, self.keys, self.order = df, keys, order
        self.by = Window.partitionBy(*keys).orderBy(*order)
        self.whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(First, Last)
        self.group = Window.partitionBy(*keys)

    def add(self, name: str, column: Column) -> Series:
        return Series(self.df.withColumn(name, column), self.keys, self.order)

    def numbered(self, name: str = "i") -> Series:
        return self.add(name, F.row_number().over(self.by) - 1)

    # ---- filling and smoothing
    def gap_filled(self, value: str, out: str, i: str = "i") -> Series:
        """Linear between known neighbours by place, constant beyond the first and last; all missing gives 0."""
        return self.filled([value], [out], i)

    def filled(self, values: list[str], outs: list[str] | None = None, i: str = "i") -> Series:
        """gap_filled for several columns, in one window over one order."""
        df, parts = self.df, lambda v: [f"__{side}{x}_{v}" for side in "ba" for x in "vi"]
        for v in values:
            known = [v, f"CASE WHEN {v} IS NOT NULL THEN {i} END"]
            df = df.withColumns(dict(zip(parts(v), [self.known(x, side) for side in ("lag", "lead") for x in known])))
        for v, out in zip(values, outs or values):
            v0, i0, v1, i1 = (F.col(k) for k in parts(v))
            between = v0 + (v1 - v0) * (F.col(i) - i0) / (i1 - i0)
            df = df.withColumn(out, F.when(F.col(v).isNotNull(), F.col(v)).otherwise(F.coalesce(between, v0, v1, F.lit(0.0))))
        return Series(df.drop(*[k for v in values for k in parts(v)]), self.keys, self.order)

    def known(self, value: str, side: str) -> Column:
        """The nearest value that is not null before (lag) or after (lead) this row, itself not counted. One pass, for both in one order."""
        return F.expr(f"{side}({value}) IGNORE NULLS OVER (PARTITION BY {', '.join(self.keys)} ORDER BY {', '.join(self.order)})")

    def crossings(self, value: str, levels: tuple[float, ...]) -> DataFrame:
        """keys, level, at: the first place at a level or above after one below it, for all levels in one pass: some earlier value is below a level if the least is."""
        low = self.add("__low", F.min(value).over(self.by.rowsBetween(First, -1))).df
        firsts = [F.min(F.when((F.col("__low") < x) & (F.col(value) >= x), F.col("i"))).alias(f"at_{k}") for k, x in enumerate(levels)]
        pairs = F.array(*[F.struct(F.lit(float(x)).alias("level"), F.col(f"at_{k}").alias("at")) for k, x in enumerate(levels)])
        return low.groupBy(*self.keys).agg(*firsts).select(*self.keys, F.inline(pairs))

    def moving_average(self, value: str, out: str, width: int, i: str = "i") -> Series:
        """Centred, the ends padded with the end values."""
        df = self.df.withColumn("__w", F.lit(width)).withColumn("__n", F.count(F.lit(1)).over(self.group)).withColumn(out, F.col(value))
        done = Series(df, self.keys, self.order).averaged([out], "__w", "__n", i)
        return Series(done.df.drop("__w", "__n"), self.keys, self.order)

    def averaged(self, values: list[str], width: str, n: str, i: str = "i") -> Series:
        """moving_average of several columns in place, with an odd width that may differ from key to key."""
        done = self.scaled(width, i).scaled_averaged(values, width, n, i)
        return Series(done.df.drop("__at"), self.keys, self.order)

    def scaled(self, width: str, i: str = "i") -> Series:
        """Ordered by __at, the place in half widths: one order for averages and all else, so that rows are sorted once."""
        return Series(self.df.withColumn("__at", F.col(i) * F.lit(2.0) / F.col(width)), self.keys, ["__at"])

    def scaled_averaged(self, values: list[str], width: str, n: str, i: str = "i") -> Series:
        """averaged, of a series that is scaled."""
        w, size, place = F.col(width), F.col(n), F.col(i)
        p = F.floor(w / 2).cast("int")
        # |i - j| <= p just where |i - j| * 2 / w <= 1
        around = self.by.rangeBetween(-1, 1)
        ends = lambda f, v: f(v).over(self.whole)
        sums = {f"__s_{v}": F.sum(v).over(around) for v in values}
        edges = {f"__f_{v}": ends(F.first, v) for v in values} | {f"__l_{v}": ends(F.last, v) for v in values}
        df = self.df.withColumns(edges).withColumns(sums)
        for v in values:
            short = F.greatest(F.lit(0), p - place) * F.col(f"__f_{v}")
            long = F.greatest(F.lit(0), place + p - size + 1) * F.col(f"__l_{v}")
            df = df.withColumn(v, F.when((size <= 2) | (w <= 1), F.col(v)).otherwise((F.col(f"__s_{v}") + short + long) / w))
        return Series(df.drop(*sums, *edges), self.keys, self.order)

    def central_speed(self, value: str, out: str, dt: float) -> Series:
        prev, nxt, v = F.lag(value).over(self.by), F.lead(value).over(self.by), F.col(value)
        d = F.coalesce((nxt - prev) / (2 * dt), (nxt - v) / dt, (v - prev) / dt, F.lit(0.0))
        return self.add(out, F.abs(d))

    def difference(self, value: str, out: str) -> Series:
        return self.add(out, F.coalesce(F.abs(F.col(value) - F.lag(value).over(self.by)), F.lit(0.0)))

    # ---- runs and crossings
    def runs(self, condition: Column, i: str = "i") -> DataFrame:
        """keys, start, stop and length of the maximal runs of condition; a null ends a run."""
        marked = self.df.where(condition)
        island = F.col(i) - F.row_number().over(Window.partitionBy(*self.keys).orderBy(i))
        grouped = marked.withColumn("island", island).groupBy(*self.keys, "island")
        return grouped.agg(F.min(i).alias("start"), F.max(i).alias("stop"), F.count("*").alias("length")).drop("island")

    def first_crossing(self, value: str, level: float, rising: bool, i: str = "i") -> DataFrame:
        """keys, at: the first place at or beyond level after a place strictly on its other side."""
        v, before = F.col(value), self.by.rowsBetween(First, -1)
        other, here = (v < level, v >= level) if rising else (v > level, v <= level)
        armed = F.max(other.cast("int")).over(before) == 1
        hit = self.df.withColumn("__hit", here & armed)
        return hit.groupBy(*self.keys).agg(F.min(F.when(F.col("__hit"), F.col(i))).alias("at"))

    def rise_after_least(self, value: str, rise: float, i: str = "i") -> DataFrame:
        """keys, least_at, at: the first place past the least value that is at least rise above it."""
        low = F.min(F.struct(value, i)).over(self.group)
        rows = self.df.withColumn("__low", low)
        hit = (F.col(i) > F.col(f"__low.{i}")) & (F.col(value) >= F.col(f"__low.{value}") + rise)
        return rows.groupBy(*self.keys).agg(F.first(f"__low.{i}").alias("least_at"), F.min(F.when(hit, F.col(i))).alias("at"))

    def hold(self, condition: Column, start: int, i: str = "i") -> DataFrame:
        """keys, held: how many places from start on meet condition without a break."""
        broken = F.min(F.when((F.col(i) >= start) & ~F.coalesce(condition, F.lit(False)), F.col(i)))
        n = F.count(F.lit(1))
        return self.df.groupBy(*self.keys).agg(F.greatest(F.coalesce(broken, n) - start, F.lit(0)).alias("held"))

    # ---- peaks
    def peaks(self, value: str, least: Column, i: str = "i") -> DataFrame:
        """Rows at least `least`, not below the one before, above the one after; ends need only their one side, strictly."""
        prev, nxt, v = F.lag(value).over(self.by), F.lead(value).over(self.by), F.col(value)
        inner = prev.isNotNull() & nxt.isNotNull() & (v >= prev) & (v > nxt)
        ends = (prev.isNull() & (v > nxt)) | (nxt.isNull() & (v > prev))
        return self.df.withColumn("__peak", (v >= least) & (inner | ends)).where("__peak").drop("__peak")

    def recentred(self, chosen: DataFrame, value: str, reach: int = 1, least: int = 1, i: str = "i") -> DataFrame:
        """keys, at: for each chosen place that of the greatest value within reach (first wins), distinct."""
        c = chosen.select(*self.keys, F.col(i).alias("c"))
        near = self.df.join(c, self.keys).where((F.abs(F.col(i) - F.col("c")) <= reach) & (F.col(i) >= least))
        best = near.groupBy(*self.keys, "c").agg(F.max(F.struct(F.col(value), (-F.col(i)).alias("m"))).alias("b"))
        return best.select(*self.keys, (-F.col("b.m")).alias("at")).distinct()

    def first_max(self, value: str, i: str = "i") -> Column:
        return -F.max(F.struct(F.col(value), (-F.col(i)).alias("m")))["m"]

    def running_max(self, value: str, out: str) -> Series:
        return self.add(out, F.max(value).over(self.by.rowsBetween(First, 0)))


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__nth", nth).where(F.col("__nth") <= k).drop("__nth")


def smoothing_width(fps: Column, seconds: float) -> Column:
    """Odd and at least 3."""
    w = F.rint(fps * seconds).cast("int")  # half to even
    w = F.when(w % 2 == 0, w + 1).otherwise(w)
    return F.greatest(w, F.lit(3))


def increasing(rows: DataFrame, keys: list[str], k: str, idx: str, n: Column) -> DataFrame:
    """Repair idx into a strictly increasing sequence below n over the places k = 0, 1, ...; adds fixed, changed.

    Forward, each is raised just above its predecessor; if the last runs over, it is
    set to n - 1 and predecessors are lowered. Both passes in closed form.
    """
    by, place = Window.partitionBy(*keys).orderBy(k), F.col(k)
    start = F.when(place == 0, F.least(F.greatest(F.col(idx), F.lit(0)), n - 1)).otherwise(F.col(idx))
    up = place + F.max(F.col("__s") - place).over(by.rowsBetween(First, 0))
    last = F.last("__up").over(by.rowsBetween(First, Last))
    capped = F.when((last > n - 1), F.least(F.col("__up"), n - 1 - (F.max(place).over(Window.partitionBy(*keys)) - place))).otherwise(F.col("__up"))
    out = rows.withColumn("__s", start).withColumn("__up", up).withColumn("fixed", capped)
    return out.withColumn("changed", F.col("fixed") != F.col("__s")).drop("__s", "__up")


def even_subsample(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """n rows spread evenly over each key's order, the ends included; all of them where there are fewer."""
    by = Window.partitionBy(*keys).orderBy(*order)
    at = rows.withColumn("__k", F.row_number().over(by) - 1).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    if n < 2:
        return at.where(F.col("__k") < n).drop("__k", "__n")
    # row k is taken if some j in 0..n-1 rounds to it
    place = lambda j: F.bround(j * (F.col("__n") - 1) / (n - 1)).cast("long")
    taken = F.exists(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: place(j) == F.col("__k"))
    return at.where((F.col("__n") <= n) | taken).drop("__k", "__n")
