"""Queries over images made of the vectors of `embeddings`, with SQL over single pixels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import components, lines, masks, raster
from .sources.rasters import tiles_from_vectors
from .sources.tables import read_table

c = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FRAME = ["task_id", "frame_index"]
BRIGHT, MOVED = 150, 120
ANGLES = 12

PX = """px AS (SELECT vec_id // 128 AS task_id, vec_id // 16 % 8 AS frame_index, vec_id % 16 // 4 * 8 + i // 8 AS y, vec_id % 4 * 8 + i % 8 AS x,
        floor(abs(embedding[i + 1]::DOUBLE) * 1000)::BIGINT % 256 AS v FROM embeddings, range(64) r(i))"""


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def tiles_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles_from_vectors(read_table(spark, sf_dir, "embeddings"))


def frames_of(tiles: DataFrame) -> DataFrame:
    return tiles.select(*FRAME).distinct()


@query(f"""WITH {PX}, d AS (SELECT a.*, abs(a.v - b.v) AS d FROM px a JOIN px b ON b.task_id = a.task_id AND b.frame_index = a.frame_index - 1 AND b.x = a.x AND b.y = a.y
        WHERE a.y BETWEEN 19 AND 31 AND a.x >= 3 + a.task_id % 5 AND a.x < 29)
    SELECT task_id, frame_index, round(avg(d), 6) AS motion_raw, round(avg(CASE WHEN d > 20 THEN x END), 6) AS centroid_x, round(avg(CASE WHEN d > 20 THEN y END), 6) AS centroid_y
    FROM d GROUP BY ALL""")
def q_pixel_motion(spark, sf_dir):
    tiles = tiles_of(spark, sf_dir)
    region = tiles.select("task_id").distinct().select("task_id", F.explode(F.sequence(F.lit(19), F.lit(31))).alias("y"), (3 + c("task_id") % 5).alias("x0"), F.lit(29).alias("x1"))
    found = raster.region_motion(tiles, region)
    return found.select(*FRAME, *[F.round(k, 6).alias(k) for k in ("motion_raw", "centroid_x", "centroid_y")])


_AROUND = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
_NAME = {(dy, dx): f"p{dy + 1}{dx + 1}" for dy, dx in _AROUND}


def _beside(dy: int, dx: int) -> str:
    """A neighbour's value; beyond the image the nearest one that there is."""
    if dy and dx:
        return f"coalesce({_NAME[dy, dx]}.v, {_NAME[0, dx]}.v, {_NAME[dy, 0]}.v, a.v)"
    return f"coalesce({_NAME[dy, dx]}.v, a.v)"


_SOBEL = f"""{PX}, sobel AS (SELECT a.task_id, a.frame_index, a.y, a.x, a.v,
        abs({_beside(-1, 1)} + 2 * {_beside(0, 1)} + {_beside(1, 1)} - {_beside(-1, -1)} - 2 * {_beside(0, -1)} - {_beside(1, -1)})
        + abs({_beside(1, -1)} + 2 * {_beside(1, 0)} + {_beside(1, 1)} - {_beside(-1, -1)} - 2 * {_beside(-1, 0)} - {_beside(-1, 1)}) AS s FROM px a
        {' '.join(f"LEFT JOIN px {n} ON {n}.task_id = a.task_id AND {n}.frame_index = a.frame_index AND {n}.y = a.y + {dy} AND {n}.x = a.x + {dx}" for (dy, dx), n in _NAME.items())}),
    most AS (SELECT task_id, frame_index, max(s) AS most FROM sobel GROUP BY ALL)"""


@query(f"WITH {_SOBEL} SELECT task_id, frame_index, y, sum(s)::BIGINT AS strength, max(s)::BIGINT AS most FROM sobel GROUP BY ALL")
def q_gradient(spark, sf_dir):
    tiles = raster.gradients(tiles_of(spark, sf_dir))
    rows = tiles.select(*FRAME, "ty", F.posexplode("pixels").alias("i", "s"))
    rows = rows.groupBy(*FRAME, (c("ty") * 8 + F.floor(c("i") / 8)).alias("y"))
    return rows.agg(F.sum(c("s").cast("bigint")).alias("strength"), F.max(c("s").cast("bigint")).alias("most"))


_RING = "(SELECT task_id, frame_index, k, max(v) FILTER (x = 2 * k) % 40 - 4 AS px, max(v) FILTER (x = 2 * k + 1) % 40 - 4 AS py FROM px, range(5) r(k) WHERE y = 0 AND x < 10 GROUP BY ALL)"


@query(f"""WITH {PX}, ring AS {_RING},
    e AS (SELECT a.task_id, a.frame_index, a.px::DOUBLE AS ax, a.py::DOUBLE AS ay, b.px::DOUBLE AS bx, b.py::DOUBLE AS by_
        FROM ring a JOIN ring b ON b.task_id = a.task_id AND b.frame_index = a.frame_index AND b.k = (a.k + 1) % 5),
    g AS (SELECT task_id, frame_index, y, x, count(*) FILTER (ay <> by_ AND y >= least(ay, by_) AND y < greatest(ay, by_) AND ax + (y - ay) * (bx - ax) / (by_ - ay) <= x) AS n
        FROM e, range(-5, 40) yy(y), range(-5, 40) xx(x) GROUP BY ALL)
    SELECT task_id, frame_index, y, count(*) AS cells, min(x) AS first, max(x) AS last FROM g WHERE n % 2 = 1 GROUP BY ALL""")
def q_polygon_mask(spark, sf_dir):
    top = tiles_of(spark, sf_dir).where("ty = 0").withColumn("own", F.slice("pixels", 1, 8))
    line = top.groupBy(*FRAME).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("tx", "own"))), lambda t: t["own"])).alias("v"))
    at = lambda k: F.get("v", k) % 40 - 4
    ring = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.struct(at(2 * k).cast("double").alias("x"), at(2 * k + 1).cast("double").alias("y")))
    rows = line.where(F.size("v") >= 10).select(*FRAME, ring.alias("ring"))
    inside = masks.united(masks.filled(rows, FRAME, c("ring")), FRAME)
    return inside.groupBy(*FRAME, "y").agg(F.sum(c("x1") - c("x0")).alias("cells"), F.min("x0").alias("first"), (F.max("x1") - 1).alias("last"))


def _components(px: str, least: int) -> str:
    """Pixels, and what can be reached from each."""
    return f"""on_ AS (SELECT task_id, frame_index, y, x, y * 1000 + x AS p FROM {px} WHERE v >= {least}),
    links AS (SELECT a.task_id, a.frame_index, a.p, b.p AS q FROM on_ a JOIN on_ b ON b.task_id = a.task_id AND b.frame_index = a.frame_index AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
    reach AS (SELECT task_id, frame_index, p, p AS q FROM on_ UNION SELECT r.task_id, r.frame_index, r.p, l.q FROM reach r JOIN links l ON l.task_id = r.task_id AND l.frame_index = r.frame_index AND l.p = r.q),
    parts AS (SELECT task_id, frame_index, label, count(*) AS area, avg(x) AS x, avg(y) AS y, min(x) AS x0, max(x) + 1 AS x1, min(y) AS y0, max(y) + 1 AS y1,
            count(*) * count(*) / (2 * pi() * (sum(x * x + y * y) - (avg(x) * avg(x) + avg(y) * avg(y)) * count(*) + count(*) / 6)) AS roundness
        FROM (SELECT o.*, l.label FROM on_ o JOIN (SELECT task_id, frame_index, p, min(q) AS label FROM reach GROUP BY ALL) l USING (task_id, frame_index, p)) GROUP BY ALL)"""


_PARTS = f"WITH RECURSIVE {PX}, {_components('px', BRIGHT)}"


@query(f"{_PARTS} SELECT task_id, frame_index, x0, y0, x1, y1, area, round(x, 6) AS x, round(y, 6) AS y, round(roundness, 6) AS roundness FROM parts")
def q_components(spark, sf_dir):
    found = components.component_sizes(tiles_of(spark, sf_dir), BRIGHT)
    return found.select(*FRAME, "x0", "y0", "x1", "y1", "area", *[F.round(k, 6).alias(k) for k in ("x", "y", "roundness")])


_DIFFS = "df AS (SELECT a.task_id, a.frame_index, a.y, a.x, abs(a.v - b.v) AS v FROM px a JOIN px b ON b.task_id = a.task_id AND b.frame_index = a.frame_index - 1 AND b.x = a.x AND b.y = a.y)"


@query(f"""WITH RECURSIVE {PX}, {_DIFFS}, {_components('df', MOVED)},
    near AS (SELECT *, sqrt((x - 16) ** 2 + (y - 14) ** 2) AS far, degrees(acos(greatest(-1, least(1, (y - 14) / sqrt((x - 16) ** 2 + (y - 14) ** 2))))) AS align FROM parts WHERE area >= 6 AND (x <> 16 OR y <> 14)),
    best AS (SELECT * FROM near WHERE far BETWEEN 0.4 * 12 AND 1.3 * 12 AND align <= 60 QUALIFY row_number() OVER (PARTITION BY task_id, frame_index ORDER BY area DESC, label) = 1)
    SELECT task_id, frame_index, round(x, 6) AS head_x, round(y, 6) AS head_y, area, round(0.85 * (0.45 * least(1, area / 24) + 0.55 * (1 - align / 60)), 6) AS confidence FROM best""")
def q_moved_head(spark, sf_dir):
    tiles = tiles_of(spark, sf_dir)
    at = {"grip_x": 16.0, "grip_y": 14.0, "club_px": 12.0, "dir_x": 0.0, "dir_y": 1.0, "fan_deg": 60.0}
    frames = frames_of(tiles).withColumns({k: F.lit(v) for k, v in at.items()})
    found = components.moved_head(components.component_sizes(raster.differences(tiles), MOVED), frames)
    return found.select(*FRAME, "area", *[F.round(k, 6).alias(k) for k in ("head_x", "head_y", "confidence")])


@query(f"""{_PARTS}, good AS (SELECT * FROM parts WHERE area >= 4 AND roundness >= 0.7 AND sqrt(area / pi()) BETWEEN 1 * 0.8 AND 2 * 1.2)
    SELECT task_id, frame_index, round_even(max(x), 0) AS ball_x, round_even(max(y), 0) AS ball_y FROM good GROUP BY ALL HAVING count(*) = 1""")
def q_balls(spark, sf_dir):
    return components.balls(components.component_sizes(tiles_of(spark, sf_dir), BRIGHT), (1, 2), 4, 0.7)


_TURNS = ", ".join(f"({a}, {lines.direction(a)[0]}, {lines.direction(a)[1]})" for a in range(0, 180, 180 // ANGLES))
_VOTES = f"""{PX}, turns(angle, co, si) AS (VALUES {_TURNS}),
    votes AS (SELECT task_id, frame_index, angle, floor((x * co + y * si + 8192) / 16384)::BIGINT AS offset_, count(*) AS votes FROM px, turns WHERE v >= {BRIGHT} GROUP BY ALL)"""


@query(f"WITH {_VOTES} SELECT task_id, frame_index, angle, offset_ AS \"offset\", votes FROM votes")
def q_line_votes(spark, sf_dir):
    return lines.votes(tiles_of(spark, sf_dir), BRIGHT, ANGLES)


_PEAKS = f"""{_VOTES}, peaks AS (SELECT * FROM votes a WHERE votes >= 7 AND NOT EXISTS (SELECT 1 FROM votes b WHERE b.task_id = a.task_id AND b.frame_index = a.frame_index
        AND abs(b.angle - a.angle) <= {180 // ANGLES} AND abs(b.offset_ - a.offset_) <= 1 AND (b.votes, -b.angle, -b.offset_) > (a.votes, -a.angle, -a.offset_)))"""


@query(f"WITH {_PEAKS} SELECT task_id, frame_index, angle, offset_ AS \"offset\", votes FROM peaks")
def q_line_peaks(spark, sf_dir):
    return lines.peaks(lines.votes(tiles_of(spark, sf_dir), BRIGHT, ANGLES), 7, 1, 180 // ANGLES)


@query(f"""WITH {_PEAKS}, on_line AS (SELECT p.*, x, y, CASE WHEN abs(si) >= abs(co) THEN x ELSE y END AS t FROM peaks p JOIN turns USING (angle)
        JOIN px USING (task_id, frame_index) WHERE v >= {BRIGHT} AND floor((x * co + y * si + 8192) / 16384) = offset_),
    cut AS (SELECT *, coalesce(t - lag(t) OVER w > 3, true)::INT AS new_ FROM on_line WINDOW w AS (PARTITION BY task_id, frame_index, angle, offset_ ORDER BY t, x, y)),
    part AS (SELECT *, sum(new_) OVER (PARTITION BY task_id, frame_index, angle, offset_ ORDER BY t, x, y ROWS UNBOUNDED PRECEDING) AS part FROM cut),
    seg AS (SELECT task_id, frame_index, angle, offset_, votes, part, arg_min(x, (t, x, y)) AS ax, arg_min(y, (t, x, y)) AS ay, arg_max(x, (t, x, y)) AS bx, arg_max(y, (t, x, y)) AS by_ FROM part GROUP BY ALL)
    SELECT task_id, frame_index, angle, offset_ AS "offset", votes, ax, ay, bx, by_ AS "by" FROM seg WHERE sqrt((ax - bx) ** 2 + (ay - by_) ** 2) >= 6""")
def q_line_segments(spark, sf_dir):
    tiles = tiles_of(spark, sf_dir)
    found = lines.peaks(lines.votes(tiles, BRIGHT, ANGLES), 7, 1, 180 // ANGLES)
    return lines.segments(found, components.runs(tiles, BRIGHT), 2, 6)


_CLUBS = "SELECT task_id, frame_index, k, 12.0 + k + v % 7 AS gx, 11.0 + v % 5 AS gy, 20.0 + k * 7 - v % 11 AS hx, 29.0 + v % 6 AS hy FROM px, range(3) r(k) WHERE y = 0 AND x = 3"


def clubs_of(tiles: DataFrame) -> DataFrame:
    """Three lines for each frame, placed by one of its pixels."""
    v = F.get("pixels", F.lit(3)).cast("int")
    rows = tiles.where("ty = 0 AND tx = 0").select(*FRAME, v.alias("v"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    return rows.select(*FRAME, "k", (12.0 + c("k") + c("v") % 7).alias("ax"), (11.0 + c("v") % 5).alias("ay"), (20.0 + c("k") * 7 - c("v") % 11).alias("bx"), (29.0 + c("v") % 6).alias("by"))


@query(f"""WITH {_SOBEL}, l AS ({_CLUBS}), s AS (SELECT *, round_even(gx + (hx - gx) * j / 23, 0) AS x, round_even(gy + (hy - gy) * j / 23, 0) AS y FROM l, range(24) q(j))
    SELECT s.task_id, s.frame_index, s.k, round(sum(coalesce(o.s, 0)) / 24 / any_value(CASE WHEN most > 0 THEN most ELSE 1 END), 6) AS edge
    FROM s JOIN most USING (task_id, frame_index) LEFT JOIN sobel o ON o.task_id = s.task_id AND o.frame_index = s.frame_index AND o.x = s.x AND o.y = s.y GROUP BY ALL""")
def q_edge_strength(spark, sf_dir):
    tiles = tiles_of(spark, sf_dir)
    found = lines.edge_strength(clubs_of(tiles), raster.gradients(tiles), ["k"])
    return found.select(*FRAME, "k", F.round("edge", 6).alias("edge"))


@query(f"""WITH {_SOBEL}, l AS (SELECT *, 14.0 AS club, sqrt((hx - gx) ** 2 + (hy - gy) ** 2) AS size FROM ({_CLUBS})),
    s AS (SELECT *, (14.0 - 2.1 + j)::DOUBLE AS t FROM l, range(5) q(j)), p AS (SELECT *, gx + (hx - gx) / size * t AS px_, gy + (hy - gy) / size * t AS py_ FROM s),
    w AS (SELECT p.*, exp(-0.5 * ((t - club) / 1.26) ** 2) * (0.6 * coalesce(o.s, 0) / CASE WHEN most > 0 THEN most ELSE 1 END + 0.4 * coalesce(o.v, 0) / 255) AS score
        FROM p JOIN most USING (task_id, frame_index) LEFT JOIN sobel o ON o.task_id = p.task_id AND o.frame_index = p.frame_index AND o.x = round_even(px_, 0) AND o.y = round_even(py_, 0))
    SELECT task_id, frame_index, k, round(t, 6) AS t, round(px_, 6) AS head_x, round(py_, 6) AS head_y FROM w
    QUALIFY row_number() OVER (PARTITION BY task_id, frame_index, k ORDER BY round(score, 9) DESC, j) = 1""")
def q_axial_head(spark, sf_dir):
    tiles = tiles_of(spark, sf_dir)
    told = clubs_of(tiles).select(*FRAME, "k", c("ax").alias("grip_x"), c("ay").alias("grip_y"), (c("bx") - c("ax")).alias("dir_x"), (c("by") - c("ay")).alias("dir_y"), F.lit(14.0).alias("club_px"))
    found = lines.axial_heads(told, tiles, raster.gradients(tiles), ["k"])
    return found.select(*FRAME, "k", *[F.round(x, 6).alias(x) for x in ("t", "head_x", "head_y")])
