"""Queries over the driver's tables, one per operator, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import geo as G
from .functions import text as T
from .operators import club, joins, metrics, risk, segment
from .operators.series import Series, even_subsample, increasing, top_k
from .operators import refine
from .plans import report, service
from .plans.report import Analysis, quality_gate
from .sources import synth, tables
from .sources.tables import read_table
from .streaming.tasks import task_states
from .swing_sql import metrics_sql, phase_name, risks_sql, swings_sql

c = F.col
USER = ["user_id"]
ORDER = ["ts", "event_id"]
LEVEL, STILL = 100.0, 50.0

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NUMBERED = """e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i,
    count(*) OVER (PARTITION BY user_id) AS n FROM events)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def users(spark: SparkSession, sf_dir: str) -> Series:
    rows = read_table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return Series(rows, USER, ORDER).numbered()


@query(f"""WITH {NUMBERED}, m AS (SELECT *, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM e),
    k AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS v0, first_value(v IGNORE NULLS) OVER a AS v1,
        last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS i0,
        first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS i1 FROM m
        WINDOW b AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
               a AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_id, round(CASE WHEN i0 = i1 THEN v0 ELSE coalesce(v0 + (v1 - v0) * (i - i0) / (i1 - i0), v0, v1, 0) END, 4) AS filled FROM k""")
def q_gap_fill(spark, sf_dir):
    s = users(spark, sf_dir).add("v", F.when(c("event_id") % 7 != 0, c("value"))).gap_filled("v", "f")
    return s.df.select("event_id", F.round("f", 4).alias("filled"))


@query(f"""WITH {NUMBERED}, w AS (SELECT *, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s,
        first_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f,
        last_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM e)
    SELECT event_id, round(CASE WHEN n <= 2 THEN value ELSE (s + greatest(0, 2 - i) * f + greatest(0, i + 2 - n + 1) * l) / 5 END, 4) AS smooth FROM w""")
def q_moving_avg_edge(spark, sf_dir):
    return users(spark, sf_dir).moving_average("value", "m", 5).df.select("event_id", F.round("m", 4).alias("smooth"))


@query("""WITH l AS (SELECT event_id, value, lag(value) OVER w AS p, lead(value) OVER w AS x FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, round(abs(coalesce((x - p) / 1.0, (x - value) / 0.5, (value - p) / 0.5, 0)), 4) AS speed FROM l""")
def q_central_speed(spark, sf_dir):
    return users(spark, sf_dir).central_speed("value", "s", 0.5).df.select("event_id", F.round("s", 4).alias("speed"))


@query("""SELECT event_id, round(coalesce(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)), 0), 4) AS motion FROM events""")
def q_frame_diff(spark, sf_dir):
    return users(spark, sf_dir).difference("value", "d").df.select("event_id", F.round("d", 4).alias("motion"))


@query(f"""WITH {NUMBERED}, b AS (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM e WHERE value < {STILL})
    SELECT user_id, min(i) AS start, max(i) AS stop, count(*) AS length FROM b GROUP BY user_id, g""")
def q_runs_below(spark, sf_dir):
    return users(spark, sf_dir).runs(c("value") < STILL).select("user_id", c("start").cast("long"), c("stop").cast("long"), "length")


def _cross(rising: bool) -> str:
    other, here = ("<", ">=") if rising else (">", "<=")
    return f"""WITH {NUMBERED}, a AS (SELECT *, max((value {other} {LEVEL})::INT) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS armed FROM e)
    SELECT user_id, min(CASE WHEN armed = 1 AND value {here} {LEVEL} THEN i END) AS at FROM a GROUP BY user_id"""


@query(_cross(True))
def q_first_rising(spark, sf_dir):
    return users(spark, sf_dir).first_crossing("value", LEVEL, True).withColumn("at", c("at").cast("long"))


@query(_cross(False))
def q_first_falling(spark, sf_dir):
    return users(spark, sf_dir).first_crossing("value", LEVEL, False).withColumn("at", c("at").cast("long"))


@query(f"""WITH {NUMBERED}, l AS (SELECT user_id, arg_min(i, (value, i)) AS least_at, min(value) AS v FROM e GROUP BY user_id)
    SELECT e.user_id, any_value(least_at) AS least_at, min(CASE WHEN e.i > least_at AND e.value >= v + {LEVEL} THEN e.i END) AS at
    FROM e JOIN l USING (user_id) GROUP BY e.user_id""")
def q_min_then_rise(spark, sf_dir):
    return users(spark, sf_dir).rise_after_least("value", LEVEL).select("user_id", c("least_at").cast("long"), c("at").cast("long"))


@query(f"""WITH {NUMBERED} SELECT user_id, greatest(coalesce(min(CASE WHEN i >= 3 AND NOT value < {LEVEL} THEN i END), count(*)) - 3, 0) AS held FROM e GROUP BY user_id""")
def q_hold_run(spark, sf_dir):
    return users(spark, sf_dir).hold(c("value") < LEVEL, 3).withColumn("held", c("held").cast("long"))


_PEAKS = f"""{NUMBERED}, l AS (SELECT *, lag(value) OVER w AS p, lead(value) OVER w AS x FROM e WINDOW w AS (PARTITION BY user_id ORDER BY i)),
    k AS (SELECT * FROM l WHERE value >= {STILL} AND ((p IS NOT NULL AND x IS NOT NULL AND value >= p AND value > x) OR (p IS NULL AND value > x) OR (x IS NULL AND value > p))),
    t AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, i) <= 3)"""


def _peaks(spark, sf_dir):
    s = users(spark, sf_dir)
    return s, top_k(s.peaks("value", F.lit(STILL)), USER, [c("value").desc(), c("i")], 3)


@query(f"WITH {_PEAKS} SELECT user_id, i, value FROM t")
def q_local_peaks_topk(spark, sf_dir):
    return _peaks(spark, sf_dir)[1].select("user_id", c("i").cast("long"), "value")


@query(f"""WITH {_PEAKS} SELECT DISTINCT t.user_id, arg_max(e.i, (e.value, -e.i)) AS at FROM t JOIN e ON e.user_id = t.user_id AND abs(e.i - t.i) <= 1 AND e.i >= 1 GROUP BY t.user_id, t.i""")
def q_peak_recentre(spark, sf_dir):
    s, best = _peaks(spark, sf_dir)
    return s.recentred(best, "value").withColumn("at", c("at").cast("long"))


@query(f"""WITH {NUMBERED}, r AS (SELECT user_id, i, n, CASE WHEN i = 0 THEN least(greatest(event_id % 30, 0), 39) ELSE event_id % 30 END AS s FROM e WHERE i < 8 AND n >= 8),
    u AS (SELECT *, i + max(s - i) OVER (PARTITION BY user_id ORDER BY i) AS up FROM r), z AS (SELECT *, max(up) OVER (PARTITION BY user_id) AS last FROM u)
    SELECT user_id, i AS k, CASE WHEN last > 39 THEN least(up, 39 - (7 - i)) ELSE up END AS fixed FROM z""")
def q_monotonic_repair(spark, sf_dir):
    s = users(spark, sf_dir)
    s = s.add("n", F.count(F.lit(1)).over(s.group)).df.where("i < 8 AND n >= 8").withColumn("x", c("event_id") % 30)
    return increasing(s, USER, "i", "x", F.lit(40)).select("user_id", c("i").cast("long").alias("k"), c("fixed").cast("long"))


@query("SELECT event_id, user_id FROM events WHERE event_id % 5 = 0")
def q_sample_step(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select(c("user_id").alias("task_id"), c("event_id").alias("frame_index"))
    steps = e.select("task_id").distinct().withColumn("sample_step", F.lit(5))
    return tables.sampled(e, steps).select(c("frame_index").alias("event_id"), c("task_id").alias("user_id"))


@query("""SELECT user_id, round(avg((event_type = 'view')::INT), 6) AS miss_ratio,
    CASE WHEN avg((event_type = 'view')::INT) > 0.5 THEN 'NO_PERSON' WHEN avg((event_type = 'view')::INT) > 0.15 THEN 'LOW_QUALITY'
         WHEN avg(CASE WHEN event_type <> 'view' THEN (value < 50)::INT END) > 0.3 THEN 'LOW_QUALITY' ELSE 'OK' END AS code FROM events GROUP BY user_id""")
def q_quality_gate(spark, sf_dir):
    seen = read_table(spark, sf_dir, "events").select(c("user_id").alias("task_id"), (c("event_type") != "view").alias("detected"), (c("value") / 100).alias("vis"))
    gate = quality_gate(seen)
    return gate.select(c("task_id").alias("user_id"), F.round("miss_ratio", 6).alias("miss_ratio"), F.coalesce("code", F.lit("OK")).alias("code"))


@query("""SELECT user_id, count(*) AS n, max(value) AS peak, round(quantile_cont(value, 0.95) - min(value), 4) AS travel,
    count(*) < 10 OR max(value) < 100 OR quantile_cont(value, 0.95) - min(value) < 50 AS rejected FROM events GROUP BY user_id""")
def q_swing_guard(spark, sf_dir):
    v = c("value")
    travel = segment.wrist_travel(v)
    bad = segment.no_swing(F.lit(1.0), F.count("*"), F.lit(20.0), F.max(v), travel, LEVEL, STILL)
    return read_table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max(v).alias("peak"), F.round(travel, 4).alias("travel"), bad.alias("rejected"))


@query("SELECT l_suppkey, round(median(l_extendedprice), 4) AS scale FROM lineitem GROUP BY l_suppkey")
def q_median_scale(spark, sf_dir):
    return read_table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(segment.body_scale(c("l_extendedprice")), 4).alias("scale"))


@query("""SELECT l_orderkey, max(l_quantity) AS most, arg_max(k, (l_quantity, -k)) AS at FROM (SELECT *, l_partkey * 10 + l_linenumber AS k FROM lineitem) GROUP BY l_orderkey""")
def q_argmax_first(spark, sf_dir):
    rows = Series(read_table(spark, sf_dir, "lineitem").withColumn("k", c("l_partkey") * 10 + c("l_linenumber")), ["l_orderkey"], ["k"])
    return rows.df.groupBy("l_orderkey").agg(F.max("l_quantity").alias("most"), rows.first_max("l_quantity", "k").alias("at"))


@query("""WITH p AS (SELECT user_id, ts AS at, event_id AS last_purchase FROM events WHERE event_type = 'purchase')
    SELECT e.event_id, p.last_purchase FROM events e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.at""")
def q_asof_backward(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    bought = e.where("event_type = 'purchase'").select("user_id", "ts", c("event_id").alias("last_purchase"))
    return joins.asof_backward(e.select("user_id", "ts", "event_id"), bought, USER, "ts", ["last_purchase"]).select("event_id", "last_purchase")


@query("""WITH p AS (SELECT user_id, event_id AS near FROM events WHERE event_type = 'purchase')
    SELECT e.event_id, arg_min(near, (abs(near - e.event_id), near)) AS near FROM events e LEFT JOIN p USING (user_id) GROUP BY e.event_id""")
def q_nearest(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    right = e.where("event_type = 'purchase'").select("user_id", c("event_id").alias("near"))
    return joins.nearest(e.select("user_id", "event_id"), right, USER, "event_id", "near").select("event_id", "near")


@query(f"""WITH {NUMBERED}, p AS (SELECT user_id, i AS centre FROM e WHERE event_type = 'purchase')
    SELECT p.user_id, p.centre, count(*) AS n, round(max(e.value), 4) AS most FROM p JOIN e ON e.user_id = p.user_id AND e.i BETWEEN p.centre - 2 AND p.centre + 5 GROUP BY ALL""")
def q_range_window_join(spark, sf_dir):
    e = users(spark, sf_dir).df
    centre = e.where("event_type = 'purchase'").select("user_id", c("i").cast("long").alias("centre"))
    met = joins.within(centre, e.select("user_id", "i", "value"), USER, c("centre") - 2, c("centre") + 5, "i", 8)
    return met.groupBy("user_id", "centre").agg(F.count("*").alias("n"), F.round(F.max("value"), 4).alias("most"))


_RULES = "('R1','high','>',9000.0),('R2','low','<',0.0),('R3','medium','>=',5000.0),('R4','low','==',0.0)"


@query(f"""WITH r(rule_id, level, op, threshold) AS (VALUES {_RULES}), m AS (
        SELECT c_custkey, rule_id, level, row_number() OVER (PARTITION BY c_custkey ORDER BY CASE level WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, rule_id) AS place
        FROM customer CROSS JOIN r WHERE CASE op WHEN '>' THEN c_acctbal > threshold WHEN '<' THEN c_acctbal < threshold WHEN '>=' THEN c_acctbal >= threshold
            ELSE abs(c_acctbal - threshold) <= 1e-6 END) SELECT * FROM m""")
def q_theta_rules(spark, sf_dir):
    rules = spark.sql(f"""SELECT rule_id, level, 'or' AS logic, array(struct(op, threshold)) AS conditions
        FROM VALUES {_RULES.replace('.0)', '.0D)')} AS t(rule_id, level, op, threshold)""")
    rows = read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").crossJoin(F.broadcast(rules))  # four rows
    met = rows.where(risk.matched(c("c_acctbal")))
    place = F.row_number().over(Window.partitionBy("c_custkey").orderBy(risk.level_order(c("level")), "rule_id"))
    return met.select("c_custkey", "rule_id", "level", place.cast("long").alias("place"))


@query("""SELECT c_custkey, 'with' AS side FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
    UNION ALL SELECT c_custkey, 'without' FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def q_semi_anti(spark, sf_dir):
    who = read_table(spark, sf_dir, "customer").select(c("c_custkey").alias("task_id"), F.lit(0).alias("frame_index"))
    o = read_table(spark, sf_dir, "orders").select(c("o_custkey").alias("task_id"), F.lit(0).alias("frame_index"))
    side = lambda rows, name: rows.select(c("task_id").alias("c_custkey"), F.lit(name).alias("side"))
    return side(tables.targeted(who, o), "with").unionByName(side(tables.absent(who, o), "without"))


_SPEC = "('quantity','l_quantity',10.0,40.0),('discount','l_discount',0.02,0.08),('tax','',0.0,0.05)"


@query(f"""WITH s(key, impl, lo, hi) AS (VALUES {_SPEC}), m AS (SELECT l_returnflag, avg(l_quantity) AS l_quantity, avg(l_discount) AS l_discount, avg(l_tax) AS tax FROM lineitem GROUP BY 1),
    u AS (UNPIVOT m ON l_quantity, l_discount, tax INTO NAME impl_key VALUE v)
    SELECT l_returnflag, key, round(v, 6) AS value, v < lo AS low, v > hi AS high FROM u JOIN s ON u.impl_key = CASE WHEN s.impl = '' THEN s.key ELSE s.impl END""")
def q_spec_dispatch(spark, sf_dir):
    spec = spark.sql(f"SELECT key, coalesce(nullif(impl, ''), key) AS impl_key, lo, hi FROM VALUES {_SPEC} AS t(key, impl, lo, hi)")
    names = {"l_quantity": "l_quantity", "l_discount": "l_discount", "tax": "l_tax"}
    wide = read_table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.struct(*[F.avg(v).alias(k) for k, v in names.items()]).alias("m"))
    long = wide.crossJoin(F.broadcast(spec)).withColumn("v", metrics.dispatched(list(names)))  # 3 rows
    return long.select("l_returnflag", "key", F.round("v", 6).alias("value"), (c("v") < c("lo")).alias("low"), (c("v") > c("hi")).alias("high"))




@query("""SELECT p_partkey, CASE WHEN p_retailprice < 1200 - 300 THEN 'critical_low' WHEN p_retailprice > 1500 + 300 THEN 'critical_high'
    WHEN p_retailprice < 1200 THEN 'low' WHEN p_retailprice > 1500 THEN 'high' ELSE 'normal' END AS status,
    CASE WHEN p_retailprice < 1200 THEN 'low' WHEN p_retailprice > 1500 THEN 'high' ELSE 'normal' END AS three FROM part""")
def q_judge5(spark, sf_dir):
    v, lo, hi = c("p_retailprice"), F.lit(1200.0), F.lit(1500.0)
    return read_table(spark, sf_dir, "part").select("p_partkey", T.judge5(v, lo, hi, F.lit(True)).alias("status"), T.judge3(v, lo, hi).alias("three"))


@query("""SELECT p_partkey, replace(replace('{name} has size {size}, {odd}', '{name}', p_name), '{size}', CAST(p_size AS VARCHAR)) AS text FROM part""")
def q_template_render(spark, sf_dir):
    text = T.rendered(F.lit("{name} has size {size}, {odd}"), {"name": c("p_name"), "size": c("p_size").cast("string")})
    return read_table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))


def _pt(k: int):
    e = lambda j: F.get("embedding", F.lit(j)).cast("double")
    return G.point(e(k), e(k + 1), e(k + 2))


@query("""WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    d AS (SELECT vec_id, e[1]-e[4] AS ux, e[2]-e[5] AS uy, e[3]-e[6] AS uz, e[7]-e[4] AS vx, e[8]-e[5] AS vy, e[9]-e[6] AS vz, e FROM p)
    SELECT vec_id, round(degrees(acos(greatest(-1, least(1, (ux*vx+uy*vy+uz*vz) / (sqrt(ux*ux+uy*uy+uz*uz) * sqrt(vx*vx+vy*vy+vz*vz)))))), 4) AS angle,
        round(-degrees(atan2(vx*uz - vz*ux, vx*ux + vz*uz)), 4) AS turn, round(degrees(atan2(abs(uz), abs(uy))), 4) AS tilt_yz,
        round(-degrees(atan2(ux, -uy)), 4) AS tilt_xy, round(degrees(atan2(e[5]-e[2], abs(e[4]-e[1]))), 4) AS line_tilt,
        round(sqrt(ux*ux + uy*uy) / 2 * 100, 4) AS moved_pct, round(ux / 2 * 100, 4) AS shift_pct,
        round(degrees(acos(least(1, abs(ux*vx+uy*vy+uz*vz) / (sqrt(ux*ux+uy*uy+uz*uz) * sqrt(vx*vx+vy*vy+vz*vz))))), 4) AS lines,
        round(abs((e[7]-e[4])*(e[2]-e[5]) - (e[8]-e[5])*(e[1]-e[4])) / sqrt(vx*vx + vy*vy), 4) AS away FROM d""")
def q_geo_angles(spark, sf_dir):
    a, b, d, two = _pt(0), _pt(3), _pt(6), F.lit(2.0)
    u, v = G.minus(a, b), G.minus(d, b)
    out = {
        "angle": G.angle_3p(a, b, d), "turn": G.rotation_xz(u, v), "tilt_yz": G.tilt_yz(u), "tilt_xy": G.tilt_xy(u), "line_tilt": G.line_tilt(a, b),
        "moved_pct": G.displacement_pct(a, b, two), "shift_pct": G.signed_shift_pct(a, b, two), "lines": G.angle_between_lines(u, v),
        "away": G.point_line_distance(a, b, d),
    }
    return read_table(spark, sf_dir, "embeddings").select("vec_id", *[F.round(x, 4).alias(k) for k, x in out.items()])


@query("""SELECT label, round(0.5 * atan2(2 * covar_pop(e[1]::DOUBLE, e[2]::DOUBLE), var_pop(e[1]::DOUBLE) - var_pop(e[2]::DOUBLE)), 5) AS direction
    FROM (SELECT label, embedding AS e FROM embeddings) GROUP BY label""")
def q_line_fit(spark, sf_dir):
    x, y = (F.get("embedding", F.lit(k)).cast("double") for k in (0, 1))
    return read_table(spark, sf_dir, "embeddings").groupBy("label").agg(F.round(G.line_fit(x, y), 5).alias("direction"))


@query(f"""WITH {NUMBERED}, p(level) AS (VALUES (50.0), (100.0), (150.0)), a AS (SELECT e.*, p.level, max((value < level)::INT) OVER (PARTITION BY user_id, level ORDER BY i
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS armed FROM e CROSS JOIN p)
    SELECT user_id, level::DOUBLE AS level, min(CASE WHEN armed = 1 AND value >= level THEN i END) AS at FROM a GROUP BY ALL""")
def q_threshold_sweep(spark, sf_dir):
    found = users(spark, sf_dir).crossings("value", (50.0, 100.0, 150.0))
    return found.select("user_id", "level", c("at").cast("long").alias("at"))


@query("""WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'), b AS (SELECT DISTINCT user_id FROM events WHERE value > 400)
    SELECT 'union' AS op, user_id FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'except', user_id FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
    UNION ALL SELECT 'intersect', user_id FROM (SELECT * FROM a INTERSECT SELECT * FROM b)""")
def q_union_frames(spark, sf_dir):
    return joins.set_sides(read_table(spark, sf_dir, "events"), USER, c("event_type") == "purchase", c("value") > 400)


@query(f"""WITH {NUMBERED}, k AS (SELECT DISTINCT user_id, n, round_even(j * (n - 1) / 4.0, 0)::BIGINT AS i FROM (SELECT DISTINCT user_id, n FROM e) CROSS JOIN range(5) t(j))
    SELECT e.user_id, e.event_id FROM e LEFT JOIN k USING (user_id, i) WHERE e.n <= 5 OR k.i IS NOT NULL""")
def q_even_subsample(spark, sf_dir):
    return even_subsample(users(spark, sf_dir).df, USER, ORDER, 5).select("user_id", "event_id")


@query("""SELECT o_orderkey, count(*) AS n_items, round(sum(l_quantity), 2) AS quantity, min(l_linenumber) AS first_line FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def q_report_nested(spark, sf_dir):
    """Nested, then read back from the nested rows."""
    told = report.nested(read_table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_quantity"], "items").withColumnRenamed("l_orderkey", "o_orderkey")
    met = read_table(spark, sf_dir, "orders").select("o_orderkey").join(told, "o_orderkey")
    total = F.aggregate("items", F.lit(0.0), lambda s, x: s + x["l_quantity"])
    return met.select("o_orderkey", F.size("items").cast("long").alias("n_items"), F.round(total, 2).alias("quantity"), F.get("items", F.lit(0))["l_linenumber"].alias("first_line"))


@query("""SELECT event_type, count(*) AS n, round(avg((value >= 50)::INT) * 100, 4) AS success_pct, count(CASE WHEN value > 400 THEN 1 END) AS n_high FROM events GROUP BY event_type""")
def q_corpus_success(spark, sf_dir):
    found = service.success_rates(read_table(spark, sf_dir, "events"), "event_type", c("value") >= 50, c("value") > 400)
    return found.withColumn("success_pct", F.round("success_pct", 4))


@query("""WITH l AS (SELECT user_id AS task_id, epoch(ts) AS sec, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'succeed' WHEN 'error' THEN 'fail' ELSE 'progress' END AS kind,
        value / 1000 AS progress FROM events),
    a AS (SELECT *, coalesce(max((kind IN ('succeed', 'fail'))::INT) OVER (PARTITION BY task_id ORDER BY sec, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM l)
    SELECT task_id, CASE arg_max(kind, (sec, seq)) WHEN 'succeed' THEN 'success' WHEN 'fail' THEN 'failed' ELSE 'processing' END AS status,
        round(CASE arg_max(kind, (sec, seq)) WHEN 'succeed' THEN 1 ELSE max(progress) END, 6) AS progress FROM a WHERE ended = 0 GROUP BY task_id""")
def q_task_state(spark, sf_dir):
    kind = F.when(c("event_type") == "purchase", "succeed").when(c("event_type") == "error", "fail").otherwise("progress")
    log = read_table(spark, sf_dir, "events").select(
        c("user_id").alias("task_id"), (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)") / 1e6).alias("at"), c("event_id").alias("seq"), kind.alias("kind"),
        (c("value") / 1000).alias("progress"), F.lit(0).alias("step"),
    )
    return task_states(log).select("task_id", "status", F.round("progress", 6).alias("progress"))


_WIDE = r"'[\x{0}-\x{2E80}]', '', 'g'"
_FITS = f"""CASE WHEN NOT wide THEN least(36, length(x) - s + 1)
    ELSE len(list_filter(range(1, 37), lambda n: n <= length(x) - s + 1 AND 55 * n + 45 * length(regexp_replace(substring(x, s, n), {_WIDE})) <= 2000)) END"""


@query(f"""WITH RECURSIVE t AS (SELECT doc_id, regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g') AS x FROM documents),
    l AS (SELECT *, regexp_replace(x, {_WIDE}) <> '' AS wide FROM t),
    w AS (SELECT *, 1::BIGINT AS s, 0 AS k FROM l UNION ALL SELECT doc_id, x, wide, s + {_FITS}, k + 1 FROM w WHERE s <= length(x))
    SELECT doc_id, max(k)::INT AS n_lines, max(CASE WHEN k = 0 AND x <> '' THEN substring(x, 1, {_FITS}) END) AS first_line FROM w GROUP BY doc_id""")
def q_line_wrap(spark, sf_dir):
    lines = T.wrapped(F.regexp_replace("text", r"\s+", " "), 20.0)
    return read_table(spark, sf_dir, "documents").select("doc_id", F.size(lines).alias("n_lines"), F.get(lines, F.lit(0)).alias("first_line"))


@query("""SELECT p_partkey, round(greatest(0, least(100, (p_retailprice - (1200 - 0.6 * 300)) / (2.2 * 300) * 100)), 4) AS at FROM part""")
def q_range_bar(spark, sf_dir):
    return read_table(spark, sf_dir, "part").select("p_partkey", F.round(T.bar_percent(c("p_retailprice"), F.lit(1200.0), F.lit(1500.0)), 4).alias("at"))


@query("""SELECT user_id, event_id, coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 500 AS below_fold FROM events""")
def q_card_offsets(spark, sf_dir):
    from .plans.report import card_offsets

    rows = users(spark, sf_dir).df
    return card_offsets(rows, USER, "i", "value").select("user_id", "event_id", (c("top") >= 500).alias("below_fold"))


# ---- swings: one per customer, with small tempo changes by key


LATES = tuple(k / 100 for k in range(7))


def swings(spark: SparkSession, sf_dir: str) -> Analysis:
    tasks = read_table(spark, sf_dir, "customer").select(c("c_custkey").alias("task_id"))
    return Analysis(synth.frames(tasks, c("task_id") % len(LATES), LATES), synth.videos(tasks))


@query(swings_sql(LATES, "SELECT task_id, n, round(any_value(s), 6) AS scale, round(max(speed), 4) AS peak, round(max(h), 4) AS highest FROM c JOIN g USING (k) GROUP BY task_id, n"))
def q_swing_signals(spark, sf_dir):
    s = swings(spark, sf_dir).swings
    return s.select("task_id", c("n").cast("long").alias("n"), F.round("S", 6).alias("scale"), F.round("peak_speed", 4).alias("peak"), F.round("highest", 4).alias("highest"))


@query(swings_sql(LATES, f"SELECT task_id, phase_no::INT AS phase_no, {phase_name('phase_no')} AS phase, i::INT AS array_index, i::INT AS frame_index, round(i / {synth.FPS}, 3) AS timestamp, est AS estimated FROM c JOIN ev USING (k)"))
def q_swing_events(spark, sf_dir):
    return swings(spark, sf_dir).events


@query(swings_sql(LATES, "SELECT task_id, phase_no::INT AS phase_no, metric_key, value + 0.0 AS value, status, filled FROM c JOIN me USING (k)", metrics_sql()))
def q_swing_metrics(spark, sf_dir):
    value = (c("value") + 0.0).alias("value")  # no negative zero
    return swings(spark, sf_dir).metrics.select("task_id", "phase_no", "metric_key", value, "status", "filled")


@query(swings_sql(LATES, "SELECT task_id, phase_no::INT AS phase_no, rule_id, level, value, description FROM c JOIN ri USING (k)", metrics_sql() + ", " + risks_sql()))
def q_swing_risks(spark, sf_dir):
    return swings(spark, sf_dir).risks.select("task_id", "phase_no", "rule_id", "level", "value", "description")


@query(swings_sql(LATES, f"""SELECT task_id, round((max(i) FILTER (phase_no = 4) - max(i) FILTER (phase_no = 1)) / greatest(1, max(i) FILTER (phase_no = 6) - max(i) FILTER (phase_no = 4)), 4) AS tempo,
    round((max(i) FILTER (phase_no = 8) - max(i) FILTER (phase_no = 1)) / {synth.FPS}, 4) AS duration FROM c JOIN ev USING (k) GROUP BY task_id"""))
def q_swing_tempo(spark, sf_dir):
    e = swings(spark, sf_dir).events
    at = lambda p, col="array_index": F.max(F.when(c("phase") == p, c(col)))
    rows = e.groupBy("task_id").agg(
        ((at("top") - at("address")) / F.greatest(F.lit(1), at("impact") - at("top"))).alias("tempo"),
        ((at("finish", "frame_index") - at("address", "frame_index")) / synth.FPS).alias("duration"),
    )
    return rows.select("task_id", F.round("tempo", 4).alias("tempo"), F.round("duration", 4).alias("duration"))


@query(swings_sql(LATES, """SELECT task_id, count(*) FILTER (phase_no < 9) AS n_metrics, count(*) FILTER (phase_no = 9) AS n_global, any_value(n_risks) AS n_risks, 8::BIGINT AS n_phases
    FROM c JOIN me USING (k) LEFT JOIN (SELECT k, count(*) AS n_risks FROM ri GROUP BY k) USING (k) GROUP BY task_id""", metrics_sql() + ", " + risks_sql()))
def q_swing_report(spark, sf_dir):
    """The nested JSON report, read back."""
    told = swings(spark, sf_dir).report("https://host")
    r = F.from_json("report", "phases array<struct<phase_no:int,metrics:array<struct<metric_key:string>>>>, global array<struct<metric_key:string>>, risk_count bigint")
    rows = told.select("task_id", r.alias("r"))
    n = F.aggregate("r.phases", F.lit(0), lambda s, p: s + F.size(p["metrics"]))
    return rows.select("task_id", n.cast("long").alias("n_metrics"), F.size("r.global").cast("long").alias("n_global"), c("r.risk_count").alias("n_risks"), F.size("r.phases").cast("long").alias("n_phases"))


@query(swings_sql(LATES, f"""SELECT task_id, x::INT AS frame_index FROM c JOIN ev USING (k) CROSS JOIN range({synth.FRAMES}) r(x)
    WHERE phase_no = 6 AND x BETWEEN i - 3 AND i + 8"""))
def q_swing_refine_frames(spark, sf_dir):
    a = swings(spark, sf_dir)
    return refine.refine_frames(a.rows, a.swings)


# One feature row per place of a swing: two humps of motion, a shaft at some places, a ball for every third task.
_FEATURES = """SELECT c.task_id, x AS i, c.task_id % 2 = 1 AS side,
        greatest(0.0, 10.0 - 3.0 * abs(x - (47 + c.task_id % 9)), 11.0 - 2.5 * abs(x - (53 + c.task_id % 7))) AS raw,
        CASE WHEN c.task_id % 11 <> 3 THEN 700.0 + c.task_id % 5 * 30 + x % 3 * 5 END AS cy,
        CASE WHEN c.task_id % 4 <> 0 AND x IN (47 + c.task_id % 9, 53 + c.task_id % 7) THEN 640.0 + c.task_id % 13 * 10 - x END AS shaft,
        c.task_id % 3 = 0 AND x < 52 AS ball FROM c, range(120) r(x)"""


@query(swings_sql(LATES, f"""SELECT task_id, (CASE WHEN ok THEN new ELSE old END)::INT AS impact, ok AS moved, (CASE WHEN ok THEN new - old ELSE 0 END)::INT AS delta FROM done""", f"""
    p8 AS (SELECT task_id, max(i) FILTER (phase_no = 6) AS old, max(i) FILTER (phase_no = 4) AS top, max(i) FILTER (phase_no = 8) AS finish FROM c JOIN ev USING (k) GROUP BY task_id),
    feat AS ({_FEATURES}),
    win AS (SELECT f.*, p.old, p.top, p.finish, i - (old - 2) AS k0 FROM feat f JOIN p8 p USING (task_id) WHERE i BETWEEN old - 2 AND old + 8),
    m0 AS (SELECT *, CASE WHEN k0 = 0 THEN 0.0 ELSE raw END AS r0 FROM win),
    m1 AS (SELECT *, CASE WHEN k0 = 0 THEN 0.0 ELSE (lag(r0) OVER w + r0 + coalesce(lead(r0) OVER w, r0)) / 3 END AS m FROM m0 WINDOW w AS (PARTITION BY task_id ORDER BY k0)),
    m2 AS (SELECT *, max(m) OVER (PARTITION BY task_id) AS most, lag(m) OVER w AS mp, lead(m) OVER w AS mn, lag(r0) OVER w AS rp, lead(r0) OVER w AS rn FROM m1 WINDOW w AS (PARTITION BY task_id ORDER BY k0)),
    pk AS (SELECT * FROM m2 WHERE most > 0 AND m >= 0.2 * most AND coalesce(m >= mp, true) AND coalesce(m > mn, true) QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY m DESC, k0) <= 3),
    at_ AS (SELECT DISTINCT task_id, CASE WHEN k0 > 1 AND rp >= r0 AND rp >= coalesce(rn, rp) THEN k0 - 1 WHEN rn IS NOT NULL AND rn > r0 AND (k0 <= 1 OR rn > rp) THEN k0 + 1 ELSE k0 END AS k0 FROM pk),
    sc AS (SELECT m2.*, m / most * CASE WHEN cy IS NULL THEN 0.0 ELSE least(1.0, greatest(0.0, (cy - 690) / 164)) END
            * CASE WHEN ball AND cy IS NOT NULL AND sqrt((cy - 760) ** 2 + 100) <= 60 THEN 1.25 ELSE 1.0 END
            * (1 + CASE WHEN shaft >= 690 - 82 THEN CASE WHEN side THEN 0.15 ELSE 0.30 END ELSE 0 END) AS score FROM m2 JOIN at_ USING (task_id, k0)),
    lo_ AS (SELECT task_id, arg_max(i, (shaft, -i)) AS anchor FROM sc WHERE shaft IS NOT NULL GROUP BY task_id),
    nb AS (SELECT sc.*, abs(i - anchor) <= 3 AS near FROM sc LEFT JOIN lo_ USING (task_id)),
    tr AS (SELECT *, max(score) OVER (PARTITION BY task_id) AS best_all, max(CASE WHEN near THEN score END) OVER (PARTITION BY task_id) AS best_in FROM nb),
    sel AS (SELECT * FROM tr WHERE best_all > 1e-9 AND (NOT coalesce(best_in >= 0.7 * best_all, false) OR near)
        QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY round(score, 9) DESC, shaft IS NOT NULL DESC, shaft DESC, CASE WHEN shaft IS NOT NULL THEN i ELSE -i END) = 1),
    done AS (SELECT p8.task_id, old, i - 1 AS new, coalesce(i - 1 - top >= 2 AND abs(i - old) BETWEEN 1 AND 12 AND abs(i - 1 - old) BETWEEN 1 AND 12 AND i - 1 < finish, false) AS ok
        FROM p8 LEFT JOIN (SELECT task_id, i FROM sel) USING (task_id))"""))
def q_swing_refined(spark, sf_dir):
    """Motion features with two humps, shafts, balls and both views; the whole analysis with refinement."""
    a = swings(spark, sf_dir)
    t, i = c("task_id"), c("i")
    hump = lambda high, fall, at: high - fall * F.abs(i - at)
    first, second = 47 + t % 9, 53 + t % 7
    features = a.frames.select(
        "task_id", "i", F.greatest(F.lit(0.0), hump(10.0, 3.0, first), hump(11.0, 2.5, second)).alias("motion_raw"),
        F.lit(10.0).alias("centroid_x"), F.when(t % 11 != 3, 700.0 + t % 5 * 30 + i % 3 * 5).alias("centroid_y"),
        F.when((t % 4 != 0) & ((i == first) | (i == second)), 640.0 + t % 13 * 10 - i).alias("shaft_y"),
        F.when((t % 3 == 0) & (i < 52), 20.0).alias("ball_x"), F.when((t % 3 == 0) & (i < 52), 760.0).alias("ball_y"),
        F.lit(690.0).alias("band_top"), F.lit(854.0).alias("band_bottom"),
    )
    videos = a.videos.withColumn("chosen_view", F.when(t % 2 == 1, "down_the_line").otherwise("face_on"))
    moved = Analysis(a.frames, videos, features).swings
    return moved.select("task_id", F.get("idx", F.lit(5)).alias("impact"), "moved", c("delta").cast("int").alias("delta"))


@query("""WITH u AS (SELECT user_id, max(event_type = 'purchase') AS bought, max(event_type = 'error') AS failed, count(*) AS n FROM events GROUP BY user_id),
    s AS (SELECT user_id, CASE WHEN n % 5 = 0 THEN 'TOO_DARK' WHEN n % 5 = 1 THEN NULL WHEN n % 5 = 2 THEN 'PENDING' WHEN n % 5 = 3 THEN 'WHAT' ELSE 'FILE_TOO_LARGE' END AS code FROM u)
    SELECT user_id, CASE code WHEN 'TOO_DARK' THEN 10004 WHEN 'PENDING' THEN 20002 WHEN 'WHAT' THEN 10004 WHEN 'FILE_TOO_LARGE' THEN 10001 ELSE 0 END::INT AS api_code,
        CASE code WHEN 'TOO_DARK' THEN 400 WHEN 'PENDING' THEN 409 WHEN 'WHAT' THEN 500 WHEN 'FILE_TOO_LARGE' THEN 400 ELSE 200 END::INT AS http FROM s""")
def q_error_codes(spark, sf_dir):
    rows = read_table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    kind = c("n") % 5
    code = F.when(kind == 0, "TOO_DARK").when(kind == 2, "PENDING").when(kind == 3, "WHAT").when(kind == 4, "FILE_TOO_LARGE")
    return service.coded(rows.withColumn("code", code)).select("user_id", "api_code", "http")


@query("""SELECT user_id, no::INT AS no, CASE WHEN n % 6 > 4 OR no < n % 6 THEN 'done' WHEN no = n % 6 THEN 'doing' ELSE 'todo' END AS state
    FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) CROSS JOIN (VALUES (1), (2), (3), (4)) t(no)""")
def q_step_list(spark, sf_dir):
    rows = read_table(spark, sf_dir, "events").groupBy("user_id").agg((F.count("*") % 6).alias("step"))
    states = rows.select(c("user_id").alias("task_id"), F.when(c("step") > 4, "success").otherwise("processing").alias("status"), "step")
    return service.step_list(states).select(c("task_id").alias("user_id"), "no", "state")


@query("""WITH w AS (SELECT user_id, event_type AS text, min((CASE event_type WHEN 'error' THEN 0 ELSE 1 END, event_id)) AS first FROM events GROUP BY ALL)
    SELECT user_id, string_agg(text, ',' ORDER BY first) AS warnings FROM w GROUP BY user_id""")
def q_warnings(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    found = e.select(c("user_id").alias("task_id"), F.when(c("event_type") == "error", 0).otherwise(1).alias("priority"), c("event_id").alias("place"), c("event_type").alias("text"))
    return service.warnings(found).select(c("task_id").alias("user_id"), F.array_join("warnings", ",").alias("warnings"))


def _heads(spark, sf_dir):
    """Detections from events: a head at every third event of a user, at most 28 of each."""
    rows = users(spark, sf_dir).df.where("i < 28")
    seen = c("event_id") % 3 == 0
    return rows.select(
        c("user_id").alias("task_id"), c("i").alias("frame_index"), F.when(seen, c("value")).alias("head_x"), F.when(seen, c("value") * 2).alias("head_y"),
        F.when(seen, 0.8).otherwise(0.2).alias("confidence"), F.when(seen, "hough").otherwise("none").alias("method"),
    )


@query(f"""WITH {NUMBERED}, d AS (SELECT user_id, i, CASE WHEN event_id % 3 = 0 THEN value END AS x, CASE WHEN event_id % 3 = 0 THEN 0.8::DOUBLE ELSE 0.2::DOUBLE END AS conf FROM e WHERE i < 28),
    k AS (SELECT *, last_value(x IGNORE NULLS) OVER b AS x0, last_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER b AS i0, first_value(x IGNORE NULLS) OVER a AS x1,
            first_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER a AS i1, count(*) OVER (PARTITION BY user_id) AS m FROM d
        WINDOW b AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    f AS (SELECT *, CASE WHEN i0 = i1 THEN x0 ELSE coalesce(x0 + (x1 - x0) * (i - i0) / (i1 - i0), x0, x1) END AS y FROM k)
    SELECT user_id, i, CASE WHEN m >= 3 THEN (coalesce(lag(y) OVER w, y) + y + coalesce(lead(y) OVER w, y)) / 3 ELSE y END AS head_x,
        CASE WHEN x IS NULL AND y IS NOT NULL THEN conf / 2 ELSE conf END AS confidence FROM f WINDOW w AS (PARTITION BY user_id ORDER BY i)""")
def q_club_smoothed(spark, sf_dir):
    d = club.smoothed(_heads(spark, sf_dir))
    return d.select(c("task_id").alias("user_id"), c("frame_index").cast("long").alias("i"), "head_x", "confidence")


@query(f"""WITH {NUMBERED}, d AS (SELECT user_id, i, event_type, event_id % 3 = 0 AS seen, CASE WHEN event_id % 3 = 0 THEN 0.8::DOUBLE ELSE 0.2::DOUBLE END AS conf FROM e WHERE i < 28)
    SELECT user_id, CASE WHEN count(*) FILTER (seen) > 0 THEN coalesce(median(conf) FILTER (event_type = 'purchase'), median(conf)) ELSE 0::DOUBLE END AS confidence, count(*) FILTER (seen) AS n_found FROM d GROUP BY user_id""")
def q_club_confidence(spark, sf_dir):
    d = _heads(spark, sf_dir)
    key = users(spark, sf_dir).df.where("event_type = 'purchase'").select(c("user_id").alias("task_id"), c("i").alias("frame_index"), F.lit("top").alias("phase"))
    t = club.tracks(d.select("task_id").distinct(), d, key)
    return t.select(c("task_id").alias("user_id"), "confidence", "n_found")


@query("""WITH p AS (SELECT c_custkey AS id, (c_custkey % 200)::DOUBLE AS h, (c_custkey % 17)::DOUBLE AS w, CASE WHEN c_custkey % 2 = 0 THEN 'face_on' ELSE 'down_the_line' END AS v FROM customer),
    q AS (SELECT id, v, CASE WHEN h * 0.59 >= 10 THEN h * 0.59 END AS a, CASE WHEN w * 2.4 >= 10 THEN w * 2.4 END AS b FROM p)
    SELECT id, round(CASE WHEN v = 'down_the_line' THEN coalesce(a, b) ELSE coalesce(b, a) END, 4) AS club_px FROM q""")
def q_club_length(spark, sf_dir):
    view = F.when(c("c_custkey") % 2 == 0, "face_on").otherwise("down_the_line")
    prior = club.length_prior(view, (c("c_custkey") % 200).cast("double"), (c("c_custkey") % 17).cast("double"))
    return read_table(spark, sf_dir, "customer").select(c("c_custkey").alias("id"), F.round(prior, 4).alias("club_px"))
