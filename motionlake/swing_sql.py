"""What the queries over swings must give, as SQL written from the definitions: every step is a scan or a scalar subquery
over the frames of a swing. The swings are those of sources.synth, one per customer.
"""

from __future__ import annotations

from . import config as C
from .dims import BRANCHES, DROPPABLE, FACE, LEVELS, NOT_CRITICAL, PHASES, RULES, SPECS
from .sources import synth

FE = synth.FPS


def frames_of(seconds: float, least: int) -> int:
    return max(least, round(FE * seconds))


def _eased(keys: list[tuple]) -> str:
    at = [str(t) if t == synth.ADDRESS else f"({t} + late)" for t, _ in keys]
    out = f"CASE WHEN ts <= {at[0]} THEN {float(keys[0][1])}"
    for (_, v0), (_, v1), a, b in zip(keys, keys[1:], at, at[1:]):
        u = f"((ts - {a}) / greatest({b} - {a}, 1e-9))"
        out += f" WHEN ts <= {b} THEN {float(v0)} + {float(v1 - v0)} * {u} * {u} * (3 - 2 * {u})"
    return f"{out} ELSE {float(keys[-1][1])} END"


def _joint(name: str, a: str, b: str, angle: str) -> str:
    d = {k: f"({b}.{k} - {a}.{k})" for k in "xyz"}
    chord = f"sqrt({d['x']} ** 2 + {d['y']} ** 2 + {d['z']} ** 2)"
    side = f"sqrt({d['z']} ** 2 + {d['x']} ** 2)"
    share = f"(CASE WHEN {side} > 1e-9 THEN {chord} / 2 * tan(radians((180 - {angle}) / 2)) / {side} ELSE 0 END)"
    return f"""{{'x': ({a}.x + {b}.x) / 2 - {d['z']} * {share}, 'y': ({a}.y + {b}.y) / 2, 'z': ({a}.z + {b}.z) / 2 + {d['x']} * {share}}} AS {name}"""


def frames_sql(lates: tuple[float, ...]) -> str:
    """f: k (the swing's number), i, ts, shift and the points p<number>."""
    point = lambda name, x, y, z: f"{{'x': ({x})::DOUBLE, 'y': ({y})::DOUBLE, 'z': ({z})::DOUBLE}} AS {name}"
    keys = ", ".join(f"{_eased(v)} AS {k}" for k, v in synth.KEYS.items())
    return f"""
    t AS (SELECT k, late, i, i / {synth.FPS} AS ts FROM (VALUES {', '.join(f'({k}, {x}::DOUBLE)' for k, x in enumerate(lates))}) l(k, late) CROSS JOIN range({synth.FRAMES}) r(i)),
    e AS (SELECT k, i, ts, {keys} FROM t),
    v AS (SELECT *, cos(radians(shoulder)) * 0.2 AS vx, sin(radians(shoulder)) * 0.2 AS vz, cos(radians(hip)) * 0.15 AS hx, sin(radians(hip)) * 0.15 AS hz FROM e),
    b AS (SELECT k, i, ts, shift, lead, trail, {point('p11', 'spine_x + vx', '-0.55', 'spine_z + vz')}, {point('p12', 'spine_x - vx', '-0.55', 'spine_z - vz')},
        {point('p0', 'spine_x', '-0.83', 'spine_z - 0.06')}, {point('p15', 'hand_x + 0.03 * vx / sqrt(vx ** 2 + vz ** 2)', 'hand_y', 'hand_z + 0.03 * vz / sqrt(vx ** 2 + vz ** 2)')},
        {point('p16', 'hand_x - 0.03 * vx / sqrt(vx ** 2 + vz ** 2)', 'hand_y', 'hand_z - 0.03 * vz / sqrt(vx ** 2 + vz ** 2)')},
        {point('p23', 'hx', '0', 'hz')}, {point('p24', '-hx', '0', '-hz')}, {point('p27', '0.22', '0.92', '0')}, {point('p28', '-0.22', '0.92', '0')} FROM v),
    f AS (SELECT *, {_joint('p13', 'p11', 'p15', 'lead')}, {_joint('p14', 'p12', 'p16', 'trail')}, {_joint('p25', 'p23', 'p27', '168')}, {_joint('p26', 'p24', 'p28', '168')} FROM b)"""


def norm(p: str, axis: str) -> str:
    return f"(0.5 + ({p}.x + shift) / 2.0)" if axis == "x" else f"(0.55 + {p}.y / 2.6)"


def signals_sql() -> str:
    """g: k, i, n, s (scale), h, speed, wy, sy."""
    r = f"({synth.HEIGHT} / {synth.WIDTH})"
    mean = lambda v: f"(coalesce(lag({v}) OVER w, {v}) + {v} + coalesce(lead({v}) OVER w, {v})) / 3"
    return f"""
    raw AS (SELECT k, i, ts, {norm('p15', 'x')} AS wx, {norm('p15', 'y')} * {r} AS wy, ({norm('p11', 'y')} + {norm('p12', 'y')}) / 2 * {r} AS sy, ({norm('p23', 'y')} + {norm('p24', 'y')}) / 2 * {r} AS hy,
        sqrt(({norm('p11', 'x')} - {norm('p12', 'x')}) ** 2 + (({norm('p11', 'y')} - {norm('p12', 'y')}) * {r}) ** 2) AS sw FROM f),
    m AS (SELECT k, i, ts, {mean('wx')} AS wx, {mean('wy')} AS wy, {mean('sy')} AS sy, {mean('hy')} AS hy, median(sw) OVER (PARTITION BY k) AS s, count(*) OVER (PARTITION BY k) AS n
        FROM raw WINDOW w AS (PARTITION BY k ORDER BY i)),
    q AS (SELECT *, (hy - wy) / s AS h, sqrt((coalesce(lead(wx) OVER w, wx) - coalesce(lag(wx) OVER w, wx)) ** 2 + (coalesce(lead(wy) OVER w, wy) - coalesce(lag(wy) OVER w, wy)) ** 2)
        / ((coalesce(lead(i) OVER w, i) - coalesce(lag(i) OVER w, i)) / {FE}) / s AS v FROM m WINDOW w AS (PARTITION BY k ORDER BY i)),
    g AS (SELECT *, {mean('v')} AS speed FROM q WINDOW w AS (PARTITION BY k ORDER BY i))"""


def events_sql() -> str:
    """ev: k, phase_no, i, est; good: the swings that pass the guards."""
    pick = lambda what, lo, hi, cond="true": f"(SELECT {what} FROM g WHERE g.k = z.k AND i BETWEEN {lo} AND {hi} AND {cond})"
    most, least = (lambda v: f"arg_max(i, ({v}, -i))"), (lambda v: f"arg_min(i, ({v}, i))")
    run = lambda place, step, size: (  # noqa: E731  whether size places from here on, or up to here, are all still
        f"(SELECT count(*) FROM g y WHERE y.k = g.k AND y.speed < {C.V_STILL} AND y.i BETWEEN {place} AND {step}) = {size}"
    )
    ratio = lambda a, b, r: f"round_even({a} + ({b} - {a}) * {r}, 0)::INT"
    top_gap, need, rest, gap = frames_of(C.MIN_TOP_ADDRESS_SEC, 2), frames_of(C.STILL_SEC_ADDRESS, 2), frames_of(C.STILL_SEC_FINISH, 2), frames_of(C.MIN_IMPACT_TOP_SEC, 2)
    span = max(gap + 1, round(FE * C.MAX_DOWNSWING_SEC))
    reach, win = frames_of(C.TOP_REFINE_SEC, 1), frames_of(C.IMPACT_WIN_SEC, 1)
    r2, r3, r5, r7 = C.FALLBACK_RATIOS
    ends = f"h <= {C.ADDRESS_H_MAX} AND {run(f'g.i - {need} + 1', 'g.i', need)} AND (i = z.top - 1 OR NOT EXISTS (SELECT 1 FROM g y WHERE y.k = g.k AND y.i = g.i + 1 AND y.speed < {C.V_STILL}))"
    steps = [
        ("z0", "g_", f"""k, count(*)::INT AS n, greatest(0, least(round_even(count(*) * {C.TOP_MARGIN}, 0)::INT, count(*)::INT - 1)) AS lo, arg_max(i, (speed, -i)) AS peak,
            any_value(s) >= {C.MIN_SCALE} AND count(*) >= greatest(10, round_even({FE} * 0.5, 0)) AND max(speed) >= {C.V_PEAK_MIN} AND quantile_cont(wy, 0.95) - min(wy) >= {C.MIN_WRIST_TRAVEL} * any_value(s) AS ok"""),
        ("z1", "z0", f"*, greatest(lo + 1, least(round_even(n * {1 - C.TOP_MARGIN}, 0)::INT, n)) AS hi0"),
        ("z2", "z1", f"*, CASE WHEN peak - lo >= {top_gap} THEN greatest(lo + 1, least(hi0, peak)) ELSE hi0 END AS hi"),
        ("z3", "z2", f"*, {pick(most('h'), 'z.lo', 'z.hi - 1')} AS high"),
        ("z4", "z3", f"*, coalesce({pick(least('speed'), f'greatest(z.lo, z.high - {reach})', f'least(z.hi, z.high + {reach} + 1) - 1')}, high) AS top"),
        ("z5", "z4", f"*, {pick('max(i)', need - 1, 'z.top - 1', ends)} AS found1, {pick(least('speed'), 0, 'z.top - 1')} AS rest1"),
        ("z6", "z5", "*, coalesce(found1, rest1) AS address, found1 IS NULL AS address_est"),
        ("z7", "z6", f"*, {pick('max(h)', 'z.address', 'z.address')} AS h0, greatest(least(n, top + 1 + {span}), least(n, top + 2)) AS hi2"),
        ("z8", "z7", f"*, {pick('min(i)', 'z.top + 1', 'z.hi2 - 1', f'h <= z.h0 + {C.IMPACT_H_TOL}')} AS crossing"),
        ("z9", "z8", f"""*, CASE WHEN crossing IS NULL THEN {pick(most('speed'), 'z.top + 1', 'z.hi2 - 1')}
            ELSE {pick(most('speed'), f'greatest(z.top + 1, z.crossing - {win})', f'least(z.hi2, z.crossing + {win} + 1) - 1')} END AS impact"""),
        ("z10", "z9", f"*, {pick('min(i)', 'z.impact + 1', f'z.n - {rest}', run('g.i', f'g.i + {rest} - 1', rest))} AS found2, {pick(least('speed'), 'z.impact + 1', 'z.n - 1')} AS rest2"),
        ("z11", "z10", f"*, coalesce(found2, CASE WHEN n - 1 - impact >= {round(FE * C.FINISH_FALLBACK_SEC)} AND impact < n - 1 THEN rest2 ELSE n - 1 END) AS finish"),
        ("z12", "z11", f"""*, CASE WHEN top > address THEN {pick('min(i)', 'z.address', 'z.top', f'h < {C.H_HIP}')} END AS low,
            {pick('min(i)', 'z.top', 'z.impact', f'h > {C.H_DOWNSWING}')} AS raised, {pick(least('h'), 'z.impact', 'z.finish')} AS least_at"""),
        ("z13", "z12", f"*, {pick('min(i)', 'z.low + 1', 'z.top', f'h >= {C.H_HIP}')} AS f2, {pick('max(h)', 'z.least_at', 'z.least_at')} AS h1"),
        ("z14", "z13", f"*, coalesce(f2, {ratio('address', 'top', r2)}) AS takeaway"),
        ("z15", "z14", f"""*, CASE WHEN top > takeaway THEN {pick('min(i)', 'z.takeaway', 'z.top', 'wy <= sy')} END AS f3, {pick('min(i)', 'z.raised + 1', 'z.impact', f'h <= {C.H_DOWNSWING}')} AS f5,
            {pick('min(i)', 'z.least_at + 1', 'z.finish', f'h >= z.h1 + {C.FOLLOW_RISE}')} AS f7"""),
        ("z16", "z15", f"""*, coalesce(f3, {ratio('address', 'top', r3)}) AS backswing, CASE WHEN f5 < impact THEN f5 ELSE {ratio('top', 'impact', r5)} END AS downswing,
            CASE WHEN f7 > impact AND f7 < finish THEN f7 ELSE {ratio('impact', 'finish', r7)} END AS follow_through"""),
    ]
    out = "g_ AS (SELECT * FROM g), " + ", ".join(f"{name} AS (SELECT {what} FROM {of} z{' GROUP BY k' if of == 'g_' else ''})" for name, of, what in steps)
    raws = ", ".join(PHASES)
    ests = "address_est, f2 IS NULL, f3 IS NULL, false, NOT coalesce(f5 < impact, false), crossing IS NULL, NOT coalesce(f7 > impact AND f7 < finish, false), found2 IS NULL"
    return f"""{out},
    good AS (SELECT * FROM z16 WHERE ok AND top > 0 AND top - address >= {frames_of(C.MIN_TOP_ADDRESS_SEC, 3)} AND impact - top >= {gap}),
    ro AS (SELECT k, n, unnest([{raws}]) AS r, unnest([{ests}]) AS e, unnest(range(8)) AS j FROM good),
    up AS (SELECT *, max(CASE WHEN j = 0 THEN least(greatest(r, 0), n - 1) ELSE r - j END) OVER (PARTITION BY k ORDER BY j) + j AS u FROM ro),
    ev AS (SELECT k, j + 1 AS phase_no, x AS i, e OR x <> r AS est FROM (
        SELECT *, CASE WHEN max(u) OVER (PARTITION BY k) > n - 1 THEN least(u, n - 8 + j) ELSE u END AS x FROM up))"""


def swings_sql(lates: tuple[float, ...], select: str, more: str = "") -> str:
    of = f"c AS (SELECT c_custkey AS task_id, c_custkey % {len(lates)} AS k FROM customer)"
    return f"WITH {frames_sql(lates)}, {signals_sql()}, {events_sql()}, {of}{', ' + more if more else ''} {select}"


def phase_name(column: str) -> str:
    return f"([{', '.join(repr(p) for p in PHASES)}])[{column}]"


def metrics_sql() -> str:
    """me: k, phase_no, metric_key, value, status, filled, and what rules need."""
    diff = lambda a, b: {x: f"({a}.{x} - {b}.{x})" for x in "xyz"}
    mid = lambda a, b: {x: f"(({a}.{x} + {b}.{x}) / 2)" for x in "xyz"}
    size = lambda v: f"sqrt({v['x']} ** 2 + {v['y']} ** 2 + {v['z']} ** 2)"

    def angle(a: str, b: str, c: str) -> str:
        u, v = diff(a, b), diff(c, b)
        dot = " + ".join(f"{u[x]} * {v[x]}" for x in "xyz")
        return f"degrees(acos(greatest(-1, least(1, ({dot}) / ({size(u)} * {size(v)})))))"

    def turn(left: str, right: str) -> str:
        v, b = diff(left, right), diff(f"a_{left}", f"a_{right}")
        return f"({C.ROTATION_SIGN} * degrees(atan2({b['x']} * {v['z']} - {b['z']} * {v['x']}, {b['x']} * {v['x']} + {b['z']} * {v['z']})))"

    s = {x: f"({mid('p11', 'p12')[x]} - {mid('p23', 'p24')[x]})" for x in "xyz"}
    tilt_xy = f"({-C.TARGET_X} * degrees(atan2({s['x']}, -{s['y']})))"
    forward = f"degrees(atan2(abs({s['z']}), abs({s['y']})))"
    px = lambda p, of="": {"x": f"((0.5 + ({of}{p}.x + {of}shift) / 2.0) * {synth.WIDTH})", "y": f"((0.55 + {of}{p}.y / 2.6) * {synth.HEIGHT})"}
    moved = f"sqrt(({px('p0')['x']} - {px('p0', 'a_')['x']}) ** 2 + ({px('p0')['y']} - {px('p0', 'a_')['y']}) ** 2) / s_px * 100"
    hips = lambda of="": f"(({px('p23', of)['x']} + {px('p24', of)['x']}) / 2)"
    knees = f"(({angle('p23', 'p25', 'p27')} + {angle('p24', 'p26', 'p28')}) / 2)"
    measures = {
        "spine_forward_tilt": forward, "stance_width_ratio": "abs(p27.x - p28.x) / s_world", "knee_flex": knees, "shoulder_turn": turn("p11", "p12"), "hip_turn": turn("p23", "p24"),
        "lead_arm_straight": angle("p11", "p13", "p15"), "trail_elbow_flex": angle("p12", "p14", "p16"), "head_drift_pct": moved,
        "pelvis_shift_pct": f"({hips()} - {hips('a_')}) / s_px * 100", "spine_lateral_tilt": tilt_xy,
    }
    derived = {
        "x_factor": "shoulder_turn - hip_turn", "trail_arm_extend": "trail_elbow_flex", "hip_open": "-hip_turn", "hip_to_target": "-hip_turn", "shoulder_open": "-shoulder_turn", "shoulder_square": "-shoulder_turn",
        "x_factor_retention": "CASE WHEN abs(max(CASE WHEN phase_no = 4 THEN shoulder_turn - hip_turn END) OVER (PARTITION BY k)) >= 1e-3 THEN max(CASE WHEN phase_no = 5 THEN shoulder_turn - hip_turn END) OVER (PARTITION BY k) / max(CASE WHEN phase_no = 4 THEN shoulder_turn - hip_turn END) OVER (PARTITION BY k) * 100 ELSE 100 END",
        "balance_hold_sec": "hold", "tempo_ratio": "tempo", "swing_duration": "lasts", "max_head_drift_pct": "drift",
    }
    rows = []
    for no, (phase, key, impl, unit, lo, hi, views) in enumerate(SPECS):
        if FACE in views:
            rows.append(f"({no}, {PHASES.index(phase) + 1 if phase in PHASES else 9}, '{key}', '{impl}', '{unit}', {lo}::DOUBLE, {hi}::DOUBLE, {key in DROPPABLE}, {key not in NOT_CRITICAL})")
    every = [*measures, *derived]
    value = " ".join(f"WHEN '{x}' THEN {x}" for x in every)
    return f"""
    ax AS (SELECT f.k, {', '.join(f'f.{p} AS a_{p}' for p in ('p0', 'p11', 'p12', 'p23', 'p24'))}, f.shift AS a_shift,
        sqrt((f.p11.x - f.p12.x) ** 2 + (f.p11.y - f.p12.y) ** 2 + (f.p11.z - f.p12.z) ** 2) AS s_world,
        sqrt(({px('p11')['x']} - {px('p12')['x']}) ** 2 + ({px('p11')['y']} - {px('p12')['y']}) ** 2) AS wide, abs(({px('p27')['y']} + {px('p28')['y']}) / 2 - {px('p0')['y']}) AS tall
        FROM f JOIN ev ON ev.k = f.k AND ev.i = f.i AND ev.phase_no = 1),
    w90 AS (SELECT k, quantile_cont(sqrt(({px('p11')['x']} - {px('p12')['x']}) ** 2 + ({px('p11')['y']} - {px('p12')['y']}) ** 2), 0.9) AS w FROM f GROUP BY k),
    ab AS (SELECT ax.*, CASE WHEN wide >= 0.6 * w THEN wide ELSE w END AS s_px, wide / tall >= {C.VIEW_RATIO_DTL} AS face FROM ax JOIN w90 USING (k)),
    hd AS (SELECT f.k, max({moved}) AS drift FROM f JOIN ab USING (k) WHERE f.i BETWEEN (SELECT i FROM ev WHERE ev.k = f.k AND phase_no = 1) AND (SELECT i FROM ev WHERE ev.k = f.k AND phase_no = 8) GROUP BY f.k),
    wh AS (SELECT k, any_value((SELECT coalesce(min(g.i), 120) FROM g WHERE g.k = ev.k AND g.i >= fin AND NOT g.speed < {C.V_STILL}) - fin) / {FE} AS hold, any_value(tempo) AS tempo, any_value(lasts) AS lasts FROM (
        SELECT k, max(i) FILTER (phase_no = 8) AS fin, (max(i) FILTER (phase_no = 4) - max(i) FILTER (phase_no = 1)) / greatest(1, max(i) FILTER (phase_no = 6) - max(i) FILTER (phase_no = 4)) AS tempo,
            (max(i) FILTER (phase_no = 8) - max(i) FILTER (phase_no = 1)) / {synth.FPS} AS lasts FROM ev GROUP BY k) ev GROUP BY k),
    ms AS (SELECT f.k, ev.phase_no, hold, tempo, lasts, drift, {', '.join(f'{v} AS {x}' for x, v in measures.items())}
        FROM ev JOIN f ON f.k = ev.k AND f.i = ev.i JOIN ab ON ab.k = ev.k JOIN hd ON hd.k = ev.k JOIN wh ON wh.k = ev.k WHERE face),
    md AS (SELECT *, {', '.join(f'{v} AS {x}' for x, v in derived.items())} FROM ms),
    mx AS (SELECT * FROM md UNION ALL SELECT * REPLACE (9 AS phase_no) FROM md WHERE phase_no = 1),
    sp(spec_no, phase_no, metric_key, impl, unit, lo, hi, allow_drop, critical) AS (VALUES {', '.join(rows)}),
    mv AS (SELECT mx.k, sp.*, CASE impl {value} END AS raw FROM mx JOIN sp USING (phase_no)),
    mf AS (SELECT *, round_even(CASE WHEN unit = '°' THEN greatest(-180, least(180, coalesce(raw, CASE WHEN NOT allow_drop THEN (lo + hi) / 2 END))) ELSE coalesce(raw, CASE WHEN NOT allow_drop THEN (lo + hi) / 2 END) END, 1) AS value FROM mv),
    me AS (SELECT *, raw IS NULL AS filled, CASE WHEN critical AND value < lo - (hi - lo) THEN 'critical_low' WHEN critical AND value > hi + (hi - lo) THEN 'critical_high' WHEN value < lo THEN 'low' WHEN value > hi THEN 'high' ELSE 'normal' END AS status
        FROM mf WHERE value IS NOT NULL)"""


def risks_sql() -> str:
    """ri: k, phase_no, rule_id, level, value, description."""
    rows = []
    for rule, level, phase, metric, conditions, views, on in RULES:
        if not on or FACE not in views:
            continue
        test = " OR ".join(f"value {'=' if op == '==' else op} {x}" for op, x in conditions)
        first = conditions[0][1]
        branch = " ".join(f"WHEN value {op} {t} THEN '{text}'" for op, t, text in BRANCHES.get(rule, []))
        branch = f"CASE {branch} ELSE '' END" if branch else "''"
        show = lambda v: f"CASE WHEN unit IN ('°', '%') THEN printf('%.1f', ({v})::DOUBLE) ELSE printf('%.2f', ({v})::DOUBLE) END"
        text = f"{show('value')} || unit || ' (' || {show('lo')} || '-' || {show('hi')} || ', limit ' || {show(first)} || '). ' || {branch}"
        rows.append(f"SELECT k, phase_no, '{rule}' AS rule_id, '{level}' AS level, value, {text} AS description FROM me WHERE phase_no = {PHASES.index(phase) + 1} AND metric_key = '{metric}' AND ({test})")
    assert set(LEVELS) >= {"high", "medium", "low"}
    return "ri AS (" + " UNION ALL ".join(rows) + ")"
