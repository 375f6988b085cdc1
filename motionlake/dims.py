"""The static dimensions: phases, metric specs and risk rules. Small by construction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PHASES = ("address", "takeaway", "backswing", "top", "downswing", "impact", "follow_through", "finish")
LEVELS = ("high", "medium", "low")
FACE, DTL = "face_on", "down_the_line"

# Phase, key, implementation, unit, reference range, views.
SPECS = (
    ("address", "spine_tilt_side", "spine_lateral_tilt", "°", 5.0, 12.0, (FACE,)),
    ("address", "stance_width_ratio", "stance_width_ratio", "", 1.0, 1.3, (FACE,)),
    ("address", "knee_flexion", "knee_flex", "°", 160.0, 172.0, (FACE, DTL)),
    ("address", "spine_tilt_fwd", "spine_forward_tilt", "°", 30.0, 40.0, (DTL,)),
    ("takeaway", "shoulder_turn", "shoulder_turn", "°", 25.0, 35.0, (FACE,)),
    ("takeaway", "hip_turn", "hip_turn", "°", 8.0, 18.0, (FACE,)),
    ("takeaway", "head_drift", "head_drift_pct", "%", 0.0, 4.0, (FACE, DTL)),
    ("takeaway", "lead_arm_straightness", "lead_arm_straight", "°", 165.0, 178.0, (FACE, DTL)),
    ("backswing", "shoulder_turn", "shoulder_turn", "°", 55.0, 72.0, (FACE,)),
    ("backswing", "hip_turn", "hip_turn", "°", 25.0, 38.0, (FACE,)),
    ("backswing", "trail_arm_flexion", "trail_elbow_flex", "°", 95.0, 125.0, (FACE, DTL)),
    ("backswing", "lead_arm_straightness", "lead_arm_straight", "°", 155.0, 175.0, (FACE, DTL)),
    ("top", "shoulder_turn", "shoulder_turn", "°", 70.0, 88.0, (FACE,)),
    ("top", "hip_turn", "hip_turn", "°", 45.0, 60.0, (FACE,)),
    ("top", "x_factor", "x_factor", "°", 20.0, 35.0, (FACE,)),
    ("top", "lead_arm_straightness", "lead_arm_straight", "°", 150.0, 172.0, (FACE, DTL)),
    ("top", "swing_plane", "swing_plane", "°", 55.0, 65.0, (DTL,)),
    ("downswing", "hip_turn", "hip_turn", "°", 10.0, 30.0, (FACE,)),
    ("downswing", "shoulder_turn", "shoulder_turn", "°", 45.0, 65.0, (FACE,)),
    ("downswing", "x_factor_retention", "x_factor_retention", "%", 85.0, 130.0, (FACE,)),
    ("downswing", "pelvis_shift", "pelvis_shift_pct", "%", 4.0, 12.0, (FACE,)),
    ("impact", "hip_open_angle", "hip_open", "°", 15.0, 30.0, (FACE,)),
    ("impact", "shoulder_squareness", "shoulder_square", "°", -5.0, 12.0, (FACE,)),
    ("impact", "pelvis_shift", "pelvis_shift_pct", "%", 10.0, 20.0, (FACE,)),
    ("impact", "spine_tilt_change", "spine_tilt_delta", "°", 0.0, 8.0, (DTL,)),
    ("follow_through", "hip_open_angle", "hip_open", "°", 40.0, 60.0, (FACE,)),
    ("follow_through", "shoulder_turn", "shoulder_open", "°", 35.0, 60.0, (FACE,)),
    ("follow_through", "trail_arm_flexion", "trail_arm_extend", "°", 150.0, 172.0, (FACE, DTL)),
    ("follow_through", "spine_tilt_side", "spine_lateral_tilt", "°", 10.0, 20.0, (FACE,)),
    ("finish", "hip_toward_target", "hip_to_target", "°", 75.0, 95.0, (FACE,)),
    ("finish", "shoulder_total_open", "shoulder_open", "°", 85.0, 110.0, (FACE,)),
    ("finish", "pelvis_shift", "pelvis_shift_pct", "%", 20.0, 35.0, (FACE,)),
    ("finish", "balance_hold", "balance_hold_sec", "s", 0.8, 3.0, (FACE, DTL)),
    ("global", "tempo_ratio", "tempo_ratio", ":1", 2.5, 3.5, (FACE, DTL)),
    ("global", "swing_duration", "swing_duration", "s", 1.0, 1.6, (FACE, DTL)),
    ("global", "max_head_drift", "max_head_drift_pct", "%", 0.0, 8.0, (FACE, DTL)),
)
DROPPABLE = {"swing_plane"}
NOT_CRITICAL = {"x_factor_retention", "balance_hold"}

# Rule, level, phase, metric, conditions, views, enabled.
RULES = (
    ("RISK-001", "high", "top", "hip_turn", ((">", 62.0),), (FACE,), True),
    ("RISK-002", "medium", "takeaway", "hip_turn", ((">", 20.0),), (FACE,), True),
    ("RISK-003", "medium", "top", "hip_turn", (("<", 40.0),), (FACE,), False),
    ("RISK-004", "low", "takeaway", "head_drift", ((">=", 5.0),), (FACE, DTL), False),
    ("RISK-005", "high", "top", "x_factor", (("<", 18.0),), (FACE,), True),
    ("RISK-006", "high", "top", "lead_arm_straightness", (("<", 145.0),), (FACE, DTL), True),
    ("RISK-007", "low", "backswing", "shoulder_turn", (("<", 50.0),), (FACE,), True),
    ("RISK-008", "low", "backswing", "trail_arm_flexion", ((">", 130.0),), (FACE, DTL), False),
    ("RISK-009", "medium", "top", "swing_plane", (("<", 50.0), (">", 70.0)), (DTL,), False),
    ("RISK-010", "medium", "downswing", "x_factor_retention", (("<", 80.0),), (FACE,), True),
    ("RISK-011", "low", "address", "knee_flexion", (("<", 156.0), (">", 174.0)), (FACE, DTL), True),
    ("RISK-012", "low", "address", "stance_width_ratio", (("<", 0.9), (">", 1.4)), (FACE,), False),
    ("RISK-013", "medium", "impact", "hip_open_angle", (("<", 12.0),), (FACE,), False),
    ("RISK-014", "high", "impact", "spine_tilt_change", ((">=", 10.0),), (DTL,), True),
    ("RISK-015", "medium", "impact", "pelvis_shift", (("<", 8.0),), (FACE,), False),
    ("RISK-016", "low", "follow_through", "shoulder_turn", (("<", 30.0),), (FACE,), True),
    ("RISK-017", "low", "finish", "balance_hold", (("<", 0.6),), (FACE, DTL), True),
)
TEMPLATE = "{value}{unit} ({ref_min}-{ref_max}, limit {threshold}). {branch}"
BRANCHES = {"RISK-011": [("<", 156.0, "bent too far"), (">=", 156.0, "too straight")]}


def metric_specs(spark: SparkSession) -> DataFrame:
    rows = [(i, *x[:6], list(x[6]), x[1] in DROPPABLE, x[1] not in NOT_CRITICAL) for i, x in enumerate(SPECS)]
    return spark.createDataFrame(
        rows,
        "spec_no int, phase string, key string, impl_key string, unit string, ref_min double, ref_max double, views array<string>,"
        " allow_drop boolean, critical boolean",
    )


def risk_rules(spark: SparkSession) -> DataFrame:
    """The rules with a neutral name and template; names, templates, advice and excerpts can be replaced by joining on rule_id."""
    rows = [
        (rule, level, phase, metric, f"{metric} at {phase}", "or", list(cs), list(views), TEMPLATE, BRANCHES.get(rule, []), [], None, on)
        for rule, level, phase, metric, cs, views, on in RULES
    ]
    return spark.createDataFrame(
        rows,
        "rule_id string, level string, phase string, metric_key string, name string, logic string, conditions array<struct<op:string,threshold:double>>,"
        " views array<string>, template string, branches array<struct<op:string,threshold:double,text:string>>, suggestions array<string>,"
        " excerpt string, enabled boolean",
    )


def phase_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i + 1, p) for i, p in enumerate(PHASES)], "phase_no int, phase string")
