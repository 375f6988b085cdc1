"""The rule engine: metrics against a declarative rule dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import LEVELS
from ..functions.text import meets, rendered, shown
from ..sources.tables import sorted_side

c = F.col


def active(rules: DataFrame, forced: tuple[str, ...] = (), enabled: bool = True) -> DataFrame:
    """Enabled or forced rules; none with the switch off."""
    return rules.where(F.lit(enabled) & (c("enabled") | c("rule_id").isin(*forced) if forced else F.lit(enabled) & c("enabled")))


def matched(value: Column) -> Column:
    """All or any of the conditions, by the rule's logic. Null-safe: a missing value matches nothing."""
    holds = lambda x: F.coalesce(meets(x["op"], x["threshold"], value), F.lit(False))
    return F.when(c("logic") == "and", F.forall("conditions", holds)).otherwise(F.exists("conditions", holds))


def description(value: Column) -> Column:
    branch = F.get(F.filter("branches", lambda b: meets(b["op"], b["threshold"], value)), F.lit(0))["text"]
    return rendered(
        c("template"),
        {
            "value": shown(value, c("unit")), "unit": c("unit"), "ref_min": shown(c("ref_min"), c("unit")),
            "ref_max": shown(c("ref_max"), c("unit")), "threshold": shown(F.get("conditions", F.lit(0))["threshold"], c("unit")), "branch": branch,
        },
    )


def level_order(level: Column) -> Column:
    return F.coalesce(*[F.when(level == x, F.lit(i)) for i, x in enumerate(LEVELS)], F.lit(len(LEVELS)))


def risks(metrics: DataFrame, rules: DataFrame, forced: tuple[str, ...] = (), enabled: bool = True) -> DataFrame:
    """One row per task and rule met. Only metrics that the phase has can meet a rule, in views that the rule covers."""
    met = metrics.join(F.broadcast(active(rules, forced, enabled).withColumnRenamed("views", "rule_views")), ["phase", "metric_key"])
    met = met.where(F.array_contains("rule_views", c("view")) & matched(c("value")))
    return met.select(
        "task_id", "phase_no", "phase", "rule_id", "level", level_order(c("level")).alias("level_no"), "metric_key", "value", "unit",
        "ref_min", "ref_max", description(c("value")).alias("description"), "name", "suggestions", "excerpt",
    )


def per_phase(found: DataFrame, tasks: DataFrame, phases: DataFrame) -> DataFrame:
    """Every task and phase with its risks in order of level and rule; an empty list where there are none."""
    items = F.array_sort(F.collect_list(F.struct("level_no", "rule_id", "name", "level", "phase", "metric_key", "value", "unit", "ref_min", "ref_max", "description", "suggestions", "excerpt")))
    lists = found.groupBy("task_id", "phase_no").agg(items.alias("risks"))
    grid = tasks.select("task_id").crossJoin(F.broadcast(phases))  # eight rows
    out = grid.join(sorted_side(lists), ["task_id", "phase_no"], "left")
    empty = F.array().cast(lists.schema["risks"].dataType)
    return out.withColumn("risks", F.coalesce("risks", empty))


def self_check(rules: DataFrame, specs: DataFrame) -> DataFrame:
    """rule_id, problem: repeated ids, odd operators or logic, no conditions, unknown metrics, views beyond the metric's."""
    known = specs.select("phase", c("key").alias("metric_key"), c("views").alias("spec_views"))
    own = rules.join(F.broadcast(known), ["phase", "metric_key"], "left")
    tests = {
        "no conditions": F.size("conditions") == 0,
        "odd logic": ~c("logic").isin("and", "or"),
        "odd operator": F.exists("conditions", lambda x: ~x["op"].isin(">", "<", ">=", "<=", "==")),
        "unknown metric": c("spec_views").isNull(),
        "views beyond the metric": F.size(F.array_except("views", "spec_views")) > 0,
        "no text": c("enabled") & (F.coalesce(c("template"), F.lit("")) == ""),
    }
    problems = F.filter(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(k)) for k, t in tests.items()]), lambda x: x.isNotNull())
    twice = rules.groupBy("rule_id").count().where("count > 1").select("rule_id", F.lit("repeated id").alias("problem"))
    return own.select("rule_id", F.explode(problems).alias("problem")).unionByName(twice)
