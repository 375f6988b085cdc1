"""Whole queries: the swing pipeline, nested reports, envelopes, and lookups."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from ..dims import metric_specs, phase_dim, risk_rules
from ..functions.text import image_name
from ..operators import risk
from ..operators.joins import nearest
from ..operators.metrics import stage_metrics, task_facts
from ..operators.refine import refined
from ..operators.segment import anchors, events, folded, intermediates, ordered, signals
from ..sources.tables import scratch, sorted_side

c = F.col


class Analysis:
    """The tables of one analysis. Swings and metrics are written once, when first asked for, as several others read them.

    With motion_features the impact is refined before events and metrics are taken.
    """

    def __init__(self, frames: DataFrame, videos: DataFrame, motion_features: DataFrame | None = None):
        self.frames, self.videos, self.motion_features = frames, videos, motion_features
        self.phases = phase_dim(frames.sparkSession)

    @cached_property
    def rows(self) -> DataFrame:
        return signals(self.frames, self.videos)

    @cached_property
    def first_swings(self) -> DataFrame:
        return scratch(folded(ordered(intermediates(anchors(self.rows)))))

    @cached_property
    def swings(self) -> DataFrame:
        if self.motion_features is None:
            return self.first_swings
        views = task_facts(self.frames, self.first_swings, self.videos).select("task_id", "view")
        return scratch(refined(self.rows, self.first_swings, self.motion_features, views))

    @cached_property
    def events(self) -> DataFrame:
        return events(self.swings)

    @cached_property
    def facts(self) -> DataFrame:
        return task_facts(self.frames, self.swings, self.videos)

    @property
    def errors(self) -> DataFrame:
        return self.swings.where("code is not null").select("task_id", "code")

    @cached_property
    def metrics(self) -> DataFrame:
        return scratch(stage_metrics(self.frames, self.swings, self.videos, metric_specs(self.frames.sparkSession)))

    @property
    def risks(self) -> DataFrame:
        return risk.risks(self.metrics, risk_rules(self.frames.sparkSession))

    def report(self, base_url: str = "") -> DataFrame:
        """task_id, report (JSON): phases by number, each with its metrics and risks; the global values."""
        fields = ["spec_no", "metric_key", "value", "unit", "ref_min", "ref_max", "status", "filled"]
        lists = nested(self.metrics, ["task_id", "view", "phase_no"], fields, "metrics")
        found = risk.per_phase(self.risks, self.events.select("task_id").distinct(), self.phases).select("task_id", "phase_no", "risks")
        rows = self.events.join(sorted_side(lists), ["task_id", "phase_no"], "left").join(sorted_side(found), ["task_id", "phase_no"], "left")
        url = F.concat(F.lit(base_url), F.lit("/"), c("task_id").cast("string"), F.lit("/"), image_name(c("phase_no"), c("phase")))
        phase = F.struct("phase_no", "phase", "frame_index", "timestamp", "estimated", url.alias("image"), "metrics", "risks")
        listed = rows.groupBy("task_id").agg(F.array_sort(F.collect_list(phase)).alias("phases"), F.max("view").alias("view"))
        whole = lists.where("phase_no = 9").select("task_id", c("metrics").alias("global"))
        out = listed.join(sorted_side(whole), "task_id", "left")
        total = F.aggregate("phases", F.lit(0), lambda s, p: s + F.size(p["risks"]))
        return out.select("task_id", F.to_json(F.struct("task_id", "view", "phases", "global", total.alias("risk_count"))).alias("report"))


def nested(rows: DataFrame, keys: list[str], fields: list[str], name: str) -> DataFrame:
    """keys and the rows of each as an array, sorted by the fields in their order."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))


def quality_gate(detected: DataFrame) -> DataFrame:
    """detected: task_id, detected, vis (mean of the core landmarks). The first code that applies, else null."""
    miss = F.avg((~c("detected")).cast("double"))
    low = F.avg(F.when(c("detected"), (c("vis") < C.LOW_VISIBILITY).cast("double")))
    code = (
        F.when(miss > C.MISS_NO_PERSON, "NO_PERSON").when(miss > C.MISS_LOW_QUALITY, "LOW_QUALITY").when(low > C.LOW_VISIBILITY_SHARE, "LOW_QUALITY")
    )
    return detected.groupBy("task_id").agg(miss.alias("miss_ratio"), low.alias("low_ratio"), code.alias("code"))


def envelope(code: Column, data: Column) -> Column:
    message = F.when(code == 0, "ok").otherwise("error")
    return F.to_json(F.struct(code.alias("code"), data.alias("data"), message.alias("message")))


def parsed_envelope(text: Column, data_type: str) -> Column:
    """Malformed text gets the code 5000."""
    e = F.from_json(text, f"code int, data {data_type}, message string")
    return F.struct(F.coalesce(e["code"], F.lit(5000)).alias("code"), e["data"].alias("data"), e["message"].alias("message"))


def frame_lookup(requests: DataFrame, events: DataFrame, frames: DataFrame, totals: DataFrame) -> DataFrame:
    """requests: task_id, frame. Clamped into the video, at most 30 frames off an event; the nearest sampled frame and phase.

    Requests meet the eight events of their task; frames meet them in order, without pairs.
    """
    asked = requests.join(totals, "task_id").withColumn("at", F.greatest(F.lit(0), F.least(c("frame"), c("total") - 1)))
    near = asked.join(events.select("task_id", c("frame_index").alias("event_frame"), "phase", "phase_no"), "task_id")
    best = F.min(F.struct(F.abs(c("event_frame") - c("at")).alias("d"), "phase_no", "phase"))
    found = near.groupBy("task_id", "frame", "at").agg(best.alias("e"))
    close = nearest(found, frames.select("task_id", c("frame_index").alias("f")), ["task_id"], "at", "f")
    return close.select(
        "task_id", "frame", c("f").alias("actual"), c("e.phase").alias("phase"), (c("e.d") > C.FRAME_RANGE).alias("out_of_range")
    )


def skeleton_lines(spark, frames: DataFrame, videos: DataFrame) -> DataFrame:
    """One row per frame and edge with scaled end points; nothing is drawn."""
    edges = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(C.SKELETON)], "edge int, p int, q int")
    rows = frames.select("task_id", "frame_index", "norm").join(videos.select("task_id", "width", "height"), "task_id").crossJoin(F.broadcast(edges))
    end = lambda k, x, size: (F.get("norm", c(k))[x] * c(size)).alias(f"{k}_{x}")
    return rows.select("task_id", "frame_index", "edge", end("p", "x", "width"), end("p", "y", "height"), end("q", "x", "width"), end("q", "y", "height"))


def card_offsets(sections: DataFrame, keys: list[str], order: str, height: str) -> DataFrame:
    """Each section's top: the sum of the heights before it."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sections.withColumn("top", F.coalesce(F.sum(height).over(before), F.lit(0)))


def counted_frames(targets: DataFrame, frames: DataFrame, name: str = "frames") -> tuple[DataFrame, Observation]:
    """targets (task_id, frame_index) with found, and what was counted on the way: asked, found, absent and tasks without any.

    The counts are taken by the plan itself as it runs, with no pass of their own; counters() reads them afterwards.
    """
    seen = frames.select("task_id", "frame_index").distinct().withColumn("found", F.lit(True))
    met = targets.join(seen, ["task_id", "frame_index"], "left").withColumn("found", F.coalesce("found", F.lit(False)))
    told = Observation(name)
    found = F.count(F.when(c("found"), 1))
    return met.observe(told, F.count(F.lit(1)).alias("asked"), found.alias("found"), (F.count(F.lit(1)) - found).alias("absent")), told


def counters(spark: SparkSession, told: list[Observation]) -> DataFrame:
    """name, metric, value of observations whose queries have run."""
    rows = [(o._name, k, int(v)) for o in told for k, v in o.get.items()]
    return spark.createDataFrame(rows, "name string, metric string, value bigint")
