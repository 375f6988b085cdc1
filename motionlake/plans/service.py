"""The surface around the analysis as tables: submissions, states, results, codes, and what a client shows of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from .. import config as C
from ..sources.tables import accepted_uploads

c = F.col

# Internal code, external code, HTTP status; the text is our own.
CODES = (
    ("OK", 0, 0, 200, "ok"),
    ("FILE_TOO_LARGE", 4001, 10001, 400, "the file is too large"),
    ("BAD_FORMAT", 4001, 10002, 400, "the format is not supported"),
    ("EMPTY", 4001, 10002, 400, "the file is empty"),
    ("BAD_DURATION", 4001, 10003, 400, "the video is too short or too long"),
    ("BAD_VIDEO", 4001, 10002, 400, "the video cannot be read"),
    ("BAD_ORIENTATION", 4001, 10005, 400, "the video lies on its side; hold the phone upright"),
    ("NO_PERSON", 4001, 10004, 400, "nobody was found in the video"),
    ("NO_SWING", 4001, 10004, 400, "no whole swing was found in the video"),
    ("TOO_DARK", 4001, 10004, 400, "the video is too dark"),
    ("LOW_QUALITY", 4001, 10004, 400, "the person was not seen well enough"),
    ("NOT_FOUND", 4004, 20001, 404, "there is no such task"),
    ("PENDING", 4009, 20002, 409, "the task is not finished"),
    ("FRAME_OUT_OF_RANGE", 4001, 20003, 400, "the frame is out of range"),
    ("TIMEOUT", 5000, 10004, 500, "the analysis took too long"),
    ("INTERNAL", 5000, 10004, 500, "the analysis failed"),
)
STEPS = ((1, "upload and check"), (2, "landmarks"), (3, "phases"), (4, "metrics and risks"))
LEVEL_TEXT = {"high": "high risk", "medium": "medium risk", "low": "low risk"}
DEFAULT_PHASE = 3


def health(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT 'ok' AS status, '{__version__}' AS version")


def code_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CODES, "name string, internal int, external int, http int, message string")


def coded(rows: DataFrame, name: str = "code", legacy: bool = False) -> DataFrame:
    """Adds api_code, http and message to rows with an error name. Null means no error; unknown names are internal errors."""
    codes = F.broadcast(code_table(rows.sparkSession).withColumnsRenamed({"name": "__name"}))  # a row per code
    known = [k for k, *_ in CODES]
    key = F.when(c(name).isNull(), "OK").when(c(name).isin(*known), c(name)).otherwise("INTERNAL")
    met = rows.withColumn("__key", key).join(codes, c("__key") == c("__name"))
    return met.withColumn("api_code", c("internal" if legacy else "external")).drop("__key", "__name", "internal", "external")


def submitted(files: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """files: task_id, name, length, content_type, field. The log rows that create tasks, and the files that are rejected.

    Of the files of one task the one in the field `video` is taken before one in `file`.
    """
    by_field = F.min_by(F.struct("name", "length", "content_type"), F.struct(F.when(c("field") == "video", 0).otherwise(1).alias("a"), c("name").alias("b")))
    one = files.groupBy("task_id").agg(by_field.alias("f")).select("task_id", "f.*")
    odd = c("content_type").isNotNull() & (c("content_type") != "") & ~c("content_type").startswith("video/") & (c("content_type") != "application/octet-stream")
    checked = accepted_uploads(one).withColumn("code", F.coalesce(F.when(odd, "BAD_FORMAT"), c("code")))
    row = F.struct(at.cast("double").alias("at"), F.lit(0).cast("bigint").alias("seq"), F.lit("create").alias("kind"), F.lit(1).alias("step"), F.lit(0.0).alias("progress"))
    return checked.where("code is null").select("task_id", row.alias("r")).select("task_id", "r.*"), coded(checked.where("code is not null"))


def first_fault(videos: DataFrame) -> DataFrame:
    """What a client checks before it sends: extension, duration, size; the first that fails is in fault."""
    ext = F.lower(F.regexp_extract("name", r"\.([A-Za-z0-9]+)$", 1))
    fault = (
        F.when(~ext.isin(*C.VIDEO_EXTENSIONS), "BAD_FORMAT")
        .when(~F.coalesce(c("duration").between(2.0, C.MAX_DURATION_SEC), F.lit(True)), "BAD_DURATION")
        .when(c("length") > C.MAX_UPLOAD_BYTES, "FILE_TOO_LARGE")
    )
    return videos.withColumn("fault", fault)


def results(requests: DataFrame, states: DataFrame, reports: DataFrame) -> DataFrame:
    """requests: task_id. A finished task's report; else why there is none: not found, not finished, or how it failed."""
    met = requests.join(states.select("task_id", "status"), "task_id", "left").join(reports, "task_id", "left")
    why = F.when(c("status").isNull(), "NOT_FOUND").when(c("status").isin("pending", "processing"), "PENDING").when(c("status") == "failed", "INTERNAL")
    why = F.coalesce(why, F.when(c("report").isNull(), "INTERNAL"))
    return coded(met.withColumn("code", why)).withColumn("report", F.when(c("code").isNull(), c("report")))


def cases(spark: SparkSession, listed: list[tuple[str, str]], present: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """The cases (name, path) of a batch that are wanted and whose file is present."""
    rows = spark.createDataFrame(listed, "name string, path string")
    rows = rows if not wanted else rows.where(c("name").isin(*wanted))
    return rows.join(present.select("path"), "path", "left_semi")


def read_reports(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Reports as JSON files, one document a file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def dump_reports(reports: DataFrame, path: str) -> None:
    """task_id, report (JSON): one line a report."""
    reports.select("report").write.text(path)


def markdown_rows(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """Lines of a table in Markdown, in order: the head, the rule, then the rows by the order columns."""
    cell = lambda x: F.replace(F.coalesce(c(x).cast("string"), F.lit("-")), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(x) for x in columns]), F.lit(" |"))
    body = rows.select(line.alias("line"), F.lit(2).alias("place"), F.struct(*order).alias("key"))
    head = rows.sparkSession.createDataFrame([(f"| {' | '.join(columns)} |", 0), ("|" + "-|" * len(columns), 1)], "line string, place int")
    return head.unionByName(body, allowMissingColumns=True).orderBy("place", "key").select("line")


def warnings(found: DataFrame) -> DataFrame:
    """found: task_id, priority, place, text. Distinct texts per task, by priority and then in the order they were given."""
    first = found.groupBy("task_id", "text").agg(F.min(F.struct("priority", "place")).alias("at"))
    listed = F.array_sort(F.collect_list(F.struct("at", "text")))
    return first.groupBy("task_id").agg(F.transform(listed, lambda x: x["text"]).alias("warnings"))


def phase_view(events: DataFrame, videos: DataFrame) -> DataFrame:
    """What a client shows of each phase: label, and the frames it can be moved to."""
    rows = events.join(videos.select("task_id", "frame_count"), "task_id")
    frame, total = c("frame_index"), F.coalesce("frame_count", F.lit(0))
    label = F.concat(F.format_string("%.2fs", F.coalesce("timestamp", F.lit(0.0))), F.lit(" #"), frame.cast("string"))
    last = F.when(total > 0, F.least(total - 1, frame + C.FRAME_RANGE)).otherwise(frame + C.FRAME_RANGE)
    return rows.select(
        "task_id", "phase_no", "phase", frame.alias("frame_index"), label.alias("label"), F.greatest(F.lit(0), frame - C.FRAME_RANGE).alias("least"),
        last.alias("most"), (c("phase_no") == DEFAULT_PHASE + 1).alias("shown_first"),
    )


def risk_view(risks: DataFrame) -> DataFrame:
    level = F.when(c("level").isin(*LEVEL_TEXT), c("level")).otherwise("low")
    text = F.coalesce(*[F.when(level == k, F.lit(v)) for k, v in LEVEL_TEXT.items()])
    return risks.withColumn("level_text", text)


def success_rates(rows: DataFrame, key: str, succeeded: Column, high: Column) -> DataFrame:
    """key, n, success_pct, n_high: how many of a corpus's cases there are, succeed and are of high risk."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), (F.avg(succeeded.cast("double")) * 100).alias("success_pct"), F.count_if(high).alias("n_high"))


def step_list(states: DataFrame) -> DataFrame:
    """Each task's steps: done, doing or todo by its current step."""
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("no"), F.lit(v).alias("name")) for k, v in STEPS]))
    rows = states.select("task_id", "status", "step", steps.alias("s"))
    state = F.when((c("status") == "success") | (c("s.no") < c("step")), "done").when(c("s.no") == c("step"), "doing").otherwise("todo")
    return rows.select("task_id", "s.no", "s.name", state.alias("state"))
