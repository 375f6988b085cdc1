"""Reading and writing tables: landmark cache, scratch tables, batch discovery."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import extension
from ..operators.series import Series, smoothing_width

POINT = "struct<x:{0},y:{0},z:{0}>"
LANDMARKS = "task_id bigint, i int, frame_index int, ts double, detected boolean, norm array<{p}>, world array<{p}>, vis array<{t}>"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(df: DataFrame) -> DataFrame:
    """Written once to the folder that all executors share, and read back: later uses do not compute it again."""
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("motionlake.tables", None)
    if not at:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="motionlake-")
        spark.conf.set("motionlake.tables", at)
    path = f"{at}/motionlake-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _places[id(out)] = (out, path)
    return out


def hashed(own: DataFrame) -> DataFrame:
    """The side of a join that has one row per task, against many: a hash table of each partition, the other side stays unsorted.

    Like sorted_side it is never broadcast: the size of a table's file, on which Spark decides, says little of its rows, as equal ones take no room in it.
    """
    return own.hint("shuffle_hash")


def sorted_side(rows: DataFrame) -> DataFrame:
    """A side of a join that grows with the tasks: never broadcast."""
    return rows.hint("merge")


_places: dict[int, tuple[DataFrame, str]] = {}  # what scratch() wrote and nobody has dropped


def dropped(*tables: DataFrame) -> None:
    """Delete tables of scratch() that nothing reads any more; others are left alone."""
    for t in tables:
        found, path = _places.pop(id(t), (None, ""))
        if found is not None:
            place = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def release() -> None:
    """Delete all tables of scratch(): once their results have been read."""
    dropped(*(t for t, _ in list(_places.values())))


def save_landmarks(frames: DataFrame, path: str) -> None:
    """32-bit floats, one folder per task."""
    kind = f"array<{POINT.format('float')}>"
    small = frames.withColumns({"norm": F.col("norm").cast(kind), "world": F.col("world").cast(kind), "vis": F.col("vis").cast("array<float>")})
    small.write.partitionBy("task_id").parquet(path)


def load_landmarks(spark: SparkSession, path: str) -> DataFrame:
    """As doubles; an empty table where nothing has been saved."""
    double = f"array<{POINT.format('double')}>"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], LANDMARKS.format(p=POINT.format("double"), t="double"))
    rows = spark.read.schema(LANDMARKS.format(p=POINT.format("float"), t="float")).parquet(path)
    return rows.withColumns({"norm": F.col("norm").cast(double), "world": F.col("world").cast(double), "vis": F.col("vis").cast("array<double>")})


def cleaned_landmarks(frames: DataFrame, videos: DataFrame) -> DataFrame:
    """What extraction does to the raw points: missing ones filled along the frames, then each coordinate averaged over SMOOTH_SEC.

    Points become rows, so each of a task's 33 is a series of its own.
    """
    c = F.col
    both = F.arrays_zip("norm", "world")
    rows = frames.select("task_id", "i", F.posexplode(both).alias("k", "p"))
    axes = [(kind, x) for kind in ("norm", "world") for x in "xyz"]
    rows = rows.select("task_id", "i", "k", *[F.when(~F.isnan(c(f"p.{kind}.{x}")), c(f"p.{kind}.{x}")).alias(f"{kind}_{x}") for kind, x in axes])
    step = videos.select("task_id", smoothing_width(c("fps") / F.coalesce("sample_step", F.lit(1)), C.SMOOTH_SEC).alias("w"))
    names = [f"{kind}_{x}" for kind, x in axes]
    s = Series(rows.join(step, "task_id"), ["task_id", "k"], ["i"]).filled(names)
    s = s.add("n", F.count(F.lit(1)).over(s.group)).averaged(names, "w", "n")
    point = lambda kind: F.struct(*[c(f"{kind}_{x}").alias(x) for x in "xyz"]).alias(kind)
    back = s.df.groupBy("task_id", "i").agg(F.array_sort(F.collect_list(F.struct("k", point("norm"), point("world")))).alias("all"))
    met = frames.drop("norm", "world").join(back, ["task_id", "i"])
    part = lambda kind: F.transform("all", lambda x: x[kind])
    return met.withColumns({kind: part(kind) for kind in ("norm", "world")}).select(*frames.columns)


def turned(points: Column, degrees: Column) -> Column:
    """Normalised points of a frame turned clockwise by 0, 90, 180 or 270 degrees; other angles leave them."""

    def one(p: Column) -> Column:
        x = F.when(degrees == 90, 1 - p["y"]).when(degrees == 180, 1 - p["x"]).when(degrees == 270, p["y"]).otherwise(p["x"])
        y = F.when(degrees == 90, p["x"]).when(degrees == 180, 1 - p["y"]).when(degrees == 270, 1 - p["x"]).otherwise(p["y"])
        return F.struct(x.alias("x"), y.alias("y"), p["z"].alias("z"))

    return F.transform(points, one)


def probed(videos: DataFrame) -> DataFrame:
    """videos: fps, frame_count, width, height, orientation. Adds duration, sample_step, low_fps and the first error in code."""
    c = F.col
    duration = c("frame_count") / c("fps")
    bad_fps = c("fps").isNull() | F.isnan("fps") | (c("fps") <= 0) | (F.abs(c("fps")) == float("inf"))
    code = (
        F.when(F.coalesce(c("orientation"), F.lit(0)) != 0, "BAD_ORIENTATION")
        .when(bad_fps | ~(F.coalesce(c("width"), F.lit(0)) > 0) | ~(F.coalesce(c("height"), F.lit(0)) > 0), "BAD_FORMAT")
        .when(~duration.between(C.MIN_DURATION_SEC, C.MAX_DURATION_SEC), "BAD_DURATION")
    )
    out = videos.withColumn("code", code)
    return out.withColumns(
        {
            "duration": F.when(~bad_fps, F.round(F.try_divide(c("frame_count"), c("fps")), 3)),
            "sample_step": F.greatest(F.lit(1), F.ceil(c("frame_count") / C.MAX_INFER_FRAMES)).cast("int"),
            "low_fps": c("fps") < C.LOW_FPS,
        }
    )


def sampled(frames: DataFrame, videos: DataFrame) -> DataFrame:
    """Every sample_step-th frame."""
    return frames.join(videos.select("task_id", "sample_step"), "task_id").where(F.col("frame_index") % F.col("sample_step") == 0)


def brightness_frames(total: Column, samples: int = C.BRIGHTNESS_SAMPLES) -> Column:
    """Up to ten frames, each in the middle of its share of the video."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda k: F.floor(total * (k + 0.5) / samples).cast("int")))


def too_dark(gray_means: DataFrame) -> DataFrame:
    """gray_means: task_id, gray."""
    return gray_means.groupBy("task_id").agg((F.avg("gray") < C.DARK_MEAN).alias("too_dark"))


def clean_indices(raw: DataFrame, key: str = "task_id", col: str = "frame") -> DataFrame:
    """Castable, not negative, distinct. Sort where they are shown."""
    n = F.expr(f"try_cast({col} AS int)")
    return raw.select(key, n.alias(col)).where(F.col(col) >= 0).distinct()


def targeted(frames: DataFrame, targets: DataFrame) -> DataFrame:
    """The frames that are asked for; those that do not exist are just absent."""
    return frames.join(targets, ["task_id", "frame_index"], "left_semi")


def absent(targets: DataFrame, frames: DataFrame) -> DataFrame:
    """The frames that are asked for and do not exist."""
    return targets.join(frames, ["task_id", "frame_index"], "left_anti")


def accepted_uploads(files: DataFrame) -> DataFrame:
    """files: name, length. Adds the first reason against each in code."""
    c = F.col
    code = F.when(~extension(c("name")).isin(*C.VIDEO_EXTENSIONS), "BAD_FORMAT").when(c("length") <= 0, "EMPTY").when(c("length") > C.MAX_UPLOAD_BYTES, "FILE_TOO_LARGE")
    return files.withColumn("code", code)


def source_file(files: DataFrame) -> DataFrame:
    """files: task_id, path. The first file of each task whose name begins with source."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return files.where(name.startswith("source")).groupBy("task_id").agg(F.min("path").alias("path"))
