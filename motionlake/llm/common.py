"""Small pieces that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, one of our own in local mode, and nowhere else."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("motionlake.scratch", None)
    if not at:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="motionlake-")
        spark.conf.set("motionlake.scratch", at)
    return at


def _write(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/motionlake-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path), path


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: no lineage, and lost executors cost nothing.

    The table stays until release() or until the owner of the folder clears it.
    """
    return _write(df)[0]


def release(spark: SparkSession) -> None:
    """Delete every table that cut() wrote in this application."""
    _delete(spark, f"{shared_dir(spark)}/motionlake-{spark.sparkContext.applicationId}")


class Tables:
    """Tables cut on the way to a result; each goes when nothing reads it any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, []

    def cut(self, df: DataFrame) -> DataFrame:
        out, path = _write(df)
        self.held.append((out, path))
        return out

    def free(self, *done: DataFrame | None) -> None:
        for out, path in [x for x in self.held if any(x[0] is d for d in done)]:
            _delete(self.spark, path)
            self.held = [x for x in self.held if x[1] != path]

    def close(self) -> None:
        self.free(*(out for out, _ in self.held))


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Slices of rows that come sorted by their first column, one for each of its values. Only for groups of bounded size."""
    rest = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t])
        k = t.column(0).to_numpy()
        at = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist()]
        for a, z in zip(at, at[1:]):
            yield t.slice(a, z - a)
        rest = t.slice(at[-1])
    if rest is not None:
        yield rest


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII takes the fast built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
