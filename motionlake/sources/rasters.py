"""Tiles from vectors: each vector of SIDE x SIDE numbers is a tile of an image."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.raster import SIDE

c = F.col


def tiles_from_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", across: int = 4, frames: int = 8) -> DataFrame:
    """across x across tiles in order of their ids make a frame, and so many frames a task. Thousandths of a number, modulo 256, are its brightness.

    Vectors of another length, or with nulls, are no tiles; their place in the frame is empty.
    """
    per_frame, k = across * across, c("__id")
    bright = F.transform("__v", lambda x: (F.floor(F.abs(x.cast("double")) * 1000) % 256).cast("smallint"))
    rows = vectors.select(c(id_col).cast("bigint").alias("__id"), c(vector_col).alias("__v"))
    rows = rows.where((F.size("__v") == SIDE * SIDE) & ~F.exists("__v", lambda x: x.isNull()) & (k >= 0))
    return rows.select(
        F.floor(k / (per_frame * frames)).cast("bigint").alias("task_id"), F.floor(k / per_frame % frames).cast("bigint").alias("frame_index"),
        F.floor(k % per_frame / across).cast("int").alias("ty"), (k % across).cast("int").alias("tx"), bright.alias("pixels"),
    )
