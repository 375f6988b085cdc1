"""Exact dedup by skew-safe combining. DataFrame operations only.

1. Local: the map side of an aggregation folds equal texts inside a task.
2. Salted: its reduce side merges per (digest, salt), where the salt is that of the map
   task. So a text meets in at most ``salts`` places, however many rows have it, and no
   task gets a whole hot group.
3. Global: the salt winners of a text, ``salts`` at most, are combined.

Each of the three compares whole normalised texts (they are grouping keys beside their
SHA-256 and xxhash64), so texts that differ are never merged. Rows then find their group by
SHA-256 and xxhash64 together, rows without their texts.

Defined cases: a null text counts as empty; empty texts form one group; a null
doc_id loses against any other; of rows that repeat both doc_id and text one
stays; an empty table gives an empty result. Other columns are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, ascii_lower, cut
from .rows import keep_rows

SALTS = 16


def _norm(docs: DataFrame, text_col: str) -> Column:
    return ascii_lower(F.coalesce(docs[text_col], F.lit("")))


def groups_of(docs: DataFrame, id_col: str, text_col: str, salts: int) -> DataFrame:
    """digest, fp, keep_id and group_size of each distinct text."""
    rows = docs.select(docs[id_col].alias("id"), _norm(docs, text_col).alias("norm"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))
    rows = rows.select("id", "norm", "salt", F.unhex(F.sha2("norm", 256)).alias("digest"), F.xxhash64("norm").alias("fp"))
    salted = rows.groupBy("digest", "fp", "norm", "salt").agg(F.max("id").alias("id"), F.count("*").alias("n"))
    whole = salted.groupBy("digest", "fp", "norm").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))
    return whole.drop("norm")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (and fp, a second fingerprint)."""
    t = Tables(docs.sparkSession)
    norm = _norm(docs, text_col)
    rows = docs.select(docs[id_col].alias("id"), norm.alias("norm"), F.monotonically_increasing_id().alias("rid"))
    keyed = rows.select("id", "rid", F.unhex(F.sha2("norm", 256)).alias("digest"), F.xxhash64("norm").alias("fp"))
    nth = F.row_number().over(Window.partitionBy("digest", "fp", "id").orderBy("rid"))
    keyed = t.cut(keyed.withColumn("nth", nth))
    groups = t.cut(groups_of(docs, id_col, text_col, salts))
    met = keyed.join(groups, ["digest", "fp"])  # the rows of one text are dealt out anew where they are many
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)
    sha = F.lower(F.hex("digest")).alias("text_sha256")
    out = cut(met.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), sha, "fp"))
    t.close()
    return out


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of docs that stay, with their columns as they were."""
    groups = cut(groups_of(docs, id_col, text_col, salts))
    pair = lambda digest, fp: F.concat_ws(":", F.hex(digest), fp.cast("string"))
    norm = _norm(docs, text_col)
    stay = groups.select(pair(F.col("digest"), F.col("fp")).alias("key"), F.col("keep_id").alias("id"))
    return keep_rows(docs, pair(F.unhex(F.sha2(norm, 256)), F.xxhash64(norm)), id_col, stay)
