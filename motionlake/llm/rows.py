"""Rows that stay, found by key and id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_rows(docs: DataFrame, key: Column, id_col: str, stay: DataFrame) -> DataFrame:
    """The rows of docs whose key and id are in stay, one of each, with their columns as they were. Rows are moved once at most."""
    own = ["__key", "__id", "__no_id"]  # never null, so that join and deduplication take the same partitioning
    marks = lambda k, i: [k.alias("__key"), F.coalesce(i.cast("string"), F.lit("")).alias("__id"), i.isNull().alias("__no_id")]
    rows = docs.select("*", *marks(key, docs[id_col]))
    met = rows.join(stay.select(*marks(stay["key"], stay["id"])), own, "left_semi")
    return met.dropDuplicates(own).drop(*own)
