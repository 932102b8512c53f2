"""Bounded, deterministic samples of labelled documents, and fold arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids have no fold."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, bytes, y)``: at most ``limit`` labelled documents outside the held-out fold.

    Labels are taken in the order of a hash of their id, so the sample is the same on every run
    and spread over the corpus.  Null labels are left out; repeated labels of an id that agree
    count once, and ids whose labels disagree are left out.  What is broadcast is the ids of the
    sample, at most ``limit`` of them.
    """
    own = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (fold(F.col(id_col), folds) != held_out))
    own = own.groupBy(F.col(id_col).alias("_id")).agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("_top"))
    own = own.filter("y = _top").select("_id", "y").orderBy(F.xxhash64("_id"), "_id").limit(limit)
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), raw.alias("raw"))
    return rows.join(F.broadcast(own), F.col("id") == F.col("_id")).select("id", "raw", "y")
