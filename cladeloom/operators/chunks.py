"""Genomes as chunks: records of any length in rows of bounded size.

A chunk row is ``(species, rec, start, own, seq)``: bases ``start`` up to ``start + own`` of a record,
and in ``seq`` up to ``overlap`` bases more, so that whatever begins in a chunk can be read there.
Every chunk but a record's last has ``SIZE`` bases of its own, so a position's chunk is known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 1 << 16


def is_chunked(genome: DataFrame) -> bool:
    return {"start", "own"} <= set(genome.columns)


def chunked(genome: DataFrame, overlap: int, size: int = SIZE) -> DataFrame:
    """Chunks of a table of whole records ``(species, rec, seq)``; a table of chunks is returned as it
    is (its source must have been given the overlap).  Records without bases have no chunk."""
    if is_chunked(genome):
        return genome
    # bytes are cut in place; a string would be walked from its beginning for every chunk
    rows = genome.select("species", "rec", F.col("seq").cast("binary").alias("_b"), F.octet_length("seq").cast("long").alias("_n"))
    # an outer explosion, as a filter on the length would be pushed below and make the sequences twice
    starts = F.when(F.col("_n") > 0, F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(size).cast("long")))
    rows = rows.select("species", "rec", "_b", "_n", F.explode_outer(starts).alias("start")).filter("start is not null")
    own = F.least(F.lit(size).cast("long"), F.col("_n") - F.col("start"))
    return rows.select("species", "rec", "start", own.alias("own"), F.substring("_b", (F.col("start") + 1).cast("int"), F.lit(size + overlap)).cast("string").alias("seq"))


def at(points: DataFrame, chunks: DataFrame, start: str, length: str | int, size: int = SIZE, name: str = "seq", few: bool = False) -> DataFrame:
    """Adds to ``points`` (species, rec, a start) the ``length`` bases from there, by an equi-join on
    the chunk: no row holds more than a chunk, whatever the record's length.

    ``few`` points go to all tasks, and the chunks stay where they are.
    """
    left = points.withColumn("_chunk", F.floor(F.col(start) / size).cast("long"))
    right = chunks.select("species", "rec", F.floor(F.col("start") / size).cast("long").alias("_chunk"), F.col("start").alias("_from"), F.col("seq").alias("_seq"))
    n = F.col(length) if isinstance(length, str) else F.lit(length)
    cut = F.substring("_seq", (F.col(start) - F.col("_from") + 1).cast("int"), n.cast("int"))
    left = F.broadcast(left) if few else left
    return left.join(right, ["species", "rec", "_chunk"]).withColumn(name, cut).drop("_chunk", "_from", "_seq")
