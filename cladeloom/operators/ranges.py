"""Prefix sums and range joins that hold when one group has a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 4096
BIN = 1 << 16


def prefix_sum(df: DataFrame, group: str, order: str, value: str, name: str = "lo", block: int = BLOCK) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of ``group`` before this one.

    ``order`` is a whole number, unique within its group.  Sums are taken per block of ``block``
    numbers (a map-side combined aggregate), then over the blocks, then within a block, so no task
    sorts a whole group of rows; only block totals of a group meet in one task.
    """
    b = F.floor(F.col(order) / block).cast("long")
    totals = df.groupBy(group, b.alias("_b")).agg(F.sum(value).alias("_t"))
    w = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_base", F.coalesce(F.sum("_t").over(w), F.lit(0))).drop("_t")
    inner = Window.partitionBy(group, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_b", b).join(totals, [group, "_b"])
    return rows.withColumn(name, (F.col("_base") + F.coalesce(F.sum(value).over(inner), F.lit(0))).cast("long")).drop("_b", "_base")


def locate(points: DataFrame, spans: DataFrame, group: str, point: str = "off", lo: str = "lo", hi: str = "hi", width: int = BIN, few: bool = False) -> DataFrame:
    """Inner join of points with the half-open spans that hold them, within ``group``.

    Spans are dealt over the bins they touch and points over their own bin, which makes it an
    equi-join on (group, bin): the rows of a large group spread over many keys.  ``few`` points go to
    all tasks.
    """
    left = points.withColumn("_bin", F.floor(F.col(point) / width).cast("long"))
    touched = F.sequence(F.floor(F.col(lo) / width).cast("long"), F.floor((F.col(hi) - 1) / width).cast("long"))
    right = spans.filter(F.col(hi) > F.col(lo)).withColumn("_bin", F.explode(touched))
    left = F.broadcast(left) if few else left
    return left.join(right, [group, "_bin"]).filter((F.col(point) >= F.col(lo)) & (F.col(point) < F.col(hi))).drop("_bin")
