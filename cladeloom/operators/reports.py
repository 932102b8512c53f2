"""Support, convergence and job reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.storage import settle
from .ranges import prefix_sum


def support_percent(stats: DataFrame, threshold: float) -> DataFrame:
    """Percent of branches whose first topology row has at least ``threshold`` support.

    A branch has three rows, one per topology; ``line_no`` (from 0) is the file's order.  Without
    branches the result is null.
    """
    first = stats.filter(F.col("line_no") % 3 == 0)
    high = F.count_if(F.col("support") >= threshold)
    return first.agg(F.count("*").alias("branches"), high.alias("high"), F.round(F.when(F.count("*") > 0, 100 * high.cast("double") / F.count("*")), 9).alias("percent"))


def deltas(iterations: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Adds the change to the previous iteration and whether it is below ``tolerance``.

    One row per iteration: a handful.
    """
    w = Window.orderBy("iteration")
    change = F.round(F.abs(F.col("pct") - F.lag("pct").over(w)), 6)
    return iterations.select("iteration", "pct", change.alias("delta"), (change < tolerance).alias("settled"))


def stops(number: int, percent: float | None, change: float | None, most: int = 9) -> bool:
    """The convergence loop's rule, after ``number`` iterations."""
    if percent is not None and percent == 100:
        return True
    return number >= 2 and (number >= most or (change is not None and change < 1))


def elapsed(stamps: DataFrame, by: str | None = None, tie: str | None = None) -> DataFrame:
    """Seconds since the start and since the previous stamp, of all stamps or of each ``by``; stamps
    of one time stand in the order of ``tie``."""
    w = Window.partitionBy(*([by] if by else [])).orderBy("ts", *([tie] if tie else []))
    s = F.floor(F.unix_micros("ts") / 1_000_000).cast("long")
    return stamps.select("*", (s - F.first(s).over(w)).alias("since_start"), (s - F.lag(s).over(w)).alias("since_last"))


def text_order(ids: DataFrame, column: str = "id") -> DataFrame:
    """Adds ``place``: where an id stands, from 0, when ids are sorted as text (1, 10, 2).

    A global rank without a global task: rows are dealt by range and counted per range.
    """
    text = ids.withColumn("_t", F.col(column).cast("string"))
    dealt = text.repartitionByRange("_t").sortWithinPartitions("_t").withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id() % (1 << 33))
    rows = settle(dealt)
    before = prefix_sum(rows.groupBy(F.lit(0).alias("_g"), F.col("_p").cast("long").alias("_p")).agg(F.count("*").alias("_n")), "_g", "_p", "_n", "_before").select("_p", "_before")
    return rows.join(F.broadcast(before), "_p").withColumn("place", F.col("_before") + F.col("_k")).drop("_t", "_p", "_k", "_before")


def step_totals(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("step").agg(F.round(F.sum("wall_min"), 4).alias("wall_min"), F.round(F.sum("cpu_min"), 4).alias("cpu_min"), F.count("*").alias("jobs"))


def slowest(jobs: DataFrame, most: int = 50) -> DataFrame:
    """The ``most`` slowest jobs of each step; ties by job name."""
    w = Window.partitionBy("step").orderBy(F.desc("wall_min"), "job")
    return jobs.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= most)


def long_form(jobs: DataFrame) -> DataFrame:
    return jobs.unpivot(["step", "job"], ["wall_min", "cpu_min"], "measure", "minutes")


def accumulated(rows: DataFrame, iteration: str = "iteration") -> DataFrame:
    """``(iteration, added, total)``: rows of each iteration and of all up to it."""
    n = rows.groupBy(F.lit(0).alias("_g"), F.col(iteration).cast("long").alias("iteration")).agg(F.count("*").alias("added"))
    before = prefix_sum(n, "_g", "iteration", "added", "before")
    return before.select("iteration", "added", (F.col("before") + F.col("added")).alias("total"))
