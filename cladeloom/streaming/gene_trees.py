"""Gene trees as a stream: new Newick files are folded into the master table as they arrive.

The convergence loop appends its rounds as batches; this is the same append for trees that come from
elsewhere.  A file is read once, each micro-batch is written under its own number, and a batch that is
run again after a failure overwrites what it wrote, so the table holds every tree exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """``(newick, arrived)``: lines that hold a tree."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    tree = F.regexp_replace("value", r"^\s*\d+\s*,\s*", "")
    return lines.select(tree.alias("newick"), F.current_timestamp().alias("arrived")).filter(F.col("newick").contains("("))


def accumulate(trees: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Start the append; it stops when everything there has been read."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return trees.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(trees: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Trees per window of arrival; state for windows behind the watermark is dropped."""
    return trees.withWatermark("arrived", late).groupBy(F.window("arrived", window)).agg(F.count("*").alias("n")).select("window.start", "window.end", "n")
