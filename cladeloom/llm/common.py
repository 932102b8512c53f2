"""Shared helpers: scratch tables in the cluster's shared folder, table readers."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir`` where the cluster names one.  Where it is unset, a
    single-machine session gets a folder below the temp folder and any other session one
    below the warehouse.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return _with_scheme(spark, named.rstrip("/"))
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        root = f"file://{tempfile.gettempdir()}/cladeloom-shared"
    else:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_cladeloom"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return _with_scheme(spark, root)


def _with_scheme(spark: SparkSession, path: str) -> str:
    """A path without a scheme is on the default file system; Python's readers need it named."""
    if "://" not in path:
        sc = spark.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        path = where.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


# A written table is never computed again, so what its plan shuffled goes when it is there.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Rows go to Python in batches of so many bytes, however wide they are.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextlib.contextmanager
def _held(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Scratch:
    """A folder of written tables in the shared folder.

    A written table cuts lineage the way ``checkpoint()`` does, survives lost executors, and is
    compressed and columnar.  A folder goes when no plan reads its tables any more: every plan over
    a table holds that table's file index, which is watched by a weak reference in the JVM, and
    folders without a living index are removed whenever a new one is made.  What is left then goes
    when the application ends.
    """

    _kept: list[Scratch] = []

    def __init__(self, spark: SparkSession, label: str = "t", batch: str | None = None):
        """``batch``: the most bytes that a batch of rows for Python has while a table is written."""
        Scratch._sweep(spark)
        self.spark = spark
        self.settings = {TIDY: "true"} | ({BATCH: batch} if batch else {})
        self.path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.open = True
        self._watched: list = []
        self._app = spark.sparkContext.applicationId
        Scratch._kept.append(self)

    @classmethod
    def _sweep(cls, spark: SparkSession) -> None:
        app, left = spark.sparkContext.applicationId, []
        for s in cls._kept:
            if s._app != app:
                continue
            if s.open or any(w.get() is not None for w in s._watched):
                left.append(s)
            else:
                _delete(spark, s.path)
        cls._kept = left

    def table(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """``df``, written and reread; with ``by``, a folder per value of that last column.

        The shuffle files of the plan go once the table is written."""
        at = f"{self.path}/{name}"
        writer = df.write.option("compression", "zstd")
        with _held(self.spark, self.settings):
            (writer.partitionBy(by) if by else writer).parquet(at)
        sc = self.spark.sparkContext
        folder = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(folder)
        out = self.spark.read.schema(df.schema).parquet(at)
        index = out._jdf.queryExecution().analyzed().relation().location()
        self._watched.append(self.spark.sparkContext._jvm.java.lang.ref.WeakReference(index))
        return out

    def drop(self, *names: str) -> None:
        """Remove tables that no plan will read again."""
        for name in names:
            _delete(self.spark, f"{self.path}/{name}")

    def close(self, df: DataFrame) -> DataFrame:
        """No more tables will be written; returns ``df``, the result."""
        self.open = False
        return df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def with_bytes(df: DataFrame, text: str = "text", name: str = "_bytes") -> DataFrame:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return df.withColumn(name, F.coalesce(F.col(text), F.lit("")).cast("binary"))


def spread(df: DataFrame, tasks_per_slot: int = 1) -> DataFrame:
    """Deal rows over at least as many tasks as there are slots; a no-op on wide inputs."""
    slots = df.sparkSession.sparkContext.defaultParallelism * tasks_per_slot
    return df if df.rdd.getNumPartitions() >= slots else df.repartition(slots)
