"""Text files under given names, as a Spark data sink that commits.

``df.write.format("named_text")`` takes rows ``(file, value)``; a task writes what it has of a file to a
place of its own attempt, and only when all tasks are done are the files that finished attempts named
moved to their names.  So a retried, speculative or failed task leaves nothing behind, and an output is
there whole or not at all.  ``write`` brings a file's rows together and in order.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    attempt: str
    files: list[str]


class NamedWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.root = path if "://" in path or path.startswith("file:") else f"file://{path}"
        self.job = uuid.uuid4().hex

    def _store(self) -> tuple[pafs.FileSystem, str]:
        store, at = pafs.FileSystem.from_uri(self.root)
        return store, at.rstrip("/")

    def write(self, iterator: Iterator) -> Written:
        store, at = self._store()
        attempt, files, name, out = uuid.uuid4().hex, [], None, None
        try:
            for row in iterator:
                if row["file"] != name:
                    if out:
                        out.close()
                    name = row["file"]
                    if name in files or not name or name.startswith("/") or ".." in name.split("/"):
                        raise ValueError(f"rows of {name!r} are not together, or it is no name below the folder")
                    files.append(name)
                    place = f"{at}/_writing-{self.job}/{attempt}/{name}"
                    store.create_dir(place.rsplit("/", 1)[0], recursive=True)
                    out = store.open_output_stream(place, compression="gzip" if name.endswith(".gz") else None)
                if row["value"] is not None:
                    out.write(f"{row['value']}\n".encode())
        finally:
            if out:
                out.close()
        return Written(attempt, files)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = self._store()
        named = [(m.attempt, f) for m in messages if m for f in m.files]
        if len({f for _, f in named}) < len(named):
            self.abort(messages)
            raise ValueError("two tasks wrote one file")
        for attempt, f in named:
            store.create_dir(f"{at}/{f}".rsplit("/", 1)[0], recursive=True)
            if store.get_file_info(f"{at}/{f}").type != pafs.FileType.NotFound:
                store.delete_file(f"{at}/{f}")
            store.move(f"{at}/_writing-{self.job}/{attempt}/{f}", f"{at}/{f}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, at = self._store()
        if store.get_file_info(f"{at}/_writing-{self.job}").type == pafs.FileType.Directory:
            store.delete_dir(f"{at}/_writing-{self.job}")


class NamedSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_text"

    def schema(self) -> str:
        return "file string, value string"

    def writer(self, schema, overwrite: bool) -> NamedWriter:
        return NamedWriter(self.options["path"])


def write(df: DataFrame, path: str, file: Column, value: Column, *order: str | Column) -> None:
    """The lines ``value`` of each ``file`` below ``path``, in ``order``; a null value only makes the file.

    A file is one task's, so it is as large as a task can write; files that exist are replaced.
    """
    df.sparkSession.dataSource.register(NamedSink)
    rows = df.select(file.alias("file"), value.alias("value"), *(F.col(c) if isinstance(c, str) else c for c in order))
    keys = [f"_o{k}" for k in range(len(order))]
    rows = rows.toDF("file", "value", *keys).repartition("file").sortWithinPartitions("file", *keys)
    rows.select("file", "value").write.format("named_text").mode("append").save(path)


def fasta_record(name: Column, seq: Column) -> Column:
    return F.concat(F.lit(">"), name.cast("string"), F.lit("\n"), F.coalesce(seq, F.lit("")))


def gene_files(members: DataFrame, ids: DataFrame, path: str) -> None:
    """``gene_<id>.fa`` for every ``gene_id`` of ``ids``, empty where a gene has no family."""
    rows = ids.select("gene_id").distinct().join(members.select("gene_id", "species", "copy", "seq"), "gene_id", "left")
    record = F.when(F.col("species").isNotNull(), fasta_record(F.concat_ws("_", "species", "copy"), F.col("seq")))
    write(rows, path, F.concat(F.lit("gene_"), "gene_id", F.lit(".fa")), record, "species", "copy")


def maf_files(hits: DataFrame, path: str, *order: str) -> None:
    """``<species>.maf`` of hits ``(species, gene_id, score, pos, strand, target, seq)``, one block each."""
    size = lambda c: F.length(F.replace(F.col(c), F.lit("-"), F.lit(""))).cast("string")
    text = lambda *parts: F.concat_ws(" ", *parts)
    target = text(F.lit("s"), "species", F.col("pos").cast("string"), size("target"), F.lit("+"), F.lit("0"), "target")
    query = text(F.lit("s"), F.concat(F.lit("gene_"), "gene_id"), F.lit("0"), size("seq"), "strand", size("seq"), "seq")
    block = F.concat(F.lit("a score="), F.col("score").cast("string"), F.lit("\n"), target, F.lit("\n"), query, F.lit("\n"))
    write(hits, path, F.concat("species", F.lit(".maf")), block, *order)


def lines(df: DataFrame, path: str, name: str, value: Column, *order: str) -> None:
    """One file of lines, such as a list of trees."""
    write(df, path, F.lit(name), value, *order)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NamedSink)
