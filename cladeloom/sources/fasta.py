"""FASTA and FASTQ, plain or gzip, as a Spark data source, and their writer.

``spark.read.format("fasta").load(folder)`` gives one row per record; with the options ``chunk`` and
``overlap`` of the format ``fasta_chunks``, records of any length come as rows of bounded size, and a
task holds one of them.  Every file is a partition there; ``read_chunks`` splits files (``sources.split``).  Files are listed and opened with ``pyarrow.fs`` by URI, so any store that it
reaches will do.  Writing gives one file per partition and ``species`` value.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .split import SPLIT, fasta_chunks

SCHEMA = "species string, rec_idx bigint, name string, comment string, seq string, qual string, is_fastq boolean, len bigint"
SUFFIX = re.compile(r"\.(fa|fasta|fna|fq|fastq)(\.gz)?$")


class BadRecord(ValueError):
    """A FASTQ record whose qualities don't match its bases."""


def records(lines: Iterator[str]) -> Iterator[tuple[str, str, str, str | None]]:
    """``(name, comment, seq, qual)``; qual is None for FASTA.

    A name ends at the first blank; the rest of the line is the comment.  Blank lines and carriage
    returns are dropped.  After a ``+`` line qualities are read until they are as long as the bases.
    """
    name = comment = None
    seq: list[str] = []
    it = iter(lines)
    pushed: str | None = None
    while True:
        line = pushed if pushed is not None else next(it, None)
        pushed = None
        line = line if line is None else line.rstrip("\r\n")
        if line is None or (line[:1] in (">", "@")):
            if name is not None:
                yield name, comment, "".join(seq), None
            if line is None:
                return
            head = line[1:].split(None, 1)
            name, comment, seq = (head[0] if head and not line[1:2].isspace() else ""), (head[1] if len(head) > 1 else ""), []
        elif line[:1] == "+" and name is not None:
            want, qual = sum(map(len, seq)), ""
            while len(qual) < want:
                more = next(it, None)
                if more is None:
                    break
                qual += more.rstrip("\r\n")
            if len(qual) != want:
                raise BadRecord(f"{name}: {len(qual)} qualities for {want} bases")
            yield name, comment, "".join(seq), qual
            name, seq = None, []
            # skip to the next header
            for more in it:
                if more[:1] in (">", "@"):
                    pushed = more
                    break
            else:
                return
        elif name is not None:
            seq.append(line.strip())


@dataclass
class File(InputPartition):
    path: str
    root: str


class FastaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path", "")
        self.wanted = FASTQ if options.get("only") == "fastq" else SUFFIX

    def partitions(self) -> list[File]:
        uri = self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}"
        store, at = pafs.FileSystem.from_uri(uri)
        info = store.get_file_info(at)
        found = [info] if info.type == pafs.FileType.File else store.get_file_info(pafs.FileSelector(at, recursive=True))
        own = sorted(x.path for x in found if x.type == pafs.FileType.File and self.wanted.search(x.path))
        return [File(p, uri) for p in own]

    def read(self, partition: File | None) -> Iterator[tuple]:
        if partition is None:  # no file
            return
        store, _ = pafs.FileSystem.from_uri(partition.root)
        compression = "gzip" if partition.path.endswith(".gz") else None
        species = SUFFIX.sub("", partition.path.rsplit("/", 1)[-1])
        with store.open_input_stream(partition.path, compression=compression) as raw:
            for k, (name, comment, seq, qual) in enumerate(records(io.TextIOWrapper(raw, "utf-8", newline="\n"))):
                yield species, k, name, comment, seq, qual, qual is not None, len(seq)


class FastaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastaReader:
        return FastaReader(self.options)


CHUNK_SCHEMA = "species string, rec_idx bigint, name string, start bigint, own bigint, seq string"
PART = 1 << 16


def chunks(parts: Iterator[str], size: int, overlap: int) -> Iterator[tuple[int, str, int, int, str]]:
    """``(record, name, start, own, seq)`` of FASTA text that comes in parts of lines: a line may be
    cut anywhere, as long as its end still ends a part."""
    record, name, start, held, line_goes_on, head = -1, "", 0, "", False, ""

    def cut(last: bool) -> Iterator[tuple[int, str, int, int, str]]:
        nonlocal start, held
        while len(held) >= size + overlap or last and held:
            own = min(size, len(held))
            yield record, name, start, own, held[: size + overlap]
            start, held = start + own, held[own:]

    for part in parts:
        if not line_goes_on:
            head = part[:1] if part[:1] == ">" else ""
            if head:
                yield from cut(True)
                record, name, start = record + 1, "", 0
        if head:
            name += part
        elif record >= 0:
            held += "".join(part.split())
            yield from cut(False)
        line_goes_on = not part.endswith("\n")
        if head and not line_goes_on:
            name = (name[1:].split(None, 1) or [""])[0] if not name[1:2].isspace() else ""
    yield from cut(True)


class ChunkReader(FastaReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.size, self.overlap = int(options["chunk"]), int(options["overlap"])

    def read(self, partition: File | None) -> Iterator[tuple]:
        if partition is None:  # no file
            return
        store, _ = pafs.FileSystem.from_uri(partition.root)
        plain, gzipped = partition.path.removesuffix(".gz"), partition.path.endswith(".gz")
        species = SUFFIX.sub("", partition.path.rsplit("/", 1)[-1])
        with store.open_input_stream(partition.path, compression="gzip" if gzipped else None) as raw:
            text = io.TextIOWrapper(raw, "utf-8", newline="\n")
            if plain.endswith((".fq", ".fastq")):  # reads are short
                for k, (name, _, seq, _) in enumerate(records(text)):
                    for at in range(0, len(seq), self.size):
                        yield species, k, name, at, min(self.size, len(seq) - at), seq[at : at + self.size + self.overlap]
            else:
                for k, name, start, own, seq in chunks(iter(lambda: text.readline(PART), ""), self.size, self.overlap):
                    yield species, k, name, start, own, seq


class ChunkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta_chunks"

    def schema(self) -> str:
        return CHUNK_SCHEMA

    def reader(self, schema) -> ChunkReader:
        return ChunkReader(self.options)


def read(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(FastaSource)
    return spark.read.format("fasta").load(path)


def read_genomes(spark: SparkSession, path: str) -> DataFrame:
    """``(species, rec, seq)`` of a folder of genomes."""
    return read(spark, path).select("species", F.col("rec_idx").alias("rec"), "seq")


FASTA = re.compile(r"\.(fa|fasta|fna)(\.gz)?$")
FASTQ = re.compile(r"\.(fq|fastq)(\.gz)?$")


def read_chunks(spark: SparkSession, path: str, overlap: int, size: int = 1 << 16, split: int = SPLIT) -> DataFrame:
    """``(species, rec, start, own, seq)`` of a folder of genomes; see ``operators.chunks``.

    FASTA files are read in byte ranges of ``split``; FASTQ files, whose lines can't be told apart from
    the middle, one a task.
    """
    spark.dataSource.register(ChunkSource)
    rows = fasta_chunks(spark, path, FASTA, size, overlap, split)
    reads = spark.read.format("fasta_chunks").option("chunk", size).option("overlap", overlap).option("only", "fastq").load(path)
    rows = rows.unionByName(reads.select(*rows.columns))
    return rows.select("species", F.col("rec_idx").alias("rec"), "start", "own", "seq")


def write(df: DataFrame, path: str, header: str = "name", seq: str = "seq", by: str | None = None, compression: str = "none") -> None:
    """Text files of FASTA records.

    Each record is one row of Spark's text writer, so this works on any file system Spark writes.
    With ``by``, a folder per value.
    """
    text = F.concat(F.lit(">"), F.col(header).cast("string"), F.lit("\n"), F.coalesce(F.col(seq), F.lit("")))
    out = df.select(*([by] if by else []), text.alias("value"))
    writer = out.write.option("compression", compression).mode("overwrite")
    (writer.partitionBy(by) if by else writer).text(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """``(name, comment, seq)`` of FASTA text written by ``write``, in any store Spark reads.

    Records are split on their header sign by the text reader, so large files are split over tasks.
    """
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("v")).filter(F.trim("v") != "")
    head = F.regexp_replace(F.substring_index("v", "\n", 1), "\r", "")
    body = F.regexp_replace(F.regexp_replace("v", "^[^\n]*\n?", ""), r"\s", "")
    return rows.select(F.substring_index(head, " ", 1).alias("name"), F.regexp_replace(head, r"^\S*\s*", "").alias("comment"), body.alias("seq"))
