"""Pairwise alignments in MAF text, by line prefix rather than by line number."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .split import SPLIT, maf_lines

SCHEMA = "species string, gene_id int, score bigint, line_no bigint, pos bigint, strand string, target string, seq string"


def blocks(lines: Iterator[str]) -> Iterator[tuple]:
    """``(gene, score, line number, target start, query strand, target, query)`` of each block with
    a target and a query row.  ``line number`` (from 0) is that of the target row."""
    score, rows, at = None, [], 0
    for k, line in enumerate([*lines, ""]):
        part = line.split()
        if part and part[0] == "a":
            score, rows = int(dict(x.split("=", 1) for x in part[1:] if "=" in x).get("score", 0)), []
        elif part and part[0] == "s" and len(part) >= 7:
            if not rows:
                at = k
            rows.append(part)
            if len(rows) == 2 and score is not None:
                target, query = rows
                yield query[1], score, at, int(target[2]), query[4], target[6], query[6]
                score = None


FILES = re.compile(r"\.maf[^/]*$")


def read(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """All ``.maf`` files of a folder; the species is the file's stem.

    Files are read in byte ranges (``sources.split``); a block is that range's in which its first line
    begins.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for frame in frames:
            rows = []
            for file, first, text in zip(frame["path"], frame["first"], frame["text"]):
                species = FILES.sub("", file.rsplit("/", 1)[-1])
                for gene, score, at, *rest in blocks(text.split("\n")):
                    rows.append((species, int(gene.rsplit("_", 1)[-1]), score, first + at, *rest))
            yield pd.DataFrame(rows, columns=names)

    return maf_lines(spark, path, FILES, split).mapInPandas(run, SCHEMA)
