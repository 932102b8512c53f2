"""Small text tables: Newick lists, branch statistics, job timings, matrices, configuration."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions.dna import SPACED


def newick(spark: SparkSession, path: str) -> DataFrame:
    """``(tree_id, newick)``: one tree per line, or ``id, tree``; blank trees are left out.

    Lines without an id are numbered from 1 within their file, which is read as a whole.
    """
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    rows = rows.filter(F.trim("line") != "")
    given = F.regexp_extract("line", r"^\s*(\d+)\s*,\s*\(", 1)
    tree = F.regexp_replace("line", r"^\s*\d+\s*,\s*", "")
    return rows.select(F.coalesce(F.when(given != "", given.cast("int")), F.col("line_no") + 1).alias("tree_id"), tree.alias("newick")).filter(F.col("newick").contains("("))


@udtf(returnType="node_id int, parent_id int, name string, length double, support double, tips array<string>, last int")
class NewickNodes:
    """``SELECT ... FROM trees, LATERAL newick_nodes(newick)``."""

    def eval(self, text: str):
        from cladeloom.functions import trees

        if text and text.strip():
            yield from trees.node_rows(trees.parse(text))


def register(spark: SparkSession) -> None:
    """Make ``newick_nodes`` known to SQL."""
    spark.udtf.register("newick_nodes", NewickNodes)


def branch_stats(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, cols, support)`` of tab-separated lines; the third field is the support."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line")).filter(F.trim("line") != "")
    cols = F.split("line", "\t")
    return rows.select(F.col("line_no").cast("long").alias("line_no"), cols.alias("cols"), F.expr("try_cast(get(split(line, '\t'), 2) as double)").alias("support"))


def job_timings(spark: SparkSession, path: str) -> DataFrame:
    """``(step, job, wall_min, cpu_min)`` of files ``<job>.<step>.txt``: a header line and one row,
    seconds first, CPU seconds last.  Files without a second line, or with NA, are left out."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1))
    second = F.get(F.split("value", "\r?\n"), 1)
    cols = F.split(F.trim(second), r"\s+")
    out = rows.select(
        F.substring_index("file", ".", -1).alias("step"), F.regexp_replace("file", r"\.[^.]*$", "").alias("job"),
        F.get(cols, 0).alias("w"), F.element_at(cols, -1).alias("c"),
    )
    out = out.select("step", "job", (F.expr("try_cast(w as double)") / 60).alias("wall_min"), (F.expr("try_cast(c as double)") / 60).alias("cpu_min"))
    return out.filter("wall_min is not null and cpu_min is not null")


def newest(spark: SparkSession, path: str, pattern: str = "*") -> str | None:
    """The file of a folder that was changed last; of several, the last by name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "modificationTime")
    row = files.orderBy(F.desc("modificationTime"), F.desc("path")).first()
    return row["path"] if row else None


def matrix(text: str) -> list[list[int]]:
    """A 4 x 4 scoring matrix, with or without a header of bases."""
    rows = [line.split() for line in text.splitlines() if line.strip() and not line.startswith("#")]
    if rows and all(x.isalpha() for x in rows[0]):
        rows = rows[1:]
    out = [[int(x) for x in (r[1:] if r[0].isalpha() else r)] for r in rows]
    if len(out) != 4 or any(len(r) != 4 for r in out):
        raise ValueError("a scoring matrix has four rows of four numbers")
    return out


@dataclass(frozen=True)
class Config:
    """Run parameters.  A config is never written back: a loop that needs more genes makes a new
    one with ``grown``."""

    genomes: str = ""
    reference: str | None = None
    length: int = 500
    gene_count: int = 250
    upper_case: float = 0.9
    out_dir: str = "output_files"
    all_out_dir: str = "converge_files"
    identity: int = 65
    identity_deep: int = 40
    coverage: int = 85
    continuity: int = 85
    max_dup: int = 10
    steps: int = 1
    filter_fragments: float = 0.5
    mask_sites: float = 0.02
    support_threshold: float = 0.95
    num_instances: int = 4
    scores: str | None = None
    matrix: tuple | None = None  # what the file ``scores`` names holds
    min_align: int | None = None
    mode: str = "accurate"
    deep: bool = False
    seed: int = 0
    seed_length: int = 12
    seed_pattern: str = ""
    segment_score: int = 2000
    segment_drop: int = 910

    def __post_init__(self):
        if self.mode not in ("accurate", "balanced", "fast"):
            raise ValueError(f"unknown mode {self.mode!r}")
        for name in ("length", "gene_count", "max_dup", "steps", "seed_length"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")
        for name in ("upper_case", "filter_fragments", "mask_sites", "support_threshold"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must be between 0 and 1")

    @property
    def pattern(self) -> str:
        """The given seed pattern; else the spaced one for seeds of 12 bases, and bases in a row for others."""
        return self.seed_pattern or (SPACED if self.seed_length == 12 else "1" * self.seed_length)

    def min_species(self, species: int) -> int:
        """Given, or a tenth of the species, rounded up, and at least 4."""
        return self.min_align if self.min_align is not None else max(4, -(-species // 10))

    def grown(self) -> Config:
        return replace(self, gene_count=2 * self.gene_count)


def config(text: str, **given) -> Config:
    """A flat ``KEY: value`` file; unknown keys are ignored, given values win."""
    known = {f.name: f for f in fields(Config)}
    out: dict = {}
    for line in text.splitlines():
        key, colon, value = line.split("#", 1)[0].partition(":")
        name, value = key.strip().lower(), value.strip().strip("'\"")
        if not colon or name not in known or name == "matrix" or value == "":
            continue
        if value.upper() == "NULL":
            out[name] = None
            continue
        kind = str(known[name].type)
        if "bool" in kind:
            out[name] = value.lower() == "true"
        elif kind.startswith("int"):
            out[name] = int(value)
        elif kind.startswith("float"):
            out[name] = float(value)
        else:
            out[name] = value
    return Config(**{**out, **given})
