"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the
columns of ``docs``.  A stage's result is written as Parquet and reread as the next one's input.

1. quality classifier: documents that it rejects go; the model is trained on labelled documents
   of its input;
2. line dedup: later copies and near copies of a line are cut out of the text, and ``n_chars``
   follows; a document of which nothing is left stays as an empty text;
3. near-dedup: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more
   are linked; the document with the smallest id of each group stays;
4. benchmark decontamination: documents that hold a benchmark passage go;
5. packing: pieces of sequences of 4096 tokens.

Defined cases are those of the operators.  An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeloom.llm import decontaminate, line_dedup, near_dedup, packing, quality
from cladeloom.llm.common import Scratch, read


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.length("text").cast(kind))
    return out


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", quality_filter),
    ("line_dedup", dedup_lines),
    ("simhash", dedup_near),
    ("decontaminate", decontaminate_benchmark),
    ("packing", pack),
]

# A trained classifier and retrieval order are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    out = STAGES[-1][1](spark, docs, sf_dir)
    return scratch.close(out)
