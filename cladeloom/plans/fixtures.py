"""Tables of the engine's shapes, derived from the star-schema test tables, in Spark and in SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Letters and digits become nucleotides: A C G T in turn for letters, N for digits.
SRC = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
DST = ("ACGT" * 7)[:26] + ("acgt" * 7)[:26] + "N" * 10


_TO = bytes.maketrans(SRC.encode(), DST.encode())
_GONE = bytes(set(range(256)) - set(SRC.encode()))


def _bases(text: pa.Array) -> pa.Array:
    """Letters and digits as nucleotides, in one walk over the bytes; all else goes."""
    own = [x if x is None else x.translate(_TO, _GONE) for x in text.cast(pa.binary()).to_pylist()]
    return pa.array(own, pa.binary()).cast(pa.string())


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("species"), F.col("doc_id").alias("rec"), F.arrow_udf(_bases, "string")("text").alias("seq"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem")
    line = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    dna = F.translate(F.md5(line.cast("string").cast("binary")), "0123456789abcdef", "ACGTACGTACGTacg-")
    return li.select(
        F.concat(F.lit("sp_"), (F.col("l_suppkey") % 20).cast("string")).alias("species"),
        (F.col("l_partkey") % 250 + 1).cast("int").alias("gene_id"),
        F.floor("l_extendedprice").cast("long").alias("score"),
        line.cast("long").alias("line_no"),
        ((F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 100000).cast("long").alias("pos"),
        F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("strand"),
        F.concat(dna, F.when(F.col("l_linenumber") == 7, "N").otherwise("")).alias("seq"),
    )


def branch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("line_no"), ((F.col("o_custkey") % 101) / F.lit(100.0)).alias("support"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    step = F.when(p == "1-URGENT", "sampling").when(p == "2-HIGH", "align").when(p == "3-MEDIUM", "msa").otherwise("tree")
    price = F.col("o_totalprice").cast("double")
    return _table(spark, sf_dir, "orders").select(step.alias("step"), F.col("o_orderkey").cast("string").alias("job"), F.round(price / 60, 6).alias("wall_min"), F.round(price * F.lit(0.8) / 60, 6).alias("cpu_min"))


def iterations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").alias("iteration"))
    return e.agg(F.round(F.lit(100.0) * F.sum(F.when(F.col("value") >= 50, 1).otherwise(0)) / F.count("*"), 6).alias("pct")).select(F.date_format("iteration", "yyyy-MM-dd").alias("iteration"), "pct")


TIPS = 20  # species of the hits


def tree_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(t, r, tip)``: a caterpillar per gene over the species that hit it, best first."""
    from pyspark.sql.window import Window

    best = hits(spark, sf_dir).groupBy(F.col("gene_id").alias("t"), "species").agg(F.max("score").alias("score"))
    tip = F.concat("species", F.lit("_"), (F.substring_index("species", "_", -1).cast("int") % 3).cast("string"))
    return best.select("t", tip.alias("tip"), F.row_number().over(Window.partitionBy("t").orderBy(F.desc("score"), "species")).alias("r"))


def newicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(tree_id, newick)``: the caterpillars as text, nested from the first tip outwards."""
    listed = tree_order(spark, sf_dir).groupBy("t").agg(F.array_sort(F.collect_list(F.struct("r", F.col("tip").alias("n")))).alias("l"))
    body = F.aggregate(F.slice("l", 2, TIPS), F.col("l")[0]["n"], lambda acc, x: F.concat(F.lit("("), acc, F.lit(","), x["n"], F.lit(")")))
    return listed.select(F.col("t").alias("tree_id"), F.concat(body, F.lit(";")).alias("newick"))


GENOME_SQL = f"genome AS (SELECT source AS species, doc_id AS rec, translate(regexp_replace(text, '[^A-Za-z0-9]', '', 'g'), '{SRC}', '{DST}') AS seq FROM documents)"
HITS_SQL = """hits AS (
  SELECT 'sp_' || cast(l_suppkey % 20 AS varchar) AS species, cast(l_partkey % 250 + 1 AS int) AS gene_id,
         cast(floor(l_extendedprice) AS bigint) AS score, cast(l_orderkey * 8 + l_linenumber AS bigint) AS line_no,
         cast((l_orderkey * 7919 + l_linenumber * 104729) % 100000 AS bigint) AS pos,
         CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand,
         translate(md5(cast(l_orderkey * 8 + l_linenumber AS varchar)), '0123456789abcdef', 'ACGTACGTACGTacg-') || CASE WHEN l_linenumber = 7 THEN 'N' ELSE '' END AS seq
  FROM lineitem)"""
STATS_SQL = "stats AS (SELECT cast(o_orderkey AS bigint) AS line_no, (o_custkey % 101) / cast(100 AS double) AS support FROM orders)"
JOBS_SQL = """jobs AS (
  SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'sampling' WHEN '2-HIGH' THEN 'align' WHEN '3-MEDIUM' THEN 'msa' ELSE 'tree' END AS step,
         cast(o_orderkey AS varchar) AS job, round(cast(o_totalprice AS double) / 60, 6) AS wall_min, round(cast(o_totalprice AS double) * cast(0.8 AS double) / 60, 6) AS cpu_min FROM orders)"""
ITERATIONS_SQL = """iterations AS (
  SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS iteration, round(cast(100 AS double) * sum(CASE WHEN value >= 50 THEN 1 ELSE 0 END) / count(*), 6) AS pct FROM events GROUP BY 1)"""
TREES_SQL = f"""{HITS_SQL}, best AS (SELECT gene_id AS t, species, max(score) AS score FROM hits GROUP BY ALL),
ordered AS (SELECT t, species || '_' || cast(cast(split_part(species, '_', 2) AS int) % 3 AS varchar) AS tip,
                   row_number() OVER (PARTITION BY t ORDER BY score DESC, species) AS r, count(*) OVER (PARTITION BY t) AS n FROM best)"""
