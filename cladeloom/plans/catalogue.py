"""Every query of the engine by name, with DuckDB SQL where SQL can express it.

Thresholds here are those at which an operator has a visible effect on the test tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna
from ..functions.storage import shared_folder
from ..operators import alignments, families, hits, kmer, ranges, reports, sampling, seeds, trees
from ..sources import fasta, maf, named
from . import fixtures as fx
from . import modes

QUERIES: dict = {}
ORACLE_SQL: dict = {}

GENES, LENGTH, MAX_DUP, MIN_SPECIES = 250, 500, 10, 4


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = "WITH RECURSIVE " + sql if not sql.lstrip().upper().startswith(("SELECT", "WITH")) else sql
        return f

    return add


# ------------------------------------------------------------------ SQL pieces

_RANKED = f"{fx.HITS_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY species, gene_id ORDER BY score DESC, line_no DESC, pos DESC) AS rn FROM hits)"
_KEPT = f"""{_RANKED}, listed AS (SELECT species, gene_id, list(pos ORDER BY rn) AS ps FROM ranked GROUP BY ALL),
fold AS (
  SELECT species, gene_id, ps, 1 AS i, cast([] AS bigint[]) AS kept FROM listed
  UNION ALL
  SELECT species, gene_id, ps, i + 1, CASE WHEN len(list_filter(kept, lambda k: abs(ps[i] - k) < 2000)) = 0 THEN list_append(kept, ps[i]) ELSE kept END
  FROM fold WHERE i <= len(ps)
), kept AS (SELECT species, gene_id, kept FROM fold WHERE i = len(ps) + 1)"""
_SELECTED = f"{_KEPT}, selected AS (SELECT r.* FROM ranked r JOIN kept k USING (species, gene_id) WHERE rn <= least(len(kept), {MAX_DUP}))"
_BARE = "replace(seq, '-', '')"
_RC = f"CASE WHEN strand = '-' THEN reverse(translate({_BARE}, '{dna.CODES}', '{dna.COMPLEMENTS}')) ELSE {_BARE} END"
_FAMILY = f"""{_SELECTED}, oriented AS (SELECT gene_id, species, rn - 1 AS copy, {_RC} AS seq FROM selected),
family AS (SELECT * FROM oriented WHERE regexp_full_match(seq, '[ACGTacgt]*'))"""
_BEST = f"{_RANKED}, best AS (SELECT gene_id, species, {_BARE} AS seq FROM ranked WHERE rn = 1)"
_SPANS = f"""{fx.GENOME_SQL}, spans AS (
  SELECT species, rec, cast(length(seq) AS bigint) AS len, cast(coalesce(sum(length(seq)) OVER (PARTITION BY species ORDER BY rec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS lo, seq FROM genome)"""
_POINTS = f"""{_SPANS}, totals AS (SELECT species, cast(sum(len) AS bigint) AS total FROM spans GROUP BY species),
points AS (SELECT species, cast(j AS int) AS j, cast(concat('0x', substring(md5(concat(species, '#', cast(j AS varchar))), 1, 12)) AS bigint) % total AS off FROM totals, range(0, 50) u(j) WHERE total > 0)"""
_WINDOWS = f"""{_POINTS}, windows AS (
  SELECT p.species, p.j, s.rec, p.off - s.lo AS start, substring(s.seq, p.off - s.lo + 1, {LENGTH}) AS seq
  FROM points p JOIN spans s ON p.species = s.species AND p.off >= s.lo AND p.off < s.lo + s.len WHERE p.off - s.lo + {LENGTH} <= s.len)"""


# ------------------------------------------------------------------ genomes and sampling


@query("genome_scan", f"{fx.GENOME_SQL} SELECT species, rec, length(seq) AS len, length(regexp_replace(seq, '[^ACGT]', '', 'g')) AS upper FROM genome")
def genome_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fx.genome(spark, sf_dir)
    return g.select("species", "rec", F.length("seq").cast("long").alias("len"), dna.upper_count(F.col("seq")).cast("long").alias("upper"))


@query("genome_total_length", f"{fx.GENOME_SQL} SELECT species, cast(sum(length(seq)) AS bigint) AS total FROM genome GROUP BY species")
def genome_total_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.genome(spark, sf_dir).groupBy("species").agg(F.sum(F.length("seq").cast("long")).alias("total"))


@query("fasta_roundtrip", f"{fx.GENOME_SQL} SELECT species || '|' || cast(rec AS varchar) AS name, length(seq) AS len, md5(seq) AS digest FROM genome")
def fasta_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "fasta")
    g = fx.genome(spark, sf_dir).select(F.concat_ws("|", "species", "rec").alias("name"), "seq")
    fasta.write(g, path)
    return fasta.read_text(spark, path).select("name", F.length("seq").cast("long").alias("len"), F.md5(F.col("seq").cast("binary")).alias("digest"))


_DRAWS = f"""{fx.GENOME_SQL}, names AS (SELECT species, row_number() OVER (ORDER BY species) - 1 AS k FROM (SELECT DISTINCT species FROM genome)),
draws AS (SELECT cast(concat('0x', substring(md5(concat('0#', cast(id AS varchar))), 1, 12)) AS bigint) % (SELECT count(*) FROM names) AS k, count(*) AS n FROM range(0, {GENES}) r(id) GROUP BY 1),
counts AS (SELECT species, k, coalesce(n, 0) AS draws FROM names LEFT JOIN draws USING (k))"""


@query("genome_files", f"{fx.GENOME_SQL}, g AS (SELECT species, row_number() OVER (PARTITION BY species ORDER BY rec) - 1 AS rec_idx, seq FROM genome) SELECT species, rec_idx, cast(ceil(length(seq) / 4096.0) AS bigint) AS chunks, cast(length(seq) AS bigint) AS len, md5(substring(seq, 1, 4096)) AS first FROM g WHERE length(seq) > 0")
def genome_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The genomes, written as one FASTA file a species and read back in byte ranges of a megabyte."""
    path = shared_folder(spark, "genomes")
    g = fx.genome(spark, sf_dir)
    named.write(g, path, F.concat("species", F.lit(".fa")), named.fasta_record(F.col("rec"), F.col("seq")), "rec")
    rows = fasta.read_chunks(spark, path, 0, 4096, 1 << 20).groupBy("species", F.col("rec").alias("rec_idx"))
    return rows.agg(F.count("*").alias("chunks"), F.sum("own").alias("len"), F.max(F.when(F.col("start") == 0, F.md5(F.col("seq").cast("binary")))).alias("first"))


@query("maf_files", f"{fx.HITS_SQL}, h AS (SELECT *, row_number() OVER (PARTITION BY species ORDER BY line_no, pos, gene_id, score) AS k FROM hits) SELECT species, gene_id, score, 4 * (k - 1) + 1 AS line_no, pos, strand, seq AS target, seq FROM h")
def maf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hits, written as one alignment file a species and read back in byte ranges of a megabyte."""
    path = shared_folder(spark, "maf")
    named.maf_files(fx.hits(spark, sf_dir).withColumn("target", F.col("seq")), path, "line_no", "pos", "gene_id", "score")
    return maf.read(spark, path, 1 << 20)


@query("sample_quota", f"{_DRAWS} SELECT species, draws, cast(coalesce(sum(draws) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS bigint) AS start_id, cast(sum(draws) OVER (ORDER BY k) + 1 AS bigint) AS end_id FROM counts")
def sample_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.quota(fx.genome(spark, sf_dir), GENES)


@query("record_prefix_sum", f"{_SPANS} SELECT species, rec, len, lo, lo + len AS hi FROM spans")
def record_prefix_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.record_spans(fx.genome(spark, sf_dir))


@query("sample_locate", f"{_WINDOWS} SELECT species, j, rec, start, seq FROM windows")
def sample_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fx.genome(spark, sf_dir)
    spans = sampling.record_spans(g)
    return sampling.windows(g, sampling.offsets(spans, 50), LENGTH, spans)


@query("sample_filter", f"{_WINDOWS} SELECT species, j, rec, start, length(regexp_replace(seq, '[^ACGT]', '', 'g')) AS upper FROM windows WHERE regexp_full_match(seq, '[ACGTacgt]*') AND length(regexp_replace(seq, '[^ACGT]', '', 'g')) > 25")
def sample_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = sample_locate(spark, sf_dir).filter(sampling.passes(LENGTH, 0.05))
    return kept.select("species", "j", "rec", "start", dna.upper_count(F.col("seq")).cast("long").alias("upper"))


@query("sample_per_species", f"{_WINDOWS} SELECT species, count(*) AS fragments FROM windows GROUP BY species")
def sample_per_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.fragments_per_species(sample_locate(spark, sf_dir))


@query("sample_union", f"{_WINDOWS} SELECT species, j, seq FROM windows WHERE j < 10 UNION ALL SELECT species, j, seq FROM windows WHERE j >= 40")
def sample_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = sample_locate(spark, sf_dir).select("species", "j", "seq")
    return w.filter("j < 10").unionByName(w.filter("j >= 40"))


_SAMPLED = f"""{_DRAWS}, totals AS (SELECT source AS species, cast(sum(length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g'))) AS bigint) AS total FROM documents GROUP BY source),
quota AS (SELECT species, cast(draws AS bigint) AS draws, cast(coalesce(sum(draws) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS bigint) AS start_id FROM counts),
ids AS (SELECT species, cast(start_id + i AS int) AS gene_id FROM quota, unnest(range(0, draws)) u(i)),
tries AS (SELECT ids.*, t AS try, cast(concat('0x', substring(md5(concat_ws('#', '0', species, gene_id, t)), 1, 12)) AS bigint) % total AS off FROM ids JOIN totals USING (species), range(0, 50) u(t)),
located AS (SELECT gene_id, t.species, try, s.rec, off - lo AS start, substring(s.seq, off - lo + 1, 200) AS seq
            FROM tries t JOIN (SELECT species, rec, cast(length(seq) AS bigint) AS len, cast(coalesce(sum(length(seq)) OVER (PARTITION BY species ORDER BY rec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS lo, seq FROM genome) s
              ON t.species = s.species AND off >= lo AND off < lo + len WHERE off - lo + 200 <= len),
sampled AS (SELECT gene_id, arg_min(struct_pack(rec := rec, start := cast(start AS bigint), seq := seq), try) AS w FROM located
            WHERE regexp_full_match(seq, '[ACGTacgt]*') AND length(regexp_replace(seq, '[^ACGT]', '', 'g')) > 10 GROUP BY gene_id)"""


@query("sample_genes", f"{_SAMPLED} SELECT gene_id, species, w.rec AS rec, w.start AS start, w.seq AS seq FROM ids LEFT JOIN sampled USING (gene_id)")
def sample_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_genes(fx.genome(spark, sf_dir), GENES, 200, 0.05)


# ------------------------------------------------------------------ hits and families


@query("hits_ranked", f"{_RANKED} SELECT species, gene_id, score, line_no, pos, rn FROM ranked WHERE rn <= {MAX_DUP}")
def hits_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits.ranked(fx.hits(spark, sf_dir), MAX_DUP).select("species", "gene_id", "score", "line_no", "pos", F.col("rn").cast("long").alias("rn"))


@query("hits_queryhspbest", f"{_RANKED} SELECT species, gene_id, score, line_no, pos FROM ranked WHERE rn <= 2 * 5")
def hits_queryhspbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits.query_best(fx.hits(spark, sf_dir), 5).select("species", "gene_id", "score", "line_no", "pos")


@query("hits_nms_count", f"{_KEPT} SELECT species, gene_id, len(kept) AS n_kept, list_sum(kept)::bigint AS pos_sum FROM kept")
def hits_nms_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = hits.spacing_kept(fx.hits(spark, sf_dir))
    return k.select("species", "gene_id", F.size("kept").cast("long").alias("n_kept"), F.aggregate("kept", F.lit(0).cast("long"), lambda a, x: a + x).alias("pos_sum"))


@query("hits_selected_compat", f"{_SELECTED} SELECT species, gene_id, score, line_no, pos, rn FROM selected")
def hits_selected_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits.selected(fx.hits(spark, sf_dir), MAX_DUP).select("species", "gene_id", "score", "line_no", "pos", F.col("rn").cast("long").alias("rn"))


@query(
    "hits_selected_spaced",
    f"""{_KEPT}, wanted AS (SELECT species, gene_id, unnest(kept[1:{MAX_DUP}]) AS pos FROM kept),
    met AS (SELECT r.*, row_number() OVER (PARTITION BY species, gene_id, pos ORDER BY rn) AS k FROM ranked r JOIN wanted USING (species, gene_id, pos))
    SELECT species, gene_id, score, line_no, pos, rn FROM met WHERE k = 1""",
)
def hits_selected_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits.selected_spaced(fx.hits(spark, sf_dir), MAX_DUP).select("species", "gene_id", "score", "line_no", "pos", F.col("rn").cast("long").alias("rn"))


@query("hits_revcomp", f"{fx.HITS_SQL} SELECT species, gene_id, line_no, pos, score, {_RC} AS seq FROM hits")
def hits_revcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits.oriented(fx.hits(spark, sf_dir)).select("species", "gene_id", "line_no", "pos", "score", "seq")


@query("hits_alphabet", f"{fx.HITS_SQL}, o AS (SELECT species, gene_id, line_no, pos, score, {_RC} AS seq FROM hits) SELECT * FROM o WHERE regexp_full_match(seq, '[ACGTacgt]*')")
def hits_alphabet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits.plain_only(hits_revcomp(spark, sf_dir))


def _family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits.family(fx.hits(spark, sf_dir), MAX_DUP)


@query("family_members", f"{_FAMILY} SELECT gene_id, species, copy, seq FROM family")
def family_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _family(spark, sf_dir).withColumn("copy", F.col("copy").cast("long"))


@query("copy_mapping", f"{_FAMILY} SELECT DISTINCT species || '_' || cast(copy AS varchar) AS taxon, species FROM family")
def copy_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits.copy_mapping(_family(spark, sf_dir))


@query("flagship_families", f"{_FAMILY} SELECT gene_id, species, copy, seq FROM family WHERE gene_id IN (SELECT gene_id FROM family GROUP BY gene_id HAVING count(DISTINCT species) >= {MIN_SPECIES})")
def flagship_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.with_min_species(family_members(spark, sf_dir), MIN_SPECIES)


@query("num_genes", f"{fx.HITS_SQL} SELECT species, count(DISTINCT gene_id) AS num_genes FROM hits GROUP BY species")
def num_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.genes_per_species(fx.hits(spark, sf_dir))


@query("homologs", f"{fx.HITS_SQL} SELECT gene_id, count(DISTINCT species) AS num_species FROM hits GROUP BY gene_id")
def homologs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.homologs(fx.hits(spark, sf_dir))


@query("homologs_hist", f"{fx.HITS_SQL}, h AS (SELECT gene_id, count(DISTINCT species) AS num_species FROM hits GROUP BY gene_id) SELECT num_species, count(*) AS n FROM h GROUP BY num_species")
def homologs_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.histogram(homologs(spark, sf_dir), "num_species")


@query("gene_dup", f"{_FAMILY}, k AS (SELECT gene_id, count(*) AS m FROM family GROUP BY gene_id), h AS (SELECT gene_id, count(DISTINCT species) AS s FROM hits GROUP BY gene_id) SELECT gene_id, round(cast(m AS double) / s, 9) AS duplicity FROM k JOIN h USING (gene_id)")
def gene_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.duplicity(_family(spark, sf_dir), fx.hits(spark, sf_dir))


@query(
    "gene_dup_hist",
    f"{_FAMILY}, k AS (SELECT gene_id, count(*) AS m FROM family GROUP BY gene_id), h AS (SELECT gene_id, count(DISTINCT species) AS s FROM hits GROUP BY gene_id), d AS (SELECT cast(floor(2 * round(cast(m AS double) / s, 9)) AS bigint) AS half FROM k JOIN h USING (gene_id)) SELECT half, count(*) AS n FROM d GROUP BY half",
)
def gene_dup_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.histogram(gene_dup(spark, sf_dir).select(F.floor(2 * F.col("duplicity")).cast("long").alias("half")), "half")


_DENSITY = f"""{fx.HITS_SQL}, h AS (SELECT cast(score AS double) AS x FROM hits WHERE score IS NOT NULL),
low AS (SELECT cast(floor(x / 500) AS bigint) AS low, count(*) AS n, sum(x / 500 - floor(x / 500)) AS w, sum(x) AS t, sum(x * x) AS s FROM h GROUP BY 1),
bins AS (SELECT bin, sum(weight) AS weight FROM (SELECT low AS bin, n - w AS weight FROM low UNION ALL SELECT low + 1, w FROM low) GROUP BY bin HAVING sum(weight) > 0),
v AS (SELECT cast(sum(n) AS double) AS n, (sum(s) - sum(t) * sum(t) / sum(n)) / (sum(n) - 1) AS v FROM low HAVING sum(n) > 1),
m AS (SELECT n, sqrt(v) * pow(n, -0.2) AS h FROM v WHERE v > 1e-12),
grid AS (SELECT n, h, (SELECT min(bin) FROM bins) * 500 - 3 * h AS first, ((SELECT max(bin) FROM bins) * 500 + 3 * h - ((SELECT min(bin) FROM bins) * 500 - 3 * h)) / 199 AS gap FROM m)
SELECT round(first + k * gap, 3) AS x, round(1000 * sum(weight * exp(-power((first + k * gap - bin * 500) / h, 2) / 2)) / (n * h * sqrt(2 * pi())), 5) AS density FROM grid, range(0, 200) r(k), bins GROUP BY k, first, gap, n, h"""


@query("score_density", _DENSITY)
def score_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The density curve over the scores of all hits, per thousand."""
    rows = families.density(families.density_bins(fx.hits(spark, sf_dir), "score", 500.0), 500.0)
    return rows.select(F.round("x", 3).alias("x"), F.round(1000 * F.col("density"), 5).alias("density"))


@query("gene_to_species", f"{fx.HITS_SQL} SELECT species, gene_id, count(*) AS n_hits, string_agg('(' || score || ',' || line_no || ',' || pos || ')', ';' ORDER BY line_no, score, pos) AS hit_list FROM hits GROUP BY ALL")
def gene_to_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.gene_lists(fx.hits(spark, sf_dir))


_FEW = f"{_RANKED}, top8 AS (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY score DESC, species, line_no DESC, pos DESC) AS k FROM hits), few AS (SELECT gene_id, species FROM top8 WHERE k <= 8)"


def _few(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 8 best hits of each gene: few enough that the species gate bites."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("gene_id").orderBy(F.desc("score"), "species", F.desc("line_no"), F.desc("pos"))
    return fx.hits(spark, sf_dir).withColumn("k", F.row_number().over(w)).filter("k <= 8").select("gene_id", "species")


@query("genes_min_species", f"{_FEW} SELECT gene_id, species FROM few WHERE gene_id IN (SELECT gene_id FROM few GROUP BY gene_id HAVING count(DISTINCT species) >= 7)")
def genes_min_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.with_min_species(_few(spark, sf_dir), 7)


@query("genes_filtered_out", f"{_FEW} SELECT gene_id FROM few GROUP BY gene_id HAVING count(DISTINCT species) < 7")
def genes_filtered_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.filtered_genes(_few(spark, sf_dir), 7)


@query("num_gene_trees", f"{_FEW}, g AS (SELECT gene_id FROM few GROUP BY gene_id HAVING count(DISTINCT species) >= 7) SELECT count(*) AS num_gt FROM g")
def num_gene_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.gene_tree_count(_few(spark, sf_dir), 7)


@query("gene_padding", f"{fx.HITS_SQL}, m AS (SELECT gene_id, count(*) AS n FROM hits GROUP BY gene_id) SELECT cast(i AS int) AS gene_id, coalesce(n, 0) AS members FROM range(1, {GENES + 11}) r(i) LEFT JOIN m ON i = gene_id")
def gene_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.padded(fx.hits(spark, sf_dir), GENES + 10)


_LEN = f"{_FAMILY}, l AS (SELECT gene_id, count(*) AS n_seq, cast((sum(length(seq)) + count(*) - 1) // count(*) AS bigint) AS mean_len FROM family GROUP BY gene_id)"


@query("gene_lengths", f"{_LEN} SELECT * FROM l")
def gene_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.lengths(_family(spark, sf_dir))


@query("msa_gate", f"{_LEN} SELECT * FROM l WHERE n_seq > 150 OR mean_len > 37")
def msa_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.alignment_gate(_family(spark, sf_dir), 150, 25)


@query("tree_gate", f"{_LEN} SELECT * FROM l WHERE n_seq > 150 AND mean_len < 100 * 25 // 65")
def tree_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.tree_gate(_family(spark, sf_dir), 150, 25, 65)


# order keys are rare enough for some genes to have rows of one sequence only
@query("identical_shortcut", f"SELECT cast(l_orderkey AS int) AS gene_id FROM lineitem GROUP BY 1 HAVING count(DISTINCT upper(l_returnflag || l_linestatus)) = 1")
def identical_shortcut(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return families.identical_genes(rows.select(F.col("l_orderkey").cast("int").alias("gene_id"), F.concat("l_returnflag", "l_linestatus").alias("seq")))


# ------------------------------------------------------------------ alignments

_ALIGNED = f"{fx.HITS_SQL}, aligned AS (SELECT species, gene_id, line_no, pos, score, rpad(seq, 33, '-') AS aligned FROM hits), sites AS (SELECT gene_id, cast(i AS int) - 1 AS site, count(*) AS n_rows, count(*) FILTER (substring(aligned, i, 1) <> '-') AS filled FROM aligned, range(1, 34) r(i) GROUP BY ALL)"


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.hits(spark, sf_dir).select("species", "gene_id", "line_no", "pos", "score", F.rpad("seq", 33, "-").alias("aligned"))


@query("site_gap_fraction", f"{_ALIGNED} SELECT gene_id, cast(site AS int) AS site, n_rows, filled FROM sites")
def site_gap_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments.site_occupancy(_aligned(spark, sf_dir))


@query("masked_sites", f"{_ALIGNED} SELECT gene_id, cast(site AS int) AS site FROM sites WHERE cast(filled AS double) / n_rows < 0.94")
def masked_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments.masked_sites(_aligned(spark, sf_dir), 0.94)


@query(
    "mask_sites",
    f"""{_ALIGNED}, gone AS (SELECT gene_id, list(site) AS s FROM sites WHERE cast(filled AS double) / n_rows < 0.94 GROUP BY gene_id)
    SELECT species, a.gene_id, line_no, pos, score, array_to_string([substring(aligned, i + 1, 1) FOR i IN range(0, 33) IF NOT list_contains(coalesce(s, []), i)], '') AS aligned FROM aligned a LEFT JOIN gone USING (gene_id)""",
)
def mask_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _aligned(spark, sf_dir)
    return alignments.mask_sites(a, 0.94).select(*a.columns)


@query("filter_fragments", f"{_ALIGNED} SELECT * FROM aligned WHERE cast(length(replace(aligned, '-', '')) AS double) / length(aligned) >= 0.9")
def filter_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments.filter_fragments(_aligned(spark, sf_dir), 0.9)


_PAIRS = f"""{_RANKED}, pairs AS (SELECT x.species, x.gene_id, rpad(x.seq, 33, '-') AS a, rpad(y.seq, 33, '-') AS b, 30 AS gene_length FROM ranked x JOIN ranked y USING (species, gene_id) WHERE x.rn = 1 AND y.rn = 2),
m AS (SELECT species, gene_id,
  len([i FOR i IN range(1, 34) IF substring(a, i, 1) <> '-' AND substring(b, i, 1) <> '-']) AS solid,
  len([i FOR i IN range(1, 34) IF upper(substring(a, i, 1)) = upper(substring(b, i, 1)) AND substring(a, i, 1) <> '-']) AS same FROM pairs),
p AS (SELECT species, gene_id, round(CASE WHEN solid > 0 THEN 100 * cast(same AS double) / solid END, 6) AS identity, round(100 * cast(solid AS double) / 30, 6) AS coverage, round(100 * cast(solid AS double) / 33, 6) AS continuity FROM m)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = hits.ranked(fx.hits(spark, sf_dir), 2)
    x = r.filter("rn = 1").select("species", "gene_id", F.rpad("seq", 33, "-").alias("a"))
    y = r.filter("rn = 2").select("species", "gene_id", F.rpad("seq", 33, "-").alias("b"))
    return x.join(y, ["species", "gene_id"]).withColumn("gene_length", F.lit(30))


@query("align_measures", f"{_PAIRS} SELECT * FROM p")
def align_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments.pair_measures(_pairs(spark, sf_dir)).drop("a", "b", "gene_length")


@query("align_filters", f"{_PAIRS} SELECT * FROM p WHERE identity >= 30 AND coverage >= 85 AND continuity >= 85")
def align_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments.pair_filter(_pairs(spark, sf_dir), 30, 85, 85).drop("a", "b", "gene_length")


@query("align_filters_deep", f"{_PAIRS} SELECT * FROM p WHERE identity >= 20 AND coverage >= 85 AND continuity >= 85")
def align_filters_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments.pair_filter(_pairs(spark, sf_dir), 20, 85, 85).drop("a", "b", "gene_length")


# ------------------------------------------------------------------ k-mers


@query(
    "kmer_profile",
    f"{fx.GENOME_SQL}, k AS (SELECT species, upper(substring(seq, i, 12)) AS kmer, count(*) AS n FROM genome, unnest(range(1, length(seq) - 10)) u(i) GROUP BY ALL) SELECT species, cast(sum(n) AS bigint) AS n_kmers, count(*) AS n_distinct FROM k WHERE regexp_full_match(kmer, '[ACGT]*') GROUP BY species",
)
def kmer_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmer.profile(fx.genome(spark, sf_dir), 12)


_SETS = f"""{_BEST}, sets AS (SELECT DISTINCT gene_id, species AS taxon, upper(substring(seq, i, 3)) AS kmer FROM best, unnest(range(1, length(seq) - 1)) u(i)),
size AS (SELECT gene_id, taxon, count(*) AS n FROM sets GROUP BY ALL),
shared AS (SELECT x.gene_id, x.taxon AS a, y.taxon AS b, count(*) AS shared FROM sets x JOIN sets y ON x.gene_id = y.gene_id AND x.kmer = y.kmer AND x.taxon < y.taxon GROUP BY ALL),
j AS (SELECT s.gene_id, a, b, shared, round(cast(shared AS double) / (p.n + q.n - shared), 9) AS jaccard FROM shared s JOIN size p ON p.gene_id = s.gene_id AND p.taxon = a JOIN size q ON q.gene_id = s.gene_id AND q.taxon = b)"""


@query("kmer_jaccard", f"{_SETS} SELECT * FROM j")
def kmer_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = hits.ranked(fx.hits(spark, sf_dir), 1).select("gene_id", F.col("species").alias("taxon"), dna.ungapped(F.col("seq")).alias("seq"))
    return kmer.jaccard(best, 3)


@query("mash_distance", f"{_SETS} SELECT *, round(abs(-ln(2 * jaccard / (1 + jaccard)) / 3), 9) AS distance FROM j")
def mash_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmer.mash_distance(kmer_jaccard(spark, sf_dir), 3)


# Bottom sketches of canonical 21-mers: two rounds of multiplying and folding 64 bits.
_UP = "translate(s, 'ACGT', '0123')"
_FOLD = "xor(x, x >> 32)"
_SKETCH = f"""{fx.GENOME_SQL}, k AS (SELECT species, substring(upper(seq), i, 21) AS s FROM genome, unnest(range(1, length(seq) - 19)) u(i)),
plain AS (SELECT DISTINCT species, s FROM k WHERE regexp_full_match(s, '[ACGT]*')),
canonical AS (SELECT DISTINCT species, least(s, reverse(translate(s, 'ACGT', 'TGCA'))) AS s FROM plain),
packed AS (SELECT species, list_reduce(list_prepend(0::UHUGEINT, list_transform(string_split({_UP}, ''), lambda c: c::UHUGEINT)), lambda a, c: a * 4 + c) AS w FROM canonical),
one AS (SELECT species, ((w * {0xFF51AFD7ED558CCD}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS x FROM packed),
two AS (SELECT species, (({_FOLD}::UHUGEINT * {0xC4CEB9FE1A85EC53}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS x FROM one),
hashed AS (SELECT species, ({_FOLD} >> 1)::BIGINT AS h FROM two),
bottom AS (SELECT species, h FROM hashed QUALIFY row_number() OVER (PARTITION BY species ORDER BY h) <= 1000)"""


@query("sketch_bottom", f"{_SKETCH} SELECT species, count(*) AS size, min(h) AS least, max(h) AS greatest, cast(sum(h % 1000003) AS bigint) AS digest FROM bottom GROUP BY species")
def sketch_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = kmer.sketches(fx.genome(spark, sf_dir), 21)
    h = F.explode("sketch").alias("h")
    return own.select("species", h).groupBy("species").agg(F.count("*").alias("size"), F.min("h").alias("least"), F.max("h").alias("greatest"), F.sum(F.col("h") % 1000003).alias("digest"))


@query(
    "sketch_distance",
    f"""{_SKETCH}, pairs AS (SELECT a.species AS a, b.species AS b FROM (SELECT DISTINCT species FROM bottom) a, (SELECT DISTINCT species FROM bottom) b WHERE a.species < b.species),
united AS (SELECT a, b, h, count(*) AS n FROM pairs JOIN bottom ON species = a OR species = b GROUP BY ALL),
top AS (SELECT a, b, n FROM united QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY h) <= 1000),
j AS (SELECT a, b, round(cast(count(*) FILTER (n = 2) AS double) / count(*), 9) AS jaccard FROM top GROUP BY a, b)
SELECT a, b, jaccard, round(abs(-ln(2 * jaccard / (1 + jaccard)) / 21), 9) AS distance FROM j WHERE jaccard > 0""",
)
def sketch_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmer.mash_distance(kmer.sketch_pairs(kmer.sketches(fx.genome(spark, sf_dir), 21)), 21)


_SEEDS = f"""{_SAMPLED}, genes AS (SELECT gene_id, upper(w.seq) AS seq FROM sampled),
strands AS (SELECT gene_id, '+' AS strand, seq AS s FROM genes UNION ALL SELECT gene_id, '-', reverse(translate(seq, '{dna.CODES}', '{dna.COMPLEMENTS}')) FROM genes),
q AS (SELECT gene_id, strand, i - 1 AS q_pos, substring(s, i, 24) AS kmer FROM strands, unnest(range(1, length(s) - 22)) u(i) WHERE regexp_full_match(substring(s, i, 24), '[ACGT]*')),
t AS (SELECT species, rec, i - 1 AS t_pos, upper(substring(seq, i, 24)) AS kmer FROM genome, unnest(range(1, length(seq) - 22)) u(i)),
found AS (SELECT gene_id, strand, q_pos, species, rec, t_pos FROM t JOIN q USING (kmer))"""


def _genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_genes(spark, sf_dir).filter("seq is not null").select("gene_id", "seq")


def _seeds(spark: SparkSession, sf_dir: str, step: int = 1, transitions: bool = False) -> DataFrame:
    """Seeds of all sampled genes in all records."""
    return kmer.seeds(_genes(spark, sf_dir), fx.genome(spark, sf_dir), 24, step, transitions)


@query("seed_join", f"{_SEEDS} SELECT gene_id, species, count(*) AS seeds, count(DISTINCT rec) AS records FROM found GROUP BY ALL")
def seed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmer.seed_counts(_seeds(spark, sf_dir))


@query("seed_join_step", f"{_SEEDS} SELECT gene_id, species, count(*) AS seeds, count(DISTINCT rec) AS records FROM found WHERE q_pos % 4 = 0 GROUP BY ALL")
def seed_join_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmer.seed_counts(_seeds(spark, sf_dir, 4))


@query(
    "seed_diagonals",
    f"{_SEEDS} SELECT gene_id, species, rec, strand, cast(floor((t_pos - q_pos) / 32.0) AS bigint) AS diagonal, count(*) AS seeds, min(t_pos) AS t_start, max(t_pos) AS t_end FROM found GROUP BY ALL HAVING count(*) >= 2",
)
def seed_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmer.seed_bands(_genes(spark, sf_dir), fx.genome(spark, sf_dir), 24)


@query(
    "seed_bands",
    f"{_SEEDS} SELECT gene_id, species, rec, strand, b AS diagonal, count(*) AS seeds, min(t_pos) AS t_start, max(t_pos) AS t_end FROM found, unnest([cast(floor((t_pos - q_pos) / 16.0) AS bigint) - 1, cast(floor((t_pos - q_pos) / 16.0) AS bigint)]) u(b) GROUP BY ALL HAVING count(*) >= 2",
)
def seed_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmer.seed_bands(_genes(spark, sf_dir), fx.genome(spark, sf_dir), 24, overlapping=True)


_TURNED = "[substring(kmer, 1, i - 1) || translate(substring(kmer, i, 1), 'ACGT', 'GTAC') || substring(kmer, i + 1) FOR i IN range(1, 25)]"


@query(
    "seed_transitions",
    f"{_SEEDS}, near AS (SELECT gene_id, strand, q_pos, unnest(list_append({_TURNED}, kmer)) AS kmer FROM q) SELECT gene_id, species, count(*) AS seeds, count(DISTINCT rec) AS records FROM t JOIN near USING (kmer) GROUP BY ALL",
)
def seed_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmer.seed_counts(_seeds(spark, sf_dir, transitions=True))


# Spaced words: two patterns of weight 12 end to end; a window with two N at most has a word for every choice.
_PATTERN = 2 * dna.SPACED
_FIRST_N = "unnest(CASE WHEN contains(w, 'N') THEN [regexp_replace(w, 'N', b) FOR b IN ['A', 'C', 'G', 'T']] ELSE [w] END) AS w"


def _spaced(s: str) -> str:
    return " || ".join(f"substring({s}, i + {m.start()}, {len(m[0])})" for m in re.finditer("1+", _PATTERN))


@query(
    "seed_spaced",
    f"""{_SEEDS}, sq AS (SELECT gene_id, {_spaced("s")} AS w FROM strands, unnest(range(1, length(s) - {len(_PATTERN) - 2})) u(i)),
st0 AS (SELECT species, rec, {_spaced("upper(seq)")} AS w FROM genome, unnest(range(1, length(seq) - {len(_PATTERN) - 2})) u(i)),
st AS (SELECT species, rec, {_FIRST_N} FROM (SELECT species, rec, {_FIRST_N} FROM st0))
SELECT gene_id, species, count(*) AS seeds, count(DISTINCT rec) AS records FROM st JOIN sq USING (w) WHERE NOT contains(w, 'N') GROUP BY ALL""",
)
def seed_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmer.seed_counts(seeds.matches(_genes(spark, sf_dir), fx.genome(spark, sf_dir), _PATTERN, most=seeds.CODE_WORDS))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.segments(_genes(spark, sf_dir), fx.genome(spark, sf_dir), 200, _PATTERN, most=seeds.CODE_WORDS, least=3000)


@query("seed_segments")
def seed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir)


@query("seed_chains")
def seed_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.chains(_segments(spark, sf_dir), 800)


# ------------------------------------------------------------------ reports


@query("support_percent", f"{fx.STATS_SQL} SELECT count(*) AS branches, count(*) FILTER (support >= 0.95) AS high, round(100 * cast(count(*) FILTER (support >= 0.95) AS double) / count(*), 9) AS percent FROM stats WHERE line_no % 3 = 0")
def support_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.support_percent(fx.branch_stats(spark, sf_dir), 0.95)


@query("convergence_delta", f"{fx.ITERATIONS_SQL}, d AS (SELECT iteration, pct, round(abs(pct - lag(pct) OVER (ORDER BY iteration)), 6) AS delta FROM iterations) SELECT *, delta < 1 AS settled FROM d")
def convergence_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.deltas(fx.iterations(spark, sf_dir))


@query("step_totals", f"{fx.JOBS_SQL} SELECT step, round(sum(wall_min), 4) AS wall_min, round(sum(cpu_min), 4) AS cpu_min, count(*) AS jobs FROM jobs GROUP BY step")
def step_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.step_totals(fx.jobs(spark, sf_dir))


@query("step_top50", f"{fx.JOBS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY wall_min DESC, job) AS rn FROM jobs) SELECT * FROM r WHERE rn <= 50")
def step_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.slowest(fx.jobs(spark, sf_dir)).withColumn("rn", F.col("rn").cast("long"))


@query("step_unpivot", f"{fx.JOBS_SQL} SELECT step, job, 'wall_min' AS measure, wall_min AS minutes FROM jobs UNION ALL SELECT step, job, 'cpu_min', cpu_min FROM jobs")
def step_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.long_form(fx.jobs(spark, sf_dir))


@query("elapsed_times", "SELECT event_id, cast(floor(epoch(ts)) AS bigint) - min(cast(floor(epoch(ts)) AS bigint)) OVER (PARTITION BY user_id) AS since_start, cast(floor(epoch(ts)) AS bigint) - lag(cast(floor(epoch(ts)) AS bigint)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS since_last FROM events")
def elapsed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return reports.elapsed(e, by="user_id", tie="event_id").select("event_id", "since_start", "since_last")


@query("ids_in_text_order", "SELECT p_partkey AS id, row_number() OVER (ORDER BY cast(p_partkey AS varchar)) - 1 AS place FROM part")
def ids_in_text_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.text_order(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id")))


@query("master_accumulate", f"{fx.HITS_SQL}, n AS (SELECT gene_id % 9 + 1 AS iteration, count(*) AS added FROM hits GROUP BY 1) SELECT cast(iteration AS bigint) AS iteration, added, cast(sum(added) OVER (ORDER BY iteration) AS bigint) AS total FROM n")
def master_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.accumulated(fx.hits(spark, sf_dir).withColumn("iteration", F.col("gene_id") % 9 + 1))


# ------------------------------------------------------------------ trees


@query("tips_per_tree", f"{fx.TREES_SQL} SELECT t AS tree_id, count(*) AS n_tips, count(DISTINCT regexp_replace(tip, '_[^_]*$', '')) AS n_species FROM ordered GROUP BY t")
def tips_per_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.tips_per_tree(fx.newicks(spark, sf_dir))


# pre-order of a caterpillar of n tips: the inner clade of the first k is node n - k, tip r is node n - 2 + r
_CLADES = f"""{fx.TREES_SQL}, want AS (SELECT tip FROM ordered WHERE t = 1 AND r <= 7),
clades AS (SELECT o.t, o.n - k AS node_id, k AS own, count(w.tip) AS shared FROM ordered o JOIN range(2, {fx.TIPS}) c(k) ON o.r <= k AND k < o.n LEFT JOIN want w USING (tip) GROUP BY o.t, o.n, k
  UNION ALL SELECT o.t, o.n - 2 + o.r, 1, count(w.tip) FROM ordered o LEFT JOIN want w USING (tip) GROUP BY o.t, o.n, o.r),
scores AS (SELECT t AS tree_id, cast(node_id AS int) AS node_id, cast({fx.TIPS} - 7 - own + 2 * shared AS bigint) AS score FROM clades)"""


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.tree_order(spark, sf_dir).filter("t = 1 AND r <= 7").select("tip")


@query("clade_scores", f"{_CLADES} SELECT * FROM scores")
def clade_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.clade_scores(trees.nodes(fx.newicks(spark, sf_dir)), _wanted(spark, sf_dir), fx.TIPS)


@query("reroot_choice", f"{_CLADES}, b AS (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY score DESC, node_id) AS k FROM scores WHERE score > 0) SELECT tree_id, node_id, score FROM b WHERE k = 1")
def reroot_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.reroot_choice(clade_scores(spark, sf_dir))


_SPLITS = f"""{fx.TREES_SQL}, first AS (SELECT t, min(tip) AS f FROM ordered GROUP BY t),
sides AS (SELECT o.t, k, list_sort(list(o.tip) FILTER (o.r <= k)) AS s, list_sort(list(o.tip) FILTER (o.r > k)) AS rest, any_value(f) AS f FROM ordered o JOIN first USING (t), range(2, 19) c(k) WHERE k <= o.n - 2 GROUP BY o.t, k),
splits AS (SELECT DISTINCT t, CASE WHEN list_contains(s, f) THEN array_to_string(rest, ',') ELSE array_to_string(s, ',') END AS split FROM sides)"""


@query("tree_splits", f"{_SPLITS} SELECT t AS tree_id, split FROM splits")
def tree_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.splits(trees.nodes(fx.newicks(spark, sf_dir)))


@query("split_rf", f"{_SPLITS}, r AS (SELECT split FROM splits WHERE t = 1) SELECT t AS tree_id, count(*) + (SELECT count(*) FROM r) - 2 * count(r.split) AS rf, round(cast(count(*) + (SELECT count(*) FROM r) - 2 * count(r.split) AS double) / (count(*) + (SELECT count(*) FROM r)), 9) AS norm_rf FROM splits s LEFT JOIN r USING (split) GROUP BY t")
def split_rf(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tree_splits(spark, sf_dir)
    return trees.robinson_foulds(s, s.filter("tree_id = 1").select("split"))


@query("gene_tree_list", f"{fx.TREES_SQL}, c AS (SELECT t, count(*) AS n_tips FROM ordered GROUP BY t) SELECT cast(i AS int) AS gene_id, cast(n_tips AS int) AS n_tips FROM range(1, {GENES + 11}) r(i) LEFT JOIN c ON i = t")
def gene_tree_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.range(1, GENES + 11).select(F.col("id").cast("int").alias("gene_id"))
    n = trees.tips_per_tree(fx.newicks(spark, sf_dir)).select(F.col("tree_id").alias("gene_id"), F.col("n_tips").cast("int").alias("n_tips"))
    return ids.join(n, "gene_id", "left")


# ------------------------------------------------------------------ whole algorithms (rows only)


def _best_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hits.oriented(hits.ranked(fx.hits(spark, sf_dir), 1))
    return hits.plain_only(rows).select("gene_id", F.concat_ws("_", "species", F.lit(0)).alias("taxon"), "seq")


@query("msa_progressive")
def msa_progressive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modes.align_families(_best_families(spark, sf_dir))


@query("nj_tree")
def nj_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modes.distance_trees(modes.align_families(_best_families(spark, sf_dir)), "balanced")


@query("ml_tree")
def ml_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modes.distance_trees(modes.align_families(_best_families(spark, sf_dir)), "accurate")


@query("mash_tree")
def mash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modes.sketch_trees(_best_families(spark, sf_dir), 5)


@query("species_tree")
def species_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modes.species_tree(fx.newicks(spark, sf_dir).withColumnRenamed("tree_id", "gene_id"))


@query("pipeline_fast")
def pipeline_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import Config

    g = fx.genome(spark, sf_dir)
    return modes.gene_trees(g, Config(gene_count=GENES, length=200, upper_case=0.02, mode="fast", min_align=3, identity=50, coverage=60, continuity=60, seed_length=24))
