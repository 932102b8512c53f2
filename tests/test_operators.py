"""Operators on small literal rows, edge cases included."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cladeloom.functions import dna
from cladeloom.operators import alignments, families, hits, kmer, ranges, reports, sampling, trees

HITS = "species string, gene_id int, score long, line_no long, pos long, strand string, seq string"


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def test_dna_functions(spark):
    assert one(spark, dna.reverse_complement(F.lit("ACGTacgtNR-"))) == "-YNacgtACGT"
    rng = random.Random(1)
    for _ in range(5):
        s = "".join(rng.choice("ACGTacgtRYKMBVDHN") for _ in range(40))
        assert one(spark, dna.reverse_complement(dna.reverse_complement(F.lit(s)))) == s
    assert one(spark, dna.is_plain(F.lit("ACGTacgt"))) and one(spark, dna.is_plain(F.lit(""))) and not one(spark, dna.is_plain(F.lit("ACGN")))
    assert one(spark, dna.upper_count(F.lit("AaCcN"))) == 2
    assert (dna.upper_threshold(0.9, 500), dna.upper_threshold(0.9, 200)) == (450, 180)
    s = "".join(random.Random(2).choice("ACGT") for _ in range(1300))
    assert one(spark, dna.kmers(F.lit(s), 7)) == [s[i : i + 7] for i in range(len(s) - 6)]
    assert one(spark, dna.kmers(F.lit("ACG"), 7)) == [] and one(spark, dna.kmers(F.lit("ACGTACG"), 7)) == ["ACGTACG"]


def test_prefix_sum_and_locate(spark):
    rng = random.Random(3)
    rows = [(g, r, rng.randrange(0, 9)) for g in "ab" for r in rng.sample(range(100), 40)]
    df = ranges.prefix_sum(spark.createDataFrame(rows, "species string, rec long, len long"), "species", "rec", "len", block=8).withColumn("hi", F.col("lo") + F.col("len"))
    got = {(r["species"], r["rec"]): r["lo"] for r in df.collect()}
    for g, r, _ in rows:
        assert got[(g, r)] == sum(n for g2, r2, n in rows if g2 == g and r2 < r)
    total = {g: sum(n for g2, _, n in rows if g2 == g) for g in "ab"}
    points = spark.createDataFrame([(g, o) for g in "ab" for o in range(total[g] + 2)], "species string, off long")
    found = ranges.locate(points, df, "species", width=5).collect()
    assert len(found) == sum(total.values()) and all(r["lo"] <= r["off"] < r["hi"] for r in found)


def test_quota_ranges_are_contiguous(spark):
    g = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "species string")
    rows = sorted(sampling.quota(g, 30).collect())
    assert [r["species"] for r in rows] == ["a", "b", "c"] and sum(r["draws"] for r in rows) == 30
    at = 1
    for r in rows:
        assert r["start_id"] == at and r["end_id"] - at == r["draws"]
        at = r["end_id"]
    compat = sorted(sampling.quota(g, 30, compat_ids=True).collect())
    assert all(c["end_id"] > r["end_id"] for c, r in zip(compat, rows))


def test_sampling_rejects_and_fails_explicitly(spark):
    g = spark.createDataFrame([("a", 0, "ACGT" * 50), ("a", 1, "AC"), ("b", 0, "N" * 300), ("c", 0, "acgt" * 80)], "species string, rec long, seq string")
    rows = sampling.sample_genes(g, 40, 50, 0.9).collect()
    assert sorted(r["gene_id"] for r in rows) == list(range(1, 41))
    for r in rows:
        if r["species"] == "a":
            assert r["seq"] == ("ACGT" * 50)[r["start"] : r["start"] + 50]
        else:
            assert r["seq"] is None


def hit_rows(spark, rows):
    return spark.createDataFrame([(s, g, sc, ln, p, st, q) for s, g, sc, ln, p, st, q in rows], HITS)


def test_rank_spacing_and_selection(spark):
    rows = [("s", 1, 100 - k, k, p, "+", "ACGT") for k, p in enumerate([0, 1999, 2000, 3999, 4100, 10_000])]
    rows += [("s", 1, 100, 9, 50_000, "-", "AC-GN"), ("t", 1, 5, 0, 0, "-", "AAC-g")]
    df = hit_rows(spark, rows)
    kept = {r["species"]: r["kept"] for r in hits.spacing_kept(df).collect()}
    assert kept == {"s": [50_000, 0, 2000, 4100, 10_000], "t": [0]}
    compat = [r["pos"] for r in sorted(hits.selected(df, 4).filter("species = 's'").collect(), key=lambda r: r["rn"])]
    assert compat == [50_000, 0, 1999, 2000]
    spaced = [r["pos"] for r in sorted(hits.selected_spaced(df, 4).filter("species = 's'").collect(), key=lambda r: r["rn"])]
    assert spaced == [50_000, 0, 2000, 4100]
    fam = {(r["species"], r["copy"]): r["seq"] for r in hits.family(df, 4).collect()}
    assert fam == {("s", 1): "ACGT", ("s", 2): "ACGT", ("s", 3): "ACGT", ("t", 0): "cGTT"}  # rank 0 of s has an N


def test_spacing_is_pairwise(spark):
    rng = random.Random(4)
    rows = [(f"s{k % 3}", k % 2, rng.randrange(9), k, rng.randrange(30_000), "+", "A") for k in range(150)]
    for r in hits.spacing_kept(hit_rows(spark, rows)).collect():
        assert all(abs(a - b) >= 2000 for i, a in enumerate(r["kept"]) for b in r["kept"][:i])


def test_family_gates(spark):
    m = spark.createDataFrame([(1, "a", 0, "AC"), (1, "a", 1, "ac"), (1, "b", 0, "AC"), (2, "a", 0, "ACGT"), (2, "b", 0, "ACGTA"), (2, "a_b", 0, "ACG")], "gene_id int, species string, copy int, seq string")
    assert {r[0] for r in families.passing_genes(m, 3).collect()} == {2}
    assert {r[0] for r in families.filtered_genes(m, 3).collect()} == {1}
    assert families.gene_tree_count(m, 2).first()[0] == 2
    assert {tuple(r) for r in families.lengths(m).collect()} == {(1, 3, 2), (2, 3, 4)}
    assert {r[0] for r in families.identical_genes(m).collect()} == {1}
    assert {r["gene_id"] for r in families.alignment_gate(m, 3, 2).collect()} == {2}
    assert {r["gene_id"] for r in families.tree_gate(m, 2, 2, 65).collect()} == {1}
    assert [tuple(r) for r in families.padded(m, 3).orderBy("gene_id").collect()] == [(1, 3), (2, 3), (3, 0)]
    assert families.gene_tree_count(m.limit(0), 2).first()[0] == 0


def test_alignment_filters(spark):
    a = spark.createDataFrame([(1, "x", "AC-T"), (1, "y", "A--T"), (1, "z", "A---")], "gene_id int, taxon string, aligned string")
    assert {tuple(r) for r in alignments.masked_sites(a, 0.34).collect()} == {(1, 1), (1, 2)}
    assert {r["taxon"]: r["aligned"] for r in alignments.mask_sites(a, 0.34).collect()} == {"x": "AT", "y": "AT", "z": "A-"}
    assert {r["taxon"] for r in alignments.filter_fragments(a, 0.5).collect()} == {"x", "y"}
    p = spark.createDataFrame([("ACGT-A", "ACCTAA", 10), ("--", "--", 5)], "a string, b string, gene_length int")
    first, second = sorted(alignments.pair_measures(p).collect(), key=lambda r: r["gene_length"], reverse=True)
    assert (first["identity"], first["coverage"], first["continuity"]) == (80.0, 50.0, round(500 / 6, 6))
    assert second["identity"] is None and second["coverage"] == 0


def test_seeds_find_planted_matches(spark):
    rng = random.Random(7)
    base = "".join(rng.choice("ACGT") for _ in range(2000))
    turn = str.maketrans("ACGT", "TGCA")
    genome = spark.createDataFrame([("a", 0, base), ("b", 3, base.translate(turn)[::-1])], "species string, rec long, seq string")
    genes = spark.createDataFrame([(1, base[500:700])], "gene_id int, seq string")
    found = kmer.seeds(genes, genome, 16)
    assert {(r["species"], r["strand"]) for r in found.collect()} == {("a", "+"), ("b", "-")}
    d = {r["species"]: r for r in kmer.diagonals(found).groupBy("species").agg(F.sum("seeds").alias("n"), F.min("t_start").alias("t")).collect()}
    assert d["a"]["n"] == d["b"]["n"] == 185 and d["a"]["t"] == 500


def test_jaccard_and_distance(spark):
    m = spark.createDataFrame([(1, "a", "ACGTACGTT"), (1, "b", "ACGTACGTT"), (1, "c", "ACGTACGAA"), (1, "d", "GGGGGGG")], "gene_id int, taxon string, seq string")
    rows = {(r["a"], r["b"]): r for r in kmer.mash_distance(kmer.jaccard(m, 4), 4).collect()}
    assert rows[("a", "b")]["jaccard"] == 1 and rows[("a", "b")]["distance"] == 0
    assert ("a", "d") not in rows and 0 < rows[("a", "c")]["jaccard"] < 1


def test_reports(spark):
    s = spark.createDataFrame([(k, float(v)) for k, v in enumerate([1.0, 0, 0, 0.95, 1, 1, 0.5, 1, 1])], "line_no long, support double")
    assert tuple(reports.support_percent(s, 0.95).first()) == (3, 2, round(200 / 3, 9))
    assert reports.support_percent(s.limit(0), 0.95).first()["percent"] is None
    assert reports.stops(1, 100.0, None) and not reports.stops(1, 50.0, None)
    assert reports.stops(2, 50.0, 0.5) and not reports.stops(2, 50.0, 1.0) and reports.stops(9, 10.0, 30.0)
    jobs = spark.createDataFrame([("a", str(k), float(k), 1.0) for k in range(60)], "step string, job string, wall_min double, cpu_min double")
    assert reports.slowest(jobs).agg(F.min("wall_min")).first()[0] == 10.0
    assert reports.long_form(jobs).count() == 120


def test_tree_tables(spark):
    t = spark.createDataFrame([(1, "((a_0,b_0),(c_0,(d_0,e_0)));"), (2, "((a_0,c_0),(b_0,(d_0,e_0)));"), (3, None), (4, " ")], "tree_id int, newick string")
    n = trees.nodes(t)
    assert n.count() == 18 and trees.tips_per_tree(t).filter("n_species = 5").count() == 2
    s = trees.splits(n)
    rf = {r["tree_id"]: r["norm_rf"] for r in trees.robinson_foulds(s, s.filter("tree_id = 1").select("split")).collect()}
    assert rf == {1: 0.0, 2: 0.5}
    wanted = spark.createDataFrame([("d_0",), ("e_0",)], "tip string")
    choice = {r["tree_id"]: r["score"] for r in trees.reroot_choice(trees.clade_scores(n, wanted, 5)).collect()}
    assert choice == {1: 5, 2: 5}


@pytest.mark.parametrize("limit", [0])
def test_empty_inputs(spark, limit):
    df = hit_rows(spark, [("s", 1, 1, 1, 1, "+", "A")]).limit(limit)
    assert hits.family(df, 10).count() == 0 and hits.selected_spaced(df, 10).count() == 0
    g = spark.createDataFrame([("a", 0, "ACGT")], "species string, rec long, seq string").limit(limit)
    assert sampling.record_spans(g).count() == 0 and kmer.profile(g, 3).count() == 0


def test_chunked_genomes_give_what_whole_records_give(spark, monkeypatch):
    from cladeloom.operators import chunks

    rng = random.Random(8)
    rows = [(sp, r, "".join(rng.choice("ACGTacgtN"[: 9 if r else 8]) for _ in range(n))) for sp in "ab" for r, n in enumerate((1500, 37, 800))]
    whole = spark.createDataFrame(rows, "species string, rec long, seq string")
    for name in ("chunked", "at"):
        monkeypatch.setattr(chunks, name, partial_size(getattr(chunks, name), 128))
    own = chunks.chunked(whole, 200)
    assert own.count() > 30
    assert sorted(map(tuple, sampling.record_spans(own).collect())) == sorted(map(tuple, sampling.record_spans(whole).collect()))
    text = {(sp, r): s for sp, r, s in rows}
    for r in sampling.windows(own, sampling.offsets(sampling.record_spans(own), 60), 150).collect():
        assert r["seq"] == text[r["species"], r["rec"]][r["start"] : r["start"] + 150] and len(r["seq"]) == 150
    want = {}
    for sp, _, s in rows:
        for i in range(len(s) - 8):
            k = s[i : i + 9].upper()
            if set(k) <= set("ACGT"):
                want.setdefault(sp, []).append(k)
    got = {r["species"]: (r["n_kmers"], r["n_distinct"]) for r in kmer.profile(own, 9).collect()}
    assert got == {sp: (len(k), len(set(k))) for sp, k in want.items()}
    genes = spark.createDataFrame([(1, rows[0][2][200:420])], "gene_id int, seq string")
    turned = {(r["q_pos"], r["species"], r["rec"], r["t_pos"]) for r in kmer.seeds(genes, own, 9, transitions=True).filter("strand = '+'").collect()}
    swap = str.maketrans("ACGT", "GTAC")
    brute, gene = set(), rows[0][2][200:420].upper()
    for sp, rec, s in rows:
        at = {}
        for i in range(len(s) - 8):
            at.setdefault(s[i : i + 9].upper(), []).append(i)
        for q in range(len(gene) - 8):
            k = gene[q : q + 9]
            for x in {k, *(k[:i] + k[i].translate(swap) + k[i + 1 :] for i in range(9))}:
                brute |= {(q, sp, rec, t) for t in at.get(x, ())}
    assert turned == brute and len(brute) > 220


def partial_size(f, size):
    return lambda *a, **k: f(*a, **{**k, "size": size}) if not (f.__name__ == "chunked" and len(a) > 2) else f(*a, **k)


def test_sampling_goes_on_until_its_tries_are_used(spark):
    """One window in two thousand passes: fixed early tries miss it."""
    seq = "acgt" * 2000
    g = spark.createDataFrame([("a", 0, seq[:5000] + "ACGTACGTAC" + seq[5010:])], "species string, rec long, seq string")
    rows = sampling.sample_genes(g, 5, 10, 0.9, tries=20).collect()
    assert len(rows) == 5 and all(r["start"] == 5000 and r["seq"] == "ACGTACGTAC" for r in rows)
    assert all(r["seq"] is None for r in sampling.sample_genes(g, 5, 10, 0.9, tries=20, most=40).collect())


def test_bands_hold_seeds_on_either_side_of_an_edge(spark):
    found = spark.createDataFrame([(1, "+", 0, "a", 0, 31), (1, "+", 5, "a", 0, 38)], "gene_id int, strand string, q_pos int, species string, rec long, t_pos long")
    assert kmer.diagonals(found).count() == 0 and kmer.diagonals(found, overlapping=True).count() >= 1


def test_text_order(spark):
    ids = [*range(0, 300, 7), 10, 100]
    got = [r["id"] for r in sorted(reports.text_order(spark.createDataFrame([(i,) for i in ids], "id long")).collect(), key=lambda r: r["place"])]
    assert got == sorted(ids, key=str)


@pytest.mark.parametrize("k", [1, 3, 9, 16, 31, 33])
def test_profiles_against_counting(spark, monkeypatch, k):
    """With several parts of a group in a task, over chunk borders, with codes, U and a group without a name."""
    import random
    from collections import Counter

    rng = random.Random(k)
    text = lambda n: "".join(rng.choice("ACGTacgt" if rng.random() < 0.99 else "NUu-") for _ in range(n))
    rows = [(rng.choice(["a", "b", None]), i, text(rng.choice([0, 5, 40, 300])) + "ACGTTGCA" * 6) for i in range(60)] + [("c", 99, "ACNNU"), ("d", 100, None)]
    monkeypatch.setattr(kmer, "HELD", 50)
    monkeypatch.setattr(kmer.chunks, "chunked", lambda g, overlap, f=kmer.chunks.chunked: f(g, overlap, 37))
    want: dict = {}
    for species, _, s in rows:
        for i in range(len(s or "") - k + 1):
            w = s[i : i + k].upper()
            if set(w) <= set("ACGT"):
                want.setdefault(species, Counter())[w] += 1
    df = spark.createDataFrame(rows, "species string, rec long, seq string")
    got = {r["species"]: (r["n_kmers"], r["n_distinct"]) for r in kmer.profile(df, k).collect()}
    assert got == {g: (sum(c.values()), len(c)) for g, c in want.items()}


def test_no_row_for_a_kmer(spark):
    df = spark.createDataFrame([("a", 1, "ACGTACGTACGTACGT")], "species string, rec long, seq string")
    plan = kmer.profile(df, 12)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 1 and "MapInArrow" in plan  # the chunks


def test_sampling_reads_the_bases_once_and_once_a_round(spark):
    met = spark.sparkContext.accumulator(0)

    def bases(s):
        met.add(1)
        return s

    rows = [(f"s{i % 3}", i, "ACGTTGCAAC" * 40) for i in range(30)] + [("s3", 30, "")]
    plain = spark.createDataFrame(rows, "species string, rec long, seq string")
    read = plain.withColumn("seq", F.udf(bases, "string")("seq"))
    got = [tuple(r) for r in sampling.sample_genes(read, 20, 50, 0.5).collect()]
    assert met.value == 2 * len(rows)
    assert len(got) == 20 and all(r[4] == dict((i, s) for _, i, s in rows)[r[2]][r[3] : r[3] + 50] for r in got if r[4])
    many = sampling.FEW
    try:
        sampling.FEW = 0  # points and chunks meet in a join that may move both
        assert sorted(tuple(r) for r in sampling.sample_genes(plain, 20, 50, 0.5).collect()) == sorted(got)
    finally:
        sampling.FEW = many
