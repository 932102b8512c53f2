"""Spaced seeds, gap-free segments, chains and batch alignment against direct computation."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from cladeloom.functions import dna, msa
from cladeloom.operators import chunks, gapped, kmer, seeds
from cladeloom.plans import modes
from cladeloom.plans.catalogue import QUERIES
from cladeloom.sources.tables import Config

SETS = {c: {b for b, bit in zip("ACGT", (1, 2, 4, 8)) if s & bit} for c, s in seeds.BASES.items()}
TURN = str.maketrans(dna.CODES, dna.COMPLEMENTS)


def _random(rng: random.Random, n: int, codes: float = 0.0) -> str:
    return "".join(rng.choice("RYSWKMBDHVN") if rng.random() < codes else rng.choice("ACGTacgt") for _ in range(n))


def _mutated(rng: random.Random, seq: str, identity: float) -> str:
    return "".join(c if rng.random() < identity else rng.choice("ACGT".replace(c.upper(), "")) for c in seq)


def _words(seq: str, pattern: str, most: int) -> dict[int, set[str]]:
    out = {}
    for i in range(len(seq) - len(pattern) + 1):
        own = [SETS.get(c, set()) for c, p in zip(seq[i : i + len(pattern)].upper(), pattern) if p == "1"]
        if 0 < np.prod([len(s) for s in own]) <= most:
            out[i] = {"".join(x) for x in itertools.product(*own)}
    return out


def _seeds(genes, genome, pattern, step, transitions, most):
    out = set()
    for (gene, seq), strand in itertools.product(genes, "+-"):
        s = seq if strand == "+" else seq.translate(TURN)[::-1]
        for q, own in _words(s, pattern, most).items():
            if q % step == 0:
                if transitions:
                    own = own | {w[:k] + w[k].translate(str.maketrans("ACGT", "GTAC")) + w[k + 1 :] for w in own for k in range(len(w))}
                for species, rec, target in genome:
                    out |= {(gene, strand, q, species, rec, t) for t, other in _words(target, pattern, most).items() if own & other}
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    genes = [(k, _random(rng, 60, 0.05)) for k in range(4)] + [(9, "ACG"), (10, "")]
    genome = [("a", 1, _random(rng, 200, 0.04) + genes[0][1] + genes[1][1].translate(TURN)[::-1] + "-.x" + genes[2][1]), ("b", 7, genes[3][1] * 2 + _random(rng, 300)), ("b", 8, ""), ("c", 1, "NNNN")]
    return genes, genome, spark.createDataFrame(genes, "gene_id int, seq string"), spark.createDataFrame(genome, "species string, rec long, seq string")


@pytest.mark.parametrize("pattern,step,transitions,most", [("1101011", 1, False, 16), (dna.SPACED, 1, True, 16), ("110111", 3, False, 1), ("1111111", 1, True, 4)])
def test_seeds_with_codes(tables, monkeypatch, pattern, step, transitions, most):
    genes, genome, g, t = tables
    monkeypatch.setattr(seeds, "INDEX_WORDS", 300)  # several passes
    got = [(r["gene_id"], r["strand"], r["q_pos"], r["species"], r["rec"], r["t_pos"]) for r in seeds.matches(g, t, pattern, step, transitions, most).collect()]
    assert len(got) == len(set(got)) and set(got) == _seeds(genes, genome, pattern, step, transitions, most)


def test_patterns_that_do_not_fit_a_long(tables):
    for bad in ("", "000", "1" * 32):
        with pytest.raises(ValueError):
            seeds.words(np.ones(50, np.uint8), bad)


def test_genome_words_are_neither_shuffled_nor_broadcast(tables):
    """Above the pass over the chunks there is no exchange, broadcast or join."""
    _, _, g, t = tables
    plan = kmer.seeds(g, chunks.chunked(t, 16), 16)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("MapInArrow")]
    assert "Join" not in plan and "Exchange" not in above and "Broadcast" not in above


@pytest.mark.parametrize("overlapping", [False, True])
def test_bands_are_counted_where_seeds_are_found(tables, monkeypatch, overlapping):
    """As from the seeds as rows, over chunk borders too; no seed is handed on."""
    _, _, g, t = tables
    monkeypatch.setattr(chunks, "chunked", lambda g, overlap, f=chunks.chunked: f(g, overlap, 53))
    want = kmer.diagonals(kmer.seeds(g, t, 7), 32, 2, overlapping)
    got = kmer.seed_bands(g, t, 7, band=32, least=2, overlapping=overlapping)
    rows = {tuple(r) for r in got.select(want.columns).collect()}
    assert rows == {tuple(r) for r in want.collect()} and len(rows) > 5
    plan = QUERIES["seed_bands"](g.sparkSession, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan[: plan.index("MapInArrow")]


def test_chunks_side_by_side_do_not_meet(spark, monkeypatch):
    """Records in one batch give what each gives alone: no window, diagonal or code goes over their borders."""
    rng = random.Random(4)
    genes = [(k, _random(rng, 40, 0.03)) for k in range(3)]
    cut = [(k, s[a:b]) for k, (_, s) in enumerate(genes) for a, b in ((0, 17), (17, 40), (5, 40), (0, 11))]
    records = [("a", k, s) for k, (_, s) in enumerate(cut)] + [("b", 90, ""), ("b", 91, "N" * 30), ("b", 92, genes[0][1])]
    g = spark.createDataFrame(genes, "gene_id int, seq string")
    t = spark.createDataFrame(records, "species string, rec long, seq string").coalesce(1)
    monkeypatch.setattr(seeds, "_spread", lambda df: df)
    for size in (1, 100, 1 << 18):
        monkeypatch.setattr(seeds, "SLAB", size)
        got = [tuple(r) for r in seeds.matches(g, t, "1101011", 1, True, 16).select("gene_id", "strand", "q_pos", "species", "rec", "t_pos").collect()]
        assert len(got) == len(set(got)) and set(got) == _seeds(genes, records, "1101011", 1, True, 16)


def test_a_slab_is_looked_through_without_walks_over_its_index(monkeypatch):
    """Work a chunk does not grow with the genes, and nothing of it is held when it is done."""
    import gc
    import weakref

    rng = random.Random(6)
    index = seeds.Index(None, [_random(rng, 100).encode() for _ in range(50)], dna.SPACED, 1, False, 16)
    assert index.codes is index.codes and index.heads is index.heads
    sets = seeds.base_sets(_random(rng, 5000, 0.01).encode())
    gc.disable()
    try:
        made = []
        monkeypatch.setattr(seeds, "_word", lambda p, held, f=seeds._word: made.append(weakref.ref(held["1"])) or f(p, held))
        index.matches(sets)
        assert made and all(x() is None for x in made)
    finally:
        gc.enable()


def test_few_windows_are_cut_where_the_chunks_lie(spark):
    """Whatever size Spark takes the genome for, its bases are not moved to meet the candidates."""
    rng = random.Random(2)
    text = "".join(rng.choice("ACGT") for _ in range(400))
    genes = spark.createDataFrame([(1, text[100:300])], "gene_id int, seq string")
    genome = spark.createDataFrame([("a", 1, text), ("b", 2, text[50:])], "species string, rec long, seq string")
    cfg = Config(gene_count=1, length=200, mode="fast", seed_length=24)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = modes.similarity_join(genes, genome, cfg)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") == 1 and found.count() == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_strands_at_one_place_have_one_order(spark):
    from cladeloom.operators import hits

    rows = [("a", g, 10, 1, 5, s, "ACGT") for g in range(40) for s in "-+"]
    for own in (rows, rows[::-1]):
        df = spark.createDataFrame(own, "species string, gene_id int, score long, line_no long, pos long, strand string, seq string").coalesce(1)
        assert {r["strand"] for r in hits.ranked(df, 1).collect()} == {"+"}


def test_spaced_seeds_are_more_sensitive_at_seventy_percent(spark):
    rng = random.Random(5)
    genes = [(k, "".join(rng.choice("ACGT") for _ in range(64))) for k in range(400)]
    genome = [(str(k), 0, _mutated(rng, s, 0.7)) for k, s in genes]
    g, t = spark.createDataFrame(genes, "gene_id int, seq string"), spark.createDataFrame(genome, "species string, rec long, seq string")

    def met(pattern: str) -> int:
        found = seeds.matches(g, t, pattern).filter("strand = '+' AND q_pos = t_pos AND cast(gene_id AS string) = species")
        return found.select("gene_id").distinct().count()

    spaced, contiguous = met(dna.SPACED), met("1" * 12)
    assert spaced > 1.2 * contiguous and spaced > 150


def _segment(gene: str, target: str, q: int, t: int, table: np.ndarray, drop: int) -> tuple[int, int, int]:
    def half(step: int, a: int, b: int) -> tuple[int, int]:
        total = best = length = 0
        n = 0
        while 0 <= a < len(gene) and 0 <= b < len(target):
            n += 1
            total += table["ACGT".find(gene[a].upper()), "ACGT".find(target[b].upper())]
            if total < best - drop:
                break
            if total > best:
                best, length = total, n
            a, b = a + step, b + step
        return best, length

    right, n = half(1, q, t)
    left, m = half(-1, q - 1, t - 1)
    return q - m, q + n, right + left


@pytest.mark.parametrize("size", [37, 1 << 16])
def test_segments_against_a_walk_from_every_seed(spark, monkeypatch, size):
    """Also over chunk borders: with small chunks the same segments are found."""
    monkeypatch.setattr(chunks, "SIZE", size)
    monkeypatch.setattr(chunks, "chunked", lambda g, overlap, size=size, f=chunks.chunked: f(g, overlap, size))
    rng = random.Random(8)
    genes = [(k, "".join(rng.choice("ACGT") for _ in range(n))) for k, n in enumerate([60, 80, 41])]
    parts = [_random(rng, 50)]
    for _ in range(4):
        for _, s in genes:
            own = _mutated(rng, s, rng.choice([0.75, 0.9]))
            cut = rng.randrange(len(own))
            parts += [own[:cut] + rng.choice(["", "", "AC"]) + own[cut:] if rng.random() < 0.5 else own.translate(TURN)[::-1], _random(rng, rng.randrange(30), 0.1)]
    genome = [("a", 0, "".join(parts)), ("b", 1, genes[2][1][5:])]
    pattern, drop, least = "110111", 200, 800
    table = np.zeros((5, 5), np.int64)
    table[:4, :4] = msa.HOXD55
    want: dict = {}
    for gene, strand, q, species, rec, t in _seeds(genes, genome, pattern, 1, False, 1):
        s = dict(genes)[gene] if strand == "+" else dict(genes)[gene].translate(TURN)[::-1]
        a, b, score = _segment(s, next(x for sp, r, x in genome if (sp, r) == (species, rec)), q, t, np.pad(table[:4, :4], (0, 1)), drop)
        if score >= least:
            want.setdefault((gene, strand, species, rec, t - q), set()).add((a, b, score))
    g, t = spark.createDataFrame(genes, "gene_id int, seq string"), spark.createDataFrame(genome, "species string, rec long, seq string")
    rows = seeds.segments(g, t, 80, pattern, drop=drop, least=least).collect()
    got: dict = {}
    for r in rows:
        got.setdefault((r["gene_id"], r["strand"], r["species"], r["rec"], r["t_start"] - r["q_start"]), []).append((r["q_start"], r["q_end"], r["score"]))
    assert set(got) == set(want) and len(got) > 12
    for key, own in got.items():
        assert set(own) <= want[key]
        own.sort()
        assert all(a[1] <= b[0] for a, b in zip(own, own[1:]))  # one row for what overlaps
        best = max(want[key], key=lambda x: x[2])
        assert any(x[2] == best[2] for x in own)


def test_segments_move_once(spark):
    found = spark.createDataFrame([], "gene_id int, strand string, species string, rec long, q_start int, q_end int, t_start long, score long")
    plan = seeds.merged(found.repartition(3))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_lone_segments_are_their_own_chains(spark, monkeypatch):
    """Also where a batch ends between groups, and in the zone of the segment only."""
    rng = random.Random(12)
    rows = {(k % 3, "+-"[k % 2], "ab"[k % 2], k, 0, 30, rng.randrange(400), rng.randrange(50, 90)) for k in range(300)}
    rows |= {(9, "+", "a", 7, q, q + 10, 100 + q, 40) for q in (0, 10, 20)}
    monkeypatch.setattr(seeds, "ROWS", 64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        found = spark.createDataFrame(sorted(rows), "gene_id int, strand string, species string, rec long, q_start int, q_end int, t_start long, score long")
        got = sorted(tuple(r) for r in seeds.chains(found, 50, least=60).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [(*r[:6], r[6], r[6] + 30, r[7], 1) for r in rows if r[0] != 9 and r[7] >= 60] + [(9, "+", "a", 7, 0, 30, 100, 130, 120, 3)]
    assert got == sorted(want)


def _best_chain(q0, q1, t0, score, reach, cost):
    best = 0
    n = len(q0)
    for size in range(1, n + 1):
        for own in itertools.permutations(range(n), size):
            total = score[own[0]]
            for a, b in zip(own, own[1:]):
                end = t0[a] + q1[a] - q0[a]
                if q1[a] > q0[b] or end > t0[b]:
                    break
                total += score[b] - cost * abs((t0[b] - end) - (q0[b] - q1[a]))
            else:
                if t0[own[-1]] + q1[own[-1]] - q0[own[-1]] - t0[own[0]] <= reach or size == 1:
                    best = max(best, total)
    return best


@pytest.mark.parametrize("seed", range(8))
def test_best_chain_of_few_segments(seed):
    rng = np.random.default_rng(seed)
    n = 6
    t0 = np.sort(rng.integers(0, 300, n))
    q0 = rng.integers(0, 150, n)
    q1 = q0 + rng.integers(10, 60, n)
    score = rng.integers(100, 900, n)
    got = seeds.chain(q0, q1, t0, score, 10_000, 3)
    assert got[0][0] == _best_chain(q0, q1, t0, score, 10_000, 3)
    assert sorted(k for _, own in got for k in own) == list(range(n))


def test_chains_over_zones_and_batches(spark):
    """A gene in two parts, with a gap between them, planted at the edges of zones; other columns sort elsewhere."""
    rows, want = [], set()
    for k, at in enumerate([0, 1990, 2000, 3999, 4100, 7950, 100_000]):
        rows += [(1, "+", "a", k, 0, 80, at, 7000), (1, "+", "a", k, 80, 200, at + 85, 9000), (1, "-", "a", k, 10, 60, at, 3000)]
        want |= {(k, "+", 0, 200, at, at + 205, 16000 - 50, 2), (k, "-", 10, 60, at, at + 50, 3000, 1)}
    df = spark.createDataFrame(rows, "gene_id int, strand string, species string, rec long, q_start int, q_end int, t_start long, score long")
    got = {(r["rec"], r["strand"], r["q_start"], r["q_end"], r["t_start"], r["t_end"], r["score"], r["segments"]) for r in seeds.chains(df, 1000).collect()}
    # the rest of a chain that crosses into the next zone may be told there once more
    assert want <= got and all(x[7] == 1 for x in got - want) and len(got - want) <= 3
    assert seeds.chains(df.limit(0), 1000).count() == 0


def test_a_repeat_is_split_into_zones(spark):
    """A record full of copies: no group is larger than a zone has room for."""
    n = 3000
    df = spark.range(n).selectExpr("1 AS gene_id", "'+' AS strand", "'a' AS species", "1L AS rec", "0 AS q_start", "90 AS q_end", "id * 100 AS t_start", "5000L AS score")
    rows = seeds.chains(df, 200).collect()
    assert len(rows) == n and {r["segments"] for r in rows} == {1}


def _affine(gene: str, window: str, start: int, step: int) -> int:
    """Gotoh's recurrences, cell by cell."""
    n, m = len(gene), len(window)
    h = [[0] * (m + 1) for _ in range(n + 1)]
    e = [[-(10**9)] * (m + 1) for _ in range(n + 1)]
    f = [[-(10**9)] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            a, b = gene[i - 1].upper(), window[j - 1].upper()
            s = 0 if a not in "ACGT" or b not in "ACGT" else 2 if a == b else -2
            e[i][j] = max(h[i - 1][j] - start - step, e[i - 1][j] - step)
            f[i][j] = max(h[i][j - 1] - start - step, f[i][j - 1] - step)
            h[i][j] = max(0, h[i - 1][j - 1] + s, e[i][j], f[i][j])
    return max(map(max, h))


def test_batch_alignment_against_single_cells(monkeypatch):
    monkeypatch.setattr(gapped, "CELLS", 3000)
    rng = random.Random(2)
    genes, windows = [], []
    for _ in range(60):
        g = _random(rng, rng.randrange(1, 40), 0.03)
        own = _mutated(rng, g, 0.85)
        cut = rng.randrange(len(own))
        genes.append(g)
        windows.append(_random(rng, rng.randrange(10)) + own[:cut] + rng.choice(["", "ACG", "T"]) + own[cut + rng.choice([0, 0, 2, 5]) :] + _random(rng, rng.randrange(10)))
    genes += ["", "ACGT", "AAAA"]
    windows += ["ACGT", "", "CCCC"]
    for start, step in ((4, 2), (0, 3), (7, 1)):
        got = list(gapped.local_alignments(genes, windows, start=start, step=step))
        for (score, at, a, b), g, w in zip(got, genes, windows):
            assert score == _affine(g, w, start, step) and len(a) == len(b)
            assert w[at:].startswith(b.replace("-", "")) and a.replace("-", "") in g
            said, gap = 0, None
            for x, y in zip(a.upper(), b.upper()):
                if "-" in (x, y):
                    side = x == "-"
                    said -= step if gap == side else start + step
                    gap = side
                else:
                    said += 0 if x not in "ACGT" or y not in "ACGT" else 2 if x == y else -2
                    gap = None
            assert said == score


def test_fewer_windows_and_no_hit_lost(spark):
    """Against bands of two seeds: a fraction of the candidates, and every planted copy is still found."""
    rng = random.Random(12)
    genes = [(k, "".join(rng.choice("ACGT") for _ in range(200))) for k in range(6)]
    genome, planted = [], set()
    for sp in "abcd":
        body = []
        for k, s in genes:
            body += [_random(rng, 30_000), _mutated(rng, s, 0.72)]
            planted.add((sp, k))
        genome.append((sp, 0, "".join(body)))
    g, t = spark.createDataFrame(genes, "gene_id int, seq string"), spark.createDataFrame(genome, "species string, rec long, seq string")
    cfg = Config(gene_count=6, length=200, identity=60, coverage=70, continuity=70, max_dup=5)
    bands = kmer.diagonals(kmer.seeds(g, t, 8), 32, overlapping=True).select("gene_id", "species", "rec", "strand", "diagonal").count()
    windows = modes.candidates(g, t, cfg).count()
    hits = {(r["species"], r["gene_id"]) for r in modes.similarity_join(g, t, cfg).collect()}
    assert hits == planted and windows * 10 < bands
