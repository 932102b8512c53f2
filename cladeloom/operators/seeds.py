"""Seeds, gap-free segments and colinear chains: the similarity join below the gapped alignment.

Genes are the small side.  Their seed words go to all tasks as one sorted index, in blocks of at most
``INDEX_WORDS`` words (a pass over the genomes a block), so genome words are looked up where the chunks
lie: none is shuffled or broadcast, and only what matches leaves a task.

A seed pattern is a string of 1 (bases that must match) and 0; a word is its 1-bases in a long, two bits
each.  Ambiguity codes stand for their bases: a window with such codes has a word for every choice, up to
``most`` words; windows with more have none.

Segments: from each seed the diagonal is followed to both sides, by the scores of a matrix, until the sum
falls ``drop`` below the best so far.  A diagonal is a gene against as many bases of a record, so a
chunk with a gene's length to either side is enough.  Ambiguous bases score 0.

Chains: segments of a gene, record and strand that follow one another in both, less a cost for the gap
between them.  Records are cut into zones that overlap by ``reach``, so each chain that spans no more lies
in one zone whole, and no group grows with a record.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dna import SPACED
from ..functions.msa import HOXD55
from . import chunks

# The bases that a nucleotide code stands for, as bits 1 (A), 2 (C), 4 (G), 8 (T).
BASES = {"A": 1, "C": 2, "G": 4, "T": 8, "U": 8, "R": 5, "Y": 10, "S": 6, "W": 9, "K": 12, "M": 3, "B": 14, "D": 13, "H": 11, "V": 7, "N": 15}

#: words that stand for a window with ambiguity codes: two bases of any kind
CODE_WORDS = 16
INDEX_WORDS = 1 << 22
BITMAP_BITS = 26
#: bases of a word that are looked up first, in a table of a byte for each choice
HEAD = 12
#: bases of chunks that are looked through together
SLAB = 1 << 18
ROWS = 1 << 16
CELLS = 1 << 18

_SETS = np.zeros(256, np.uint8)
for _c, _s in BASES.items():
    _SETS[ord(_c)] = _SETS[ord(_c.lower())] = _s
_COUNT = np.array([bin(s).count("1") for s in range(16)], np.int64)
_CHOICE = np.array([([k for k in range(4) if s >> k & 1] + [0] * 4)[:4] for s in range(16)], np.int64)
TURNED = np.array([sum((s >> k & 1) << 3 - k for k in range(4)) for s in range(16)], np.uint8)
_FIRST = _CHOICE[:, 0].astype(np.uint8)
_CODE = np.array([4, 0, 1, 4, 2, 4, 4, 4, 3, 4, 4, 4, 4, 4, 4, 4], np.uint8)  # of a set: one base, or 4


def base_sets(seq: bytes) -> np.ndarray:
    """A set of bases for each letter; none for what is no nucleotide code."""
    return _SETS[np.frombuffer(seq, np.uint8)]


def _places(pattern: str) -> list[int]:
    at = [k for k, c in enumerate(pattern) if c == "1"]
    if not at or len(at) > 31:
        raise ValueError("a pattern has 1 to 31 places that must match")
    return at


def _word(p: str, held: dict[str, np.ndarray]) -> np.ndarray:
    """The words of a pattern that begins and ends with 1, from those of two parts."""
    if p not in held:
        half, ones = len(p) // 2, p.find("0")
        if p == 2 * p[:half]:
            at = half
        else:
            at = ones if ones >= 0 else 1 << (len(p) - 1).bit_length() - 1
        before, after = p[:at].rstrip("0"), p[at:].lstrip("0")
        at = len(p) - len(after)
        first, then = _word(before, held), _word(after, held)
        n = max(0, len(held["1"]) - len(p) + 1)
        word = first[:n].astype(np.int32 if p.count("1") < 16 else np.int64)
        word <<= 2 * after.count("1")
        word |= then[at : at + n]
        held[p] = word
    return held[p]


def rolled(codes: np.ndarray, pattern: str) -> np.ndarray:
    """The word of every window of base codes below 4: words of parts of the pattern, joined; equal parts are made once."""
    lead = pattern.index("1")
    return _word(pattern.strip("0"), {"1": codes})[lead : lead + max(0, len(codes) - len(pattern) + 1)]


def _apart(sets: np.ndarray, at: list[int], n: int) -> np.ndarray:
    """Which of the first ``n`` windows have a place that stands for no base or several."""
    out = np.zeros(n, bool)
    codes = np.flatnonzero(_CODE[sets] > 3)
    for k in at if len(codes) else ():
        own = codes - k
        out[own[(own >= 0) & (own < n)]] = True
    return out


def _several(sets: np.ndarray, where: np.ndarray, at: list[int], most: int) -> tuple[np.ndarray, np.ndarray]:
    """``(position, word)`` of the windows at ``where`` that stand for ``most`` words at most."""
    choices = np.ones(len(where), np.int64)
    for k in at if len(where) else ():
        choices = np.minimum(choices * _COUNT[sets[where + k]], most + 1)
    own = where[(choices > 0) & (choices <= most)]
    word = np.zeros(len(own), np.int64)
    for k in at if len(own) else ():
        s = sets[own + k]
        times = _COUNT[s]
        which = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        own, word, s = np.repeat(own, times), np.repeat(word, times), np.repeat(s, times)
        word = word << 2 | _CHOICE[s, which]
    return own, word


def words(sets: np.ndarray, pattern: str, most: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """``(position, word)`` of all windows, those of windows with ambiguity codes last."""
    at = _places(pattern)
    n = len(sets) - len(pattern) + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    apart = _apart(sets, at, n)
    plain = np.flatnonzero(~apart)
    word = rolled(_FIRST[sets], pattern)[plain].astype(np.int64)
    if most == 1:
        return plain, word
    own, more = _several(sets, np.flatnonzero(apart), at, most)
    return np.concatenate([plain, own]), np.concatenate([word, more])


def _once(*keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows of several columns, sorted, each once."""
    order = np.lexsort(keys[::-1])
    own = [x[order] for x in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in own])
    return tuple(x[new] for x in own)


class Index:
    """The words of a block of genes on both strands, sorted."""

    def __init__(self, ids: pa.Array, seqs: list[bytes], pattern: str, step: int, transitions: bool, most: int):
        self.ids, self.pattern, self.most = ids, pattern, most
        #: row 2 * gene + (strand is minus)
        self.rows = [x for s in map(base_sets, seqs) for x in (s, TURNED[s[::-1]])]
        word, row, at = [], [], []
        for k, sets in enumerate(self.rows):
            p, w = words(sets, pattern, most)
            p, w = p[p % step == 0], w[p % step == 0]
            if transitions:  # the other purine or pyrimidine differs in a base's higher bit
                turns = np.append(0, 2 << 2 * np.arange(pattern.count("1")))
                p, w = np.repeat(p, len(turns)), (w[:, None] ^ turns).ravel()
            word.append(w)
            at.append(p.astype(np.int32))
            row.append(np.full(len(p), k, np.int32))
        word, row, at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (word, row, at))
        # with codes, a transition of one choice may be another
        word, row, at = _once(word, row, at)
        self.row, self.at = row, at
        #: each word once, and where its rows begin
        self.first = np.flatnonzero(np.append(True, word[1:] != word[:-1])[: len(word)])
        self.word, self.first = word[self.first], np.append(self.first, len(word))

    # the tables below are made where they are used, and not sent

    @cached_property
    def bits(self) -> np.ndarray:
        slot = self._slot(self.word)
        out = np.zeros(1 << BITMAP_BITS - 6, np.uint64)
        np.bitwise_or.at(out, slot >> 6, np.uint64(1) << (slot & 63).astype(np.uint64))
        return out

    @cached_property
    def head(self) -> str:
        """The pattern up to its first ``HEAD`` places that must match."""
        return self.pattern[: _places(self.pattern)[:HEAD][-1] + 1]

    @cached_property
    def heads(self) -> np.ndarray:
        """Whether a word of the index begins so."""
        own = self.head.count("1")
        out = np.zeros(1 << 2 * own, bool)
        out[self.word >> 2 * (self.pattern.count("1") - own)] = True
        return out

    @cached_property
    def codes(self) -> np.ndarray:
        """The rows' base codes, padded."""
        out = np.full((len(self.rows), max(map(len, self.rows), default=1)), 5, np.uint8)
        for k, s in enumerate(self.rows):
            out[k, : len(s)] = _CODE[s]
        return out

    @staticmethod
    def _slot(word: np.ndarray) -> np.ndarray:
        return (word.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)

    def matches(self, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(row, place in the gene, place in sets)`` of all seeds; a window's whole word is made only
        where its head is one of the index."""
        places = _places(self.pattern)
        n = len(sets) - len(self.pattern) + 1
        if n <= 0 or not len(self.word):
            return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64)
        codes = _FIRST[sets]
        head = rolled(codes, self.head)[:n]
        at = np.flatnonzero(self.heads[head])
        apart = _apart(sets, places, n)
        at = at[~apart[at]]
        word = head[at].astype(np.int64)
        for k in places[HEAD:]:
            word = word << 2 | codes[at + k]
        plain = len(at)
        if self.most > 1:
            own, more = _several(sets, np.flatnonzero(apart), places, self.most)
            at, word = np.concatenate([at, own]), np.concatenate([word, more])
        slot = self._slot(word)
        met = np.flatnonzero(self.bits[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1))
        at, word, plain = at[met], word[met], np.searchsorted(met, plain)
        k = np.minimum(np.searchsorted(self.word, word), len(self.word) - 1)
        met = self.word[k] == word
        at, k, plain = at[met], k[met], int(met[:plain].sum())
        n = self.first[k + 1] - self.first[k]
        where = np.repeat(self.first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
        row, q, t = self.row[where], self.at[where], np.repeat(at, n)
        plain = n[:plain].sum()
        if plain < len(q):  # ambiguity on both sides meets by several words
            row, q, t = (np.concatenate([x[:plain], y]) for x, y in zip((row, q, t), _once(row[plain:], q[plain:], t[plain:])))
        return row, q, t


def indexes(genes: DataFrame, pattern: str, step: int, transitions: bool, most: int) -> Iterator[Index]:
    """The genes' index in blocks of about ``INDEX_WORDS`` words; a block's genes come to the driver."""
    own = genes.select("gene_id", F.col("seq").cast("binary").alias("seq")).filter(F.octet_length("seq") >= len(pattern))
    bases = own.agg(F.coalesce(F.sum(F.octet_length("seq")), F.lit(0)).cast("long")).first()[0]
    blocks = max(1, -(-bases * 2 * (pattern.count("1") + 1 if transitions else 1) // (step * INDEX_WORDS)))
    for k in range(blocks):
        table = own.filter(F.pmod(F.xxhash64("gene_id"), F.lit(blocks)) == k).toArrow().sort_by("gene_id").combine_chunks()
        if table.num_rows or not k:
            yield Index(table.column("gene_id").combine_chunks(), table.column("seq").to_pylist(), pattern, step, transitions, most)


def _spread(df: DataFrame) -> DataFrame:
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= slots else df.repartition(slots)


class Slab:
    """Chunks side by side: their sets of bases, and where each begins there, its start in the record, its
    own bases and all of its bases."""

    def __init__(self, sets: np.ndarray, at: np.ndarray, start: np.ndarray, own: np.ndarray):
        self.sets, self.at, self.start, self.own, self.length = sets, at[:-1], start, own, np.diff(at)

    def chunk_of(self, t: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, t, "right") - 1


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column's values, end to end, and where each begins, with the end."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(at, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slabs(batch: pa.RecordBatch, table: np.ndarray = _SETS) -> Iterator[tuple[int, Slab]]:
    """A batch's chunks in groups of about ``SLAB`` bases, looked up in ``table``: the first one's row, and the group."""
    data, at = joined(batch.column("seq"))
    start, own = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "own"))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + SLAB, "right")) - 1)
        yield lo, Slab(table[data[at[lo] : at[hi]]], at[lo : hi + 1] - at[lo], start[lo:hi], own[lo:hi])
        lo = hi


def _over_chunks(genes: DataFrame, genome: DataFrame, overlap: int, index_of: dict, columns: list[tuple[str, pa.DataType, str]], work) -> DataFrame:
    """``(gene_id, strand, species, rec, *columns)``: what ``work(index, slab)`` finds in each slab of chunks:
    rows of the index, chunks of the slab, and a list of arrays."""
    own = _spread(chunks.chunked(genome, overlap).select("species", "rec", "start", "own", F.col("seq").cast("binary").alias("seq")))
    kinds = {f.name: f.dataType.simpleString() for f in [*genes.schema, *own.schema]}
    schema = f"gene_id {kinds['gene_id']}, strand string, species {kinds['species']}, rec {kinds['rec']}, " + ", ".join(f"{n} {t}" for n, _, t in columns)
    names = ["gene_id", "strand", "species", "rec", *(n for n, _, _ in columns)]
    signs = pa.array(["+", "-"])

    def over(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                held, n = [], 0

                def rows() -> Iterator[pa.RecordBatch]:
                    row, chunk, *found = (np.concatenate(x) for x in zip(*held))
                    for lo in range(0, len(row), ROWS):
                        part, here = row[lo : lo + ROWS], pa.array(chunk[lo : lo + ROWS])
                        yield pa.RecordBatch.from_arrays(
                            [index.ids.take(pa.array(part >> 1)), signs.take(pa.array(part & 1)), batch.column("species").take(here), batch.column("rec").take(here), *(pa.array(x[lo : lo + ROWS], t) for x, (_, t, _) in zip(found, columns))],
                            names=names,
                        )

                for first, slab in slabs(batch):
                    row, chunk, found = work(index, slab)
                    if len(row):
                        held.append((row, chunk + first, *found))
                        n += len(row)
                    if n >= ROWS:
                        yield from rows()
                        held, n = [], 0
                if held:
                    yield from rows()

        return run

    sc = genes.sparkSession.sparkContext
    parts = [own.mapInArrow(over(sc.broadcast(index)), schema) for index in indexes(genes, **index_of)]
    return reduce(DataFrame.union, parts)


def _in_slab(index: Index, slab: Slab) -> tuple[np.ndarray, ...]:
    """``(row, place in the gene, place in the slab, chunk, place in the chunk)`` of the seeds that lie in one chunk."""
    row, q, t = index.matches(slab.sets)
    chunk = slab.chunk_of(t)
    inside = t - slab.at[chunk]
    whole = np.flatnonzero(inside + len(index.pattern) <= slab.length[chunk])
    return tuple(x[whole] for x in (row, q, t, chunk, inside))


def matches(genes: DataFrame, genome: DataFrame, pattern: str = SPACED, step: int = 1, transitions: bool = False, most: int = 1) -> DataFrame:
    """``(gene_id, strand, q_pos, species, rec, t_pos)``: all seeds on both strands.

    ``step`` thins the genes' words; with ``transitions`` one base of a seed may be the other purine or
    the other pyrimidine; ``most`` words at most stand for a window with ambiguity codes.
    """

    def work(index: Index, slab: Slab) -> tuple:
        row, q, _, chunk, t = _in_slab(index, slab)
        own = np.flatnonzero(t < slab.own[chunk])
        row, q, chunk, t = row[own], q[own], chunk[own], t[own]
        return row, chunk, [q, t + slab.start[chunk]]

    columns = [("q_pos", pa.int32(), "int"), ("t_pos", pa.int64(), "long")]
    index_of = {"pattern": pattern, "step": step, "transitions": transitions, "most": most}
    out = _over_chunks(genes, genome, len(pattern), index_of, columns, work)
    return out.select("gene_id", "strand", "q_pos", "species", "rec", "t_pos")


def bands(genes: DataFrame, genome: DataFrame, pattern: str = SPACED, step: int = 1, transitions: bool = False, most: int = 1, width: int = 32, overlapping: bool = False) -> DataFrame:
    """``(gene_id, strand, species, rec, diagonal, seeds, t_start, t_end)``: how many seeds of each chunk lie
    in a band of diagonals, and the first and the last place; bands of a record add up.

    With ``overlapping``, a band begins every half band, and each seed is in two.  No seed leaves its task.
    """
    every = width // 2 if overlapping else width

    def work(index: Index, slab: Slab) -> tuple:
        row, q, _, chunk, t = _in_slab(index, slab)
        own = np.flatnonzero(t < slab.own[chunk])
        row, chunk, t, q = row[own], chunk[own], (t + slab.start[chunk])[own], q[own]
        d = (t - q) // every
        if overlapping:
            row, chunk, t, d = np.tile(row, 2), np.tile(chunk, 2), np.tile(t, 2), np.concatenate([d, d - 1])
        order = np.lexsort((t, d, row, chunk))
        row, chunk, t, d = row[order], chunk[order], t[order], d[order]
        first = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (row[1:] != row[:-1]) | (chunk[1:] != chunk[:-1]))[: len(d)])
        n = np.diff(np.append(first, len(d)))
        return row[first], chunk[first], [d[first], n, t[first], t[first + n - 1]]

    columns = [(c, pa.int64(), "long") for c in ("diagonal", "seeds", "t_start", "t_end")]
    index_of = {"pattern": pattern, "step": step, "transitions": transitions, "most": most}
    return _over_chunks(genes, genome, len(pattern), index_of, columns, work)


# ------------------------------------------------------------------ gap-free segments


def score_table(matrix: list[list[float]] = HOXD55) -> np.ndarray:
    """Scores of base codes; 0 for an ambiguous base (code 4), far below any sum outside either sequence (5)."""
    out = np.zeros((6, 6), np.int64)
    out[:4, :4] = matrix
    out[5, :] = out[:, 5] = -(1 << 40)
    return out


def _half(s: np.ndarray, drop: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row, the best sum of a beginning before the sum falls ``drop`` below it, and its length."""
    total = np.concatenate([np.zeros((len(s), 1), np.int64), np.cumsum(s, axis=1)], axis=1)
    top = np.maximum.accumulate(total, axis=1)
    fallen = total < top - drop
    stop = np.where(fallen.any(axis=1), fallen.argmax(axis=1), total.shape[1])
    best = top[np.arange(len(s)), stop - 1]
    return best, (total == best[:, None]).argmax(axis=1)


def extend(genes: np.ndarray, codes: np.ndarray, row: np.ndarray, q: np.ndarray, t: np.ndarray, table: np.ndarray, drop: int) -> tuple[np.ndarray, ...]:
    """``(q_start, q_end, score)`` of the segment that each seed grows to; ``codes`` has padding of a gene's
    width around each sequence."""
    width = genes.shape[1]
    outs = []
    for lo in range(0, len(row), max(1, CELLS // width)):
        r, a, b = (x[lo : lo + max(1, CELLS // width)] for x in (row, q, t))
        at = (b - a)[:, None] + np.arange(width)
        s = table[genes[r], codes[at]]
        on = np.arange(width)[None, :]
        right, n = _half(np.where(on + a[:, None] < width, np.take_along_axis(s, np.minimum(on + a[:, None], width - 1), 1), table[5, 5]), drop)
        left, m = _half(np.where(on < a[:, None], np.take_along_axis(s, np.maximum(a[:, None] - 1 - on, 0), 1), table[5, 5]), drop)
        outs.append((a - m, a + n, left + right))
    return tuple(np.concatenate(x) for x in zip(*outs)) if outs else (np.zeros(0, np.int64),) * 3


def segments(
    genes: DataFrame, genome: DataFrame, longest: int, pattern: str = SPACED, step: int = 1, transitions: bool = False, most: int = 1, matrix: list[list[float]] = HOXD55, drop: int = 910, least: int = 0
) -> DataFrame:
    """``(gene_id, strand, species, rec, q_start, q_end, t_start, score)``: gap-free segments that score at
    least ``least``, each once.

    Seeds less than the pattern's span apart on a diagonal grow as one.  ``longest`` is the longest gene's
    length; a table of chunks must reach ``2 * longest`` bases beyond each chunk.
    """
    table, span = score_table(matrix), len(pattern)

    def work(index: Index, slab: Slab) -> tuple:
        row, q, t, chunk, inside = _in_slab(index, slab)
        lo = np.where(slab.start > 0, longest, 0)[chunk]
        own = np.flatnonzero((inside >= lo) & (inside < longest + slab.own[chunk]))
        row, q, t, chunk, inside = (x[own].astype(np.int64) for x in (row, q, t, chunk, inside))
        # chunks with seeds, apart by a gene's width, so that none is met from another's diagonals
        width = index.codes.shape[1]
        used, k = np.unique(chunk, return_inverse=True)
        at = width + np.cumsum(slab.length[used] + width) - slab.length[used] - width
        codes = np.full(int(slab.length[used].sum()) + width * (len(used) + 1), 5, np.uint8)
        for c, p in zip(used.tolist(), at.tolist()):
            codes[p : p + slab.length[c]] = _CODE[slab.sets[slab.at[c] : slab.at[c] + slab.length[c]]]
        t = at[k] + inside
        order = np.lexsort((q, t - q, row))
        row, q, t, k = row[order], q[order], t[order], k[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | ((t - q)[1:] != (t - q)[:-1]) | (q[1:] - q[:-1] >= span)
        row, q, t, k = row[new], q[new], t[new], k[new]
        a, b, score = extend(index.codes, codes, row, q, t, table, drop)
        keep = np.flatnonzero(score >= least)
        row, a, b, first, k = row[keep], a[keep], b[keep], (t - q + a)[keep], k[keep]
        chunk = used[k]
        return row, chunk, [a, b, first - at[k] + slab.start[chunk], score[keep]]

    columns = [("q_start", pa.int32(), "int"), ("q_end", pa.int32(), "int"), ("t_start", pa.int64(), "long"), ("score", pa.int64(), "long")]
    index_of = {"pattern": pattern, "step": step, "transitions": transitions, "most": most}
    return merged(_over_chunks(genes, genome, 2 * longest + span, index_of, columns, work))


def merged(found: DataFrame) -> DataFrame:
    """Of segments of one diagonal that overlap, the best (then the longest, then the first) stands for all.

    A diagonal has as many segments as fit a gene, so no group is large.
    """
    place = ["gene_id", "strand", "species", "rec", "diagonal"]
    rows = found.withColumn("diagonal", F.col("t_start") - F.col("q_start")).repartition(*place).distinct()
    by = Window.partitionBy(*place).orderBy("q_start", "q_end")
    before = F.max("q_end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("run", F.sum(F.when(F.col("q_start") >= before, 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max_by(F.struct("q_start", "q_end", "t_start", "score"), F.struct("score", F.col("q_end") - F.col("q_start"), -F.col("q_start")))
    return rows.groupBy(*place, "run").agg(best.alias("b")).select("gene_id", "strand", "species", "rec", "b.*")


# ------------------------------------------------------------------ chains


def chain(q0: np.ndarray, q1: np.ndarray, t0: np.ndarray, score: np.ndarray, reach: int, cost: int) -> list[tuple[int, list[int]]]:
    """Chains of segments sorted by ``t0``, best first; each segment is in one chain.

    A segment follows another if it begins at or after its end in both, and the chain spans at most
    ``reach`` bases of the record; the link costs ``cost`` for every base by which the two gaps differ.
    """
    n, t1 = len(q0), t0 + q1 - q0
    total, back, begin = score.astype(np.int64).copy(), np.full(n, -1), t0.copy()
    for k in range(1, n):
        ok = np.flatnonzero((q1[:k] <= q0[k]) & (t1[:k] <= t0[k]) & (t1[k] - begin[:k] <= reach))
        if len(ok):
            gain = total[ok] - cost * np.abs((t0[k] - t1[ok]) - (q0[k] - q1[ok]))
            j = int(gain.argmax())
            if gain[j] > 0:
                total[k], back[k], begin[k] = score[k] + gain[j], ok[j], begin[ok[j]]
    free = np.ones(n, bool)
    out = []
    for k in np.argsort(-total, kind="stable").tolist():
        own, at = [], k
        while at >= 0 and free[at]:
            own.append(at)
            at = int(back[at])
        if own and own[0] == k:
            free[own] = False
            out.append((int(total[k] - (total[at] if at >= 0 else 0)), own[::-1]))
    return out


CHAIN = "q_start int, q_end int, t_start long, t_end long, score long, segments int"


def chains(found: DataFrame, reach: int, cost: int = 10, least: int = 0) -> DataFrame:
    """``(gene_id, strand, species, rec, q_start, q_end, t_start, t_end, score, segments)``: the best chains.

    A zone begins every ``2 * reach`` bases and reaches ``reach`` further; a chain is kept by the zone
    in whose own part it begins, and a segment goes to two zones at most.
    """
    step = 2 * reach
    zone = F.floor(F.col("t_start") / step)
    inside = F.col("t_start") - zone * step
    rows = found.withColumn("zone", F.explode(F.when((inside < reach) & (zone > 0), F.array(zone - 1, zone)).otherwise(F.array(zone))))
    keys = ["gene_id", "strand", "species", "rec", "zone"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    rows = rows.select(*keys, "q_start", "q_end", "t_start", "score").repartition(*keys).sortWithinPartitions(*keys, "t_start", "q_start", "q_end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*keys[:4], *(x.split()[0] for x in CHAIN.split(", "))]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        held = None

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            """Whole groups of sorted rows."""
            at = np.array(_edges(table, keys))
            q0, q1, t0, score, zone = (table.column(c).to_numpy().astype(np.int64) for c in ("q_start", "q_end", "t_start", "score", "zone"))
            n, at = np.diff(at), at[:-1]
            alone = at[n == 1]
            alone = alone[(t0[alone] // step == zone[alone]) & (score[alone] >= least)]
            found = [(alone, alone, score[alone], np.ones(len(alone), np.int64))]
            for a, b in zip(at[n > 1].tolist(), (at + n)[n > 1].tolist()):
                got = [(a + own[0], a + own[-1], total, len(own)) for total, own in chain(q0[a:b], q1[a:b], t0[a:b], score[a:b], reach, cost)]
                got = [x for x in got if t0[x[0]] // step == zone[a] and x[2] >= least]
                if got:
                    found.append(tuple(map(np.array, zip(*got))))
            first, last, total, many = (np.concatenate(x) for x in zip(*found))
            for lo in range(0, len(first), ROWS):
                f, e = first[lo : lo + ROWS], last[lo : lo + ROWS]
                columns = [q0[f], q1[e], t0[f], t0[e] + q1[e] - q0[e], total[lo : lo + ROWS], many[lo : lo + ROWS]]
                yield pa.RecordBatch.from_arrays([*(table.column(c).take(pa.array(f)).combine_chunks() for c in keys[:4]), *(pa.array(c, t) for c, t in zip(columns, types))], names=names)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            cut = _edges(table, keys)[-2] if table.num_rows else 0  # the last group may go on in the next batch
            yield from done(table.slice(0, cut))
            held = table.slice(cut)
        if held is not None:
            yield from done(held)

    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keys[:4]) + ", " + CHAIN)


def _edges(table: pa.Table, keys: list[str]) -> list[int]:
    """Where groups of equal keys begin, and the end."""
    if not table.num_rows:
        return [0]
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for c in keys:
        code = table.column(c).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return [*np.flatnonzero(new).tolist(), table.num_rows]
