"""Hierarchical Pitman-Yor language model, trained and applied over the whole corpus.

Tokens are the blank-separated words of the text with A-Z lower-cased, then one end token.  The
model spells words by the pieces of a public byte-level vocabulary, the longest that fits first;
last pieces mark the end of a word, so pieces and words give each other.  Frequent words are one piece.

The restaurants: every word is a context with a restaurant of its own, which serves the first piece
of the word after it (the end token is the context of a text's first word); every beginning of a
word is a context as well, which serves the piece that follows in the word.  All word contexts share
one parent, the unigram restaurant of first pieces; all beginnings share another, that of later
pieces; both have a uniform base.  No word, context or pair is left out, however rare.

A word that training does not hold parts from the known words at some piece.  It counts with the
probability of all words that part there, and its further pieces count nothing: like the base
score's one unseen word, that is the probability of meeting an unseen word, not of its spelling.
With it, the probabilities of all known words and of all ways to part from them add up to one.

Seating is sampled by Gibbs sweeps.  The weight of a restaurant's seating is
``(strength | d)_T / (strength | 1)_C`` times, for each dish, ``S_d(c, t) P(w)^t``, where T are its
tables, C its customers, P the parent's probability and S_d the generalised Stirling numbers, that
is, the sum over all ways in which c customers sit at t tables.  ``(strength | d)_T`` is the moment
of a gamma variable: given ``g ~ Gamma(strength / d + T)`` the dishes are independent, each with
``p(t) ~ S_d(c, t) (d g P(w))^t``, which is drawn directly, all customers of a dish at once.
Strengths are drawn as well, on a grid under their exact likelihood.  Contexts are seated against the
parent's probabilities of the sweep before, as is usual where sampling is distributed.  Discounts
come from the counts of counts (n1 / (n1 + 2 n2)).  Predictive probabilities are averaged over the
sweeps after burn-in.

Numbers: S_d is exact up to ``EXACT`` customers (and ``TABLES`` tables).  Beyond, the tables of a
dish are drawn from the law that theirs tends to: one plus a Poisson number where they are few, and
a normal number, by the saddle point, where they are many.

What grows with the corpus stays distributed.  Words are a shuffled table of hash, bytes and count,
which gives the beginnings their customers.  Pairs of word and first piece are counted in tasks and
added up in buckets by context; a context serves at most as many dishes as there are pieces, so its
pairs are one bucket's and yet bounded.  A bucket draws tables in every sweep, once: a sweep is a job
that writes its draws, with those of the kept sweeps before it, and later jobs read them.  Its numbers
are seeded, so a lost task is repeated alike.  Per sweep, sums over pieces come to the driver; their
number, and that of what goes to all tasks, is that of the vocabulary's pieces.

Scores: what follows a word's first piece depends on the word alone, so it is reckoned once a word.
The ``HEAD_WORDS`` and ``HEAD_PAIRS`` most frequent words and pairs, at most, go to all tasks with
their figures.  Other words are joined.  Other pairs go from blocks of documents to the buckets, each
with the documents that have it, and a bucket sends back to each block the sum per document.

Defined cases: null and empty texts are one end token; repeated rows are scored alike; null ids
belong to no held-out fold and train; without training documents every word is unseen, which is
certain (score and base_score 0); an empty table gives an empty result; a text of any length is
read whole; other columns are ignored.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Scratch, read, with_bytes
from .labelled import fold
from .packing import Encoder, tokenizer_path

HEAD_WORDS = 1 << 18
HEAD_PAIRS = 1 << 20
FOLDS, HELD_OUT = 7, 2
BURN_IN, SAMPLES = 2, 3
EXACT, TABLES = 4096, 512
BLOCK_UNITS, BLOCK_ROWS = 1 << 20, 1 << 19
BUCKET_UNITS = 1 << 23
CHUNK = 1 << 18
SLICE_ROWS, SLICE_BYTES = 2048, 1 << 21
FLUSH = 800_000
BATCH = "4m"
CACHE = 200_000
HEAD = 6
END = b" "  # no word holds a blank
PIECES = 1 << 16


def tokens_of(raw: bytes) -> list[bytes]:
    return [*raw.lower().split(), END]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])


def coded(column: pa.Array) -> tuple[pa.LargeBinaryArray, np.ndarray, np.ndarray]:
    """The distinct words of some texts; the tokens as places there, the end token as the place after
    the last; how many each text has."""
    column = column.cast(pa.large_binary())
    bound = np.frombuffer(column.buffers()[1], np.int64)[column.offset :][: len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[bound[0] : bound[-1]]
    inner = ~_BLANK[data]
    first = inner.copy()
    first[1:] &= ~inner[:-1]
    begin = bound[:-1][np.diff(bound) > 0] - bound[0]
    first[begin] = inner[begin]
    letters, at = _LOWER[data[inner]], np.flatnonzero(first[inner])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(letters)).astype(np.int64)), pa.py_buffer(letters)])
    both = words.dictionary_encode()
    n = np.diff(np.searchsorted(np.flatnonzero(first), bound - bound[0])) + 1
    end = np.zeros(int(n.sum()), bool)
    end[np.cumsum(n) - 1] = True
    out = np.full(len(end), len(both.dictionary), np.int64)
    out[~end] = both.indices.to_numpy()
    return both.dictionary, out, n


def _listed(words: pa.LargeBinaryArray) -> list[bytes]:
    """Of an array that begins with its buffers."""
    cut = np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1].tolist()
    raw = bytes(words.buffers()[2] or b"")
    return [raw[a:b] for a, b in zip(cut, cut[1:])]


def tokenized(column: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of some texts, the end token last; the tokens as places in that list; how many
    each text has."""
    words, tokens, n = coded(column)
    return [*_listed(words), END], tokens, n


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of at most ``SLICE_ROWS`` rows and ``SLICE_BYTES`` bytes of text, or one row."""
    size = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(size, (size[lo - 1] if lo else 0) + SLICE_BYTES, "right"))
        hi = min(max(hi, lo + 1), lo + SLICE_ROWS)
        yield batch.slice(lo, hi - lo)
        lo = hi


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64 bits a word."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


# ---------------------------------------------------------------- words


def word_counts(texts: DataFrame, in_train: str) -> DataFrame:
    """``(h, word, c)``: the distinct words and how often each stands in training texts.

    Tasks count before the shuffle: slices of texts by themselves, and their counts together whenever
    they are ``FLUSH`` words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, units = [], 0

        def out() -> pa.RecordBatch:
            both = pa.concat_arrays([w for w, _ in held]).dictionary_encode()
            words = _listed(both.dictionary)
            c = np.bincount(both.indices.to_numpy(), np.concatenate([c for _, c in held]), minlength=len(words))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(word_hashes(words).view(np.int64)), pa.array(words, pa.binary()), pa.array(c.astype(np.int64))], names=["h", "word", "c"])

        for batch in batches:
            for part in slices(batch, 0):
                words, tokens, n = coded(part.column(0))
                train = np.repeat(part.column(1).to_numpy(zero_copy_only=False).astype(bool), n)
                held.append((pa.concat_arrays([words, pa.array([END], pa.large_binary())]), np.bincount(tokens[train], minlength=len(words) + 1)))
                units += len(words) + 1
                if units >= FLUSH:
                    yield out()
                    units = 0
        if held:
            yield out()

    counted = texts.select("_bytes", in_train).mapInArrow(run, "h long, word binary, c long")
    return counted.groupBy("h").agg(F.min("word").alias("word"), F.sum("c").alias("c"))


def frequent(sizes: dict[int, int], most: int) -> int | None:
    """The least power of two such that at most ``most`` things are as frequent; ``sizes`` has how
    many there are by bit length of their count."""
    total, least = 0, None
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > most or not k:
            break
        least = 1 << k - 1
    return least


_MASK = (1 << 64) - 1


def _prefix(before: int, piece: int) -> int:
    """The context of a word's beginning, from that of the beginning one piece shorter; odd."""
    x = (before ^ piece + 1) * 0x9E3779B97F4A7C15 & _MASK
    x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & _MASK
    return x ^ x >> 32 | 1


class Speller:
    """A word's pieces: the longest of the vocabulary first."""

    def __init__(self, path: str):
        encoder = Encoder(path)
        byte = {c: bytes([k]) for k, c in enumerate(encoder.letters)}
        self.inner, self.last = {}, {}
        for token, n in encoder.tokenizer.get_vocab(with_added_tokens=False).items():
            text = token.removesuffix("</w>")
            if text and all(c in byte for c in text):
                (self.last if text != token else self.inner)[b"".join(byte[c] for c in text)] = n
        if any(bytes([k]) not in d for k in range(256) for d in (self.inner, self.last)):
            raise ValueError("the vocabulary has no piece for some byte")
        self.longest = max(map(len, self.inner))
        # the longest piece that begins each beginning of a piece
        self.begins: dict[bytes, tuple[int, int]] = {}
        for k in range(1, self.longest + 1):
            for begin in {x[:k] for x in self.inner if len(x) >= k}:
                self.begins[begin] = (self.inner[begin], k) if begin in self.inner else self.begins[begin[:-1]]
        self.heads: dict[bytes, tuple[int, int]] = {}
        self.end = encoder.tokenizer.get_vocab_size()

    def first(self, word: bytes) -> tuple[int, int]:
        """The first piece and its length."""
        if word == END:
            return self.end, 1
        n = self.last.get(word)
        if n is not None:
            return n, len(word)
        if len(word) <= HEAD:
            return self._walk(word, min(len(word) - 1, self.longest))
        # where no piece begins like the word's head, the head decides
        got = self.heads.get(word[:HEAD])
        if got is None:
            got = self._walk(word, min(len(word) - 1, self.longest))
            if word[:HEAD] not in self.begins:
                if len(self.heads) >= CACHE:
                    self.heads.clear()
                self.heads[word[:HEAD]] = got
        return got

    def _walk(self, word: bytes, most: int) -> tuple[int, int]:
        """The longest piece of at most ``most`` bytes that begins the word."""
        k, find = min(most, 4), self.begins.get
        got = find(word[:k])
        while got is None:
            k -= 1
            got = find(word[:k])
        while k < most:
            k += 1
            more = find(word[:k])
            if more is None:
                break
            got = more
        return got

    def pieces(self, word: bytes) -> list[int]:
        out = []
        while word:
            n, k = self.first(word)
            out.append(n)
            word = word[k:]
        return out


@lru_cache(maxsize=2)
def speller_of(path: str) -> Speller:
    """One a worker process: reading the vocabulary takes longer than many a task."""
    return Speller(path)


class Words(dict):
    """A bounded cache from a word to its row in arrays: its code, its first piece, its context.

    The code is the word's row in the table of head words, by binary search, or -1.  A word's context
    is its hash, made even; contexts are numbered by the rows here.
    """

    def __init__(self, hashes: np.ndarray, speller: Speller):
        self.order = np.argsort(hashes, kind="stable")
        self.sorted = hashes[self.order]
        self.first_of = speller.first
        self.fresh()

    def fresh(self) -> None:
        self.clear()
        self.code, self.first, self.hash = array("q"), array("q"), array("Q")

    def rows(self, words: list[bytes]) -> np.ndarray:
        """The rows of distinct words; new ones get theirs."""
        out = np.fromiter(map(self.get, words, repeat(-1)), np.int64, len(words))
        at = np.flatnonzero(out < 0)
        if len(at):
            new = [words[j] for j in at.tolist()]
            out[at] = np.arange(len(self), len(self) + len(new))
            self.update(zip(new, out[at].tolist()))
            h = word_hashes(new)
            code = np.full(len(h), -1)
            if len(self.sorted):
                k = np.minimum(np.searchsorted(self.sorted, h.view(np.int64)), len(self.sorted) - 1)
                code = np.where(self.sorted[k] == h.view(np.int64), self.order[k], -1)
            self.code.frombytes(code.astype(np.int64).tobytes())
            self.hash.frombytes((h & np.uint64(_MASK - 1)).tobytes())
            self.first.extend([n for n, _ in map(self.first_of, new)])
        return out

    def read(self, words: list[bytes], tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the tokens, which are places in ``words``, and context and first piece of each as one
        number; the last token is the end token, and so is what each text's first word stands after."""
        at = self.rows(words)[tokens]
        before = np.concatenate([at[-1:], at[:-1]])
        return at, before << 16 | np.frombuffer(self.first, np.int64)[at]

    def codes(self, at: np.ndarray) -> np.ndarray:
        return np.frombuffer(self.code, np.int64)[at]

    def hashes(self) -> np.ndarray:
        return np.array(self.hash, np.uint64)


# ---------------------------------------------------------------- arrays in rows


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of bytes."""
    width = 1 if not len(values) else max(1, (int(values.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return len(values).to_bytes(7, "little") + bytes([width]) + pa.compress(planes, "zstd", asbytes=True)


def _unpack(raw: bytes) -> np.ndarray:
    n, width = int.from_bytes(raw[:7], "little"), raw[7]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(pa.decompress(raw[8:], n * width, "zstd"), np.uint8).reshape(width, n).T if n else 0
    return out.view("<u8").ravel().astype(np.int64)


def _pack_sorted(values: np.ndarray) -> bytes:
    return _pack(np.diff(values, prepend=0))


def _unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpack(raw))


# ---------------------------------------------------------------- restaurants


def discount(n1: int, n2: int) -> float:
    return min(0.95, max(0.1, n1 / (n1 + 2 * n2) if n1 else 0.1))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, after moving small arguments up."""
    x = np.array(x, float)
    shift = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        shift -= np.where(low, np.log(np.where(low, x, 1.0)), 0.0)
        x = x + low
    return shift + (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


class Seats:
    """Numbers of tables of dishes: ``p(t) ~ S_d(c, t) x^t``."""

    def __init__(self, d: float):
        self.d = d
        self.rows = [np.array([-np.inf]), np.array([0.0])]  # log S_d(c, t) for t from 1, by c

    def row(self, c: int) -> np.ndarray:
        """log S_d(c, t) for t = 1 .. min(c, TABLES)."""
        while len(self.rows) <= c:
            n, last = len(self.rows) - 1, self.rows[-1]
            t = np.arange(1, len(last) + 1)
            stay = last + np.log(n - self.d * t)
            if len(last) < TABLES:
                self.rows.append(np.logaddexp(np.append(stay, -np.inf), np.concatenate([[-np.inf], last])))
            else:
                self.rows.append(np.logaddexp(stay, np.concatenate([[-np.inf], last[:-1]])))
        return self.rows[c]

    def draw(self, c: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        out = np.ones(len(c), np.int64)
        order = np.argsort(c, kind="stable")
        sizes, first = np.unique(c[order], return_index=True)
        for n, at in zip(sizes.tolist(), np.split(order, first[1:])):
            if n == 2:
                out[at] += rng.random(len(at)) * (x[at] + 1 - self.d) < x[at]
            elif 2 < n <= EXACT:
                log_s = self.row(n)
                step = -np.diff(log_s)  # rises: the law is log-concave
                mode = np.searchsorted(step, np.log(x[at])) + 1
                reach = 2 * mode + 60
                far = (reach > len(log_s)) & (len(log_s) < n)
                if far.any():
                    out[at[far]] = self.limit(c[at[far]], x[at[far]], rng)
                at, reach = at[~far], reach[~far]
                if not len(at):
                    continue
                wide = int(min(reach.max(), len(log_s)))
                for lo in range(0, len(at), max(1, CHUNK // wide)):
                    own = at[lo : lo + max(1, CHUNK // wide)]
                    w = log_s[None, :wide] + np.log(x[own])[:, None] * np.arange(1, wide + 1)
                    w = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
                    out[own] = 1 + (w < rng.random((len(own), 1)) * w[:, -1:]).sum(axis=1)
            elif n > EXACT:
                out[at] = self.limit(c[at], x[at], rng)
        return np.minimum(out, c)

    def limit(self, c: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Tables as a compound Poisson sum that is c: the saddle point 1 - q solves
        ``x (1 - q) q^(d - 1) = c``."""
        d = self.d
        lo, hi = np.full(len(c), -700.0), np.zeros(len(c))
        for _ in range(60):
            mid = (lo + hi) / 2
            up = np.log(x) + np.log1p(-np.exp(mid)) + (d - 1) * mid > np.log(c)
            lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
        q = np.exp(lo)
        mean = x * -np.expm1(d * lo) / d
        spread = np.maximum(mean - c / (1 + (1 - d) * (1 - q) / np.maximum(q, 1e-300)), 1e-9)
        normal = np.rint(mean + 0.5 + rng.standard_normal(len(c)) * np.sqrt(spread))
        return np.clip(np.where(mean < 64, 1 + rng.poisson(np.minimum(mean, 64)), normal), 1, c).astype(np.int64)


GRID = np.exp(np.linspace(math.log(0.01), math.log(10_000.0), 48))


def _strength_likelihood(tables: np.ndarray, customers: np.ndarray, d: float) -> np.ndarray:
    """By grid point, of all restaurants; those that are alike are reckoned once."""
    if not len(tables):
        return np.zeros(len(GRID))
    alike, n = np.unique(tables << 32 | customers, return_counts=True)
    t, c = (alike >> 32).astype(float)[:, None], (alike & 0xFFFFFFFF).astype(float)[:, None]
    out = np.zeros(len(GRID))
    for lo in range(0, len(n), CHUNK // 16):
        at = slice(lo, lo + CHUNK // 16)
        out += n[at] @ (log_gamma(GRID / d + t[at]) - log_gamma(GRID / d) + log_gamma(GRID) - log_gamma(GRID + c[at]))
    return out


def _draw_strength(log: np.ndarray, rng: np.random.Generator) -> float:
    p = np.cumsum(np.exp(log - log.max()))
    return float(GRID[int((p < rng.random() * p[-1]).sum())])


@dataclass
class Root:
    """A unigram restaurant: what it serves are the tables of the contexts."""

    size: int  # pieces
    tables: np.ndarray
    strength: float = 1.0

    def sweep(self, customers: np.ndarray, rng: np.random.Generator, times: int = 3) -> np.ndarray:
        """Seats the customers anew; the probability of every piece."""
        d = discount(int((customers == 1).sum()), int((customers == 2).sum()))
        own = np.flatnonzero(customers)
        seats = Seats(d)
        self.tables = np.where(customers > 0, np.clip(self.tables, 1, np.maximum(customers, 1)), 0)
        for _ in range(times if len(own) else 0):
            g = rng.gamma(self.strength / d + self.tables.sum())
            self.tables[own] = seats.draw(customers[own], np.full(len(own), d * g / self.size), rng)
            self.strength = _draw_strength(_strength_likelihood(self.tables.sum(keepdims=True), customers.sum(keepdims=True), d), rng)
        out = (customers - d * self.tables + (self.strength + d * self.tables.sum()) / self.size) / (self.strength + customers.sum())
        out[self.size :] = 0.0
        return out


@dataclass
class Pairs:
    """A bucket's contexts, sorted by hash, and their dishes with their customers.

    ``draws`` holds, for the kept sweeps or else for the last one, how many tables more than one each
    dish with several customers has; a dish with one customer has one table.
    """

    bucket: int
    context: np.ndarray
    dishes: np.ndarray  # how many, by context
    piece: np.ndarray
    count: np.ndarray
    draws: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self):
        self.kind = (self.context & 1).astype(np.int64)
        self.at = np.repeat(np.arange(len(self.context)), self.dishes)
        self.first = np.cumsum(self.dishes) - self.dishes
        self.customers = self._by_context(self.count)
        self.many = np.flatnonzero(self.count > 1)

    def _by_context(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.first) if len(self.first) else values[:0]

    def seated(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The tables of every dish and of every context, by the draw with number k; one a dish before the first."""
        tables = np.ones(len(self.count), np.int64)
        if not self.draws:
            return tables, self.dishes
        tables[self.many] += self.draws[k]
        return tables, self.dishes + np.bincount(self.at[self.many], self.draws[k], minlength=len(self.dishes)).astype(np.int64)

    def sweep(self, s: Sweep, keep: bool) -> None:
        """Draws the tables anew from those of the last draw, which goes unless it is to be kept."""
        context, piece, count = self.at[self.many], self.piece[self.many], self.count[self.many]
        kind, all_tables = self.kind[context], self.seated(-1)[1]
        own, where = np.unique(context, return_inverse=True)
        rng = np.random.default_rng([7, s.number, self.bucket])
        d, strength = np.array(s.d), np.array(s.strength)
        weight = d[self.kind[own]] * rng.gamma((strength / d)[self.kind[own]] + all_tables[own])
        x = np.maximum(weight[where] * s.parent[kind, piece], 1e-300)
        drawn = np.ones(len(count), np.int64)
        for k in (0, 1):
            mine = np.flatnonzero(kind == k)
            for lo in range(0, len(mine), 8 * CHUNK):
                part = mine[lo : lo + 8 * CHUNK]
                drawn[part] = _seats(s.d[k]).draw(count[part], x[part], rng)
        self.draws = [*(self.draws if keep else []), drawn - 1]


@dataclass
class Sweep:
    """What a sweep is drawn against; ``after`` are the parents' probabilities once they are seated anew."""

    number: int
    d: tuple[float, float]
    strength: tuple[float, float]
    parent: np.ndarray  # by kind of context and piece
    after: np.ndarray | None = None


@dataclass
class Model:
    sweeps: list[Sweep]
    burn_in: int
    served: np.ndarray  # by kind of context and piece: whether training has it

    def log_probability(self, pairs: Pairs, context: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """log10 of the averaged probability of each pair asked for, sorted by context and piece."""
        kept = [s for s in self.sweeps if s.number >= self.burn_in]
        known = np.minimum(np.searchsorted(pairs.context, context), max(len(pairs.context) - 1, 0))
        is_known = pairs.context[known] == context if len(pairs.context) else np.zeros(len(context), bool)
        key, asked = pairs.at << 16 | pairs.piece, known << 16 | piece
        where = np.minimum(np.searchsorted(key, asked), max(len(key) - 1, 0))
        met = is_known & (key[where] == asked) if len(key) else is_known
        word = (context & 1) == 0
        total = np.zeros(len(context))
        hit, new_w, new_b = np.flatnonzero(met), np.flatnonzero(~met & word), np.flatnonzero(~met & ~word & is_known)
        for k, s in enumerate(kept):
            tables, all_tables = pairs.seated(k)
            d, strength = np.array(s.d), np.array(s.strength)
            spare = (strength[pairs.kind] + d[pairs.kind] * all_tables) / (strength[pairs.kind] + pairs.customers)
            base = s.after[pairs.kind[pairs.at], pairs.piece]
            p = (pairs.count - d[pairs.kind[pairs.at]] * tables) / (strength[pairs.kind] + pairs.customers)[pairs.at] + spare[pairs.at] * base
            total[hit] += p[where[hit]]
            # a first piece that the context hasn't had, or that no context has had
            unseen = s.after[0][~self.served[0]].sum()
            back = np.where(self.served[0][piece[new_w]], s.after[0][piece[new_w]], unseen)
            total[new_w] += np.where(is_known[new_w], spare[known[new_w]] if len(spare) else 1.0, 1.0) * back
            # a later piece that parts from all known words; after an unknown beginning nothing counts
            part = np.maximum(1 - pairs._by_context(base), 1e-12) * spare
            total[new_b] += part[known[new_b]]
        out = np.zeros(len(context))
        counted = met | word | is_known
        out[counted] = np.log10(total[counted] / len(kept))
        return out


_SEATS: dict[float, Seats] = {}


def _seats(d: float) -> Seats:
    if d not in _SEATS:
        if len(_SEATS) > 3:
            _SEATS.clear()
        _SEATS[d] = Seats(d)
    return _SEATS[d]


SUMS = 2 * PIECES + 512


def _sums(table: DataFrame, what) -> np.ndarray:
    """The sum over all buckets of ``what(pairs)``, ``SUMS`` whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SUMS, np.int64)
        for batch in batches:
            for row in zip(*batch.columns):
                total += what(_pairs_of(*(x.as_py() for x in row)))
        part, n = _parts(total)
        yield pa.RecordBatch.from_arrays([part, n], names=["bucket", "count"])

    return _total(table.mapInArrow(run, "bucket int, count binary"))


def _parts(total: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """A task's sums in rows of 512, those that are not all zero."""
    at = [j for j in range(0, SUMS, 512) if total[j : j + 512].any()]
    return pa.array([j // 512 for j in at], pa.int32()), pa.array([_pack(total[j : j + 512]) for j in at], pa.binary())


def _total(parts: DataFrame) -> np.ndarray:
    """The sum of all tasks' sums; they meet in ``SUMS / 512`` rows."""

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(_unpack(x.as_py()) for x in table.column("count"))
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "count": pa.array([_pack(total)], pa.binary())})

    out = np.zeros(SUMS, np.int64)
    for part, n in parts.select("bucket", "count").groupBy("bucket").applyInArrow(add, "bucket int, count binary").toLocalIterator():
        out[part * 512 : (part + 1) * 512] = _unpack(n)
    return out


def drawn_once(table: DataFrame, what, s: Sweep, keep: bool) -> DataFrame:
    """Rows of two parts.  Part 0: the buckets of ``table`` with a further draw.  Part 1: the sums over
    each task's buckets of ``what(pairs)``, in their columns ``bucket`` and ``count``."""
    shared = table.sparkSession.sparkContext.broadcast(s)
    names = [*SEATED_NAMES, "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SUMS, np.int64)
        for batch in batches:
            for j in range(batch.num_rows):
                row = [x[j].as_py() for x in batch.columns]
                own = _pairs_of(*row)
                own.sweep(shared.value, keep)
                total += what(own)
                cols = [pa.array([x], t) for x, t in zip([*row[:5], [*(row[5] if keep else []), _pack(own.draws[-1])], 0], SEATED_TYPES)]
                yield pa.RecordBatch.from_arrays(cols, names=names)
        part, n = _parts(total)
        none = [pa.nulls(len(n), t) for t in SEATED_TYPES]
        yield pa.RecordBatch.from_arrays([part, *none[1:4], n, none[5], pa.array([1] * len(n), pa.int32())], names=names)

    return table.mapInArrow(run, f"{SEATED}, part int")


def _served(pairs: Pairs, tables: np.ndarray) -> np.ndarray:
    return np.bincount(pairs.kind[pairs.at] * PIECES + pairs.piece, tables, minlength=2 * PIECES).astype(np.int64)


def _signed(values: np.ndarray) -> np.ndarray:
    """Thousandths as two whole numbers, one of them zero."""
    whole = np.rint(values * 1000).astype(np.int64)
    return np.concatenate([np.maximum(whole, 0), np.maximum(-whole, 0)])


def _likelihoods(pairs: Pairs, all_tables: np.ndarray, d: tuple[float, float]) -> np.ndarray:
    out = np.zeros(512, np.int64)
    for k in (0, 1):
        own = pairs.kind == k
        out[k * 128 :][: 2 * len(GRID)] = _signed(_strength_likelihood(all_tables[own], pairs.customers[own], d[k]))
    return out


def fit(scratch: Scratch, table: DataFrame, size: int, burn_in: int = BURN_IN, samples: int = SAMPLES, seed: int = 11) -> tuple[Model, DataFrame]:
    """Gibbs sweeps over the table of a corpus's pairs; the model, and the table with the draws of
    the kept sweeps (``SEATED``).  A sweep's table goes when the next one is written."""

    def counts_of_counts(pairs: Pairs) -> np.ndarray:
        out = np.zeros(512, np.int64)
        kind = pairs.kind[pairs.at]
        out[:4] = [((pairs.count == n) & (kind == k)).sum() for k in (0, 1) for n in (1, 2)]
        return np.concatenate([_served(pairs, np.ones(len(pairs.count))), out])

    def sums(pairs: Pairs) -> np.ndarray:
        tables, all_tables = pairs.seated(-1)
        return np.concatenate([_served(pairs, tables), _likelihoods(pairs, all_tables, d)])

    got = _sums(table, counts_of_counts)
    d = tuple(discount(int(got[2 * PIECES + 2 * k]), int(got[2 * PIECES + 2 * k + 1])) for k in (0, 1))
    served = got[: 2 * PIECES].reshape(2, PIECES)
    model = Model([], burn_in, served > 0)
    rng = np.random.default_rng(seed)
    roots = [Root(size, np.minimum(served[k], 1)) for k in (0, 1)]
    parent = np.stack([r.sweep(c, rng) for r, c in zip(roots, served)])
    strength = (1.0, 1.0)
    for number in range(burn_in + samples):
        model.sweeps.append(Sweep(number, d, strength, parent))
        both = scratch.table(drawn_once(table, sums, model.sweeps[-1], number > burn_in), f"sweep{number}", by="part")
        scratch.drop(f"sweep{number - 1}" if number else "pairs")
        table, got = both.filter("part = 0").drop("part"), _total(both.filter("part = 1"))
        served = got[: 2 * PIECES].reshape(2, PIECES)
        parent = model.sweeps[-1].after = np.stack([r.sweep(c, rng) for r, c in zip(roots, served)])
        n = len(GRID)
        logs = [got[2 * PIECES + 128 * k :][:n] - got[2 * PIECES + 128 * k + n :][:n] for k in (0, 1)]
        strength = tuple(_draw_strength(x / 1000, rng) for x in logs)
    return model, table


# ---------------------------------------------------------------- blocks and buckets

# per context: its hash and its number of pieces; per pair: piece, count in training, rows that have
# it; per pair and row: the row and the count there
ASKED = "block long, bucket int, context binary, dishes binary, piece binary, count binary, rows binary, row binary, n binary"
KNOWN = "bucket int, context binary, dishes binary, piece binary, count binary"
SEATED = f"{KNOWN}, draws array<binary>"
ASKED_NAMES, KNOWN_NAMES, SEATED_NAMES = ([x.split()[0] for x in s.split(", ")] for s in (ASKED, KNOWN, SEATED))
ASKED_TYPES = [pa.int64(), pa.int32(), *[pa.binary()] * 7]
SEATED_TYPES = [pa.int32(), *[pa.binary()] * 4, pa.list_(pa.binary()), pa.int32()]  # with the part


def _pairs_of(bucket: int, context: bytes, dishes: bytes, piece: bytes, count: bytes, draws: list[bytes] | None = None) -> Pairs:
    return Pairs(bucket, _unpack_hashes(context), _unpack(dishes), _unpack(piece), _unpack(count), [_unpack(x) for x in draws or []])


def _pack_hashes(values: np.ndarray) -> bytes:
    """Sorted 64-bit hashes."""
    return _pack(np.diff(values, prepend=np.uint64(0)))


def _unpack_hashes(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpack(raw).view(np.uint64))


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(8)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) * buckets >> 24


def _pair_key(context: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """64 bits that name a pair."""
    x = (context ^ piece.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(31)


def finder(keys: np.ndarray):
    """A function from names to their places among ``keys``, which are sorted and as good as random, or
    -1: where the keys with the same first bits begin is looked up, and these are gone through."""
    bits = max(8, len(keys).bit_length() + 1)
    shift = np.uint64(64 - bits)
    start = np.searchsorted(keys >> shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int64)

    def find(names: np.ndarray) -> np.ndarray:
        out = np.full(len(names), -1, np.int64)
        top = (names >> shift).astype(np.int64)
        at, end = start[top], start[top + 1]
        todo = np.flatnonzero(at < end)
        while len(todo):
            hit = keys[at[todo]] == names[todo]
            out[todo[hit]] = at[todo[hit]]
            todo = todo[~hit]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
        return out

    return find


def _spans(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def asked_rows(first_row: int, keys: np.ndarray, row: np.ndarray, weight: np.ndarray, hashes: np.ndarray, buckets: int, with_rows: bool = True) -> pa.RecordBatch:
    """One row a bucket.  ``keys`` are numbered context and piece, ``row`` who has the pair (sorted),
    ``weight`` how often it counts in training, ``hashes`` those of the numbered contexts."""
    used = np.flatnonzero(np.bincount(keys >> 16, minlength=len(hashes)))
    order = used[np.lexsort((hashes[used], _bucket(hashes[used], buckets)))]
    rank = np.zeros(len(hashes), np.int64)
    rank[order] = np.arange(len(order))
    keys = rank[keys >> 16] << 16 | keys & 0xFFFF
    by = np.argsort(keys, kind="stable")
    keys, row, weight = keys[by], row[by], weight[by]
    new_pair = np.diff(keys, prepend=-1) != 0
    at = np.flatnonzero(new_pair | (np.diff(row, prepend=-1) != 0)) if with_rows else np.flatnonzero(new_pair)
    head = np.flatnonzero(new_pair[at])
    pair = keys[at[head]]
    count = np.add.reduceat(weight, at[head])
    dishes, context = np.bincount(pair >> 16, minlength=len(order)), hashes[order]
    n, row, rows = np.diff(at, append=len(keys)), row[at], np.diff(head, append=len(at))
    # where each bucket's contexts, pairs and entries begin
    cut_c = np.flatnonzero(np.diff(_bucket(context, buckets), prepend=-1, append=-1))
    cut_p = _spans(dishes)[cut_c]
    cut_e = np.append(head, len(at))[cut_p]
    out = []
    for j in range(len(cut_c) - 1):
        c, p, e = (slice(x[j], x[j + 1]) for x in (cut_c, cut_p, cut_e))
        own = (rows[p], row[e], n[e]) if with_rows else (rows[:0],) * 3
        out.append((first_row, int(_bucket(context[c][:1], buckets)[0]), _pack_hashes(context[c]), *map(_pack, (dishes[c], pair[p] & 0xFFFF, count[p], *own))))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), ASKED_TYPES)], names=ASKED_NAMES)


def _wide(batch: pa.RecordBatch | dict, names: list[str], types: list, part: int) -> pa.RecordBatch:
    """A batch with nulls for the columns that the other part has."""
    cols = batch if isinstance(batch, dict) else dict(zip(batch.schema.names, batch.columns))
    rows = len(next(iter(cols.values())))
    cols = {**cols, "part": pa.array(np.full(rows, part, np.int32))}
    return pa.RecordBatch.from_arrays([cols[n] if n in cols else pa.nulls(rows, t) for n, t in zip(names, types)], names=names)


def word_pairs(vocabulary: DataFrame, buckets: int, path: str) -> DataFrame:
    """Rows of two parts.  Part 0: ``(row_key, h, c)``, the words.  Part 1: for blocks of words, the
    pairs of beginning and next piece, for the buckets; a word is a row."""
    names = ["part", "row_key", "h", "c", *ASKED_NAMES]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *ASKED_TYPES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        speller, at = speller_of(path), TaskContext.get().partitionId() << 40
        number: dict[int, int] = {}
        keys, row, weight, first, rows = array("q"), array("q"), array("q"), at, 0

        def flush() -> pa.RecordBatch:
            hashes = np.fromiter(number, np.uint64, len(number))
            got = asked_rows(first, *(np.array(x, np.int64) for x in (keys, row, weight)), hashes, buckets)
            number.clear()
            for x in (keys, row, weight):
                del x[:]
            return _wide(got, names, types, 1)

        for batch in batches:
            for lo in range(0, batch.num_rows, 5000):
                part = batch.slice(lo, 5000)
                for word, c in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    own, begin = speller.pieces(word), 0
                    for a, b in zip(own, own[1:]):
                        begin = _prefix(begin, a)
                        keys.append(number.setdefault(begin, len(number)) << 16 | b)
                        row.append(rows)
                        weight.append(c)
                    rows += 1
                yield _wide({"row_key": pa.array(np.arange(at, at + part.num_rows)), "h": part.column(0), "c": part.column(2)}, names, types, 0)
                at += part.num_rows
                if len(keys) >= BLOCK_UNITS or rows > BLOCK_ROWS - 5000:
                    if len(keys):
                        yield flush()
                    first, rows = at, 0
        if len(keys):
            yield flush()

    return vocabulary.select("h", "word", "c").mapInArrow(run, f"part int, row_key long, h long, c long, {ASKED}")


def first_pairs(texts: DataFrame, buckets: int, path: str) -> DataFrame:
    """How often each first piece follows each word in ``texts``, by block and bucket (``KNOWN``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, keys, units = Words(np.empty(0, np.int64), speller_of(path)), [], 0

        def flush() -> pa.RecordBatch:
            pair, n = np.unique(np.concatenate(keys), return_counts=True)
            got = asked_rows(0, pair, np.zeros(len(pair), np.int64), n, words_of.hashes(), buckets, with_rows=False)
            keys.clear()
            return got.select(KNOWN_NAMES)

        for batch in batches:
            for part in slices(batch, 0):
                words, tokens, _ = tokenized(part.column(0))
                keys.append(words_of.read(words, tokens)[1])
                units += len(tokens)
                if units >= 2 * BLOCK_UNITS:
                    yield flush()
                    units = 0
                    if len(words_of) > CACHE:
                        words_of.fresh()
        if units:
            yield flush()

    return texts.select("_bytes").mapInArrow(run, KNOWN)


def merged(counted: DataFrame) -> DataFrame:
    """A bucket's pairs that stand in training, with their counts; rows as ``Pairs`` takes them."""

    def added(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        c, p, n = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((p, c))
        c, p, n = c[order], p[order], n[order]
        first = np.flatnonzero(np.append(True, (c[1:] != c[:-1]) | (p[1:] != p[:-1]))[: len(c)])
        return c[first], p[first], np.add.reduceat(n, first) if len(first) else n

    def run(key: tuple, table: pa.Table) -> pa.Table:
        parts = [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))]
        held = 0
        for context, dishes, piece, count in zip(*(table.column(x) for x in KNOWN_NAMES[1:])):
            c, n = np.repeat(_unpack_hashes(context.as_py()), _unpack(dishes.as_py())), _unpack(count.as_py())
            parts.append((c[n > 0], _unpack(piece.as_py())[n > 0], n[n > 0]))
            held += len(parts[-1][0])
            if held > len(parts[0][0]) + 4 * CHUNK:
                parts, held = [added(parts)], 0
        c, p, n = added(parts)
        first = np.flatnonzero(np.append(True, c[1:] != c[:-1])[: len(c)])
        got = (_pack_hashes(c[first]), _pack(np.diff(first, append=len(c))), _pack(p), _pack(n))
        return pa.table([pa.array([key[0].as_py()], pa.int32()), *(pa.array([x], pa.binary()) for x in got)], names=KNOWN_NAMES)

    return counted.select(*KNOWN_NAMES).groupBy("bucket").applyInArrow(run, KNOWN)


def head_pairs(pairs: DataFrame, model: Model, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Names, sorted, and log probabilities of the most frequent pairs of word and first piece."""

    def by_size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(64, np.int64)
        for batch in batches:
            for row in zip(*(x.to_pylist() for x in batch.columns)):
                own = _pairs_of(*row)
                total += np.bincount(np.frexp(own.count[own.kind[own.at] == 0].astype(float))[1], minlength=64)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(total[k])], names=["k", "n"])

    sizes = {r["k"]: r["n"] for r in pairs.mapInArrow(by_size, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}
    least = frequent(sizes, most)
    if least is None:
        return np.empty(0, np.uint64), np.empty(0)
    shared = pairs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(x.to_pylist() for x in batch.columns)):
                own = _pairs_of(*row)
                at = np.flatnonzero((own.count >= least) & (own.kind[own.at] == 0))
                context, piece = own.context[own.at[at]], own.piece[at]
                log = shared.value.log_probability(own, context, piece)
                yield pa.RecordBatch.from_arrays([pa.array([_pair_key(context, piece).tobytes()], pa.binary()), pa.array([log.astype(np.float32).tobytes()], pa.binary())], names=["k", "p"])

    rows = pairs.mapInArrow(run, "k binary, p binary").collect()  # ``most`` numbers at most
    key = np.concatenate([np.frombuffer(r["k"], np.uint64) for r in rows])
    log = np.concatenate([np.frombuffer(r["p"], np.float32) for r in rows])
    order = np.argsort(key)
    return key[order], log[order]


def _tails(who: np.ndarray, hashes: np.ndarray, rows: int) -> tuple[pa.ListArray, pa.ListArray]:
    """For every row the distinct hashes that it has, and how often it has each."""
    order = np.lexsort((hashes, who))
    who, hashes = who[order], hashes[order]
    first = np.flatnonzero(np.append(True, (np.diff(who) != 0) | (hashes[1:] != hashes[:-1]))[: len(who)])
    cut = pa.array(np.searchsorted(who[first], np.arange(rows + 1)).astype(np.int32))
    return tuple(pa.ListArray.from_arrays(cut, pa.array(x)) for x in (hashes[first], np.diff(first, append=len(who))))


HEADS = "row_key long, {id} {kind}, n_tokens long, known long, base double, score double, tail_h array<long>, tail_n array<long>"


def document_heads(docs: DataFrame, lexicon: tuple, pairs: tuple, buckets: int, id_col: str, text_col: str, path: str) -> DataFrame:
    """Rows of two parts.  Part 0, one a document: what its head words give to the base score
    (``base`` is the sum of log10(c + 1)), what head words and head pairs give to the score, and the
    other words as (hash, count) lists; ``row_key`` numbers the rows of a partition.  Part 1: for
    blocks of documents, the other pairs, for the buckets."""
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, pairs))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"part int, {HEADS.format(id=f'`{id_col}`', kind=kind)}, {ASKED}"
    names = [x.split()[0].strip("`") for x in schema.split(", ")]
    id_type = to_arrow_type(docs.schema[id_col].dataType)
    types = [pa.int32(), pa.int64(), id_type, pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()), *ASKED_TYPES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        (head_hash, head_count, head_rest), (pair_key, pair_log) = shared.value
        words_of, find = Words(head_hash, speller_of(path)), finder(pair_key)
        log_base = np.append(np.log10(head_count + 1.0), 0.0)  # the last row: words elsewhere
        rest = np.append(head_rest, 0.0)
        at = TaskContext.get().partitionId() << 40
        first, keys, row, rows, units = at, [], [], 0, 0

        def flush() -> pa.RecordBatch:
            pair, who = np.concatenate(keys), np.concatenate(row)
            got = asked_rows(first, pair, who, np.zeros(len(pair), np.int64), words_of.hashes(), buckets)
            keys.clear()
            row.clear()
            return _wide(got, names, types, 1)

        for batch in batches:
            for part in slices(batch, 1):
                words, tokens, n = tokenized(part.column(1))
                firsts = np.cumsum(n) - n
                own, pair = words_of.read(words, tokens)
                code = words_of.codes(own)
                known = code >= 0
                who = np.repeat(np.arange(len(n)), n)
                spot = np.where(known, code, len(head_count))
                # head pairs are looked up here, others by their bucket
                score = rest[spot]
                far = np.ones(len(pair), bool)
                if len(pair_key):
                    name = _pair_key(words_of.hashes()[pair >> 16], pair & 0xFFFF)
                    where = find(name)
                    far = where < 0
                    score = score + np.where(far, 0.0, pair_log[where])
                tail = np.flatnonzero(~known)
                rare = np.flatnonzero(np.bincount(tokens[tail], minlength=len(words)))
                hash_of = np.zeros(len(words), np.int64)
                hash_of[rare] = word_hashes([words[j] for j in rare.tolist()]).view(np.int64)
                tails = _tails(who[tail], hash_of[tokens[tail]], len(n))
                yield _wide(
                    {
                        "row_key": pa.array(np.arange(at, at + len(n))), id_col: part.column(0), "n_tokens": pa.array(n.astype(np.int64)),
                        "known": pa.array(np.add.reduceat((known & (spot < len(head_count))).astype(np.int64), firsts)),
                        "base": pa.array(np.add.reduceat(log_base[spot], firsts)), "score": pa.array(np.add.reduceat(score, firsts)),
                        "tail_h": tails[0], "tail_n": tails[1],
                    },
                    names, types, 0,
                )
                keys.append(pair[far])
                row.append(who[far] + rows)
                units += int(far.sum())
                at += len(n)
                rows += len(n)
                if units >= BLOCK_UNITS or rows > BLOCK_ROWS - SLICE_ROWS:
                    if units:
                        yield flush()
                    first, rows, units = at, 0, 0
                    keys.clear()
                    row.clear()
                    if len(words_of) > CACHE:
                        words_of.fresh()
        if units:
            yield flush()

    return with_bytes(docs, text_col).select(id_col, "_bytes").mapInArrow(run, schema)


def row_scores(asked: DataFrame, pairs: DataFrame, model: Model) -> DataFrame:
    """``(row_key, s)``: the sum of log probabilities of the pairs that each row asks for."""
    shared = pairs.sparkSession.sparkContext.broadcast(model)

    def answer(key: tuple, asked: pa.Table, known: pa.Table) -> pa.Table:
        if known.num_rows:
            own = _pairs_of(*(known.column(x)[0].as_py() for x in SEATED_NAMES))
        else:
            own = Pairs(key[0].as_py(), np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
        # all blocks' pairs at once, each once
        rows = [(_unpack_hashes(c.as_py()), _unpack(d.as_py()), _unpack(p.as_py())) for c, d, p in zip(*(asked.column(x) for x in ("context", "dishes", "piece")))]
        if not rows:
            return pa.table({"block": pa.array([], pa.int64()), "row": pa.array([], pa.binary()), "s": pa.array([], pa.binary())})
        sizes = _spans(np.array([len(p) for *_, p in rows]))
        context, piece = np.concatenate([np.repeat(c, d) for c, d, _ in rows]), np.concatenate([p for *_, p in rows])
        order = np.lexsort((piece, context))
        first = np.flatnonzero(np.append(True, (np.diff(context[order]) != 0) | (np.diff(piece[order]) != 0)))
        value = np.empty(len(context))
        value[order] = np.repeat(shared.value.log_probability(own, context[order[first]], piece[order[first]]), np.diff(first, append=len(order)))
        out = []
        for j, (block, per, row, n) in enumerate(zip(*(asked.column(x) for x in ("block", "rows", "row", "n")))):
            where = _unpack(row.as_py())
            sums = np.bincount(where, np.repeat(value[sizes[j] : sizes[j + 1]], _unpack(per.as_py())) * _unpack(n.as_py()))
            present = np.unique(where)
            out.append((block.as_py(), _pack_sorted(present), sums[present].astype(np.float32).tobytes()))
        cols = list(zip(*out))
        return pa.table({"block": pa.array(cols[0], pa.int64()), "row": pa.array(cols[1], pa.binary()), "s": pa.array(cols[2], pa.binary())})

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total, seen = np.zeros(BLOCK_ROWS), np.zeros(BLOCK_ROWS, bool)
        # in the order of their content, so that a repeated task adds in the same order
        for row, s in sorted(zip(table.column("row").to_pylist(), table.column("s").to_pylist())):
            at = _unpack_sorted(row)
            total[at] += np.frombuffer(s, np.float32)
            seen[at] = True
        own = np.flatnonzero(seen)
        return pa.table({"row_key": pa.array(own + key[0].as_py()), "s": pa.array(total[own])})

    answers = asked.groupBy("bucket").cogroup(pairs.groupBy("bucket")).applyInArrow(answer, "block long, row binary, s binary")
    return answers.groupBy("block").applyInArrow(add, "row_key long, s double")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, held_out: int = HELD_OUT, tokenizer: str | None = None, most: int = HEAD_WORDS, most_pairs: int = HEAD_PAIRS, burn_in: int = BURN_IN, samples: int = SAMPLES) -> DataFrame:
    """``(id, n_tokens, n_known, train_tokens, base_score, score)`` of every whole text."""
    scratch = Scratch(docs.sparkSession, "lm", BATCH)
    path = tokenizer or tokenizer_path()
    marked = docs.select(F.col(id_col), F.col(text_col), F.coalesce(fold(F.col(id_col), folds) != held_out, F.lit(True)).alias("_train"))
    vocabulary = scratch.table(word_counts(with_bytes(marked, text_col), "_train"), "vocabulary")
    v, n = vocabulary.agg(F.count_if(F.col("c") > 0), F.coalesce(F.sum("c"), F.lit(0))).first()
    buckets = max(16, n * 2 // BUCKET_UNITS)

    words = scratch.table(word_pairs(vocabulary, buckets, path), "words", by="part")
    beginnings = words.filter("part = 1")
    counted = first_pairs(with_bytes(marked.filter("_train"), text_col), buckets, path)
    pairs = scratch.table(merged(counted.unionByName(beginnings.select(*KNOWN_NAMES))), "pairs")
    model, pairs = fit(scratch, pairs, speller_of(path).end + 1, burn_in, samples)

    rest = row_scores(beginnings.select(*ASKED_NAMES), pairs, model)
    lexicon = words.filter("part = 0").select("row_key", "h", "c").join(rest, "row_key", "left").select("h", "c", F.coalesce("s", F.lit(0.0)).alias("rest"))
    lexicon = scratch.table(lexicon, "lexicon")
    least = frequent({r["k"]: r["n"] for r in lexicon.filter("c > 0").groupBy(F.length(F.bin("c")).alias("k")).agg(F.count("*").alias("n")).collect()}, most)
    head = lexicon.filter(F.col("c") >= least).toPandas() if least else lexicon.limit(0).toPandas()
    lexicon_head = head["h"].to_numpy(np.int64), head["c"].to_numpy(np.int64), head["rest"].to_numpy(float)
    both = scratch.table(document_heads(marked, lexicon_head, head_pairs(pairs, model, most_pairs), buckets, id_col, text_col, path), "heads", by="part")
    scratch.drop("vocabulary", "words")
    heads = both.filter("part = 0").select("row_key", id_col, "n_tokens", "known", "base", "score", "tail_h", "tail_n")
    far = row_scores(both.filter("part = 1").select(*ASKED_NAMES), pairs, model)

    tail = heads.filter("size(tail_h) > 0").select("row_key", F.explode(F.arrays_zip("tail_h", "tail_n")).alias("t")).select("row_key", F.col("t.tail_h").alias("h"), F.col("t.tail_n").alias("n"))
    sums = tail.join(lexicon, "h").groupBy("row_key").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("t_known"),
        F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("t_base"),
        F.sum(F.col("n") * F.col("rest")).alias("t_rest"),
    )
    zero = F.lit(0.0)
    out = heads.drop("tail_h", "tail_n").join(sums, "row_key", "left").join(far, "row_key", "left").select(
        id_col, "n_tokens", (F.col("known") + F.coalesce("t_known", F.lit(0))).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("t_base", zero) - F.col("n_tokens") * math.log10(n + v + 1)).alias("base_score"),
        (F.col("score") + F.coalesce("t_rest", zero) + F.coalesce("s", zero)).alias("score"),
    )
    return scratch.close(out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = score(read(spark, sf_dir, "documents"))
    out = got.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
    return out
