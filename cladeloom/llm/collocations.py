"""Phrase collocations by pivot partitioning: every phrase is counted where its rarest word is.

Texts are cut into pieces at punctuation and line breaks, and pieces into words.  One pass counts
words by language; words too rare to stand in any candidate break a piece.  A second pass takes every
word occurrence as a pivot: its fragment reaches up to ``most_words - 1`` words to each side, as far
as the words are more frequent than the pivot (to the right: or the pivot itself again, so that the
leftmost of equal pivots owns a phrase).  So each phrase occurrence lies in one fragment, that of its
rarest word.  Equal fragments are merged in the task and routed to the pivot's bucket.  A bucket
counts the phrases around its pivots and keeps the frequent ones; it emits no phrase of other pivots.

Frequency order: the ``listed`` most frequent words, a bounded number, go to all tasks and are ordered
by count.  Where more words than these are frequent enough, the others count as rarer than all listed
ones and are ordered among themselves by their bytes; the result is the same, fragments only are less
evenly long.  Buckets hold about ``bucket_words`` words, however large the corpus.  A pivot that would
fill more than a quarter of one is dealt over several by its fragments, and its counts are added up.

Scores: a phrase's cut into two parts has ``1000 * a * n / (l * r)`` with the counts of the phrase, of
all words and of the parts, in exact decimals; its lowest cut counts.  A phrase that a longer candidate
holds ``closed_percent`` of the time is dropped.  As a phrase inside a longer one is inside one that is
one word longer, and at least as often, comparing with those is enough.

Defined cases: null and empty texts have no words; a null language is ``und``; repeated rows count
each; equal scores go by count, then by the phrase's bytes; an empty table gives no rows; texts of any
length are read in blocks; other columns are ignored; no id is needed.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, read, spread, with_bytes

MIN_COUNT = 100
MOST_WORDS = 5
TOP = 2000
CLOSED_PERCENT = 100
UNKNOWN = "und"
LISTED = 1 << 18
BUCKET_WORDS = 1 << 21
CHUNK = 1 << 19
HELD_WORDS = 300_000
BLOCK = 1 << 20

_MARK = b"."  # stands for any separator of pieces; no word holds it
_CUTS = bytes.maketrans(b",;:!?\n\x0b\x0c\r\t", b"......... ")


def word_blocks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, with a mark between pieces, in blocks of about ``BLOCK`` bytes."""
    text = text.lower().translate(_CUTS).replace(_MARK, b" . ")
    at = 0
    while at < len(text):
        to = len(text) if len(text) - at <= BLOCK else text.find(b" ", at + BLOCK)
        to = len(text) if to < 0 else to
        yield text[at:to].split()
        at = to


def count_words(docs: DataFrame) -> DataFrame:
    """``(lang, word, n)`` of ``(lang, _bytes)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, c in held.items():
                c.pop(_MARK, None)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = held.setdefault(lang, Counter())
                for words in word_blocks(text.as_py()):
                    own.update(words)
                    if len(own) > HELD_WORDS:
                        yield from out()
                        own = held.setdefault(lang, Counter())
            if sum(map(len, held.values())) > HELD_WORDS:
                yield from out()
        yield from out()

    return docs.select("lang", "_bytes").mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class WordList:
    """The listed words: ids from 1 on, most frequent first; ``complete`` if no other word is frequent enough."""

    def __init__(self, rows: list, complete: bool, bucket_words: int, total: int):
        self.complete = complete
        self.lang = [r["lang"] for r in rows]
        self.word = [bytes(r["word"]) for r in rows]
        self.count = np.array([0] + [r["n"] for r in rows], np.int64)
        self.buckets = max(1, -(-total // bucket_words))
        #: over how many buckets a pivot is dealt; 1 for words that are not listed
        self.ways = np.clip(-(-self.count * 4 // bucket_words), 1, self.buckets)
        self._ids: dict[str, dict[bytes, int]] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_ids": None}

    def ids(self, lang: str) -> dict[bytes, int]:
        if self._ids is None:
            self._ids = {}
            for k, (own, word) in enumerate(zip(self.lang, self.word), 1):
                self._ids.setdefault(own, {_MARK: 0})[word] = k
        return self._ids.get(lang) or {_MARK: 0}

    def first_bucket(self, pivot: np.ndarray, lang: str, names: list[bytes]) -> np.ndarray:
        """A mix of the id, or of the word where it is not listed."""
        seed = zlib.crc32(lang.encode())
        own = np.array([zlib.crc32(x, seed) for x in names], np.int64)
        out = pivot.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
        rest = pivot >= len(self.count)
        out[rest] = own[pivot[rest] - len(self.count)]
        return (out % np.uint64(self.buckets)).astype(np.int64)


def fragments(ids: np.ndarray, reach: int) -> np.ndarray:
    """One row a word that has a neighbour: the pivot in column ``reach``, zeros outside the fragment.

    ``ids`` has ``reach`` words of context at both ends; 0 breaks a piece and larger ids are rarer.
    """
    n = len(ids) - 2 * reach
    pivot = ids[reach : reach + n]
    out = np.zeros((n, 2 * reach + 1), np.int32)
    out[:, reach] = pivot
    for side in (-1, 1):
        on = pivot > 0
        for d in range(1, reach + 1):
            at = reach + side * d
            near = ids[at : at + n]
            on = on & (near > 0) & ((near < pivot) if side < 0 else (near <= pivot))
            out[on, at] = near[on]
    return out[(out[:, reach - 1] > 0) | (out[:, reach + 1] > 0)]


def _mix(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        out = (out ^ rows[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _pack(a: np.ndarray) -> bytes:
    return pa.compress(a.tobytes(), codec="zstd", asbytes=True)


def _unpack(raw: bytes, size: int, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, size * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


_ROUTED = "bucket long, lang string, size long, rows binary, times binary, names array<binary>"


def route(docs: DataFrame, words, most_words: int) -> DataFrame:
    """Merged fragments by bucket: one row a bucket and ``CHUNK`` words of a task.

    ``rows`` are the columns of the fragments, one after another; ids beyond the list point into ``names``.
    """
    reach = most_words - 1

    def deal(lang: str, ids: np.ndarray, names: list[bytes], lst: WordList) -> Iterator[tuple]:
        rows = fragments(ids, reach)
        if not len(rows):
            return
        pivot, mixed = rows[:, reach], _mix(rows)
        ways = np.ones(len(rows), np.int64)
        known = pivot < len(lst.count)
        ways[known] = lst.ways[pivot[known]]
        bucket = (lst.first_bucket(pivot, lang, names) + (mixed >> np.uint64(40)).astype(np.int64) % ways) % lst.buckets
        order = np.lexsort((mixed, bucket))
        rows, bucket, mixed = rows[order], bucket[order], mixed[order]
        new = np.ones(len(rows), bool)
        new[1:] = (mixed[1:] != mixed[:-1]) | (rows[1:] != rows[:-1]).any(axis=1)
        at = np.flatnonzero(new)
        rows, bucket, times = rows[at], bucket[at], np.diff(np.append(at, len(new)))
        edge = np.flatnonzero(np.diff(bucket, prepend=-1))
        for lo, hi in zip(edge.tolist(), np.append(edge[1:], len(bucket)).tolist()):
            part = rows[lo:hi]
            own, used = part >= len(lst.count), []
            if own.any():
                use, where = np.unique(part[own], return_inverse=True)
                part[own] = where + len(lst.count)
                used = [names[k - len(lst.count)] for k in use.tolist()]
            yield int(bucket[lo]), lang, hi - lo, _pack(np.ascontiguousarray(part.T)), _pack(times[lo:hi].astype(np.int32)), used

    def flush(lang: str, held: list[np.ndarray], rare: list[list[bytes]], lst: WordList) -> Iterator[pa.RecordBatch]:
        ids = np.concatenate([np.zeros(reach, np.int32), *held, np.zeros(reach, np.int32)])
        names = sorted({w for r in rare for w in r})
        if names:
            at = {w: k for k, w in enumerate(names, len(lst.count))}
            ids[ids < 0] = [at[w] for r in rare for w in r]
        for lo in range(0, len(ids) - 2 * reach, CHUNK):
            got = list(deal(lang, ids[lo : lo + CHUNK + 2 * reach], names, lst))
            if got:
                types = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), types)], names=["bucket", "lang", "size", "rows", "times", "names"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lst, missing = words.value, 0 if words.value.complete else -1
        held: dict[str, tuple[list, list]] = {}
        n = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                get = lst.ids(lang).get
                ids, rare = held.setdefault(lang, ([], []))
                for block in word_blocks(text.as_py()):
                    got = np.array([get(w, missing) for w in block], np.int32)
                    ids.append(got)
                    n += len(got)
                    if missing:
                        rare.append([block[k] for k in np.flatnonzero(got < 0).tolist()])
                ids.append(np.zeros(1, np.int32))
                if n >= CHUNK:
                    for own, (i, r) in held.items():
                        yield from flush(own, i, r, lst)
                    held, n = {}, 0
        for own, (i, r) in held.items():
            yield from flush(own, i, r, lst)

    return docs.select("lang", "_bytes").mapInArrow(run, _ROUTED)


def _sums(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's key among the distinct ones, and those keys' total times."""
    _, where = np.unique(keys, return_inverse=True)
    return where, np.bincount(where, weights=times).astype(np.int64)  # below 2**53


def mine(rows: np.ndarray, times: np.ndarray, whole: np.ndarray, min_count: int, most_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Phrases that hold the pivot, as rows of ids with zeros at the end, and their counts.

    Where ``whole`` says that all fragments of the pivot are here, rare phrases go; those of other pivots
    keep their part of the count.
    """
    reach = most_words - 1
    rows = rows.copy()
    for near, gone in ((reach - 1, slice(0, reach)), (reach + 1, slice(reach + 1, None))):
        where, total = _sums(rows[:, reach].astype(np.int64) << 32 | rows[:, near], times)
        rows[whole & (total[where] < min_count), gone] = 0  # a longer phrase on this side is rarer still
    parts, weights, sure = [], [], []
    for m in range(2, most_words + 1):
        for lo in range(max(0, reach - m + 1), reach + 1):
            on = np.flatnonzero((rows[:, lo] > 0) & (rows[:, lo + m - 1] > 0))
            got = np.zeros((len(on), most_words), np.int32)
            got[:, :m] = rows[on, lo : lo + m]
            parts.append(got)
            weights.append(times[on])
            sure.append(whole[on])
    phrase, weight, certain = np.concatenate(parts), np.concatenate(weights), np.concatenate(sure)
    if not len(phrase):
        return phrase, weight
    code = phrase[:, 0].astype(np.int64)
    for k in range(1, most_words):
        code, total = _sums(code << 32 | phrase[:, k], weight)
    first = np.zeros(len(total), np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    keep = (total >= min_count) | ~certain[first]
    return phrase[first[keep]], total[keep]


_MINED = "lang string, phrase binary, a long, first_n long, last_n long"


def phrase_counts(routed: DataFrame, words, min_count: int, most_words: int) -> DataFrame:
    """``(lang, phrase, a, first_n, last_n)`` of the frequent phrases; the counts of the first and the last
    word are null where they are not listed."""
    reach = most_words - 1

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lst = words.value
        by_lang: dict[str, list] = {}
        names: dict[str, dict[bytes, int]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                lang, size = row["lang"], row["size"]
                got = _unpack(row["rows"], size * (2 * reach + 1), np.int32).reshape(2 * reach + 1, size).T
                if row["names"]:
                    own = names.setdefault(lang, {})
                    at = np.array([own.setdefault(w, len(own) + len(lst.count)) for w in row["names"]], np.int32)
                    got = np.where(got >= len(lst.count), at[np.maximum(got - len(lst.count), 0)], got)
                by_lang.setdefault(lang, []).append((got, _unpack(row["times"], size, np.int32)))
        for lang, got in by_lang.items():
            rows, times = (np.concatenate(x) for x in zip(*got))
            pivot = rows[:, reach]
            whole = np.ones(len(rows), bool)
            known = pivot < len(lst.count)
            whole[known] = lst.ways[pivot[known]] == 1
            phrase, count = mine(rows, times, whole, min_count, most_words)
            text = [b"", *lst.word, *names.get(lang, {})]
            single = np.append(lst.count, np.full(len(names.get(lang, {})), -1))
            last = phrase[np.arange(len(phrase)), (phrase > 0).sum(axis=1) - 1] if len(phrase) else np.zeros(0, np.int64)
            ends = [pa.array(n, pa.int64(), mask=n < 0) for n in (single[phrase[:, 0]], single[last])]
            said = [b" ".join([text[k] for k in r if k]) for r in phrase.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(said), pa.string()), pa.array(said, pa.binary()), pa.array(count, pa.int64()), *ends], names=["lang", "phrase", "a", "first_n", "last_n"])

    mined = routed.groupBy("bucket").applyInArrow(run, _MINED)
    mined = mined.groupBy("lang", F.col("phrase").cast("string").alias("phrase"))
    return mined.agg(F.sum("a").alias("a"), F.max("first_n").alias("first_n"), F.max("last_n").alias("last_n")).filter(F.col("a") >= min_count)


def scored(phrases: DataFrame, single: DataFrame | None, totals: DataFrame, most_words: int = MOST_WORDS, closed_percent: int = CLOSED_PERCENT) -> DataFrame:
    """``(lang, phrase, a, l, r, n, score)`` of the candidates that no longer one replaces.

    ``single`` has ``(lang, phrase, a)`` of words whose count the phrases do not bring along.  Each
    phrase asks for the counts of its parts, and tells the parts one word shorter of itself.
    """
    w, m = F.split("phrase", " "), F.size(F.split("phrase", " "))
    asks = []
    for k in range(1, most_words):
        for side, part, words in (("l", F.slice(w, 1, k), F.lit(k)), ("r", F.slice(w, k + 1, F.greatest(m - k, F.lit(1))), m - k)):
            known = F.col("first_n" if side == "l" else "last_n").isNotNull() & (words == 1)
            asks.append(F.when((m > k) & ~known, F.struct(F.lit(f"{side}{k}").alias("cut"), F.concat_ws(" ", part).alias("part"), words.alias("words"))))
    ask = phrases.select("lang", "phrase", "a", m.alias("m"), F.explode(F.filter(F.array(*asks), lambda x: x.isNotNull())).alias("x"))
    ask = ask.select("lang", "phrase", "a", "m", "x.*")
    counts = phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("found"))
    if single is not None:
        counts = counts.unionByName(single.select("lang", F.col("phrase").alias("part"), F.col("a").alias("found")))
    told = ask.join(counts, ["lang", "part"]).select("lang", "phrase", "cut", "found")
    longer = ask.filter(F.col("words") == F.col("m") - 1).select("lang", F.col("part").alias("phrase"), F.col("a").alias("longer"))
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [phrases, told, longer])
    cut = lambda s: F.max(F.when(F.col("cut") == s, F.col("found"))).alias(s)
    rows = rows.groupBy("lang", "phrase").agg(
        *(F.max(c).alias(c) for c in ("a", "first_n", "last_n", "longer")), *(cut(f"{s}{k}") for s in "lr" for k in range(1, most_words))
    )
    rows = rows.filter(F.col("a").isNotNull() & (F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * closed_percent)))
    rows = rows.join(totals, "lang")

    def at(k: int):
        left, right = (F.coalesce(F.col("first_n"), F.col("l1")) if k == 1 else F.col(f"l{k}")), F.when(m == k + 1, F.coalesce("last_n", f"r{k}")).otherwise(F.col(f"r{k}"))
        wide = lambda c: c.cast("decimal(38,0)")
        score = F.call_function("div", wide(F.lit(1000)) * wide(F.col("a")) * wide(F.col("n")), wide(left) * wide(right))
        return F.when(m > k, F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))

    best = F.array_min(F.array(*(at(k) for k in range(1, most_words))))
    return rows.select("lang", "phrase", "a", "n", best.alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, most_words: int = MOST_WORDS, top: int = TOP, closed_percent: int = CLOSED_PERCENT, listed: int = LISTED, bucket_words: int = BUCKET_WORDS
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``, the first ``top`` of each language; see the module's docstring."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "collocations")
    docs = spread(with_bytes(docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"))).drop("text"))
    # words too rare count together, under no word
    counts = count_words(docs).groupBy("lang", F.when(F.col("n") >= min_count, F.col("word")).alias("word")).agg(F.sum("n").alias("n"))
    counts = scratch.table(counts, "words")
    frequent = counts.filter(F.col("word").isNotNull())
    n_frequent, total = counts.agg(F.count("word"), F.coalesce(F.sum("n"), F.lit(0))).first()
    order = [F.desc("n"), F.asc("lang"), F.asc("word")]
    head = frequent.orderBy(*order).limit(listed).collect()  # at most ``listed`` rows
    words = spark.sparkContext.broadcast(WordList(head, n_frequent <= listed, bucket_words, total))
    phrases = scratch.table(phrase_counts(route(docs, words, most_words), words, min_count, most_words), "phrases")
    single = None if n_frequent <= listed else frequent.select("lang", F.col("word").cast("string").alias("phrase"), F.col("n").alias("a"))
    out = scored(phrases, single, counts.groupBy("lang").agg(F.sum("n").alias("n")), most_words, closed_percent)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
    out = out.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top)
    return scratch.close(out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


SQL = r"""
WITH pieces AS (
  SELECT lang, list_filter(string_split(replace(p, chr(9), ' '), ' '), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[.,;:!?\x0A-\x0D]')) AS p
        FROM documents)
), starts AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces
), grams AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS a
  FROM starts, (SELECT unnest([1, 2, 3, 4, 5]) AS m)
  WHERE i + m - 1 <= len(w)
  GROUP BY ALL
), totals AS (
  SELECT lang, sum(a)::BIGINT AS n FROM grams WHERE m = 1 GROUP BY lang
), often AS (
  SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM grams WHERE a >= 100
), subs AS (
  SELECT DISTINCT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, a AS longer
  FROM (SELECT lang, w, a, m, k, unnest(range(1, m - k + 2)) AS i
        FROM often, (SELECT unnest([2, 3, 4]) AS k) WHERE k < m)
), dropped AS (
  SELECT DISTINCT o.lang, o.phrase FROM often o JOIN subs s ON s.lang = o.lang AND s.phrase = o.phrase AND 100 * s.longer >= 100 * o.a
), cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS p, array_to_string(w[k + 1:m], ' ') AS q
  FROM (SELECT *, unnest(range(1, m)) AS k FROM often WHERE m > 1)
), valued AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r, t.n,
         (1000::HUGEINT * c.a * t.n) // (x.a::HUGEINT * y.a) AS score
  FROM cuts c JOIN often x ON x.lang = c.lang AND x.phrase = c.p
  JOIN often y ON y.lang = c.lang AND y.phrase = c.q
  JOIN totals t ON t.lang = c.lang
), best AS (
  SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
         phrase, a, l, r, n, score::BIGINT AS score
  FROM best b WHERE NOT EXISTS (SELECT 1 FROM dropped d WHERE d.lang = b.lang AND d.phrase = b.phrase)
) WHERE rank <= 2000
"""
