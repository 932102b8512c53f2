"""Lexical retrieval packing: sequences of related documents, filled through BM25.

Texts become token ids; documents are dealt by content over shards of bounded size.  Each shard
builds an inverted index of its documents (terms are token ids).  A seed opens a window; the index
returns unused neighbours by BM25 score, best first, and they fill the window greedily.  The one
that no longer fits is cut: its head closes the window and its tail seeds the next, so only the
last window of a shard is short, and that is cut at powers of two, which need no padding.
Documents longer than a window fill whole windows of their own first.

Shards by content: a document's term weights are projected onto ``DIM`` random directions, and a
tree of two-means splits, fitted on about ``ROUTING_DOCS`` documents, names its leaf; ``SIGN_BITS``
signs of the projection cut a leaf further.  Leaves, in the order of the tree, fill shards one after
another, so like documents meet in a shard.  Leaves above the size of a shard are split by row.
Only the routing is fitted on a sample: every document is in the index of its shard, and document
frequencies, the document count and the mean length are those of the whole corpus; their size is
bounded by the tokenizer's vocabulary.  The README gives the recall of neighbours against one index
of all documents.

Token ids are written once to the shared folder (two bytes each), read for the statistics, and
shuffled by shard.  A shard holds about ``shard_tokens`` tokens, however large the corpus; the
number of shards grows instead.

Defined cases: null and empty texts are the end id alone; repeated rows are packed each; ties in
score go to the smaller document id, then the earlier row; rows with a null id are packed too and
ids of any type come back as they are; an empty table gives no pieces; a document of any length is
cut; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read

WINDOW = 4096
END_ID = 2
SHARD_TOKENS = 1 << 20
ROUTING_DOCS = 8192
LEAF_DOCS = 8
DIM = 64
SIGN_BITS = 4
K1, B = 1.2, 0.75
CACHE_PIECES = 500_000
VOCABULARY = 1 << 16

# Texts of these characters only are cut by a plain pattern: ASCII without the four controls that
# count as blanks in Python alone, and the Latin-1 letters.
_PLAIN = re.compile(r"[\x00-\x1b\x20-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
_PLAIN_PIECE = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\sa-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
# Fixed value: the pre-tokenizer's pattern, as the tokenizer file states it.
_PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# A full stop or comma that a run of signs goes on with; any other begins a piece.
_GOES_ON = re.compile(r"[^\sa-z0-9\u00df-\u00f6\u00f8-\u00ff][.,]")
_WHOLE = re.compile("[\x1c-\x1f\u03a3]|<\\|")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes
    stand for themselves, the others for the letters from U+0100 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Encoder(dict):
    """Token ids of whole texts, through a bounded cache of words and pieces in two generations.

    The tokenizer lower-cases, cuts a text into pieces and encodes each by itself, so a text's ids
    are its pieces' ids.  No piece holds a blank, so plain texts are cut at blanks, and a word into its
    pieces only when it is met first.  Texts in which cutting could differ (final sigma, control characters,
    special tokens) are given to the tokenizer whole.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > VOCABULARY:
            raise ValueError("token ids must fit two bytes")
        self.pieces = regex.compile(_PIECE).findall
        self.letters = _byte_letters()
        self.model = self.tokenizer.model
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        out = self.older.get(piece)
        if out is not None:
            self[piece] = out
            return out
        text = piece
        if not (piece.isascii() and piece.isalpha()):
            if _PLAIN.fullmatch(piece) and len(parts := _PLAIN_PIECE.findall(piece)) > 1:
                out = self[piece] = b"".join(map(self.__getitem__, parts))
                return out
            text = "".join(self.letters[b] for b in piece.encode())
        out = self[piece] = array("H", [t.id for t in self.model.tokenize(text)]).tobytes()
        return out

    def text(self, text: str) -> bytes:
        if _PLAIN.fullmatch(text) and "<|" not in text:
            text = text.lower()
            pieces = (text if _GOES_ON.search(text) else text.replace(".", " .").replace(",", " ,")).split()
        elif _WHOLE.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16).tobytes()
        else:
            pieces = self.pieces(unicodedata.normalize("NFC", text).lower())
        return b"".join(map(self.__getitem__, pieces))

    def encode(self, texts: list[str], end_id: int = END_ID) -> list[bytes]:
        if len(self) > CACHE_PIECES:  # pieces in use come back from the older generation
            self.older = dict(self)
            self.clear()
        end = np.array([end_id], np.uint16).tobytes()
        return [self.text(x) + end for x in texts]


_ENCODERS: dict[str, Encoder] = {}


class Router:
    """Bucket of a document by its content: a tree of two-means splits, then signs.

    ``ids`` are the documents that it is fitted on.  Buckets are numbered in the order of the tree.
    """

    def __init__(self, ids: list[np.ndarray], seed: int = 3):
        rng = np.random.default_rng(seed)
        df = np.zeros(VOCABULARY, np.int64)
        for x in ids:
            df[np.unique(x)] += 1
        idf = np.log1p((len(ids) - df + 0.5) / (df + 0.5))
        self.terms = rng.standard_normal((VOCABULARY, DIM), np.float32)
        self.terms *= idf[:, None].astype(np.float32)
        self.tree: list[tuple[np.ndarray, float, int, int]] = []  # direction, cut, left, right; negative: leaf
        self.leaves = 0
        rows = self.vectors([np.unique(x, return_counts=True) for x in ids]) if ids else np.zeros((1, DIM), np.float32)
        self.centre = rows.mean(axis=0)
        self.signs = rng.standard_normal((DIM, SIGN_BITS)).astype(np.float32)
        self.root = self._grow(rows, rng)
        self.direction = np.stack([t[0] for t in self.tree]) if self.tree else np.zeros((0, DIM), np.float32)
        self.cut, self.left, self.right = (np.array([t[k] for t in self.tree]) for k in (1, 2, 3))

    def _grow(self, rows: np.ndarray, rng: np.random.Generator) -> int:
        if len(rows) >= 2 * LEAF_DOCS:
            two = rows[rng.choice(len(rows), 2, replace=False)]
            for _ in range(8):
                near = ((rows[:, None] - two[None]) ** 2).sum(axis=2).argmin(axis=1)
                if near.min() == near.max():
                    break
                two = np.stack([rows[near == k].mean(axis=0) for k in (0, 1)])
            direction = two[1] - two[0]
            cut = float(direction @ (two[0] + two[1]) / 2)
            right = rows @ direction > cut
            if LEAF_DOCS // 4 <= right.sum() <= len(rows) - LEAF_DOCS // 4:
                at = len(self.tree)
                self.tree.append((direction, cut, 0, 0))
                left = self._grow(rows[~right], rng)
                self.tree[at] = (direction, cut, left, self._grow(rows[right], rng))
                return at
        self.leaves += 1
        return -self.leaves

    def vectors(self, terms: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The projected weights of documents, given as distinct ids and their counts, of length one."""
        v = np.stack([(1 + np.log(tf)).astype(np.float32) @ self.terms[t] for t, tf in terms])
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def buckets(self, terms: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        v = self.vectors(terms)
        at = np.full(len(v), self.root)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            right = (self.direction[node] * v[inner]).sum(axis=1) > self.cut[node]
            at[inner] = np.where(right, self.right[node], self.left[node])
        bits = (v - self.centre) @ self.signs > 0
        return ((-1 - at << SIGN_BITS) + bits @ (1 << np.arange(SIGN_BITS))).astype(np.int32)


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _forget() -> None:
    """Once texts are ids, the encoders' caches only take room from what comes next in a worker."""
    _ENCODERS.clear()


def router(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None, most: int = ROUTING_DOCS) -> Router:
    """A router fitted on about ``most`` documents, taken by a hash of their texts."""
    path = tokenizer or tokenizer_path()
    n = docs.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_encoder(path).encode([x or "" for x in batch.column(0).to_pylist()]), pa.binary())], names=["ids"])

    # copies of a text are one document here: what is taken of a group of copies is at most one a partition
    own = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    own = own.filter(F.pmod(F.xxhash64("t"), F.lit(1 << 30)) * n < most * (1 << 30)).distinct()
    rows = sorted(bytes(r[0]) for r in own.mapInArrow(run, "ids binary").toLocalIterator())
    return Router([np.frombuffer(x, np.uint16) for x in rows])


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, route: Router | None = None) -> DataFrame:
    """``(id, ids, n, bucket, row, part)``: token ids as little-endian two-byte integers, the end id
    last; the bucket that ``route`` gives; a number of the row; part 0.

    Every task adds one row of part 1: in how many of its documents each id stands, as eight-byte
    integers.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    path = tokenizer or tokenizer_path()
    shared = docs.sparkSession.sparkContext.broadcast(route)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, way = _encoder(path), shared.value
        df = np.zeros(VOCABULARY, np.int64)
        names = [id_col, "ids", "n", "bucket", "row", "part"]
        none, row = None, TaskContext.get().partitionId() << 40
        for batch in batches:
            none = pa.nulls(1, batch.column(0).type)
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                got = encoder.encode([x or "" for x in part.column(1).to_pylist()])
                terms = [np.unique(np.frombuffer(raw, np.uint16), return_counts=True) for raw in got]
                for t, _ in terms:
                    df[t] += 1
                bucket = way.buckets(terms) if way else np.zeros(len(got), np.int32)
                cols = [pa.array(got, pa.binary()), pa.array([len(x) // 2 for x in got], pa.int64()), pa.array(bucket), pa.array(np.arange(row, row + len(got))), pa.array(np.zeros(len(got), np.int32))]
                row += len(got)
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=names)
        if none is not None:
            cols = [pa.array([df.tobytes()], pa.binary()), pa.array([0], pa.int64()), pa.array([0], pa.int32()), pa.array([row]), pa.array([1], pa.int32())]
            yield pa.RecordBatch.from_arrays([none, *cols], names=names)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids binary, n long, bucket int, row long, part int")


def bucket_spans(tokens: DataFrame, shard_tokens: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Where each bucket begins and ends, in shards; and the number of shards.

    What comes to the driver is one number a bucket, of which there are at most as many as routing
    documents times signs.
    """
    rows = tokens.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    size = np.zeros(int(rows["bucket"].max()) + 1 if len(rows) else 1, np.int64)
    size[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    total = int(size.sum())
    shards = max(1, round(total / shard_tokens))
    end = np.cumsum(size) * (shards / max(total, 1))
    return end - size * (shards / max(total, 1)), end, shards


def shard_of(bucket: np.ndarray, row: np.ndarray, spans: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """A bucket's rows, repeated ones too, are dealt over its span by a mix of their number."""
    begin, end, shards = spans
    with np.errstate(over="ignore"):
        mixed = (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) / 2.0**32
    return np.clip((begin[bucket] + mixed * (end - begin)[bucket]).astype(np.int64), 0, shards - 1)


def document_frequencies(tokens: DataFrame) -> np.ndarray:
    """In how many documents each id stands; tasks add up what they read before it is summed by
    term, and what comes back is bounded by the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(VOCABULARY, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                df += np.frombuffer(raw, np.int64)
        own = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(df[own])], names=["term", "n"])

    rows = tokens.filter("part = 1").select("ids").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(VOCABULARY, np.int64)
    out[rows["term"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


class ShardIndex:
    """BM25 postings of one shard, as one array sorted by term."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float):
        self.n = len(docs)
        terms, tfs, owner = [], [], []
        self.query = []
        for j, ids in enumerate(docs):
            t, tf = np.unique(ids, return_counts=True)
            self.query.append(t)
            terms.append(t)
            tfs.append(tf)
            owner.append(np.full(len(t), j, np.int32))
        term, tf, own = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (terms, tfs, owner))
        length = np.array([len(x) for x in docs], float)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[own.astype(np.int64)] / mean_length))
        order = np.argsort(term, kind="stable")
        self.owner, self.weight = own[order], weight[order]
        self.at = np.searchsorted(term[order], np.arange(len(idf) + 1))

    def keep(self, docs: np.ndarray) -> None:
        """Leave out the postings of all other documents, whose scores are zero from now on."""
        own = docs[self.owner]
        self.at = np.concatenate([[0], np.cumsum(own)])[self.at]
        self.owner, self.weight = self.owner[own], self.weight[own]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document for the seed's distinct terms."""
        t = self.query[seed]
        lo, size = self.at[t], self.at[t + 1] - self.at[t]
        total = int(size.sum())
        where = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(total)
        return np.bincount(self.owner[where], weights=self.weight[where], minlength=self.n)


def pack_shard(ids: list[np.ndarray], idf: np.ndarray, mean_length: float, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)`` of one shard.

    Seeds are taken longest first, so that the short documents are left to fill.
    """
    index = ShardIndex(ids, idf, mean_length)
    unused = np.ones(len(ids), bool)
    queue = iter(np.argsort([-len(x) for x in ids], kind="stable").tolist())
    pieces: list[tuple[int, int, int, int, int]] = []
    indexed = len(ids)
    sequence, carry = 0, None  # carry: a cut document and where its rest starts
    while True:
        if carry is None:
            seed = next((j for j in queue if unused[j]), None)
            if seed is None:
                break
            unused[seed] = False
            carry = (seed, 0)
        seed, start = carry
        carry, filled = None, 0
        take = min(window, len(ids[seed]) - start)
        pieces.append((seed, start, take, sequence, 0))
        filled = take
        if start + take < len(ids[seed]):
            carry = (seed, start + take)
        elif filled < window and unused.any():
            left = np.flatnonzero(unused)
            if 4 * len(left) < 3 * indexed:
                index.keep(unused)
                indexed = len(left)
            score = index.scores(seed)
            for j in left[np.argsort(-score[left], kind="stable")].tolist():
                unused[j] = False
                take = min(window - filled, len(ids[j]))
                pieces.append((j, 0, take, sequence, filled))
                filled += take
                if take < len(ids[j]):
                    carry = (j, take)
                if filled == window:
                    break
        sequence += 1
    return _trim(pieces, window)


def _trim(pieces: list[tuple[int, int, int, int, int]], window: int) -> list[tuple[int, int, int, int, int]]:
    """Cut the last, short window into sequences of powers of two."""
    if not pieces:
        return pieces
    last = pieces[-1][3]
    tail = [p for p in pieces if p[3] == last]
    total = sum(p[2] for p in tail)
    if total == window:
        return pieces
    out = [p for p in pieces if p[3] != last]
    room = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
    k, offset = 0, 0
    for doc, start, length, _, _ in tail:
        while length:
            take = min(length, room[k] - offset)
            out.append((doc, start, take, last + k, offset))
            start, length, offset = start + take, length - take, offset + take
            if offset == room[k]:
                k, offset = k + 1, 0
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, tokenizer: str | None = None, shard_tokens: int = SHARD_TOKENS, routing_docs: int = ROUTING_DOCS) -> DataFrame:
    """One row per piece; see the module's docstring."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    route = router(docs, text_col, tokenizer, routing_docs)
    tokens = scratch.table(tokenize(docs, id_col, text_col, tokenizer, route), "tokens", by="part")
    df = document_frequencies(tokens)
    tokens = tokens.filter("part = 0")
    n_docs, n_tokens = tokens.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5)).astype(np.float32)
    mean_length = n_tokens / max(n_docs, 1)
    way = spark.sparkContext.broadcast(bucket_spans(tokens, shard_tokens))
    kind = docs.schema[id_col].dataType.simpleString()
    shared = spark.sparkContext.broadcast(idf)  # one float per token id

    def run(key: tuple, table: pa.Table) -> pa.Table:
        _forget()
        table = table.sort_by([(id_col, "ascending"), ("ids", "ascending"), ("row", "ascending")]).combine_chunks()
        ids = [np.frombuffer(x.as_buffer(), np.uint16) for x in table.column("ids")]
        rows = pack_shard(ids, shared.value, mean_length, window)
        doc = [r[0] for r in rows]
        cols = [
            [r[1] for r in rows],
            [r[2] for r in rows],
            [zlib.crc32(ids[r[0]][r[1] : r[1] + r[2]].astype("<u4").tobytes()) for r in rows],
            [len(ids[d]) for d in doc],
            [(key[0].as_py() << 32) + r[3] for r in rows],
            [r[4] for r in rows],
        ]
        return pa.table([table.column(id_col).take(pa.array(doc, pa.int64())), *(pa.array(c, pa.int64()) for c in cols)], names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = shard_of(batch.column(3).to_numpy(), batch.column(2).to_numpy(), way.value)
            yield pa.RecordBatch.from_arrays([pa.array(shard), *batch.columns[:3]], names=["shard", id_col, "ids", "row"])

    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    dealt = tokens.select(id_col, "ids", "row", "bucket").mapInArrow(deal, f"shard long, `{id_col}` {kind}, ids binary, row long")
    return scratch.close(dealt.groupBy("shard").applyInArrow(run, schema))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
