"""Toxicity by a weighted finite-state pattern grammar.

A document is cut into clauses.  A lexicon transducer turns a clause's words into class symbols
(insult, threat verb, target, negation, reported speech, other) with a weight.  Five transducers,
composed into one machine, rewrite the symbols and add weights of their own:

* insult: an insult counts, one that follows another within a few words counts more;
* threat: a target up to a few words after a threat verb completes a threat;
* target: an insult or threat verb up to a few words after a target is aimed;
* negation: up to a few words after a negation it is denied;
* reported speech: after a verb of saying it is reported.

A clause's total is the weight of its whole path, and its kind follows from the marks of its
rewritten symbols (threat, aimed insult, insult, bare threat verb, reported, denied).  What a document's score is made of are
totals of matched clauses by kind, the best of them and their number; what each counts for is
fitted by a logistic regression on labels.

Insult entries are a fixed list and what is learned: whole words and word beginnings of 4 to 6
letters whose smoothed log odds exceed ``MIN_ODDS`` and that stand in enough toxic training
documents, ``FEWEST_DOCS`` at least, and so many that of the terms in just as many documents, all
of them toxic, at most ``FALSE_SHARE`` would be expected by chance.  Training documents that are
near copies (equal in one of three minimum word-pair hashes) count once, so that one text copied
often does not fill the lexicon.  The sample has at most ``TRAIN_ROWS`` labelled documents, which
bounds the lexicon; scoring is one pass over every whole text, no shuffle.

Defined cases: null and empty texts have no clause and get the score of a document without
matches; repeated rows get equal scores; without labels, or with labels of one kind only, the
score is the label share (0 without labels); null ids are scored, held_out is null; words of any
length and texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read, with_bytes
from .labelled import fold, training_sample

TRAIN_ROWS = 12_000
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
FEWEST_DOCS, FALSE_SHARE, MIN_ODDS = 3, 0.15, 3.0
CACHE = 400_000

# Closed classes of English, French, German and Spanish words.
CLASSES = {
    "N": "not no never neither nor isn't aren't wasn't don't doesn't ne pas jamais nicht kein keine keinen nie ni nunca tampoco",
    "R": "said says say told claimed claims wrote quoted called reported dit disait sagte sagt gesagt dijo dice dicho",
    "T": "you your yours yourself he him his she her they them their u tu te toi vous ton ta tes du dich dir dein deine ihr sie ihn usted ustedes tú ti",
    "V": "kill hurt destroy beat shoot stab burn hang strangle crush tuer frapper brûler töten schlagen verbrennen matar golpear quemar",
    "I": "idiot moron stupid loser scum trash pathetic worthless disgusting clown imbecile fool dumb filth vermin",
}
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_BREAK = re.compile(r"[.!?;:|\n]")


# ---------------------------------------------------------------- transducers


@dataclass
class Transducer:
    """A finite-state machine over symbols: arcs from a state by input to (output, next, weight)."""

    start: object
    arcs: dict = field(default_factory=dict)

    def arc(self, state, symbol: str, out: str, to, weight: float = 0.0) -> None:
        self.arcs.setdefault(state, {})[symbol] = (out, to, weight)

    def run(self, symbols: list[str]) -> tuple[list[str], float]:
        state, out, total = self.start, [], 0.0
        for s in symbols:
            o, state, w = self.arcs[state][s]
            out.append(o)
            total += w
        return out, total


def compose(a: Transducer, b: Transducer) -> Transducer:
    """The machine that feeds a's output to b; weights add.  Only states that can be reached."""
    start = (a.start, b.start)
    made, todo, seen = Transducer(start), [start], {start}
    while todo:
        p, q = at = todo.pop()
        for symbol, (mid, p2, w1) in a.arcs.get(p, {}).items():
            if mid not in b.arcs.get(q, {}):
                continue
            out, q2, w2 = b.arcs[q][mid]
            to = (p2, q2)
            made.arc(at, symbol, out, to, w1 + w2)
            if to not in seen:
                seen.add(to)
                todo.append(to)
    return made


MARKS = "!+@-\""  # insult or threat, piled up, aimed, denied, reported
ALPHABET = [base + "".join(m for k, m in enumerate(MARKS) if n >> k & 1) for base in "IVNRTO" for n in range(1 << len(MARKS))]


def after(trigger: str, mark: str, on: str, reach: int, weight: float, again: bool = False) -> Transducer:
    """Marks symbols of the kinds ``on`` that stand up to ``reach`` words after a ``trigger``.  With
    ``again`` the state also counts from a symbol that it marks."""
    t = Transducer(0)
    for state in range(reach + 1):
        for s in ALPHABET:
            hit = state > 0 and s[0] in on and mark not in s
            nxt = reach if s[0] == trigger or again and hit else max(0, state - 1)
            t.arc(state, s, s + mark if hit else s, nxt, weight if hit else 0.0)
    return t


def insult() -> Transducer:
    """Every insult is marked; one up to six words after another is marked as piled up."""
    t = Transducer(0)
    for state in range(7):
        for s in ALPHABET:
            out = s if s[0] != "I" or "!" in s else s + ("!+" if state else "!")
            t.arc(state, s, out, 6 if s[0] == "I" else max(0, state - 1), 0.0 if s[0] != "I" else 1.5 if state else 1.0)
    return t


def parts() -> list[Transducer]:
    """The five, in the order in which they apply.  Weights are a prior only; what a kind of clause
    counts for in the end is learned."""
    return [insult(), after("V", "!", "T", 4, 1.0), after("T", "@", "IV", 4, 1.0), after("N", "-", "IV", 3, -2.0), after("R", '"', "IV", 8, -1.0)]


def grammar() -> Transducer:
    """All five in one machine, over the symbols of the lexicon."""
    first, *rest = parts()
    out = Transducer(first.start, {state: {s: a for s, a in arcs.items() if len(s) == 1} for state, arcs in first.arcs.items()})
    for t in rest:
        out = compose(out, t)
    return out


KINDS = ["threat", "aimed", "insult", "verb", "reported", "denied"]
WIDTH = len(KINDS) + 4


def kind_of(marked: list[str]) -> str | None:
    """A clause's kind by its rewritten symbols; None where nothing matches."""
    hits = [s for s in marked if s[0] in "IV"]
    if not hits:
        return None
    live = [s for s in hits if "-" not in s]
    if not live:
        return "denied"
    spoken = [s for s in live if '"' in s]
    if len(spoken) == len(live):
        return "reported"
    if any(s[0] == "T" and "!" in s for s in marked) or any(s[0] == "V" and "@" in s for s in live):
        return "threat"
    if any(s[0] == "I" and "@" in s for s in live):
        return "aimed"
    return "insult" if any(s[0] == "I" for s in live) else "verb"


class Machine:
    """The lexicon and the composed machine, run over clauses."""

    def __init__(self, terms: dict[str, float]):
        self.words = {w: (k, 0.0) for k, ws in CLASSES.items() for w in ws.split()}
        self.whole = {t: w for t, w in terms.items() if not t.endswith("*")}
        self.heads = {t[:-1]: w for t, w in terms.items() if t.endswith("*")}
        self.lengths = sorted({len(h) for h in self.heads}, reverse=True)
        self.grammar = grammar()
        self.cache: dict[bytes, bool] = {}

    def entry(self, word: str) -> tuple[str, float]:
        """Class and weight of a word: the better of its own entry and its beginning's."""
        weight = self.whole.get(word, 0.0)
        for n in self.lengths:
            if len(word) >= n:
                weight = max(weight, self.heads.get(word[:n], 0.0))
        if weight > 0:
            return "I", weight
        return self.words.get(word, ("O", 0.0))

    def trigger(self, token: bytes) -> bool:
        """Whether a blank-separated token holds an insult or threat; cached."""
        return any(self.entry(w)[0] in "IV" for w in _WORD.findall(token.decode("utf-8", "replace").lower()))

    def clause(self, words: list[str]) -> tuple[str | None, float]:
        """Kind and total weight of a clause."""
        entries = [self.entry(w) for w in words]
        if not any(k in "IV" for k, _ in entries):
            return None, 0.0
        marked, total = self.grammar.run([k for k, _ in entries])
        return kind_of(marked), total + sum(w for _, w in entries)

    def figures(self, raw: bytes) -> np.ndarray:
        """Per kind of clause the log of one plus the sum of totals; then the best clause, the number
        of matched clauses, whether any is neither denied nor reported, and how dense they are.  All
        are zero without a match, whatever the length of the text."""
        out = np.zeros(WIDTH)
        tokens = raw.split()
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        hit = False
        for t in tokens:
            known = cache.get(t)
            if known is None:
                known = cache[t] = self.trigger(t)
            if known:
                hit = True
        if not hit:
            return out
        best = matched = live = 0.0
        for line in raw.split(b"\n"):
            if not any(cache.get(t) for t in line.split()):
                continue
            for clause in _BREAK.split(line.decode("utf-8", "replace").lower()):
                kind, total = self.clause(_WORD.findall(clause))
                if kind is None:
                    continue
                out[KINDS.index(kind)] += max(total, 0.0)
                matched += 1
                best = max(best, total)
                live = max(live, float(kind in KINDS[:3]))
        out[: len(KINDS)] = np.log1p(out[: len(KINDS)])
        out[len(KINDS) :] = math.log1p(best), math.log1p(matched), live, math.log1p(100 * matched / len(tokens))
        return out


# ---------------------------------------------------------------- learning


def _terms(raw: bytes) -> set[str]:
    words = set(_WORD.findall(raw.decode("utf-8", "replace").lower()))
    return words | {w[:n] + "*" for w in words for n in (4, 5, 6) if len(w) >= n}


def _sketch(raw: bytes) -> list[int]:
    """Three minima of word-pair hashes; near copies agree in most."""
    words = raw.lower().split()
    pairs = {xxhash.xxh64_intdigest(a + b" " + b) for a, b in zip(words, words[1:] or [b""])} or {0}
    h = np.fromiter(pairs, np.uint64, len(pairs))
    with np.errstate(over="ignore"):
        return [int((h * np.uint64(m) >> np.uint64(1)).min()) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def learn_terms(sample: DataFrame, scratch: Scratch) -> dict[str, float]:
    """Lexicon entries with their log odds; what reaches the driver is bounded by the sample."""

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(zip(*(_sketch(x) for x in batch.column(1).to_pylist()))) or [()] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in got)], names=["id", "raw", "y", "s0", "s1", "s2"])

    kind = sample.schema["id"].dataType.simpleString()
    own = sample.mapInArrow(sketches, f"id {kind}, raw binary, y int, s0 long, s1 long, s2 long")
    for s in ("s0", "s1", "s2"):
        own = own.groupBy(s).agg(F.min_by(F.struct(*own.columns), F.struct("id", "raw")).alias("r")).select("r.*")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos: dict[str, int] = {}
        neg: dict[str, int] = {}
        docs = [0, 0]
        for batch in batches:
            for raw, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs[y] += 1
                into = pos if y else neg
                for t in _terms(raw):
                    into[t] = into.get(t, 0) + 1
        names = [*pos, *(t for t in neg if t not in pos), ""]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names), pa.array([*(pos.get(t, 0) for t in names[:-1]), docs[1]], pa.int64()), pa.array([*(neg.get(t, 0) for t in names[:-1]), docs[0]], pa.int64())],
            names=["term", "pos", "neg"],
        )

    counts = own.select("raw", F.col("y").cast("int").alias("y")).mapInArrow(counted, "term string, pos long, neg long")
    counts = scratch.table(counts.groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "terms")
    n = counts.filter("term = ''").first()
    if n is None or not n["pos"] or not n["neg"]:
        return {}
    share = n["pos"] / (n["pos"] + n["neg"])
    sizes = counts.filter("term <> ''").groupBy((F.col("pos") + F.col("neg")).alias("k")).agg(F.count("*").alias("all"), F.count_if(F.col("neg") == 0).alias("toxic")).collect()
    sure = [r["k"] for r in sizes if r["k"] >= FEWEST_DOCS and r["all"] * share ** r["k"] <= FALSE_SHARE * r["toxic"]]
    if not sure:
        return {}
    least = min(sure)
    odds = F.log((F.col("pos") + 0.5) / F.lit(n["pos"] + 1.0)) - F.log((F.col("neg") + 0.5) / F.lit(n["neg"] + 1.0))
    rows = counts.filter(F.col("term") != "").withColumn("odds", odds).filter((F.col("pos") >= least) & (F.col("odds") >= MIN_ODDS))
    found = {r["term"]: (r["odds"], r["pos"], r["neg"]) for r in rows.collect()}
    # a beginning says no more than a shorter one that is as sure
    kept = {}
    for t, (w, p, m) in found.items():
        shorter = [t[:k] + "*" for k in (4, 5, 6) if len(t.rstrip("*")) > k or (not t.endswith("*") and len(t) >= k)]
        if not any(s != t and s in found and found[s][0] >= w for s in shorter):
            kept[t] = float(w)
    return kept


@dataclass
class Model:
    terms: dict[str, float]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Newton steps on the penalised log loss."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], axis=1)
    w = np.zeros(z.shape[1])
    ridge = np.diag([penalty] * (len(w) - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = FOLDS, held_out: int = HELD_OUT, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = scratch.table(training_sample(docs, labels, label, folds, held_out, rows, id_col, text_col), "sample")
    terms = learn_terms(sample, scratch)
    kind = sample.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(terms)
        for batch in batches:
            got = [machine.figures(raw).tobytes() for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(got, pa.binary())], names=["id", "y", "x"])

    got = sample.mapInArrow(run, f"id {kind}, y int, x binary").toPandas().sort_values(["id", "x"], kind="stable")
    scratch.close(sample)
    y = got["y"].to_numpy(float)
    width = WIDTH
    if len(np.unique(y)) < 2:
        p = min(max(float(y.mean()) if len(y) else 0.0, 1e-9), 1 - 1e-9)
        return Model(terms, np.zeros(width), np.ones(width), np.zeros(width), math.log(p / (1 - p)))
    return Model(terms, *logistic(np.stack([np.frombuffer(v) for v in got["x"]]), y))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        machine = Machine(m.terms)
        for batch in batches:
            x = np.stack([machine.figures(raw) for raw in batch.column(1).to_pylist()]) if batch.num_rows else np.zeros((0, len(m.mean)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.score(x), pa.float64())], names=[id_col, "score"])

    return with_bytes(docs, text_col).select(id_col, "_bytes").mapInArrow(run, f"`{id_col}` {kind}, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    got = score(docs, train(docs, read(spark, sf_dir, "labels")))
    return got.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
