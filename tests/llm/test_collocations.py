"""Phrase collocations against direct counting."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from cladeloom.llm import collocations


def _brute(rows: list[tuple], least: int, most: int, top: int, percent: int) -> list[tuple]:
    count, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for m in range(1, most + 1):
                for i in range(len(words) - m + 1):
                    count[lang, tuple(words[i : i + m])] += 1
    good = {k: a for k, a in count.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in good.items():
        inside = any(g == lang and len(v) > len(w) and 100 * b >= percent * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (g, v), b in good.items())
        if not inside:
            n = total[lang]
            score, k = min((1000 * a * n // (count[lang, w[:k]] * count[lang, w[k:]]), k) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), a, count[lang, w[:k]], count[lang, w[k:]], n))
    return sorted((lang, r + 1, x[2].decode(), *x[3:], -x[0]) for lang, got in out.items() for r, x in enumerate(sorted(got)[:top]))


def _rows(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    words = ["a", "b", "c", "é", "dd", "E", "\x01", "naïve"] * 3 + [f"w{k}" for k in range(30)]
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\r\n", "; ", "\xa0"]
    out = [(rng.choice(["x", "y", None]), "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randrange(60)))) for _ in range(n)]
    return [*out, ("x", None), ("x", ""), ("z", "..."), ("x", "a b c dd E " * 40), ("x", "a a a a a a a"), ("und", "a b")]


@pytest.mark.parametrize("listed,bucket,percent", [(1 << 18, 1 << 21, 100), (1 << 18, 40, 100), (4, 300, 100), (0, 100, 60), (7, 1 << 21, 60)])
def test_against_direct_counting(spark, monkeypatch, listed, bucket, percent):
    """Whole and short word lists, one bucket and many, pivots in one bucket and in several."""
    monkeypatch.setattr(collocations, "BLOCK", 50)
    monkeypatch.setattr(collocations, "CHUNK", 200)
    monkeypatch.setattr(collocations, "HELD_WORDS", 20)
    rows = _rows(7, 150)
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "lang string, text string, n long, phrase string").repartition(3)
    out = collocations.collocations(df, min_count=6, top=25, closed_percent=percent, listed=listed, bucket_words=bucket)
    got = sorted(tuple(r) for r in out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == _brute(rows, 6, 5, 25, percent)


def test_counts_beyond_64_bits(spark):
    """Products of counts are exact in decimals."""
    phrases = spark.createDataFrame([("x", "a b", 10**12 + 7, 3 * 10**12 + 1, 2 * 10**12 + 5)], "lang string, phrase string, a long, first_n long, last_n long")
    totals = spark.createDataFrame([("x", 3 * 10**13 + 11)], "lang string, n long")
    row = collocations.scored(phrases, None, totals).collect()[0]
    assert row["score"] == 1000 * (10**12 + 7) * (3 * 10**13 + 11) // ((3 * 10**12 + 1) * (2 * 10**12 + 5))


def test_empty(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None)], "lang string, text string")).count() == 0
