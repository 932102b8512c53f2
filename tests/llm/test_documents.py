"""Operators over texts: brute force, exact cases, and odd inputs."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from cladeloom.llm import decontaminate, language_model, license_scan, line_dedup, matroska, packing, quality, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, component_id string, _bytes string, row string, raw int, n int, h1 string, ids string, _id int, y int, score string, shard int"
LONG = " ".join(f"w{i % 997}" for i in range(30_000))


def frame(spark, rows):
    """Documents with extra columns whose names clash with working columns."""
    return spark.createDataFrame([(i, t, "en", "s", 0, 7, "x", "b", "r", 1, 2, "h", "i", 3, 9, "s", 4) for i, t in rows], SCHEMA).repartition(3)


ODD = [(1, None), (2, ""), (3, "   "), (4, "one"), (5, "a b c"), (6, "a b c"), (7, LONG), (8, "É é Ü\nzwei  Wörter\tdrei\r\nvier"), (None, "no id at all here"), (9, "a b c"), (9, "a b c")]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else f"{rng.choice('bcdfgh')}{rng.choice('aeiou')}{rng.randrange(300)}" for _ in range(n))


# ------------------------------------------------------------------ SimHash


def brute_print(text: str) -> int:
    words = (text or "").encode().lower().split()
    k = min(3, len(words))
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(rows):
    prints = [brute_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return sorted(((d, prints[i], low.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def test_simhash_matches_brute_force(spark):
    rows = [(i, prose(i, 60)) for i in range(20)]
    for i in range(20, 60):
        words = prose(i % 20, 60).split()
        words[i % 60] = "changed"
        rows.append((i, " ".join(words)))
    rows += [(60 + i, "tiny text number" if i % 2 else "") for i in range(6)] + ODD
    got = [(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == brute_groups(rows)


def test_simhash_chain_is_one_group(spark):
    fps = [0, 3, 15, 63, 255, 1 << 40]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {tuple(sorted((r["fp"], r["other"]))) for r in simhash.links(df).collect()}
    assert {(0, 3), (3, 15), (15, 63), (63, 255)} <= got
    assert all(bin(a ^ b).count("1") <= 2 for a, b in got)


def test_simhash_links_run_through_rows_without_an_id(spark):
    """Texts 1 and 2 are near the null-id row's, not near each other."""
    base = prose(5, 12)
    near = {}
    for k in range(40_000):
        words = base.split()
        words[k % 12] = f"v{k}"
        d = bin(brute_print(" ".join(words)) ^ brute_print(base)).count("1")
        if d == 2:
            near.setdefault(brute_print(" ".join(words)) ^ brute_print(base), " ".join(words))
        pair = next(((a, b) for a in near for b in near if a & b == 0 and a), None)
        if pair:
            break
    rows = [(1, near[pair[0]]), (2, near[pair[1]]), (None, base), (3, prose(6, 30))]
    got = [(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == brute_groups(rows)
    assert {r[0]: r[2] for r in got} == {1: 1, 2: 1, None: 1, 3: 3}
    alone = simhash.near_duplicates(frame(spark, [(None, "all alone here"), (7, prose(8, 30))])).collect()
    assert {r["doc_id"]: r["component_id"] for r in alone} == {None: None, 7: 7}


# ------------------------------------------------------------------ line dedup


def edit_at_most_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    return a[p + 1 :] == b[p + 1 :] or a[p:] == b[p + 1 :] or a[p + 1 :] == b[p:]


def brute_lines(rows, least=8):
    seen, out = [], {}
    for d, text in sorted(rows):
        gone = []
        for pos, line in enumerate(text.split("\n")):
            w = line.split()
            if not w:
                continue
            if any(x == w or (min(len(x), len(w)) >= least and edit_at_most_one(x, w)) for x in seen):
                gone.append(pos)
            seen.append(w)
        out[d] = gone
    return out


@pytest.mark.parametrize("least", [1, 2, 3, 8])
def test_line_dedup_matches_brute_force(spark, least):
    rng = random.Random(5)
    sizes = [3, 7, 8, 9, 15, 16, 17, 31, 32, 33] if least > 3 else [1, 2, 3, 4, 5, 8, 9, 16]
    pool = [[rng.choice("abcd") + str(rng.randrange(40)) for _ in range(rng.choice(sizes))] for _ in range(25)]
    rows = []
    for d in range(40):
        lines = []
        for _ in range(5):
            w = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.randrange(len(w))
                kind = rng.randrange(3)
                w[at : at + (kind != 0)] = [] if kind == 1 else [rng.choice("abcdx")]
                if not w:
                    w = ["z"]
            lines.append(rng.choice([" ", " ", " ", "\t", "\f", " \x0b"]).join(w))
        rows.append((d, "\n".join([*lines, ""])))
    fates = {r["id"]: r["removed"] for r in line_dedup.line_fates(frame(spark, rows), min_words=least).collect()}
    want = brute_lines(rows, least)
    assert {d: g for d, g in want.items() if g} == fates and fates
    clean = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame(spark, rows), min_words=least).collect()}
    for d, text in rows:
        assert clean[d] == "\n".join(x for k, x in enumerate(text.split("\n")) if k not in want[d])


def test_line_dedup_odd_rows(spark, odd, empty):
    out = line_dedup.dedup_lines(odd)
    assert out.columns == odd.columns and out.count() == len(ODD)
    text = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert (1, None) in text and (5, "a b c") in text and (6, "") in text and (7, LONG) in text
    assert line_dedup.dedup_lines(empty).count() == 0


# ------------------------------------------------------------------ license scan


def test_license_scan(spark, empty):
    rows = [
        (1, "Some prose.\nLicensed under CC BY-NC 4.0.\nAll Rights, reserved"),
        (2, "This work is licensed under the GNU General Public License, version 3."),
        (3, "all rights\nreserved and cc by"),
        (4, "the license version apache nothing"),
        (5, "Kings licensed under the mit release\nReleased under the MIT License. " + LONG),
        (6, "Licensed under the GNU Lesser General Public License version 3"),
        (7, "x " * 100 + "Licensed under the GNU Affero General Public License version 3"),
        (8, "Released under the license."),
        (9, " ".join(f"w{i}" if i % 40 else ["released", "by", "under", "license", "the"][i // 40] for i in range(200))),
        (10, LONG + "\nLicensed under the Apache\nLicense, Version 2.0"),
        (11, "All rights reserved. Licensed under the Apache License, Version 2"),
        (12, "Licensed under the GNU General Public License version 2 or licensed under the GNU General Public License version 3"),
        (13, "y " * 60 + license_scan.TEMPLATES["mit"][1].replace("merge publish", "sell and publish")),
        *[(i + 50 if i else i, t) for i, t in ODD],
    ]
    got = {(r["doc_id"], r["n_words"]): r for r in license_scan.scan(frame(spark, rows)).collect()}
    by = {d: r for (d, _), r in got.items()}
    a, b = by[1], by[2]
    assert by[51]["n_words"] == 0 and by[51]["labels"] == "" and by[57]["n_words"] == 30_000
    assert a["labels"] == "all-rights-reserved,cc-by,cc-by-nc-4.0,reserved" and a["base_labels"] == "cc-by,reserved"
    assert b["base_labels"] == "gpl" and b["labels"] == "gpl,gpl-3.0"
    assert (by[3]["n_base"], by[3]["first_word"], by[3]["last_word"], by[3]["base_labels"]) == (2, 0, 4, "cc-by,reserved")
    assert by[4]["n_base"] == 0 and by[4]["labels"] == "" and by[4]["first_word"] is None and by[4]["score"] == 0
    assert by[5]["labels"] == "mit"
    assert by[6]["labels"] == "gpl,lgpl-3.0" and by[7]["labels"] == "agpl-3.0,gpl"
    assert by[8]["labels"] == "" and by[9]["labels"] == "" and by[10]["labels"] == "apache-2.0"
    assert by[11]["labels"] == "all-rights-reserved,apache-2.0,reserved" and by[12]["labels"] == "gpl,gpl-2.0,gpl-3.0"
    assert by[13]["labels"] == "mit"
    assert license_scan.scan(empty).count() == 0


def test_license_containment_matches_brute_force(spark):
    rng = random.Random(3)
    notices = [(label, t.split()) for label, ts in license_scan.TEMPLATES.items() for t in ts]
    rows = []
    for d in range(80):
        words = []
        while len(words) < 300:
            words += [f"w{rng.randrange(50)}" for _ in range(rng.randrange(30))]
            own = list(rng.choice(notices)[1])
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = rng.choice(rng.choice(notices)[1])
            words += own if rng.random() < 0.8 else own[: len(own) // 2]
        rows.append((d, "".join(w + rng.choice([" ", " ", ", ", "\n"]) for w in words)))
    got = {(r["doc_id"], r["block"], r["label"], round(r["containment"], 9)) for r in license_scan.template_join(frame(spark, rows)).collect()}
    want = set()
    step = license_scan.STRIDE
    for d, text in rows:
        words = text.replace(",", " ").lower().split()
        for k in range(len(words) // step + 1):
            own = words[k * step : (k + 2) * step]
            pairs = set(zip(own, own[1:]))
            for label, t in notices:
                have = set(zip(t, t[1:]))
                if len(pairs & have) >= 0.7 * len(have) - 1e-9 and (k + 1) * step < len(words) + step:
                    want.add((d, k, label, round(len(pairs & have) / len(have), 9)))
    assert got == want and len(want) > 100


# ------------------------------------------------------------------ decontamination


def brute_contaminated(rows, items):
    """From the definition: words, five-word shingles with multiplicity, weights log(1 + items / items with it)."""
    import math
    import re

    def bag(words):
        k = min(5, len(words))
        return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else Counter()

    words_of = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    own = [(i, w) for i, t in items if (w := words_of(t))]
    bags = [bag(w) for _, w in own]
    df = Counter(s for b in bags for s in b)
    weight = lambda s: math.log(1 + len(own) / df.get(s, 1))
    out = set()
    for d, text in rows:
        words = words_of(text)
        for (i, w), b in zip(own, bags):
            best = 0.0
            for lo in range(max(1, len(words) - len(w) + 1)):
                a = bag(words[lo : lo + len(w)])
                low = sum(weight(s) * min(n, b[s]) for s, n in a.items())
                high = sum(weight(s) * max(a[s], b[s]) for s in a | b)
                best = max(best, low / high if high else 0.0)
            if best >= 0.8:
                out.add((d, i, round(best, 9)))
    return out


def test_windows_near_the_threshold_are_not_missed():
    """Of windows at a similarity of 0.80 to 0.86, SimHash and the multi-index lose hardly any."""
    rng = random.Random(12)
    items = [(i, prose(i, 60).encode()) for i in range(30)]
    index = decontaminate.Index(items)
    tried = met = 0
    for k in range(3000):
        j = k % 30
        words = items[j][1].split()
        # words at the ends spoil few shingles, so many windows lie just above the threshold
        for at in rng.sample([0, 1, 2, 3, 4, 5, 56, 57, 58, 59], rng.choice([3, 4, 5])) + rng.choice([[], [30]]):
            words[at] = b"x%d" % rng.randrange(10**6)
        bag = Counter(decontaminate.shingle_hashes(decontaminate._word_hashes(words)).tolist())
        if 0.8 <= decontaminate.similarity(bag, index.bags[j], index.weight) < 0.86:
            tried += 1
            met += any(m[0] == j for m in decontaminate.matches(b" ".join(words), index))
    assert tried > 150 and met >= tried * 0.99


def test_decontamination_matches_brute_force(spark, odd, empty):
    items = [(i, prose(100 + i, 14 + 5 * i)) for i in range(8)] + [(8, "only three words"), (9, ""), (10, None)]
    rows = []
    rng = random.Random(9)
    for d in range(60):
        words = prose(d, 80).split()
        if d % 2:
            item = (items[d % 9][1] or "").split()
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                item[rng.randrange(len(item))] = "other"
            at = rng.randrange(len(words))
            words[at:at] = item
        text = " ".join(words)
        rows.append((d, text.upper() if d % 3 == 0 else text.replace(" the ", " The, ")))
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = {(r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in decontaminate.contaminated(frame(spark, rows), bench).collect()}
    want = brute_contaminated(rows, [(i, t or "") for i, t in items])
    assert got == want and len(want) >= 15
    left = decontaminate.remove_contaminated(frame(spark, rows), bench)
    assert {r["doc_id"] for r in left.collect()} == {d for d, _ in rows} - {d for d, *_ in want}
    small = {(r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in decontaminate.contaminated(frame(spark, rows), bench, items_per_block=3).select("doc_id", "item_id", "similarity").collect()}
    assert {x[:2] for x in small} >= {x[:2] for x in want if x[2] == 1}
    assert decontaminate.contaminated(odd, bench).count() == 0
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(odd, bench.limit(0)).count() == 0
    assert decontaminate.remove_contaminated(odd, bench).count() == len(ODD)
    # rows without an id are judged like any other; the other columns stay as they are
    nameless = frame(spark, [(None, rows[d][1]) for d in sorted({d for d, *_ in want})] + [(None, "clean")])
    assert [tuple(r) for r in decontaminate.remove_contaminated(nameless, bench, items_per_block=3).collect()] == [(None, "clean", "en", "s", 0, 7, "x", "b", "r", 1, 2, "h", "i", 3, 9, "s", 4)]
    dated = bench.selectExpr("date_add(date'2020-01-01', item_id) AS item_id", "text")
    assert decontaminate.contaminated(frame(spark, rows), dated).count() == len(want)


def test_multi_index_finds_all_within_radius():
    rng = np.random.default_rng(1)
    index = decontaminate.Index([(i, prose(i, 30).encode()) for i in range(40)])
    for j in range(40):
        for flips in (0, 5, 12, 19):
            value = int(index.prints[j])
            for b in rng.choice(64, flips, replace=False).tolist():
                value ^= 1 << b
            want = [k for k in range(40) if bin(int(index.prints[k]) ^ value).count("1") <= 19]
            assert index.near(value) == want and j in want


# ------------------------------------------------------------------ packing


def check_packing(docs, pieces, window=4096):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter((d, len(t.encode(x or "", add_special_tokens=False).ids) + 1) for d, x in docs)
    ids = {}
    for d, x in docs:
        ids.setdefault(d, []).append(np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], np.uint32))
    covered, sequences = Counter(), {}
    for p in pieces:
        assert any(len(i) == p["doc_tokens"] and zlib.crc32(i[p["start"] : p["start"] + p["length"]].astype("<u4").tobytes()) == p["ids_crc32"] for i in ids[p["doc_id"]])
        covered[(p["doc_id"], p["doc_tokens"])] += p["length"]
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert covered == Counter({k: k[1] * n for k, n in want.items()})
    short = 0
    for spans in sequences.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at and n > 0
            at += n
        assert at <= window
        short += at != window and at & (at - 1) != 0
    assert short == 0


def test_packing_covers_every_id(spark, odd, empty):
    docs = [(i, prose(i, 20 + 37 * (i % 40))) for i in range(120)] + ODD + [(200, "it's <|endoftext|> ΑΣ we'll\x1cgo ² İ 日本")]
    check_packing(docs, packing.pack(frame(spark, docs), shard_tokens=20_000).collect())
    check_packing(ODD, packing.pack(odd).collect())
    assert packing.pack(empty).count() == 0
    large = [(9007199254740993, "a b"), (None, "c d e"), (9007199254740993, "a b"), (-1, "")]
    check_packing(large, packing.pack(frame(spark, large)).collect())


def test_encoder_equals_the_tokenizer():
    e = packing.Encoder(packing.tokenizer_path())
    texts = ["It's 'S don'ts we'll a_b 12² Ⅷ ½", "İΣς", "a\x1cb", "<|startoftext|>x", "naïve – “q” ﬁ ǅ 日本 🎉", "º ª µ ß ẞ", "\x00\x01\x0b", "'' 's's", ""]
    for t, got in zip(texts, e.encode(texts)):
        assert np.frombuffer(got, np.uint16).tolist() == [*e.tokenizer.encode(t, add_special_tokens=False).ids, 2]


def brute_pack(docs, idf, mean, window):
    """The greedy rule, spelled out: BM25 of every unused document for the seed's distinct ids."""
    import math

    def bm25(seed, other):
        total = 0.0
        for t in set(docs[seed].tolist()):
            tf = int((docs[other] == t).sum())
            if tf:
                total += idf[t] * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len(docs[other]) / mean))
        return total

    order = sorted(range(len(docs)), key=lambda j: (-len(docs[j]), j))
    unused, windows = list(range(len(docs))), []
    carry = None
    while carry or unused:
        if carry is None:
            seed = next(j for j in order if j in unused)
            unused.remove(seed)
            carry = (seed, 0)
        seed, start = carry
        carry, room, own = None, window, []
        queue = [(seed, start)]
        if len(docs[seed]) - start < window:
            queue += [(j, 0) for j in sorted(unused, key=lambda j: (-bm25(seed, j), j))]
        for j, at in queue:
            if not room:
                break
            take = min(room, len(docs[j]) - at)
            own.append((j, at, take))
            room -= take
            if j in unused:
                unused.remove(j)
            if at + take < len(docs[j]):
                carry = (j, at + take)
        windows.append(own)
        assert math.isclose(sum(t for *_, t in own), window) or not (carry or unused)
    return windows


def test_packing_fills_windows_by_the_greedy_rule():
    rng = np.random.default_rng(6)
    for trial in range(5):
        docs = [rng.integers(0, 40, rng.integers(1, 90)).astype(np.uint16) for _ in range(25)]
        df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=50)
        idf = np.log1p((25 - df + 0.5) / (df + 0.5))
        mean = float(np.mean([len(d) for d in docs]))
        got = {}
        for d, start, n, seq, _ in packing.pack_shard(docs, idf, mean, 64):
            got.setdefault(seq, []).append((d, start, n))
        want = brute_pack(docs, idf, mean, 64)
        assert [got[k] for k in range(len(want) - 1)] == want[:-1]
        assert sum(n for k in got if k >= len(want) - 1 for *_, n in got[k]) == sum(n for *_, n in want[-1])


def test_like_documents_share_a_shard(spark):
    """Four kinds of text: with a shard a kind, neighbours are mostly in one's own shard."""
    rng = random.Random(7)
    kinds = [[f"{c}{rng.randrange(400)}" for _ in range(60)] for c in ("river", "engine", "garden", "music")]
    docs = [(i, " ".join(rng.choices(kinds[i % 4], k=60))) for i in range(400)]
    pieces = packing.pack(frame(spark, docs), shard_tokens=len(docs) * 150 // 4, routing_docs=400).collect()
    check_packing(docs, pieces)
    mates = {}
    for p in pieces:
        mates.setdefault(p["sequence_id"], []).append(p["doc_id"] % 4)
    same = sum(max(Counter(k).values()) for k in mates.values()) / sum(map(len, mates.values()))
    assert same > 0.8


def test_bm25_matches_the_formula():
    docs = [np.array(x, np.uint16) for x in ([1, 1, 2, 9], [1, 3, 9], [2, 2, 2], [5])]
    idf = np.zeros(1 << 16, np.float32)
    idf[[1, 2, 3, 5]] = [0.7, 1.1, 1.5, 2.0]
    index = packing.ShardIndex(docs, idf, 2.75)
    for s, seed in enumerate(docs):
        for j, d in enumerate(docs):
            want = sum(float(idf[t]) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / 2.75)) for t in set(seed.tolist()) if (tf := int((d == t).sum())))
            assert index.scores(s)[j] == pytest.approx(want, rel=1e-5)


def test_neighbours_fill_the_window_first():
    a, b = list(range(100, 160)), list(range(300, 360))
    docs = [np.array(x, np.uint16) for x in (a + a[:5], a[:40], b + b[:3], b[:40])]
    pieces = packing.pack_shard(docs, np.ones(1 << 16, np.float32), 50.0, window=105)
    first = [p[0] for p in pieces if p[3] == 0]
    assert first[:2] == [0, 1]


# ------------------------------------------------------------------ media


@pytest.mark.parametrize("n", [1, 575, 576, 577, 576 * 9, 300_000])
def test_matroska_round_trip(n):
    payload = matroska.pad(random.Random(n).randbytes(n))
    data = matroska.mux(payload)
    media = matroska.demux(data)
    assert matroska.payload_of(data, media) == payload
    assert [c[2] for c in media.cues] == media.cluster_at
    assert [p.timestamp_ms for p in media.packets] == [12 * k for k in range(len(payload) // 576)]
    assert media.tracks == [matroska.Track(number=1, codec="A_PCM/INT/LIT", rate=48000.0, bits=8, channels=1, frame_ns=12_000_000)]
    assert matroska.seek(media, 10**9) == media.cluster_at[-1]


@pytest.mark.parametrize("kind", [matroska.XIPH, matroska.EBML_LACE])
def test_uneven_lacing(kind):
    frames = [bytes([k]) * n for k, n in enumerate([1, 254, 255, 256, 600, 3, 70_000, 2])]
    head = matroska.element(matroska.EBML, matroska.element(matroska.DOC_TYPE, b"matroska"))
    cluster = matroska.uint(matroska.TIMESTAMP, 40) + matroska.element(0xEC, b"void") + matroska.block(frames, 5, kind)
    unknown = matroska.SEGMENT.to_bytes(4, "big") + b"\xff" + matroska.CLUSTER.to_bytes(4, "big") + b"\xff" + cluster
    for data in (head + matroska.element(matroska.SEGMENT, matroska.element(matroska.CLUSTER, cluster)), head + unknown):
        media = matroska.demux(data)
        assert [data[p.offset : p.offset + p.size] for p in media.packets] == frames
        assert media.packets[0].timestamp_ms == 45


def test_times_of_a_file_made_by_hand():
    """Scale 10 ms; a laced track with a default duration, a PCM track without, one of neither."""
    m = matroska
    head = m.element(m.EBML, m.element(m.DOC_TYPE, b"matroska"))
    info = m.element(m.INFO, m.uint(m.TIMESTAMP_SCALE, 10_000_000) + m.element(m.DURATION, b"\x41\x20\x00\x00"))
    pcm = m.element(m.AUDIO, m.element(m.SAMPLING_FREQUENCY, b"\x45\xfa\x00\x00") + m.uint(m.CHANNELS, 2) + m.uint(m.BIT_DEPTH, 16))
    entries = [
        m.uint(m.TRACK_NUMBER, 1) + m.uint(m.DEFAULT_DURATION, 40_000_000) + m.element(m.CODEC_ID, b"V_X"),
        m.uint(m.TRACK_NUMBER, 2) + m.element(m.CODEC_ID, b"A_PCM/INT/LIT") + pcm,
        m.uint(m.TRACK_NUMBER, 3) + m.element(m.CODEC_ID, b"S_TEXT"),
    ]
    tracks = m.element(m.TRACKS, b"".join(m.element(m.TRACK_ENTRY, e) for e in entries))
    group = lambda body, more=b"": m.element(m.BLOCK_GROUP, m.element(m.BLOCK, body) + more)
    laced = b"\x81\x00\x05\x04\x01" + b"ab" + b"cd"  # track 1, relative 5, fixed lacing, two frames
    sound = b"\x82\xff\xff\x04\x01" + b"x" * 32 + b"y" * 32  # track 2, relative -1
    plain = b"\x83\x00\x02\x00" + b"z"
    cluster = m.element(m.CLUSTER, m.uint(m.TIMESTAMP, 10) + m.element(m.SIMPLE_BLOCK, laced) + group(sound, m.element(m.REFERENCE_BLOCK, b"\x01")) + group(plain))
    cues = m.element(m.CUES, m.element(m.CUE_POINT, m.uint(m.CUE_TIME, 10) + m.element(m.CUE_TRACK_POSITIONS, m.uint(m.CUE_TRACK, 1) + m.uint(m.CUE_CLUSTER_POSITION, 0))))
    got = m.demux(head + m.element(m.SEGMENT, cluster + info + tracks + cues))
    assert [(p.track, p.timestamp_ns, p.lace, p.keyframe) for p in got.packets] == [
        (1, 150_000_000, 0, False), (1, 190_000_000, 1, False), (2, 90_000_000, 0, False), (2, 91_000_000, 1, False), (3, 120_000_000, 0, True),
    ]
    assert got.cues == [(100, 1, 0)] and got.duration_ms == 100.0 and m.seek(got, 99) is None and m.seek(got, 100) == 0


def brute_feature(text):
    """The feature string from the text alone, by counting frames and blocks."""
    raw = (text or "").encode()
    raw += b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
    frames = len(raw) // 576
    per_cluster = [min(512, frames - c) for c in range(0, frames, 512)]
    blocks = [[min(8, n - b) for b in range(0, n, 8)] for n in per_cluster]
    kinds = [0, 0, 0, 0]
    for cluster in blocks:
        for k, n in enumerate(cluster):
            kinds[0 if n == 1 else (2, 1, 3)[k % 3]] += 1
    turns = sum((a >= 128) != (b >= 128) for a, b in zip(raw, raw[1:]))
    return (
        f"tracks=1;clusters={len(per_cluster)};blocks={sum(kinds)};packets={frames};laced={'/'.join(map(str, kinds))};cues={len(per_cluster)};cues_exact=1;"
        f"duration_ms={frames * 12};last_ms={(frames - 1) * 12};sample_sum={sum(raw)};peak={max(raw)};crossings={turns}"
    )


def test_features_match_brute_force(spark, odd):
    texts = {}
    for d, t in [*ODD, (30, "é" * 400_000)]:
        texts.setdefault(d, t)
    rows = matroska.media_features(matroska.store(frame(spark, [*ODD, (30, texts[30])]))).collect()
    for r in rows:
        assert r["feature"] == brute_feature(texts[r["doc_id"]])
    stored = {r["doc_id"]: bytes(r["media"]) for r in matroska.store(odd).collect()}
    assert all(hashlib.sha256(stored[r["doc_id"]]).hexdigest() == r["media_sha256"] for r in rows if r["doc_id"] in stored and r["doc_id"] != 9)


def test_foreign_bytes_are_refused():
    data = matroska.mux(matroska.pad(b"x"))
    for bad in (b"RIFF" + data, data[:-1], data[:60]):
        with pytest.raises(ValueError):
            matroska.demux(bad)


def test_media_column(spark, odd, empty):
    rows = matroska.media_features(matroska.store(odd)).collect()
    assert len(rows) == len(ODD)
    texts = {}
    for d, t in ODD:
        texts.setdefault(d, (t or "").encode())
    for r in rows:
        payload = matroska.pad(texts[r["doc_id"]])
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert r["n_bytes"] == len(texts[r["doc_id"]]) and r["payload_bytes"] == len(payload) and r["media_bytes"] > len(payload)
    n = matroska.packets(matroska.store(odd)).count()
    assert n == sum(r["payload_bytes"] for r in rows) // 576
    assert matroska.media_features(matroska.store(empty)).count() == 0


# ------------------------------------------------------------------ learned operators


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for d in range(700):
        words = prose(d, 40).split()
        good, toxic = d % 5 != 0, d % 7 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["zorgling", "zorgmar", "idiot"]))
        if not good:
            words = [w + "%%%" for w in words]
        docs.append((d, " ".join(words)))
        labels.append((d, int(good), int(toxic)))
    labels += [(None, 1, 1), (10_000, 1, 1), (3, None, None)]
    return frame(spark, docs + [(i + 5000 if i else i, t) for i, t in ODD]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


@pytest.mark.parametrize("label", ["quality", "toxic"])
def test_classifiers_learn_and_score_all(labelled, empty, label):
    docs, labels, rows = labelled
    op = quality if label == "quality" else toxicity

    def run(d, lab):
        return op.score(d, *op.train(d, lab)) if op is quality else op.score(d, op.train(d, lab))

    got = {}
    for r in run(docs, labels).collect():
        assert 0 <= r["score"] <= 1
        got.setdefault(r["doc_id"], set()).add(r["score"])
    assert all(len(s) == 1 for s in got.values()) and len(got) == 700 + 10
    truth = {d: (q if label == "quality" else t) for d, q, t in rows if d is not None and d < 700 and q is not None}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % op.FOLDS == op.HELD_OUT]
    right = sum((min(got[d]) >= 0.3) == bool(truth[d]) for d in held)
    assert right / len(held) > 0.95
    assert run(empty, labels).count() == 0
    none = run(docs, labels.limit(0)).collect()
    assert len({r["score"] for r in none}) == 1


def test_held_out_labels_are_not_read(labelled):
    docs, labels, _ = labelled
    from pyspark.sql import functions as F

    from cladeloom.llm.labelled import fold, training_sample

    flipped = labels.withColumn("toxic", F.when(fold(F.col("doc_id"), 4) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, training_sample(docs, x, "toxic", 4, 2, 300).select("id", "y").collect())) for x in (labels, flipped))
    assert a == b and len(a) >= 299


def test_grammar_marks_context():
    m = toxicity.Machine({"zorg*": 3.0})
    clause = lambda s: m.clause(toxicity._WORD.findall(s.lower()))
    run = lambda s: m.grammar.run([m.entry(w)[0] for w in s.split()])[0]
    assert run("you are an idiot")[-1] == "I!@" and clause("you are an idiot") == ("aimed", 2.0)
    assert clause("not an idiot") == ("denied", -1.0) and clause("report said the idiot") == ("reported", 0.0)
    assert clause("plain zorgling")[0] == "insult" and clause("plain zorgling")[1] == 4.0
    assert clause("worthless idiot") == ("insult", 2.5)  # fixed insults count without learned ones
    assert clause("i will kill you") == ("threat", 1.0) and clause("you they kill")[0] == "threat"
    assert clause("he said they would kill you")[0] == "reported" and clause("never kill")[0] == "denied"
    assert clause("machines crush stones") == ("verb", 0.0) and clause("all fine here") == (None, 0.0)
    assert m.figures(b"all fine here").sum() == 0 and m.figures(b"").sum() == 0


def test_composed_machine_is_sequential_application():
    """Over random clauses, and over every clause of whole documents, the five applied in turn."""
    steps, both = toxicity.parts(), toxicity.grammar()
    assert len(steps) == 5

    def in_turn(symbols):
        total = 0.0
        for t in steps:
            symbols, w = t.run(symbols)
            total += w
        return symbols, total

    rng = random.Random(4)
    for _ in range(2000):
        s = [rng.choice("INTOVR") for _ in range(rng.randrange(15))]
        assert both.run(s) == in_turn(s)
    m = toxicity.Machine({"g*": 2.0, "ba1": 4.0})
    words = ["not", "said", "you", "kill", "idiot", "ba1", "go", "of", "they", "never", "scum"]
    for k in range(30):
        text = "".join(f"{rng.choice(words)}{rng.choice([' ', ' ', ' ', '. ', chr(10), '; '])}" for _ in range(120))
        out, best, n, live = dict.fromkeys(toxicity.KINDS, 0.0), 0.0, 0, 0.0
        for clause in toxicity._BREAK.split(text):
            entries = [m.entry(w) for w in toxicity._WORD.findall(clause)]
            marked, total = in_turn([k for k, _ in entries])
            kind = toxicity.kind_of(marked)
            if kind:
                total += sum(w for _, w in entries)
                out[kind] += max(total, 0.0)
                best, n, live = max(best, total), n + 1, max(live, float(kind in ("threat", "aimed", "insult")))
        want = [*(np.log1p(x) for x in out.values()), np.log1p(best), np.log1p(n), live, np.log1p(100 * n / len(text.split()))]
        assert np.allclose(m.figures(text.encode()), want)


def test_long_text_and_ties_score_alike(spark, labelled):
    docs, labels, _ = labelled
    model = toxicity.train(docs, labels)
    text = ("calm words here. " * 40_000) + "you zorgling idiot"
    got = [r["score"] for r in toxicity.score(frame(spark, [(1, text), (2, text), (1, text), (3, "calm words here. " * 40_000)]), model).collect()]
    assert len(set(got)) == 2 and max(got) == sorted(got)[1]


def test_temperature_and_network():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 8))
    y = ((x[:, 0] * x[:, 1]) > 0).astype(float)
    net = quality.fit(x, y, epochs=150)
    assert ((net.probability(x) >= 0.5) == y).mean() > 0.9 and 0.1 < net.temperature < 8
    assert quality.fit(x, np.ones(600)).probability(x[:3]).min() > 0.99


def test_word_vectors_bring_neighbours_together():
    b, index = quality.Buckets(), quality.index_vectors()
    table = np.zeros((quality.BUCKETS, quality.DIM), np.float32)
    for s in (b"the red cat sat", b"the red dog sat", b"a b c d e") * 5:
        quality.add_contexts(quality.token_ids(s, b), index, table)
    cos = lambda p, q: float(table[b[p]] @ table[b[q]] / (np.linalg.norm(table[b[p]]) * np.linalg.norm(table[b[q]])))
    assert cos(b"cat", b"dog") > 0.9 > cos(b"cat", b"c")


# ------------------------------------------------------------------ language model


def brute_base(rows):
    import math

    toks = [[*(t or "").encode().lower().split(), b" "] for _, t in rows]
    c = Counter(w for (d, _), ws in zip(rows, toks) if d is None or zlib.crc32(str(d).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted((repr(d), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for (d, _), ws in zip(rows, toks))


@pytest.mark.parametrize("most", [1 << 19, 40])
def test_language_model_base_and_gain(spark, empty, most):
    rows = [(i, " ".join(f"{'abcdef'[i % 6]}{(i + k) % 9} then b{k % 4}" for k in range(30))) for i in range(60)] + [(i and i + 1000, t) for i, t in ODD]
    got = language_model.score(frame(spark, rows), most=most).collect()
    assert sorted((repr(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == brute_base(rows)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 60 and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 and r["n_tokens"] > 60]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    alike = [{round(r["score"], 9) for r in got if r["doc_id"] in ids} for ids in ((1005, 1006, 1009), (1001, 1002, 1003))]
    assert [len(x) for x in alike] == [1, 1] and max(r["score"] for r in got) < 0
    assert language_model.score(empty).count() == 0


def test_untrained_language_model(spark):
    rows = [(i, "a b") for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2][:5]
    for r in language_model.score(frame(spark, rows)).collect():
        assert r["base_score"] == 0 and r["train_tokens"] == 0 and r["n_known"] == 0
        assert abs(r["score"]) < 1e-6


def spelled(text, encoder=packing.Encoder(packing.tokenizer_path())):
    """Per word its pieces, the longest first; the end token last."""
    vocabulary, out = encoder.tokenizer.get_vocab(with_added_tokens=False), []
    for w in (text or "").encode().lower().split():
        letters, own = "".join(encoder.letters[b] for b in w), []
        while letters:
            k = next(k for k in range(len(letters), 0, -1) if letters[:k] + "</w>" * (k == len(letters)) in vocabulary)
            own.append(vocabulary[letters[:k] + "</w>" * (k == len(letters))])
            letters = letters[k:]
        out.append((w, tuple(own)))
    return [*out, (b" ", (encoder.tokenizer.get_vocab_size(),))]


def steps(text):
    """``(kind, context, piece)`` of every piece."""
    words = spelled(text)
    out = []
    for (before, _), (_, pieces) in zip([words[-1], *words], words):
        out.append((0, before, pieces[0]))
        out += [(1, pieces[:k], pieces[k]) for k in range(1, len(pieces))]
    return out


class Restaurants:
    """Brute force: every customer sits at a table; one is taken out and seated again at a time."""

    def __init__(self, customers, size, d, rng):
        self.size, self.d, self.d0, self.rng, self.theta, self.theta0 = size, d, 0.5, rng, 1.0, 1.0
        self.rooms, self.root, self.customers = {}, {}, customers
        for u, w in customers:
            self.sit(u, w)

    def parent(self, w):
        tables, people = sum(map(len, self.root.values())), sum(map(sum, self.root.values()))
        own = self.root.get(w, [])
        return (sum(own) - self.d0 * len(own) + (self.theta0 + self.d0 * tables) / self.size) / (self.theta0 + people)

    def probability(self, u, w):
        room = self.rooms.get(u, {})
        tables, people = sum(map(len, room.values())), sum(map(sum, room.values()))
        own = room.get(w, [])
        return (sum(own) - self.d * len(own) + (self.theta + self.d * tables) * self.parent(w)) / (self.theta + people)

    def _pick(self, own, d, fresh):
        weights = [n - d for n in own] + [fresh]
        return self.rng.choices(range(len(weights)), weights)[0]

    def sit(self, u, w):
        room = self.rooms.setdefault(u, {})
        own = room.setdefault(w, [])
        k = self._pick(own, self.d, (self.theta + self.d * sum(map(len, room.values()))) * self.parent(w))
        if k < len(own):
            own[k] += 1
            return
        own.append(1)
        up = self.root.setdefault(w, [])
        k = self._pick(up, self.d0, (self.theta0 + self.d0 * sum(map(len, self.root.values()))) / self.size)
        if k < len(up):
            up[k] += 1
        else:
            up.append(1)

    def leave(self, u, w):
        own = self.rooms[u][w]
        k = self.rng.choices(range(len(own)), own)[0]
        own[k] -= 1
        if not own[k]:
            del own[k]
            up = self.root[w]
            k = self.rng.choices(range(len(up)), up)[0]
            up[k] -= 1
            if not up[k]:
                del up[k]

    def sweep(self):
        for u, w in self.customers:
            self.leave(u, w)
            self.sit(u, w)


def test_language_model_against_single_customers(spark):
    """Held-out probability of texts of known words against chains that move one customer at a time."""
    rng = random.Random(1)
    rows = [(i, " ".join(f"{rng.choice('abc')}{rng.choice('xyz')}q{rng.choice('vw')} {rng.choice(['then', 'so', 'q'])}" for _ in range(25))) for i in range(40)]
    got = {r["doc_id"]: r["score"] for r in language_model.score(frame(spark, rows), burn_in=6, samples=10).collect()}
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    every = [s for i, t in rows if i not in held for s in steps(t)]
    size = spelled("")[0][1][0] + 1
    chains = []
    for kind in (0, 1):
        customers = [(u, w) for k, u, w in every if k == kind]
        n1, n2 = (sum(c == k for c in Counter(customers).values()) for k in (1, 2))
        chains.append(Restaurants(customers, size, language_model.discount(n1, n2), random.Random(2)))
    asked = [(i, s) for i, t in rows if i in held for s in steps(t)]
    assert {(k, u) for _, (k, u, _) in asked} <= {(k, u) for k, u, _ in every} and any(k for _, (k, *_) in asked)
    p = np.zeros(len(asked))
    for sweep in range(12):
        for chain in chains:
            chain.sweep()
        if sweep >= 4:
            p += [chains[k].probability(u, w) / 8 for _, (k, u, w) in asked]
    assert abs(sum(got[i] for i in held) - np.log10(p).sum()) / len(asked) < 0.02


def test_tokens_and_places_against_direct_ones():
    rng = random.Random(1)
    for _ in range(200):
        raws = [bytes(rng.choice(b" \t\n\x0b\x0c\rABZaz[@\xc3\x1c\x85\x00") for _ in range(rng.choice([0, 0, 1, 5, 30]))) for _ in range(rng.choice([0, 1, 2, 7]))]
        words, tokens, n = language_model.tokenized(pa.array([b"xx y", *raws, b"z"], pa.binary()).slice(1, len(raws)))
        want = [language_model.tokens_of(raw) for raw in raws]
        assert [words[j] for j in tokens] == [w for ws in want for w in ws] and n.tolist() == [len(ws) for ws in want]
        assert len(set(words)) == len(words)
    keys = np.sort(np.random.default_rng(0).integers(0, 1 << 64, 5000, dtype=np.uint64))
    find = language_model.finder(keys)
    assert (find(keys) == np.arange(5000)).all() and (find(keys + np.uint64(1)) == -1).all() and not len(find(keys[:0]))
    assert (language_model.finder(keys[:0])(keys) == -1).all()


def test_slices_hold_all_rows(monkeypatch):
    monkeypatch.setattr(language_model, "SLICE_ROWS", 3)
    monkeypatch.setattr(language_model, "SLICE_BYTES", 10)
    texts = [b"x" * n for n in (0, 0, 0, 0, 25, 1, 10, 9, 1, 1, 0)]
    parts = [p.column(0).to_pylist() for p in language_model.slices(pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"]), 0)]
    assert [t for p in parts for t in p] == texts and all(len(p) == 1 or (len(p) <= 3 and sum(map(len, p)) <= 10) for p in parts)


def test_probabilities_of_a_bucket_sum_to_one():
    """All known pieces of a context and all ways to leave them."""
    rng = np.random.default_rng(0)
    size, pieces = 50, language_model.PIECES
    context = np.array([2, 3, 8, 9], np.uint64)
    dish = [np.sort(rng.choice(size - 10, 5, replace=False)) for _ in context]
    pairs = language_model.Pairs(0, context, np.array([5] * 4), np.concatenate(dish), rng.integers(1, 9, 20))
    base = np.zeros((2, pieces))
    base[:, :size] = rng.dirichlet(np.ones(size), 2)
    served = np.zeros((2, pieces), bool)
    served[:, : size - 10] = True
    model = language_model.Model([language_model.Sweep(k, (0.6, 0.7), (1.0, 2.0), base, base) for k in range(4)], 1, served)
    for k, sweep in enumerate(model.sweeps):
        pairs.sweep(sweep, k > 1)
    assert len(pairs.draws) == 3 and sum(x.sum() for x in pairs.draws) > 0

    def ask(c, p):
        return 10 ** model.log_probability(pairs, np.array([c] * len(p), np.uint64), np.array(p))

    for c, own in zip(context.tolist(), dish):
        if c % 2:  # beginnings: known pieces, and one way to part
            other = [p for p in range(size) if p not in own]
            assert ask(c, own).sum() + ask(c, other)[0] == pytest.approx(1) and np.allclose(ask(c, other), ask(c, other)[0])
        else:  # words: pieces that training has, and all others together
            assert ask(c, list(range(size - 10))).sum() + ask(c, [size - 1])[0] == pytest.approx(1)
    assert ask(4, list(range(size - 10))).sum() + ask(4, [size - 1])[0] == pytest.approx(1)
    assert (ask(5, [1, 2]) == 1).all()  # after an unknown beginning nothing counts


def stirling(c, d):
    """log of the generalised Stirling numbers of c, by their recursion."""
    row = {1: 0.0}
    for n in range(1, c):
        new = {}
        for t in range(1, n + 2):
            parts = [row[k] + w for k, w in ((t - 1, 0.0), (t, np.log(max(n - d * t, 1e-300)))) if k in row]
            new[t] = float(np.logaddexp.reduce(parts))
        row = new
    return row


@pytest.mark.parametrize("c,d,x", [(2, 0.5, 0.3), (10, 0.5, 0.8), (50, 0.7, 0.05), (200, 0.5, 0.8), (200, 0.8, 0.05), (200, 0.8, 30.0), (1500, 0.6, 3.0), (1500, 0.8, 200.0)])
def test_tables_follow_the_exact_law(c, d, x):
    log = {t: v + t * np.log(x) for t, v in stirling(c, d).items()}
    p = np.exp(np.array(list(log.values())) - max(log.values()))
    p /= p.sum()
    t = np.arange(1, c + 1)
    mean, sd = float(p @ t), float(np.sqrt(p @ t**2 - (p @ t) ** 2))
    got = language_model.Seats(d).draw(np.full(20_000, c), np.full(20_000, x), np.random.default_rng(3))
    assert abs(got.mean() - mean) < 5 * sd / np.sqrt(20_000) + 0.004 * mean * (mean > 150) and got.min() >= 1 and got.max() <= c
    assert abs(got.std() - sd) < 0.05 * sd + 0.01


@pytest.mark.parametrize("d,x", [(0.7, 0.4), (0.7, 40.0), (0.5, 3.0), (0.8, 300.0)])
def test_the_limit_law_beyond_the_exact_numbers(d, x):
    """Against the exact law at the last exact number of customers."""
    c = 3000
    rng = np.random.default_rng(5)
    seats = language_model.Seats(d)
    log = seats.row(c) + np.arange(1, language_model.TABLES + 1) * np.log(x)
    p = np.exp(log - log.max())
    p /= p.sum()
    mean = float(p @ np.arange(1, len(p) + 1))
    assert p[-1] < 1e-9
    got = seats.limit(np.full(20_000, c), np.full(20_000, x), rng)
    assert abs(got.mean() - mean) < 0.06 * mean


def test_seating_of_one_restaurant_is_its_posterior():
    """Tables of three dishes that share a restaurant, against all states of the exact posterior."""
    c, parent, d, strength = [3, 5, 2], [0.2, 0.5, 0.1], 0.6, 1.5
    logs = [stirling(n, d) for n in c]
    rise = lambda n: sum(np.log(strength + d * k) for k in range(n))
    states = {(a, b, e): rise(a + b + e) + logs[0][a] + logs[1][b] + logs[2][e] + a * np.log(parent[0]) + b * np.log(parent[1]) + e * np.log(parent[2]) for a in logs[0] for b in logs[1] for e in logs[2]}
    z = np.logaddexp.reduce(list(states.values()))
    want = np.sum([np.array(s) * np.exp(v - z) for s, v in states.items()], axis=0)
    rng, seats, t, total = np.random.default_rng(1), language_model.Seats(d), np.ones(3), np.zeros(3)
    for k in range(20_500):
        g = rng.gamma(strength / d + t.sum())
        t = seats.draw(np.array(c), d * g * np.array(parent), rng)
        total += t * (k >= 500)
    assert np.allclose(total / 20_000, want, atol=0.03)


def test_log_gamma_and_packed_arrays():
    import math

    x = np.array([0.01, 0.5, 1, 2, 7.9, 30, 1e6])
    assert np.allclose(language_model.log_gamma(x), [math.lgamma(v) for v in x])
    for values in ([], [0], [5, 5, 300, 70_000, 1 << 34], list(range(1000))):
        a = np.array(values, np.int64)
        assert (language_model._unpack(language_model._pack(a)) == a).all()
        assert (language_model._unpack_sorted(language_model._pack_sorted(a)) == a).all()


def test_blocks_give_every_pair_to_one_bucket():
    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 1 << 63, 40, np.uint64) * np.uint64(2) + np.arange(40, dtype=np.uint64) % np.uint64(2)
    keys = rng.integers(0, 40, 10_000) << 16 | rng.integers(0, 30, 10_000) * 1700
    row, weight = np.sort(rng.integers(0, 50, 10_000)), rng.integers(0, 3, 10_000)
    named = [(int(hashes[k >> 16]), k & 0xFFFF) for k in keys.tolist()]
    want, rows = Counter(), Counter(zip(named, row.tolist()))
    for k, w in zip(named, weight.tolist()):
        want[k] += w
    got, met = Counter(), Counter()
    for first, bucket, context, dishes, piece, count, per, who, n in zip(*(c.to_pylist() for c in language_model.asked_rows(100, keys, row, weight, hashes, 7).columns)):
        own = language_model._pairs_of(bucket, context, dishes, piece, count)
        assert first == 100 and (language_model._bucket(own.context, 7) == bucket).all() and (np.diff(own.context.astype(float)) > 0).all()
        names = [(int(own.context[a]), int(p)) for a, p in zip(own.at, own.piece)]
        got.update(dict(zip(names, own.count.tolist())))
        each = [k for k, m in zip(names, language_model._unpack(per)) for _ in range(m)]
        met.update(dict(zip(zip(each, language_model._unpack(who).tolist()), language_model._unpack(n).tolist())))
    assert got == want and met == rows


def test_head_tables_do_not_change_scores(spark):
    """With all words and pairs in tables, with some, and with none."""
    rows = [(i, " ".join(f"{'abcdef'[i % 6]}{(i + k) % 9} then b{k % 4}" for k in range(30))) for i in range(40)] + ODD
    found = []
    for most, most_pairs in ((1 << 18, 1 << 20), (10, 20), (0, 0)):
        got = language_model.score(frame(spark, rows), most=most, most_pairs=most_pairs).collect()
        found.append(sorted((repr(r["doc_id"]), r["n_tokens"], r["n_known"], r["score"], r["base_score"]) for r in got))
    for other in found[1:]:
        for a, b in zip(found[0], other):
            assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], abs=1e-2, rel=1e-5)
