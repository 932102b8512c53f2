"""The conversation trie against one built directly."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from cladeloom.llm import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _brute(rows: list[tuple]) -> list[tuple]:
    own: dict = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t, key=lambda x: x[:2])] for c, t in own.items()}
    built = {c: own.get(c - c % 100, [])[: (h := zlib.crc32(str(c).encode()) % 6)] + t[h:] for c, t in own.items()}
    nodes: dict = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = {k: [v for v in nodes if len(v) == len(k) + 1 and v[: len(k)] == k] for k in nodes}

    def below(k: tuple) -> tuple[int, int]:
        got = [below(v) for v in kids[k]]
        return sum(g[0] for g in got) or 1, sum(g[1] for g in got) + (len(nodes[k]) - 1) * (len(k[-1][1]) if k else 0)

    out = []
    for k, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if tuple(built[c]) == k)))
        leaves, saved = below(k)
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(kids[k]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def _rows(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for c in rng.sample(range(1000), n):
        for t in range(rng.randrange(7)):
            out.append((c, t or rng.choice([0, None]), rng.choice(["user", "bot", None]), rng.choice(["a", "é", "", None, "long text"]) if t else "hello"))
    out += [(c, t, "user", "copy") for c in range(2000, 2040) for t in range(3)]  # one conversation many times
    out += [(500, t, "u", "ab") for t in range(20, 60)]
    out += [(None, 1, "user", "no id"), (7, 3, "user", "hello"), (1100, 0, "user", "only"), (-5, 1, "bot", "less")]
    rng.shuffle(out)
    return list({(r[0], r[1]): r for r in out}.values())


@pytest.mark.parametrize("partitions", [1, 4, 23])
def test_against_a_trie_built_directly(spark, partitions):
    rows = _rows(partitions, 150)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth long, key string")
        got = prefix_trie.trie(df).select(COLUMNS).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((tuple(r) for r in got), key=repr) == _brute(rows)


def test_equal_conversations_over_many_partitions(spark):
    """All members end at one node, whose ids are hashed in order over partitions."""
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        df = spark.range(1, 1000).selectExpr("id * 100 AS conv_id", "0L AS turn", "'user' AS role", "'same' AS text")
        rows = prefix_trie.trie(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    ids = [c * 100 for c in range(1, 1000)]
    top, hello = sorted(rows, key=lambda r: r["depth"])
    assert (top["n_convs"], top["n_children"], top["saved_tokens"]) == (999, 1, 998 * 4)
    assert hello["ends_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_empty_and_turnless(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.trie(spark.createDataFrame([], schema)).count() == 0
    # crc32("12") % 6 is more than one, so conversation 12 has no turn of its own left and its group has no first one
    one = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = prefix_trie.trie(spark.createDataFrame([(one, 0, "user", "gone")], schema)).collect()
    assert [(r["conv_id"], r["depth"], r["n_convs"], r["n_children"], r["n_leaves"]) for r in rows] == [(one, 0, 1, 0, 1)]
