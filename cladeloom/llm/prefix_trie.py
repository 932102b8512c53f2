"""Conversation prefix trie: turn arrays are range-sorted, swept by a stack, and stitched at the seams.

A turn is known by 128 bits of the SHA-256 of its role and text, and a conversation's key is its turns'
digests one after another.  Keys, with the conversation id behind them, are range-sorted over all
partitions; that is the order of a depth-first walk, so a node's members stand side by side.

Each task sweeps its sorted rows: the longest common prefix with the row before says which nodes close
and which open.  Nodes that are a prefix of the task's first or last key may go on in the neighbouring
partition; all others are whole.  Of the open ones a task writes one row: its first and last key and,
for every depth of both, what it has counted.  One more sweep over these rows, one a partition, in
order and with nothing in memory but the open stack, joins them up.  Children of open nodes learn their
parent's id by a join on partition and depth.

Partitions hold about ``partition_turns`` turns.  Sorting by id too splits any number of equal
conversations over partitions.  The list of ids behind ``ends_sha256`` is hashed as it goes by; where it
crosses partitions, the parts are hashed in their order.  A conversation's own turns are one array (28
bytes a turn).

Defined cases: rows without ``conv_id`` belong to no conversation; null role and text are empty; equal
turn numbers go by their content's digest; repeated rows are turns each; a null turn number comes first;
conversations left without turns are members of the root; an empty table has no nodes; texts of any
length are only digested and measured; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read

WIDTH = 16
GROUP = 100
MOST_SHARED = 6
PARTITION_TURNS = 250_000


def digest(role: Column, text: Column) -> Column:
    """128 bits that tell turns apart; the role's length keeps role and text apart."""
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(said.cast("binary"), 256)), 1, WIDTH)


def turn_arrays(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turns)``: digests and code points of a conversation's turns in order."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("t"), digest(role, text).alias("d"), F.char_length(text).cast("long").alias("size")
    )
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("t", "d", "size"))).alias("turns"))


def rebuilt(arrays: DataFrame, group: int = GROUP, most_shared: int = MOST_SHARED) -> DataFrame:
    """``(conv_id, key, sizes)``: the first h turns of the group's first conversation, then its own after h.

    h is the id's CRC-32 modulo ``most_shared``.  At most ``group`` conversations (at 0 also the negative
    ones) share a first one, so the join has no hot key.
    """
    base = F.col("conv_id") - F.col("conv_id") % group
    heads = arrays.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most_shared - 1).alias("head"))
    own = arrays.withColumn("base", base).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most_shared).cast("int"))
    empty = F.slice("turns", 1, 0)
    turns = F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), empty), F.slice("turns", F.col("h") + 1, F.size("turns")))
    out = own.join(heads, "base", "left").select("conv_id", turns.alias("turns"))
    key = F.unhex(F.concat_ws("", F.transform("turns", lambda x: F.hex(x["d"]))))
    return out.select("conv_id", key.alias("key"), F.transform("turns", lambda x: x["size"]).alias("sizes"))


def _common(a: bytes, b: bytes) -> int:
    """Turns that two keys share at their beginning."""
    lo, hi = 0, min(len(a), len(b)) // WIDTH
    while lo < hi:  # the shared part is found by halving; comparing bytes is cheap
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo * WIDTH : mid * WIDTH] == b[lo * WIDTH : mid * WIDTH] else (lo, mid - 1)
    return lo


NOTHING = hashlib.sha256(b"").hexdigest()
NODE, SPINE = 0, 1
_PATH = pa.struct([*((c, pa.list_(pa.int64())) for c in ("count", "least", "children", "leaves", "saved", "sizes")), ("ends", pa.list_(pa.string()))])
_PATH_DDL = "struct<count:array<bigint>,least:array<bigint>,children:array<bigint>,leaves:array<bigint>,saved:array<bigint>,sizes:array<bigint>,ends:array<string>>"
_NODE = [("conv_id", "long"), ("depth", "long"), ("n_convs", "long"), ("n_children", "long"), ("n_leaves", "long"), ("saved_tokens", "long"), ("ends_sha256", "string")]
#: a node (kind 0) with its parent's id, or with the open parent's side and the partition; or a partition's open nodes (kind 1)
_SWEPT = [*_NODE, ("parent_conv_id", "long"), ("part", "int"), ("side", "int"), ("first_key", "binary"), ("last_key", "binary"), ("first", _PATH_DDL), ("last", _PATH_DDL), ("first_ids", "string"), ("last_ids", "string"), ("kind", "int")]
#: a node (kind 0) with its number and its parent's, or which number an open node of a partition has (kind 1)
_STITCHED = [*_NODE, ("number", "long"), ("parent_number", "long"), ("part", "int"), ("side", "int"), ("kind", "int")]
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), _PATH_DDL: _PATH}


def _ddl(columns: list[tuple[str, str]]) -> str:
    return ", ".join(" ".join(c) for c in columns)


def _batch(columns: list[tuple[str, str]], rows: int, given: dict) -> pa.RecordBatch:
    types = [_ARROW[t] for _, t in columns]
    return pa.RecordBatch.from_arrays([pa.array(given[c], t) if c in given else pa.nulls(rows, t) for (c, _), t in zip(columns, types)], names=[c for c, _ in columns])


def sweep(rows: Iterator[tuple[int, bytes, list[int]]], part: int) -> Iterator[pa.RecordBatch]:
    """One partition's nodes from its sorted ``(conv_id, key, sizes)``: the whole ones, then one row of the open ones.

    Nodes stand in the order in which they open, so a parent comes before its children.
    """
    parent, depth, size, count, least, ends = [-1], [0], [0], [0], [0], [None]
    path, before, pending = [0], None, []
    first, first_ids, first_end = b"", "", 0
    for conv, key, sizes in rows:
        if before is None:
            first, first_end, least[0] = key, len(sizes), conv  # the first key's nodes are numbered by depth
        elif key != before:
            ids = ",".join(pending)
            if path[-1] == first_end:
                first_ids = ids
            else:
                ends[path[-1]] = hashlib.sha256(ids.encode()).hexdigest()
            pending = []
        del path[(_common(before, key) if before is not None else 0) + 1 :]
        for d in range(len(path), len(sizes) + 1):
            path.append(len(parent))
            parent.append(path[-2])
            depth.append(d)
            size.append(sizes[d - 1])
            count.append(0)
            least.append(conv)
            ends.append(None)
        count[path[-1]] += 1
        least[path[-1]] = min(least[path[-1]], conv)
        pending.append(str(conv))
        before = key
    if before is None:
        return
    last_ids = ",".join(pending)
    if path[-1] == first_end:
        first_ids, last_ids = last_ids, ""
    n, left = len(parent), list(range(first_end + 1))
    side = np.full(n, -1, np.int32)
    side[path], side[left] = 1, 0  # what both paths share counts as the first one's
    open_node = (side >= 0).tolist()
    children, leaves, saved = [0] * n, [0] * n, [0] * n
    for at in range(n - 1, 0, -1):
        up = parent[at]
        count[up] += count[at]
        least[up] = min(least[up], least[at])
        if not open_node[at]:
            leaves[at] = leaves[at] or 1
            saved[at] += (count[at] - 1) * size[at]
            children[up] += 1
            leaves[up] += leaves[at]
            saved[up] += saved[at]
    whole = [at for at in range(n) if not open_node[at]]
    for lo in range(0, len(whole), 10_000):
        ats = whole[lo : lo + 10_000]
        ups = [parent[at] for at in ats]
        yield _batch(_SWEPT, len(ats), {
            "conv_id": [least[at] for at in ats], "depth": [depth[at] for at in ats], "n_convs": [count[at] for at in ats], "n_children": [children[at] for at in ats],
            "n_leaves": [leaves[at] for at in ats], "saved_tokens": [saved[at] for at in ats], "ends_sha256": [ends[at] or NOTHING for at in ats],
            "parent_conv_id": [None if open_node[up] else least[up] for up in ups], "part": [part] * len(ats), "side": [int(side[up]) if open_node[up] else None for up in ups], "kind": [NODE] * len(ats),
        })

    def told(ats: list[int]) -> dict:
        lists = {"count": count, "least": least, "children": children, "leaves": leaves, "saved": saved, "sizes": size, "ends": ends}
        return {c: [x[at] for at in ats] for c, x in lists.items()}

    right = [at for at in path if side[at] == 1]
    yield _batch(_SWEPT, 1, {"part": [part], "first_key": [first], "last_key": [before], "first": [told(left)], "last": [told(right)], "first_ids": [first_ids], "last_ids": [last_ids], "kind": [SPINE]})


class _Open:
    """A node on the stitching stack."""

    __slots__ = ("number", "digest", "size", "count", "least", "children", "leaves", "saved", "sha", "some", "ended")

    def __init__(self, number: int, digest: bytes, size: int, least: int):
        self.number, self.digest, self.size, self.least = number, digest, size, least
        self.count = self.children = self.leaves = self.saved = 0
        self.sha, self.some, self.ended = None, False, None

    def add(self, path: dict, k: int, ids: str | None) -> None:
        self.count += path["count"][k]
        self.least = min(self.least, path["least"][k])
        self.children += path["children"][k]
        self.leaves += path["leaves"][k]
        self.saved += path["saved"][k]
        self.ended = path["ends"][k] or self.ended
        if ids:
            self.sha = self.sha or hashlib.sha256()
            self.sha.update(("," * self.some + ids).encode())
            self.some = True

    def ends(self) -> str:
        return self.sha.hexdigest() if self.some else self.ended or NOTHING


def stitch(spines: Iterator[dict]) -> Iterator[tuple[int, tuple]]:
    """``(kind, row)`` of the open nodes joined up over all partitions, given in order."""
    stack: list[_Open] = []
    numbers = 0

    def close(depth: int) -> Iterator[tuple[int, tuple]]:
        while len(stack) > depth:
            x = stack.pop()
            leaves, saved = x.leaves if x.children else 1, x.saved + (x.count - 1) * x.size
            if stack:
                up = stack[-1]
                up.children, up.leaves, up.saved = up.children + 1, up.leaves + leaves, up.saved + saved
            yield NODE, (x.least, len(stack), x.count, x.children, leaves, saved, x.ends(), x.number, stack[-1].number if stack else None)

    for row in spines:
        first, last = row["first_key"], row["last_key"]
        held = b"".join(x.digest for x in stack[1:])
        yield from close(_common(held, first) + 1)
        for side, key, path, ids in ((0, first, row["first"], row["first_ids"]), (1, last, row["last"], row["last_ids"])):
            if side:
                yield from close(_common(first, last) + 1)
            n = len(key) // WIDTH + 1
            for k, d in enumerate(range(n - len(path["count"]), n)):
                if d == len(stack):
                    stack.append(_Open(numbers, key[max(0, d - 1) * WIDTH : d * WIDTH], path["sizes"][k], path["least"][k]))
                    numbers += 1
                stack[d].add(path, k, ids if d == n - 1 else None)
                yield SPINE, (d, stack[d].number, row["part"], side)
    yield from close(0)


def trie(conversations: DataFrame, group: int = GROUP, most_shared: int = MOST_SHARED, partition_turns: int = PARTITION_TURNS) -> DataFrame:
    """One row a node; see the module's docstring."""
    spark = conversations.sparkSession
    scratch = Scratch(spark, "trie")
    keys = scratch.table(rebuilt(scratch.table(turn_arrays(conversations), "arrays"), group, most_shared), "keys")
    turns = keys.agg(F.coalesce(F.sum(F.size("sizes") + 1), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // partition_turns))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        yield from sweep(rows, TaskContext.get().partitionId())

    ordered = keys.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id").select("conv_id", "key", "sizes")
    swept = scratch.table(ordered.mapInArrow(walk, _ddl(_SWEPT)), "swept", by="kind")

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])

        def out(kind: int) -> pa.RecordBatch:
            rows = held[kind]
            names = [*(c for c, _ in _NODE), "number", "parent_number"] if kind == NODE else ["depth", "number", "part", "side"]
            got = _batch(_STITCHED, len(rows), dict(zip(names, zip(*rows))) | {"kind": [kind] * len(rows)})
            rows.clear()
            return got

        for kind, row in stitch(row for batch in batches for row in batch.to_pylist()):
            held[kind].append(row)
            if len(held[kind]) == 10_000:
                yield out(kind)
        yield from (out(kind) for kind in (NODE, SPINE) if held[kind])

    spines = swept.filter(F.col("kind") == SPINE).select("part", "first_key", "last_key", "first", "last", "first_ids", "last_ids")
    stitched = scratch.table(spines.repartition(1).sortWithinPartitions("part").mapInArrow(join_up, _ddl(_STITCHED)), "stitched", by="kind")
    open_nodes = stitched.filter(F.col("kind") == NODE)
    names = [c for c, _ in _NODE]
    ups = open_nodes.select(F.col("number").alias("parent_number"), F.col("conv_id").alias("parent_conv_id"))
    at = stitched.filter(F.col("kind") == SPINE).select("part", "side", F.col("depth").alias("up"), F.col("number").alias("parent_number")).join(ups, "parent_number")
    whole = swept.filter(F.col("kind") == NODE)
    below = whole.filter(F.col("side").isNotNull()).drop("parent_conv_id").withColumn("up", F.col("depth") - 1).join(at, ["part", "side", "up"])
    columns = [*names, "parent_conv_id"]
    out = whole.filter(F.col("side").isNull()).select(columns).union(below.select(columns)).union(open_nodes.join(ups, "parent_number", "left").select(columns))
    return scratch.close(out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(read(spark, sf_dir, "conversations"))


SQL = """
WITH own AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), hashed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ord(s)::BIGINT)),
                            lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
                                                     lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)),
                4294967295) % 6 AS h
  FROM own
), built AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns
  FROM hashed c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100
), steps AS (
  SELECT conv_id, turns, list_transform(turns, lambda x: sha256(concat(length(x.r)::VARCHAR, ':', x.r, x.t))) AS k, len(turns) AS n FROM built
), members AS (
  SELECT conv_id, d, array_to_string(k[1:d], '') AS p, CASE WHEN d > 1 THEN array_to_string(k[1:d - 1], '') ELSE '' END AS up, n = d AS ends,
         CASE WHEN d > 0 THEN length(turns[d].t) ELSE 0 END AS size
  FROM (SELECT *, unnest(range(0, n + 1)) AS d FROM steps)
), nodes AS (
  SELECT d, p, up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS own_saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM members GROUP BY d, p, up
), kids AS (
  SELECT d - 1 AS d, up AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL
), below AS (
  SELECT x.d, substr(n.p, 1, x.d * 64) AS p, sum(CASE WHEN k.n_children IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum(n.own_saved)::BIGINT AS saved_tokens
  FROM nodes n LEFT JOIN kids k ON k.d = n.d AND k.p = n.p, LATERAL (SELECT unnest(range(0, n.d + 1)) AS d) x
  GROUP BY ALL
)
SELECT n.conv_id, n.d::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children,
       b.n_leaves, b.saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.d = n.d AND b.p = n.p
LEFT JOIN kids k ON k.d = n.d AND k.p = n.p
LEFT JOIN nodes u ON u.d = n.d - 1 AND u.p = n.up
"""
