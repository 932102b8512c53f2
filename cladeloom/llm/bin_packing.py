"""Best-fit packing by a grouping genetic algorithm, distributed as islands with elite migration.

Texts become token ids; a document longer than a window is cut into whole windows, which are sequences
of their own, and a rest.  Only places and lengths of pieces are written, no ids.  Pieces are dealt by
row over shards of about ``shard_pieces`` pieces (and no fewer than ``shard_bins`` windows of tokens),
so the largest group is bounded and the number of shards grows with the corpus.

In a shard an individual is a packing: the bin of every piece.  Each of ``islands`` islands is a task
with its own population, begun by best fit over lengths that are sorted with a little noise.  Crossover
injects whole well-filled bins of one parent into the other, drops the bins that now hold duplicates,
and best-fits the displaced pieces, longest first, into what is left open; the emptiest bins are opened
too.  Fitness is the number of bins, then how unevenly they are filled.  After each epoch an island's
elite moves to the next island.  A population rests once it reaches the lower bound.

Shards lose up to a window each at their end, so the emptiest bins of a shard (those filled less than
15/16, at most one in 32, at least one) give their pieces back, and these are packed anew in
correspondingly fewer shards, until one shard holds them all.  Every level is one job.

Defined cases: null and empty texts are the end id alone; repeated rows are packed each; rows with a
null id too; equal lengths go by row; an empty table gives no pieces; a document of any length is cut;
ids of any type come back as they are; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read, spread
from .packing import _encoder, tokenizer_path

WINDOW = 4096
END_ID = 1
SHARD_PIECES = 4096
SHARD_BINS = 64
ISLANDS = 3
EPOCHS = 3
OFFSPRING = 12
POPULATION = 6
ELITE = 2
NOISE = 0.1


def cut_pieces(docs: DataFrame, id_col: str, text_col: str, window: int, end_id: int, tokenizer: str | None) -> DataFrame:
    """``(row, id, piece, start, length, ids_crc32)``; ``row`` tells the pieces apart."""
    kind = docs.schema[id_col].dataType.simpleString()
    path = tokenizer or tokenizer_path()
    names = ["row", id_col, "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, row = _encoder(path), TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                doc, piece, start, length, crc = [], [], [], [], []
                for k, raw in enumerate(encoder.encode([x or "" for x in part.column(1).to_pylist()], end_id)):
                    ids = np.frombuffer(raw, np.uint16)
                    for j, at in enumerate(range(0, len(ids), window)):
                        own = ids[at : at + window]
                        doc.append(k)
                        piece.append(j)
                        start.append(at)
                        length.append(len(own))
                        crc.append(zlib.crc32(own.astype("<u4").tobytes()))
                cols = [pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(doc))), part.column(0).take(pa.array(doc, pa.int64())), *cols], names=names)
                row += len(doc)

    return spread(docs.select(id_col, text_col)).mapInArrow(run, f"row long, `{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(order: list[int], sizes: list[int], room: list[int], where: np.ndarray, window: int) -> None:
    """Put each piece into the open bin that it leaves least room in, or into a new one."""
    by_room: dict[int, list[int]] = {}
    some = 0  # a bit for each room that some bin has
    for b, r in enumerate(room):
        if r:
            by_room.setdefault(r, []).append(b)
            some |= 1 << r
    for i in order:
        size = sizes[i]
        fits = some >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                some ^= 1 << r
        else:
            r, b = window, len(room)
            room.append(window)
        r -= size
        room[b], where[i] = r, b
        if r:
            by_room.setdefault(r, []).append(b)
            some |= 1 << r


def lower_bound(sizes: np.ndarray, window: int) -> int:
    return max(-(-int(sizes.sum()) // window), int((sizes * 2 > window).sum()))


class Island:
    """A population of packings of one shard's pieces, longest first."""

    def __init__(self, sizes: np.ndarray, window: int, seed: list[int]):
        self.sizes, self.window = sizes.astype(np.int64), window
        self.list = self.sizes.tolist()
        self.rng = np.random.default_rng(seed)
        self.bound = lower_bound(self.sizes, window)
        self.members: list[tuple[tuple[int, int], np.ndarray]] = []

    def fills(self, where: np.ndarray) -> np.ndarray:
        return np.bincount(where, weights=self.sizes).astype(np.int64)

    def add(self, where: np.ndarray) -> None:
        fill = self.fills(where)
        self.members.append(((len(fill), -int((fill * fill).sum())), where))

    def begin(self, size: int, exact: bool) -> None:
        """The first member goes by exact lengths if ``exact``, the others by lengths with noise."""
        while len(self.members) < size and not self.rests():
            noise = 0 if exact and not self.members else NOISE
            order = np.argsort(-self.sizes * (1 + noise * self.rng.random(len(self.sizes))), kind="stable")
            where = np.zeros(len(self.sizes), np.int64)
            best_fit(order.tolist(), self.list, [], where, self.window)
            self.add(where)

    def best(self) -> tuple[tuple[int, int], np.ndarray]:
        return min(self.members, key=lambda m: m[0])

    def rests(self) -> bool:
        return bool(self.members) and self.best()[0][0] <= self.bound

    def child(self, keeper: np.ndarray, giver: np.ndarray) -> np.ndarray:
        """``keeper`` with some of ``giver``'s well-filled bins injected."""
        fill = self.fills(giver)
        well = np.flatnonzero(fill * len(fill) >= fill.sum())
        take = self.rng.choice(well, self.rng.integers(1, max(2, len(well) // 2 + 1)), replace=False)
        new = np.full(len(fill), -1)
        new[take] = np.arange(len(take))
        where = new[giver]  # pieces outside the injected bins have no place yet
        hit = np.zeros(int(keeper.max()) + 1, bool)
        hit[keeper[where >= 0]] = True  # bins with duplicates
        kept = self.fills(keeper)
        open_too = np.argsort(kept + self.window * hit)[: 1 + len(kept) // 32]
        hit[open_too] = True
        stay = ~hit[keeper] & (where < 0)
        number = np.cumsum(~hit) - 1 + len(take)
        where[stay] = number[keeper[stay]]
        room = (self.window - np.concatenate([fill[take], kept[~hit]])).tolist()
        best_fit(np.flatnonzero(where < 0).tolist(), self.list, room, where, self.window)
        used = np.unique(where, return_inverse=True)[1]
        return used.astype(np.int64)

    def evolve(self, offspring: int, size: int) -> None:
        for _ in range(offspring):
            if self.rests() or len(self.members) < 2:
                break
            a, b = (min(self.rng.choice(len(self.members), 2, replace=False), key=lambda k: self.members[k][0]) for _ in range(2))
            if a == b:
                b = (a + 1) % len(self.members)
            self.add(self.child(self.members[a][1], self.members[b][1]))
            distinct = {m[0]: m for m in self.members}
            self.members = sorted(distinct.values(), key=lambda m: m[0])[:size] if len(distinct) > 1 else self.members[:size]


_STATE = "shard long, island int, sizes array<int>, members array<binary>"


def epochs(shards: DataFrame, n_shards: int, window: int, islands: int, n_epochs: int, offspring: int, population: int) -> DataFrame:
    """``(shard, sizes)`` to ``(shard, bins)``: the best packing of all islands after all epochs.

    Populations are few bytes and much work, so the number of tasks is set here: by size alone, adaptive
    execution would put all islands into one.
    """

    def step(epoch: int):
        def run(key: tuple, table: pa.Table) -> pa.Table:
            shard, island = key[0].as_py(), key[1].as_py()
            sizes = next(np.asarray(x.values, np.int64) for x in table.column("sizes") if x.is_valid)
            own = Island(sizes, window, [shard, island, epoch])
            for member in (m for row in table.column("members").to_pylist() for m in row):
                own.add(np.frombuffer(member, np.uint32).astype(np.int64))
            if not epoch:
                own.begin(population, island == 0)
            own.evolve(offspring, population)
            own.members.sort(key=lambda m: m[0])
            raw = [m[1].astype(np.uint32).tobytes() for m in own.members]
            if epoch == n_epochs - 1:
                return pa.table({"shard": [shard], "bins": pa.array([raw[0]], pa.binary()), "n_bins": [own.members[0][0][0]], "unevenness": [own.members[0][0][1]]})
            types = (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.binary()))
            rows = ([shard, shard], [island, (island + 1) % islands], [sizes.tolist(), None], [raw, raw[:ELITE]])
            return pa.table([pa.array(c, t) for c, t in zip(rows, types)], names=["shard", "island", "sizes", "members"])

        return run

    spark = shards.sparkSession
    tasks = min(n_shards * islands, max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    state = shards.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "sizes", F.expr("CAST(array() AS array<binary>)").alias("members"))
    for k in range(n_epochs - 1):
        state = state.repartition(tasks, "shard", "island").groupBy("shard", "island").applyInArrow(step(k), _STATE)
    last = state.repartition(tasks, "shard", "island").groupBy("shard", "island").applyInArrow(step(n_epochs - 1), "shard long, bins binary, n_bins long, unevenness long")
    return last.groupBy("shard").agg(F.min_by("bins", F.struct("n_bins", "unevenness", "bins")).alias("bins"))


def _placing(level: int, last: bool, window: int):
    """Gives a shard's pieces the places of its best packing; unless it is the ``last`` shard, with its emptiest bins marked loose."""

    def place(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by([("length", "descending"), ("row", "ascending")]).combine_chunks()
        length = left.column("length").to_numpy()
        bins = np.frombuffer(right.column("bins")[0].as_py(), np.uint32).astype(np.int64)
        fill = np.bincount(bins, weights=length).astype(np.int64)
        loose = np.zeros(len(fill), bool)
        if not last:
            worst = np.argsort(fill, kind="stable")[: max(1, len(fill) // 32)]
            loose[worst] = fill[worst] * 16 < window * 15
        order = np.argsort(bins, kind="stable")
        first = np.cumsum(fill) - fill
        offset = np.empty(len(bins), np.int64)
        offset[order] = np.cumsum(length[order]) - length[order] - first[bins[order]]
        sequence = (level << 56) + (key[0].as_py() << 24) + bins
        return left.drop_columns(["shard"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).append_column("loose", pa.array(loose[bins].astype(np.int32)))

    return place


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, tokenizer: str | None = None, shard_pieces: int = SHARD_PIECES, islands: int = ISLANDS, n_epochs: int = EPOCHS, offspring: int = OFFSPRING, population: int = POPULATION
) -> DataFrame:
    """One row per piece; see the module's docstring."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "bins")
    pieces = scratch.table(cut_pieces(docs, id_col, text_col, window, end_id, tokenizer), "pieces")
    kind = docs.schema[id_col].dataType.simpleString()
    columns = [id_col, "piece", "start", "length", "ids_crc32"]
    out = [pieces.filter(F.col("length") == window).select(*columns, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    open_pieces, level = pieces.filter(F.col("length") < window), 0
    while True:
        n, tokens = open_pieces.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        if not n:
            break
        shards = max(1, min(-(-n // shard_pieces), tokens // (SHARD_BINS * window)))
        dealt = open_pieces.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(shards)))
        sizes = dealt.groupBy("shard").agg(F.reverse(F.array_sort(F.collect_list(F.col("length").cast("int")))).alias("sizes"))  # a shard is bounded
        best = epochs(sizes, shards, window, islands, n_epochs, offspring, population)

        schema = f"row long, `{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, loose int"
        placed = dealt.groupBy("shard").cogroup(best.groupBy("shard")).applyInArrow(_placing(level, shards == 1, window), schema)
        placed = scratch.table(placed, f"level{level}", by="loose")
        out.append(placed.filter("loose = 0").select(*columns, "sequence_id", "offset"))
        open_pieces, level = placed.filter("loose = 1").select("row", *columns), level + 1
    return scratch.close(reduce(DataFrame.unionByName, out))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
