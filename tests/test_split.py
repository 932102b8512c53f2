"""Split readers give what reading in one gives, wherever a file is cut."""

from __future__ import annotations

import gzip
import random
import struct
import zlib

import pytest

from cladeloom.sources import fasta, maf, split


def _bgzf(data: bytes, size: int) -> bytes:
    out = b""
    for part in [*(data[k : k + size] for k in range(0, len(data), size)), b""]:
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def _text(rng: random.Random) -> str:
    out = [rng.choice(["", "\n", "ACGT before any header\n"])]
    for k in range(7):
        out.append(f">r{k} comment > here" + rng.choice(["\n", "\r\n"]))
        seq = "".join(rng.choice("ACGTacgtN") for _ in range(rng.choice([0, 3, 17, 90])))
        width = rng.choice([1, 7, 200])
        out.append("".join(seq[i : i + width] + rng.choice(["\n", "\r\n", "\n\n", " \n"]) for i in range(0, len(seq), width)))
    return "".join(out).rstrip("\n") + rng.choice(["", "\n"])


def _whole(path: str, size: int, overlap: int) -> set:
    """By the reader of one file a task."""
    options = {"path": path, "chunk": str(size), "overlap": str(overlap)}
    reader = fasta.ChunkReader(options)
    return {(sp, rec, start, own, seq) for p in reader.partitions() for sp, rec, _, start, own, seq in reader.read(p)}


@pytest.mark.parametrize("seed", range(4))
def test_states_compose_at_every_cut(seed):
    raw = _text(random.Random(seed)).encode()
    for step in range(1, 40):
        s = split.State()
        for at in range(0, len(raw), step):
            s = split.after(s, *split._summary(raw[at : at + step]))
        assert s == split.after(split.State(), *split._summary(raw))


@pytest.mark.parametrize("kind", ["plain", "blocked", "gzip"])
def test_chunks_at_every_cut(spark, tmp_path, kind):
    rng = random.Random(kind)
    for k in range(2):
        raw = _text(rng).encode()
        (tmp_path / f"s{k}.fa").write_bytes(raw) if kind == "plain" else (tmp_path / f"s{k}.fa.gz").write_bytes(_bgzf(raw, 50) if kind == "blocked" else gzip.compress(raw))
    (tmp_path / "reads.fq").write_text("@q\nACGTACGTAC\n+\n@@@@@@@@@@\n")
    want = _whole(str(tmp_path), 10, 4)
    cuts = (1, 7, 13, 64, 1000) if kind == "plain" else (1, 40, 100_000)
    for cut in cuts:
        rows = fasta.read_chunks(spark, str(tmp_path), 4, 10, cut).collect()
        assert {tuple(r) for r in rows} == want and len(rows) == len(want), cut
    many = split.ranges(spark, str(tmp_path), fasta.FASTA, 64)
    assert many.count() > 4 if kind != "gzip" else many.count() == 2


def test_alignments_at_every_cut(spark, tmp_path):
    rng = random.Random(2)
    lines = ["##maf version=1", "# a comment"]
    for k in range(12):
        lines += [f"a score={rng.randrange(9999)}", f"s chr{k} {k * 7} 4 + 100 AC-GT", f"s gene_{k % 5} 0 4 {rng.choice('+-')} 50 ACCGT", *rng.choice([[""], ["", ""]])]
    lines.append("a score=7")
    for name, text in {"one.maf": "\n".join(lines), "two.maf": "\n".join(lines[:9]) + "\n", "none.maf": ""}.items():
        (tmp_path / name).write_text(text)
    want = set()
    for name in ("one", "two"):
        for gene, *rest in maf.blocks((tmp_path / f"{name}.maf").read_text().splitlines()):
            want.add((name, int(gene.rsplit("_", 1)[-1]), *rest))
    for cut in (1, 3, 17, 50, 1000):
        rows = maf.read(spark, str(tmp_path), cut).collect()
        assert {tuple(r) for r in rows} == want and len(rows) == len(want), cut
