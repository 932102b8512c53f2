"""Cues of several tracks, and errors of damaged files."""

from __future__ import annotations

import random

import pytest

from cladeloom.llm import matroska as m


def _file(*parts: bytes) -> bytes:
    return m.element(m.EBML, m.element(m.DOC_TYPE, b"matroska")) + m.element(m.SEGMENT, b"".join(parts))


def test_every_position_of_a_cue_point_is_kept():
    def where(track: int, at: int) -> bytes:
        return m.element(m.CUE_TRACK_POSITIONS, m.uint(m.CUE_TRACK, track) + m.uint(m.CUE_CLUSTER_POSITION, at))

    points = m.element(m.CUE_POINT, m.uint(m.CUE_TIME, 5) + where(1, 70) + where(2, 90)), m.element(m.CUE_POINT, where(1, 200) + m.uint(m.CUE_TIME, 9)), m.element(m.CUE_POINT, b"")
    media = m.demux(_file(m.element(m.CUES, b"".join(points))))
    assert media.cues == [(5, 1, 70), (5, 2, 90), (9, 1, 200)]
    assert m.seek(media, 8) == 90 and m.seek(media, 4) is None


@pytest.mark.parametrize("n", [1, 576 * 20])
def test_cut_and_changed_files_raise_value_errors_only(n):
    rng = random.Random(n)
    whole = m.mux(m.pad(rng.randbytes(n)))
    for cut in {*range(0, min(len(whole), 700)), *range(0, len(whole), 37), len(whole) - 1}:
        with pytest.raises(ValueError):
            m.demux(whole[:cut])
    for _ in range(3000):
        bad = bytearray(whole)
        for _ in range(rng.randrange(1, 4)):
            bad[rng.randrange(min(len(bad), 400))] = rng.randrange(256)
        try:
            m.demux(bytes(bad))
        except ValueError:
            pass


@pytest.mark.parametrize("kind", [m.XIPH, m.FIXED, m.EBML_LACE])
def test_every_prefix_of_a_laced_block(kind):
    frames = [bytes(k + 1) if kind != m.FIXED else bytes(4) for k in (3, 300, 5)]
    body = m.block(frames, 0, kind)
    ident, at = m._ident(body, 0)
    size, at = m._size(body, at)
    for n in range(size):
        try:
            m.demux(_file(m.element(m.CLUSTER, m.uint(m.TIMESTAMP, 0) + m.element(m.SIMPLE_BLOCK, body[at : at + n]))))
        except ValueError:
            pass
