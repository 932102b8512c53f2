"""Column expressions over nucleotide strings; case is meaningful (lower case is soft-masked)."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

# Nucleotide codes and their complements, IUPAC ambiguity codes included.
CODES = "ACGTUacgtuRYKMBVDHrykmbvdh"
COMPLEMENTS = "TGCAAtgcaaYRMKVBHDyrmkvbhd"

# Fixed value: the widespread spaced seed of weight 12 and span 19.
SPACED = "1110100110010101111"

ALPHABET = "^[ACGTacgt]*$"


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, CODES, COMPLEMENTS))


def ungapped(seq: Column) -> Column:
    return F.replace(seq, F.lit("-"), F.lit(""))


def is_plain(seq: Column) -> Column:
    """Only A, C, G, T in either case; null for null."""
    return seq.rlike(ALPHABET)


def upper_count(seq: Column) -> Column:
    return F.regexp_count(seq, F.lit("[ACGT]"))


def _single(x: float) -> float:
    """Rounded to a 32-bit float."""
    return struct.unpack("f", struct.pack("f", x))[0]


def upper_threshold(fraction: float, length: int) -> int:
    """The whole part of the product in 32-bit arithmetic; a window must have more upper-case
    bases than this."""
    return int(_single(_single(fraction) * length))


def kmers(seq: Column, k: int, piece: int = 512) -> Column:
    """All overlapping k-mers, left to right; none for a shorter string.

    A position in a string is found by walking to it, so long strings are cut into overlapping
    pieces first; the cost then grows with the length and not with its square.
    """

    def short(s: Column) -> Column:
        n = F.length(s) - k + 1
        own = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(s, i, F.lit(k)))
        return F.when(n >= 1, own).otherwise(F.expr("cast(array() as array<string>)"))

    # lambda variables are bound once; an expression would be evaluated again for every k-mer
    def cut(whole: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(whole), F.lit(1)), F.lit(piece))
        return F.flatten(F.transform(F.transform(starts, lambda i: F.substring(whole, i, F.lit(piece + k - 1))), short))

    return F.transform(F.array(seq), cut)[0]


def hashed_int(text: Column, modulus: Column) -> Column:
    """A draw below ``modulus`` fixed by ``text``: 48 bits of its MD5.

    Deterministic across engines and runs, unlike a seeded generator that depends on partitions.
    """
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long"), modulus)


def packed(kmer: Column, k: int) -> Column:
    """A plain upper-case k-mer as one number, two bits a base, up to 31 bases; longer ones stay text."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long") if k <= 31 else kmer
