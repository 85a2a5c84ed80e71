"""Arithmetic on ids and sizes, as column expressions (and the same on Python integers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK32 = 0xFFFFFFFF


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def rotr32(id_: Column, r: int) -> Column:
    """Rotate the low 32 bits of an id right by r; the high ones stay: an injective priority that differs from round to round."""
    r %= 32
    if r == 0:
        return id_
    low = id_.bitwiseAND(F.lit(MASK32))
    turned = F.shiftright(low, r).bitwiseOR(F.shiftleft(low, 32 - r).bitwiseAND(F.lit(MASK32)))
    return id_.bitwiseAND(F.lit(~MASK32)).bitwiseOR(turned)


def rotl32(id_: Column, r: int) -> Column:
    return rotr32(id_, (32 - r) % 32)


def floordiv(a, b) -> Column:
    """Quotient rounded towards minus infinity."""
    a, b = _col(a).cast("long"), _col(b).cast("long")
    return F.call_function("div", a - F.pmod(a, b), b)


def ceildiv(a, b) -> Column:
    a, b = _col(a), _col(b)
    return -floordiv(-a, b)


def remainder(a, b) -> Column:
    """Never negative for a positive divisor."""
    return F.pmod(_col(a), _col(b))


def round_down(a, b) -> Column:
    return _col(a) - remainder(a, b)


def round_up(a, b) -> Column:
    return ceildiv(a, b) * _col(b)


def clip(x, lo, hi) -> Column:
    return F.greatest(_col(lo), F.least(_col(x), _col(hi)))


def mix_hash(x: Column, seed: int = 0) -> Column:
    """A 64-bit integer hash."""
    return F.xxhash64(x, F.lit(seed))


def bytes_for(top: int) -> int:
    """Fewest bytes, 1 to 8, that hold ``top``."""
    if top < 0 or top >= 1 << 64:
        raise ValueError("out of range for eight bytes")
    return max(1, (int(top).bit_length() + 7) // 8)


def bytes_for_column(top: Column) -> Column:
    """``bytes_for`` on a non-negative column; null for null."""
    return F.ceil(F.length(F.bin(top)) / 8).cast("int")
