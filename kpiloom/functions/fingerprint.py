"""FarmHash Fingerprint64 of short texts as Column arithmetic.

The hash multiplies and adds modulo 2^64, while Spark's ``bigint`` arithmetic raises on
overflow (ANSI) or has no unsigned form, so sums and products go by 32-bit halves that
never leave the range.  Each intermediate value is bound once.  The hash is published (FarmHash, 2014, MIT licence).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

#: Fixed constants of the hash, as unsigned 64-bit numbers.
_K0 = 0xC3A5C85C97CB3127
_K1 = 0xB492B66FBE98F273
_K2 = 0x9AE16A3B2F90404F
#: Longest text, in bytes, of the branches written here; the text of any 64-bit id has 20.
LONGEST = 32

_LOW32 = 0xFFFFFFFF


def _long(x: int) -> Column:
    """A 64-bit pattern as a ``bigint`` literal."""
    return F.lit(x - (1 << 64) if x >= 1 << 63 else x).cast("bigint")


def _let2(a: Column, b: Column, body: Callable[[Column, Column], Column]) -> Column:
    return let(a, lambda x: let(b, lambda y: body(x, y)))


def _low(x: Column) -> Column:
    return x.bitwiseAND(_long(_LOW32))


def _high(x: Column) -> Column:
    return F.shiftrightunsigned(x, 32)


def _joined(high: Column, low: Column) -> Column:
    """Two 32-bit halves; bits of ``high`` beyond 32 fall out."""
    return F.shiftleft(high, 32).bitwiseOR(low)


def _plus(a: Column, b: Column) -> Column:
    """a + b modulo 2^64."""
    return _let2(a, b, lambda x, y: let(
        _low(x) + _low(y), lambda s: _joined(_high(x) + _high(y) + _high(s), _low(s))))


def _times32(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of two 32-bit values."""
    low, high = b.bitwiseAND(_long(0xFFFF)), F.shiftrightunsigned(b, 16)
    return _low(a * low + F.shiftleft((a * high).bitwiseAND(_long(0xFFFF)), 16))


def _times(a: Column, b: Column) -> Column:
    """a * b modulo 2^64."""
    def halves(x, y):
        first = _low(x) * _low(y).bitwiseAND(_long(0xFFFF))                         # below 2^48
        return let(first, lambda p: let(
            _low(x) * F.shiftrightunsigned(_low(y), 16) + F.shiftrightunsigned(p, 16),
            lambda q: _joined(
                F.shiftrightunsigned(q, 16) + _times32(_low(x), _high(y)) + _times32(_high(x), _low(y)),
                p.bitwiseAND(_long(0xFFFF)).bitwiseOR(F.shiftleft(q.bitwiseAND(_long(0xFFFF)), 16)))))
    return _let2(a, b, halves)


def _rotated(x: Column, bits: int) -> Column:
    return let(x, lambda v: F.shiftrightunsigned(v, bits).bitwiseOR(F.shiftleft(v, 64 - bits)))


def _folded(x: Column) -> Column:
    return let(x, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 47)))


def _mixed(u: Column, v: Column, mul: Column) -> Column:
    """Two 64-bit values mixed into one."""
    return let(v, lambda w: _times(_folded(_times(
        w.bitwiseXOR(_folded(_times(u.bitwiseXOR(w), mul))), mul)), mul))


def farm_fingerprint(text: Column) -> Column:
    """FarmHash Fingerprint64 of a text's UTF-8 bytes as a signed ``bigint``.

    Null gives null; a text of more than 32 bytes raises (ids are shorter).
    """
    pairs = F.regexp_extract_all(F.hex(text.cast("binary")), F.lit(".."), F.lit(0))
    backwards = F.array_join(F.reverse(pairs), "")          # little-endian reads are its substrings

    def hashed(back: Column) -> Column:
        n = F.length(back) / 2

        def read(size: int, at=None, to_end=None) -> Column:
            """``size`` bytes from byte ``at`` on, or from ``to_end`` bytes before the end."""
            first = 2 * (n - size - at) + 1 if to_end is None else F.lit(2 * (to_end - size) + 1)
            return F.conv(F.substr(back, first.cast("int"), F.lit(2 * size)), 16, -10).cast("bigint")

        size = n.cast("bigint")
        mul = size * 2 + _long(_K2)
        second = size.cast("int") / 2
        few = _let2(
            read(1, 0) + F.shiftleft(read(1, F.floor(second)), 8), size + F.shiftleft(read(1, to_end=1), 2),
            lambda y, z: _times(_folded(_times(y, _long(_K2)).bitwiseXOR(_times(z, _long(_K0)))), _long(_K2)))
        some = _mixed(size + F.shiftleft(read(4, 0), 3), read(4, to_end=4), mul)
        more = _let2(
            _plus(read(8, 0), _long(_K2)), read(8, to_end=8),
            lambda a, b: _mixed(_plus(_times(_rotated(b, 37), mul), a), _times(_plus(_rotated(a, 25), b), mul), mul))
        many = _let2(
            _times(read(8, 0), _long(_K1)), read(8, 8),
            lambda a, b: _let2(
                _times(read(8, to_end=8), mul), _times(read(8, to_end=16), _long(_K2)),
                lambda c, d: _mixed(
                    _plus(_plus(_rotated(_plus(a, b), 43), _rotated(c, 30)), d),
                    _plus(_plus(a, _rotated(_plus(b, _long(_K2)), 18)), c), mul)))
        return (F.when(size > LONGEST, F.raise_error(F.lit(f"a fingerprint takes texts of up to {LONGEST} bytes"))
                       .cast("bigint"))
                .when(size > 16, many).when(size >= 8, more).when(size >= 4, some)
                .when(size > 0, few).otherwise(_long(_K2)))

    return F.when(text.isNotNull(), let(backwards, hashed))
