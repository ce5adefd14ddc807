"""Little-endian encodings as Column expressions. Unsigned 64-bit values are DECIMAL(20,0): BIGINT can't hold them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

U64 = "decimal(20,0)"


def _reversed(hexed: Column, width: int) -> Column:
    return F.concat(*[F.substring(hexed, 2 * i + 1, 2) for i in reversed(range(width))])


def le(value: Column, width: int) -> Column:
    """BINARY of a non-negative BIGINT in `width` bytes."""
    return F.unhex(_reversed(F.lpad(F.hex(value.cast("bigint")), 2 * width, "0"), width))


def le_u64(value: Column) -> Column:
    """BINARY of a DECIMAL(20,0) in 8 bytes."""
    return F.unhex(_reversed(F.lpad(F.conv(value.cast("string"), 10, 16), 16, "0"), 8))


def text(value: Column) -> Column:
    """Length-prefixed UTF-8."""
    raw = value.cast("binary")
    return F.concat(le(F.octet_length(raw), 4), raw)


def uint(data: Column, offset: int | Column, width: int) -> Column:
    """An unsigned integer at a byte offset: BIGINT up to 4 bytes, else DECIMAL(20,0)."""
    at = F.lit(offset + 1) if isinstance(offset, int) else (offset + 1).cast("int")
    number = F.conv(_reversed(F.hex(F.substring(data, at, F.lit(width))), width), 16, 10)
    return number.cast("bigint" if width <= 4 else U64)


def piece(data: Column, offset: int | Column, length: int | Column) -> Column:
    at = F.lit(offset + 1) if isinstance(offset, int) else (offset + 1).cast("int")
    return F.substring(data, at, F.lit(length) if isinstance(length, int) else length.cast("int"))


def low_hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def align_up(n: Column, to: int) -> Column:
    return (n + F.pmod(-n, F.lit(to))).cast("bigint")


def hex_preview(data: Column, most: int) -> Column:
    """The first bytes in hex, an ellipsis where some are left out."""
    return F.concat(low_hex(F.substring(data, 1, most)), F.when(F.octet_length(data) > most, F.lit("...")).otherwise(F.lit("")))


def wrap32(value: Column) -> Column:
    return value.bitwiseAND(F.lit(0xFFFFFFFF))


def times32(a: Column, factor: int) -> Column:
    """a * factor mod 2^32 without overflow of BIGINT: a below 2^32, the factor taken in halves."""
    low, high = factor & 0xFFFF, factor >> 16
    return wrap32(a * F.lit(low) + wrap32(a * F.lit(high)).bitwiseAND(F.lit(0xFFFF)) * F.lit(1 << 16))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: a lambda's variable isn't inlined, as a projected column would be."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def times64(a: Column, factor: int) -> Column:
    """a * factor mod 2^64 for DECIMAL(20,0), in 32-bit halves so that no product leaves DECIMAL(38,0)."""
    big = lambda x, n=38: F.lit(str(x)).cast(f"decimal({n},0)")

    def halves(x: Column) -> Column:
        low, high = (x % big(1 << 32, 20)).cast("decimal(10,0)"), F.floor(x / big(1 << 32, 20)).cast("decimal(10,0)")
        cross = (low * big(factor >> 32, 10) + high * big(factor & 0xFFFFFFFF, 10)).cast("decimal(38,0)") % big(1 << 32)
        total = (low * big(factor & 0xFFFFFFFF, 10)).cast("decimal(38,0)") + (cross.cast("decimal(10,0)") * big(1 << 32, 10)).cast("decimal(38,0)")
        return (total.cast("decimal(38,0)") % big(1 << 64)).cast(U64)

    return let(a, halves)


def signed64(u: Column) -> Column:
    """The BIGINT with the bit pattern of an unsigned value."""
    return let(u, lambda x: F.when(x >= F.lit(str(1 << 63)).cast(U64), x.cast("decimal(21,0)") - F.lit(str(1 << 64)).cast("decimal(21,0)")).otherwise(x.cast("decimal(21,0)")).cast("bigint"))


def unsigned64(s: Column) -> Column:
    return let(s, lambda x: F.when(x < 0, x.cast("decimal(21,0)") + F.lit(str(1 << 64)).cast("decimal(21,0)")).otherwise(x.cast("decimal(21,0)")).cast(U64))


def _finalised(x):
    """The 64-bit finaliser of Murmur3 on an array of uint64, which wraps."""
    import numpy as np

    shift = np.uint64(33)
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ x >> shift) * np.uint64(factor)
    return x ^ x >> shift


def murmur_finaliser(u: Column) -> Column:
    """The 64-bit finaliser of Murmur3 on DECIMAL(20,0)."""
    import pyarrow as pa

    def run(x: pa.Array) -> pa.Array:
        import numpy as np

        return pa.array(_finalised(x.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)).view(np.int64), mask=x.is_null().to_numpy(zero_copy_only=False))

    run.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return unsigned64(F.arrow_udf(run, "bigint")(signed64(u)))


def ring_hash(s: Column) -> Column:
    """FNV-1a of a string's bytes, then the finaliser: DECIMAL(20,0). A null is an empty string."""
    import pyarrow as pa

    def run(x: pa.Array) -> pa.Array:
        import numpy as np

        x = x.fill_null(b"").cast(pa.large_binary())
        ends = np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1]
        data = np.frombuffer(x.buffers()[2] or b"", np.uint8)
        h, size = np.full(len(x), 14695981039346656037, np.uint64), np.diff(ends)
        # byte by byte over all strings that are that long, the long ones first
        order = np.argsort(-size, kind="stable")
        left = len(x)
        for i in range(int(size.max(initial=0))):
            left -= int(np.searchsorted(size[order[:left]][::-1], i, "right"))
            at = order[:left]
            h[at] = (h[at] ^ data[ends[at] + i]) * np.uint64(0x100000001B3)
        return pa.array(_finalised(h).view(np.int64))

    run.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return unsigned64(F.arrow_udf(run, "bigint")(s.cast("binary")))


def bit_at(u: Column, depth: Column) -> Column:
    """The bit of a DECIMAL(20,0) at this depth, the highest at 0."""
    return F.call_function("shiftrightunsigned", signed64(u), (F.lit(63) - depth).cast("int")).bitwiseAND(F.lit(1)).cast("int")


def mask_prefix(u: Column, length: Column) -> Column:
    """u with all bits beyond the first `length` cleared."""
    mask = F.call_function("shiftleft", F.lit(-1).cast("bigint"), (F.lit(64) - length).cast("int"))
    return F.when(length <= 0, F.lit(0).cast(U64)).otherwise(unsigned64(signed64(u).bitwiseAND(F.when(length >= 64, F.lit(-1).cast("bigint")).otherwise(mask))))


def trailing_zeros(u: Column) -> Column:
    """How many of the lowest bits are 0; 64 for 0."""

    def count(s: Column) -> Column:
        # all below the lowest one
        return F.when(s == 0, 64).otherwise(F.bit_count((s.bitwiseAND(F.bitwise_not(s) + F.lit(1))) - F.lit(1)))

    # the lowest bit alone may be -2^63, whose negation and predecessor overflow: it has 63 zeros
    return let(signed64(u), lambda s: F.when(s == F.lit(-(1 << 63)).cast("bigint"), 63).otherwise(count(s)).cast("int"))
