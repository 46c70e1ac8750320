"""Byte functions as native column expressions over BINARY and BIGINT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The seeds and multipliers of the 32-bit block hash, and the offset of masked checksums.
HASH_MULTIPLIER = 0xC6A4A793
BLOOM_SEED = 0xC6A4A793
MASK_OFFSET = 0xA282EAD8
WORD32 = 0xFFFFFFFF


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def byte_at(b: Column, i: Column | int) -> Column:
    """Unsigned byte at 0-based place i."""
    at = (F.lit(i) if isinstance(i, int) else i) + 1
    return F.conv(F.hex(F.substring(b, at, F.lit(1))), 16, 10).cast("long")


def fixed_hex(n: Column, width: int) -> Column:
    """Hex of n as a little-endian fixed integer of width bytes."""
    big = F.lpad(F.hex(n), 2 * width, "0")
    return F.concat(*[F.substring(big, 2 * k + 1, 2) for k in reversed(range(width))])


def fixed(n: Column, width: int) -> Column:
    return F.unhex(fixed_hex(n, width))


def fixed_value(b: Column, width: int = 8) -> Column:
    """Value of a little-endian fixed integer; missing bytes are zero."""
    h = F.rpad(F.hex(F.substring(b, 1, width)), 2 * width, "0")
    return F.conv(F.concat(*[F.substring(h, 2 * k + 1, 2) for k in reversed(range(width))]), 16, 10).cast("decimal(20,0)").cast("long")


def varint_hex(n: Column) -> Column:
    """Hex of n (not negative) as a base-128 varint: seven bits a byte, low ones first, the high bit says that more follow."""
    out = F.lit("")
    for k in range(9):
        low = F.shiftright(n, 7 * k).bitwiseAND(F.lit(127))
        more = F.shiftright(n, 7 * (k + 1)) > 0
        byte = F.lpad(F.hex(low + F.when(more, 128).otherwise(0)), 2, "0")
        out = F.concat(out, F.when((F.lit(k) == 0) | (F.shiftright(n, 7 * k) > 0), byte).otherwise(""))
    return out


def prefixed(b: Column) -> Column:
    """Length as varint, then the bytes; the empty slice is one zero byte."""
    return F.unhex(F.concat(varint_hex(F.octet_length(b).cast("long")), F.hex(b)))


def internal_key(key: Column, seq: Column, vtype: Column) -> Column:
    """User key and the fixed 64-bit tag of sequence and type."""
    return F.unhex(F.concat(F.hex(key), fixed_hex(F.shiftleft(seq, 8) + vtype, 8)))


def user_key(ikey: Column) -> Column:
    """Null when shorter than the tag or of unknown type."""
    n = F.octet_length(ikey)
    return F.when((n >= 8) & (byte_at(ikey, n - 8) <= 1), F.substring(ikey, F.lit(1), n - 8))


def tag_of(ikey: Column) -> Column:
    """(seq, vtype) struct of an internal key."""
    n = F.octet_length(ikey)
    tag = fixed_value(F.substring(ikey, n - 7, F.lit(8)))
    return F.struct(F.shiftright(tag, 8).alias("seq"), tag.bitwiseAND(F.lit(255)).cast("int").alias("vtype"))


def mask(crc: Column) -> Column:
    """Rotated right by 15 bits, plus a constant, in 32 bits."""
    turned = F.shiftright(crc, 15).bitwiseOR(F.shiftleft(crc, 17).bitwiseAND(F.lit(WORD32)))
    return (turned + F.lit(MASK_OFFSET)).bitwiseAND(F.lit(WORD32))


def unmask(masked: Column) -> Column:
    turned = (masked + F.lit((1 << 32) - MASK_OFFSET)).bitwiseAND(F.lit(WORD32))
    return F.shiftright(turned, 17).bitwiseOR(F.shiftleft(turned, 15).bitwiseAND(F.lit(WORD32)))


def crc_extend(data: Column, more: Column) -> Column:
    """The checksum of data followed by more."""
    return F.crc32(F.concat(data, more))


def _times(a: Column, m: int) -> Column:
    """a * m in 32 bits, by halves: a whole product would overflow 64 bits."""
    high = (a * F.lit(m >> 16)).bitwiseAND(F.lit(0xFFFF))
    return (F.shiftleft(high, 16) + a * F.lit(m & 0xFFFF)).bitwiseAND(F.lit(WORD32))


def _xor_shift(h: Column, by: int) -> Column:
    return h.bitwiseXOR(F.shiftright(h, by))


def hash32(data: Column, seed: int) -> Column:
    """32-bit block hash: four bytes a round, then what is left."""
    n = F.octet_length(data)
    first = F.lit(seed).bitwiseXOR(_times(n.cast("long"), HASH_MULTIPLIER))
    starts = F.when(n >= 4, F.sequence(F.lit(0), F.greatest(n - 4, F.lit(0)), F.lit(4))).otherwise(F.array().cast("array<int>"))
    word = lambda i: fixed_value(F.substring(data, i + 1, F.lit(4)), 4)
    body = F.aggregate(starts, first, lambda h, i: _let(_times((h + word(i)).bitwiseAND(F.lit(WORD32)), HASH_MULTIPLIER), lambda x: _xor_shift(x, 16)))
    rest = F.pmod(n, F.lit(4))
    tail = fixed_value(F.substring(data, n - rest + 1, rest), 4)

    def end(h: Column) -> Column:
        mixed = _times((h + tail).bitwiseAND(F.lit(WORD32)), HASH_MULTIPLIER)
        return F.when(rest == 0, h).otherwise(_let(mixed, lambda x: _xor_shift(x, 24)))

    return _let(body, end)


def _common(a: Column, b: Column) -> Column:
    """Length of the common prefix of two binaries."""
    ha, hb = F.hex(a), F.hex(b)
    n = F.least(F.octet_length(a), F.octet_length(b))
    same = F.filter(F.sequence(F.lit(0), n), lambda i: F.substring(ha, F.lit(1), i * 2) == F.substring(hb, F.lit(1), i * 2))
    return F.size(same) - 1


def separator(a: Column, b: Column) -> Column:
    """A short key in [a, b): a cut behind the first difference and raised there, where that stays below b; else a."""

    def cut(i: Column) -> Column:
        x, y = byte_at(a, i), byte_at(b, i)
        raised = F.unhex(F.concat(F.hex(F.substring(a, F.lit(1), i)), F.lpad(F.hex(x + 1), 2, "0")))
        inside = (i < F.octet_length(a)) & (i < F.octet_length(b))
        return F.when(inside & (x < 255) & (x + 1 < y), raised).otherwise(a)

    return F.when((F.octet_length(a) == 0) | (F.octet_length(b) == 0), a).otherwise(_let(_common(a, b), cut))


def successor(a: Column) -> Column:
    """A short key at or behind a: the first byte below 255 raised, what follows cut; a itself if there is none."""
    n = F.octet_length(a)
    places = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    at = F.get(F.filter(places, lambda i: byte_at(a, i) < 255), F.lit(0))
    return _let(at, lambda i: F.when(i.isNull(), a).otherwise(F.unhex(F.concat(F.hex(F.substring(a, F.lit(1), i)), F.lpad(F.hex(byte_at(a, i) + 1), 2, "0")))))


def shared_prefix(prev: Column, key: Column) -> Column:
    return F.when(prev.isNull(), 0).otherwise(_common(prev, key))
