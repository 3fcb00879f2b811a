"""Bit strings, hex text and integers.  Bits are '0'/'1' strings, first bit first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def bits_to_int(bits: Column) -> Column:
    """Most significant bit first; up to 63 bits."""
    return F.conv(bits, 2, 10).cast("bigint")


def int_to_bits(value: Column, width: int) -> Column:
    return F.lpad(F.bin(value.cast("bigint")), width, "0")


def _by_part(text: Column, size: int, convert) -> Column:
    """Convert ``text`` in parts of ``size`` characters and join the results."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text), F.lit(size)))
    return F.coalesce(
        F.concat_ws("", F.transform(starts, lambda i: convert(F.substring(text, i, F.lit(size))))), F.lit("")
    )


def hex_to_bits(text: Column) -> Column:
    return _by_part(text, 15, lambda p: F.lpad(F.conv(p, 16, 2), F.length(p) * 4, "0"))


def bits_to_hex(bits: Column) -> Column:
    """Hex text; a partial last nibble is padded with zeros at its end."""
    padded = F.rpad(bits, ((F.length(bits) + 3) / 4).cast("int") * 4, F.lit("0"))
    return _by_part(padded, 60, lambda p: F.lpad(F.conv(p, 2, 16), (F.length(p) / 4).cast("int"), "0"))


def dibits_to_bits(dibits: Column) -> Column:
    """'0'..'3' digits to two bits each."""
    out = F.translate(dibits, "0123", "abcd")
    for mark, pair in zip("abcd", ("00", "01", "10", "11"), strict=True):
        out = F.replace(out, F.lit(mark), F.lit(pair))
    return out


def bits_to_dibits(bits: Column) -> Column:
    """Pairs of bits to '0'..'3'; an odd last bit is dropped."""
    pairs = F.when(F.length(bits) >= 2, F.sequence(F.lit(1), F.length(bits) - 1, F.lit(2)))
    return F.coalesce(
        F.concat_ws("", F.transform(pairs, lambda i: F.conv(F.substring(bits, i, F.lit(2)), 2, 10))), F.lit("")
    )


def bit_field(bits: Column, first: int, last: int) -> Column:
    """Integer in bits ``first``..``last`` (1-based, inclusive); null when the text is shorter."""
    return F.when(F.length(bits) >= last, bits_to_int(F.substring(bits, first, last - first + 1)))
