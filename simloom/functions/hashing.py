"""Integer and byte hashes as column expressions; arithmetic is done in longs and masked, so that it wraps without errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
#: Fixed value: the multiplier of the integer scramble.
SCRAMBLE = 0x45D9F3B


def signed32(x: Column) -> Column:
    """An unsigned 32-bit value in a long as the signed int with the same bits."""
    return F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x).cast("int")


def unsigned32(x: Column) -> Column:
    return x.cast("long").bitwiseAND(MASK)


def scramble(x: Column) -> Column:
    """Shift, xor and multiply twice, then shift and xor, over 32 bits; the result is a long from 0 up."""
    x = unsigned32(x)
    for _ in range(2):
        x = (F.shiftright(x, 16).bitwiseXOR(x) * F.lit(SCRAMBLE).cast("long")).bitwiseAND(MASK)
    return F.shiftright(x, 16).bitwiseXOR(x)


def scramble_signed(x: Column) -> Column:
    """The scramble in signed 32-bit arithmetic with arithmetic shifts, as an int."""
    x = signed32(unsigned32(x)).cast("long")
    for _ in range(2):
        x = signed32((F.shiftright(x, 16).bitwiseXOR(x) * F.lit(SCRAMBLE).cast("long")).bitwiseAND(MASK)).cast("long")
    return F.shiftright(x, 16).bitwiseXOR(x).cast("int")


def int_bytes(x: Column) -> Column:
    """The four bytes of an int, highest first, each signed."""
    return F.array(*[(F.shiftright(x.cast("long"), s).bitwiseAND(255).bitwiseXOR(128) - 128) for s in (24, 16, 8, 0)])


def bytes_hash(values: Column) -> Column:
    """The polynomial hash with factor 31 and start 1 over an array of signed bytes, as a signed int."""
    return signed32(F.aggregate(values, F.lit(1).cast("long"), lambda h, b: (h * 31 + b).bitwiseAND(MASK)))


def ints_hash(values: Column) -> Column:
    """bytes_hash of an array of ints, each as four bytes."""
    return bytes_hash(F.flatten(F.transform(values, int_bytes)))
