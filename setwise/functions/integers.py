"""Column expressions over unsigned integers, held as BIGINT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIVERSE = 1 << 32
#: Values of one chunk share their high bits.
CHUNK_BITS, CHUNK = 16, 1 << 16


def chunk_of(v: Column) -> Column:
    return F.shiftright(v, CHUNK_BITS)


def low_bits(v: Column) -> Column:
    return v.bitwiseAND(CHUNK - 1)


def signed32(v: Column) -> Column:
    """The signed view of an unsigned 32-bit value."""
    return F.when(v >= 1 << 31, v - UNIVERSE).otherwise(v)


def unsigned64_key(v: Column) -> Column:
    """Orders BIGINTs as unsigned 64-bit values."""
    return v.bitwiseXOR(F.lit(-(1 << 63)))


def order_key_of_double(x: Column) -> Column:
    """A BIGINT that orders as the double does, as unsigned 64-bit values: exponent and fraction as in its bits, which Spark has no cast for, flipped by its sign. Null stays null; -0.0 counts as 0.0."""
    mantissa, size = F.abs(x), F.lit(52)
    exponent = F.when(mantissa == 0, F.lit(-1023)).otherwise(F.greatest(F.floor(F.log2(mantissa)), F.lit(-1022))).cast("int")
    exponent = F.when(F.pow(F.lit(2.0), exponent) > mantissa, exponent - 1).when(F.pow(F.lit(2.0), exponent + 1) <= mantissa, exponent + 1).otherwise(exponent)
    fraction = ((mantissa / F.pow(F.lit(2.0), exponent) - 1) * F.pow(F.lit(2.0), size)).cast("long")
    raw = F.when(mantissa == 0, F.lit(0)).otherwise(F.shiftleft((exponent + 1023).cast("long"), 52) + fraction)
    return F.when(x < 0, F.bitwise_not(raw.bitwiseOR(F.lit(-(1 << 63))))).otherwise(raw.bitwiseOR(F.lit(-(1 << 63))))


def bit(v: Column, i: int | Column) -> Column:
    return F.shiftrightunsigned(v, i).bitwiseAND(1) if isinstance(i, int) else F.getbit(v, i)
