"""Erasure parity over GF(2^8) with the polynomial x^8+x^4+x^3+x^2+1, and the layout of striped blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The generator polynomial (fixed value).
POLYNOMIAL = 0x11D


def tables() -> tuple[list[int], list[int]]:
    """(2^k for k from 0 to 254, the k of each byte; 0 has none and holds 0)."""
    powers, logs, x = [], [0] * 256, 1
    for k in range(255):
        powers.append(x)
        logs[x] = k
        x = x << 1 ^ (POLYNOMIAL if x & 0x80 else 0)
    return powers, logs


def _looked_up(table: list[int], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x).cast("long") for x in table]), (index + 1).cast("int"))


def gf_times_power(a: Column, k: Column) -> Column:
    """a * 2^k for a byte a, by logarithms."""
    powers, logs = tables()
    return F.when(a == 0, F.lit(0).cast("long")).otherwise(_looked_up(powers, (_looked_up(logs, a) + k) % 255))


def gf_over_power(a: Column, k: Column) -> Column:
    """a / 2^k."""
    return gf_times_power(a, 255 - k % 255)


def p_parity(data: Column) -> Column:
    return F.bit_xor(data)


def q_parity(data: Column, exponent: Column) -> Column:
    """Sum of 2^exponent * data."""
    return F.bit_xor(gf_times_power(data, exponent))


def stripe_columns(sectors: Column, width: Column | int, parity: int) -> dict[str, Column]:
    """Layout of a block of that many sectors over `width` members: rows of data, columns that hold one sector more, parity and skip sectors."""
    width = F.lit(width) if isinstance(width, int) else width
    data = width - parity
    full = F.floor(sectors / data)
    rest = sectors - full * data
    big = F.when(rest > 0, rest + parity).otherwise(F.lit(0))
    total = sectors + F.lit(parity) * (full + F.when(rest > 0, 1).otherwise(0))
    padded = F.ceil(total / (parity + 1)) * (parity + 1)
    return {"full_rows": full, "big_columns": big, "allocated": padded, "skip_sectors": padded - total}
