"""Block checksums as aggregates.

The running sums of Fletcher's checksums have closed forms: with n words w_1..w_n and r = n - i + 1,
a = sum w, b = sum r w, c = sum r (r + 1) / 2 w, d = sum r (r + 1) (r + 2) / 6 w, modulo 2**64. Sums
are taken in DECIMAL(38), whose partial sums merge in any order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODULUS = 1 << 64


def _wrapped(total: Column) -> Column:
    return F.pmod(total, F.lit(str(MODULUS)).cast("decimal(38,0)")).cast("decimal(20,0)")


def _places(df: DataFrame, key: str, order: Sequence[str], word: str) -> DataFrame:
    group = Window.partitionBy(key)
    i = F.row_number().over(group.orderBy(*order))
    return df.withColumns({"i__": i.cast("long"), "n__": F.count("*").over(group), "w__": F.col(word).cast("decimal(20,0)")})


def _sums(r: Column, w: Column, names: Sequence[str]) -> list[Column]:
    weights = [F.lit(1).cast("long"), r, (r * (r + 1)).cast("long") / 2, (r * (r + 1) * (r + 2)).cast("long") / 6]
    out = []
    for name, weight in zip(names, weights, strict=False):
        out.append(_wrapped(F.sum((w * F.floor(weight).cast("decimal(17,0)")).cast("decimal(38,0)"))).alias(name))
    return out


def fletcher4(df: DataFrame, key: str, order: Sequence[str], word: str) -> DataFrame:
    """Rows (key, a, b, c, d): four running sums over the words of each key in order."""
    placed = _places(df, key, order, word)
    r = F.col("n__") - F.col("i__") + 1
    return placed.groupBy(key).agg(*_sums(r, F.col("w__"), ("a", "b", "c", "d")))


def fletcher2(df: DataFrame, key: str, order: Sequence[str], word: str) -> DataFrame:
    """Rows (key, a0, a1, b0, b1): two running sums over each of two interleaved lanes (an odd last word counts in the first)."""
    placed = _places(df, key, order, word).withColumn("lane", (F.col("i__") + 1) % 2)
    # place within the lane, counted from its end
    count = F.floor((F.col("n__") + 1 - F.col("lane")) / 2)
    r = count - F.floor((F.col("i__") - 1) / 2)
    zero = F.lit(0).cast("decimal(20,0)")
    sums = []
    for lane in (0, 1):
        w = F.when(F.col("lane") == lane, F.col("w__")).otherwise(zero)
        sums += _sums(F.when(F.col("lane") == lane, r).otherwise(F.lit(0)).cast("long"), w, (f"a{lane}", f"b{lane}"))
    return placed.groupBy(key).agg(*sums)


def verdict(stored: Column, computed: Column, known: Column) -> Column:
    """ok, mismatch, or unverified where the kind of checksum is not known."""
    return F.when(~known, "unverified").when(stored.eqNullSafe(computed), "ok").otherwise("mismatch")
