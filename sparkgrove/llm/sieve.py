"""Sieves: bitmaps of hashed keys, of bounded size, that let rows pass whose key may be in a set.

A key's hash names one of ``n`` bits. The bitmap is sent to all tasks in pieces of 4 KB, and
a row goes on if its key's bit is set: all rows of the set do, and a few others. What goes
on is joined exactly afterwards, so a sieve changes what a join has to move and never its
result. Beyond ``MAX_BITS`` the bitmap does not grow; then it only lets more rows pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each key, and of a bitmap at most: 32 MB are sent to all tasks.
BITS_A_KEY, MAX_BITS = 64, 1 << 28


def bits_for(n: int) -> int:
    """Bits of a bitmap for ``n`` keys: a power of two, at least one piece of 4 KB."""
    return min(MAX_BITS, max(1 << 15, 1 << (n * BITS_A_KEY - 1).bit_length()))


def _place(bits: int, columns: list) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(bits)) + 1


def sieve(keys: DataFrame, columns: list, bits: int) -> DataFrame:
    """Pieces of the bitmap of ``keys``' ``columns``: __piece, __bitmap."""
    at = keys.select(_place(bits, columns).alias("at"))
    return at.groupBy(F.bitmap_bucket_number("at").alias("__piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("__bitmap"))


def flagged(df: DataFrame, columns: list, through: DataFrame, bits: int, flag: str) -> DataFrame:
    """``df`` with a boolean column: whether ``columns`` may be among the keys of the sieve
    ``through``."""
    placed = df.select("*", _place(bits, columns).alias("__at")).withColumn("__bit", F.bitmap_bit_position("__at"))
    met = placed.join(F.broadcast(through), F.bitmap_bucket_number("__at") == F.col("__piece"), "left")
    byte = F.conv(F.hex(F.substring("__bitmap", F.floor(F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_ = F.call_function("shiftright", byte, (F.col("__bit") % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return met.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(set_, F.lit(False)).alias(flag))


def sifted(df: DataFrame, columns: list, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``columns`` may be among those of ``keys``, a written table."""
    bits = bits_for(keys.count())
    return flagged(df, columns, sieve(keys, columns, bits), bits, "__met").where("__met").drop("__met")
