"""A bitmap of keys that is small enough to broadcast: what is not marked need not move.

A key sets one bit of ``2**bits``; a set bit may be another key's, so a mark only says that a row may be wanted, and what
decides comes later.  The number of bits follows the number of keys, up to ``2**MOST_BITS`` (16 MiB); with more keys than
that more rows move in vain, and the result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BITS = 27
#: Bits of one row of the bitmap functions (4096 bytes).
ROW_BITS = 32768


def bits_for(keys: int) -> int:
    """Bits, as a power of 2, of which ``keys`` keys set a sixteenth at most, or as many as there may be."""
    return min(MOST_BITS, max(16, (16 * max(keys, 1) - 1).bit_length()))


def bitmap(keys: DataFrame, key: Column, bits: int) -> DataFrame:
    """Rows (bucket, bitmap) for the 64-bit integers ``key`` of ``keys``, ``2**bits / 32768`` rows at most."""
    place = F.pmod(key, F.lit(1 << bits))
    return keys.select(place.alias("place")).groupBy((F.col("place") / ROW_BITS).cast("int").alias("bucket")).agg(F.expr(f"bitmap_construct_agg(place % {ROW_BITS})").alias("bitmap"))


def marked(rows: DataFrame, key: Column, marks: DataFrame, bits: int, flag: str | None = None) -> DataFrame:
    """The rows of ``rows`` whose key is marked or, with the name of a ``flag``, all rows and if they are."""
    place = F.pmod(key, F.lit(1 << bits))
    sought = rows.select(F.struct("*").alias("row"), (place / ROW_BITS).cast("int").alias("at"), (place % ROW_BITS).cast("int").alias("in_row"))
    byte = F.conv(F.hex(F.expr("substring(bitmap, in_row div 8 + 1, 1)")), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.expr("shiftleft(1, in_row % 8)")) > 0
    found = sought.join(F.broadcast(marks), F.col("at") == F.col("bucket"), "left" if flag else "inner")
    return found.select("row.*", F.coalesce(bit, F.lit(False)).alias(flag)) if flag else found.where(bit).select("row.*")
