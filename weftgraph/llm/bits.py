"""A set of 64-bit keys as a bit table of fixed size, for dropping rows at the scan before anything is shuffled.

A key in the set always tests true; another one seldom does, as long as the table is not full. A full table
drops nothing, so what follows must be an exact join; the table only spares it rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import private

#: Bits of one cell: what Spark's bitmap functions put in one binary value.
CELL = 32_768


def key_bits(key: Column, cells: int) -> Column:
    """A positive number of `cells` cells of bits, from any key."""
    return F.pmod(F.xxhash64(key, F.lit("bits")), F.lit(cells * CELL)) + 1


#: Cells of the largest table, 8 MB.
MOST_CELLS = 2048


def cells_for(keys: int) -> int:
    """A power of two of cells, with 16 bits for each key as long as that is at most MOST_CELLS."""
    return min(MOST_CELLS, 1 << max(0, (16 * keys // CELL).bit_length()))


def bit_table(keys: DataFrame, column: str, cells: int) -> DataFrame:
    """cell, bits: at most `cells` rows of 4 kB, however many keys there are."""
    at = keys.select(key_bits(F.col(column), cells).alias("at"))
    return at.groupBy(F.bitmap_bucket_number("at").alias("cell")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))


def may_hold(rows: DataFrame, key: Column, table: DataFrame, cells: int) -> DataFrame:
    """The rows whose key may be in the set; null keys are not. The table goes to every executor: its size is
    bounded by `cells`."""
    at, cell, bits = private(rows, "at", "cell", "bits")
    asked = rows.withColumn(at, key_bits(key, cells)).filter(key.isNotNull())
    met = asked.join(F.broadcast(table.select(F.col("cell").alias(cell), F.col("bits").alias(bits))), F.bitmap_bucket_number(at) == F.col(cell))
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(place, F.lit(8)))), F.lit(2)) == 1
    return met.filter(held).select(*[F.col(f"`{c}`") for c in rows.columns])
