"""Rows of a wide or long table for a set of ids: few columns read, few rows shuffled, exactly the semi join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.sources.staging import staged

#: Ids, counted, that are broadcast as they are; places of the bitmap otherwise (2^25: at most 1024 rows of 4 KB).
FEW, PLACES = 20_000, 1 << 25


def _may_hold(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose ``key`` may be one of ``ids``: hashes of the ids as one bitmap of at most 4 MB, whatever their number."""
    place = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(PLACES))
    low = lambda p: p.bitwiseAND(32767)
    table = ids.groupBy(F.shiftright(place, 15).alias("_at")).agg(F.bitmap_construct_agg(low(place)).alias("_bits"))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.shiftright(low(place), 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = F.getbit(byte, low(place).bitwiseAND(7).cast("int")) == 1
    return df.join(F.broadcast(staged(table, "bitmap")), F.shiftright(place, 15) == F.col("_at")).where(met).select(*df.columns)


def rows_of(df: DataFrame, key: str, ids: DataFrame, columns: list[str], few: int = FEW) -> DataFrame:
    """``columns`` of the rows of ``df`` whose ``key`` is among those of ``ids``; a NULL key never is.

    The columns are chosen first, so a scan reads no others. Up to ``few`` ids are broadcast; of more, a bitmap keeps
    rows that can't match from being shuffled, and a join makes the rest exact.
    """
    slim = df.select(*dict.fromkeys([key, *columns]))
    own = ids.select(key).where(F.col(key).isNotNull()).distinct()
    if own.count() <= few:
        return slim.join(F.broadcast(own), key, "left_semi").select(*columns)
    return _may_hold(slim, key, own).join(own, key, "left_semi").select(*columns)
