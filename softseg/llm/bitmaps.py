"""Bitmaps of key hashes: a bounded broadcast by which rows whose key is not among given ones leave a scan.

A bit that is set may stand for several keys, so what passes has to be joined
with the keys; what does not pass is not among them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each key, and of a bitmap at most (64 MB); a fuller one lets more rows through, and the result is the same.
KEY_BITS, MAX_BITS = 16, 1 << 29
_PAGE = 1 << 15


@dataclass
class Bitmap:
    pages: DataFrame
    bits: int

    def _place(self, key: Column) -> tuple[Column, Column]:
        place = F.pmod(key, F.lit(self.bits))
        return F.shiftright(place, 15).cast("int"), place.bitwiseAND(F.lit(_PAGE - 1)).cast("int")

    def passed(self, rows: DataFrame, key: str) -> DataFrame:
        """Rows whose ``key``, a long, may be among the keys; their pages are at most MAX_BITS bits."""
        page, bit = self._place(F.col(key))
        byte = F.conv(F.hex(F.substring("_bitmap", F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
        held = rows.withColumn("_page", page).join(F.broadcast(self.pages), "_page")
        return held.filter(F.getbit(byte, bit.bitwiseAND(F.lit(7))) == 1).select(*rows.columns)


def bitmap_of(keys: DataFrame, key: str) -> Bitmap:
    """The bitmap of the values of ``key``, a long; ``keys`` is read twice, so hand over a written table."""
    count, bits = keys.count(), _PAGE
    while bits < min(MAX_BITS, KEY_BITS * count):
        bits *= 2
    out = Bitmap(keys, bits)
    page, bit = out._place(F.col(key))
    out.pages = keys.select(page.alias("_page"), bit.cast("long").alias("bit")).groupBy("_page").agg(F.bitmap_construct_agg("bit").alias("_bitmap"))
    return out
