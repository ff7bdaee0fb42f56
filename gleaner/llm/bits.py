"""A bit table of bounded size that tells which rows can't have a partner, before they are shuffled."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits in the table: 8 for every number at most, from 128 KB to 32 MB. Beyond 30 million numbers it gets fuller and drops
#: less; it never drops a partner.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
_BUCKET = 32768


class Filter:
    """Built on the cluster as bitmaps of 4 KB; ``holds`` is false only for numbers that ``df`` hasn't. ``most``: how many
    different numbers ``df`` holds at most."""

    def __init__(self, df: DataFrame, column: str, most: int):
        self.bits = min(MOST_BITS, max(LEAST_BITS, 1 << (8 * most).bit_length()))
        at = F.pmod(F.col(column), F.lit(self.bits)) + 1
        rows = df.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap")).collect()  # MOST_BITS / 32768 rows
        table = np.zeros(self.bits // 8, dtype=np.uint8)
        for r in rows:
            table[(r["bucket"] - 1) * _BUCKET // 8 : r["bucket"] * _BUCKET // 8] = np.frombuffer(bytes(r["bitmap"]), dtype=np.uint8)
        self.sent = df.sparkSession.sparkContext.broadcast(table)

    def holds(self, numbers: np.ndarray) -> np.ndarray:
        at = np.mod(numbers, self.bits)
        return (self.sent.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
