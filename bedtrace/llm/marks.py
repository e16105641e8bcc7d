"""Bitmaps of fixed size over 64-bit values: a screen that may be broadcast or visit the driver at any size of the data.

A crowded bitmap lets more rows pass; whatever passes is decided by an exact join afterwards.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bedtrace.session import cut_lineage

MARK_BITS = 1 << 27  # 16 MB
SMALL_BITS = 1 << 24  # 2 MB


def marked(values: DataFrame, col: str) -> np.ndarray:
    """Bitmap of MARK_BITS bits of a column of longs; its size is fixed, so it may visit the driver."""
    at = F.pmod(F.col(col), F.lit(MARK_BITS)) + 1  # Spark counts bits of positive numbers from 1
    rows = values.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros(MARK_BITS // 8, np.uint8)
    for r in rows:
        out[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def is_marked(bits: np.ndarray, v: np.ndarray) -> np.ndarray:
    at = v & (MARK_BITS - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def split_by_marks(df: DataFrame, col: str, values: DataFrame, of: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` that can be among ``values``, and rows that are not, by a bitmap of fixed size; null ``col``: not."""
    at = lambda c: F.pmod(F.col(c), F.lit(SMALL_BITS)) + 1
    marks = cut_lineage(values.groupBy(F.bitmap_bucket_number(at(of)).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at(of))).alias("__bits")))
    place = F.bitmap_bit_position(at(col))
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    both = df.withColumn("__bucket", F.bitmap_bucket_number(at(col))).join(F.broadcast(marks), "__bucket", "left")
    both = both.withColumn("__hit", F.coalesce(F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1, F.lit(False)))
    return both.filter("__hit").select(*df.columns), both.filter("not __hit").select(*df.columns)
