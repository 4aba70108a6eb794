"""Bounded samples for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = 1_000_000


def bounded_sample(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """``n`` rows of the lowest hash of ``keys``, or all if there are fewer.

    Rows are counted, and a hash threshold keeps about a third more than ``n`` before anything is ordered or moved, so tasks send
    a bounded number of rows together, whatever their number. (Should the threshold keep fewer than ``n``, the sample is smaller.)
    """
    total = df.count()
    h = F.xxhash64(*keys)
    if total > n:
        df = df.where(F.pmod(h, F.lit(PARTS)) < int(min(1.0, (1.3 * n + 100) / total) * PARTS) + 1)
    return df.orderBy(F.pmod(h, F.lit(PARTS)), h, *keys).limit(n)
