"""TOP n PERCENT and TOP n WITH TIES for DataFrames, without sorting everything into one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top_percent(frame: DataFrame, percent: float, *order: Column) -> DataFrame:
    """The first ceil(percent * rows / 100) rows. One job counts, the other keeps a limit; frame has to be the same to both."""
    if percent < 0:
        raise ValueError("a percentage is 0 or more")
    return frame.orderBy(*order).limit(math.ceil(percent * frame.count() / 100))


def with_ties(frame: DataFrame, n: int, *keys: str, descending: bool = False) -> DataFrame:
    """The first n rows by keys, and all that equal the n-th in them. NULL is least. The n-th row's keys are found by a limit,
    which every task applies to its own rows first."""
    if n <= 0:
        return frame.limit(0)
    order = [F.col(k).desc_nulls_last() if descending else F.col(k).asc_nulls_first() for k in keys]
    last = frame.select(*keys).orderBy(*order).limit(n).collect()
    if len(last) < n:
        return frame
    # Before or equal, key by key.
    found = F.lit(True)
    for k in reversed(keys):
        v = F.lit(last[-1][k]).cast(frame.schema[k].dataType)
        c = F.col(k)
        if last[-1][k] is None:
            before = c.isNotNull() if descending else F.lit(False)
        else:
            before = (c > v) if descending else (c.isNull() | (c < v))
        found = F.coalesce(before, F.lit(False)) | (c.eqNullSafe(v) & found)
    return frame.where(found)
