"""Exponential smoothing over histories of any length, by windows alone.

``y = y + k (x - y)`` is an affine map of y, and a missing value is the identity. Inside a block of values the maps compose to a running sum of
``k x`` weighted by powers of ``1 - k``; a block is sized so that these powers stay far from the end of a double's range. What enters
a block is a weighted sum over the few blocks before it that a double can still tell: one row per block, no chain and no repeated rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ordered import plain_keys, scan
from tidemark.session import chunk_rows

c, lit, when = F.col, F.lit, F.when


def smoothed(df: DataFrame, keys, order, grain, value: str, n: int, k: float, out: str, count: str | None = None) -> DataFrame:
    """Adds ``out``: the smoothing of ``value`` with gain ``k``, seeded with the mean of its first ``n`` values.

    Null before the seed; a missing value changes nothing, and its row tells the last result. ``count`` names a column for the number
    of values so far.
    """
    if not 0.0 < k < 1.0:
        raise ValueError("a gain lies between 0 and 1")
    w = 1.0 - k
    size = max(1, min(int(230.0 / -math.log(w)), chunk_rows(df.sparkSession)))  # w ** -size stays below 1e100
    reach = max(1, math.ceil(42.0 / (size * -math.log(w))))  # blocks until w ** rows falls below 1e-18
    there = F.col(value).isNotNull() & ~F.isnan(c(value))
    x = scan(df, keys, order, grain, _n=("count", when(there, 1)), _s=("sum", when(there, c(value))))
    # rows before the first value lie in the first block too
    x = x.withColumn("_m", F.floor((F.greatest(c("_n"), lit(1)) - 1) / size)).withColumn("_j", F.greatest(c("_n"), lit(1)) - 1 - c("_m") * size)
    made = plain_keys(df, keys)
    by = [*made, "_m"]
    term = when(there & (c("_n") == n), c("_s") / n).when(there & (c("_n") > n), c(value) * k)
    x = x.withColumns({**made, "_term": F.coalesce(term * F.pow(lit(w), -c("_j")), lit(0.0))})
    here = F.sum("_term").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    ends = x.groupBy(*by).agg((F.sum("_term") * (w ** (size - 1))).alias("_end"))
    before = Window.partitionBy(*made).orderBy("_m").rowsBetween(-reach, -1)
    past = F.collect_list(F.struct("_m", "_end")).over(before)
    into = F.aggregate(past, lit(0.0), lambda s, e: s + e["_end"] * F.pow(lit(w ** size), c("_m") - e["_m"] - 1))
    x = x.withColumn("_here", here).join(ends.withColumn("_into", into).select(*by, "_into"), by)
    y = F.pow(lit(w), c("_j")) * (c("_here") + w * c("_into"))
    return x.select(*df.columns, when(c("_n") >= n, y).alias(out), *([c("_n").alias(count)] if count else []))
