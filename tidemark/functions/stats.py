"""Exact quantiles, ranks and buckets on groups of any size, and the normal distribution.

For ranks a group is first reduced to its distinct values with counts; cumulative counts over those
come from the two-level scan, cut by counted ranges of values (``ordered.Cut``).  Quantiles need
the values of a few ranges alone, which are found by counting.  No task sees a whole group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ordered import MANY, Cut, chunked, plain_keys, scan
from tidemark.session import chunk_rows

c, lit, when = F.col, F.lit, F.when
#: First width of the ranges on the axis of :func:`value_axis`, which spans about 25,000.
WIDE = 4096.0
#: Widths on that axis of the bins in which :func:`quantiles` counts: 1.6 % of a value, then each cut in 65,536.
BINS = (2.0 ** -2, 2.0 ** -18, 2.0 ** -34)


def value_axis(x: Column) -> Column:
    """Order-preserving place of a number, fine near zero and logarithmic far out; NaN stands last, as in Spark's order.

    ``asinh`` is taken of the size alone: of a large negative number it is the logarithm of a rounding error.
    """
    x = x.cast("double")
    return when(F.isnan(x), 3e5).otherwise(F.signum(x) * F.least(F.asinh(F.abs(x) * 1000.0) * 16.0, lit(2e5)))


def _cut_by_value(df: DataFrame, keys, col: str) -> tuple[DataFrame, Column]:
    """Rows with ``_g``: the range of values they lie in, as many for a group as its rows ask for."""
    x = chunked(df.withColumn("_u", value_axis(c(col))), keys, Cut("_u", WIDE), "_g", times=9)
    return x.drop("_u"), c("_g")


def histogram_counts(df: DataFrame, keys, col: str) -> DataFrame:
    """Distinct values with ``n``, the running count ``cum`` and the group's ``total``."""
    keys = list(keys)
    h = df.where(c(col).isNotNull()).groupBy(*keys, col).agg(F.count(lit(1)).alias("n"))
    h, range_ = _cut_by_value(h, keys, col)
    return scan(h, keys, [col], range_, cum=("sum", "n")).drop("_g")


def quantile_places(total: Column, probs: dict[str, float], rule: str) -> dict[str, tuple[Column, Column]]:
    """Zero-based places, among ``total`` values in order, of the two values that each quantile lies between."""
    places = {}
    for name, q in probs.items():
        if rule == "linear":
            pos = (total - 1) * lit(float(q))
            places[name] = F.floor(pos), F.ceil(pos)
        elif rule == "upper":
            places[name] = (F.least(F.floor(total * lit(float(q))), total - 1),) * 2
        else:
            places[name] = (F.bround((total - 1) * lit(float(q)), 0).cast("long"),) * 2
    return places


def quantile_values(values: DataFrame, by, more: list, probs: dict[str, float], rule: str) -> DataFrame:
    """Quantiles from the values ``_v`` at places ``_before`` to ``_before + _n`` of a group of ``_total``; ``more`` are aggregates to keep."""
    places = quantile_places(c("_total"), probs, rule)
    at = lambda k: F.max(when((c("_before") <= k) & (k < c("_before") + c("_n")), c("_v")))
    ends = [at(k).alias(f"{name}__{end}") for name, pair in places.items() for end, k in zip(("lo", "hi"), pair)]
    g = values.groupBy(*by).agg(*more, F.first("_total").alias("_total"), *ends)
    out = {}
    for name, q in probs.items():
        lo, hi = c(f"{name}__lo"), c(f"{name}__hi")
        pos = (c("_total") - 1) * lit(float(q))
        out[name] = lo + (hi - lo) * (pos - F.floor(pos)) if rule == "linear" else lo
    return g.withColumns(out).drop("_total", *[f"{name}__{end}" for name in probs for end in ("lo", "hi")])


def quantile_bins(counts: DataFrame, by, probs: dict[str, float], rule: str) -> DataFrame:
    """Of bins ``_b`` with ``_n`` values, those that a quantile lies in: with ``_before``, the values in earlier bins, and ``_total``.

    Bins inside bins come with the ``_p`` they are in and its ``_before`` and ``_total``.
    """
    inner = "_p" in counts.columns
    over = Window.partitionBy(*by, *(["_p"] if inner else []))
    upto = F.sum("_n").over(over.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - c("_n")
    counts = counts.withColumns({"_before": upto + c("_before") if inner else upto, "_total": c("_total") if inner else F.sum("_n").over(over)})
    places = quantile_places(c("_total"), probs, rule)
    hit = lit(False)
    for k in {str(k): k for pair in places.values() for k in pair}.values():
        hit = hit | ((c("_before") <= k) & (k < c("_before") + c("_n")))
    return counts.where(hit).drop("_p")


def ordered_values(values: DataFrame, by) -> DataFrame:
    """``_before`` of distinct values ``_v`` that come ``_n`` times, from that of the bin ``by`` they are in."""
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return values.withColumn("_before", c("_before") + upto - c("_n"))


def quantile_bin(value: Column, level: int = 0) -> Column:
    return F.floor(value_axis(value) / BINS[level])


def quantiles(df: DataFrame, keys, col: str, probs: dict[str, float], rule: str = "linear") -> DataFrame:
    """Exact quantiles per group; null values count for nothing, null keys are a group.

    ``linear`` interpolates between neighbours, ``upper`` takes index n*q (upper median),
    ``nearest`` rounds the index half to even.

    A job counts the values in bins of their range, which are reduced before the shuffle; the few bins that the quantiles lie in are sent to all tasks, and
    those with more rows than ``chunkRows`` are cut finer by a further job.  Only their values are then grouped and ordered.  Groups with
    more than ``MANY`` such bins are counted whole instead.
    """
    keys = list(keys)
    x = df.where(c(col).isNotNull()).select(*keys, c(col).alias("_v"))
    made = plain_keys(x, keys) or {"_q0": lit(0)}
    by, spark = [*made], df.sparkSession
    x, own = x.withColumns(made), [F.first(k).alias(k) for k in keys]
    bins, level = None, 0
    for level in range(len(BINS)):
        inside, here = [*by], quantile_bin(c("_v"), level)
        rows = x.withColumn("_b", here)
        if bins is not None:
            rows = x.withColumns({"_p": quantile_bin(c("_v"), level - 1), "_b": here}).join(bins, [*by, "_p"])
            inside += ["_p", "_before", "_total"]
        n = rows.groupBy(*inside, "_b").agg(F.count(lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        frame = quantile_bins(n, by, probs, rule)
        some = frame.limit(MANY + 1).collect()
        if len(some) > MANY:
            break
        bins = F.broadcast(spark.createDataFrame(some, frame.schema).select(*by, c("_b").alias("_p"), "_before", "_total"))
        if all(r["_n"] <= chunk_rows(spark) or r["_lo"] == r["_hi"] for r in some):
            break
    if bins is None or len(some) > MANY:
        h = histogram_counts(x, by, "_v").withColumn("_before", c("cum") - c("n")).withColumnRenamed("n", "_n")
        h = h.join(x.groupBy(*by).agg(F.count(lit(1)).alias("_total"), *own), by)
    else:
        h = x.withColumn("_p", quantile_bin(c("_v"), level)).join(bins, [*by, "_p"])
        h = ordered_values(h.groupBy(*by, "_p", "_before", "_total", "_v").agg(F.count(lit(1)).alias("_n"), *own), [*by, "_p"])
    return quantile_values(h, by, own, probs, rule).select(*keys, *probs)


def average_ranks(df: DataFrame, keys, cols: dict[str, str]) -> DataFrame:
    """Add average ranks (ties share the mean rank) of ``cols`` within the group."""
    keys = list(keys)
    for col, out in cols.items():
        h = histogram_counts(df, keys, col).select(
            *keys, c(col), (c("cum") - c("n") + (c("n") + 1) / 2.0).alias(out))
        df = df.join(h, [*keys, col])
    return df


def bucket_of_rank(rank: Column, n: Column, q: Column | int) -> Column:
    """Quantile bucket 1..q of rank 1..n: equal-frequency edges by linear interpolation.

    This is not ``ntile``: edge k lies at position (n - 1) * k / q and a rank belongs to the
    first bucket whose upper edge is not below it.
    """
    q = lit(q) if isinstance(q, int) else q

    def edge(k):
        p = (k.cast("double") * (lit(1.0) / q)) * 100.0 / 100.0
        pos = (n - 1) * p
        frac = pos - F.floor(pos)
        return when(frac >= 0.5, F.floor(pos) + 2 - (1 - frac)).otherwise(F.floor(pos) + 1 + frac)

    edges = F.sequence(lit(0), F.greatest(q.cast("int") - 1, lit(0)))
    return F.size(F.filter(edges, lambda k: (k == 0) | (edge(k) < rank)))


def corr0(a: str, b: str) -> Column:
    """Pearson correlation as an aggregate; null when either side is constant."""
    flat = (F.min(a) == F.max(a)) | (F.min(b) == F.max(b))
    return when(~flat, F.corr(a, b))


def _poly(coeffs, x):
    out = coeffs[0]
    for k in coeffs[1:]:
        out = out * x + k
    return out


# Coefficients of published approximations.
# Normal CDF: Hart (1968), as given by West, "Better approximations to cumulative normal functions" (2005).
CDF_NUM = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871,
           221.213596169931, 220.206867912376)
CDF_DEN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674,
           637.333633378831, 793.826512519948, 440.413735824752)
# Normal quantile: Wichura, algorithm AS 241 (1988).
PPF_MID_NUM = (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457,
               13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608)
PPF_MID_DEN = (5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867,
               5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0)
PPF_TAIL_NUM = (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258,
                3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734)
PPF_TAIL_DEN = (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459,
                0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0)
PPF_FAR_NUM = (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093,
               0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772)
PPF_FAR_DEN = (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4,
               0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0)


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function, absolute error below 1e-14."""
    a = F.abs(x)
    e = F.exp(-a * a / 2.0)
    near = e * _poly(CDF_NUM, a) / _poly(CDF_DEN, a)
    far = e / (a + 1.0 / (a + 2.0 / (a + 3.0 / (a + 4.0 / (a + 0.65))))) / 2.506628274631
    tail = when(a > 37, 0.0).when(a < 7.07106781186547, near).otherwise(far)
    return when(x > 0, 1.0 - tail).otherwise(tail)


def normal_ppf(p: Column) -> Column:
    """Standard normal quantile, relative error about 1e-16; null outside (0, 1)."""
    q = p - 0.5
    r = lit(0.180625) - q * q
    mid = _poly(PPF_MID_NUM, r) * q / _poly(PPF_MID_DEN, r)
    t = F.sqrt(-F.ln(F.least(p, 1.0 - p)))
    tail = when(t <= 5.0, _poly(PPF_TAIL_NUM, t - 1.6) / _poly(PPF_TAIL_DEN, t - 1.6)).otherwise(
        _poly(PPF_FAR_NUM, t - 5.0) / _poly(PPF_FAR_DEN, t - 5.0))
    return when((p > 0) & (p < 1), when(F.abs(q) <= 0.425, mid).otherwise(when(q < 0, -tail).otherwise(tail)))


def sql_normal_cdf(x: str) -> str:
    poly = lambda cs: _sql_poly(cs, f"abs({x})")
    return (f"(CASE WHEN {x} > 0 THEN 1 - exp(-({x})*({x})/2) * {poly(CDF_NUM)} / {poly(CDF_DEN)} "
            f"ELSE exp(-({x})*({x})/2) * {poly(CDF_NUM)} / {poly(CDF_DEN)} END)")


def _sql_poly(coeffs, x):
    out = f"{coeffs[0]!r}"
    for k in coeffs[1:]:
        out = f"({out} * {x} + {k!r}::DOUBLE)"
    return out


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.least(x, lit(30.0)), lit(-30.0))))


EULER_GAMMA = 0.5772156649
E_NUMBER = math.e


def cross_ranks(df: DataFrame, keys, col: str, avg: str | None = None, first: str | None = None, tie: str | None = None,
                size: str | None = None) -> DataFrame:
    """Ranks of ``col`` within each group, in one pass over ranges of its values.

    ``avg`` gives tied values their mean rank, ``first`` orders ties by ``tie``, ``size`` is
    the group size.  A group is spread over its ranges, so a large one is never sorted whole; null and NaN have no rank.
    """
    keys = list(keys)
    by = [*keys, "_b"]
    rows, range_ = _cut_by_value(df.where(c(col).isNotNull() & ~F.isnan(c(col).cast("double"))), keys, col)
    rows = rows.withColumn("_b", range_)
    heads = rows.groupBy(*by).agg(F.count(lit(1)).alias("_n"))
    over = Window.partitionBy(*keys)
    heads = heads.withColumns({
        "_before": F.coalesce(F.sum("_n").over(over.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), lit(0)),
        "_size": F.sum("_n").over(over)}).drop("_n")
    w = Window.partitionBy(*by).orderBy(col)
    made = {}
    if avg:
        made["_avg"] = F.rank().over(w) + (F.count(lit(1)).over(w.rangeBetween(0, 0)) - 1) / 2.0
    if first:
        made["_first"] = F.row_number().over(Window.partitionBy(*by).orderBy(col, tie))
    out = rows.withColumns(made).join(heads, by)
    res = []
    if avg:
        res.append((c("_before") + c("_avg")).alias(avg))
    if first:
        res.append((c("_before") + c("_first")).alias(first))
    if size:
        res.append(c("_size").alias(size))
    return out.select(*df.columns, *res)
