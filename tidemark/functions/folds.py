"""Recurrences over one chunk of a series, as array expressions in the JVM.

A recurrence ``y = y + k (x - y)`` forgets: after ``memory(k)`` rows the start value
weighs less than the rounding of a double.  A chunk with that many earlier rows
therefore gives the same numbers as the whole history, and chunks need no chain.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordered import Cut, placed_rows, plain_keys

BLOCK = 64


def memory(k: float) -> int:
    """Rows after which a start value has weight below 1e-18."""
    keep = 1.0 - k
    return 1 if keep <= 0 else math.ceil(42.0 / -math.log(keep))


def run(arr: Column, zero: Column, step) -> Column:
    """All states of a fold: ``step(state, element)`` gives the next state.

    Works in blocks, so that growing the output copies little.
    """
    def block(done, part):
        grown = F.aggregate(
            part,
            F.array(F.element_at(F.element_at(done, -1), -1)),
            lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))),
        )
        return F.concat(done, F.array(F.slice(grown, 2, BLOCK)))

    parts = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(arr) - 1) / BLOCK).cast("int")),
        lambda i: F.slice(arr, i * BLOCK + 1, BLOCK),
    )
    return F.flatten(F.slice(F.aggregate(parts, F.array(F.array(zero)), block), 2, 1 << 30))


def smooth(arr: Column, n: int, gain, start: float | None = None, value=None, skip: bool = False) -> Column:
    """Exponential smoothing of an array, seeded with the mean of the first ``n`` values.

    A null restarts the seeding, or with ``skip`` changes nothing.  ``gain`` is a number or a function of the element;
    ``start`` gives the state before the first value instead of a seed.
    """
    value = value or (lambda x: x)
    rate = gain if callable(gain) else (lambda x: F.lit(float(gain)))
    null = F.lit(None).cast("double")
    zero = F.struct(
        (null if start is None else F.lit(float(start))).alias("y"),
        F.lit(0).alias("c"),
        F.lit(0.0).alias("s"),
    )

    def step(p, x):
        v = value(x)
        seeded = p["y"].isNotNull()
        y = (
            F.when(v.isNull(), null if start is None and not skip else p["y"])
            .when(seeded, p["y"] + rate(x) * (v - p["y"]))
            .when(p["c"] + 1 == n, (p["s"] + v) / n)
        )
        c = F.when(v.isNull(), p["c"] if skip else F.lit(0)).when(seeded, 0).otherwise(p["c"] + 1)
        s = F.when(v.isNull(), p["s"] if skip else F.lit(0.0)).when(seeded, 0.0).otherwise(p["s"] + v)
        return F.struct(y.alias("y"), c.alias("c"), s.alias("s"))

    return F.transform(run(arr, zero, step), lambda p: p["y"])


def shift(arr: Column, n: int) -> Column:
    """The array moved n places later, nulls in front."""
    return F.slice(F.concat(F.array_repeat(F.lit(None).cast("double"), n), arr), F.lit(1), F.size(arr))


class Chunk:
    """The arrays of one chunk and the steps computed from them.

    Every step becomes a column of its own: an array used inside a lambda must be
    computed before, or it would be computed again for each element.  With ``skip`` its
    smoothings go on over missing values, else they start again after one.
    """

    def __init__(self, fields, skip: bool = False):
        self.fields, self.skip = set(fields), skip
        self.steps: list[tuple[str, Column]] = []

    def __getitem__(self, name: str) -> Column:
        if name not in self.fields:
            raise KeyError(name)
        return F.col(name)

    def let(self, expr: Column) -> Column:
        name = f"_s{len(self.steps)}"
        self.steps.append((name, expr))
        return F.col(name)

    def smooth(self, arr, n, gain, **more):
        return self.let(smooth(arr, n, gain, skip=self.skip, **more))

    def ema(self, arr, n):
        return self.let(smooth(arr, n, 2.0 / (n + 1.0), skip=self.skip))

    def wilder(self, arr, n):
        return self.let(smooth(arr, n, 1.0 / n, skip=self.skip))

    def zip(self, a, b, f):
        return self.let(F.zip_with(a, b, f))

    def minus(self, a, b):
        return self.zip(a, b, lambda x, y: x - y)

    def map(self, a, f):
        return self.let(F.transform(a, f))

    def shift(self, a, n):
        return self.let(shift(a, n))

    def cumsum(self, arr):
        zero = F.struct(F.lit(0.0).alias("y"))
        states = self.let(run(arr, zero, lambda p, x: F.struct((p["y"] + F.coalesce(x, F.lit(0.0))).alias("y"))))
        return self.map(states, lambda p: p["y"])

    def apply(self, df):
        for name, expr in self.steps:
            df = df.withColumn(name, expr)
        return df


def chunk_entries(heads: DataFrame, keys, start: Column, step) -> DataFrame:
    """State entering each chunk, from one summary ``m`` per chunk ``_k``: (keys, _k, e)."""
    g = heads.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_k", "m"))).alias("h"))
    g = g.select(*keys, F.col("h._k").alias("k"), F.concat(F.array(start), run(F.col("h"), start, step)).alias("s"))
    g = g.select(*keys, F.explode(F.arrays_zip("k", "s")).alias("e")).where("e.k IS NOT NULL")
    return g.select(*keys, F.col("e.k").alias("_k"), F.col("e.s").alias("e"))


def affine(df: DataFrame, keys, order, grain: Column | Cut, a: Column, b: Column, out: str, placed=None, seen: Column | None = None) -> DataFrame:
    """``y = a * y_before + b`` per key in order, from 0; adds ``out`` (after) and ``out_before``.

    Affine maps compose, so a chunk is one pair (A, B): pairs are folded per key, then all
    chunks run at once.  Rows of a null key are a key of their own.  ``placed`` names columns that the rows are shuffled by already, the chunk
    last: they are read twice, once for the pairs, instead of being shuffled again; ``seen`` is then an aggregate that keeps all their columns.
    """
    step = [*order, a.alias("_a"), b.alias("_b2")]
    if placed:
        rows, keys = df.withColumn("_k", F.col(placed[-1])), placed[:-1]
        item = F.struct(*step, F.struct(*[n for n in df.columns if n not in placed]).alias("row"))
    else:
        made, item = plain_keys(df, keys), F.struct(*step, F.struct(*df.columns).alias("row"))
        rows = placed_rows(df, keys, grain).withColumns({**made, "_item": item}).withColumnRenamed("_b", "_k")
        keys, item = [*made], F.col("_item")
    g = rows.groupBy(*keys, "_k").agg(F.array_sort(F.collect_list(item)).alias("rows"))
    steps = g
    if placed:
        steps = rows.groupBy(*keys, "_k").agg(F.array_sort(F.collect_list(F.struct(*step))).alias("rows"), seen.alias("_seen")).where("_seen >= 0")
    unit = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    pair = F.aggregate("rows", unit, lambda s, x: F.struct(
        (x["_a"] * s["a"]).alias("a"), (x["_a"] * s["b"] + x["_b2"]).alias("b")))
    zero = F.struct(F.lit(0.0).alias("y"), F.lit(0.0).alias("p"))
    entry = chunk_entries(steps.select(*keys, "_k", pair.alias("m")), keys, zero, lambda s, x: F.struct(
        (x["m"]["a"] * s["y"] + x["m"]["b"]).alias("y"), s["y"].alias("p")))
    done = g.join(entry, [*keys, "_k"]).select("rows", run(F.col("rows"), F.col("e"), lambda s, x: F.struct(
        (x["_a"] * s["y"] + x["_b2"]).alias("y"), s["y"].alias("p"))).alias("s"))
    return done.select(F.explode(F.arrays_zip("rows", "s")).alias("z")).select(
        "z.rows.row.*", F.col("z.s.y").alias(out), F.col("z.s.p").alias(f"{out}_before"))
