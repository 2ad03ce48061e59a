"""Supertrend: two keep-or-reset bands and a direction, over chunks of a symbol.

Neither recurrence is linear, yet a chunk acts on the value that enters it in a simple
way.  A band value stays while ``lo <= y <= hi`` and becomes ``r`` otherwise, so it
leaves at one of the few rows where the running band narrows and what follows does not
depend on it.  The direction has two states, so a chunk is a pair of results.  Chunks
are reduced to these summaries, the entry values follow from a fold over the summaries,
and all chunks then run at the same time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.folds import chunk_entries, run
from tidemark.functions.smoothing import smoothed
from tidemark.model import Panel

INF = float("inf")
BANDS = ("u", "l")


def _move(y: Column, band: Column) -> Column:
    return F.when((y < band["lo"]) | (y > band["hi"]), band["r"]).otherwise(y)


def _exits(name: str) -> Column:
    """Rows where the running band narrows, with the value at the chunk end after a reset there."""
    zero = F.struct(F.lit(-INF).alias("lo"), F.lit(INF).alias("hi"), F.lit(False).alias("new"))
    narrow = run(F.col("rows"), zero, lambda p, x: F.struct(
        F.greatest(p["lo"], x[name]["lo"]).alias("lo"), F.least(p["hi"], x[name]["hi"]).alias("hi"),
        ((x[name]["lo"] > p["lo"]) | (x[name]["hi"] < p["hi"])).alias("new")))
    marked = F.arrays_zip(F.sequence(F.lit(1), F.size("rows")).alias("i"), F.col("rows"), narrow.alias("n"))
    return F.transform(F.filter(marked, lambda e: e["n"]["new"]), lambda e: F.struct(
        e["rows"][name]["lo"].alias("lo"), e["rows"][name]["hi"].alias("hi"),
        F.aggregate(F.slice("rows", e["i"] + 1, F.size("rows")), e["rows"][name]["r"],
                    lambda y, x: _move(y, x[name])).alias("last")))


def _after(y: Column, exits: Column) -> Column:
    left = F.get(F.filter(exits, lambda e: (y < e["lo"]) | (y > e["hi"])), F.lit(0))
    return F.coalesce(left["last"], y)


def supertrend(panel: Panel, period: int = 10, multiplier: float = 3.0, output: str = "direction",
               chunk: int = 2048) -> DataFrame:
    """Trend direction (1, -1) or the active band, from bar ``period`` on."""
    from tidemark.operators.factors import with_base

    c, keys = F.col, list(panel.keys)
    fr = panel.frame(1)
    df = fr.own(with_base(fr.df, fr.row)).select(*keys, *panel.order, "pos", "high", "low", "close", c("prev").alias("prev_close"), "tr")
    df = smoothed(df, keys, panel.order, panel.grain, "tr", period, 1.0 / period, "atr", "ranges")
    mid, first = (c("high") + c("low")) / 2.0, (c("ranges") == period) & c("tr").isNotNull()
    up, low = mid + multiplier * c("atr"), mid - multiplier * c("atr")
    start, known = F.when(first, INF), mid.isNotNull()  # a missing bar moves no band
    band = lambda lo, hi, r: F.struct(F.when(known, lo).otherwise(-INF).alias("lo"), F.when(known, hi).otherwise(INF).alias("hi"), r.alias("r"))
    item = F.struct("pos", *panel.order, "close", first.alias("first"), band(F.coalesce(start, "prev_close"), up, up).alias("u"), band(F.coalesce(start, low), c("prev_close"), low).alias("l"))
    g = (df.where(c("atr").isNotNull()).groupBy(*keys, F.floor(c("pos") / chunk).alias("_k"))
         .agg(F.array_sort(F.collect_list(item)).alias("rows")))

    heads = g.select(*keys, "_k", F.struct(*[_exits(b).alias(b) for b in BANDS]).alias("m"))
    before = chunk_entries(heads, keys, F.struct(*[F.lit(-INF).alias(b) for b in BANDS]), lambda p, x: F.struct(
        *[_after(p[b], x["m"][b]).alias(b) for b in BANDS]))
    bands = g.join(before, [*keys, "_k"]).select(*keys, "_k", "rows", run(
        c("rows"), c("e"), lambda p, x: F.struct(*[_move(p[b], x[b]).alias(b) for b in BANDS])).alias("s"))

    def turn(d, x):
        above, below = x["rows"]["close"] > x["s"]["u"], x["rows"]["close"] < x["s"]["l"]
        return F.when(x["rows"]["first"], 1).when((d < 0) & above, 1).when((d > 0) & below, -1).otherwise(d)

    both = F.struct(F.lit(1).alias("p"), F.lit(-1).alias("n"))
    sides = bands.select(*keys, "_k", F.arrays_zip("rows", "s").alias("z")).select(
        *keys, "_k", "z", run(c("z"), both, lambda p, x: F.struct(
            turn(p["p"], x).alias("p"), turn(p["n"], x).alias("n"))).alias("d"))
    entry = chunk_entries(sides.select(*keys, "_k", F.element_at("d", -1).alias("m")), keys,
                     F.struct(F.lit(1).alias("d")), lambda p, x: F.struct(
                         F.when(p["d"] > 0, x["m"]["p"]).otherwise(x["m"]["n"]).alias("d")))
    rows = sides.join(entry, [*keys, "_k"]).select(
        *keys, c("e.d").alias("side"), F.explode(F.arrays_zip("z", "d")).alias("r"))
    side = F.when(c("side") > 0, c("r.d.p")).otherwise(c("r.d.n"))
    value = side.cast("double") if output == "direction" else F.when(
        side > 0, c("r.z.s.l")).otherwise(c("r.z.s.u"))
    return rows.where((c("r.z.rows.pos") >= period) & ~c("r.z.rows.first")).select(
        *keys, *[c(f"r.z.rows.{o}").alias(o) for o in panel.order], value.alias("value"))
