"""Resampling, schedules, sampling and latest-per-key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ordered import scan
from tidemark.model import PRICES, Panel, epoch

c, lit, when = F.col, F.lit, F.when
DAY = 86400


def _ohlcv(order) -> list[Column]:
    o = F.struct(*order)
    return [F.min_by("open", o).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", o).alias("close"),
            F.sum("volume").alias("volume")]


def resample_count(panel: Panel, k: int) -> DataFrame:
    """Every k bars of a symbol to one; an incomplete tail is dropped; time of the first bar."""
    g = panel.number().df.groupBy(*panel.keys, F.floor(c("pos") / k).alias("_g")).agg(F.min("ts").alias("ts"), *_ohlcv(panel.order), F.count(lit(1)).alias("_n"))
    return g.where(c("_n") == k).select(*panel.keys, "ts", *PRICES)


def resample_floor(panel: Panel, step: int) -> DataFrame:
    """Epoch-aligned buckets, partial ones kept."""
    start = F.timestamp_seconds(F.floor(epoch() / step) * step)
    g = panel.df.withColumn("_b", start).groupBy(*panel.keys, "_b").agg(*_ohlcv(panel.order))
    return g.select(*panel.keys, c("_b").alias("ts"), *PRICES)


def resample_right(panel: Panel, step: int) -> DataFrame:
    """Right-closed, right-labelled buckets."""
    end = F.timestamp_seconds(F.ceil(epoch() / step) * step)
    g = panel.df.withColumn("_b", end).groupBy(*panel.keys, "_b").agg(*_ohlcv(panel.order))
    return g.select(*panel.keys, c("_b").alias("ts"), *PRICES).dropna(subset=["open", "high", "low", "close"])


def review_window(trades: DataFrame, panel: Panel, most: int) -> DataFrame:
    """Bars around the trades of each symbol, padded by eight bars or 5 %, the last ``most``."""
    t = trades.groupBy("symbol").agg(F.min("entry_t").alias("_a"), F.max("exit_t").alias("_z"))
    span = F.greatest(lit(panel.step), c("_z") - c("_a"))
    pad = F.greatest(lit(panel.step * 8), F.floor(span * 0.05))
    x = panel.number().df.join(t, "symbol").where((epoch() >= c("_a") - pad) & (epoch() <= c("_z") + pad))
    end = x.groupBy("symbol").agg(F.max("pos").alias("_end"))
    return x.join(end, "symbol").where(c("pos") > c("_end") - most).select("symbol", "ts", *PRICES)


def due_days(days: DataFrame, key: str, day: str, frequency: str, weekday: int = 1, monthday: int = 1) -> DataFrame:
    """Session days on which a schedule runs, catching up after days without a session.

    ``days`` holds one row per key and session day (epoch days).
    """
    x = scan(days, [key], [day], F.floor(c(day) / 4096), _was=("last", day, -1))
    date = F.date_from_unix_date(c(day).cast("int"))
    if frequency == "weekly":
        mine = c(day) - F.weekday(date) + (weekday - 1)
        before = mine - 7
    elif frequency == "monthly":
        at = lambda d: F.unix_date(F.date_add(F.trunc(d, "month"), F.least(lit(monthday), F.dayofmonth(F.last_day(d))) - 1))
        mine, before = at(date), at(F.add_months(F.trunc(date, "month"), -1))
    else:
        return x.where(c("_was").isNull() | (c("_was") != c(day))).drop("_was")
    late = c(day) < mine
    due = when(late, c("_was").isNotNull() & (c("_was") < before) & (before <= c(day))).otherwise(c("_was").isNull() | (c("_was") < mine))
    return x.where(due).drop("_was")


def period_ends(days: DataFrame, key: str, day: str, frequency: str) -> DataFrame:
    """Last session of each week or month that has a later session."""
    x = days.withColumn("_neg", -c(day))
    x = scan(x, [key], ["_neg"], F.floor(c("_neg") / 4096), _next=("last", day, -1))
    d, n = (F.date_from_unix_date(c(k).cast("int")) for k in (day, "_next"))
    unit = "week" if frequency == "weekly" else "month"
    return x.where(c("_next").isNotNull() & (F.date_trunc(unit, d) != F.date_trunc(unit, n))).drop("_neg", "_next")


def even_sample(points: DataFrame, keys, pos: str, most: int = 2400) -> DataFrame:
    """About ``most`` points per key at even steps, both ends kept (positions from 0)."""
    n = points.groupBy(*keys).agg((F.max(pos) + 1).alias("_n"))
    x = points.join(n, list(keys))
    step = F.greatest(lit(1), F.ceil(c("_n") / float(most)))
    return x.where((c("_n") <= most) | (c(pos) == 0) | (c(pos) == c("_n") - 1) | (c(pos) % step == 0)).drop("_n")


def sample_curve(points: DataFrame, keys, pos: str, value: str, limit: int, initial: float, grain: Column) -> DataFrame:
    """Bound a curve to ``limit`` points: ends, extremes, the drawdown's peak and trough and the
    first insolvency stay, the rest is filled evenly (half to even).
    """
    keys = list(keys)
    x = scan(points, keys, [pos], grain, _top=("max", F.struct(c(value).alias("v"), (-c(pos)).alias("n"))))
    own = c("_top.v") > initial
    peak, at = when(own, c("_top.v")).otherwise(lit(initial)), when(own, -c("_top.n")).otherwise(lit(0))
    x = x.withColumns({"_dd": when(peak > 0, (c(value) / peak - 1.0) * 100.0).otherwise(0.0), "_at": at})
    need = x.groupBy(*keys).agg(
        F.max(pos).alias("_end"), F.min_by(pos, F.struct(value, pos)).alias("_lo"), F.min_by(pos, F.struct((-c(value)).alias("v"), c(pos))).alias("_hi"),
        F.min_by(F.struct(c("_at").alias("p"), c(pos).alias("t"), c("_dd").alias("d")), F.struct("_dd", pos)).alias("_w"), F.min(when(c(value) <= 0, c(pos))).alias("_broke"))
    worst = when(c("_w.d") < 0, F.array(c("_w.p"), c("_w.t"))).otherwise(F.array(lit(0).cast("long")))
    broke = when(c("_broke").isNotNull(), F.array(F.greatest(c("_broke") - 1, lit(0)), c("_broke"))).otherwise(F.array().cast("array<bigint>"))
    must = F.array_distinct(F.concat(F.array(lit(0).cast("long"), c("_end"), c("_lo"), c("_hi")), worst, broke))
    need = need.select(*keys, (c("_end") + 1).alias("_n"), must.alias("_must"))
    x = points.join(need, keys).withColumn("_req", F.array_contains("_must", c(pos)))
    # place among the points that are not required: its position less the required ones before it
    rank = c(pos) - F.size(F.filter("_must", lambda m: m < c(pos)))
    slots, free = lit(limit) - F.size("_must"), c("_n") - F.size("_must")
    step = (free - 1) / (slots - 1)
    near = F.round(rank / step)
    hit = F.greatest(*[F.bround(k * step, 0) == rank for k in (near - 1, near, near + 1)]) & (rank < free)
    inside = (near >= 0)
    return x.where((c("_n") <= limit) | c("_req") | (inside & hit)).drop("_n", "_must", "_req")


def similar_records(records: DataFrame, now: DataFrame, keys, limit: int = 3) -> DataFrame:
    """Most similar past records of a key: the newest 5 x limit are scored, the best kept."""
    keys = list(keys)
    part = F.pmod(F.xxhash64("id"), lit(32))
    w = lambda *more: Window.partitionBy(*keys, *more).orderBy(c("t").desc(), c("id").desc())
    x = records.withColumn("_p", part).withColumn("_n", F.row_number().over(w("_p"))).where(c("_n") <= 5 * limit)
    x = x.withColumn("_n", F.row_number().over(w())).where(c("_n") <= 5 * limit).drop("_n", "_p")
    j = x.join(now.select(*keys, *[c(k).alias(f"now_{k}") for k in ("rsi", "macd", "ma", "vol")]), keys)
    low, high = ("low", "normal", "normal_low"), ("high", "elevated", "volatile", "very_high")
    band = (c("vol").isin(*low) & c("now_vol").isin(*low)) | (c("vol").isin(*high) & c("now_vol").isin(*high))
    sim = (F.greatest(lit(0.0), 1 - F.abs(c("rsi") - c("now_rsi")) / 30) * 0.3 + when(c("macd") == c("now_macd"), 0.3).otherwise(0.0)
           + when(c("ma") == c("now_ma"), 0.25).otherwise(0.0) + when(c("vol") == c("now_vol"), 0.15).when(band, 0.08).otherwise(0.0))
    j = j.withColumn("_s", sim).where("_s >= 0.25").withColumn("score", c("_s") + when(c("correct"), 0.1).otherwise(0.0))
    r = Window.partitionBy(*keys).orderBy(c("score").desc(), c("t").desc(), c("id").desc())
    return j.withColumn("rank", F.row_number().over(r)).where(c("rank") <= limit)


def missing_bars(panel: Panel) -> DataFrame:
    """Gaps: the bars expected between the first and last bar of a symbol that are absent.

    A gap is found from the bar before it, so nothing is generated for bars that exist.
    """
    t = epoch()
    x = scan(panel.df.select(*panel.keys, *panel.order), panel.keys, panel.order, panel.grain, _was=("last", t, -1))
    x = x.where(t - c("_was") > panel.step)
    return x.select(*panel.keys, F.explode(F.sequence(c("_was") + panel.step, t - panel.step, lit(panel.step).cast("long"))).alias("t"))


def canonical_members(raw: DataFrame, keys, seq: str) -> DataFrame:
    """One row per identity, the last given one wins."""
    rest = [n for n in raw.columns if n not in (*keys, seq)]
    return raw.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(*keys, "r.*")
