"""Feature series with strict gaps, market regimes, signals and chart evidence.

Here a window with a missing value gives null and a recursion starts again after a gap,
unlike the catalogue in ``operators.factors``.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import deque
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.market import stack_trend, volatility_level
from tidemark.functions.ordered import scan
from tidemark.model import PRICES, Panel, div, epoch, finite
from tidemark.operators.factors import _Frame, fold_frame, mem, with_base, wmem

c, lit, when = F.col, F.lit, F.when


def valid_bar() -> Column:
    fine = lit(True)
    for p in PRICES:
        fine = fine & finite(c(p)).isNotNull()
    return F.coalesce(fine & (c("high") >= c("low")), lit(False))


def full(agg, w, n: int, col: str) -> Column:
    """A window aggregate that is null unless all ``n`` rows have a value."""
    return when(F.count(col).over(w(n)) == n, agg(col).over(w(n)))


def windowed(panel: Panel, back: int, ahead: int = 0):
    """Frame, window maker and rows with the base columns."""
    fr = panel.frame(back, ahead)
    return fr, _Frame(fr), with_base(fr.df, fr.row)


def moving_averages(panel: Panel, **periods: int) -> Panel:
    """EMA columns that seed again after a gap."""
    df = fold_frame(panel, max(mem(n) for n in periods.values()), {}, lambda a: {
        k: a.ema(a["close"], n) for k, n in periods.items()}, extra=PRICES)
    return panel.replace(df)


def ema_features(panel: Panel, period: int) -> DataFrame:
    """EMA, its step per bar and the relative distance of the close."""
    p = moving_averages(panel, ema=period)
    fr = p.frame(1)
    df = fr.df.withColumns({"slope": c("ema") - F.lag("ema").over(fr.row), "distance": div(c("close") - c("ema"), c("ema"))})
    return fr.own(df)


def session_vwap(panel: Panel, session: Column) -> DataFrame:
    """VWAP that starts again with each session; bars without volume carry the value."""
    tp = (c("high") + c("low") + c("close")) / 3.0
    use = F.coalesce(valid_bar() & (c("volume") > 0), lit(False))
    df = panel.df.withColumn("session", session)
    df = scan(df, [*panel.keys, "session"], panel.order, panel.grain, _pv=("sum", when(use, tp * c("volume"))), _vv=("sum", when(use, c("volume"))))
    return df.withColumn("vwap", div(c("_pv"), c("_vv"))).drop("_pv", "_vv")


def rolling_vwap_expr(w, n: int) -> Column:
    use = valid_bar() & (c("volume") > 0)
    return when(F.count_if(use).over(w(n)) == n, F.sum(c("tp") * c("volume")).over(w(n)) / F.sum("volume").over(w(n)))


def trend_direction(fast: str, mid: str, slow: str) -> Column:
    f, m, s = c(fast), c(mid), c(slow)
    return when(f.isNull() | m.isNull() | s.isNull(), None).when((f > m) & (m > s), 1).when((f < m) & (m < s), -1).otherwise(0)


def trend_strength(panel: Panel, direction: str, n: int) -> DataFrame:
    """Share of the last n bars with the current direction; windows with a gap are null."""
    fr = panel.frame(n)
    w = fr.w(n)
    rows = F.count(lit(1)).over(w)
    same = [F.count_if(c(direction) == k).over(w) for k in (-1, 0, 1)]
    pick = when(c(direction) == -1, same[0]).when(c(direction) == 0, same[1]).otherwise(same[2])
    return fr.own(fr.df.withColumn("strength", when(F.count(direction).over(w) == rows, when(c(direction).isNotNull(), pick / rows))))


def stochastic_features(panel: Panel, n: int, smooth: int) -> DataFrame:
    """%K (50 on a flat window) and its mean."""
    fr, w, df = windowed(panel, n + smooth)
    hh, ll = full(F.max, w, n, "high"), full(F.min, w, n, "low")
    ok = F.count("close").over(w(n)) == n
    df = df.withColumn("k", when(ok & hh.isNotNull() & ll.isNotNull(), when(hh == ll, 50.0).otherwise(100.0 * (c("close") - ll) / (hh - ll))))
    return fr.own(df.withColumn("d", full(F.avg, w, smooth, "k")))


def mid_rank(values: Column, x: Column) -> Column:
    """Mid-rank of ``x`` among values of its window, in (0, 1]."""
    below = F.size(F.filter(values, lambda v: v < x))
    equal = F.size(F.filter(values, lambda v: v == x))
    return when(x.isNotNull() & (F.size(values) > 0), (below + 0.5 * (equal - 1) + 0.5) / F.size(values))


def rolling_percentile(panel: Panel, col: str, n: int, out: str = "percentile") -> DataFrame:
    fr = panel.frame(n)
    df = fr.df.withColumn("_v", F.collect_list(col).over(fr.w(n)))
    return fr.own(df.withColumn(out, mid_rank(c("_v"), c(col))).drop("_v"))


def spread_features(panel: Panel, n: int, mult: float = 2.0) -> DataFrame:
    """Bollinger bandwidth in percent and rolling population deviation."""
    fr, w, df = windowed(panel, n)
    sd, mean = full(F.stddev_pop, w, n, "close"), full(F.avg, w, n, "close")
    return fr.own(df.withColumns({"bandwidth": div(100.0 * 2.0 * mult * sd, F.abs(mean)), "deviation": sd}))


def log_return() -> Column:
    return when((c("close") > 0) & (c("prev") > 0), F.ln(c("close") / c("prev")))


def return_features(panel: Panel, n: int, ppy: float, lag: int = 1, bins: int = 8) -> DataFrame:
    """Volatility, Hurst exponent, autocorrelation and entropy of the last n log returns."""
    fr, w, df = windowed(panel, n + 1)
    df = df.withColumn("lr", log_return())
    df = df.withColumns({"_a": F.collect_list("lr").over(w(n)), "_m": F.avg("lr").over(w(n)), "_s": F.stddev_pop("lr").over(w(n)),
                         "_lo": F.min("lr").over(w(n)), "_hi": F.max("lr").over(w(n))})
    df = df.withColumn("_ok", (F.size("_a") == n) & (c("pos") >= n))
    zero = F.struct(lit(0.0).alias("x"), lit(0.0).alias("lo"), lit(0.0).alias("hi"))

    def step(z, r):
        x = z["x"] + r - c("_m")
        return F.struct(x.alias("x"), F.least(z["lo"], x).alias("lo"), F.greatest(z["hi"], x).alias("hi"))

    span = F.aggregate("_a", zero, step, lambda z: z["hi"] - z["lo"])
    hurst = when(c("_s") <= 0, 0.5).otherwise(F.log2(span / c("_s")) / math.log2(n))
    late, early = F.slice("_a", lag + 1, n - lag), F.slice("_a", 1, n - lag)
    cov = F.aggregate(F.zip_with(late, early, lambda a, b: (a - c("_m")) * (b - c("_m"))), lit(0.0), lambda s, x: s + x)
    var = c("_s") * c("_s") * n
    cell = F.transform("_a", lambda r: F.least(F.floor((r - c("_lo")) / F.nullif(c("_hi") - c("_lo"), lit(0.0)) * bins), lit(bins - 1)))
    share = F.transform(F.sequence(lit(0), lit(bins - 1)), lambda b: F.size(F.filter("_cell", lambda x: x == b)) / lit(float(n)))
    entropy = F.aggregate(share, lit(0.0), lambda s, p: s - when(p > 0, p * F.log2(p)).otherwise(0.0))
    df = df.withColumn("_cell", cell)
    df = df.withColumns({
        "volatility": when(c("_ok"), c("_s") * math.sqrt(ppy)), "hurst": when(c("_ok"), hurst),
        "autocorr": when(c("_ok") & (var > 0), cov / var), "entropy": when(c("_ok"), when(c("_hi") == c("_lo"), 0.0).otherwise(entropy))})
    return fr.own(df.drop("_a", "_m", "_s", "_lo", "_hi", "_ok", "_cell"))


def moment_features(panel: Panel, n: int) -> DataFrame:
    """Skewness and excess kurtosis of closes; a flat window gives 0 and -3."""
    fr, w, df = windowed(panel, n)
    ok, flat = F.count("close").over(w(n)) == n, F.min("close").over(w(n)) == F.max("close").over(w(n))
    return fr.own(df.withColumns({"skew": when(ok, when(flat, 0.0).otherwise(F.skewness("close").over(w(n)))),
                                  "kurtosis": when(ok, when(flat, -3.0).otherwise(F.kurtosis("close").over(w(n))))}))


def efficiency(panel: Panel, n: int) -> DataFrame:
    """Kaufman efficiency; 1 when nothing moved."""
    fr, w, df = windowed(panel, n + 1)
    ok = F.count("delta").over(w(n)) == n
    path = F.sum(F.abs("delta")).over(w(n))
    return fr.own(df.withColumn("efficiency", when(ok, when(path == 0, 1.0).otherwise(F.abs(c("close") - F.lag("close", n).over(fr.row)) / path))))


def volume_features(panel: Panel, n: int) -> DataFrame:
    """Relative volume, money flow, and OBV that carries over invalid bars."""
    good = valid_bar()
    df = scan(panel.df.withColumn("_ok", good), panel.keys, panel.order, panel.grain, _pc=("last", when(good, c("close")), -1))
    signed = when(c("_ok") & (c("close") > c("_pc")), c("volume")).when(c("_ok") & (c("close") < c("_pc")), -c("volume")).when(c("_ok"), 0.0)
    df = scan(df.withColumn("_sv", signed), panel.keys, panel.order, panel.grain, obv=("sum", "_sv"))
    fr, w, df = windowed(panel.replace(df), n)
    ok = F.count_if("_ok").over(w(n)) == n
    mean, total = full(F.avg, w, n, "volume"), F.sum("volume").over(w(n))
    return fr.own(df.withColumns({
        "relative_volume": when(mean > 0, c("volume") / mean), "cmf": when(ok & (total > 0), F.sum("mfv").over(w(n)) / total)}).drop("_ok", "_pc", "_sv"))


def _directional(a, n):
    """ADX (seeded by the mean of n DX), +DI and -DI arrays."""
    plus, minus, tr = (a.wilder(a[x], n) for x in ("_up", "_down", "_ttr"))
    pdi = a.zip(plus, tr, lambda x, t: when(t > 0, 100.0 * x / t))
    mdi = a.zip(minus, tr, lambda x, t: when(t > 0, 100.0 * x / t))
    dx = a.zip(pdi, mdi, lambda p, m: when(p.isNotNull(), when(p + m > 0, 100.0 * F.abs(p - m) / (p + m)).otherwise(0.0)))
    return {"adx": a.wilder(dx, n), "pdi": pdi, "mdi": mdi}


def moves() -> dict:
    """Directional moves and true range against the bar before, by name."""
    from tidemark.operators.factors import _moves
    return _moves


def adx_series(panel: Panel, n: int = 14) -> DataFrame:
    """ADX and directional lines; ADX starts from the mean of the first n DX values.

    After a gap the lines start again (bars are expected to be cleaned at ingest).
    """
    steps = {k: (lambda w, f=f: f(w, None)) for k, f in moves().items()}
    return fold_frame(panel, 2 * wmem(n) + 2, steps, lambda a: _directional(a, n), extra=PRICES)


REGIME = {"adx_period": 14, "adx_trend": 25.0, "adx_strong": 40.0, "atr_period": 14, "atr_window": 100, "atr_pct_high": 0.8,
          "atr_pct_low": 0.2, "ema_fast": 20, "ema_slow": 50, "slope_bars": 5, "range_band": 0.01, "di_gap": 5.0, "vol_period": 20,
          "breakout_lookback": 20, "relvol_breakout": 1.5, "mr_dev_atr": 2.0, "meanrev_adx_max": 20.0,
          "abnormal_range_atr_mult": 6.0, "vwap_period": 20, "rsi_period": None}  # fixed values


def _smooth(values, starts, n: int, gain: float, state):
    """``folds.smooth`` over the rows of a batch; ``state`` is what the batch before left. A missing value starts it again, and so does a chunk."""
    y, count, total = state
    out = []
    for v, start in zip(values, starts):
        if start or v is None:
            y, count, total = None, 0, 0.0
        if v is not None:
            if y is not None:
                y += gain * (v - y)
            else:
                count, total = count + 1, total + v
                y = total / n if count == n else None
        out.append(y)
    return out, (y, count, total)


def _mid_ranks(values, starts, n: int, state):
    """:func:`mid_rank` of each value among the last ``n``, kept in order; NaN stands above all numbers, as in Spark."""
    last, ordered, nans = state
    out = []
    for v, start in zip(values, starts):
        if start:
            last, ordered, nans = deque(), [], 0
        last.append(v)
        old = last.popleft() if len(last) > n else None
        if old is not None:
            if old != old:
                nans -= 1
            else:
                del ordered[bisect_left(ordered, old)]
        if v is None:
            out.append(None)
            continue
        if v != v:
            nans += 1
            below, equal = len(ordered), nans
        else:
            below = bisect_left(ordered, v)
            ordered.insert(below, v)
            equal = bisect_right(ordered, v) - below
        out.append((below + 0.5 * (equal - 1) + 0.5) / (len(ordered) + nans))
    return out, (last, ordered, nans)


def _streaks(values, starts, state):
    """Rising and falling steps in a row up to each value."""
    before, up, down = state
    ups, downs = [], []
    for v, start in zip(values, starts):
        step = None if start or v is None or before is None else v - before
        up = up + 1 if step is not None and not step <= 0 else 0
        down = down + 1 if step is not None and step < 0 else 0
        before = v
        ups.append(up)
        downs.append(down)
    return ups, downs, (before, up, down)


def _rsi(closes, starts, n: int, state):
    """The catalogue's RSI (``factors``): a bar without a close is passed over."""
    before, gain, loss, count = state
    out = []
    for x, start in zip(closes, starts):
        if start:
            before, gain, loss, count = None, 0.0, 0.0, 0
        if x is None or not math.isfinite(x):
            out.append(None)
            continue
        if before is not None:
            step = x - before
            up, down = max(step, 0.0), max(-step, 0.0)
            if count >= n:
                gain, loss = gain + 1.0 / n * (up - gain), loss + 1.0 / n * (down - loss)
            else:
                count, gain, loss = count + 1, gain + up, loss + down
                if count == n:
                    gain, loss = gain / n, loss / n
        before = x
        value = None if count < n else 100.0 if loss <= 0 else 100.0 - 100.0 / (1.0 + gain / loss)
        out.append(value if value is not None and math.isfinite(value) else None)
    return out, (before, gain, loss, count)


def _listed(column) -> list:
    values = column.to_numpy(zero_copy_only=False).tolist()
    for i in np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False)) if column.null_count else ():
        values[i] = None
    return values


LINES = ("adx", "pdi", "mdi", "ef", "es", "atr", "atr_price", "atr_pct")


def _regime_lines(cfg: dict, kept):
    """Rows of chunks in order (``_start`` is a chunk's first) -> own rows with the recursive inputs; held are one batch and the states."""
    n, over = cfg["adx_period"], lambda t: t is not None and not t <= 0  # as Spark compares, NaN is above zero

    def run(batches):
        none, slopes = (None, 0, 0.0), cfg["slope_bars"] - 1
        state, ranks, trend, strength = [none] * 7, (deque(), [], 0), (None, 0, 0), (None, 0.0, 0.0, 0)
        for b in batches:
            starts = b.column("_start").to_pylist()
            up, down, ttr, tr, close = (_listed(b.column(x)) for x in ("_up", "_down", "_ttr", "tr", "close"))
            todo = ((up, n, 1.0 / n), (down, n, 1.0 / n), (ttr, n, 1.0 / n), (close, cfg["ema_fast"], 2.0 / (cfg["ema_fast"] + 1.0)),
                    (close, cfg["ema_slow"], 2.0 / (cfg["ema_slow"] + 1.0)), (tr, cfg["atr_period"], 1.0 / cfg["atr_period"]))
            done = []
            for i, (values, m, gain) in enumerate(todo):
                out, state[i] = _smooth(values, starts, m, gain, state[i])
                done.append(out)
            plus, minus, span, ef, es, atr = done
            pdi = [100.0 * x / t if x is not None and over(t) else None for x, t in zip(plus, span)]
            mdi = [100.0 * x / t if x is not None and over(t) else None for x, t in zip(minus, span)]
            dx = [None if p is None else 100.0 * abs(p - m) / (p + m) if m is not None and over(p + m) else 0.0 for p, m in zip(pdi, mdi)]
            adx, state[6] = _smooth(dx, starts, n, 1.0 / n, state[6])
            part = [a / x if a is not None and over(x) else None for a, x in zip(atr, close)]
            pct, ranks = _mid_ranks(part, starts, cfg["atr_window"], ranks)
            ups, downs, trend = _streaks(ef, starts, trend)
            lines = [pa.array(x, pa.float64()) for x in (adx, pdi, mdi, ef, es, atr, part, pct)]
            names = [*kept, *LINES]
            if cfg.get("rsi_period"):
                rsi, strength = _rsi(close, starts, cfg["rsi_period"], strength)
                lines, names = [*lines, pa.array(rsi, pa.float64())], [*names, "rsi"]
            flags = [pa.array([k >= slopes for k in x]) for x in (ups, downs)]
            whole = pa.RecordBatch.from_arrays([*(b.column(x) for x in kept), *lines, *flags], [*names, "slope_up", "slope_dn"])
            yield whole.filter(b.column("_own"))

    return run


def regime_inputs(panel: Panel, cfg: dict) -> Panel:
    """The windows of a chunk, and then its recursive inputs in one pass over the rows as they come."""
    look, kept = cfg["breakout_lookback"], list(dict.fromkeys([*panel.df.columns, "pos"]))
    if "pos" not in panel.df.columns:
        df = scan(panel.df, panel.keys, panel.order, panel.grain, reuse=True, pos=("count", lit(1)))
        panel = panel.replace(df.withColumn("pos", c("pos") - 1))
    fr, w, df = windowed(panel, 2 * wmem(cfg["adx_period"]) + 2 + mem(cfg["ema_slow"]) + max(
        wmem(cfg.get("rsi_period") or 2), cfg["atr_window"], look, cfg["slope_bars"], cfg["vwap_period"], cfg["vol_period"]) + 1)
    prior = fr.between(-look, -1)
    whole = F.count("close").over(prior) == F.count(lit(1)).over(prior)
    df = df.withColumns({
        "vwap": rolling_vwap_expr(w, cfg["vwap_period"]),
        "relvol": when(full(F.avg, w, cfg["vol_period"], "volume") > 0, c("volume") / full(F.avg, w, cfg["vol_period"], "volume")),
        "ch_hi": when(whole, F.max("close").over(prior)), "ch_lo": when(whole, F.min("close").over(prior)),
        "_start": F.lag("pos").over(fr.row).isNull(), **{k: f(w, None) for k, f in moves().items()}})
    kept += ["vwap", "relvol", "ch_hi", "ch_lo"]
    own = list(dict.fromkeys([*kept, "close", "tr", *moves(), "_start", "_own"]))
    rows = df.sortWithinPartitions(*panel.keys, "_chunk", "pos").select(*own)
    kind = [f for f in rows.schema if f.name in kept]
    kind = T.StructType(sorted(kind, key=lambda f: kept.index(f.name)))
    for name in (*LINES, *(["rsi"] if cfg.get("rsi_period") else [])):
        kind.add(name, "double")
    return panel.replace(rows.mapInArrow(_regime_lines(cfg, kept), kind.add("slope_up", "boolean").add("slope_dn", "boolean")))


def detect_regimes(panel: Panel, keep=None, **changes) -> DataFrame:
    """Regime per bar: ordered rules; an established trend survives while ADX is very strong.

    ``keep`` names the columns that are wanted beside the regime (all, if left out); with no other ones the rows are made once for both uses of the scan.

    The carry of a trend is an island test: the last bar that started the trend is not
    before the last bar that broke it.  Both are running maxima of positions.
    """
    cfg = {**REGIME, **changes}
    p = regime_inputs(panel, cfg)
    a, pl, mi, f, s, ap, v = (c(x) for x in ("adx", "pdi", "mdi", "ef", "es", "atr_pct", "vwap"))
    known = a.isNotNull() & pl.isNotNull() & f.isNotNull() & s.isNotNull() & ap.isNotNull() & v.isNotNull()
    trending = a >= cfg["adx_trend"]
    rule = (when(~valid_bar() | (c("close") <= 0), "ABNORMAL").when(~known, "TRANSITION")
            .when((c("atr") > 0) & (c("high") - c("low") >= cfg["abnormal_range_atr_mult"] * c("atr")), "ABNORMAL")
            .when(ap >= cfg["atr_pct_high"], "HIGH_VOLATILITY")
            .when(trending & (f > s) & c("slope_up") & (pl - mi >= cfg["di_gap"]), "TRENDING_UP")
            .when(trending & (f < s) & c("slope_dn") & (mi - pl >= cfg["di_gap"]), "TRENDING_DOWN"))
    strong = a >= cfg["adx_strong"]
    out = (c("close") > c("ch_hi")) | (c("close") < c("ch_lo"))
    gap = F.abs(c("close") - v)
    later = (when((c("relvol") >= cfg["relvol_breakout"]) & out, "BREAKOUT")
             .when((c("atr") > 0) & (gap / c("atr") >= cfg["mr_dev_atr"]) & (a <= cfg["meanrev_adx_max"]), "MEAN_REVERSION")
             .when((v != 0) & (F.abs((c("close") - v) / v) <= cfg["range_band"]) & (a < cfg["adx_trend"]), "RANGING")
             .when(ap <= cfg["atr_pct_low"], "LOW_VOLATILITY").otherwise("TRANSITION"))
    df = p.df.withColumns({"_rule": rule, "_later": later,
                           "_up": F.coalesce(strong & (f > s) & (pl > mi), lit(False)), "_dn": F.coalesce(strong & (f < s) & (mi > pl), lit(False))})
    free = c("_rule").isNull()
    marks = {}
    for name, label, still in (("u", "TRENDING_UP", "_up"), ("d", "TRENDING_DOWN", "_dn")):
        start = F.coalesce(c("_rule") == label, lit(False))
        marks[f"_{name}s"] = ("max", when(start, c("pos")))
        marks[f"_{name}b"] = ("max", when(~start & ~(free & c(still)), c("pos")))
    if keep is not None:
        df = df.select(*dict.fromkeys([*p.keys, *p.order, *keep, "pos", "_rule", "_later", "_up", "_dn"]))
    df = scan(df, p.keys, ["pos"], F.floor(c("pos") / 16384), reuse=True, **marks)
    alive = lambda n: c(f"_{n}s").isNotNull() & (c(f"_{n}s") > F.coalesce(f"_{n}b", lit(-1)))
    label = (when(c("_rule").isNotNull(), c("_rule")).when(c("_up") & alive("u"), "TRENDING_UP").when(c("_dn") & alive("d"), "TRENDING_DOWN")
             .otherwise(c("_later")))
    return df.withColumn("regime", label).drop("_rule", "_later", "_up", "_dn", *marks)


# --- signals ----------------------------------------------------------------------------

def cross_signals(regimes: DataFrame, fast: str = "ef", slow: str = "es") -> DataFrame:
    """EMA cross where a trend thesis is allowed: 1, -1 or 0."""
    ok = c("regime").isin("TRENDING_UP", "TRENDING_DOWN", "TRANSITION", "BREAKOUT")
    return regimes.withColumn("signal", F.coalesce(when(ok, when(c(fast) > c(slow), 1).when(c(fast) < c(slow), -1)), lit(0)))


def reversion_signals(rows: DataFrame, rsi: str, low: float = 30.0, high: float = 70.0, shorts: bool = False) -> DataFrame:
    ok = c("regime").isin("RANGING", "TRANSITION", "MEAN_REVERSION")
    short = when(c(rsi) > high, -1) if shorts else lit(None)
    return rows.withColumn("signal", F.coalesce(when(ok & (c(rsi) < low), 1), when(ok, short), lit(0)))


def breakout_signals(regimes: DataFrame, least: float = 1.5) -> DataFrame:
    """Long when the close leaves the channel of the prior bars with volume."""
    hit = (c("regime") == "BREAKOUT") & (c("close") > c("ch_hi")) & (c("relvol") >= least)
    return regimes.withColumn("signal", when(F.coalesce(hit, lit(False)), 1).otherwise(0))


def signal_returns(panel: Panel, signal: str, latency: int = 1, cost: float = 0.001) -> DataFrame:
    """Return per bar of a position decided at bar i and held from the open of bar i + latency."""
    fr = panel.frame(latency + 1, 1)
    pos, before = F.lag(signal, latency).over(fr.row), F.lag(signal, latency + 1).over(fr.row)
    move = div(F.lead("open").over(fr.row), c("open")) - 1.0
    turn = F.abs(F.coalesce(pos, lit(0)) - F.coalesce(before, lit(0)))
    return fr.own(fr.df.withColumns({"held": F.coalesce(pos, lit(0)), "turn": turn, "gross": F.coalesce(pos, lit(0)) * move,
                                     "net": F.coalesce(pos, lit(0)) * move - turn * cost}))


LEVELS = 4


def _levels(bars: DataFrame, size: int, width: int) -> list[DataFrame]:
    """symbol, _node, _in: bars by spans of time, spans by spans of spans, each with the extremes of what it holds."""
    x, parts = bars.select("symbol", epoch().alias("u"), "high", "low").where("u IS NOT NULL"), []
    for level in range(LEVELS):
        # never null, so that a join doesn't filter the bars in another way for each level, and all levels read one shuffle of them
        x = x.groupBy("symbol", F.coalesce(F.floor(c("u") / (width if level else size)), lit(0)).alias("_node"))
        x = x.agg(F.collect_list(F.struct("u", "high", "low")).alias("_in"), F.max("high").alias("high"), F.min("low").alias("low"))
        parts.append(x.select("symbol", "_node", "_in"))
        x = x.select("symbol", c("_node").alias("u"), "high", "low")
    return parts


def _look(level: int, low: Column, high: Column):
    return lambda node: F.struct(lit(level).alias("_level"), node.alias("_node"), low.cast("long").alias("_lo"), high.cast("long").alias("_hi"))


def excursions(trades: DataFrame, bars: DataFrame, step: int, width: int = 64) -> DataFrame:
    """Worst and best excursion of trades over the bars they were open.

    Bars stand in spans of ``width``, spans in spans of spans. A trade within one span looks into that alone, and is shuffled once. Others look
    into the two spans of bars at their ends; the whole spans between
    them they see through the two spans of spans at their ends, and so on: two looks a level, whatever the length, and one
    join by (symbol, level, node). Rows: id, symbol, entry_t, exit_t, direction, entry.
    """
    size, looks = step * width, []
    low, high = c("entry_t"), c("exit_t")
    within = F.coalesce((low <= high) & (F.floor(low / size) == F.floor(high / size)), lit(False))
    levels = _levels(bars, size, width)
    extremes = lambda inside: [F.array_max(F.transform(inside, lambda x: x["high"])).alias("_h"), F.array_min(F.transform(inside, lambda x: x["low"])).alias("_l")]
    t = trades.where(within).withColumn("_node", F.floor(low / size)).join(levels[0], ["symbol", "_node"], "left")
    inside = F.filter("_in", lambda x: (x["u"] >= c("entry_t")) & (x["u"] <= c("exit_t")))
    short = t.select(*trades.columns, inside.alias("_in")).select(*trades.columns, *extremes("_in"))
    for level in range(LEVELS):
        a, b = F.floor(low / (width if level else size)), F.floor(high / (width if level else size))
        nodes = F.sequence(a, b) if level == LEVELS - 1 else F.array_distinct(F.array(a, b))
        looks.append(when(low <= high, F.transform(nodes, _look(level, low, high))))
        low, high = a + 1, b - 1
    looks = F.flatten(F.array_compact(F.array(*looks)))
    row = [f"_r_{n}" for n in trades.columns]  # by columns, so that those nobody asks for are not carried
    t = trades.where(~within).select(*[c(n).alias(r) for n, r in zip(trades.columns, row)], F.monotonically_increasing_id().alias("_id"), "symbol", looks.alias("_looks"))
    t = t.select(*row, "_id", "symbol", F.posexplode_outer("_looks").alias("_at", "_look"))  # the first look alone carries the trade
    t = t.select(*[when(F.coalesce("_at", lit(0)) == 0, c(r)).alias(r) for r in row], "_id", "symbol", "_look.*")
    spans = reduce(DataFrame.unionByName, [x.withColumn("_level", lit(level)) for level, x in enumerate(levels)])
    inside = F.filter("_in", lambda x: (x["u"] >= c("_lo")) & (x["u"] <= c("_hi")))
    t = t.join(spans, ["symbol", "_level", "_node"], "left").select(*row, "_id", inside.alias("_in")).select(*row, "_id", *extremes("_in"))
    t = t.groupBy("_id").agg(*[F.first(r, ignorenulls=True).alias(n) for n, r in zip(trades.columns, row)], F.max("_h").alias("_h"), F.min("_l").alias("_l"))
    x = short.unionByName(t.drop("_id"))
    up, entry = c("direction") > 0, c("entry")
    best = when(up, F.greatest("_h", entry) - entry).otherwise(entry - F.least("_l", entry))
    worst = when(up, entry - F.least("_l", entry)).otherwise(F.greatest("_h", entry) - entry)
    zero = lit(0.0)
    return x.select(*trades.columns, F.coalesce(div(worst, entry), zero).alias("mae"), F.coalesce(div(best, entry), zero).alias("mfe"))


# --- chart indicators and evidence --------------------------------------------------------

def chart_series(panel: Panel, rsi: int = 14, kdj: int = 9, k: int = 3, d: int = 3) -> DataFrame:
    """KDJ with start value 50 and Wilder RSI, rounded to four places as charts show them."""
    from tidemark.operators.factors import factor_panel
    df = factor_panel(panel, {"k": {"factor": "kdj", "period": kdj, "k_period": k, "d_period": d, "output": "k"},
                              "d": {"factor": "kdj", "period": kdj, "k_period": k, "d_period": d, "output": "d"},
                              "rsi": {"factor": "rsi", "period": rsi}})
    return df.select(*panel.keys, *panel.order, *[F.round(x, 4).alias(x) for x in ("k", "d")],
                     F.round(3 * c("k") - 2 * c("d"), 4).alias("j"), F.round("rsi", 4).alias("rsi"))


def cross_event(a: Column, b: Column, pa: Column, pb: Column) -> Column:
    return when((pa <= pb) & (a > b), "golden_cross").when((pa >= pb) & (a < b), "death_cross")


def indicator_snapshot(panel: Panel) -> DataFrame:
    """Indicator block per bar: RSI, MACD with crosses, moving averages, levels, volatility, volume ratio."""
    safe = lambda w: when((c("high") > 0) & (c("low") > 0), c("tr")).otherwise(0.0)

    def parts(a):
        line = a.minus(a.ema(a["close"], 12), a.ema(a["close"], 26))
        rsi = a.zip(a.wilder(a["gain"], 14), a.wilder(a["loss"], 14), lambda g, l: when(l == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + g / F.nullif(l, lit(0.0)))))
        return {"rsi": rsi, "macd": line, "macd_signal": a.ema(line, 9), "atr": a.wilder(a["_str"], 14)}

    df = fold_frame(panel, mem(26) + mem(9) + 2, {"_str": safe}, parts, extra=PRICES)
    df = df.withColumns({"macd": F.round("macd", 6), "macd_signal": F.round("macd_signal", 6)})
    fr, w, df = windowed(panel.replace(df), 34)
    row = fr.row
    df = df.withColumns({
        "_pm": F.lag("macd").over(row), "_ps": F.lag("macd_signal").over(row), **{f"ma{n}": F.avg("close").over(w(n)) for n in (5, 10, 20)},
        "swing_high": F.max("high").over(w(20)), "swing_low": F.min("low").over(w(20)), "_sd": F.stddev_pop("close").over(w(20)),
        "_base": F.avg("volume").over(fr.between(-20, -1))})
    pivot, span = (c("ph") + c("pl") + c("prev")) / 3.0, c("ph") - c("pl")
    df = df.withColumns({"pivot": pivot, "r1": 2 * pivot - c("pl"), "s1": 2 * pivot - c("ph"), "r2": pivot + span, "s2": pivot - span,
                         "cross": cross_event(c("macd"), c("macd_signal"), c("_pm"), c("_ps"))})
    df = df.withColumns({
        "support": (c("s1") + c("swing_low") + F.round(c("ma20") - 2 * c("_sd"), 4)) / 3.0,
        "resistance": (c("r1") + c("swing_high") + F.round(c("ma20") + 2 * c("_sd"), 4)) / 3.0,
        "trend": stack_trend(c("close"), c("ma5"), c("ma10"), c("ma20")), "volatility": volatility_level(c("atr"), c("close")),
        "volume_ratio": when(c("_base") > 0, c("volume") / c("_base")).otherwise(1.0),
        "position": when(c("swing_high") > c("swing_low"), (c("close") - c("swing_low")) / (c("swing_high") - c("swing_low")) * 100).otherwise(50.0)})
    stop = F.greatest(when(c("atr") > 0, c("close") - 2 * c("atr")).otherwise(c("close") * 0.95), c("support") * 0.99)
    take = F.least(when(c("atr") > 0, c("close") + 3 * c("atr")).otherwise(c("close") * 1.05), c("resistance") * 1.01)
    df = df.withColumns({"stop_loss": stop, "take_profit": take}).withColumn(
        "risk_reward", when(c("close") > c("stop_loss"), (c("take_profit") - c("close")) / (c("close") - c("stop_loss"))).otherwise(0.0))
    return fr.own(df).where(c("pos") >= 33)


def technical_evidence(panel: Panel, ppy: float, horizons=(1, 5, 20)) -> DataFrame:
    """Evidence block per bar; what lacks history is null and listed in ``missing``."""
    df = fold_frame(panel, mem(200), {}, lambda a: {f"ema{n}": a.ema(a["close"], n) for n in (20, 60, 200)}, extra=PRICES)
    fr, w, df = windowed(panel.replace(df), 22)
    later = when(c("prev").isNotNull(), c("tr"))  # the first bar has no range against a close before it
    mean, sd = F.avg("close").over(w(20)), F.stddev_pop("close").over(w(20))
    base = F.avg("volume").over(fr.between(-20, -1))
    cols = {f"return_{h}": (div(c("close"), F.lag("close", h).over(fr.row)) - 1) * 100 for h in horizons}
    cols.update({
        "atr14": F.avg(later).over(w(14)), "volume_ratio": div(c("volume"), base),
        "volatility": when(F.count("ret").over(w(20)) == 20, F.stddev_samp("ret").over(w(20)) * math.sqrt(ppy) * 100),
        "bollinger": when(c("pos") >= 19, when(sd > 0, (c("close") - (mean - 2 * sd)) / (4 * sd)).otherwise(0.5)),
        "trend": when((c("close") > c("ema20")) & (c("ema20") > c("ema60")), "bullish").when((c("close") < c("ema20")) & (c("ema20") < c("ema60")), "bearish").otherwise("neutral")})
    df = df.withColumns(cols)
    names = [*[f"return_{h}" for h in horizons], "atr14", "volume_ratio", "volatility", "bollinger", "ema20", "ema60", "ema200"]
    return fr.own(df.withColumn("missing", F.array_compact(F.array(*[when(c(n).isNull(), n) for n in names]))))


def _clusters(values: Column, tolerance: Column) -> Column:
    """Greedy groups of sorted prices: a price joins the first group whose mean is near."""
    null = lit(None).cast("double")
    group = lambda s, n: F.struct(s.alias("s"), n.alias("n"))
    zero = F.struct(F.array().cast("array<struct<s:double,n:int>>").alias("done"), null.alias("s"), lit(0).alias("n"))
    with_last = lambda z: when(z["n"] > 0, F.concat(z["done"], F.array(group(z["s"], z["n"])))).otherwise(z["done"])

    # Prices ascend: one that is beyond a closed group's mean leaves all later ones beyond it, so only the last group is open.
    def add(z, v):
        near = F.abs(v - z["s"] / z["n"]) <= tolerance
        return when(near, F.struct(z["done"].alias("done"), (z["s"] + v).alias("s"), (z["n"] + 1).alias("n"))).otherwise(
            F.struct(with_last(z).alias("done"), v.alias("s"), lit(1).alias("n")))

    groups = F.aggregate(F.array_sort(values), zero, add, with_last)
    return F.transform(groups, lambda g: F.struct(F.round(g["s"] / g["n"], 8).alias("price"), g["n"].alias("touches")))


def support_resistance(panel: Panel, history: int = 120, levels: int = 3) -> DataFrame:
    """Nearest support and resistance clusters of the five-bar pivots before each bar."""
    fr, w, df = windowed(panel, history + 4, 2)
    lag, lead = (lambda x, k: F.lag(x, k).over(fr.row)), (lambda x, k: F.lead(x, k).over(fr.row))
    high = lambda x: F.greatest(lag(x, 2), lag(x, 1), lead(x, 1), lead(x, 2))
    low = lambda x: F.least(lag(x, 2), lag(x, 1), lead(x, 1), lead(x, 2))
    inside = (c("pos") >= 2)
    df = df.withColumns({"_ph": when(inside & (c("high") >= high("high")), c("high")), "_pl": when(inside & (c("low") <= low("low")), c("low")),
                         "atr": F.avg(when(c("prev").isNotNull(), c("tr"))).over(w(14))})
    prior, pivots = fr.between(-history, -1), fr.between(-(history - 2), -3)
    df = df.withColumns({"prior_high": F.max("high").over(prior), "prior_low": F.min("low").over(prior), "_n": F.count(lit(1)).over(prior),
                         "_hs": F.collect_list("_ph").over(pivots), "_ls": F.collect_list("_pl").over(pivots),
                         "_base": F.avg("volume").over(fr.between(-20, -1))})
    df = df.withColumn("tolerance", F.greatest(F.coalesce("atr", lit(0.0)) * 0.35, c("close") * 0.002))
    df = df.withColumns({"_sup": _clusters(F.concat("_ls", F.array("prior_low")), c("tolerance")), "_res": _clusters(F.concat("_hs", F.array("prior_high")), c("tolerance"))})

    def nearest(groups, keep):
        near = F.transform(F.filter(groups, keep), lambda g: F.struct(F.abs(c("close") - g["price"]).alias("d"), (-g["touches"]).alias("t"), g["price"].alias("price"), g["touches"].alias("touches")))
        return F.transform(F.slice(F.array_sort(near), 1, levels), lambda g: F.struct(g["price"].alias("price"), g["touches"].alias("touches")))

    df = df.withColumns({"supports": nearest(c("_sup"), lambda g: g["price"] <= c("close") + c("tolerance")),
                         "resistances": nearest(c("_res"), lambda g: g["price"] >= c("close") - c("tolerance")), "volume_ratio": div(c("volume"), c("_base"))})
    return fr.own(df.where(c("_n") >= 5)).drop("_ph", "_pl", "_n", "_hs", "_ls", "_sup", "_res", "_base")


def breakout_state(rows: DataFrame, volume: float = 1.2) -> DataFrame:
    """Close beyond the prior range by the tolerance, confirmed by volume or not."""
    up, down = c("close") > c("prior_high") + c("tolerance"), c("close") < c("prior_low") - c("tolerance")
    ok = F.coalesce(c("volume_ratio") >= volume, lit(False))
    state = when(up, when(ok, "confirmed_up").otherwise("unconfirmed_up")).when(down, when(ok, "confirmed_down").otherwise("unconfirmed_down")).otherwise("range")
    return rows.withColumn("state", state)


def drawdown_columns(curve: DataFrame, keys, time: str, value: str, initial: Column, grain: Column) -> DataFrame:
    """Running peak (from the initial value) and drawdown percent of a curve."""
    x = scan(curve, keys, [time], grain, _top=("max", value))
    return x.withColumn("peak", F.greatest("_top", initial)).withColumn("drawdown", when(c("peak") > 0, (c(value) / c("peak") - 1) * 100).otherwise(0.0)).drop("_top")

