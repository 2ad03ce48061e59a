"""Catalogue of technical and fundamental factors over bar panels.

A factor is declared once: the fields it needs, its defaults, how many earlier bars
it looks at, the first position that has a value and the expression.  Three shapes:

* window factors are plain expressions over bounded frames;
* smoothings (one EMA or Wilder average of a column) run on windows alone, over any length,
  and go on over missing values (see ``functions.smoothing``);
* other recursive factors are array folds over a chunk with enough earlier
  rows for the start value to vanish (see ``functions.folds``).

Ids, categories, required fields, default parameters and outputs are fixed values.

``factor_series`` gives one row per bar (the value on the prefix that ends there),
``factor_last`` one row per symbol, ``factor_panel`` several factors side by side.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.folds import Chunk, memory
from tidemark.functions.smoothing import smoothed
from tidemark.model import PRICES, Panel, div, finite

YEAR = math.sqrt(252.0)
MAX_PERIOD = 5000


class FactorError(ValueError):
    """A parameter or a field is not usable."""


@dataclass(frozen=True)
class Factor:
    id: str
    category: str
    direction: str
    fields: tuple[str, ...]
    params: dict
    first: Callable[[dict], int]
    back: Callable[[dict], int]
    value: Callable
    kind: str = "window"
    steps: dict | Callable[[dict], dict] = field(default_factory=dict)
    outputs: tuple[str, ...] = ()
    check: Callable[[dict], bool] | None = None
    series: Callable[[dict], dict] | None = None

    @property
    def factor_type(self) -> str:
        return "fundamental" if self.kind == "fundamental" else "technical"


REGISTRY: dict[str, Factor] = {}


def _add(id, category, direction, fields, params, first, value, back=None, **more):
    REGISTRY[id] = Factor(id, category, direction, tuple(fields.split()), params, first,
                          back or first, value, **more)


def list_factors(category: str = "", factor_type: str = "") -> list[dict]:
    found = [f for f in REGISTRY.values()
             if category in ("", f.category) and factor_type in ("", f.factor_type)]
    return sorted(
        ({"factor_id": f.id, "category": f.category, "factor_type": f.factor_type,
          "direction": f.direction, "required_fields": list(f.fields),
          "default_params": dict(f.params), "warmup": f.first(f.params) + 1} for f in found),
        key=lambda m: (m["factor_type"], m["category"], m["factor_id"]))


def get_factor(id: str) -> Factor:
    try:
        return REGISTRY[str(id).strip()]
    except KeyError:
        raise FactorError(f"unknown factor {id!r}") from None


def settle(f: Factor, given: dict) -> dict:
    """Defaults, then the given values, checked before any job starts."""
    unknown = set(given) - set(f.params)
    if unknown:
        raise FactorError(f"{f.id} has no parameter {sorted(unknown)}")
    p = {**f.params, **given}
    for name, v in p.items():
        if name == "output":
            if v not in f.outputs:
                raise FactorError(f"{f.id}: output must be one of {f.outputs}")
        elif isinstance(f.params[name], float):
            if not (isinstance(v, (int, float)) and math.isfinite(v) and v > 0):
                raise FactorError(f"{f.id}: {name} must be positive")
        else:
            low = 1 if name in ("smooth_k", "smooth_d", "k_period", "d_period", "slope_period") or (
                f.id == "kama" and name == "fast_period") else 2
            if not low <= int(v) <= MAX_PERIOD:
                raise FactorError(f"{f.id}: {name} must lie in {low}..{MAX_PERIOD}")
            p[name] = int(v)
    if f.check and not f.check(p):
        raise FactorError(f"{f.id}: inconsistent periods")
    return p


# --- base columns shared by the expressions (Catalyst prunes the unused ones) -------

def with_base(df: DataFrame, row) -> DataFrame:
    c = F.col
    df = df.withColumns({
        "prev": F.lag("close").over(row),
        "ph": F.lag("high").over(row),
        "pl": F.lag("low").over(row),
        "tp": (c("high") + c("low") + c("close")) / 3.0,
    })
    spread = F.nullif(c("high") - c("low"), F.lit(0.0))
    return df.withColumns({
        "ptp": F.lag("tp").over(row),
        "delta": c("close") - c("prev"),
        "ret": div(c("close"), c("prev")) - 1.0,
        "tr": F.greatest(c("high") - c("low"), F.abs(c("high") - c("prev")), F.abs(c("low") - c("prev"))),
        "vol": F.coalesce(c("volume"), F.lit(0.0)),
    }).withColumns({
        "gain": F.when(c("delta").isNotNull(), F.greatest(c("delta"), F.lit(0.0))),
        "loss": F.when(c("delta").isNotNull(), F.greatest(-c("delta"), F.lit(0.0))),
        "mfv": F.coalesce(((c("close") - c("low")) - (c("high") - c("close"))) / spread, F.lit(0.0)) * c("vol"),
        "signed": F.signum(F.coalesce(c("delta"), F.lit(0.0))) * c("vol"),
    })


c = F.col
P = lambda *names: (lambda p: sum(p[n] for n in names))
N1 = lambda p: p["period"] - 1
N = lambda p: p["period"]
hi = lambda w, n: F.max("high").over(w(n))
lo = lambda w, n: F.min("low").over(w(n))


def _pick(p, **choices):
    return choices[p["output"]]()


def _position(x, low, high):
    return F.when(high > low, (x - low) / (high - low)).otherwise(0.5)


# --- window factors ------------------------------------------------------------------

def _distance(x, avg):
    return div(x, avg) - 1.0


_add("sma", "trend", "neutral", "close", {"period": 20}, N1,
     lambda w, p: F.avg("close").over(w(p["period"])))
_add("sma_distance", "trend", "higher_is_bullish", "close", {"period": 20}, N1,
     lambda w, p: _distance(c("close"), F.avg("close").over(w(p["period"]))))
for _id, _n in (("momentum", 60), ("roc", 12)):
    _add(_id, "momentum", "higher_is_bullish", "close", {"period": _n}, N,
         lambda w, p: div(c("close"), F.lag("close", p["period"]).over(w.row)) - 1.0)


def _bollinger(w, p):
    win = w(p["period"])
    mid, sd = F.avg("close").over(win), F.stddev_pop("close").over(win) * p["stddev"]
    up, low = mid + sd, mid - sd
    return _pick(p, upper=lambda: up, middle=lambda: mid, lower=lambda: low,
                 bandwidth=lambda: div(up - low, mid),
                 position=lambda: _position(c("close"), low, up))


_add("bollinger_bands", "volatility", "neutral", "close",
     {"period": 20, "stddev": 2.0, "output": "position"}, N1, _bollinger,
     outputs=("upper", "middle", "lower", "bandwidth", "position"))


def _full(agg, col, w, n):
    """A window value that is missing when any of its rows is."""
    return F.when(F.count(col).over(w(n)) == n, agg(col).over(w(n)))


_add("stochastic", "momentum", "neutral", "high low close",
     {"period": 14, "smooth_k": 3, "smooth_d": 3, "output": "k"},
     lambda p: p["period"] + p["smooth_k"] + p["smooth_d"] - 3,
     lambda w, p: c("_sk") if p["output"] == "k" else _full(F.avg, "_sk", w, p["smooth_d"]),
     steps={"_raw": lambda w, p: div(100.0 * (c("close") - _full(F.min, "low", w, p["period"])),
                                     _full(F.max, "high", w, p["period"]) - _full(F.min, "low", w, p["period"])),
            "_sk": lambda w, p: _full(F.avg, "_raw", w, p["smooth_k"])},
     outputs=("k", "d"))


def _cci(w, p):
    rows = F.collect_list("tp").over(w(p["period"]))
    mean = F.avg("tp").over(w(p["period"]))
    off = F.aggregate(rows, F.lit(0.0), lambda a, x: a + F.abs(x - mean)) / p["period"]
    return F.when(off > 0, (c("tp") - mean) / (0.015 * off)).otherwise(0.0)


_add("cci", "momentum", "neutral", "high low close", {"period": 20}, N1, _cci)
_add("williams_r", "momentum", "neutral", "high low close", {"period": 14}, N1,
     lambda w, p: F.when(hi(w, p["period"]) <= lo(w, p["period"]), -50.0).otherwise(
         -100.0 * (hi(w, p["period"]) - c("close")) / (hi(w, p["period"]) - lo(w, p["period"]))))


def _mfi(w, p):
    flow = c("tp") * c("vol")
    plus = F.sum(F.when(c("tp") > c("ptp"), flow).otherwise(0.0)).over(w(p["period"]))
    minus = F.sum(F.when(c("tp") < c("ptp"), flow).otherwise(0.0)).over(w(p["period"]))
    return F.when(minus <= 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + plus / minus))


_add("mfi", "volume", "neutral", "high low close volume", {"period": 14}, N, _mfi)


def _aroon(w, p):
    n = p["period"]
    up = F.array_position(F.collect_list("high").over(w(n)), hi(w, n)) * 100.0 / n
    down = F.array_position(F.collect_list("low").over(w(n)), lo(w, n)) * 100.0 / n
    return _pick(p, up=lambda: up, down=lambda: down, oscillator=lambda: up - down)


_add("aroon", "trend", "higher_is_bullish", "high low", {"period": 25, "output": "oscillator"}, N1, _aroon,
     outputs=("up", "down", "oscillator"))
_add("realized_volatility", "risk", "lower_is_bullish", "close", {"period": 20}, N,
     lambda w, p: F.stddev_samp("ret").over(w(p["period"])) * YEAR)
_add("downside_volatility", "risk", "lower_is_bullish", "close", {"period": 20}, N,
     lambda w, p: F.sqrt(F.avg(F.pow(F.least(c("ret"), F.lit(0.0)), 2)).over(w(p["period"]))) * YEAR)


def _underwater(w, p):
    """Drawdowns inside the window: array of close / running max - 1."""
    zero = F.struct(F.lit(0.0).alias("m"), F.lit(0.0).alias("d"), F.lit(0.0).alias("q"))

    def step(a, x):
        m = F.greatest(a["m"], x)
        d = x / m - 1.0
        return F.struct(m.alias("m"), F.least(a["d"], d).alias("d"), (a["q"] + d * d).alias("q"))

    return F.aggregate(F.collect_list("close").over(w(p["period"])), zero, step)


def _falls(p):
    """Columns with the extremes and the deepest fall of ever longer windows, each made of two shorter ones.

    The deepest fall of two neighbouring windows is that of one of them, or from the top of the first to the bottom of the second.
    """
    def join(a, b):
        across = F.when(a["hi"] > 0, b["lo"] / a["hi"] - 1.0)
        both = F.struct(F.greatest(a["hi"], b["hi"]).alias("hi"), F.least(a["lo"], b["lo"]).alias("lo"), F.least(a["d"], b["d"], across).alias("d"))
        return F.when(a.isNull(), b).otherwise(both)

    one = F.struct(F.greatest("close", F.lit(0.0)).alias("hi"), F.coalesce("close", F.lit(float("inf"))).alias("lo"), F.lit(0.0).alias("d"))
    made, size, n = {"_fall1": lambda w, p: one}, 1, p["period"]
    while 2 * size <= n:
        made[f"_fall{2 * size}"] = lambda w, p, k=size: join(F.lag(f"_fall{k}", k).over(w.row), c(f"_fall{k}"))
        size *= 2
    name, done = f"_fall{size}", size
    while done < n:
        size = 1 << ((n - done).bit_length() - 1)
        made[f"_fall{done + size}of{n}"] = lambda w, p, k=size, far=done, near=name: join(F.lag(f"_fall{k}", far).over(w.row), c(near))
        name, done = f"_fall{done + size}of{n}", done + size
    made[f"_falls{n}"] = lambda w, p, last=name: c(last)
    return made


def _deepest(w, p):
    """Below zero, or after a price that is no number, a fall isn't made of two: these windows are looked through."""
    x = c(f"_falls{p['period']}")
    return F.when((x["lo"] < 0) | F.isnan(x["hi"]), _underwater(w, p)["d"]).otherwise(x["d"])


_add("max_drawdown", "risk", "higher_is_bullish", "close", {"period": 60}, N1, _deepest, steps=_falls)
_add("ulcer_index", "risk", "lower_is_bullish", "close", {"period": 14}, N1,
     lambda w, p: F.sqrt(10000.0 * _underwater(w, p)["q"] / p["period"]))


def _donchian(w, p):
    up, low = hi(w, p["period"]), lo(w, p["period"])
    return _pick(p, upper=lambda: up, lower=lambda: low, middle=lambda: (up + low) / 2.0,
                 position=lambda: _position(c("close"), low, up))


_add("donchian_channels", "volatility", "neutral", "high low close",
     {"period": 20, "output": "position"}, N1, _donchian, outputs=("upper", "middle", "lower", "position"))


def _zscore(col):
    def value(w, p):
        win = w(p["period"])
        sd = F.stddev_samp(col).over(win)
        return F.when(sd > 0, (c(col) - F.avg(col).over(win)) / sd).otherwise(0.0)
    return value


_add("volume_zscore", "liquidity", "neutral", "volume", {"period": 20}, N1, _zscore("volume"))
_add("mean_reversion_zscore", "reversal", "lower_is_bullish", "close", {"period": 20}, N1, _zscore("close"))
_add("volume_ratio", "liquidity", "higher_is_bullish", "volume", {"period": 20}, N1,
     lambda w, p: div(c("volume"), F.avg("volume").over(w(p["period"]))))
_add("turnover_proxy", "liquidity", "higher_is_bullish", "close volume", {"period": 20}, N1,
     lambda w, p: F.avg(c("close") * c("volume")).over(w(p["period"])))


def _flow_slope(col):
    def value(w, p):
        if p["output"] == "value":
            return c(f"{col}_total")
        n = p["period"]
        size = F.sum(F.abs("volume")).over(w(n))
        return F.when(size != 0, F.sum(col).over(w(n)) / size).otherwise(0.0)
    return value


_slope = dict(outputs=("value", "slope"))
_flow_first = lambda p: 0 if p["output"] == "value" else p["period"]
_add("obv", "volume", "higher_is_bullish", "close volume", {"period": 20, "output": "slope"},
     _flow_first, _flow_slope("signed"), back=N, **_slope)
_add("ad_line", "volume", "higher_is_bullish", "high low close volume", {"period": 20, "output": "slope"},
     _flow_first, _flow_slope("mfv"), back=N, **_slope)


def _vwap(w, p):
    win = w(p["period"])
    size = F.sum("vol").over(win)
    v = F.when(size > 0, F.sum(c("tp") * c("vol")).over(win) / size)
    return v if p["output"] == "value" else _distance(c("close"), v)


_add("vwap", "volume", "higher_is_bullish", "high low close volume", {"period": 20, "output": "distance"},
     N1, _vwap, outputs=("value", "distance"))
_add("cmf", "volume", "higher_is_bullish", "high low close volume", {"period": 20}, N1,
     lambda w, p: F.coalesce(div(F.sum("mfv").over(w(p["period"])), F.sum("vol").over(w(p["period"]))), F.lit(0.0)))


def _wma(col, n, w):
    arr = F.collect_list(col).over(w(n))
    dot = F.aggregate(F.zip_with(arr, F.sequence(F.lit(1), F.lit(n)), lambda x, k: x * k),
                      F.lit(0.0), lambda a, x: a + x)
    return dot / (n * (n + 1) / 2.0)


_root = lambda p: max(1, int(math.sqrt(p["period"])))
_add("hma", "trend", "neutral", "close", {"period": 20}, lambda p: p["period"] + _root(p) - 1,
     lambda w, p: _wma("_hraw", _root(p), w),
     steps={"_hraw": lambda w, p: 2.0 * _wma("close", max(1, p["period"] // 2), w) - _wma("close", p["period"], w)})


def _cmo(w, p):
    g, l = F.sum("gain").over(w(p["period"])), F.sum("loss").over(w(p["period"]))
    return F.coalesce(div(100.0 * (g - l), g + l), F.lit(0.0))


_add("cmo", "momentum", "neutral", "close", {"period": 14}, N, _cmo)
_fast_slow = dict(check=lambda p: p["fast_period"] < p["slow_period"])
_add("awesome_oscillator", "momentum", "higher_is_bullish", "high low",
     {"fast_period": 5, "slow_period": 34}, lambda p: p["slow_period"] - 1,
     lambda w, p: F.avg((c("high") + c("low")) / 2.0).over(w(p["fast_period"]))
     - F.avg((c("high") + c("low")) / 2.0).over(w(p["slow_period"])), **_fast_slow)


def _ultimate(w, p):
    floor = F.least("low", "prev")
    buying, span = c("close") - floor, F.greatest("high", "prev") - floor

    def part(n):
        return F.coalesce(div(F.sum(buying).over(w(n)), F.sum(span).over(w(n))), F.lit(0.0))

    return 100.0 * (4.0 * part(p["fast_period"]) + 2.0 * part(p["medium_period"]) + part(p["slow_period"])) / 7.0


_add("ultimate_oscillator", "momentum", "neutral", "high low close",
     {"fast_period": 7, "medium_period": 14, "slow_period": 28}, P("slow_period"), _ultimate,
     check=lambda p: p["fast_period"] < p["medium_period"] < p["slow_period"])


def _vortex(w, p):
    win = w(p["period"])
    span = F.sum("tr").over(win)
    plus = F.sum(F.abs(c("high") - c("pl"))).over(win)
    minus = F.sum(F.abs(c("low") - c("ph"))).over(win)
    top = _pick(p, plus=lambda: plus, minus=lambda: minus, oscillator=lambda: plus - minus)
    return F.when(span > 0, top / span).otherwise(0.0)


_add("vortex", "trend", "higher_is_bullish", "high low close", {"period": 14, "output": "oscillator"},
     N, _vortex, outputs=("plus", "minus", "oscillator"))
_add("choppiness", "trend", "lower_is_bullish", "high low close", {"period": 14}, N,
     lambda w, p: F.when(hi(w, p["period"]) - lo(w, p["period"]) <= 0, 100.0).otherwise(
         100.0 * F.log10(F.sum("tr").over(w(p["period"])) / (hi(w, p["period"]) - lo(w, p["period"])))
         / math.log10(p["period"])))
_add("efficiency_ratio", "trend", "higher_is_bullish", "close", {"period": 10}, N,
     lambda w, p: F.coalesce(div(F.abs(c("close") - F.lag("close", p["period"]).over(w.row)),
                                 F.sum(F.abs("delta")).over(w(p["period"]))), F.lit(0.0)))


def _log2(a, b):
    return F.pow(F.ln(a / F.nullif(b, F.lit(0.0))), 2)


_add("parkinson_volatility", "risk", "lower_is_bullish", "high low", {"period": 20}, N1,
     lambda w, p: F.sqrt(F.greatest(F.avg(_log2(c("high"), c("low"))).over(w(p["period"]))
                                    / (4.0 * math.log(2.0)), F.lit(0.0)) * 252.0))
_add("garman_klass_volatility", "risk", "lower_is_bullish", "open high low close", {"period": 20}, N1,
     lambda w, p: F.sqrt(F.greatest(F.avg(
         0.5 * _log2(c("high"), c("low")) - (2.0 * math.log(2.0) - 1.0) * _log2(c("close"), c("open"))
     ).over(w(p["period"])), F.lit(0.0)) * 252.0))
_add("amihud_illiquidity", "liquidity", "lower_is_bullish", "close volume", {"period": 20}, N,
     lambda w, p: _full(F.avg, "_ill", w, p["period"]),
     steps={"_ill": lambda w, p: div(F.abs("ret"), c("close") * c("volume"))})

# --- recursive factors: ``a`` holds the arrays of a chunk (functions.folds.Chunk) -------

mem = lambda n: memory(2.0 / (n + 1.0))
wmem = lambda n: memory(1.0 / n)


def _fold(id, category, direction, fields, params, first, value, back, **more):
    _add(id, category, direction, fields, params, first, value, back, kind="fold", **more)


def _smooth(id, category, direction, fields, params, first, value, series, **more):
    """``series`` gives named smoothings (value, how many values seed it, gain), from which ``value`` makes the result."""
    _add(id, category, direction, fields, params, first, value, lambda p: 1, kind="smooth", series=series, **more)


ema = lambda x, n: (x, n, 2.0 / (n + 1.0))
wilder = lambda x, n: (x, n, 1.0 / n)
_smooth("ema", "trend", "neutral", "close", {"period": 20}, N1, lambda v, p: v["m"], lambda p: {"m": ema("close", p["period"])})
_smooth("ema_distance", "trend", "higher_is_bullish", "close", {"period": 20}, N1,
        lambda v, p: div(c("close"), v["m"]) - 1.0, lambda p: {"m": ema("close", p["period"])})
_fold("rsi", "momentum", "neutral", "close", {"period": 14}, N,
      lambda a, p: a.zip(a.wilder(a["gain"], p["period"]), a.wilder(a["loss"], p["period"]),
                         lambda g, l: F.when(l <= 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + g / l))),
      lambda p: wmem(p["period"]) + 1)


def _macd(a, p):
    line = a.minus(a.ema(a["close"], p["fast_period"]), a.ema(a["close"], p["slow_period"]))
    return _pick(p, line=lambda: line, signal=lambda: a.ema(line, p["signal_period"]),
                 histogram=lambda: a.minus(line, a.ema(line, p["signal_period"])))


_fold("macd", "trend", "higher_is_bullish", "close",
      {"fast_period": 12, "slow_period": 26, "signal_period": 9, "output": "histogram"},
      lambda p: p["slow_period"] + p["signal_period"] - 2, _macd,
      lambda p: mem(p["slow_period"]) + mem(p["signal_period"]),
      outputs=("line", "signal", "histogram"), **_fast_slow)


def _kdj(a, p):
    k = a.smooth(a["_rsv"], 1, 1.0 / p["k_period"], start=50.0)
    d = a.smooth(k, 1, 1.0 / p["d_period"], start=50.0)
    return _pick(p, k=lambda: k, d=lambda: d, j=lambda: a.zip(k, d, lambda x, y: 3.0 * x - 2.0 * y))


_fold("kdj", "momentum", "neutral", "high low close",
      {"period": 9, "k_period": 3, "d_period": 3, "output": "j"}, N1, _kdj,
      lambda p: p["period"] + memory(1.0 / p["k_period"]) + memory(1.0 / p["d_period"]),
      steps={"_rsv": lambda w, p: F.when(c("pos") < p["period"] - 1, None).when(
          hi(w, p["period"]) <= lo(w, p["period"]), 50.0).otherwise(
          (c("close") - lo(w, p["period"])) / (hi(w, p["period"]) - lo(w, p["period"])) * 100.0)},
      outputs=("k", "d", "j"))


def _di(a, dm, n):
    return a.zip(a.wilder(a[dm], n), a.wilder(a["_ttr"], n), lambda x, t: F.when(
        t.isNotNull(), F.coalesce(div(100.0 * x, t), F.lit(0.0))))


def _adx(a, p):
    n = p["period"]
    plus, minus = _di(a, "_up", n), _di(a, "_down", n)
    # the first DX seeds the average
    gap = a.zip(plus, minus, lambda x, y: F.when(
        x.isNotNull(), F.coalesce(div(100.0 * F.abs(x - y), x + y), F.lit(0.0))))
    return _pick(p, plus_di=lambda: plus, minus_di=lambda: minus, adx=lambda: a.smooth(gap, 1, 1.0 / n))


_moves = {
    "_ttr": lambda w, p: F.when(c("prev").isNotNull(), c("tr")),
    "_up": lambda w, p: F.when(c("prev").isNotNull(), F.when(
        (c("high") - c("ph") > c("pl") - c("low")) & (c("high") > c("ph")), c("high") - c("ph")).otherwise(0.0)),
    "_down": lambda w, p: F.when(c("prev").isNotNull(), F.when(
        (c("pl") - c("low") > c("high") - c("ph")) & (c("pl") > c("low")), c("pl") - c("low")).otherwise(0.0)),
}
_fold("adx", "trend", "neutral", "high low close", {"period": 14, "output": "adx"}, N, _adx,
      lambda p: 2 * wmem(p["period"]) + 2, steps=_moves, outputs=("adx", "plus_di", "minus_di"))


def _again(a, arr, n, times):
    for _ in range(times):
        arr = a.ema(arr, n)
    return arr


_fold("trix", "trend", "higher_is_bullish", "close", {"period": 15}, lambda p: 3 * p["period"],
      lambda a, p: (lambda t: a.zip(t, a.shift(t, 1), lambda x, y: div(x, y) - 1.0))(_again(a, a["close"], p["period"], 3)),
      lambda p: 3 * mem(p["period"]) + 1)
_smooth("atr", "volatility", "neutral", "high low close", {"period": 14}, N1, lambda v, p: v["r"], lambda p: {"r": wilder("tr", p["period"])})
_smooth("atr_pct", "risk", "lower_is_bullish", "high low close", {"period": 14}, N1,
        lambda v, p: div(v["r"], c("close")), lambda p: {"r": wilder("tr", p["period"])})
_fold("ema_slope", "trend", "higher_is_bullish", "close", {"period": 20, "slope_period": 5},
      lambda p: p["period"] + p["slope_period"] - 1,
      lambda a, p: (lambda e: a.zip(e, a.shift(e, p["slope_period"]), lambda x, y: div(x, y) - 1.0))(
          a.ema(a["close"], p["period"])), lambda p: mem(p["period"]) + p["slope_period"])


def _keltner(v, p):
    up, low = (v["m"] + s * p["multiplier"] * v["r"] for s in (1.0, -1.0))
    return _pick(p, upper=lambda: up, lower=lambda: low, middle=lambda: v["m"], position=lambda: _position(c("close"), low, up))


_smooth("keltner_channels", "volatility", "neutral", "high low close",
        {"period": 20, "atr_period": 10, "multiplier": 2.0, "output": "position"},
        lambda p: max(p["period"], p["atr_period"]) - 1, _keltner,
        lambda p: {"m": ema("close", p["period"]), "r": wilder("tr", p["atr_period"])},
        outputs=("upper", "middle", "lower", "position"))
# an EMA difference does not depend on where the running sum starts
_fold("chaikin_oscillator", "volume", "higher_is_bullish", "high low close volume",
      {"fast_period": 3, "slow_period": 10}, lambda p: p["slow_period"] - 1,
      lambda a, p: (lambda ad: a.zip(a.minus(a.ema(ad, p["fast_period"]), a.ema(ad, p["slow_period"])), a["_scale"],
                                     lambda x, s: F.coalesce(div(x, s), F.lit(0.0))))(a.cumsum(a["mfv"])),
      lambda p: mem(p["slow_period"]) + p["slow_period"],
      steps={"_scale": lambda w, p: F.avg("volume").over(w(p["slow_period"]))}, **_fast_slow)


def _multi(times, f):
    def value(a, p):
        first = a.ema(a["close"], p["period"])
        return f(a, first, *[_again(a, first, p["period"], k) for k in range(1, times)])
    return value


_fold("dema", "trend", "neutral", "close", {"period": 20}, lambda p: 2 * p["period"] - 2,
      _multi(2, lambda a, x, y: a.zip(x, y, lambda s, t: 2.0 * s - t)), lambda p: 2 * mem(p["period"]))
_fold("tema", "trend", "neutral", "close", {"period": 20}, lambda p: 3 * p["period"] - 3,
      _multi(3, lambda a, x, y, z: a.zip(a.zip(x, y, lambda s, t: 3.0 * s - 3.0 * t), z, lambda s, t: s + t)),
      lambda p: 3 * mem(p["period"]))
_lag = lambda p: max(1, (p["period"] - 1) // 2)
_fold("zlema", "trend", "neutral", "close", {"period": 20}, lambda p: p["period"] + _lag(p) - 1,
      lambda a, p: a.ema(a.zip(a["close"], a.shift(a["close"], _lag(p)), lambda x, y: x + (x - y)), p["period"]),
      lambda p: mem(p["period"]) + _lag(p))


def _kama(a, p):
    pair = a.zip(a["close"], a["_sc"], lambda x, k: F.struct(x.alias("x"), k.alias("k")))
    return a.smooth(pair, p["period"], lambda e: e["k"], value=lambda e: e["x"])


def _kama_gain(w, p):
    n, fast, slow = p["period"], 2.0 / (p["fast_period"] + 1.0), 2.0 / (p["slow_period"] + 1.0)
    er = F.coalesce(div(F.abs(c("close") - F.lag("close", n).over(w.row)), F.sum(F.abs("delta")).over(w(n))), F.lit(0.0))
    return F.pow(er * (fast - slow) + slow, 2)


_fold("kama", "trend", "neutral", "close", {"period": 10, "fast_period": 2, "slow_period": 30}, N, _kama,
      lambda p: memory((2.0 / (p["slow_period"] + 1.0)) ** 2) + p["period"],
      steps={"_sc": _kama_gain}, **_fast_slow)
_fold("ppo", "momentum", "higher_is_bullish", "close", {"fast_period": 12, "slow_period": 26},
      lambda p: p["slow_period"] - 1,
      lambda a, p: a.zip(a.ema(a["close"], p["fast_period"]), a.ema(a["close"], p["slow_period"]),
                         lambda f, s: div(100.0 * (f - s), s)), lambda p: mem(p["slow_period"]), **_fast_slow)


def _tsi(a, p):
    def twice(arr):
        return a.ema(a.ema(arr, p["slow_period"]), p["fast_period"])
    size = twice(a.map(a["delta"], lambda x: F.abs(x)))
    return a.zip(twice(a["delta"]), size, lambda x, y: F.coalesce(div(100.0 * x, y), F.lit(0.0)))


_fold("tsi", "momentum", "neutral", "close", {"slow_period": 25, "fast_period": 13},
      lambda p: p["slow_period"] + p["fast_period"], _tsi,
      lambda p: mem(p["slow_period"]) + mem(p["fast_period"]) + 1)
_smooth("elder_ray", "momentum", "neutral", "high low close", {"period": 13, "output": "bull"}, N1,
        lambda v, p: c("high" if p["output"] == "bull" else "low") - v["m"], lambda p: {"m": ema("close", p["period"])}, outputs=("bull", "bear"))
_fold("force_index", "volume", "higher_is_bullish", "close volume", {"period": 13}, N,
      lambda a, p: a.ema(a.zip(a["delta"], a["volume"], lambda d, v: d * v), p["period"]),
      lambda p: mem(p["period"]) + 1)

# --- supertrend: bands are Wilder folds, the carry is not linear ----------------------

_add("supertrend", "trend", "higher_is_bullish", "high low close",
     {"period": 10, "multiplier": 3.0, "output": "direction"}, N, None,
     lambda p: wmem(p["period"]) + 1, kind="carry", outputs=("direction", "line"))

# --- fundamental factors: the last visible report (see operators.asof) ----------------


def _ratio(num, den):
    return lambda w, p: div(c(num), c(den))


_now = lambda p: 0
for _id, _cat, _dir, _fields in (
        ("earnings_yield", "valuation", "higher_is_bullish", "net_income market_cap"),
        ("book_to_price", "valuation", "higher_is_bullish", "shareholder_equity market_cap"),
        ("return_on_equity", "quality", "higher_is_bullish", "net_income shareholder_equity"),
        ("debt_to_equity", "quality", "lower_is_bullish", "total_debt shareholder_equity"),
        ("free_cash_flow_yield", "cashflow", "higher_is_bullish", "free_cash_flow market_cap")):
    _add(_id, _cat, _dir, _fields, {}, _now, _ratio(*_fields.split()), kind="fundamental")
_add("market_cap", "size", "lower_is_bullish", "market_cap", {}, _now, lambda w, p: c("market_cap"), kind="fundamental")
_add("revenue_growth", "growth", "higher_is_bullish", "revenue_growth", {}, _now,
     lambda w, p: c("revenue_growth"), kind="fundamental")


# --- evaluation -----------------------------------------------------------------------

class _Frame:
    """Window maker handed to the expressions."""

    def __init__(self, framed):
        self.row = framed.row
        self._w = framed.w

    def __call__(self, n):
        return self._w(n)


def _prepare(panel: Panel, fields) -> Panel:
    missing = set(fields) - set(panel.df.columns)
    if missing:
        raise FactorError(f"missing fields {sorted(missing)}")
    if len(fields) == 1:
        panel = panel.dropna(*fields)
    else:
        panel = panel.clean(*fields)
    absent = [f for f in ("open", "high", "low", "close", "volume") if f not in panel.df.columns]
    return panel.replace(panel.df.withColumns({f: F.lit(None).cast("double") for f in absent}))


def _windows(panel: Panel, wanted: dict[str, tuple[Factor, dict]]) -> DataFrame:
    back = max(f.back(p) for f, p in wanted.values()) + 1
    if any(p.get("output") == "value" and f.id in ("obv", "ad_line") for f, p in wanted.values()):
        panel = _with_totals(panel)
    fr = panel.frame(back)
    w = _Frame(fr)
    df = with_base(fr.df, fr.row)
    for f, p in wanted.values():
        for name, expr in (f.steps(p) if callable(f.steps) else f.steps).items():
            df = df.withColumn(name, expr(w, p))
    df = df.withColumns({n: F.when(c("pos") >= f.first(p), f.value(w, p)) for n, (f, p) in wanted.items()})
    return fr.own(df)


def _with_totals(panel: Panel) -> Panel:
    """Running OBV and accumulation/distribution over the whole history."""
    fr = panel.number().frame(1)
    df = fr.own(with_base(fr.df, fr.row))
    names = panel.df.columns
    return panel.replace(df.select(*names, "signed", "mfv")).scan(
        signed_total=("sum", "signed"), mfv_total=("sum", "mfv"))


FOLD_FIELDS = ("open", "high", "low", "close", "volume", "gain", "loss", "delta", "tr", "mfv")


def fold_frame(panel: Panel, back: int, steps: dict, outputs: Callable, extra=(), skip: bool = False) -> DataFrame:
    """Run array folds per chunk.

    ``steps`` adds columns by window first; ``outputs`` maps the arrays of a chunk to
    named result arrays.  One shuffle for the positions, one for the chunks.
    """
    fr = panel.frame(back)
    w = _Frame(fr)
    df = with_base(fr.df, fr.row)
    for name, expr in steps.items():
        df = df.withColumn(name, expr(w))
    fields = [*FOLD_FIELDS, *steps]
    keep = [k for k in dict.fromkeys((*panel.order, *extra)) if k not in fields]
    rows = F.array_sort(F.collect_list(F.struct("pos", "_own", *keep, *fields)))
    g = df.groupBy(*panel.keys, "_chunk").agg(rows.alias("rows"))
    chunk = Chunk(fields, skip)
    results = outputs(chunk)
    g = g.select(*panel.keys, "rows", *[F.col(f"rows.{f}").alias(f) for f in fields])
    g = chunk.apply(g).select(*panel.keys, "rows", *[col.alias(n) for n, col in results.items()])
    g = g.select(*panel.keys, F.explode(F.arrays_zip("rows", *results)).alias("z"))
    return g.where("z.rows._own").select(
        *panel.keys, *[F.col(f"z.rows.{k}") for k in keep], F.col("z.rows.pos").alias("pos"),
        *[F.col(f"z.rows.{e}").alias(e) for e in extra if e in fields],
        *[F.col(f"z.{n}").alias(n) for n in results])


def _folds(panel: Panel, wanted: dict[str, tuple[Factor, dict]]) -> DataFrame:
    back = max(f.back(p) for f, p in wanted.values())
    steps = {}
    for f, p in wanted.values():
        for name, expr in f.steps.items():
            steps[name] = lambda w, expr=expr, p=p: expr(w, p)
    df = fold_frame(panel, back, steps, lambda a: {n: f.value(a, p) for n, (f, p) in wanted.items()}, skip=True)
    return df.withColumns({n: F.when(c("pos") >= f.first(p), c(n)) for n, (f, p) in wanted.items()})


def _smooths(panel: Panel, wanted: dict[str, tuple[Factor, dict]]) -> DataFrame:
    """One smoothing for each series that the factors need, by :func:`tidemark.functions.smoothing.smoothed`."""
    series = {n: f.series(p) for n, (f, p) in wanted.items()}
    todo = {s: f"_y{i}" for i, s in enumerate(dict.fromkeys(s for own in series.values() for s in own.values()))}
    df = panel.df
    if any(x == "tr" for x, _, _ in todo):
        fr = panel.frame(1)
        df = fr.own(with_base(fr.df, fr.row)).select(*panel.keys, *panel.order, *PRICES, *sorted({x for x, _, _ in todo} - {*PRICES}))
    for (x, n, k), name in todo.items():
        df = smoothed(df, panel.keys, panel.order, panel.grain, x, n, k, name)
    ready = lambda own: reduce(Column.__and__, [c(todo[s]).isNotNull() for s in own.values()])
    return df.withColumns({n: F.when(ready(series[n]), f.value({v: c(todo[s]) for v, s in series[n].items()}, p)) for n, (f, p) in wanted.items()})


def factor_panel(panel: Panel, wanted: dict[str, dict] | list[str]) -> DataFrame:
    """Several factors per bar: one pass for each way of treating missing rows."""
    if not isinstance(wanted, dict):
        wanted = {w: {} for w in wanted}
    plans: dict = {}
    for name, given in wanted.items():
        given = dict(given)
        f = get_factor(given.pop("factor", name))
        p = settle(f, given)
        clash = tuple(p.items()) if f.steps else ()
        lone = f.fields[0] if len(f.fields) == 1 and f.kind != "fundamental" else f.fields
        plans.setdefault((f.kind, lone, clash), {})[name] = (f, p)
    out = None
    keys = [*panel.keys, *panel.order]
    for (kind, _, _), part in plans.items():
        fields = sorted({x for f, _ in part.values() for x in f.fields})
        if kind == "fundamental":
            df = panel.clean(*fields).df.withColumns({n: f.value(None, p) for n, (f, p) in part.items()})
        elif kind == "carry":
            from tidemark.operators.supertrend import supertrend
            (name, (f, p)), = part.items()
            df = supertrend(_prepare(panel, fields), **p).withColumnRenamed("value", name)
        else:
            ready = _prepare(panel, fields)
            df = {"window": _windows, "fold": _folds, "smooth": _smooths}[kind](ready, part)
        df = df.select(*keys, *[finite(c(n)).alias(n) for n in part])
        out = df if out is None else out.join(df, keys, "full")
    return out


def factor_series(panel: Panel, id: str, **params) -> DataFrame:
    """The factor's value at every bar that has one."""
    df = factor_panel(panel, {"value": {"factor": id, **params}})
    return df.where("value IS NOT NULL")


def factor_last(panel: Panel, id: str, **params) -> DataFrame:
    """The value at the last bar of each symbol; symbols without one are absent."""
    f = get_factor(id)
    p = settle(f, params)
    df = panel.df
    if f.kind not in ("carry", "fundamental", "smooth") and not (f.id in ("obv", "ad_line") and p["output"] == "value"):
        ready = _prepare(panel, f.fields).number()
        size = ready.df.groupBy(*panel.keys).agg(F.max("pos").alias("_end"))
        need = f.first(p) + f.back(p) + 2
        panel = panel.replace(ready.df.join(size, list(panel.keys)).where(c("pos") > c("_end") - need))
    series = factor_panel(panel, {"value": {"factor": id, **params}})
    last = series.groupBy(*panel.keys).agg(
        *[F.max(o).alias(o) for o in panel.order], F.max_by("value", F.struct(*panel.order)).alias("value"))
    return last.where("value IS NOT NULL")
