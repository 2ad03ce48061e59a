"""Factor catalogue over weekly supplier bars, with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.registry import add
from tidemark.model import epoch
from tidemark.operators.factors import REGISTRY, factor_series, get_factor
from tidemark.plans.standins import weekly, with_sql

IDS = """sma ema sma_distance ema_distance momentum roc rsi macd bollinger_bands stochastic kdj cci williams_r
mfi adx aroon trix supertrend atr realized_volatility ema_slope atr_pct downside_volatility max_drawdown
donchian_channels keltner_channels volume_zscore volume_ratio mean_reversion_zscore turnover_proxy obv ad_line
chaikin_oscillator vwap cmf dema tema zlema hma kama ppo cmo awesome_oscillator ultimate_oscillator tsi vortex
choppiness efficiency_ratio elder_ray force_index ulcer_index parkinson_volatility garman_klass_volatility
amihud_illiquidity""".split()


def w(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def lag(expr: str, n: int = 1) -> str:
    return f"lag({expr}, {n}) OVER (PARTITION BY symbol ORDER BY pos)"


def emas(name: str, src: str, col: str, n: int, k: float | None = None, first: int | None = None) -> str:
    """Recursive CTE ``name(symbol, pos, y)``: smoothing of ``src.col`` seeded with a mean.

    ``first`` is the position of the first value of ``col``.
    """
    k = 2.0 / (n + 1.0) if k is None else k
    at = (first or 0) + n - 1
    return (f"{name}_s AS (SELECT symbol, pos, {col} AS v, avg({col}) {w(n)} AS m FROM {src} WHERE {col} IS NOT NULL), "
            f"{name} AS (SELECT symbol, pos, m AS y FROM {name}_s WHERE pos = {at} UNION ALL "
            f"SELECT s.symbol, s.pos, r.y + (s.v - r.y) * {k!r} FROM {name} r JOIN {name}_s s "
            f"ON s.symbol = r.symbol AND s.pos = r.pos + 1)")


def final(value: str, first: int, src: str = "x") -> str:
    return (f"SELECT symbol, t, round(value, 6) AS value FROM (SELECT *, {value} AS value FROM {src}) "
            f"WHERE pos >= {first} AND value IS NOT NULL AND isfinite(value)")


DRAW = "list_transform(generate_series(1, len(l)), lambda i: l[i] / list_max(l[1:i]) - 1)"
S: dict[str, str] = {}


def plain(id: str, value: str, src: str = "x", more: str = "") -> None:
    f = get_factor(id)
    S[id] = with_sql("x", more=more) + final(value, f.first(f.params), src)


plain("sma", f"avg(close) {w(20)}")
plain("sma_distance", f"close / avg(close) {w(20)} - 1")
plain("momentum", f"close / {lag('close', 60)} - 1")
plain("roc", f"close / {lag('close', 12)} - 1")
plain("bollinger_bands", f"""CASE WHEN stddev_pop(close) {w(20)} > 0 THEN
 (close - (avg(close) {w(20)} - 2 * stddev_pop(close) {w(20)})) / (4 * stddev_pop(close) {w(20)}) ELSE 0.5 END""")
plain("stochastic", f"avg(rk) {w(3)}", "y", f"""y AS (SELECT *, CASE WHEN pos >= 13 THEN
 100 * (close - min(low) {w(14)}) / nullif(max(high) {w(14)} - min(low) {w(14)}, 0) END AS rk FROM x)""")
plain("cci", "coalesce((tp - m) / nullif(0.015 * list_avg(list_transform(l, lambda v: abs(v - m))), 0), 0)", "y",
      f"y AS (SELECT *, list(tp) {w(20)} AS l, avg(tp) {w(20)} AS m FROM x)")
plain("williams_r", f"""coalesce(-100 * (max(high) {w(14)} - close) / nullif(max(high) {w(14)} - min(low) {w(14)}, 0), -50)""")
plain("mfi", "CASE WHEN mn <= 0 THEN 100 ELSE 100 - 100 / (1 + pl / mn) END", "y", f"""y AS (SELECT symbol, t, pos,
 sum(CASE WHEN tp > ptp THEN tp * volume ELSE 0 END) {w(14)} AS pl,
 sum(CASE WHEN tp < ptp THEN tp * volume ELSE 0 END) {w(14)} AS mn FROM x)""")
plain("aroon", "100.0 * list_position(hl, list_max(hl)) / 25 - 100.0 * list_position(ll, list_min(ll)) / 25", "y",
      f"y AS (SELECT *, list(high) {w(25)} AS hl, list(low) {w(25)} AS ll FROM x)")
plain("realized_volatility", f"stddev_samp(ret) {w(20)} * sqrt(252)")
plain("downside_volatility", f"sqrt(avg(least(ret, 0) * least(ret, 0)) {w(20)}) * sqrt(252)")
plain("max_drawdown", f"list_min({DRAW})", "y", f"y AS (SELECT *, list(close) {w(60)} AS l FROM x)")
plain("ulcer_index", f"sqrt(list_avg(list_transform({DRAW}, lambda v: 10000 * v * v)))", "y",
      f"y AS (SELECT *, list(close) {w(14)} AS l FROM x)")
plain("donchian_channels", f"coalesce((close - min(low) {w(20)}) / nullif(max(high) {w(20)} - min(low) {w(20)}, 0), 0.5)")
for _id, _c in (("volume_zscore", "volume"), ("mean_reversion_zscore", "close")):
    plain(_id, f"coalesce(({_c} - avg({_c}) {w(20)}) / nullif(stddev_samp({_c}) {w(20)}, 0), 0)")
plain("volume_ratio", f"volume / nullif(avg(volume) {w(20)}, 0)")
plain("turnover_proxy", f"avg(close * volume) {w(20)}")
plain("obv", f"coalesce(sum(signed) {w(20)} / nullif(sum(abs(volume)) {w(20)}, 0), 0)")
plain("ad_line", f"coalesce(sum(mfv) {w(20)} / nullif(sum(abs(volume)) {w(20)}, 0), 0)")
plain("vwap", f"close / (sum(tp * volume) {w(20)} / nullif(sum(volume) {w(20)}, 0)) - 1")
plain("cmf", f"coalesce(sum(mfv) {w(20)} / nullif(sum(volume) {w(20)}, 0), 0)")
plain("cmo", f"coalesce(100 * (sum(gain) {w(14)} - sum(loss) {w(14)}) / nullif(sum(gain) {w(14)} + sum(loss) {w(14)}, 0), 0)")
plain("awesome_oscillator", f"avg((high + low) / 2) {w(5)} - avg((high + low) / 2) {w(34)}")
plain("ultimate_oscillator", " + ".join(
    f"{k} * coalesce(sum(close - least(low, prev)) {w(n)} / nullif(sum(greatest(high, prev) - least(low, prev)) {w(n)}, 0), 0)"
    f" * 100 / 7.0" for k, n in ((4, 7), (2, 14), (1, 28))))
plain("vortex", f"coalesce((sum(abs(high - pl)) {w(14)} - sum(abs(low - ph)) {w(14)}) / nullif(sum(tr) {w(14)}, 0), 0)")
plain("choppiness", f"""CASE WHEN max(high) {w(14)} - min(low) {w(14)} <= 0 THEN 100 ELSE
 100 * log10(sum(tr) {w(14)} / (max(high) {w(14)} - min(low) {w(14)})) / log10(14) END""")
plain("efficiency_ratio", f"coalesce(abs(close - {lag('close', 10)}) / nullif(sum(abs(delta)) {w(10)}, 0), 0)")
plain("parkinson_volatility", f"sqrt(avg(ln(high / low) * ln(high / low)) {w(20)} / (4 * ln(2)) * 252)")
plain("garman_klass_volatility", f"""sqrt(greatest(avg(0.5 * ln(high / low) * ln(high / low)
 - (2 * ln(2) - 1) * ln(close / open) * ln(close / open)) {w(20)}, 0) * 252)""")
plain("amihud_illiquidity", f"avg(abs(ret) / nullif(close * volume, 0)) {w(20)}")
_wma = lambda l, n: f"list_dot_product({l}, [{', '.join(str(float(k)) for k in range(1, n + 1))}]) / {n * (n + 1) / 2}"
plain("hma", _wma("l", 4), "z", f"""y0 AS (SELECT *, list(close) {w(10)} AS l1, list(close) {w(20)} AS l2 FROM x),
 y AS (SELECT *, 2 * {_wma('l1', 10)} - {_wma('l2', 20)} AS raw FROM y0 WHERE pos >= 19),
 z0 AS (SELECT *, list(raw) {w(4)} AS l FROM y), z AS (SELECT * FROM z0 WHERE pos >= 22)""")


def folded(id: str, ctes: list[str], value: str, joins: list[str]) -> None:
    f = get_factor(id)
    src = "x " + " ".join(f"LEFT JOIN {j} USING (symbol, pos)" for j in joins)
    cols = ", ".join(f"{j}.y AS {j}" for j in joins)
    S[id] = (with_sql("x", recursive=True, more=", ".join(ctes))
             + final(value, f.first(f.params), f"(SELECT x.*, {cols} FROM {src})"))


folded("ema", [emas("e", "x", "close", 20)], "e", ["e"])
folded("ema_distance", [emas("e", "x", "close", 20)], "close / nullif(e, 0) - 1", ["e"])
folded("ema_slope", [emas("e", "x", "close", 20)], f"e / nullif({lag('e', 5)}, 0) - 1", ["e"])
folded("rsi", [emas("g", "x", "delta_gain", 14, 1 / 14, 1), emas("l", "x", "delta_loss", 14, 1 / 14, 1)],
       "CASE WHEN l <= 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END", ["g", "l"])
S["rsi"] = S["rsi"].replace("delta_gain", "CASE WHEN prev IS NOT NULL THEN gain END").replace(
    "delta_loss", "CASE WHEN prev IS NOT NULL THEN loss END")
folded("macd", [emas("f", "x", "close", 12), emas("s", "x", "close", 26),
                "m AS (SELECT s.symbol, s.pos, f.y - s.y AS line FROM s JOIN f USING (symbol, pos))",
                emas("g", "m", "line", 9, first=25), "ml AS (SELECT symbol, pos, line AS y FROM m)"], "ml - g", ["ml", "g"])
folded("ppo", [emas("f", "x", "close", 12), emas("s", "x", "close", 26)], "100 * (f - s) / nullif(s, 0)", ["f", "s"])
folded("atr", [emas("a", "x", "tr", 14, 1 / 14)], "a", ["a"])
folded("atr_pct", [emas("a", "x", "tr", 14, 1 / 14)], "a / nullif(close, 0)", ["a"])
folded("keltner_channels", [emas("e", "x", "close", 20), emas("a", "x", "tr", 10, 0.1)],
       "CASE WHEN a > 0 THEN (close - (e - 2 * a)) / (4 * a) ELSE 0.5 END", ["e", "a"])
folded("elder_ray", [emas("e", "x", "close", 13)], "high - e", ["e"])
folded("force_index", [emas("e", "x", "delta * volume", 13, first=1)], "e", ["e"])
folded("dema", [emas("e", "x", "close", 20), emas("f", "e", "y", 20, first=19)], "2 * e - f", ["e", "f"])
folded("tema", [emas("e", "x", "close", 20), emas("f", "e", "y", 20, first=19), emas("g", "f", "y", 20, first=38)],
       "3 * e - 3 * f + g", ["e", "f", "g"])
folded("trix", [emas("e", "x", "close", 15), emas("f", "e", "y", 15, first=14), emas("g", "f", "y", 15, first=28)],
       f"g / nullif({lag('g')}, 0) - 1", ["g"])
folded("zlema", [f"q AS (SELECT symbol, pos, 2 * close - {lag('close', 9)} AS v FROM x)",
                 emas("e", "q", "v", 20, first=9)], "e", ["e"])
folded("tsi", [emas("a", "x", "delta", 25, first=1), emas("b", "a", "y", 13, first=25),
               emas("cc", "x", "abs(delta)", 25, first=1), emas("d", "cc", "y", 13, first=25)],
       "coalesce(100 * b / nullif(d, 0), 0)", ["b", "d"])
folded("chaikin_oscillator", ["q AS (SELECT symbol, pos, sum(mfv) OVER (PARTITION BY symbol ORDER BY pos) AS ad FROM x)",
                              emas("f", "q", "ad", 3), emas("s", "q", "ad", 10)],
       f"coalesce((f - s) / nullif(avg(volume) {w(10)}, 0), 0)", ["f", "s"])
folded("kdj", [f"""q AS (SELECT symbol, pos, coalesce((close - min(low) {w(9)}) / nullif(max(high) {w(9)} - min(low) {w(9)}, 0)
 * 100, 50) AS rsv FROM x)""",
               """kd AS (SELECT symbol, pos, (2 * 50.0 + rsv) / 3 AS k, (2 * 50.0 + (2 * 50.0 + rsv) / 3) / 3 AS d FROM q WHERE pos = 8
 UNION ALL SELECT q.symbol, q.pos, (2 * k + rsv) / 3, (2 * d + (2 * k + rsv) / 3) / 3 FROM kd JOIN q
 ON q.symbol = kd.symbol AND q.pos = kd.pos + 1)""", "kdy AS (SELECT symbol, pos, 3 * k - 2 * d AS y FROM kd)"],
       "kdy", ["kdy"])
_tr0 = "CASE WHEN prev IS NOT NULL THEN tr END"
_up0 = "CASE WHEN prev IS NULL THEN NULL WHEN high - ph > pl - low AND high > ph THEN high - ph ELSE 0 END"
_dn0 = "CASE WHEN prev IS NULL THEN NULL WHEN pl - low > high - ph AND pl > low THEN pl - low ELSE 0 END"
folded("adx", [emas("a", "x", _tr0, 14, 1 / 14, 1), emas("u", "x", _up0, 14, 1 / 14, 1), emas("d", "x", _dn0, 14, 1 / 14, 1),
               """q AS (SELECT a.symbol, a.pos, coalesce(100 * abs(u.y - d.y) / nullif(u.y + d.y, 0), 0) AS dx
 FROM a JOIN u USING (symbol, pos) JOIN d USING (symbol, pos))""", emas("g", "q", "dx", 1, 1 / 14, 14)], "g", ["g"])
folded("kama", [f"""q AS (SELECT symbol, pos, close, avg(close) {w(10)} AS m, power(coalesce(abs(close - {lag('close', 10)})
 / nullif(sum(abs(delta)) {w(10)}, 0), 0) * (2 / 3.0 - 2 / 31.0) + 2 / 31.0, 2) AS sc FROM x)""",
                """k AS (SELECT symbol, pos, m AS y FROM q WHERE pos = 9 UNION ALL
 SELECT q.symbol, q.pos, k.y + q.sc * (q.close - k.y) FROM k JOIN q ON q.symbol = k.symbol AND q.pos = k.pos + 1)"""],
       "k", ["k"])
folded("supertrend", [emas("a", "x", "tr", 10, 0.1), """q AS (SELECT x.symbol, x.pos, x.close, x.prev,
 (high + low) / 2 + 3 * a.y AS bu, (high + low) / 2 - 3 * a.y AS bl FROM x JOIN a USING (symbol, pos))""",
                      """r AS (SELECT symbol, pos, bu AS u, bl AS l, CAST(1 AS DOUBLE) AS y FROM q WHERE pos = 9 UNION ALL
 SELECT symbol, pos, u, l, CASE WHEN y < 0 AND close > u THEN 1 WHEN y > 0 AND close < l THEN -1 ELSE y END FROM (
 SELECT q.symbol, q.pos, q.close, r.y, CASE WHEN q.bu < r.u OR q.prev > r.u THEN q.bu ELSE r.u END AS u,
 CASE WHEN q.bl > r.l OR q.prev < r.l THEN q.bl ELSE r.l END AS l
 FROM r JOIN q ON q.symbol = r.symbol AND q.pos = r.pos + 1))"""], "r", ["r"])


def _series(id):
    def run(spark, d):
        out = factor_series(weekly(spark, d), id)
        return out.select("symbol", epoch().alias("t"), F.round("value", 6).alias("value"))
    return run


for _n, _id in enumerate(IDS, start=1):
    add(f"f{_n:02d}_{_id}", _series(_id), S.get(_id))
assert set(IDS) <= set(REGISTRY)
