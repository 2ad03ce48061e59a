"""Feature series, regimes, signals and chart evidence over weekly supplier bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.registry import query
from tidemark.model import Panel, epoch
from tidemark.operators import features as X
from tidemark.operators.factors import fold_frame, mem
from tidemark.plans.factors import emas, lag, w
from tidemark.plans.standins import HOUR, WEEK, hourly, seconds, table, weekly, with_sql

c, lit, when = F.col, F.lit, F.when
R = lambda n, *names: [F.round(x, n).alias(x) for x in names]
def T():
    return epoch().alias("t")



def gappy(spark, d) -> Panel:
    """Weekly bars with some closes missing."""
    p = weekly(spark, d)
    return p.replace(p.df.withColumn("close", when(c("volume").cast("long") % 41 != 0, c("close"))))


GAPS = """gb AS (SELECT symbol, t, open, high, low, CASE WHEN CAST(volume AS BIGINT) % 41 <> 0 THEN close END AS close, volume, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS pos FROM bars),
 ge AS (SELECT symbol, pos, t, close, CASE WHEN close IS NULL THEN NULL WHEN 1 = 5 THEN close END AS y, CASE WHEN close IS NULL THEN 0 ELSE 1 END AS n, coalesce(close, 0) AS s FROM gb WHERE pos = 0
 UNION ALL SELECT g.symbol, g.pos, g.t, g.close, CASE WHEN g.close IS NULL THEN NULL WHEN r.y IS NOT NULL THEN r.y + (g.close - r.y) / 3.0 WHEN r.n + 1 = 5 THEN (r.s + g.close) / 5 END,
 CASE WHEN g.close IS NULL OR r.y IS NOT NULL THEN 0 ELSE r.n + 1 END, CASE WHEN g.close IS NULL OR r.y IS NOT NULL THEN 0 ELSE r.s + g.close END FROM ge r JOIN gb g ON g.symbol = r.symbol AND g.pos = r.pos + 1)"""


@query("w1_ema_reseed", with_sql("bars", recursive=True, more=GAPS) + "SELECT symbol, t, round(y, 6) AS ema FROM ge WHERE y IS NOT NULL")
def _(spark, d):
    p = X.moving_averages(gappy(spark, d), ema=5)
    return p.df.where("ema IS NOT NULL").select("symbol", T(), *R(6, "ema"))


@query("w2_ema_slope_distance", with_sql("bars", recursive=True, more=GAPS) + """SELECT symbol, t, round(y - lag(y) OVER s, 6) AS slope, round(close / y - 1, 6) AS distance FROM ge WINDOW s AS (PARTITION BY symbol ORDER BY pos) QUALIFY y IS NOT NULL""")
def _(spark, d):
    return X.ema_features(gappy(spark, d), 5).where("ema IS NOT NULL").select("symbol", T(), *R(6, "slope", "distance"))


@query("w3_session_vwap", with_sql("hbars") + """SELECT symbol, t, round(sum(CASE WHEN volume > 1 THEN (high + low + close) / 3 * volume END) OVER s / sum(CASE WHEN volume > 1 THEN volume END) OVER s, 6) AS vwap FROM hbars WINDOW s AS (PARTITION BY symbol, t // 86400 ORDER BY t)""")
def _(spark, d):
    p = hourly(spark, d)
    p = p.replace(p.df.withColumn("volume", when(c("volume") > 1, c("volume")).otherwise(0.0)))
    return X.session_vwap(p, F.floor(epoch() / 86400)).select("symbol", T(), *R(6, "vwap"))


@query("w4_rolling_vwap", with_sql("x") + f"""SELECT symbol, t, round(CASE WHEN count(*) FILTER (CAST(volume AS BIGINT) % 53 <> 0) {w(10)} = 10 THEN sum(tp * volume) {w(10)} / sum(volume) {w(10)} END, 6) AS vwap FROM x""")
def _(spark, d):
    p = weekly(spark, d)
    p = p.replace(p.df.withColumn("volume", when(c("volume").cast("long") % 53 != 0, c("volume")).otherwise(0.0)))
    fr, win, df = X.windowed(p, 10)
    return fr.own(df.withColumn("vwap", X.rolling_vwap_expr(win, 10))).select("symbol", T(), *R(6, "vwap"))


STACK = f"tr AS (SELECT *, avg(close) {w(5)} AS f, avg(close) {w(10)} AS m, avg(close) {w(20)} AS s FROM x), dr AS (SELECT *, CASE WHEN pos < 19 THEN NULL WHEN f > m AND m > s THEN 1 WHEN f < m AND m < s THEN -1 ELSE 0 END AS dir FROM tr)"


def stack(spark, d):
    fr, win, df = X.windowed(weekly(spark, d), 20)
    df = df.withColumns({k: when(c("pos") >= n - 1, F.avg("close").over(win(n))) for k, n in (("f", 5), ("m", 10), ("s", 20))})
    return weekly(spark, d).replace(fr.own(df.withColumn("dir", X.trend_direction("f", "m", "s"))))


@query("w5_trend_direction", with_sql("x", more=STACK) + "SELECT symbol, t, CAST(dir AS INTEGER) AS dir FROM dr WHERE dir IS NOT NULL")
def _(spark, d):
    return stack(spark, d).df.where("dir IS NOT NULL").select("symbol", T(), "dir")


@query("w6_trend_strength", with_sql("x", more=STACK) + f"""SELECT symbol, t, round(CASE WHEN count(dir) {w(10)} = count(*) {w(10)} THEN (CASE dir WHEN 1 THEN count(*) FILTER (dir = 1) {w(10)} WHEN -1 THEN count(*) FILTER (dir = -1) {w(10)} ELSE count(*) FILTER (dir = 0) {w(10)} END) / count(*) {w(10)} END, 6) AS strength FROM dr""")
def _(spark, d):
    return X.trend_strength(stack(spark, d), "dir", 10).select("symbol", T(), *R(6, "strength"))


@query("w7_roc", with_sql("x") + f"SELECT symbol, t, round(100 * (close / {lag('close', 9)} - 1), 6) AS roc FROM x QUALIFY pos >= 9")
def _(spark, d):
    fr, _, df = X.windowed(weekly(spark, d), 9)
    return fr.own(df.withColumn("roc", 100 * (F.try_divide("close", F.lag("close", 9).over(fr.row)) - 1))).where("pos >= 9").select("symbol", T(), *R(6, "roc"))


@query("w8_stochastic", with_sql("x", more=f"k AS (SELECT *, CASE WHEN pos >= 4 THEN coalesce(100 * (close - min(low) {w(5)}) / nullif(max(high) {w(5)} - min(low) {w(5)}, 0), 50) END AS k FROM x)") + f"SELECT symbol, t, round(k, 6) AS k, round(CASE WHEN count(k) {w(3)} = 3 THEN avg(k) {w(3)} END, 6) AS d FROM k")
def _(spark, d):
    return X.stochastic_features(weekly(spark, d), 5, 3).select("symbol", T(), *R(6, "k", "d"))


@query("w9_atr_wilder", with_sql("x", recursive=True, more=emas("a", "x", "tr", 10, 0.1)) + "SELECT x.symbol, t, tr, round(y, 6) AS atr FROM x LEFT JOIN a USING (symbol, pos)")
def _(spark, d):
    df = fold_frame(weekly(spark, d), mem(19) + 2, {}, lambda a: {"atr": a.wilder(a["tr"], 10)}, extra=("tr",))
    return df.select("symbol", T(), "tr", *R(6, "atr"))


@query("w10_rolling_percentile", with_sql("x", more=f"l AS (SELECT *, list(close) {w(30)} AS l FROM x)") + """SELECT symbol, t, round((len(list_filter(l, lambda v: v < close)) + 0.5 * (len(list_filter(l, lambda v: v = close)) - 1) + 0.5) / len(l), 6) AS percentile FROM l""")
def _(spark, d):
    return X.rolling_percentile(weekly(spark, d), "close", 30).select("symbol", T(), *R(6, "percentile"))


@query("w11_bandwidth", with_sql("x") + f"SELECT symbol, t, round(400 * stddev_pop(close) {w(20)} / avg(close) {w(20)}, 6) AS bandwidth, round(stddev_pop(close) {w(20)}, 6) AS deviation FROM x QUALIFY pos >= 19")
def _(spark, d):
    return X.spread_features(weekly(spark, d), 20).where("pos >= 19").select("symbol", T(), *R(6, "bandwidth", "deviation"))


LR = f"""lr AS (SELECT *, ln(close / prev) AS lr FROM x), a AS (SELECT *, list(lr) {w(16)} AS l, avg(lr) {w(16)} AS m, stddev_pop(lr) {w(16)} AS s, min(lr) {w(16)} AS lo, max(lr) {w(16)} AS hi FROM lr)"""


def returns(spark, d):
    return X.return_features(weekly(spark, d), 16, 52.0, lag=2, bins=6).where("pos >= 16")


@query("w12_log_volatility", with_sql("x", more=LR) + "SELECT symbol, t, round(s * sqrt(52), 6) AS volatility FROM a WHERE pos >= 16")
def _(spark, d):
    return returns(spark, d).select("symbol", T(), *R(6, "volatility"))


@query("w13_relative_volume", with_sql("x") + f"SELECT symbol, t, round(volume / avg(volume) {w(20)}, 6) AS relative_volume FROM x QUALIFY pos >= 19")
def _(spark, d):
    return X.volume_features(weekly(spark, d), 20).where("pos >= 19").select("symbol", T(), *R(6, "relative_volume"))


@query("w14_obv_cmf", with_sql("x", more="""v AS (SELECT symbol, t, pos, CAST(volume AS BIGINT) % 29 <> 0 AS ok, close, volume, mfv FROM x), q AS (SELECT *, last_value(CASE WHEN ok THEN close END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pc FROM v)""") + f"""
 SELECT symbol, t, sum(CASE WHEN NOT ok THEN 0 WHEN close > pc THEN volume WHEN close < pc THEN -volume ELSE 0 END) OVER (PARTITION BY symbol ORDER BY pos) AS obv, round(CASE WHEN count(*) FILTER (ok) {w(15)} = 15 THEN sum(mfv) {w(15)} / sum(volume) {w(15)} END, 6) AS cmf FROM q QUALIFY count(*) FILTER (ok) OVER (PARTITION BY symbol ORDER BY pos) > 0""")
def _(spark, d):
    p = weekly(spark, d)
    p = p.replace(p.df.withColumn("open", when(c("volume").cast("long") % 29 != 0, c("open"))))
    return X.volume_features(p, 15).where("obv IS NOT NULL").select("symbol", T(), "obv", *R(6, "cmf"))


@query("w15_moments", with_sql("x", more=f"l AS (SELECT *, list(close) {w(20)} AS l, avg(close) {w(20)} AS m, var_pop(close) {w(20)} AS v FROM x)") + """SELECT symbol, t, round(list_avg(list_transform(l, lambda z: power(z - m, 3))) / power(v, 1.5), 5) AS skew, round(list_avg(list_transform(l, lambda z: power(z - m, 4))) / power(v, 2) - 3, 5) AS kurtosis FROM l WHERE pos >= 19""")
def _(spark, d):
    return X.moment_features(weekly(spark, d), 20).where("pos >= 19").select("symbol", T(), *R(5, "skew", "kurtosis"))


@query("w16_hurst", with_sql("x", more=LR + ", k AS (SELECT *, list_transform(generate_series(1, 16), lambda i: list_sum(l[1:i]) - i * m) AS z FROM a WHERE pos >= 16)") + "SELECT symbol, t, round(log2((greatest(0, list_max(z)) - least(0, list_min(z))) / s) / log2(16), 6) AS hurst FROM k")
def _(spark, d):
    return returns(spark, d).select("symbol", T(), *R(6, "hurst"))


@query("w17_autocorrelation", with_sql("x", more=LR) + "SELECT symbol, t, round(list_sum(list_transform(generate_series(3, 16), lambda i: (l[i] - m) * (l[i - 2] - m))) / (s * s * 16), 6) AS autocorr FROM a WHERE pos >= 16")
def _(spark, d):
    return returns(spark, d).select("symbol", T(), *R(6, "autocorr"))


@query("w18_entropy", with_sql("x", more=LR + ", b AS (SELECT *, list_transform(l, lambda z: least(floor((z - lo) / (hi - lo) * 6), 5)) AS c FROM a WHERE pos >= 16)") + """
 SELECT symbol, t, round(list_sum(list_transform(generate_series(0, 5), lambda k: CASE WHEN len(list_filter(c, lambda z: z = k)) > 0 THEN -(len(list_filter(c, lambda z: z = k)) / 16.0) * log2(len(list_filter(c, lambda z: z = k)) / 16.0) ELSE 0 END)), 6) AS entropy FROM b""")
def _(spark, d):
    return returns(spark, d).select("symbol", T(), *R(6, "entropy"))


@query("w19_efficiency", with_sql("x") + f"SELECT symbol, t, round(coalesce(abs(close - {lag('close', 10)}) / nullif(sum(abs(delta)) {w(10)}, 0), 1), 6) AS efficiency FROM x QUALIFY pos >= 10")
def _(spark, d):
    return X.efficiency(weekly(spark, d), 10).where("pos >= 10").select("symbol", T(), *R(6, "efficiency"))


_TR = "CASE WHEN prev IS NOT NULL THEN tr END"
_UP = "CASE WHEN prev IS NULL THEN NULL WHEN high - ph > pl - low AND high > ph THEN high - ph ELSE 0 END"
_DN = "CASE WHEN prev IS NULL THEN NULL WHEN pl - low > high - ph AND pl > low THEN pl - low ELSE 0 END"
ADX = ", ".join([emas("wt", "x", _TR, 14, 1 / 14, 1), emas("wu", "x", _UP, 14, 1 / 14, 1), emas("wd", "x", _DN, 14, 1 / 14, 1),
                 """dxq AS (SELECT wt.symbol, wt.pos, 100 * wu.y / wt.y AS pdi, 100 * wd.y / wt.y AS mdi, coalesce(100 * abs(wu.y - wd.y) / nullif(wu.y + wd.y, 0), 0) AS dx FROM wt JOIN wu USING (symbol, pos) JOIN wd USING (symbol, pos))""",
                 emas("wg", "dxq", "dx", 14, 1 / 14, 14)])


@query("w20_adx_series", with_sql("x", recursive=True, more=ADX) + "SELECT x.symbol, t, round(pdi, 6) AS pdi, round(mdi, 6) AS mdi, round(wg.y, 6) AS adx FROM x JOIN dxq USING (symbol, pos) LEFT JOIN wg USING (symbol, pos)")
def _(spark, d):
    return X.adx_series(weekly(spark, d), 14).where("pdi IS NOT NULL").select("symbol", T(), *R(6, "pdi", "mdi", "adx"))


# trends are rarely strong in this data: a lower bar lets the carry of a trend show
CFG = {"adx_trend": 18.0, "adx_strong": 20.0, "di_gap": 1.0, "slope_bars": 3, "range_band": 0.1, "relvol_breakout": 1.1, "mr_dev_atr": 0.5, "abnormal_range_atr_mult": 2.5}
REG = ", ".join([ADX, emas("f", "x", "close", 20), emas("s", "x", "close", 50), emas("atr", "x", "tr", 14, 1 / 14), f"""
 j AS (SELECT x.*, wg.y AS adx, pdi, mdi, f.y AS ef, s.y AS es, atr.y AS ar, atr.y / close AS ap0 FROM x LEFT JOIN dxq USING (symbol, pos) LEFT JOIN wg USING (symbol, pos) LEFT JOIN f USING (symbol, pos) LEFT JOIN s USING (symbol, pos) LEFT JOIN atr USING (symbol, pos)),
 j1 AS (SELECT *, ef - {lag('ef')} AS st, list(ap0) FILTER (ap0 IS NOT NULL) {w(100)} AS apl, CASE WHEN pos >= 19 THEN sum(tp * volume) {w(20)} / sum(volume) {w(20)} END AS v, CASE WHEN pos >= 19 THEN volume / avg(volume) {w(20)} END AS rv,
  max(close) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS hi, min(close) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS lo FROM j),
 j2 AS (SELECT *, CASE WHEN count(st) {w(2)} = 2 THEN min(st) {w(2)} > 0 ELSE false END AS su, CASE WHEN count(st) {w(2)} = 2 THEN max(st) {w(2)} < 0 ELSE false END AS sd,
  CASE WHEN ap0 IS NOT NULL THEN (len(list_filter(apl, lambda z: z < ap0)) + 0.5 * (len(list_filter(apl, lambda z: z = ap0)) - 1) + 0.5) / len(apl) END AS ap FROM j1),
 j3 AS (SELECT *, CASE WHEN adx IS NULL OR ef IS NULL OR es IS NULL OR ap IS NULL OR v IS NULL THEN 'TRANSITION' WHEN high - low >= 2.5 * ar THEN 'ABNORMAL' WHEN ap >= 0.8 THEN 'HIGH_VOLATILITY' WHEN adx >= 18 AND ef > es AND su AND pdi - mdi >= 1 THEN 'TRENDING_UP' WHEN adx >= 18 AND ef < es AND sd AND mdi - pdi >= 1 THEN 'TRENDING_DOWN' END AS pre,
  CASE WHEN rv >= 1.1 AND (close > hi OR close < lo) THEN 'BREAKOUT' WHEN ar > 0 AND abs(close - v) / ar >= 0.5 AND adx <= 20 THEN 'MEAN_REVERSION' WHEN abs((close - v) / v) <= 0.1 AND adx < 18 THEN 'RANGING' WHEN ap <= 0.2 THEN 'LOW_VOLATILITY' ELSE 'TRANSITION' END AS post FROM j2),
 rg AS (SELECT symbol, pos, coalesce(pre, post) AS regime FROM j3 WHERE pos = 0 UNION ALL SELECT j.symbol, j.pos, CASE WHEN pre IS NOT NULL THEN pre WHEN adx >= 20 AND rg.regime = 'TRENDING_UP' AND ef > es AND pdi > mdi THEN 'TRENDING_UP' WHEN adx >= 20 AND rg.regime = 'TRENDING_DOWN' AND ef < es AND mdi > pdi THEN 'TRENDING_DOWN' ELSE post END
  FROM rg JOIN j3 j ON j.symbol = rg.symbol AND j.pos = rg.pos + 1)"""])
REGSQL = with_sql("x", recursive=True, more=REG)


def regimes(spark, d, *keep, **more):
    return X.detect_regimes(weekly(spark, d), keep, **CFG, **more)


@query("w21_regimes", REGSQL + "SELECT symbol, t, regime FROM rg JOIN x USING (symbol, pos)")
def _(spark, d):
    return regimes(spark, d).select("symbol", T(), "regime")


@query("w22_channel_slope", REGSQL + "SELECT symbol, t, hi, lo, su AS slope_up, sd AS slope_dn FROM j2")
def _(spark, d):
    return X.regime_inputs(weekly(spark, d), {**X.REGIME, **CFG}).df.select("symbol", T(), c("ch_hi").alias("hi"), c("ch_lo").alias("lo"), "slope_up", "slope_dn")


@query("w23_cross_signal", REGSQL + "SELECT symbol, t, CASE WHEN regime NOT IN ('TRENDING_UP', 'TRENDING_DOWN', 'TRANSITION', 'BREAKOUT') THEN 0 WHEN ef > es THEN 1 WHEN ef < es THEN -1 ELSE 0 END AS signal FROM rg JOIN j3 USING (symbol, pos)")
def _(spark, d):
    return X.cross_signals(regimes(spark, d, "ef", "es")).select("symbol", T(), "signal")


RSI = ", " + emas("rgn", "x", "CASE WHEN prev IS NOT NULL THEN gain END", 14, 1 / 14, 1) + ", " + emas("rls", "x", "CASE WHEN prev IS NOT NULL THEN loss END", 14, 1 / 14, 1)


@query("w24_reversion_signal", with_sql("x", recursive=True, more=REG + RSI) + """SELECT symbol, t, CASE WHEN regime NOT IN ('RANGING', 'TRANSITION', 'MEAN_REVERSION') THEN 0 WHEN 100 - 100 / (1 + rgn.y / rls.y) < 45 THEN 1 WHEN 100 - 100 / (1 + rgn.y / rls.y) > 55 THEN -1 ELSE 0 END AS signal FROM x JOIN rg USING (symbol, pos) LEFT JOIN rgn USING (symbol, pos) LEFT JOIN rls USING (symbol, pos)""")
def _(spark, d):
    return X.reversion_signals(regimes(spark, d, "rsi", rsi_period=14), "rsi", 45.0, 55.0, shorts=True).select("symbol", T(), "signal")


@query("w25_breakout_signal", REGSQL + "SELECT symbol, t, CASE WHEN regime = 'BREAKOUT' AND close > hi AND rv >= 1.3 THEN 1 ELSE 0 END AS signal FROM rg JOIN j3 USING (symbol, pos)")
def _(spark, d):
    return X.breakout_signals(regimes(spark, d, "close", "ch_hi", "relvol"), 1.3).select("symbol", T(), "signal")


SIG = f"sg AS (SELECT *, CASE WHEN close > avg(close) {w(10)} THEN 1 WHEN close < avg(close) {w(10)} THEN -1 ELSE 0 END AS signal FROM x)"


@query("w26_signal_returns", with_sql("x", more=SIG + f", h AS (SELECT *, coalesce({lag('signal')}, 0) AS held, coalesce({lag('signal', 2)}, 0) AS before, lead(open) OVER (PARTITION BY symbol ORDER BY pos) / open - 1 AS mv FROM sg)") + """
 SELECT symbol, t, held, round(held * mv, 6) AS gross, round(held * mv - abs(held - before) * 0.001, 6) AS net FROM h""")
def _(spark, d):
    p = weekly(spark, d)
    fr, win, df = X.windowed(p, 10)
    mean = F.avg("close").over(win(10))
    sig = fr.own(df.withColumn("signal", when(c("close") > mean, 1).when(c("close") < mean, -1).otherwise(0)))
    return X.signal_returns(p.replace(sig.select("symbol", "ts", "open", "pos", "signal")), "signal").select("symbol", T(), "held", *R(6, "gross", "net"))


EXC = """tq AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || CAST(epoch(l_shipdate) AS BIGINT) || '-' || l_suppkey AS id, CAST(epoch(l_shipdate) AS BIGINT) AS a, CAST(epoch(l_shipdate) AS BIGINT) + CAST(l_quantity AS BIGINT) * 604800 AS b, CASE WHEN l_linestatus = 'F' THEN 1 ELSE -1 END AS dir, l_extendedprice / l_quantity AS e FROM lineitem),
 xq AS (SELECT id, any_value(dir) AS dir, any_value(e) AS e, greatest(any_value(e), max(high)) AS hi, least(any_value(e), min(low)) AS lo FROM tq LEFT JOIN bars ON bars.symbol = tq.symbol AND t BETWEEN a AND b GROUP BY 1)"""


@query("w27_excursions", with_sql("bars", more=EXC) + "SELECT id, round(CASE WHEN dir > 0 THEN (e - lo) / e ELSE (hi - e) / e END, 6) AS mae, round(CASE WHEN dir > 0 THEN (hi - e) / e ELSE (e - lo) / e END, 6) AS mfe FROM xq")
def _(spark, d):
    t = seconds("l_shipdate")
    li = table(spark, d, "lineitem").select(
        c("l_suppkey").cast("string").alias("symbol"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", t.cast("string"), "l_suppkey").alias("id"),
        t.alias("entry_t"), (t + c("l_quantity").cast("long") * WEEK).alias("exit_t"), when(c("l_linestatus") == "F", 1).otherwise(-1).alias("direction"), (c("l_extendedprice") / c("l_quantity")).alias("entry"))
    return X.excursions(li, weekly(spark, d).df, WEEK).select("id", *R(6, "mae", "mfe"))


KDJ = f"""kq AS (SELECT symbol, pos, coalesce((close - min(low) {w(9)}) / nullif(max(high) {w(9)} - min(low) {w(9)}, 0) * 100, 50) AS rsv FROM x),
 kd AS (SELECT symbol, pos, (100.0 + rsv) / 3 AS k, (100.0 + (100.0 + rsv) / 3) / 3 AS d FROM kq WHERE pos = 8 UNION ALL SELECT q.symbol, q.pos, (2 * k + rsv) / 3, (2 * d + (2 * k + rsv) / 3) / 3 FROM kd JOIN kq q ON q.symbol = kd.symbol AND q.pos = kd.pos + 1)"""


@query("w28_chart_series", with_sql("x", recursive=True, more=KDJ + RSI) + """SELECT x.symbol, t, round(k, 4) AS k, round(d, 4) AS d, round(CASE WHEN rls.y <= 0 THEN 100 ELSE 100 - 100 / (1 + rgn.y / rls.y) END, 4) AS rsi FROM x JOIN kd USING (symbol, pos) LEFT JOIN rgn USING (symbol, pos) LEFT JOIN rls USING (symbol, pos)""")
def _(spark, d):
    return X.chart_series(weekly(spark, d)).where("k IS NOT NULL").select("symbol", T(), "k", "d", "rsi")


SNAP = ", ".join([emas("mf", "x", "close", 12), emas("ms", "x", "close", 26), "mm AS (SELECT ms.symbol, ms.pos, mf.y - ms.y AS line FROM ms JOIN mf USING (symbol, pos))", emas("mg", "mm", "line", 9, first=25), emas("ma", "x", "tr", 14, 1 / 14), f"""
 sq AS (SELECT x.*, round(line, 6) AS m, round(mg.y, 6) AS g, ma.y AS atr, avg(close) {w(5)} AS m5, avg(close) {w(10)} AS m10, avg(close) {w(20)} AS m20, stddev_pop(close) {w(20)} AS sd, max(high) {w(20)} AS sh, min(low) {w(20)} AS sl,
 avg(volume) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS vb FROM x LEFT JOIN mm USING (symbol, pos) LEFT JOIN mg USING (symbol, pos) LEFT JOIN ma USING (symbol, pos)),
 sp AS (SELECT *, (ph + pl + prev) / 3 AS pv, {lag('m')} AS pm, {lag('g')} AS pg FROM sq), sr AS (SELECT *, (2 * pv - ph + sl + round(m20 - 2 * sd, 4)) / 3 AS sup, (2 * pv - pl + sh + round(m20 + 2 * sd, 4)) / 3 AS res FROM sp WHERE pos >= 33)"""])
CROSS = "CASE WHEN pm <= pg AND m > g THEN 'golden_cross' WHEN pm >= pg AND m < g THEN 'death_cross' END"


@query("w29_indicator_snapshot", with_sql("x", recursive=True, more=SNAP) + f"""SELECT symbol, t, floor(pv * 100 + 0.3713) AS pivot, floor(sup * 10 + 0.3713) AS support, floor(res * 10 + 0.3713) AS resistance, round(atr, 6) AS atr, round(volume / vb, 6) AS volume_ratio, round((close - sl) / (sh - sl) * 100, 6) AS position,
 CASE WHEN close > m5 AND m5 > m10 AND m10 > m20 THEN 'strong_uptrend' WHEN close > m20 THEN 'uptrend' WHEN close < m5 AND m5 < m10 AND m10 < m20 THEN 'strong_downtrend' WHEN close < m20 THEN 'downtrend' ELSE 'sideways' END AS trend FROM sr""")
def _(spark, d):
    s = X.indicator_snapshot(weekly(spark, d))
    return s.select("symbol", T(), F.floor(c("pivot") * 100 + 0.3713).cast("double").alias("pivot"),
                    *[F.floor(c(x) * 10 + 0.3713).cast("double").alias(x) for x in ("support", "resistance")], *R(6, "atr", "volume_ratio", "position"), "trend")


EVI = ", ".join([emas("e20", "x", "close", 20), emas("e60", "x", "close", 60), f"""vq AS (SELECT x.*, e20.y AS a, e60.y AS b, avg(CASE WHEN prev IS NOT NULL THEN tr END) {w(14)} AS atr, close / {lag('close', 5)} * 100 - 100 AS r5, CASE WHEN pos >= 20 THEN stddev_samp(ret) {w(20)} * sqrt(52) * 100 END AS vol,
 avg(volume) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS vb, avg(close) {w(20)} AS m, stddev_pop(close) {w(20)} AS sd FROM x LEFT JOIN e20 USING (symbol, pos) LEFT JOIN e60 USING (symbol, pos))"""])


@query("w30_technical_evidence", with_sql("x", recursive=True, more=EVI) + """SELECT symbol, t, round(r5, 6) AS return_5, round(atr, 6) AS atr14, round(vol, 6) AS volatility, round(CASE WHEN pos >= 19 THEN CASE WHEN sd > 0 THEN (close - m + 2 * sd) / (4 * sd) ELSE 0.5 END END, 6) AS bollinger, round(volume / vb, 6) AS volume_ratio,
 CASE WHEN close > a AND a > b THEN 'bullish' WHEN close < a AND a < b THEN 'bearish' ELSE 'neutral' END AS trend, CAST(CASE WHEN pos < 1 THEN 1 ELSE 0 END + CASE WHEN pos < 5 THEN 1 ELSE 0 END + CASE WHEN pos < 20 THEN 1 ELSE 0 END + CASE WHEN pos < 1 THEN 1 ELSE 0 END + CASE WHEN pos < 1 THEN 1 ELSE 0 END + CASE WHEN pos < 20 THEN 1 ELSE 0 END + CASE WHEN pos < 19 THEN 1 ELSE 0 END
 + CASE WHEN pos < 19 THEN 1 ELSE 0 END + CASE WHEN pos < 59 THEN 1 ELSE 0 END + CASE WHEN pos < 199 THEN 1 ELSE 0 END AS INTEGER) AS missing FROM vq""")
def _(spark, d):
    e = X.technical_evidence(weekly(spark, d), 52.0)
    return e.select("symbol", T(), *R(6, "return_5", "atr14", "volatility", "bollinger", "volume_ratio"), "trend", F.size("missing").alias("missing"))


LEVELS = f"""px AS (SELECT *, CASE WHEN pos >= 2 AND high >= greatest(lag(high, 2) OVER o, lag(high) OVER o, lead(high) OVER o, lead(high, 2) OVER o) THEN high END AS top,
 CASE WHEN pos >= 2 AND low <= least(lag(low, 2) OVER o, lag(low) OVER o, lead(low) OVER o, lead(low, 2) OVER o) THEN low END AS bottom,
 greatest(coalesce(avg(CASE WHEN prev IS NOT NULL THEN tr END) {w(14)}, 0) * 0.35, close * 0.002) AS tol FROM x WINDOW o AS (PARTITION BY symbol ORDER BY pos)),
 hx AS (SELECT symbol, t, close, tol, max(high) OVER p AS hi, min(low) OVER p AS lo, count(*) OVER p AS n, list(top) FILTER (top IS NOT NULL) OVER q AS hs, list(bottom) FILTER (bottom IS NOT NULL) OVER q AS ls
 FROM px WINDOW p AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING), q AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 118 PRECEDING AND 3 PRECEDING)),
 vx AS (SELECT symbol, t, close, tol, 's' AS side, list_sort(list_append(coalesce(ls, []::DOUBLE[]), lo)) AS v FROM hx WHERE n >= 5 UNION ALL SELECT symbol, t, close, tol, 'r', list_sort(list_append(coalesce(hs, []::DOUBLE[]), hi)) FROM hx WHERE n >= 5),
 gx AS (SELECT symbol, t, side, v, tol, 0 AS i, []::STRUCT(s DOUBLE, n BIGINT)[] AS g, 0 AS k FROM vx
  UNION ALL SELECT symbol, t, side, v, tol, i + 1, CASE WHEN k = 0 THEN list_append(g, {{'s': v[i + 1], 'n': 1}}) ELSE g[:k - 1] || [{{'s': g[k].s + v[i + 1], 'n': g[k].n + 1}}] || g[k + 1:] END, 0 FROM
   (SELECT symbol, t, side, v, tol, i, g, coalesce(list_position(list_transform(g, lambda y: abs(v[i + 1] - y.s / y.n) <= tol), true), 0) AS k FROM gx WHERE i < len(v))),
 nx AS (SELECT symbol, t, side, array_to_string(list_transform(list_sort(list_filter(list_transform(g, lambda y: {{'d': abs(close - round(y.s / y.n, 8)), 'm': -y.n, 'p': round(y.s / y.n, 8)}}),
  lambda y: CASE WHEN side = 's' THEN y.p <= close + vx.tol ELSE y.p >= close - vx.tol END))[:3], lambda y: CAST(floor(y.p * 10000 + 0.5) AS BIGINT) || 'x' || -y.m), ' ') AS told FROM gx JOIN vx USING (symbol, t, side) WHERE i = len(gx.v))"""


@query("w31_support_resistance", with_sql("x", more=LEVELS, recursive=True) + """SELECT symbol, t, round(max(tol), 6) AS tolerance, max(told) FILTER (side = 's') AS supports, max(told) FILTER (side = 'r') AS resistances
 FROM nx JOIN vx USING (symbol, t, side) GROUP BY symbol, t""")
def _(spark, d):
    s = X.support_resistance(weekly(spark, d))
    text = lambda x: F.array_join(F.transform(x, lambda g: F.concat_ws("x", F.floor(g["price"] * 10000 + 0.5), g["touches"])), " ")
    return s.select("symbol", T(), *R(6, "tolerance"), text(c("supports")).alias("supports"), text(c("resistances")).alias("resistances"))


BRK = f"""bq AS (SELECT *, greatest(coalesce(avg(CASE WHEN prev IS NOT NULL THEN tr END) {w(14)}, 0) * 0.35, close * 0.002) AS tol, max(high) OVER p AS hi, min(low) OVER p AS lo, avg(volume) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS vb FROM x WINDOW p AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING))"""


@query("w32_breakout_state", with_sql("x", more=BRK) + """SELECT symbol, t, CASE WHEN close > hi + tol THEN CASE WHEN volume / vb >= 1.2 THEN 'confirmed_up' ELSE 'unconfirmed_up' END WHEN close < lo - tol THEN CASE WHEN volume / vb >= 1.2 THEN 'confirmed_down' ELSE 'unconfirmed_down' END ELSE 'range' END AS state FROM bq WHERE pos >= 5""")
def _(spark, d):
    return X.breakout_state(X.support_resistance(weekly(spark, d))).select("symbol", T(), "state")


@query("w33_cross_events", with_sql("x", recursive=True, more=SNAP) + f"SELECT symbol, t, {CROSS} AS event FROM sr WHERE {CROSS} IS NOT NULL AND pos >= 34")
def _(spark, d):
    return X.indicator_snapshot(weekly(spark, d)).where("cross IS NOT NULL AND pos >= 34").select("symbol", T(), c("cross").alias("event"))


@query("w34_drawdown_columns", with_sql("hbars", more="k AS (SELECT *, greatest(4, max(close) OVER (PARTITION BY symbol ORDER BY t)) AS peak FROM hbars)") + "SELECT symbol, t, peak, round((close / peak - 1) * 100, 6) AS drawdown FROM k")
def _(spark, d):
    x = hourly(spark, d).df.select("symbol", T(), "close")
    return X.drawdown_columns(x, ["symbol"], "t", "close", lit(4.0), F.floor(c("t") / (HOUR * 16384))).select("symbol", "t", "peak", *R(6, "drawdown"))
