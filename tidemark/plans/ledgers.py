"""Ledger aggregates over the driver tables (first part of the aggregation inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.registry import query
from tidemark.operators import ledger as L
from tidemark.plans.joins import BOUNDARY, EQUITY, OPEN, equity, opening
from tidemark.plans.standins import DAY, hourly, marks, positions, snapshots, strategies, trades, with_sql

c, lit = F.col, F.lit
R = lambda n, *names: [F.round(x, n).alias(x) for x in names]
STEP = "CASE WHEN profit IS NOT NULL THEN profit - commission ELSE -commission END"


@query("a1_equity_rollup", with_sql("trades") + """SELECT strategy_id, round(sum(coalesce(profit, 0) - commission), 4) AS realized,
 count(*) FILTER (type NOT LIKE 'open%' AND type NOT LIKE 'add%' AND profit IS NOT NULL) AS completed_trades,
 count(*) FILTER (type NOT LIKE 'open%' AND type NOT LIKE 'add%' AND profit > 0) AS wins FROM trades GROUP BY 1""")
def _(spark, d):
    return L.trade_totals(trades(spark, d)).withColumn("realized", F.round("realized", 4))


@query("a2_reconstructed_opening", with_sql("snapshots", "trades", "payments", "strategies", more=OPEN) + "SELECT strategy_id, round(rebuilt, 4) AS opening FROM rebuilt")
def _(spark, d):
    from tidemark.plans.standins import payments
    return L.reconstructed_opening(strategies(spark, d), trades(spark, d), payments(spark, d), BOUNDARY).select(
        "strategy_id", F.round("rebuilt", 4).alias("opening"))


@query("a3_daily_metrics", with_sql("snapshots", "trades", "payments", "strategies", "positions", "marks", more=OPEN + ", " + EQUITY + f""",
 rs AS (SELECT strategy_id, last(equity ORDER BY t, id) AS reset FROM snapshots WHERE reason = 'P' AND t >= {BOUNDARY} AND t < {BOUNDARY + DAY} GROUP BY 1)""") + """
 SELECT e.strategy_id, round(capital + realized + funding + unrealized, 4) AS current_equity, round(realized + funding + unrealized, 4) AS total_pnl,
 round(capital + realized + funding + unrealized - coalesce(reset, opening), 4) AS today_pnl, CASE WHEN reset IS NOT NULL THEN false ELSE estimated END AS estimated,
 CASE WHEN reset IS NOT NULL THEN 'capital_change' ELSE source END AS source, completed_trades, wins, round(wins / completed_trades, 6) AS win_rate
 FROM equity e JOIN opening USING (strategy_id) LEFT JOIN rs USING (strategy_id)""")
def _(spark, d):
    s = snapshots(spark, d).where((c("reason") == "P") & (c("t") >= BOUNDARY) & (c("t") < BOUNDARY + DAY))
    resets = L.latest(s, "strategy_id", ["t", "id"], ["equity"]).withColumnRenamed("equity", "reset_equity")
    m = L.daily_metrics(opening(spark, d, equity(spark, d)), None, resets)
    return m.select("strategy_id", *R(4, "current_equity", "total_pnl", "today_pnl"), "estimated", "source", "completed_trades", "wins", *R(6, "win_rate"))


PERF = """c AS (SELECT t.*, capital, profit - commission AS net FROM trades t JOIN strategies USING (strategy_id) WHERE profit IS NOT NULL),
 e AS (SELECT *, capital + sum(net) OVER w AS eq FROM c WINDOW w AS (PARTITION BY strategy_id ORDER BY t, id ROWS UNBOUNDED PRECEDING)),
 p AS (SELECT *, CASE WHEN capital > 0 THEN greatest(capital, max(eq) OVER w) ELSE max(eq) OVER w END AS peak FROM e WINDOW w AS (PARTITION BY strategy_id ORDER BY t, id ROWS UNBOUNDED PRECEDING)),
 dy AS (SELECT strategy_id, max(n) AS best_day, min(n) AS worst_day FROM (SELECT strategy_id, t // 86400, CAST(sum(CAST(net AS DECIMAL(28, 8))) AS DOUBLE) AS n FROM c GROUP BY 1, 2) GROUP BY 1),
 g AS (SELECT strategy_id, max(capital) AS capital, count(*) AS total_trades, count(*) FILTER (net > 0) AS winning, count(*) FILTER (net < 0) AS losing,
 CAST(sum(CAST(CASE WHEN net > 0 THEN net ELSE 0 END AS DECIMAL(28, 8))) AS DOUBLE) AS total_profit, -CAST(sum(CAST(CASE WHEN net < 0 THEN net ELSE 0 END AS DECIMAL(28, 8))) AS DOUBLE) AS total_loss, CAST(sum(CAST(net AS DECIMAL(28, 8))) AS DOUBLE) / count(*) AS avg_trade, max(net) AS max_win, min(net) AS max_loss,
 max(peak - eq) AS max_drawdown, max(peak) AS top FROM p GROUP BY 1),
 perf AS (SELECT *, winning * 100.0 / (winning + losing) AS win_rate, total_profit / total_loss AS profit_factor, total_profit / winning AS avg_win, total_loss / losing AS avg_loss,
 CASE WHEN top > 0 THEN max_drawdown / top * 100 ELSE 0 END AS max_drawdown_pct FROM g JOIN dy USING (strategy_id))"""
PNAMES = ("total_profit", "total_loss", "avg_trade", "avg_win", "avg_loss", "max_win", "max_loss", "max_drawdown", "best_day", "worst_day")


@query("a4_performance_block", with_sql("trades", "strategies", more=PERF) + "SELECT strategy_id, total_trades, winning, losing, round(win_rate, 6) AS win_rate, round(profit_factor, 6) AS profit_factor, round(max_drawdown_pct, 6) AS max_drawdown_pct, "
       + ", ".join(f"round({n}, 4) AS {n}" for n in PNAMES) + " FROM perf")
def _(spark, d):
    t = trades(spark, d).join(strategies(spark, d).select("strategy_id", "capital"), "strategy_id")
    return L.performance(t).select("strategy_id", "total_trades", "winning", "losing", *R(6, "win_rate", "profit_factor", "max_drawdown_pct"), *R(4, *PNAMES))


@query("a5_strategy_stats", with_sql("trades", "strategies", more=PERF + f", tp AS (SELECT strategy_id, sum({STEP}) AS total_pnl FROM trades GROUP BY 1)") + """
 SELECT strategy_id, total_trades, round(win_rate, 6) AS win_rate, round(total_pnl, 4) AS total_pnl, round(CASE WHEN capital > 0 THEN total_pnl / capital * 100 ELSE 0 END, 6) AS roi,
 round(max_drawdown, 4) AS max_drawdown FROM perf JOIN tp USING (strategy_id) WHERE strategy_id % 7 <> 3""")
def _(spark, d):
    s = L.strategy_stats(trades(spark, d), strategies(spark, d).where("strategy_id % 7 <> 3"))
    return s.select("strategy_id", "total_trades", *R(6, "win_rate", "roi"), *R(4, "total_pnl", "max_drawdown")).orderBy(c("total_pnl").desc(), "strategy_id")


DAYS = f"dd AS (SELECT to_timestamp(t // 86400 * 86400)::DATE AS day, sum({STEP}) AS p FROM trades GROUP BY 1)"


@query("a6_pnl_calendar", with_sql("trades", more=DAYS) + """SELECT strftime(day, '%Y-%m') AS month, count(*) AS days, round(sum(p), 4) AS total,
 count(*) FILTER (p > 0) AS win_days, count(*) FILTER (p < 0) AS lose_days FROM dd GROUP BY 1""")
def _(spark, d):
    return L.pnl_calendar(trades(spark, d)).select("month", F.size("days").cast("long").alias("days"), *R(4, "total"), "win_days", "lose_days")


@query("a6_pnl_hours", with_sql("trades") + f"""SELECT h AS hour, count(x.t) AS count, round(coalesce(sum({STEP}), 0), 4) AS profit FROM range(24) r(h)
 LEFT JOIN (SELECT *, (t + CAST(right(id, 2) AS BIGINT) % 19 * 3600) // 3600 % 24 AS hh FROM trades) x ON hh = h GROUP BY 1""")
def _(spark, d):
    t = trades(spark, d).withColumn("t", c("t") + F.substring("id", -2, 2).cast("long") % 19 * 3600)
    return L.pnl_by_hour(t).withColumn("profit", F.round("profit", 4))


@query("a7_pnl_rollup", with_sql("trades", more=f"q AS (SELECT to_timestamp(t) AS ts, {STEP} AS p FROM trades)") + """
 SELECT 'day' AS level, strftime(ts, '%Y-%m-%d') AS bucket, count(*) AS n, round(sum(p), 4) AS profit FROM q GROUP BY 2
 UNION ALL SELECT 'month', strftime(ts, '%Y-%m'), count(*), round(sum(p), 4) FROM q GROUP BY 2
 UNION ALL SELECT 'hour', CAST(hour(ts) AS VARCHAR), count(*), round(sum(p), 4) FROM q GROUP BY 2""")
def _(spark, d):
    return L.pnl_rollup(trades(spark, d)).withColumn("profit", F.round("profit", 4))


REVIEW = f"""r AS (SELECT t.*, greatest(capital, 0) AS start, regexp_matches(type, '^(close|reduce)_') AS x, {STEP} AS st, sum({STEP}) OVER (PARTITION BY strategy_id ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS cum
 FROM trades t JOIN strategies USING (strategy_id)),
 k AS (SELECT *, greatest(start, max(start + cum) OVER (PARTITION BY strategy_id ORDER BY t, id ROWS UNBOUNDED PRECEDING)) AS peak FROM r),
 l0 AS (SELECT strategy_id, profit, sum(CASE WHEN profit > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY strategy_id ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS isle FROM trades WHERE profit <> 0),
 ls AS (SELECT strategy_id, max(n) AS loss_streak FROM (SELECT strategy_id, isle, count(*) AS n FROM l0 WHERE profit < 0 GROUP BY 1, 2) GROUP BY 1)"""


@query("a8_review_block", with_sql("trades", "strategies", more=REVIEW) + """SELECT strategy_id, count(*) AS trade_events, count(*) FILTER (NOT x) AS opening_events, count(*) FILTER (x OR profit IS NOT NULL) AS closing_events,
 round(avg(profit), 6) AS expectancy, round(sum(st), 4) AS net_pnl, round(max(peak - start - cum), 4) AS max_drawdown, round(CASE WHEN max(peak) > 0 THEN max(peak - start - cum) / max(peak) * 100 ELSE 0 END, 6) AS max_drawdown_pct,
 round(sum(commission) / sum(price * amount) * 100, 6) AS fee_to_notional_pct, max(loss_streak) AS loss_streak FROM k LEFT JOIN ls USING (strategy_id) GROUP BY 1""")
def _(spark, d):
    r = L.review(trades(spark, d), strategies(spark, d), positions(spark, d), marks(spark, d))
    return r.select("strategy_id", "trade_events", "opening_events", "closing_events", *R(6, "expectancy", "max_drawdown_pct", "fee_to_notional_pct"),
                    *R(4, "net_pnl", "max_drawdown"), "loss_streak")


@query("a8_exit_reasons", with_sql("trades", more="""n AS (SELECT strategy_id, symbol || ':' || type AS reason, count(*) AS n FROM trades WHERE profit IS NOT NULL GROUP BY 1, 2)""") + """
 SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY n DESC, reason) AS rank FROM n QUALIFY rank <= 8""")
def _(spark, d):
    return L.exit_reasons(trades(spark, d), "strategy_id", F.concat("symbol", lit(":"), "type"))


@query("a9_curve_summary", with_sql("hbars", more="""k AS (SELECT *, greatest(3, max(close) OVER (PARTITION BY symbol ORDER BY t)) AS peak FROM hbars)""") + """
 SELECT symbol, round(last(close ORDER BY t), 4) AS latest, round(last(close ORDER BY t) - 3, 4) AS total_return, round(max(peak - close), 4) AS max_drawdown,
 round(max((peak - close) / peak * 100), 6) AS max_drawdown_pct, count(*) AS points FROM k GROUP BY 1""")
def _(spark, d):
    p = hourly(spark, d)
    s = L.curve_summary(p.df, ["symbol"], ["ts"], p.grain, "close", lit(3.0))
    return s.select("symbol", *R(4, "latest", "total_return", "max_drawdown"), *R(6, "max_drawdown_pct"), "points")


LOTS = """o AS (SELECT *, row_number() OVER (PARTITION BY symbol, leg ORDER BY t, id) AS n FROM (SELECT *, CASE WHEN contains(type, 'long') THEN 'long' ELSE 'short' END AS leg,
 regexp_matches(type, '^(close|reduce)_') AS x FROM trades)),
 i0 AS (SELECT *, sum(CASE WHEN x THEN -amount ELSE amount END) OVER w AS s, sum(CASE WHEN x THEN 0 ELSE amount END) OVER w AS inn FROM o WINDOW w AS (PARTITION BY symbol, leg ORDER BY n)),
 i1 AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY symbol, leg ORDER BY n)) AS inv FROM i0),
 ex AS (SELECT *, lag(inn - inv, 1, 0) OVER (PARTITION BY symbol, leg ORDER BY n) AS a, inn - inv AS b FROM i1),
 en AS (SELECT symbol, leg, inn - amount AS a, inn AS b, commission / amount AS u FROM i0 WHERE NOT x),
 fi AS (SELECT e.id, e.t, e.symbol, sum((least(e.b, n.b) - greatest(e.a, n.a)) * n.u) AS oc FROM ex e JOIN en n ON n.symbol = e.symbol AND n.leg = e.leg AND n.a < e.b AND n.b > e.a WHERE e.x AND e.b > e.a GROUP BY 1, 2, 3)"""


@query("a52_fifo_commission", with_sql("trades", more=LOTS) + """SELECT e.id, e.t, round(coalesce(oc, 0), 4) AS open_commission, round(profit - commission - coalesce(oc, 0), 4) AS net_pnl
 FROM ex e LEFT JOIN fi ON fi.id = e.id AND fi.t = e.t WHERE e.x""")
def _(spark, d):
    f = L.allocate_fifo(trades(spark, d))
    return f.select("id", "t", *R(4, "open_commission"), F.round(c("profit") - c("commission") - c("open_commission"), 4).alias("net_pnl"))


@query("a53_equity_steps", with_sql("trades") + f"""SELECT id, t, round({STEP}, 4) AS step, round(sum({STEP}) OVER (PARTITION BY strategy_id ORDER BY t, id ROWS UNBOUNDED PRECEDING), 3) AS equity FROM trades""")
def _(spark, d):
    p = L.equity_path(trades(spark, d), ["strategy_id"], lit(0.0))
    return p.select("id", "t", F.round(L.equity_step(), 4).alias("step"), F.round("equity", 3).alias("equity"))


