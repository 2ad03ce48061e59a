"""Join operators over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.registry import query
from tidemark.model import epoch
from tidemark.operators import joins as J
from tidemark.operators import ledger as L
from tidemark.plans.standins import (DAY, HOUR, WEEK, bucket_bars, calendar, fundamentals, hourly, marks, members, payments,
                                     positions, seconds, snapshots, strategies, table, trades, weekly, with_sql)
from tidemark.session import chunk_rows

c, lit, when = F.col, F.lit, F.when
BOUNDARY = 896659200  # 1998-06-01


def span(spark, step):
    return step * chunk_rows(spark)


def reports_on_bars(spark, d):
    """Weekly bars with the newest report visible on the bar's day."""
    f = fundamentals(spark, d)
    cols = [x for x in f.columns if x != "symbol"]
    p = weekly(spark, d)
    return J.asof(p.df, f, ["symbol"], F.floor(epoch() / DAY) * DAY, F.unix_date("available_at").cast("long") * DAY,
                  span(spark, WEEK), cols, "f", tie=["period_end"], bounded=True)


ASOF = "bars b ASOF LEFT JOIN fundamentals f ON b.symbol = f.symbol AND b.t >= CAST(epoch(f.available_at) AS BIGINT)"


@query("j1_asof_fundamentals", with_sql("bars", "fundamentals") + f"""SELECT b.symbol, b.t, CAST(epoch(period_end) AS BIGINT) // 86400 AS period,
 total_debt AS debt, round(CASE WHEN close * shares > 0 THEN close * shares END, 2) AS market_cap FROM {ASOF}""")
def _(spark, d):
    cap = c("close") * c("f.shares")
    return reports_on_bars(spark, d).select(
        "symbol", epoch().alias("t"), F.unix_date("f.period_end").cast("long").alias("period"), c("f.total_debt").alias("debt"),
        F.round(when(cap > 0, cap), 2).alias("market_cap"))


IN = "m.valid_from <= to_timestamp(t)::DATE AND (m.valid_to IS NULL OR to_timestamp(t)::DATE < m.valid_to)"


@query("j2_interval_members", with_sql("bars", "members") + f"""SELECT t, count(*) AS members, round(sum(volume), 2) AS volume FROM bars b
 WHERE EXISTS (SELECT 1 FROM members m WHERE m.symbol = b.symbol AND {IN}) GROUP BY 1""")
def _(spark, d):
    rows = J.active_members(weekly(spark, d).df, members(spark, d), F.to_date("ts"))
    return rows.groupBy(epoch().alias("t")).agg(F.count(lit(1)).alias("members"), F.round(F.sum("volume"), 2).alias("volume"))


@query("j3_membership_flags", with_sql("bars", "members") + f"""SELECT symbol, t, EXISTS (SELECT 1 FROM members m WHERE m.symbol = b.symbol AND {IN}) AS member FROM bars b""")
def _(spark, d):
    return J.membership_flags(weekly(spark, d).df, members(spark, d), F.to_date("ts")).select("symbol", epoch().alias("t"), "member")


def fills_on_bars(spark, d):
    """Supplier fills with the close of the last finished weekly bar."""
    li = table(spark, d, "lineitem")
    fills = li.select(c("l_suppkey").cast("string").alias("symbol"), seconds("l_shipdate").alias("t"), "l_orderkey", "l_linenumber",
                      "l_partkey", (c("l_extendedprice") / c("l_quantity")).alias("price"), c("l_quantity").alias("amount"),
                      F.when(c("l_returnflag") == "R", "close_long").otherwise("open_long").alias("type"))
    bars = weekly(spark, d).df.select("symbol", (epoch() + WEEK).alias("closes"), "close")
    return J.asof(fills, bars, ["symbol"], c("t"), c("closes"), span(spark, WEEK), ["closes", "close"], "bar")


FILLS = """fills AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(epoch(l_shipdate) AS BIGINT) AS t, l_orderkey, l_linenumber, l_partkey,
 l_extendedprice / l_quantity AS price, l_quantity AS amount, CASE WHEN l_returnflag = 'R' THEN 'close_long' ELSE 'open_long' END AS type FROM lineitem),
 closed AS (SELECT symbol, t + 604800 AS closes, close FROM bars),
 dev AS (SELECT f.*, b.closes, b.close FROM fills f ASOF LEFT JOIN closed b ON f.symbol = b.symbol AND f.t >= b.closes)"""


@query("j4_asof_closed_bar", with_sql("bars", more=FILLS) + """SELECT symbol, t, l_orderkey AS o, l_linenumber AS l, l_partkey AS p, closes,
 CASE WHEN close > 0 THEN close END AS signal FROM dev""")
def _(spark, d):
    return fills_on_bars(spark, d).select("symbol", "t", c("l_orderkey").alias("o"), c("l_linenumber").alias("l"), c("l_partkey").alias("p"),
                                          c("bar.closes").alias("closes"), when(c("bar.close") > 0, c("bar.close")).alias("signal"))


OPEN = f"""b AS (SELECT strategy_id, max(t) AS bt, last(equity ORDER BY t, id) AS be FROM snapshots WHERE t <= {BOUNDARY} GROUP BY 1),
 a AS (SELECT strategy_id, min(t) AS a_t, first(equity ORDER BY t, id) AS ae FROM snapshots WHERE t >= {BOUNDARY} AND t < {BOUNDARY + DAY} GROUP BY 1),
 tn AS (SELECT strategy_id, sum(coalesce(profit, 0) - commission) AS n FROM trades WHERE t < {BOUNDARY} GROUP BY 1),
 fn AS (SELECT strategy_id, sum(amount) AS n FROM payments WHERE t < {BOUNDARY} GROUP BY 1),
 rebuilt AS (SELECT s.strategy_id, capital + coalesce(tn.n, 0) + CASE WHEN mode = 'signal' THEN 0 ELSE coalesce(fn.n, 0) END AS rebuilt
  FROM strategies s LEFT JOIN tn USING (strategy_id) LEFT JOIN fn USING (strategy_id)),
 opening AS (SELECT strategy_id, CASE WHEN bt IS NULL AND a_t IS NULL THEN rebuilt WHEN a_t IS NULL OR {BOUNDARY} - bt <= a_t - {BOUNDARY} THEN be ELSE ae END AS opening,
  CASE WHEN bt IS NULL AND a_t IS NULL THEN true WHEN a_t IS NULL OR {BOUNDARY} - bt <= a_t - {BOUNDARY} THEN {BOUNDARY} - bt > 900 ELSE a_t - {BOUNDARY} > 900 END AS estimated,
  CASE WHEN bt IS NULL AND a_t IS NULL THEN 'ledger_reconstruction' WHEN a_t IS NULL OR {BOUNDARY} - bt <= a_t - {BOUNDARY} THEN 'snapshot_before' ELSE 'snapshot_after' END AS source
  FROM rebuilt LEFT JOIN b USING (strategy_id) LEFT JOIN a USING (strategy_id))"""


def opening(spark, d, rebuilt=None):
    snaps = snapshots(spark, d)
    edge = J.boundary_rows(snaps, "strategy_id", "t", BOUNDARY, BOUNDARY + DAY, ["t", "id"], ["t", "equity"])
    rebuilt = rebuilt if rebuilt is not None else L.reconstructed_opening(strategies(spark, d), trades(spark, d), payments(spark, d), BOUNDARY)
    return J.opening_equity(edge, rebuilt, "strategy_id", BOUNDARY)


@query("j5_nearest_snapshot", with_sql("snapshots", "trades", "payments", "strategies", more=OPEN) + "SELECT strategy_id, round(opening, 4) AS opening, estimated, source FROM opening")
def _(spark, d):
    return opening(spark, d).withColumn("opening", F.round("opening", 4))


@query("j6_price_as_of", with_sql("bars", "fundamentals") + """SELECT f.symbol, CAST(epoch(f.available_at) AS BIGINT) // 86400 AS day, b.close FROM fundamentals f
 ASOF LEFT JOIN bars b ON f.symbol = b.symbol AND CAST(epoch(f.available_at) AS BIGINT) >= b.t""")
def _(spark, d):
    f = fundamentals(spark, d).select("symbol", "available_at")
    day = F.unix_date("available_at").cast("long")
    out = J.asof(f, weekly(spark, d).df, ["symbol"], day * DAY, F.floor(epoch() / DAY) * DAY, span(spark, WEEK), ["close"], "b", bounded=True)
    return out.select("symbol", day.alias("day"), c("b.close").alias("close"))


@query("j7_bounded_forward_asof", with_sql("fundamentals", more="""e AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, max(CAST(l_shipdate AS DATE)) AS a FROM lineitem GROUP BY l_suppkey, (year(l_shipdate) * 12 + month(l_shipdate) - 1) // 9),
 n AS (SELECT f.symbol, period_end, (SELECT min(a) FROM e WHERE e.symbol = f.symbol AND a > period_end AND a <= period_end + 120) AS a FROM fundamentals f)""") + """
 SELECT symbol, CAST(epoch(period_end) AS BIGINT) // 86400 AS period, CAST(epoch(CASE WHEN a IS NOT NULL THEN a + 1 ELSE least(period_end + 91, DATE '2001-06-01') END) AS BIGINT) // 86400 AS day,
 CASE WHEN a IS NOT NULL THEN 'reported_earnings_date' WHEN period_end + 91 <= DATE '2001-06-01' THEN 'conservative_91_day_lag' ELSE 'observed_at_sync' END AS basis FROM n""")
def _(spark, d):
    """The last shipment of a supplier's nine months stands for an announcement."""
    part = F.floor((F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1) / 9)
    e = table(spark, d, "lineitem").groupBy(c("l_suppkey").cast("string").alias("symbol"), part).agg(F.max(c("l_shipdate").cast("date")).alias("announced")).select("symbol", "announced")
    out = J.availability(fundamentals(spark, d).select("symbol", "period_end"), e, F.to_date(lit("2001-06-01")), span(spark, DAY))
    num = lambda x: F.unix_date(x).cast("long")
    return out.select("symbol", num("period_end").alias("period"), num("available_at").alias("day"), "basis")


def coarse(spark, d, step=4 * HOUR):
    ev = table(spark, d, "events")
    return bucket_bars(ev, c("event_type"), seconds("ts"), c("value"), lit(1.0), ["ts", "event_id"], step)


@query("j8_multi_timeframe", with_sql("hbars", more="""q AS (SELECT event_type AS symbol, CAST(floor(epoch(ts) / 14400) AS BIGINT) * 14400 + 14400 AS vis,
 last(value ORDER BY ts, event_id) AS close FROM events GROUP BY 1, 2)""") + """SELECT h.symbol, h.t, q.vis - 14400 AS coarse_t, q.close AS coarse_close FROM hbars h
 ASOF LEFT JOIN q ON h.symbol = q.symbol AND h.t + 3600 >= q.vis""")
def _(spark, d):
    slow = coarse(spark, d).select("symbol", epoch().alias("open_t"), "close")
    out = J.asof(hourly(spark, d).df, slow, ["symbol"], epoch() + HOUR, c("open_t") + 4 * HOUR, span(spark, HOUR), ["open_t", "close"], "s", bounded=True)
    return out.select("symbol", epoch().alias("t"), c("s.open_t").alias("coarse_t"), c("s.close").alias("coarse_close"))


@query("j9_common_curve", with_sql("hbars") + """SELECT a.t, a.close AS portfolio, b.close AS benchmark FROM hbars a JOIN hbars b USING (t)
 WHERE a.symbol = 'view' AND b.symbol = 'click' AND a.close > 1 AND b.close > 0""")
def _(spark, d):
    h = hourly(spark, d).df.select("symbol", epoch().alias("t"), c("close").alias("value"), lit(1).alias("seq"))
    a, b = h.where("symbol = 'view'"), h.where("symbol = 'click'")
    a = a.withColumn("value", when(c("value") > 1, c("value")).otherwise(-1.0))
    stale = b.withColumns({"value": c("value") + 5, "seq": lit(0)})
    return J.common_curve(a, b.unionByName(stale))


@query("j10_score_coverage", with_sql("bars") + """SELECT t, count(*) AS keys, count(CASE WHEN a AND b THEN 1 END) AS both, round(count(CASE WHEN a AND b THEN 1 END) / count(*), 6) AS coverage FROM (
 SELECT t, CAST(volume AS BIGINT) % 3 <> 0 AS a, CAST(volume AS BIGINT) % 5 <> 0 AS b FROM bars) WHERE a OR b GROUP BY 1""")
def _(spark, d):
    df, v = weekly(spark, d).df, c("volume").cast("long")
    s = df.where(v % 3 != 0).select("symbol", "ts", c("close").alias("score"))
    r = df.where(v % 5 != 0).select("symbol", "ts", c("open").alias("ret"))
    j = J.full_pairs(s, r, ["symbol", "ts"])
    both = F.count_if(c("score").isNotNull() & c("ret").isNotNull())
    return j.groupBy(epoch().alias("t")).agg(F.count(lit(1)).alias("keys"), both.alias("both"), F.round(both / F.count(lit(1)), 6).alias("coverage"))


EQUITY = """tt AS (SELECT strategy_id, sum(coalesce(profit, 0) - commission) AS realized, count(*) FILTER (type NOT LIKE 'open%' AND type NOT LIKE 'add%' AND profit IS NOT NULL) AS done,
 count(*) FILTER (type NOT LIKE 'open%' AND type NOT LIKE 'add%' AND profit > 0) AS wins FROM trades GROUP BY 1),
 vt AS (SELECT strategy_id, sum(coalesce(profit, 0) - commission) AS realized, count(*) FILTER (type NOT LIKE 'open%' AND type NOT LIKE 'add%' AND profit IS NOT NULL) AS done,
 count(*) FILTER (type NOT LIKE 'open%' AND type NOT LIKE 'add%' AND profit > 0) AS wins FROM trades WHERE symbol <> 'SOL/USDT' GROUP BY 1),
 pt AS (SELECT strategy_id, sum(coalesce(CASE WHEN side = 'short' THEN entry - mark ELSE mark - entry END * size, 0)) AS u, count(*) AS n FROM positions LEFT JOIN marks USING (symbol) GROUP BY 1),
 ft AS (SELECT strategy_id, sum(amount) AS f FROM payments GROUP BY 1),
 equity AS (SELECT s.strategy_id, capital, mode, CASE WHEN mode = 'signal' THEN coalesce(vt.realized, 0) ELSE coalesce(tt.realized, 0) END AS realized,
 CASE WHEN mode = 'signal' THEN 0 ELSE coalesce(f, 0) END AS funding, coalesce(u, 0) AS unrealized, coalesce(pt.n, 0) AS open_positions,
 CASE WHEN mode = 'signal' THEN vt.done ELSE tt.done END AS completed_trades, CASE WHEN mode = 'signal' THEN vt.wins ELSE tt.wins END AS wins
 FROM strategies s LEFT JOIN tt USING (strategy_id) LEFT JOIN vt USING (strategy_id) LEFT JOIN pt USING (strategy_id) LEFT JOIN ft USING (strategy_id))"""
EQ = with_sql("trades", "positions", "marks", "payments", "strategies", more=EQUITY)


def equity(spark, d):
    return L.equity_and_opening(strategies(spark, d), trades(spark, d), payments(spark, d), BOUNDARY, c("symbol") != "SOL/USDT", c("symbol") != "DOGE/USDT")


@query("j11_current_equity", EQ + """SELECT strategy_id, mode, round(realized, 4) AS realized, round(funding, 4) AS funding, round(unrealized, 4) AS unrealized,
 open_positions, completed_trades, wins, round(wins / completed_trades, 6) AS win_rate, round(capital + realized + funding + unrealized, 4) AS equity FROM equity""")
def _(spark, d):
    r4 = [F.round(x, 4).alias(x) for x in ("realized", "funding", "unrealized", "equity")]
    return equity(spark, d).select("strategy_id", "mode", *r4, "open_positions", "completed_trades", "wins", F.round("win_rate", 6).alias("win_rate"))


@query("j12_position_prices", with_sql("positions", "marks") + """SELECT strategy_id, symbol, side, coalesce(mark, 0) AS price, round(coalesce(mark, 0) * size, 4) AS market_value,
 round(CASE WHEN side = 'long' THEN coalesce(mark, 0) - entry ELSE entry - coalesce(mark, 0) END * size, 4) AS pnl,
 round(CASE WHEN side = 'long' THEN coalesce(mark, 0) - entry ELSE entry - coalesce(mark, 0) END / entry * 100, 6) AS pct FROM positions LEFT JOIN marks USING (symbol)""")
def _(spark, d):
    p = positions(spark, d).join(marks(spark, d), "symbol", "left").withColumn("price", F.coalesce("mark", lit(0.0)))
    gap = when(c("side") == "long", c("price") - c("entry")).otherwise(c("entry") - c("price"))
    return p.select("strategy_id", "symbol", "side", "price", F.round(c("price") * c("size"), 4).alias("market_value"),
                    F.round(gap * c("size"), 4).alias("pnl"), F.round(gap / c("entry") * 100, 6).alias("pct"))


SUBS = """subs AS (SELECT DISTINCT p_partkey AS strategy_id, (['click','view','signup','error','purchase'])[p_size % 5 + 1] AS key FROM part WHERE p_size % 7 <> 0),
 bt AS (SELECT key, strategy_id % 16 AS shard, (row_number() OVER (PARTITION BY key, strategy_id % 16 ORDER BY strategy_id) - 1) // 10 AS batch, strategy_id FROM subs)"""


def subscriptions(spark, d):
    key = F.element_at(F.array(*[lit(x) for x in ("click", "view", "signup", "error", "purchase")]), (c("p_size") % 5 + 1))
    return table(spark, d, "part").select(c("p_partkey").alias("strategy_id"), key.alias("partition_key"),
                                          when(c("p_size") % 7 != 0, "running").otherwise("stopped").alias("status"))


@query("j13_fan_out", with_sql("hbars", more=SUBS) + """SELECT symbol AS key, shard, batch, count(DISTINCT t) AS events, count(*) AS dispatched, min(strategy_id) AS first
 FROM hbars JOIN bt ON key = symbol GROUP BY 1, 2, 3""")
def _(spark, d):
    ev = hourly(spark, d).df.select(c("symbol").alias("partition_key"), epoch().alias("t"))
    out = J.fan_out(ev, subscriptions(spark, d), 16, 10)  # a key has one bar an hour, so its bars are its times
    return out.groupBy(c("partition_key").alias("key"), "shard", "batch").agg(
        F.count("t").alias("events"), F.sum(F.size("strategy_ids").cast("long")).alias("dispatched"), F.min(F.get("strategy_ids", lit(0))).alias("first"))


@query("j14_left_join_on_mode", with_sql("positions", "strategies") + """SELECT s.strategy_id, count(lp.size) AS live_rows, count(vp.size) AS signal_rows,
 round(sum(coalesce(lp.size, vp.size, 0)), 2) AS size FROM strategies s LEFT JOIN positions lp ON lp.strategy_id = s.strategy_id AND s.mode = 'live'
 LEFT JOIN (SELECT strategy_id, sum(size) AS size FROM positions GROUP BY 1) vp ON vp.strategy_id = s.strategy_id AND s.mode = 'signal' GROUP BY 1""")
def _(spark, d):
    s, p = strategies(spark, d), positions(spark, d)
    lp = p.select(c("strategy_id").alias("li"), c("size").alias("lsize"))
    vp = p.groupBy(c("strategy_id").alias("vi")).agg(F.sum("size").alias("vsize"))
    df = s.join(lp, (c("li") == c("strategy_id")) & (c("mode") == "live"), "left").join(vp, (c("vi") == c("strategy_id")) & (c("mode") == "signal"), "left")
    return df.groupBy("strategy_id").agg(F.count("lsize").alias("live_rows"), F.count("vsize").alias("signal_rows"),
                                         F.round(F.sum(F.coalesce("lsize", "vsize", lit(0.0))), 2).alias("size"))


@query("j15_semi_join", with_sql("trades", "strategies") + """SELECT symbol, count(*) AS n FROM trades WHERE strategy_id IN (SELECT strategy_id FROM strategies WHERE mode = 'live') GROUP BY 1""")
def _(spark, d):
    live = strategies(spark, d).where("mode = 'live'")
    return trades(spark, d).join(live, "strategy_id", "left_semi").groupBy("symbol").agg(F.count(lit(1)).alias("n"))


@query("j16_coverage_state", with_sql("fundamentals", more="""l AS (SELECT symbol, last(period_end ORDER BY available_at) AS pe, arg_max(struct_pack(a := total_debt, b := revenue_growth), available_at) AS r
 FROM fundamentals WHERE available_at <= DATE '1998-06-01' AND NOT (CAST(symbol AS BIGINT) % 4 = 0 AND period_end > DATE '1997-06-30') AND CAST(symbol AS BIGINT) % 9 <> 0 GROUP BY 1)""") + """
 SELECT CAST(s_suppkey AS VARCHAR) AS symbol, CASE WHEN pe IS NULL THEN 'no_data' WHEN DATE '1998-06-01' - pe > 200 THEN 'stale' WHEN r.a IS NULL OR r.b IS NULL THEN 'partial' ELSE 'ready' END AS state,
 CAST(DATE '1998-06-01' - pe AS INTEGER) AS age_days, CASE WHEN pe IS NULL OR r.a IS NULL THEN 1 ELSE 0 END + CASE WHEN pe IS NULL OR r.b IS NULL THEN 1 ELSE 0 END AS missing
 FROM supplier LEFT JOIN l ON symbol = CAST(s_suppkey AS VARCHAR)""")
def _(spark, d):
    k = c("symbol").cast("long")
    f = fundamentals(spark, d).where(~((k % 4 == 0) & (c("period_end") > F.to_date(lit("1997-06-30")))) & (k % 9 != 0))
    m = table(spark, d, "supplier").select(c("s_suppkey").cast("string").alias("symbol"))
    return J.coverage(m, f, ["total_debt", "revenue_growth"], F.to_date(lit("1998-06-01"))).withColumn("missing", F.size("missing"))


@query("j19_consecutive_sessions", with_sql("snapshots", "calendar", more="""p AS (SELECT id, t // 86400 AS a, (t + 86400 * (1 + id % 4)) // 86400 AS b FROM snapshots)""") + """
 SELECT id, coalesce(y.ordinal - x.ordinal = 1, false) AS consecutive FROM p LEFT JOIN calendar x ON x.day = a LEFT JOIN calendar y ON y.day = b""")
def _(spark, d):
    p = snapshots(spark, d).select("id", lit("X").alias("market"), "t", (c("t") + DAY * (1 + c("id") % 4)).alias("u"))
    return J.consecutive_sessions(p, calendar(spark, d), "t", "u").select("id", "consecutive")


@query("j20_in_session", with_sql("snapshots", "calendar", more="p AS (SELECT id, t // 3600 * 3600 AS b FROM snapshots)") + """
 SELECT id, coalesce(opens < b AND b <= closes AND NOT (break_start < b AND b <= break_end), false) AS open FROM p LEFT JOIN calendar ON day = b // 86400""")
def _(spark, d):
    p = snapshots(spark, d).select("id", lit("X").alias("market"), (F.floor(c("t") / HOUR) * HOUR).alias("b"))
    return J.in_session(p, calendar(spark, d), c("b")).select("id", "open")


@query("j21_allocation", with_sql("payments", "positions", more="""o AS (SELECT symbol, strategy_id AS owner, sum(size) / sum(sum(size)) OVER (PARTITION BY symbol) AS ratio FROM positions GROUP BY 1, 2)""") + """
 SELECT coalesce(owner, 7) AS owner, count(*) AS payments, round(sum(amount * coalesce(ratio, 1)), 6) AS paid FROM payments LEFT JOIN o USING (symbol) GROUP BY 1""")
def _(spark, d):
    out = J.allocate(payments(spark, d).drop("strategy_id"), positions(spark, d), lit(7).cast("long"))
    return out.groupBy("owner").agg(F.count(lit(1)).alias("payments"), F.round(F.sum("paid"), 6).alias("paid"))


@query("j22_ledger_detail", with_sql("trades", more="""k AS (SELECT *, CAST(left(id, 12) AS BIGINT) AS o FROM trades)""") + """
 SELECT o_orderpriority AS priority, c_mktsegment AS segment, n_name AS venue, count(*) AS n, round(sum(profit), 2) AS profit FROM k
 LEFT JOIN orders ON o_orderkey = o AND o_orderstatus <> 'P' LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey <> 2 GROUP BY 1, 2, 3""")
def _(spark, d):
    k = trades(spark, d).withColumn("o", F.substring("id", 1, 12).cast("long"))
    o, cu, n = (table(spark, d, x) for x in ("orders", "customer", "nation"))
    df = (k.join(o, (c("o_orderkey") == c("o")) & (c("o_orderstatus") != "P"), "left").join(cu, c("c_custkey") == c("o_custkey"), "left")
          .join(n, (c("n_nationkey") == c("c_nationkey")) & (c("n_regionkey") != 2), "left"))
    return df.groupBy(c("o_orderpriority").alias("priority"), c("c_mktsegment").alias("segment"), c("n_name").alias("venue")).agg(
        F.count(lit(1)).alias("n"), F.round(F.sum("profit"), 2).alias("profit"))


@query("j23_alert_positions", with_sql("positions", more="""a AS (SELECT o_orderkey AS alert, o_custkey % 60 AS strategy_id, (['BTC','ETH','SOL','XRP','DOGE'])[o_orderkey % 5 + 1] || '/USDT' AS symbol FROM orders)""") + """
 SELECT alert, size, entry FROM a LEFT JOIN (SELECT * FROM positions WHERE side = 'long') USING (strategy_id, symbol)""")
def _(spark, d):
    coin = F.element_at(F.array(*[lit(x + "/USDT") for x in ("BTC", "ETH", "SOL", "XRP", "DOGE")]), (c("o_orderkey") % 5 + 1).cast("int"))
    a = table(spark, d, "orders").select(c("o_orderkey").alias("alert"), (c("o_custkey") % 60).alias("strategy_id"), coin.alias("symbol"))
    return a.join(positions(spark, d).where("side = 'long'"), ["strategy_id", "symbol"], "left").select("alert", "size", "entry")


@query("j24_owned_ledgers", """SELECT c_mktsegment AS segment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey
 WHERE o_orderstatus = 'F' AND c_nationkey < 10 GROUP BY 1""")
def _(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'")
    cu = table(spark, d, "customer").where("c_nationkey < 10")
    return o.join(cu, o.o_custkey == cu.c_custkey).groupBy(c("c_mktsegment").alias("segment")).agg(
        F.count(lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


