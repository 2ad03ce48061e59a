"""Top-k, latest-per-key, set operations, resampling and schedules over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.registry import query
from tidemark.model import epoch
from tidemark.operators import bars as B
from tidemark.operators.ledger import latest
from tidemark.plans.standins import (HOUR, calendar, hourly, positions, seconds, snapshots, strategies, table, trades, trials,
                                     weekly, with_sql)

c, lit = F.col, F.lit


def T():
    return epoch().alias("t")


AT = 896659200


@query("t1_latest_per_key", with_sql("snapshots") + f"SELECT strategy_id, last(equity ORDER BY t, id) AS equity, max(t) AS t FROM snapshots WHERE t <= {AT} GROUP BY 1")
def _(spark, d):
    return latest(snapshots(spark, d).where(c("t") <= AT), "strategy_id", ["t", "id"], ["equity", "t"])


@query("t2_first_with_group_max", "SELECT p_brand AS venue, upper(p_name) AS symbol, first(p_partkey ORDER BY p_size DESC, p_partkey) AS k, max(p_size) AS hot FROM part WHERE p_size % 3 <> 0 GROUP BY 1, 2")
def _(spark, d):
    p = table(spark, d, "part").where("p_size % 3 <> 0")
    return p.groupBy(c("p_brand").alias("venue"), F.upper("p_name").alias("symbol")).agg(
        F.min_by("p_partkey", F.struct((-c("p_size")).alias("s"), c("p_partkey"))).alias("k"), F.max("p_size").alias("hot"))


@query("t3_top_by_value", "SELECT p_partkey AS k, p_name AS name, p_retailprice AS cap FROM part WHERE p_name <> '' ORDER BY p_retailprice DESC, p_partkey LIMIT 12")
def _(spark, d):
    return table(spark, d, "part").where("p_name <> ''").select(c("p_partkey").alias("k"), c("p_name").alias("name"), c("p_retailprice").alias("cap")).orderBy(c("cap").desc(), "k").limit(12)


@query("t4_even_sample", with_sql("x", more="n AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM x)") + "SELECT symbol, t, close FROM n WHERE n <= 40 OR pos = 0 OR pos = n - 1 OR pos % greatest(1, CAST(ceil(n / 40.0) AS BIGINT)) = 0")
def _(spark, d):
    return B.even_sample(weekly(spark, d).number().df, ["symbol"], "pos", 40).select("symbol", T(), "close")


CURVE = """k AS (SELECT symbol, t, pos, close - 3000 AS v FROM x), k1 AS (SELECT *, max(v) OVER w AS mx FROM k WINDOW w AS (PARTITION BY symbol ORDER BY pos)),
 k2 AS (SELECT *, CASE WHEN mx > 500 THEN mx ELSE 500 END AS pk FROM k1), k3 AS (SELECT *, CASE WHEN pk > 0 THEN (v / pk - 1) * 100 ELSE 0 END AS dd FROM k2),
 w AS (SELECT symbol, max(pos) AS e, arg_min(pos, (v, pos)) AS lo, arg_min(pos, (-v, pos)) AS hi, arg_min(pos, (dd, pos)) AS tr, arg_min(pk, (dd, pos)) AS pk, min(dd) AS dd, min(CASE WHEN v <= 0 THEN pos END) AS br FROM k3 GROUP BY 1),
 wp AS (SELECT w.*, CASE WHEN w.pk > 500 THEN (SELECT min(pos) FROM k WHERE k.symbol = w.symbol AND k.v = w.pk) ELSE 0 END AS pp FROM w),
 m AS (SELECT symbol, e + 1 AS n, list_distinct(list_filter([0, e, lo, hi, CASE WHEN dd < 0 THEN pp ELSE 0 END, CASE WHEN dd < 0 THEN tr ELSE 0 END, greatest(br - 1, 0), br], lambda z: z IS NOT NULL)) AS must FROM wp),
 r AS (SELECT k.*, n, must, list_contains(must, pos) AS req, pos - len(list_filter(must, lambda z: z < k.pos)) AS rk FROM k JOIN m USING (symbol)),
 sl AS (SELECT symbol, CAST(round_even(i * ((n - len(must) - 1) / (40.0 - len(must) - 1)), 0) AS BIGINT) AS rk FROM m, range(40) s(i) WHERE i < 40 - len(must))"""


@query("t5_sample_curve", with_sql("x", more=CURVE) + "SELECT symbol, t, v FROM r WHERE n <= 40 OR req OR (symbol, rk) IN (SELECT (symbol, rk) FROM sl)")
def _(spark, d):
    p = weekly(spark, d).number()
    x = p.df.select("symbol", "ts", "pos", (c("close") - 3000).alias("v"))
    return B.sample_curve(x, ["symbol"], "pos", "v", 40, 500.0, F.floor(c("pos") / 16384)).select("symbol", T(), "v")


REC = """rc AS (SELECT o_orderkey AS id, o_custkey % 300 AS k, CAST(epoch(o_orderdate) AS BIGINT) AS t, o_totalprice % 100 AS rsi, o_orderstatus AS macd, o_custkey % 3 AS ma, (['low','normal','high','volatile'])[o_orderkey % 4 + 1] AS vol, o_orderkey % 3 = 0 AS correct FROM orders),
 nw AS (SELECT k, 50.0 AS rsi, 'F' AS macd, k % 3 AS ma, 'normal' AS vol FROM (SELECT DISTINCT k FROM rc)), tp AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t DESC, id DESC) AS n FROM rc),
 sc AS (SELECT tp.*, greatest(0, 1 - abs(tp.rsi - nw.rsi) / 30) * 0.3 + CASE WHEN tp.macd = nw.macd THEN 0.3 ELSE 0 END + CASE WHEN tp.ma = nw.ma THEN 0.25 ELSE 0 END + CASE WHEN tp.vol = nw.vol THEN 0.15 WHEN tp.vol = 'low' THEN 0.08 ELSE 0 END AS s FROM tp JOIN nw USING (k) WHERE n <= 15)"""


@query("t6_similar_records", "WITH " + REC + " SELECT k, id, round(s + CASE WHEN correct THEN 0.1 ELSE 0 END, 6) AS score, row_number() OVER (PARTITION BY k ORDER BY s + CASE WHEN correct THEN 0.1 ELSE 0 END DESC, t DESC, id DESC) AS rank FROM sc WHERE s >= 0.25 QUALIFY rank <= 3")
def _(spark, d):
    k = c("o_orderkey")
    r = table(spark, d, "orders").select(k.alias("id"), (c("o_custkey") % 300).alias("k"), seconds("o_orderdate").alias("t"), (c("o_totalprice") % 100).alias("rsi"), c("o_orderstatus").alias("macd"),
                                         (c("o_custkey") % 3).alias("ma"), F.element_at(F.array(*[lit(x) for x in ("low", "normal", "high", "volatile")]), (k % 4 + 1).cast("int")).alias("vol"), (k % 3 == 0).alias("correct"))
    now = r.select("k").distinct().select("k", lit(50.0).alias("rsi"), lit("F").alias("macd"), (c("k") % 3).alias("ma"), lit("normal").alias("vol"))
    return B.similar_records(r, now, ["k"]).select("k", "id", F.round("score", 6).alias("score"), "rank")


@query("t7_ranked_trials", "SELECT p_partkey AS trial, p_partkey * 7919 % 1009 / 10.0 AS score FROM part WHERE p_partkey % 7 <> 0 ORDER BY score DESC, trial LIMIT 20")
def _(spark, d):
    return trials(spark, d).where("NOT pruned").orderBy(c("score").desc(), "trial").limit(20).select("trial", "score")


@query("t8_page_with_total", "SELECT o_orderkey AS id, o_totalprice AS price, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS total FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25 OFFSET 50")
def _(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'P'")
    page = o.orderBy(c("o_orderdate").desc(), c("o_orderkey").desc()).offset(50).limit(25)
    return page.join(F.broadcast(o.agg(F.count(lit(1)).alias("total")))).select(c("o_orderkey").alias("id"), c("o_totalprice").alias("price"), "total")


@query("t9_symbol_order", with_sql("bars") + "SELECT symbol, t, close FROM bars ORDER BY symbol, t")
def _(spark, d):
    return weekly(spark, d).df.orderBy("symbol", "ts").select("symbol", T(), "close")


@query("u1_union_all_latest", with_sql("trades", "strategies") + "SELECT strategy_id, max(t) AS last_fill, any_value(src) AS source FROM (SELECT strategy_id, t, 'live' AS src FROM trades JOIN strategies USING (strategy_id) WHERE mode = 'live' UNION ALL SELECT strategy_id, t, 'signal' FROM trades JOIN strategies USING (strategy_id) WHERE mode = 'signal') GROUP BY 1")
def _(spark, d):
    t = trades(spark, d).join(strategies(spark, d), "strategy_id")
    part = lambda m: t.where(c("mode") == m).select("strategy_id", "t", lit(m).alias("source"))
    return part("live").unionByName(part("signal")).groupBy("strategy_id").agg(F.max("t").alias("last_fill"), F.max_by("source", "t").alias("source"))


@query("u2_unlike_orders", "SELECT kind, status, count(*) AS n, round(sum(value), 2) AS value FROM (SELECT 'order' AS kind, o_orderstatus AS status, o_totalprice AS value FROM orders UNION ALL SELECT 'line', l_linestatus, l_extendedprice FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 'part', 'open', p_retailprice FROM part) GROUP BY 1, 2")
def _(spark, d):
    o = table(spark, d, "orders").select(lit("order").alias("kind"), c("o_orderstatus").alias("status"), c("o_totalprice").alias("value"))
    li = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(lit("line").alias("kind"), c("l_linestatus").alias("status"), c("l_extendedprice").alias("value"))
    p = table(spark, d, "part").select(lit("part").alias("kind"), lit("open").alias("status"), c("p_retailprice").alias("value"))
    return o.unionByName(li).unionByName(p).groupBy("kind", "status").agg(F.count(lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value"))


@query("u3_union_distinct", with_sql("trades", "positions") + "SELECT strategy_id, symbol FROM positions UNION SELECT strategy_id, symbol FROM trades WHERE profit IS NOT NULL")
def _(spark, d):
    return positions(spark, d).select("strategy_id", "symbol").union(trades(spark, d).where("profit IS NOT NULL").select("strategy_id", "symbol")).distinct()


@query("u4_stream_discovery", "SELECT l_suppkey AS k FROM lineitem WHERE l_quantity > 48 UNION SELECT s_suppkey FROM supplier WHERE s_acctbal < 0")
def _(spark, d):
    a = table(spark, d, "lineitem").where("l_quantity > 48").select(c("l_suppkey").alias("k"))
    return a.union(table(spark, d, "supplier").where("s_acctbal < 0").select("s_suppkey")).distinct()


@query("u5_common_times", with_sql("hbars") + "SELECT t FROM hbars WHERE symbol = 'view' INTERSECT SELECT t FROM hbars WHERE symbol = 'click'")
def _(spark, d):
    h = hourly(spark, d).df.select("symbol", T())
    return h.where("symbol = 'view'").join(h.where("symbol = 'click'"), "t", "left_semi").select("t")


@query("u6_canonical_members", "SELECT lower(p_brand) AS market, p_name AS symbol, last(p_size ORDER BY p_partkey) AS weight FROM part GROUP BY 1, 2")
def _(spark, d):
    p = table(spark, d, "part").select(F.lower("p_brand").alias("market"), c("p_name").alias("symbol"), c("p_size").alias("weight"), c("p_partkey").alias("seq"))
    return B.canonical_members(p, ["market", "symbol"], "seq")


@query("u7_missing_bars", with_sql("bars", more="e AS (SELECT symbol, unnest(range(min(t), max(t), 604800)) AS t FROM bars GROUP BY 1)") + "SELECT symbol, t FROM e EXCEPT SELECT symbol, t FROM bars")
def _(spark, d):
    return B.missing_bars(weekly(spark, d))


AGG = "first(open ORDER BY t) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY t) AS close, sum(volume) AS volume"


@query("b1_resample_count", with_sql("x") + f"SELECT symbol, min(t) AS t, {AGG} FROM x GROUP BY symbol, pos // 4 HAVING count(*) = 4")
def _(spark, d):
    return B.resample_count(weekly(spark, d), 4).select("symbol", T(), "open", "high", "low", "close", "volume")


@query("b3_resample_floor", with_sql("hbars") + f"SELECT symbol, t // 14400 * 14400 AS t, {AGG} FROM hbars AS h GROUP BY symbol, h.t // 14400")
def _(spark, d):
    return B.resample_floor(hourly(spark, d), 4 * HOUR).select("symbol", T(), "open", "high", "low", "close", "volume")


@query("b4_resample_right", with_sql("hbars") + f"SELECT symbol, CAST(ceil(h.t / 14400.0) AS BIGINT) * 14400 AS t, {AGG.replace('ORDER BY t', 'ORDER BY h.t')} FROM hbars AS h GROUP BY 1, 2")
def _(spark, d):
    return B.resample_right(hourly(spark, d), 4 * HOUR).select("symbol", T(), "open", "high", "low", "close", "volume")


@query("b6_review_window", with_sql("x", more="""w AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, min(CAST(epoch(l_shipdate) AS BIGINT)) AS a, max(CAST(epoch(l_shipdate) AS BIGINT)) AS z FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
 v AS (SELECT symbol, a, z, greatest(604800 * 8, CAST(floor((z - a) * 0.05) AS BIGINT)) AS pad FROM w)""") + "SELECT symbol, t, close FROM x JOIN v USING (symbol) WHERE t BETWEEN a - pad AND z + pad QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY t DESC) <= 60")
def _(spark, d):
    t = seconds("l_shipdate")
    x = table(spark, d, "lineitem").where("l_linestatus = 'F'").select(  # closed trades
        c("l_suppkey").cast("string").alias("symbol"), t.alias("entry_t"), t.alias("exit_t"))
    return B.review_window(x, weekly(spark, d), 60).select("symbol", T(), "close")


def sessions(spark, d):
    return calendar(spark, d).where("day % 5 <> 2").select("market", "day")


SESS = "ss AS (SELECT day, CAST(DATE '1970-01-01' + CAST(day AS INTEGER) AS DATE) AS dt, lag(day) OVER (ORDER BY day) AS was FROM calendar WHERE day % 5 <> 2)"


@query("b7_schedule_weekly", with_sql("calendar", more=SESS + ", k AS (SELECT *, day - (isodow(dt) - 1) + 2 AS due FROM ss)") + "SELECT day FROM k WHERE CASE WHEN day < due THEN was IS NOT NULL AND was < due - 7 AND due - 7 <= day ELSE was IS NULL OR was < due END")
def _(spark, d):
    return B.due_days(sessions(spark, d), "market", "day", "weekly", weekday=3).select("day")


@query("b7_schedule_monthly", with_sql("calendar", more=SESS + """, k AS (SELECT *, date_trunc('month', dt)::DATE AS m FROM ss), k1 AS (SELECT *, CAST(epoch(m + CAST(least(31, day(last_day(m))) AS INTEGER) - 1) AS BIGINT) // 86400 AS due,
 CAST(epoch((m - INTERVAL 1 MONTH)::DATE + CAST(least(31, day(last_day((m - INTERVAL 1 MONTH)::DATE))) AS INTEGER) - 1) AS BIGINT) // 86400 AS bef FROM k)""") + "SELECT day FROM k1 WHERE CASE WHEN day < due THEN was IS NOT NULL AND was < bef AND bef <= day ELSE was IS NULL OR was < due END")
def _(spark, d):
    return B.due_days(sessions(spark, d), "market", "day", "monthly", monthday=31).select("day")


@query("b8_period_ends", with_sql("calendar", more=SESS + ", k AS (SELECT day, dt, lead(dt) OVER (ORDER BY day) AS nx FROM ss)") + "SELECT 'weekly' AS kind, day FROM k WHERE nx IS NOT NULL AND date_trunc('week', dt) <> date_trunc('week', nx) UNION ALL SELECT 'monthly', day FROM k WHERE nx IS NOT NULL AND date_trunc('month', dt) <> date_trunc('month', nx)")
def _(spark, d):
    s = sessions(spark, d)
    ends = lambda f: B.period_ends(s, "market", "day", f).select(lit(f).alias("kind"), "day")
    return ends("weekly").unionByName(ends("monthly"))


