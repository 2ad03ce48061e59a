"""Projection, filter and predicate operators over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import market as M
from tidemark.functions.registry import query
from tidemark.model import epoch
from tidemark.operators import select as S
from tidemark.plans.standins import (HOUR, WEEK, hourly, marks, positions, seconds, strategies, table, trades, weekly, with_sql)

c, lit, when = F.col, F.lit, F.when


@query("p1_time_range_last_n", with_sql("bars") + """SELECT symbol, t, close FROM bars WHERE t >= 820000000 AND t < 920000000
 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY t DESC) <= 25""")
def _(spark, d):
    at = lambda x: F.timestamp_seconds(lit(x))
    return S.latest_rows(weekly(spark, d), 25, before=at(920000000), after=at(820000000)).select(
        "symbol", epoch().alias("t"), "close")


HOLES = "h AS (SELECT *, CAST(volume AS BIGINT) AS v FROM bars)"


def _holes(spark, d):
    v = c("volume").cast("long")
    df = weekly(spark, d).df
    return df.withColumn("open", when(v % 3 != 0, c("open"))).withColumn("high", when(v % 10 != 0, c("high")))


@query("p2_clean_ohlcv", with_sql("bars", more=HOLES) + """SELECT symbol, t, CASE WHEN v % 3 <> 0 THEN open ELSE close END AS open,
 high, close FROM h WHERE v % 10 <> 0""")
def _(spark, d):
    return S.clean_ohlcv(_holes(spark, d)).select("symbol", epoch().alias("t"), "open", "high", "close")


@query("p3_closed_bars", with_sql("hbars") + """SELECT symbol, count(*) AS n, max(t) AS last FROM hbars
 WHERE t + 3600 <= 1704500000 GROUP BY 1""")
def _(spark, d):
    df = S.closed_bars(hourly(spark, d).df, HOUR, lit(1704500000))
    return df.groupBy("symbol").agg(F.count(lit(1)).alias("n"), F.max(epoch()).alias("last"))


@query("p4_last_completed_open", """SELECT event_id, (CAST(floor(epoch(ts)) AS BIGINT) // 900 - 1) * 900 AS open_15m,
 CAST(floor(epoch(ts)) AS BIGINT) // 14400 - 1 AS token_4h FROM events""")
def _(spark, d):
    now = seconds("ts")
    return table(spark, d, "events").select("event_id", M.last_completed_open(now, 900).alias("open_15m"),
                                            (F.floor(now / 14400) - 1).alias("token_4h"))


@query("p5_window_coverage", with_sql("bars") + """SELECT symbol, min(t) AS first, max(t) AS last, count(*) AS rows,
 min(t) <= 789000000 + 3 * 604800 AND max(t) >= 1004000000 - 3 * 604800 AND count(*) / 356.0 >= 0.98 AS covered FROM bars GROUP BY 1""")
def _(spark, d):
    return S.covers_window(weekly(spark, d).df, ["symbol"], 789000000, 1004000000, WEEK)


KEY = """CASE k WHEN 0 THEN 'Crypto:' || lower(p_name) || 'usdt@Sim:swap' WHEN 1 THEN 'btc-usdt@spot' WHEN 2 THEN '600' || lpad(CAST(p_size AS VARCHAR), 3, '0')
 WHEN 3 THEN 'cnstock:000' || lpad(CAST(p_size AS VARCHAR), 3, '0') || '.xshe' WHEN 4 THEN '0' || lpad(CAST(p_size AS VARCHAR), 4, '0') || '.HK'
 WHEN 5 THEN 'usstock: abc' || p_size WHEN 6 THEN 'eth_usdc@binance' ELSE 'Forex:EURUSD@x:spot' END"""


@query("p6_instrument_key", f"""WITH p AS (SELECT p_partkey AS k0, p_partkey % 8 AS k, upper(p_name) AS n, p_size AS z, {KEY} AS raw
 FROM (SELECT *, p_partkey % 8 AS k FROM part)) SELECT k0 AS k,
 (['Crypto','Crypto','CNStock','CNStock','HKStock','USStock','Crypto','Forex'])[k + 1] AS market,
 CASE k WHEN 0 THEN n || '/USDT' WHEN 1 THEN 'BTC/USDT' WHEN 2 THEN '600' || lpad(CAST(z AS VARCHAR), 3, '0')
 WHEN 3 THEN '000' || lpad(CAST(z AS VARCHAR), 3, '0') || '.SZ' WHEN 4 THEN '0' || lpad(CAST(z AS VARCHAR), 4, '0') || '.HK'
 WHEN 5 THEN 'ABC' || z WHEN 6 THEN 'ETH/USDC' ELSE 'EURUSD' END AS symbol,
 CASE k WHEN 0 THEN 'sim' WHEN 6 THEN 'binance' ELSE '' END AS exchange,
 CASE k WHEN 0 THEN 'swap' WHEN 1 THEN 'spot' WHEN 6 THEN 'spot' ELSE '' END AS market_type FROM p""")
def _(spark, d):
    raw = F.expr("CASE p_partkey % 8 WHEN 0 THEN concat('Crypto:', lower(p_name), 'usdt@Sim:swap') WHEN 1 THEN 'btc-usdt@spot'"
                 " WHEN 2 THEN concat('600', lpad(p_size, 3, '0')) WHEN 3 THEN concat('cnstock:000', lpad(p_size, 3, '0'), '.xshe')"
                 " WHEN 4 THEN concat('0', lpad(p_size, 4, '0'), '.HK') WHEN 5 THEN concat('usstock: abc', p_size)"
                 " WHEN 6 THEN 'eth_usdc@binance' ELSE 'Forex:EURUSD@x:spot' END")
    return table(spark, d, "part").select(c("p_partkey").alias("k"), M.parse_instrument(raw).alias("i")).select("k", "i.*")


@query("p7_symbol_norm", """SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) || '/USDT' WHEN 1 THEN upper(p_name) || '/USD'
 WHEN 2 THEN upper(p_name) || '/BTC' ELSE upper(p_name) END AS venue,
 CASE p_partkey % 4 WHEN 0 THEN upper(p_name) || '/USDT' WHEN 1 THEN upper(p_name) || '_USD_PERP'
 WHEN 2 THEN upper(p_name) || '/BTC' ELSE upper(p_name) END AS ledger FROM part""")
def _(spark, d):
    raw = F.expr("CASE p_partkey % 4 WHEN 0 THEN concat(p_name, '-usdt') WHEN 1 THEN concat(p_name, '_usd_perp')"
                 " WHEN 2 THEN concat(p_name, '/btc', if(p_size % 2 = 0, '', ':btc')) ELSE p_name END")
    raw2 = F.regexp_replace(raw, ":btc$", "")
    return table(spark, d, "part").select(c("p_partkey").alias("k"), M.traded_symbol(raw2).alias("venue"),
                                          M.strategy_symbol(raw).alias("ledger"))


@query("p8_order_status", """SELECT CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'P' THEN 'partial' ELSE
 CASE WHEN o_orderkey % 2 = 0 THEN 'open' WHEN o_orderkey % 3 = 0 THEN 'cancelled' ELSE 'held_up' END END AS status, count(*) AS n
 FROM orders GROUP BY 1""")
def _(spark, d):
    raw = F.expr("CASE o_orderstatus WHEN 'F' THEN 'Fully-Filled' WHEN 'P' THEN ' partial_fill ' ELSE"
                 " CASE WHEN o_orderkey % 2 = 0 THEN 'NEW' WHEN o_orderkey % 3 = 0 THEN 'canceled' ELSE 'held-up' END END")
    return table(spark, d, "orders").groupBy(M.order_status(raw).alias("status")).agg(F.count(lit(1)).alias("n"))


@query("p9_epoch_unit", """SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE CAST(floor(epoch(ts)) AS BIGINT) END AS t FROM events""")
def _(spark, d):
    t = seconds("ts").cast("double")
    k = c("event_id") % 4
    raw = when(k == 0, t).when(k == 1, t * 1e3).when(k == 2, t * 1e6).otherwise(-1.0)
    return table(spark, d, "events").select("event_id", M.epoch_seconds(raw).cast("long").alias("t"))


@query("p10_frequency", """WITH f AS (SELECT p_partkey AS k, p_size AS z, p_brand = 'Brand#1' AS coin,
 (['1m','15m','1h','4h','1d','1w','2m'])[p_partkey % 7 + 1] AS freq FROM part) SELECT k, freq,
 CAST((MAP {'1m': 60, '15m': 900, '1h': 3600, '4h': 14400, '1d': 86400, '1w': 604800, '2m': 86400})[freq] AS INTEGER) AS seconds,
 round(CASE freq WHEN '1m' THEN CASE WHEN coin THEN 525960.0 ELSE 98280.0 END WHEN '15m' THEN CASE WHEN coin THEN 35064.0 ELSE 6552.0 END
 WHEN '1h' THEN CASE WHEN coin THEN 8766.0 ELSE 1638.0 END WHEN '4h' THEN CASE WHEN coin THEN 2191.5 ELSE 409.5 END
 WHEN '1w' THEN 52.0::DOUBLE WHEN '2m' THEN CASE WHEN coin THEN 262980.0 ELSE 49140.0 END ELSE CASE WHEN coin THEN 365.25 ELSE 252.0 END END, 6) AS per_year FROM f""")
def _(spark, d):
    raw = F.expr("element_at(array('m1', '15分钟', ' H1', '4小时', 'Daily', 'weekly', '2m'), int(p_partkey % 7) + 1)")
    f = M.frequency(raw)
    return table(spark, d, "part").select(
        c("p_partkey").alias("k"), f.alias("freq"), M.frequency_seconds(f).alias("seconds"),
        F.round(M.periods_per_year(f, c("p_brand") == "Brand#1"), 6).alias("per_year"))


@query("p11_unrealized_pnl", with_sql("positions", "marks") + """SELECT strategy_id, symbol, side,
 round(CASE WHEN mark > 0 THEN CASE WHEN side = 'short' THEN entry - mark ELSE mark - entry END * size ELSE 0 END, 4) AS pnl,
 round(entry * size, 6) AS notional, round(CASE WHEN strategy_id % 2 = 0 THEN entry * size / 5 ELSE entry * size END, 6) AS margin,
 round(CASE WHEN mark > 0 THEN CASE WHEN side = 'short' THEN entry - mark ELSE mark - entry END * size ELSE 0 END
 / (entry * size) * 100 * CASE WHEN strategy_id % 2 = 0 THEN 5 ELSE 1 END, 6) AS pct
 FROM positions LEFT JOIN marks USING (symbol)""")
def _(spark, d):
    p = positions(spark, d).join(marks(spark, d), "symbol", "left")
    pnl = M.unrealized_pnl(c("side"), c("entry"), c("mark"), c("size"))
    kind, n = when(c("strategy_id") % 2 == 0, "swap").otherwise("spot"), M.notional(c("entry"), c("size"))
    return p.select("strategy_id", "symbol", "side", F.round(pnl, 4).alias("pnl"), F.round(n, 6).alias("notional"),
                    F.round(M.margin(n, lit(5.0), kind), 6).alias("margin"),
                    F.round(M.pnl_percent(c("entry"), c("size"), pnl, lit(5.0), kind), 6).alias("pct"))


@query("p12_floor_to_step", """SELECT p_partkey AS k, CAST(floor(CAST(CAST(p_retailprice AS VARCHAR) AS DECIMAL(20,6)) / 0.25) AS DOUBLE) * 0.25 AS lots,
 CAST(p_partkey % 100 AS DOUBLE) * 0.0001 AS near, round(p_retailprice / 3, 2) + 0.0 AS clean FROM part""")
def _(spark, d):
    near = (c("p_partkey") % 100) * 0.0001 - 6e-20
    return table(spark, d, "part").select(
        c("p_partkey").alias("k"), M.floor_to_step(c("p_retailprice"), lit(0.25)).alias("lots"),
        M.floor_to_step(near, lit(0.0001)).alias("near"), M.clean_number(c("p_retailprice") / 3, 2).alias("clean"))


@query("p13_target_quantity", with_sql("positions", "strategies") + """SELECT strategy_id, symbol, side, kind,
 round(CASE kind WHEN 'quantity' THEN size + 2 WHEN 'value' THEN size + 1000 * 3 / entry WHEN 'target_quantity' THEN 2
 WHEN 'target_value' THEN 3000 / entry ELSE (CASE WHEN capital > 0 THEN capital * 0.6 / (1.001 * 1.0005) ELSE capital * 0.6 END) / entry END, 6) AS target
 FROM positions JOIN strategies USING (strategy_id), (VALUES ('quantity'), ('value'), ('target_quantity'), ('target_value'), ('target_percent')) k(kind)""")
def _(spark, d):
    p = positions(spark, d).join(strategies(spark, d), "strategy_id")
    kinds = F.array(*[lit(k) for k in ("quantity", "value", "target_quantity", "target_value", "target_percent")])
    p = p.withColumn("kind", F.explode(kinds))
    value = when(c("kind").endswith("quantity"), 2.0).when(c("kind") == "target_percent", 0.2).otherwise(1000.0)
    q = M.target_quantity(c("kind"), value, c("size"), c("entry"), c("capital"), 3.0, 0.001, 0.0005)
    return p.select("strategy_id", "symbol", "side", "kind", F.round(q, 6).alias("target"))


@query("p14_block_reason", with_sql("bars", more="""o AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol,
 CAST(floor(epoch(l_shipdate) / 604800) AS BIGINT) * 604800 + 604800 AS t, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS delta FROM lineitem)""") + """
 SELECT CASE WHEN close IS NULL THEN 'no_price' WHEN CAST(volume AS BIGINT) % 13 = 0 THEN 'suspended'
 WHEN delta > 0 AND close = high THEN 'limit_up' WHEN delta < 0 AND close = low THEN 'limit_down' ELSE '' END AS reason,
 count(*) AS n, sum(delta) AS delta FROM o LEFT JOIN bars USING (symbol, t) GROUP BY 1""")
def _(spark, d):
    li = table(spark, d, "lineitem")
    o = li.select(c("l_suppkey").cast("string").alias("symbol"),
                  F.timestamp_seconds(F.floor(seconds("l_shipdate") / WEEK) * WEEK + WEEK).alias("ts"),
                  when(c("l_returnflag") == "R", -c("l_quantity")).otherwise(c("l_quantity")).alias("delta"))
    j = S.tradable(o, weekly(spark, d).df, ["symbol", "ts"])
    reason = M.block_reason(c("close"), c("volume").cast("long") % 13 == 0, c("close") == c("high"), c("close") == c("low"), c("delta"))
    return j.groupBy(reason.alias("reason")).agg(F.count(lit(1)).alias("n"), F.sum("delta").alias("delta"))


@query("p15_liquidity_cap", with_sql("bars") + "SELECT symbol, t, floor(volume * 0.1 / 0.5 + 1e-10) * 0.5 AS cap FROM bars WHERE volume > 0")
def _(spark, d):
    return weekly(spark, d).df.select("symbol", epoch().alias("t"), M.liquidity_cap(c("volume"), lit(0.5)).alias("cap"))


def _bands(name):
    strong, medium, mild = M.OPPORTUNITY_BANDS[name]
    out = f"CASE WHEN ch > {strong} THEN 'overbought' WHEN ch > {medium} THEN 'bullish_momentum'"
    out += f" WHEN ch > {mild} THEN 'bullish_momentum'" if mild else ""
    out += f" WHEN ch < -{strong} THEN 'oversold' WHEN ch < -{medium} THEN 'bearish_momentum'"
    out += f" WHEN ch < -{mild} THEN 'bearish_momentum' WHEN abs(ch) <= {mild} THEN 'consolidation'" if mild else ""
    return out + " END"


@query("p16_opportunity", with_sql("hbars", more="""q AS (SELECT symbol, t, 100 * (close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY t), 0) - 1) AS ch FROM hbars)""")
       + "SELECT market, signal, count(*) AS n FROM (SELECT CASE symbol WHEN 'click' THEN 'Crypto' WHEN 'view' THEN 'USStock' WHEN 'signup' THEN 'CNStock' WHEN 'error' THEN 'HKStock' ELSE 'Forex' END AS market, "
       + "CASE symbol WHEN 'click' THEN " + _bands("Crypto") + " WHEN 'view' THEN " + _bands("USStock") + " WHEN 'signup' THEN " + _bands("CNStock")
       + " WHEN 'error' THEN " + _bands("HKStock") + " ELSE " + _bands("Forex") + " END AS signal FROM q) WHERE signal IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    df = S.with_previous(hourly(spark, d), "close")
    market = F.expr("CASE symbol WHEN 'click' THEN 'Crypto' WHEN 'view' THEN 'USStock' WHEN 'signup' THEN 'CNStock' WHEN 'error' THEN 'HKStock' ELSE 'Forex' END")
    ch = 100.0 * (F.try_divide("close", "prev_close") - 1)
    df = df.select(market.alias("market"), ch.alias("ch"))
    o = M.opportunity(c("ch"), c("market"))
    return df.select("market", o["signal"].alias("signal")).where("signal IS NOT NULL").groupBy("market", "signal").agg(F.count(lit(1)).alias("n"))


@query("p17_rate_units", """SELECT l_returnflag AS f, CASE u WHEN 0 THEN 'decimal' WHEN 1 THEN 'percent' WHEN 2 THEN 'bps' ELSE 'AMBIGUOUS_RATE_UNIT' END AS kind,
 count(*) AS n, round(sum(CASE u WHEN 0 THEN l_discount * 100 WHEN 1 THEN l_discount WHEN 2 THEN l_discount / 100 END), 4) AS pct
 FROM (SELECT *, l_partkey % 4 AS u FROM lineitem) GROUP BY 1, 2""")
def _(spark, d):
    unit = F.expr("element_at(array('Fraction', 'pct', 'basis-point', 'points'), int(l_partkey % 4) + 1)")
    li = table(spark, d, "lineitem").select("l_returnflag", unit.alias("u"), M.normal_rate(c("l_discount"), unit).alias("r"))
    kind = F.coalesce(F.get("r.warnings", lit(0)), M.rate_unit(c("u")))
    return li.groupBy(c("l_returnflag").alias("f"), kind.alias("kind")).agg(
        F.count(lit(1)).alias("n"), F.round(F.sum("r.percent"), 4).alias("pct"))


@query("p18_long_short", """SELECT l_partkey % 5 AS k, count(*) AS n, round(sum(CASE k5 WHEN 0 THEN l / (100 - l) WHEN 1 THEN (l + 5) / (100 - l)
 WHEN 2 THEN l / 50 END), 6) AS ratio, count(*) FILTER (k5 IN (1, 3, 4)) AS warned FROM (SELECT *, l_partkey % 5 AS k5, l_quantity AS l FROM lineitem) GROUP BY 1""")
def _(spark, d):
    k, q = c("l_partkey") % 5, c("l_quantity")
    none = lit(None).cast("double")
    s = M.long_short(when(k >= 2, q / 50), when(k == 2, "x").otherwise("lots"), when(k == 1, (q + 5) / 100).when(k == 3, q),
                     when(k == 1, (100 - q) / 100), when(k == 0, q), when(k == 0, 100 - q).otherwise(none))
    li = table(spark, d, "lineitem").select(k.alias("k"), s.alias("s"))
    return li.groupBy("k").agg(F.count(lit(1)).alias("n"), F.round(F.sum("s.ratio"), 6).alias("ratio"),
                               F.count_if(F.size("s.warnings") > 0).alias("warned"))


ALIAS = """a AS (SELECT DISTINCT p_type AS asset, lower(p_name) AS alias FROM part UNION SELECT DISTINCT n_name, lower(substr(n_name, 1, 6)) FROM nation
 UNION SELECT 'said', 'the')"""


@query("p19_news_relevance", f"""WITH {ALIAS} SELECT asset, count(DISTINCT doc_id) AS docs FROM documents JOIN a
 ON regexp_matches(lower(text), '(^|[^a-z0-9])' || alias || '($|[^a-z0-9])') GROUP BY 1""")
def _(spark, d):
    p, n = table(spark, d, "part"), table(spark, d, "nation")
    a = (p.select(c("p_type").alias("asset"), c("p_name").alias("alias")).distinct()
         .unionByName(n.select(c("n_name").alias("asset"), F.substring("n_name", 1, 6).alias("alias")).distinct())
         .unionByName(spark.range(1).select(lit("said").alias("asset"), lit("the").alias("alias"))))
    docs = table(spark, d, "documents")
    return S.relevant_news(docs, a, c("text"), "doc_id").groupBy("asset").agg(F.count(lit(1)).alias("docs"))


RULES_SQL = lambda rules, x: "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains({x}, '{w}')" for w in words) + f" THEN '{name}'" for name, words in rules) + " ELSE 'macro' END"


@query("p20_headline_class", f"SELECT {RULES_SQL(M.HEADLINE_RULES, 'lower(text)')} AS class, count(*) AS n FROM documents GROUP BY 1")
def _(spark, d):
    return table(spark, d, "documents").groupBy(M.headline_class(c("text")).alias("class")).agg(F.count(lit(1)).alias("n"))


@query("p21_macro_relevance", f"""SELECT lang, count(*) AS n FROM (SELECT *, {RULES_SQL(M.HEADLINE_RULES, 'lower(text)')} AS cl FROM documents)
 WHERE cl IN ('inflation', 'central_bank', 'jobs', 'growth') AND ((doc_id % 2 = 0 AND doc_id % 3 <> 0 AND doc_id % 4 = 0) OR (doc_id % 2 = 1 AND doc_id % 3 = 1)) GROUP BY 1""")
def _(spark, d):
    """Even documents are judged for a coin (asset listed, importance high or medium), odd ones for a share (high)."""
    df = table(spark, d, "documents").withColumn("cl", M.headline_class(c("text")))
    affected = F.array(F.struct(lit("DXY").alias("symbol")), F.struct(when(c("doc_id") % 4 == 0, "BTC").otherwise("GOLD").alias("symbol")))
    importance = F.element_at(F.array(lit("low"), lit("high"), lit("medium")), (c("doc_id") % 3 + 1).cast("int"))
    listed = F.array_contains(F.transform(affected, lambda x: x["symbol"]), "BTC")
    hit = when(c("doc_id") % 2 == 0, listed & importance.isin("high", "medium")).otherwise(importance == "high")
    core = c("cl").isin("inflation", "central_bank", "jobs", "growth")
    return df.where(core & hit).groupBy("lang").agg(F.count(lit(1)).alias("n"))


@query("p22_trade_type", with_sql("trades") + """SELECT type, regexp_matches(type, '^(close|reduce)_') AS is_exit,
 CASE WHEN contains(type, 'long') THEN 'long' ELSE 'short' END AS leg,
 CASE WHEN type IN ('open_short', 'add_short', 'close_long', 'reduce_long') THEN -1 ELSE 1 END AS sign, count(*) AS n FROM trades GROUP BY 1, 2, 3, 4""")
def _(spark, d):
    t = trades(spark, d)
    return t.groupBy("type", M.is_exit(c("type")).alias("is_exit"), M.leg(c("type")).alias("leg"),
                     M.direction(c("type")).alias("sign")).agg(F.count(lit(1)).alias("n"))


@query("p23_close_reason", with_sql("trades") + """SELECT resolved, legacy, count(*) AS n FROM (SELECT
 CASE WHEN NOT x THEN '' WHEN strategy_id % 4 = 0 THEN 'stop' WHEN strategy_id % 4 = 1 THEN CASE WHEN contains(type, 'long') THEN 'grid_reduce_long' ELSE 'grid_reduce_short' END ELSE '' END AS resolved,
 CASE WHEN strategy_id % 5 = 0 THEN 'kept' WHEN NOT x THEN '' WHEN strategy_id % 4 = 1 THEN CASE WHEN contains(type, 'long') THEN 'grid_reduce_long' ELSE 'grid_reduce_short' END ELSE 'signal_trigger' END AS legacy
 FROM (SELECT *, regexp_matches(type, '^(close|reduce)_') AS x FROM trades)) GROUP BY 1, 2""")
def _(spark, d):
    s = c("strategy_id")
    bot, reason = when(s % 4 == 1, "grid").otherwise("signal"), when(s % 4 == 0, " stop ").otherwise("")
    return trades(spark, d).groupBy(
        M.close_reason(c("type"), reason, bot).alias("resolved"),
        M.legacy_close_reason(c("type"), bot, when(s % 5 == 0, "kept").otherwise("")).alias("legacy")).agg(F.count(lit(1)).alias("n"))


@query("p24_fee_to_quote", with_sql("trades") + """SELECT strategy_id % 5 AS k, count(*) AS n, round(sum(CASE strategy_id % 5 WHEN 0 THEN commission WHEN 1 THEN commission
 WHEN 2 THEN commission * price WHEN 3 THEN commission * 2.5 ELSE CASE WHEN commission = 0 THEN 0 END END), 4) AS fee FROM trades GROUP BY 1""")
def _(spark, d):
    k = c("strategy_id") % 5
    ccy = when(k == 0, "usdt").when(k == 1, "USDC").when(k == 2, F.substring_index("symbol", "/", 1)).when(k == 3, "BNB").otherwise("")
    fee = M.fee_in_quote(c("symbol"), c("commission"), ccy, c("price"), when(k == 3, 2.5))
    return trades(spark, d).groupBy(k.alias("k")).agg(F.count(lit(1)).alias("n"), F.round(F.sum(fee), 4).alias("fee"))


@query("p25_marker_edge", with_sql("bars", more="""m AS (SELECT symbol, t, CASE WHEN CAST(symbol AS BIGINT) % 2 = 0 THEN close > open ELSE CAST(volume AS BIGINT) % 11 = 0 END AS on_ FROM bars),
 e AS (SELECT *, lag(on_, 1, false) OVER (PARTITION BY symbol ORDER BY t) AS was, avg(CASE WHEN on_ THEN 1.0 ELSE 0 END) OVER (PARTITION BY symbol) AS share FROM m)""")
       + "SELECT symbol, t FROM e WHERE on_ AND (share <= 0.18 OR NOT was)")
def _(spark, d):
    p = weekly(spark, d)
    mark = when(c("symbol").cast("long") % 2 == 0, when(c("close") > c("open"), c("close")).otherwise(0.0)).otherwise(
        when(c("volume").cast("long") % 11 == 0, 1.0))
    return S.marker_edges(p.df.withColumn("m", mark), ["symbol"], ["ts"], p.grain, "m").select("symbol", epoch().alias("t"))


@query("p26_price_alerts", with_sql("positions", "marks") + """SELECT strategy_id, symbol, side, kind FROM positions JOIN marks USING (symbol),
 (VALUES ('price_above'), ('price_below'), ('pnl_above'), ('pnl_below')) k(kind) WHERE mark > 0 AND CASE kind WHEN 'price_above' THEN mark >= entry
 WHEN 'price_below' THEN mark <= entry * 0.9 WHEN 'pnl_above' THEN CASE WHEN side = 'long' THEN mark - entry ELSE entry - mark END / entry * 100 >= 5
 ELSE CASE WHEN side = 'long' THEN mark - entry ELSE entry - mark END / entry * 100 <= -5 END""")
def _(spark, d):
    p = positions(spark, d).join(marks(spark, d), "symbol")
    p = p.withColumn("kind", F.explode(F.array(*[lit(k) for k in ("price_above", "price_below", "pnl_above", "pnl_below")])))
    bar = when(c("kind") == "price_above", c("entry")).when(c("kind") == "price_below", c("entry") * 0.9).when(c("kind") == "pnl_above", 5.0).otherwise(-5.0)
    return p.where(M.alert_hit(c("kind"), c("mark"), bar, c("side"), c("entry"), c("size"))).select("strategy_id", "symbol", "side", "kind")


@query("p27_volatility_trend", with_sql("x", more="""y AS (SELECT *, avg(close) OVER (w ROWS 4 PRECEDING) AS m5, avg(close) OVER (w ROWS 9 PRECEDING) AS m10,
 avg(close) OVER (w ROWS 19 PRECEDING) AS m20, avg(tr) OVER (w ROWS 13 PRECEDING) AS a FROM x WINDOW w AS (PARTITION BY symbol ORDER BY t))""") + """
 SELECT trend, level, count(*) AS n FROM (SELECT CASE WHEN close > m5 AND m5 > m10 AND m10 > m20 THEN 'strong_uptrend' WHEN close > m20 THEN 'uptrend'
 WHEN close < m5 AND m5 < m10 AND m10 < m20 THEN 'strong_downtrend' WHEN close < m20 THEN 'downtrend' ELSE 'sideways' END AS trend,
 CASE WHEN a / close > 0.05 THEN 'high' WHEN a / close > 0.02 THEN 'medium' WHEN a > 0 THEN 'low' ELSE 'unknown' END AS level FROM y WHERE pos >= 19) GROUP BY 1, 2""")
def _(spark, d):
    from tidemark.operators.factors import with_base
    fr = weekly(spark, d).frame(20)
    df = with_base(fr.df, fr.row).withColumns({f"m{n}": F.avg("close").over(fr.w(n)) for n in (5, 10, 20)}).withColumn(
        "a", F.avg("tr").over(fr.w(14)))
    df = fr.own(df).where("pos >= 19")
    return df.groupBy(M.stack_trend(c("close"), c("m5"), c("m10"), c("m20")).alias("trend"),
                      M.volatility_level(c("a"), c("close")).alias("level")).agg(F.count(lit(1)).alias("n"))


FILL = """CASE WHEN type IN ('open_long', 'add_long', 'reduce_short', 'close_short') THEN CASE WHEN mark <= price THEN least(price, mark * 1.001) END
 ELSE CASE WHEN mark >= price THEN greatest(price, mark * 0.999) END END"""


@query("p28_limit_fill", with_sql("trades", "marks") + f"""SELECT type, count(*) AS orders, count(f) AS filled, round(sum(f), 4) AS total FROM (
 SELECT trades.type, {FILL} AS f FROM trades JOIN marks USING (symbol)) GROUP BY 1""")
def _(spark, d):
    t = trades(spark, d).join(marks(spark, d).drop("t"), "symbol")
    f = M.limit_fill(c("type"), c("price"), c("mark"), 0.001)
    return t.groupBy("type").agg(F.count(lit(1)).alias("orders"), F.count(f).alias("filled"), F.round(F.sum(f), 4).alias("total"))


@query("p29_fill_costs", with_sql("trades") + """SELECT strategy_id, round(sum(amount * fp * 0.0005), 4) AS commission, round(sum(amount * abs(fp - price)), 4) AS slippage
 FROM (SELECT *, price * CASE WHEN type IN ('open_long', 'add_long', 'reduce_short', 'close_short') THEN 1.0005 ELSE 0.9995 END AS fp FROM trades) GROUP BY 1""")
def _(spark, d):
    t = trades(spark, d).withColumn("fp", M.slipped(c("type"), c("price"), 0.0005))
    return t.groupBy("strategy_id").agg(
        F.round(F.sum(M.commission(c("amount"), c("fp"))), 4).alias("commission"),
        F.round(F.sum(M.slippage_cost(c("amount"), c("price"), c("fp"))), 4).alias("slippage"))


@query("p30_slippage_verdict", """WITH s AS (SELECT l_partkey % 40 AS k, avg(l_discount * 1000) AS a, max(l_discount * 2000) AS p, count(*) AS n FROM lineitem GROUP BY 1)
 SELECT k, tf, CASE WHEN n < 5 THEN 'unknown' WHEN a <= ga AND p <= gp THEN 'good' WHEN a <= wa AND p <= wp THEN 'warn' ELSE 'bad' END AS level FROM s,
 (VALUES (60, 5, 15, 20, 50), (3600, 15, 40, 50, 120), (14400, 30, 80, 100, 250), (86400, 60, 150, 200, 500)) b(tf, ga, gp, wa, wp)""")
def _(spark, d):
    s = table(spark, d, "lineitem").groupBy((c("l_partkey") % 40).alias("k")).agg(
        F.avg(c("l_discount") * 1000).alias("a"), F.max(c("l_discount") * 2000).alias("p"), F.count(lit(1)).alias("n"))
    s = s.withColumn("tf", F.explode(F.array(*[lit(x) for x in (60, 3600, 14400, 86400)])))
    return s.select("k", "tf", M.slippage_verdict(c("a"), c("p"), c("n"), c("tf")).alias("level"))


@query("p31_yield_curve", with_sql("hbars") + """SELECT t, CASE WHEN s < -0.5 THEN 'deeply_inverted' WHEN s < 0 THEN 'inverted' WHEN s < 0.5 THEN 'flat'
 WHEN s < 1.5 THEN 'normal' ELSE 'steep' END AS level FROM (SELECT a.t, a.close - b.close AS s FROM hbars a JOIN hbars b USING (t)
 WHERE a.symbol = 'view' AND b.symbol = 'click')""")
def _(spark, d):
    h = hourly(spark, d).df
    ten, two = h.where("symbol = 'view'"), h.where("symbol = 'click'").select("ts", c("close").alias("two"))
    return ten.join(two, "ts").select(epoch().alias("t"), M.curve_level(c("close") - c("two")).alias("level"))


@query("p32_surprise", """SELECT k, direction, count(*) AS n FROM (SELECT l_linenumber % 4 AS k, CASE WHEN l_linenumber % 4 = 3 THEN 'neutral'
 WHEN l_discount > l_tax THEN CASE WHEN l_linenumber % 4 = 0 THEN 'bearish' ELSE 'bullish' END
 WHEN l_discount < l_tax THEN CASE WHEN l_linenumber % 4 = 0 THEN 'bullish' ELSE 'bearish' END ELSE 'neutral' END AS direction FROM lineitem) GROUP BY 1, 2""")
def _(spark, d):
    k = c("l_linenumber") % 4
    fmt = lambda x: when(k == 0, F.concat(x, lit("%"))).when(k == 1, F.concat(lit("1,00"), x, lit("K"))).when(k == 2, x).otherwise(lit("-"))
    name = when(k == 0, "US CPI y/y").when(k == 1, "Nonfarm payrolls").otherwise("GDP growth")
    a, f = fmt(c("l_discount").cast("string")), fmt((c("l_tax") + 0.0).cast("string"))
    return table(spark, d, "lineitem").groupBy(k.alias("k"), M.surprise(a, f, name).alias("direction")).agg(F.count(lit(1)).alias("n"))


@query("p33_event_impact", f"""WITH e AS (SELECT {RULES_SQL(M.CALENDAR_RULES, 'lower(text)')} AS cl, (['high', 'medium', 'low'])[doc_id % 3 + 1] AS imp, doc_id % 2 = 0 AS rel FROM documents),
 s AS (SELECT cl, imp, least(100, CASE imp WHEN 'high' THEN 72 WHEN 'low' THEN 28 ELSE 48 END + CASE WHEN cl IN ('inflation', 'central_bank', 'jobs') THEN 10
 WHEN cl IN ('growth', 'energy') THEN 5 ELSE 0 END + CASE WHEN rel THEN 8 ELSE 0 END) AS score FROM e)
 SELECT cl AS class, CAST(score AS INTEGER) AS score, CASE WHEN score >= 70 THEN 'high' WHEN score >= 45 THEN 'medium' ELSE 'low' END AS risk,
 CASE imp WHEN 'high' THEN 0 WHEN 'low' THEN 2 ELSE 1 END AS rank, count(*) AS n FROM s GROUP BY 1, 2, 3, 4""")
def _(spark, d):
    cl = M.headline_class(c("text"), M.CALENDAR_RULES)
    imp = F.element_at(F.array(lit("high"), lit("medium"), lit("low")), (c("doc_id") % 3 + 1).cast("int"))
    df = table(spark, d, "documents").select(cl.alias("class"), imp.alias("imp"), (c("doc_id") % 2 == 0).alias("rel"))
    score = M.impact_score(c("imp"), c("class"), c("rel"), lit("bullish"))
    return df.select("class", score.alias("score"), M.importance_rank(c("imp")).alias("rank")).groupBy(
        "class", "score", M.risk_level(c("score")).alias("risk"), "rank").agg(F.count(lit(1)).alias("n"))


@query("p34_bias_votes", """WITH m AS (SELECT CASE WHEN l_linenumber % 3 <> 0 THEN l_discount - 0.05 END AS f, CASE WHEN l_partkey % 4 <> 0 THEN l_quantity - 25 END AS oi,
 CASE WHEN l_suppkey % 5 <> 0 THEN l_tax * 25 END AS r FROM lineitem), v AS (SELECT *,
 coalesce(CASE WHEN f > 0 THEN 1 WHEN f < 0 THEN -1 END, 0) + coalesce(CASE WHEN oi > 3 THEN 1 WHEN oi < -3 THEN -1 END, 0) + coalesce(CASE WHEN r > 1.2 THEN 1 WHEN r < 0.85 THEN -1 END, 0) AS s,
 coalesce(CASE WHEN f < 0 THEN 1 WHEN f > 0 THEN -1 END, 0) + coalesce(CASE WHEN oi > 0 THEN 1 WHEN oi < 0 THEN -1 END, 0) AS w FROM m)
 SELECT CASE WHEN s >= 2 THEN 'bullish' WHEN s <= -2 THEN 'bearish' ELSE 'neutral' END AS bias,
 CASE WHEN w >= 1 THEN 'bullish' WHEN w <= -1 THEN 'bearish' ELSE 'neutral' END AS flow,
 CASE WHEN coalesce((f > 0.03 AND r > 1.5 AND oi > 8) OR (f < -0.03 AND r < 0.75 AND oi > 8), false) THEN 'high'
 WHEN coalesce(abs(f) > 0.015, false) OR coalesce(r > 1.3 OR r < 0.85, false) THEN 'medium' ELSE 'low' END AS squeeze,
 CASE WHEN oi IS NULL THEN 'unknown' WHEN oi > 20 THEN 'expanding' WHEN oi < -20 THEN 'shrinking' ELSE 'stable' END AS volume, count(*) AS n FROM v GROUP BY 1, 2, 3, 4""")
def _(spark, d):
    m = table(spark, d, "lineitem").select(
        when(c("l_linenumber") % 3 != 0, c("l_discount") - 0.05).alias("f"), when(c("l_partkey") % 4 != 0, c("l_quantity") - 25).alias("oi"),
        when(c("l_suppkey") % 5 != 0, c("l_tax") * 25).alias("r"))
    return m.groupBy(M.derivatives_bias(c("f"), c("oi"), c("r")).alias("bias"), M.flow_bias(c("f"), c("oi")).alias("flow"),
                     M.squeeze_risk(c("f"), c("r"), c("oi")).alias("squeeze"), M.volume_state(c("oi")).alias("volume")).agg(F.count(lit(1)).alias("n"))


