"""Market tables derived from the star-schema tables, in Spark and in SQL.

The SQL fragments are common table expressions; ``with_sql(names...)`` puts the ones a
query needs in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.model import Panel

WEEK, HOUR, DAY = 604800, 3600, 86400
CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cte(name: str, sql: str, *needs: str) -> None:
    CTE[name] = (needs, sql)


def _order(names, done):
    for n in names:
        if n not in done:
            _order(CTE[n][0], done)
            done.append(n)
    return done


def with_sql(*names: str, recursive: bool = False, more: str = "") -> str:
    """``WITH a AS (...), b AS (...)`` for the named fragments and what they need."""
    parts = [f"{n} AS ({CTE[n][1]})" for n in _order(names, [])]
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(parts + ([more] if more else [])) + "\n"


def seconds(col: str):
    """Epoch seconds of a zone-less timestamp column (the session runs in UTC)."""
    return F.unix_seconds(F.col(col).cast("timestamp"))


def bucket_bars(df: DataFrame, symbol, time, price, size, order, step: int) -> DataFrame:
    """Bars by epoch-aligned buckets; first and last price by a complete order."""
    start = F.floor(time / step) * step
    rows = df.select(symbol.alias("symbol"), start.alias("t"), price.alias("price"),
                     size.alias("size"), F.struct(*order).alias("o"))
    return rows.groupBy("symbol", "t").agg(
        F.min_by("price", "o").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "o").alias("close"), F.sum("size").alias("volume"),
    ).select("symbol", F.timestamp_seconds("t").alias("ts"), "open", "high", "low", "close", "volume")


def weekly(spark, d) -> Panel:
    """Weekly bars per supplier."""
    li = table(spark, d, "lineitem")
    df = bucket_bars(li, F.col("l_suppkey").cast("string"), seconds("l_shipdate"),
                     F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity"),
                     ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"], WEEK)
    return Panel(df, WEEK)


cte("bars", """SELECT CAST(l_suppkey AS VARCHAR) AS symbol,
 CAST(floor(epoch(l_shipdate) / 604800) AS BIGINT) * 604800 AS t,
 first(l_extendedprice / l_quantity ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS open,
 max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
 last(l_extendedprice / l_quantity ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS close,
 sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2""")


def hourly(spark, d) -> Panel:
    """Hourly bars per event type."""
    ev = table(spark, d, "events")
    df = bucket_bars(ev, F.col("event_type"), seconds("ts"), F.col("value"), F.lit(1.0),
                     ["ts", "event_id"], HOUR)
    return Panel(df, HOUR)


cte("hbars", """SELECT event_type AS symbol, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS t,
 first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
 last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2""")

cte("x0", """SELECT *, row_number() OVER s - 1 AS pos, lag(close) OVER s AS prev, lag(high) OVER s AS ph,
 lag(low) OVER s AS pl, (high + low + close) / 3.0 AS tp FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY t)""", "bars")
cte("x", """SELECT *, lag(tp) OVER (PARTITION BY symbol ORDER BY t) AS ptp, close - prev AS delta,
 close / nullif(prev, 0) - 1 AS ret, greatest(high - low, abs(high - prev), abs(low - prev)) AS tr,
 greatest(close - prev, 0) AS gain, greatest(prev - close, 0) AS loss,
 coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0) * volume AS mfv,
 sign(coalesce(close - prev, 0)) * volume AS signed FROM x0""", "x0")

# --- ledgers ---------------------------------------------------------------------------

COINS = ("BTC", "ETH", "SOL", "XRP", "DOGE")
KINDS = {("A", "F"): "open_long", ("N", "F"): "add_long", ("R", "F"): "close_long",
         ("A", "O"): "open_short", ("N", "O"): "reduce_long", ("R", "O"): "close_short"}


def trades(spark, d) -> DataFrame:
    """One row per fill; profit is null on entries."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = F.col
    kind = F.lit(None).cast("string")
    for (flag, status), name in KINDS.items():
        kind = F.when((c("l_returnflag") == flag) & (c("l_linestatus") == status), name).otherwise(kind)
    price = c("l_extendedprice") / c("l_quantity")
    coin = F.element_at(F.array(*[F.lit(x + "/USDT") for x in COINS]), (c("l_partkey") % 5 + 1).cast("int"))
    exit_ = (c("l_returnflag") == "R") | ((c("l_returnflag") == "N") & (c("l_linestatus") == "O"))
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.concat_ws("-", F.lpad(c("l_orderkey").cast("string"), 12, "0"), c("l_linenumber").cast("string"),
                    F.lpad(c("l_partkey").cast("string"), 10, "0"),
                    F.lpad(c("l_suppkey").cast("string"), 10, "0")).alias("id"),
        (c("o_custkey") % 50).alias("strategy_id"), coin.alias("symbol"), kind.alias("type"),
        c("l_quantity").alias("amount"), price.alias("price"), (F.floor(c("l_tax") * price) / 100.0 * c("l_quantity")).alias("commission"),
        F.when(exit_, F.floor((c("l_discount") - 0.05) * c("l_extendedprice") * 100) / 100.0).alias("profit"),
        seconds("l_shipdate").alias("t"))


cte("trades", """SELECT lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || '-' || l_linenumber || '-' || lpad(CAST(l_partkey AS VARCHAR), 10, '0')
 || '-' || lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS id, o_custkey % 50 AS strategy_id,
 (['BTC','ETH','SOL','XRP','DOGE'])[l_partkey % 5 + 1] || '/USDT' AS symbol,
 CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'open_long' WHEN 'NF' THEN 'add_long' WHEN 'RF' THEN 'close_long'
 WHEN 'AO' THEN 'open_short' WHEN 'NO' THEN 'reduce_long' WHEN 'RO' THEN 'close_short' END AS type,
 l_quantity AS amount, l_extendedprice / l_quantity AS price, floor(l_tax * (l_extendedprice / l_quantity)) / 100.0 * l_quantity + 0.0 AS commission,
 CASE WHEN l_returnflag = 'R' OR (l_returnflag = 'N' AND l_linestatus = 'O')
 THEN floor((l_discount - 0.05) * l_extendedprice * 100) / 100.0 + 0.0 END AS profit,
 CAST(epoch(l_shipdate) AS BIGINT) AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")


def strategies(spark, d) -> DataFrame:
    """Strategies with capital (sometimes small) and execution mode."""
    return table(spark, d, "customer").groupBy((F.col("c_custkey") % 50).alias("strategy_id")).agg(
        F.round(F.sum("c_acctbal"), 2).alias("capital")).withColumn(
        "mode", F.when(F.col("strategy_id") % 2 == 0, "live").otherwise("signal"))


cte("strategies", """SELECT c_custkey % 50 AS strategy_id, round(sum(c_acctbal), 2) AS capital,
 CASE WHEN c_custkey % 50 % 2 = 0 THEN 'live' ELSE 'signal' END AS mode FROM customer GROUP BY 1, 3""")


def snapshots(spark, d) -> DataFrame:
    """Equity snapshots of strategies at irregular times."""
    c = F.col
    return table(spark, d, "orders").select(
        (c("o_custkey") % 50).alias("strategy_id"), (seconds("o_orderdate") + c("o_orderkey") * 7919 % 86400).alias("t"),
        c("o_orderkey").alias("id"), c("o_totalprice").alias("equity"), c("o_orderstatus").alias("reason"))


cte("snapshots", """SELECT o_custkey % 50 AS strategy_id, CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey * 7919 % 86400 AS t,
 o_orderkey AS id, o_totalprice AS equity, o_orderstatus AS reason FROM orders""")


def positions(spark, d) -> DataFrame:
    """Open positions per strategy, symbol and side with their average entry."""
    t = trades(spark, d).where(F.col("type").isin("open_long", "add_long", "open_short"))
    side = F.when(F.col("type") == "open_short", "short").otherwise("long")
    return t.groupBy("strategy_id", "symbol", side.alias("side")).agg(
        F.sum("amount").alias("size"), F.round(F.sum(F.col("price") * F.col("amount")) / F.sum("amount"), 6).alias("entry"))


cte("positions", """SELECT strategy_id, symbol, CASE WHEN type = 'open_short' THEN 'short' ELSE 'long' END AS side,
 sum(amount) AS size, round(sum(price * amount) / sum(amount), 6) AS entry FROM trades
 WHERE type IN ('open_long', 'add_long', 'open_short') GROUP BY 1, 2, 3""", "trades")


def marks(spark, d) -> DataFrame:
    """Latest price per symbol (one symbol has none)."""
    t = trades(spark, d).where(F.col("symbol") != "DOGE/USDT")
    return t.groupBy("symbol").agg(F.max_by("price", F.struct("t", "id")).alias("mark"), F.max("t").alias("t"))


cte("marks", """SELECT symbol, last(price ORDER BY t, id) AS mark, max(t) AS t FROM trades
 WHERE symbol <> 'DOGE/USDT' GROUP BY 1""", "trades")


def members(spark, d) -> DataFrame:
    """Universe intervals: half-open, several per symbol with a gap, some open, some absent."""
    s, c = table(spark, d, "supplier"), F.col
    base = F.unix_date(F.to_date(F.lit("1995-01-01"))) + (c("s_suppkey") % 40) * 30
    day = lambda x: F.date_from_unix_date(x.cast("int"))
    first = F.struct(day(base).alias("valid_from"), day(base + 700).alias("valid_to"))
    again = F.struct(day(base + 900).alias("valid_from"),
                     F.when(c("s_suppkey") % 3 == 0, None).otherwise(day(base + 1500)).alias("valid_to"))
    return s.where(c("s_suppkey") % 10 != 9).select(
        c("s_suppkey").cast("string").alias("symbol"), F.explode(F.array(first, again)).alias("i")).select("symbol", "i.*")


cte("members", """SELECT CAST(s_suppkey AS VARCHAR) AS symbol, DATE '1995-01-01' + CAST(s_suppkey % 40 * 30 + k AS INTEGER) AS valid_from,
 CASE WHEN k = 0 THEN DATE '1995-01-01' + CAST(s_suppkey % 40 * 30 + 700 AS INTEGER) WHEN s_suppkey % 3 <> 0
 THEN DATE '1995-01-01' + CAST(s_suppkey % 40 * 30 + 1500 AS INTEGER) END AS valid_to
 FROM supplier, (VALUES (0), (900)) v(k) WHERE s_suppkey % 10 <> 9""")


def fundamentals(spark, d) -> DataFrame:
    """Quarterly reports per supplier, visible 45 days after the quarter; some fields are null."""
    li, c = table(spark, d, "lineitem"), F.col
    quarter = F.trunc(c("l_shipdate").cast("date"), "quarter")
    g = li.groupBy(c("l_suppkey").cast("string").alias("symbol"), quarter.alias("q")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("revenue"), F.sum("l_quantity").alias("qty"),
        F.round(F.sum(c("l_extendedprice") * c("l_discount")), 4).alias("debt"), F.count(F.lit(1)).alias("n"))
    end = F.date_sub(F.add_months("q", 3), 1)
    return g.select("symbol", end.alias("period_end"), F.date_add(end, 45).alias("available_at"),
                    (c("revenue") * 0.1).alias("net_income"), (c("revenue") * 2.0).alias("shareholder_equity"),
                    F.when(c("n") % 5 != 0, c("debt")).alias("total_debt"), c("revenue").alias("revenue"),
                    (c("qty") * 1000.0).alias("shares"), (c("revenue") * 0.05).alias("free_cash_flow"),
                    F.when(c("n") % 7 != 0, c("qty") / 100.0 - 1.0).alias("revenue_growth"))


cte("fundamentals", """SELECT symbol, period_end, period_end + 45 AS available_at, revenue * 0.1 AS net_income,
 revenue * 2.0 AS shareholder_equity, CASE WHEN n % 5 <> 0 THEN debt END AS total_debt, revenue, qty * 1000.0 AS shares,
 revenue * 0.05 AS free_cash_flow, CASE WHEN n % 7 <> 0 THEN qty / 100.0 - 1.0 END AS revenue_growth FROM (
 SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(CAST(date_trunc('quarter', l_shipdate) AS DATE) + INTERVAL 3 MONTH AS DATE) - 1 AS period_end,
 round(sum(l_extendedprice), 2) AS revenue, sum(l_quantity) AS qty,
 round(sum(l_extendedprice * l_discount), 4) AS debt, count(*) AS n FROM lineitem GROUP BY 1, 2)""")


def calendar(spark, d) -> DataFrame:
    """Sessions: week days with orders, 09:00 to 16:00 with a break at noon."""
    from tidemark.functions.ordered import number
    day = F.floor(seconds("o_orderdate") / DAY)
    days = table(spark, d, "orders").select(day.alias("day")).distinct().where((F.col("day") + 3) % 7 < 5)
    days = days.withColumn("market", F.lit("X"))
    days = number(days, ["market"], ["day"], F.floor(F.col("day") / 4096), "ordinal")
    at = lambda h: F.col("day") * DAY + h * HOUR
    return days.select("market", "day", "ordinal", at(9).alias("opens"), at(16).alias("closes"),
                       at(12).alias("break_start"), at(13).alias("break_end"))


cte("calendar", """SELECT 'X' AS market, day, row_number() OVER (ORDER BY day) - 1 AS ordinal, day * 86400 + 32400 AS opens,
 day * 86400 + 57600 AS closes, day * 86400 + 43200 AS break_start, day * 86400 + 46800 AS break_end FROM (
 SELECT DISTINCT CAST(epoch(o_orderdate) AS BIGINT) // 86400 AS day FROM orders) WHERE (day + 3) % 7 < 5""")


def payments(spark, d) -> DataFrame:
    """Funding payments per symbol (one symbol has no owner)."""
    c = F.col
    coin = F.element_at(F.array(*[F.lit(x + "/USDT") for x in (*COINS, "ADA")]), (c("o_custkey") % 6 + 1).cast("int"))
    return table(spark, d, "orders").select(c("o_orderkey").alias("id"), coin.alias("symbol"), (c("o_totalprice") / 10000 - 15).alias("amount"),
                                            seconds("o_orderdate").alias("t"), (c("o_custkey") % 50).alias("strategy_id"))


cte("payments", """SELECT o_orderkey AS id, (['BTC','ETH','SOL','XRP','DOGE','ADA'])[o_custkey % 6 + 1] || '/USDT' AS symbol,
 o_totalprice / 10000 - 15 AS amount, CAST(epoch(o_orderdate) AS BIGINT) AS t, o_custkey % 50 AS strategy_id FROM orders""")


REGIMES = ("trend_up", "trend_down", "range", "volatile")


def closed_trades(spark, d) -> DataFrame:
    """Closed research trades of twenty runs, money in whole units."""
    c = F.col
    li = table(spark, d, "lineitem")
    gross = F.floor((c("l_discount") - 0.05) * c("l_extendedprice")).cast("double")
    cost = F.floor(c("l_tax") * c("l_extendedprice") * 0.2).cast("double")
    return li.select(
        (c("l_suppkey") % 20).alias("run"), seconds("l_shipdate").alias("t"),
        F.concat_ws("-", F.lpad(c("l_orderkey").cast("string"), 12, "0"), c("l_linenumber").cast("string"),
                    F.lpad(c("l_partkey").cast("string"), 10, "0"), F.lpad(c("l_suppkey").cast("string"), 10, "0")).alias("id"),
        gross.alias("gross"), cost.alias("cost"), (gross - cost).alias("net"), c("l_discount").alias("mae"), (c("l_tax") * 2 + 0.0).alias("mfe"),
        c("l_quantity").alias("holding"), F.element_at(F.array(*[F.lit(r) for r in REGIMES]), (c("l_linenumber") % 4 + 1)).alias("regime"))


cte("rt", """SELECT l_suppkey % 20 AS run, CAST(epoch(l_shipdate) AS BIGINT) AS t, lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || '-' || l_linenumber || '-' || lpad(CAST(l_partkey AS VARCHAR), 10, '0')
 || '-' || lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS id, floor((l_discount - 0.05) * l_extendedprice) AS gross, floor(l_tax * l_extendedprice * 0.2) AS cost,
 floor((l_discount - 0.05) * l_extendedprice) - floor(l_tax * l_extendedprice * 0.2) AS net, l_discount AS mae, l_tax * 2 + 0.0 AS mfe, l_quantity AS holding,
 (['trend_up', 'trend_down', 'range', 'volatile'])[l_linenumber % 4 + 1] AS regime FROM lineitem""")


def score_matrix(spark, d) -> DataFrame:
    """In-sample and out-of-sample scores of twelve configs over eight splits."""
    c = F.col
    p = table(spark, d, "part")
    return p.groupBy((c("p_partkey") % 12).alias("config"), (F.floor(c("p_partkey") / 12) % 8).alias("split")).agg(
        (F.sum(c("p_partkey") * 7919 % 1009) % 997 / 997.0).alias("ins"), (F.sum(c("p_partkey") * 104729 % 1013) % 991 / 991.0).alias("oos"))


cte("sm", """SELECT p_partkey % 12 AS config, p_partkey // 12 % 8 AS split, sum(p_partkey * 7919 % 1009) % 997 / 997.0 AS ins,
 sum(p_partkey * 104729 % 1013) % 991 / 991.0 AS oos FROM part GROUP BY 1, 2""")


def trials(spark, d) -> DataFrame:
    """Parameter trials with a score; every seventh is pruned."""
    c = F.col
    k = c("p_partkey")
    params = F.create_map(F.lit("fast"), (k % 9).cast("double"), F.lit("slow"), (k % 25).cast("double"), F.lit("stop"), (k % 4).cast("double"))
    return table(spark, d, "part").select(k.alias("trial"), params.alias("params"), (k * 7919 % 1009 / 10.0).alias("score"), (k % 7 == 0).alias("pruned"))


def decisions(spark, d) -> DataFrame:
    """Past decisions with confidence, realised return and the raw JSON result."""
    c = F.col
    o = table(spark, d, "orders")
    ret = c("o_totalprice") % 2000 / 100 - 10
    dec = F.element_at(F.array(F.lit("BUY"), F.lit("SELL"), F.lit("HOLD")), (c("o_orderkey") % 3 + 1).cast("int"))
    raw = F.when(c("o_custkey") % 5 == 0, F.lit("{bad")).when(c("o_custkey") % 5 == 1, F.to_json(F.struct(F.struct(F.struct(
        F.lower("o_orderpriority").alias("trend")).alias("risk_context")).alias("consensus")))).otherwise(
        F.to_json(F.struct(F.struct(c("o_orderstatus").alias("market_regime")).alias("consensus"))))
    df = o.select(c("o_orderkey").alias("id"), (c("o_custkey") % 4).alias("market"), dec.alias("decision"), (50 + c("o_orderkey") % 50).alias("confidence"),
                  ret.alias("ret"), (c("o_custkey") % 61 - 30).cast("double").alias("score"), raw.alias("raw"), seconds("o_orderdate").alias("t"))
    return df.withColumn("correct", F.when(c("decision") == "BUY", c("ret") > 2).when(c("decision") == "SELL", c("ret") < -2).otherwise(F.abs("ret") <= 5))


cte("dec0", """SELECT o_orderkey AS id, o_custkey % 4 AS market, (['BUY','SELL','HOLD'])[o_orderkey % 3 + 1] AS decision, 50 + o_orderkey % 50 AS confidence,
 o_totalprice % 2000 / 100 - 10 AS ret, CAST(o_custkey % 61 - 30 AS DOUBLE) AS score, CASE WHEN o_custkey % 5 = 0 THEN 'unknown' WHEN o_custkey % 5 = 1 THEN lower(o_orderpriority) ELSE lower(o_orderstatus) END AS regime,
 CAST(epoch(o_orderdate) AS BIGINT) AS t FROM orders""")
cte("dec", "SELECT *, CASE decision WHEN 'BUY' THEN ret > 2 WHEN 'SELL' THEN ret < -2 ELSE abs(ret) <= 5 END AS correct FROM dec0", "dec0")
