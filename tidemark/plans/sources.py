"""Source and sink operators over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.registry import query
from tidemark.model import PRICES, epoch
from tidemark.plans.standins import hourly, seconds, table, weekly, with_sql
from tidemark.session import chunk_rows
from tidemark.sources import bars as B
from tidemark.sources import events as E

c = F.col
BARS_X = "b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) AS n FROM bars)"


@query("s1_csv_lines", with_sql("bars", more="""
 k AS (SELECT symbol, t, CASE CAST(volume AS BIGINT) % 41 WHEN 1 THEN 'number' WHEN 2 THEN 'columns' WHEN 3 THEN 'range'
  WHEN 4 THEN 'volume' WHEN 5 THEN 'price' WHEN 6 THEN 'time' ELSE '' END AS bad FROM bars)""") + """
 SELECT symbol, count(*) AS lines, count(*) FILTER (bad = '') AS good,
 first(bad ORDER BY t) FILTER (bad <> '') AS first_bad, min(t) FILTER (bad <> '') AS first_t FROM k GROUP BY 1""")
def _(spark, d):
    """Lines of OHLCV text with planted faults: count, and the first offender per symbol."""
    k = c("volume").cast("long") % 41
    s = lambda x: c(x).cast("string")
    high = F.when(k == 1, F.lit("x")).when(k == 3, (c("low") - 1).cast("string")).otherwise(s("high"))
    vol = F.when(k == 4, F.lit("-1.0")).otherwise(s("volume"))
    line = F.concat_ws(",", F.when(k == 6, F.lit("noon")).otherwise(epoch().cast("string")),
                       F.when(k == 5, F.lit("0.0")).otherwise(s("open")), high, s("low"), s("close"),
                       F.when(k == 2, None).otherwise(vol))
    low = F.when(k == 5, F.lit(0.0))
    p = weekly(spark, d)
    lines = p.df.select("symbol", epoch().alias("place"), line.alias("line"))
    span = F.floor(c("place") / (p.step * chunk_rows(spark)))
    out = B.check_lines(lines, ["symbol"], ["place"], span)
    return out.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(c("bad").isNull()).alias("good"),
        F.min_by("bad", F.when(c("bad").isNotNull(), c("place"))).alias("first_bad"),
        F.min(F.when(c("bad").isNotNull(), c("place"))).alias("first_t"))


@query("s2_normalise_provider", with_sql("bars") + """SELECT symbol, t, close, volume FROM bars
 WHERE t >= 800000000 AND CAST(volume AS BIGINT) % 50 <> 0""")
def _(spark, d):
    """Provider rows in seconds or milliseconds by symbol, text numbers, some broken."""
    df = weekly(spark, d).df
    ms = F.length("symbol") % 2 == 0
    raw = df.select("symbol", F.when(ms, epoch() * 1000).otherwise(epoch()).cast("string").alias("Time"),
                    *[c(p).cast("string").alias(p.upper()) for p in PRICES if p != "close"],
                    F.when(c("volume").cast("long") % 50 == 0, "n/a").otherwise(c("close").cast("string")).alias("CLOSE"))
    out = B.normalise_provider(raw, ["symbol"], "time", start=F.timestamp_seconds(F.lit(800000000)))
    return out.select("symbol", epoch().alias("t"), "close", "volume")


@query("s3_ledger_table", """SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
 WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1""")
def _(spark, d):
    o = E.ledger(spark, path=d, table="orders")
    return o.where(seconds("o_orderdate") >= 820454400).groupBy(c("o_orderstatus").alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


KINDS = {"click": E.BAR_CLOSED, "purchase": E.FILL, "view": E.EVALUATE, "signup": E.INTENT}


def envelopes(spark, d):
    """Events as JSON envelopes; some are broken in known ways."""
    ev = table(spark, d, "events")
    kind = F.col("event_type")
    for k, v in KINDS.items():
        kind = F.when(c("event_type") == k, v).otherwise(kind)
    good = E.envelope_json(
        event_id=F.when(c("event_id") % 17 == 1, "").otherwise(c("event_id").cast("string")), event_type=kind,
        schema_version=F.when(c("event_id") % 17 == 2, 0).otherwise(1),
        occurred_at=F.when(c("event_id") % 17 == 3, "yesterday").otherwise(
            F.date_format(c("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        partition_key=F.concat(F.lit("user:"), c("user_id").cast("string")), producer=F.lit("clock"),
        payload=F.from_json("props", "map<string,string>"), trace_id=F.lit(""))
    return ev.select("event_id", "event_type", "user_id", F.when(
        c("event_id") % 17 == 4, F.concat(F.lit("{"), good)).otherwise(good).alias("value"))


FAULT = """CASE event_id % 17 WHEN 1 THEN 'missing event_id' WHEN 2 THEN 'schema_version' WHEN 3 THEN 'occurred_at'
 WHEN 4 THEN 'json' END"""


@query("s4_topic_route", f"""SELECT topic, count(*) AS n, count(DISTINCT user_id) AS keys FROM (SELECT user_id,
 CASE WHEN {FAULT} IS NOT NULL THEN 'runtime.dead' WHEN event_type = 'click' THEN 'market.bar.closed'
 WHEN event_type = 'purchase' THEN 'order.event' WHEN event_type = 'view' THEN 'strategy.evaluate'
 WHEN event_type = 'signup' THEN 'order.intent' ELSE 'runtime.dead' END AS topic, event_id FROM events) GROUP BY 1""")
def _(spark, d):
    out = E.route(E.decode(envelopes(spark, d)).where(F.lit(True)))
    key = F.regexp_extract("value", r'"partition_key":"user:(\d+)"', 1)
    return out.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("keys"))


@query("s5_envelope_check", f"""SELECT coalesce({FAULT}, 'ok') AS fault, count(*) AS n,
 CAST(sum(CASE WHEN {FAULT} IS NULL THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END) AS BIGINT) AS k
 FROM events GROUP BY 1""")
def _(spark, d):
    df = E.decode(envelopes(spark, d))
    k = F.when(c("fault").isNull(), F.col("e.payload")["k"].cast("long"))
    return df.groupBy(F.coalesce("fault", F.lit("ok")).alias("fault")).agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k"))


@query("s6_event_id", with_sql("hbars", more="""
 k AS (SELECT symbol, t, 'bar:sim:crypto:spot:' || symbol || ':1h:' || CAST(t // 3600 AS VARCHAR) AS name FROM hbars),
 h AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(name)) AS h FROM k)""") + """
 SELECT symbol, t, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
 substr('89ab', CAST(('0x' || substr(h, 17, 1)) AS INTEGER) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS event_id FROM h""")
def _(spark, d):
    key = E.bar_key(F.lit("Sim "), F.lit("Crypto"), F.lit("spot"), c("symbol"), F.lit("1H"))
    return hourly(spark, d).df.select("symbol", epoch().alias("t"), E.bar_event_id(
        key, F.floor(epoch() / 3600)).alias("event_id"))


@query("s7_snapshot_digest", with_sql("bars") + """SELECT symbol, sha256(sha256(string_agg(
 concat_ws(',', t * 1000000, open, high, low, close, volume), chr(10) ORDER BY t))) AS digest FROM bars GROUP BY 1""")
def _(spark, d):
    return B.snapshot_digest(weekly(spark, d))


@query("s8_upsert", """WITH u AS (SELECT l_suppkey AS supplier, l_partkey % 50 AS slot, l_extendedprice AS price,
 l_shipdate AS s, l_orderkey AS o, l_linenumber AS l, l_partkey AS p FROM lineitem)
 SELECT supplier, slot, last(price ORDER BY s, o, l, p) AS price FROM u GROUP BY 1, 2""")
def _(spark, d):
    li = table(spark, d, "lineitem")
    rows = li.select(c("l_suppkey").alias("supplier"), (c("l_partkey") % 50).alias("slot"), c("l_extendedprice").alias("price"),
                     F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey").alias("stamp"), "l_returnflag")
    old, new = rows.where("l_returnflag = 'A'"), rows.where("l_returnflag <> 'A'")
    return B.upsert(old, new, ["supplier", "slot"], "stamp").select("supplier", "slot", "price")


@query("s9_insert_absent", """SELECT count(*) AS n, CAST(sum(k) AS BIGINT) AS keys FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem
 WHERE l_linestatus = 'O' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')""")
def _(spark, d):
    li = table(spark, d, "lineitem").select(c("l_orderkey").alias("k"), "l_linestatus")
    new = B.insert_absent(li.where("l_linestatus = 'F'").select("k"), li.where("l_linestatus = 'O'").select("k"), ["k"])
    return new.agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("keys"))


@query("s10_json_results", """SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k
 FROM events WHERE event_id % 11 <> 3 AND event_id % 11 <> 5 GROUP BY 1""")
def _(spark, d):
    ev = table(spark, d, "events")
    raw = F.when(c("event_id") % 11 == 3, F.substr("props", F.lit(2))).when(c("event_id") % 11 == 5, "[1]").otherwise(c("props"))
    return E.parse_results(ev.withColumn("raw", raw), "raw", "k long").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("r.k").alias("k"))


@query("s11_merge_bars", with_sql("bars", more=BARS_X) + """SELECT symbol, t, CASE WHEN n % 3 = 0 THEN close + 1 ELSE close END AS close
 FROM b WHERE n % 3 = 0 OR n % 5 <> 0""")
def _(spark, d):
    p = weekly(spark, d).number()
    keep = ["symbol", "ts", *PRICES]
    now = p.df.where((c("pos") + 1) % 5 != 0).select(*keep)
    new = p.df.where((c("pos") + 1) % 3 == 0).withColumn("close", c("close") + 1).select(*keep)
    return B.merge_bars(now, new).select("symbol", epoch().alias("t"), "close")


@query("s12_duplicate_bars", with_sql("bars", more=BARS_X) + """SELECT symbol, count(*) AS bars,
 CAST(sum(1 + CASE WHEN n % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN n % 7 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS copies,
 count(*) FILTER (n % 7 = 0) AS conflicts FROM b GROUP BY 1""")
def _(spark, d):
    p = weekly(spark, d).number()
    keep = ["symbol", "ts", *PRICES]
    n = c("pos") + 1
    rows = p.df.select(*keep, F.explode(F.array_compact(F.array(
        F.lit(0), F.when(n % 4 == 0, 1), F.when(n % 7 == 0, 2)))).alias("copy"))
    rows = rows.withColumn("close", F.when(c("copy") == 2, c("close") + 1).otherwise(c("close")))
    return B.duplicate_bars(rows).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"), F.sum("copies").alias("copies"), F.count_if("conflict").alias("conflicts"))


@query("s13_catalog_merge", """SELECT p_partkey AS k, p_brand AS venue, CASE WHEN p_size % 3 = 0 AND p_size % 6 <> 0 THEN 'new ' || p_name
 WHEN p_size % 2 = 0 OR p_size % 3 <> 0 THEN p_name ELSE '' END AS name, p_size % 3 = 0 OR NOT coalesce(f, false) AS active FROM part
 LEFT JOIN (SELECT DISTINCT p_brand AS b, true AS f FROM part WHERE p_size % 3 = 0) ON b = p_brand WHERE p_size % 2 = 0 OR p_size % 3 = 0""")
def _(spark, d):
    """Old catalogue: even sizes. New: sizes divisible by 3, with an empty name when also even."""
    p = table(spark, d, "part").select(c("p_partkey").alias("k"), c("p_brand").alias("venue"), c("p_name").alias("name"), "p_size")
    old = p.where("p_size % 2 = 0").withColumn("active", F.lit(True))
    new = p.where("p_size % 3 = 0").withColumn(
        "name", F.when(c("p_size") % 2 == 0, "").otherwise(F.concat(F.lit("new "), "name")))
    return B.merge_catalog(old, new, ["k", "venue"], ["name"], ["venue"], sticky=["name"])
