"""Streaming forms: bar closing, fan-out, deduplication, dead letters, state per key.

The same call gives the same rows on a batch and on a stream. Most is plain DataFrame code, and windows close when the
watermark passes their end; what needs the rows of a key in order runs a two-level scan on a batch and a
processor of :mod:`tidemark.streaming.stateful` on a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.market import alert_hit, leg
from tidemark.functions.ordered import Cut, scan
from tidemark.operators.joins import fan_out, in_session
from tidemark.operators.ledger import virtual_fills
from tidemark.operators.resting import alerts_on, buys, filled_orders, met_orders
from tidemark.sources.events import bar_event_id, decode, route
from tidemark.streaming import stateful

c, lit, when = F.col, F.lit, F.when


def _mark(df: DataFrame, time: str, delay: str) -> DataFrame:
    return df.withWatermark(time, delay) if df.isStreaming else df


def close_bars(ticks: DataFrame, keys, step: str, grace: str = "1 second", tie: str = "event_id") -> DataFrame:
    """One bar per key and closed window, from ticks (ts, value, tie-break)."""
    o = F.struct("ts", tie)
    g = _mark(ticks, "ts", grace).groupBy(F.window("ts", step).alias("w"), *keys).agg(
        F.min_by("value", o).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", o).alias("close"),
        F.count(lit(1)).cast("double").alias("volume"))
    return g.select(*keys, c("w.start").alias("ts"), c("w.end").alias("closed_at"), "open", "high", "low", "close", "volume")


def bar_events(bars: DataFrame, key: Column, step: int) -> DataFrame:
    """Closed bars as events: partition key, token of the closed bar and a repeatable id."""
    token = F.floor(F.unix_seconds("ts") / step)
    return bars.select("*", key.alias("partition_key"), token.alias("token")).withColumn("event_id", bar_event_id(c("partition_key"), c("token")))


def session_bars(events: DataFrame, calendar: DataFrame) -> DataFrame:
    """Bar closes that lie inside a session (stream to static join)."""
    x = in_session(events.select("market", "event_id", "closed_at"), calendar, F.unix_seconds("closed_at"))
    return x.where("open").drop("open")


def due_batches(events: DataFrame, subscriptions: DataFrame, shards: int = 128, size: int = 250) -> DataFrame:
    """Strategies to evaluate per bar event, in shard batches."""
    return fan_out(events, subscriptions, shards, size)


def once(events: DataFrame, keys, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Each event once; on a stream the keys are remembered for the watermark delay."""
    if events.isStreaming:
        return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))
    return events.dropDuplicates(list(keys))


def valid_batches(batches: DataFrame, shards: int = 128) -> DataFrame:
    """Does a batch agree with itself: its shard, its partition key and its members."""
    members = F.forall("strategy_ids", lambda s: F.pmod(s, lit(shards)) == c("shard"))
    ok = members & (c("partition_key") == F.concat(lit("shard:"), c("shard").cast("string"))) & (F.size("strategy_ids") > 0)
    return batches.withColumn("valid", F.coalesce(ok, lit(False)))


def split_dead(df: DataFrame, attempts: str, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Good envelopes to process or retry, and the ones for the dead letter sink."""
    x = decode(df)
    dead = c("fault").isNotNull() | (c(attempts) >= most)
    return x.where(~dead), x.where(dead)


def start_router(raw: DataFrame, table: str, checkpoint: str):
    """Decode, split and append in one query; a replayed batch overwrites its own partition."""
    def write(batch: DataFrame, number: int) -> None:
        out = route(decode(batch)).withColumn("batch", lit(number))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)
    return raw.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def deltas(updates: DataFrame, key: str, order, grain: Column | Cut | None, quantity: str = "cumulative", time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Fills from cumulative quantities in ``order``: an older, smaller total adds nothing.  A stream needs the timestamp ``time``."""
    if updates.isStreaming:
        return stateful.in_order(updates.withColumn(quantity, c(quantity).cast("double")), [key], time, list(order), delay, stateful.Deltas, "filled double", quantity=quantity)
    x = scan(updates, [key], order, grain, _seen=("max", quantity, -1))
    add = F.greatest(F.coalesce(c(quantity) - F.coalesce("_seen", lit(0.0)), lit(0.0)), lit(0.0))
    return x.withColumn("filled", add).drop("_seen")


def changed(rows: DataFrame, key: str, order, grain: Column | Cut | None, fingerprint: Column, time: str = "ts", delay: str = "1 hour", initial: DataFrame | None = None) -> DataFrame:
    """Rows whose fingerprint differs from the one before of the same key.

    ``initial`` (key, mark) gives a stream the last fingerprints of a batch, as :func:`last_marks` tells them.
    """
    if rows.isStreaming:
        x = rows.withColumn("_f", fingerprint.cast("string"))
        return stateful.in_order(x, [key], time, [o for o in order if o != time], delay, stateful.Changes, "", initial).drop("_f")
    x = scan(rows.withColumn("_f", fingerprint), [key], order, grain, _was=("last", F.struct("_f"), -1))
    return x.where(c("_was").isNull() | (c("_was._f") != c("_f"))).drop("_f", "_was")


def last_marks(rows: DataFrame, key: str, order, fingerprint: Column) -> DataFrame:
    """Last fingerprint of each key, to start a stream of changes where a batch ended."""
    return rows.groupBy(key).agg(F.max_by(fingerprint.cast("string"), F.struct(*order)).alias("mark"))


def alert_hits(alerts: DataFrame, marks: DataFrame) -> DataFrame:
    """Marks (id, symbol, t, price, and ts on a stream) that reach the threshold of an alert (alert_id, symbol, kind, threshold, side, entry, size, wait)."""
    hit = alert_hit(c("kind"), c("price"), c("threshold"), c("side"), c("entry"), c("size"))
    return marks.join(alerts, "symbol").where(hit).select("alert_id", *[n for n in marks.columns], "wait")


def alert_triggers(alerts: DataFrame, marks: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Marks at which an alert goes off: once, and again after ``wait`` seconds if that is not 0."""
    if marks.isStreaming:  # the marks carry the watermark on, whether or not they hit
        x = alert_hits(alerts, stateful.marked(marks, "ts", delay)).withColumn("_wait", c("wait").cast("long"))
        return stateful.in_order(x, ["alert_id"], "ts", ["id"], None, stateful.Triggers, "").drop("_wait")
    return alerts_on(alerts, marks)


def limit_matches(orders: DataFrame, marks: DataFrame, age: int = 600, life: int = 86400, delay: str = "10 minutes", salts: int = 1) -> DataFrame:
    """Fills of resting orders (id, symbol, action, limit, rate, t) by marks (id, symbol, t, price): see ``met_orders``.

    On a stream, both have a timestamp ``ts`` as well; the orders of a busy symbol can be dealt over ``salts`` keys, each of which sees all its marks.
    """
    if not orders.isStreaming:
        return filled_orders(met_orders(orders, marks, age, life))
    none = lambda kind: lit(None).cast(kind)
    o = orders.select("symbol", F.pmod(F.xxhash64("id"), lit(salts)).alias("salt"), "ts", lit(False).alias("_mark"), c("id").cast("string").alias("id"), "action", "rate", buys().alias("buy"), c("limit").cast("double").alias("limit"), none("double").alias("price"))
    m = marks.select("symbol", F.explode(F.sequence(lit(0).cast("long"), lit(salts - 1).cast("long"))).alias("salt"), "ts", lit(True).alias("_mark"), c("id").cast("string").alias("id"), none("string").alias("action"),
                     none("double").alias("rate"), none("boolean").alias("buy"), none("double").alias("limit"), c("price").cast("double").alias("price"))
    met = stateful.in_order(o.unionByName(m), ["symbol", "salt"], "ts", ["_mark", "id"], delay, stateful.RestingOrders, "met_ms long, mark_ms long", age=age, life=life)
    return filled_orders(met).select("id", "symbol", "action", "limit", "rate", F.timestamp_millis("met_ms").alias("met_at"), F.timestamp_millis("mark_ms").alias("mark_at"), "price", "fill")


def snapshots(points: DataFrame, keys, window: str = "5 minutes", delay: str = "10 minutes", tie: str = "id") -> DataFrame:
    """Last value per key and window."""
    g = _mark(points, "ts", delay).groupBy(F.window("ts", window).alias("w"), *keys).agg(F.max_by("equity", F.struct("ts", tie)).alias("equity"))
    return g.select(*keys, c("w.start").alias("ts"), "equity")


def activity(events: DataFrame, key: str, window: str, slide: str, delay: str = "1 hour") -> DataFrame:
    """Events per key in sliding windows."""
    g = _mark(events, "ts", delay).groupBy(F.window("ts", window, slide).alias("w"), key).agg(F.count(lit(1)).alias("n"))
    return g.select(key, c("w.start").alias("ts"), "n")


def bursts(events: DataFrame, key: str, gap: str, delay: str = "1 hour") -> DataFrame:
    """Sessions of activity per key: events less than ``gap`` apart."""
    g = _mark(events, "ts", delay).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(lit(1)).alias("n"))
    return g.select(key, c("w.start").alias("ts"), c("w.end").alias("end"), "n")


def next_fill(kind: str | None, amount: float | None, price: float | None, short: bool, size: float, entry: float) -> tuple[float, float, float]:
    """Size, entry price and realised gain after one fill, with the rules of ``virtual_fills``.

    An exit without a quantity closes all; a fill of an unknown kind or without a price changes nothing.
    """
    from tidemark.functions.market import ENTRIES, EXITS
    kind, amount, price = (kind or "").strip().lower(), max(0.0, amount or 0.0), max(0.0, price or 0.0)
    if kind in ENTRIES and amount > 0 and price > 0:
        return size + amount, (size * entry + amount * price) / (size + amount), 0.0
    if kind in EXITS and size > 0 and price > 0:
        done = min(size, amount) if amount > 0 else size
        return max(0.0, size - done), entry, (entry - price if short else price - entry) * done
    return size, entry, 0.0


def positions(fills: DataFrame, keys=("strategy_id", "symbol"), order=("t", "id"), time: str = "ts", delay: str = "1 hour", cost: bool = True) -> DataFrame:
    """Average-cost position after each fill: size, entry, realized (a batch without ``cost``: size alone).  A stream needs the timestamp ``time``."""
    if not fills.isStreaming:
        return virtual_fills(fills, keys, order, cost)
    x = fills.withColumn("leg", leg(c("type"))).withColumns({n: c(n).cast("double") for n in ("amount", "price")})
    return stateful.in_order(x, [*keys, "leg"], time, list(order), delay, stateful.Positions, "size double, entry double, realized double")
