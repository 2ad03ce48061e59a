"""A stream gives the rows the batch gives, over several triggers and with rows that come late."""

import os

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidemark.operators.ledger import ledger_grain, virtual_fills
from tidemark.plans.standins import trades
from tidemark.plans.streams import alerts, marks, resting
from tidemark.session import prepare
from tidemark.streaming import flows as S

FAR = 4102444800  # long after all rows: pushes the watermark past them


def run(stream, name, tmp_path, mode="append"):
    q = (stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name))
         .trigger(availableNow=True).start())
    q.awaitTermination(240)
    assert q.exception() is None
    return q


def files(folder, parts, start=0):
    """Writes frames as files that a stream reads one a trigger, in this order."""
    for k, df in enumerate(parts, start):
        df.coalesce(1).write.parquet(str(folder / f"part={k}"))
        for base, _, names in os.walk(folder / f"part={k}"):
            for n in names:
                os.utime(os.path.join(base, n), (1e9 + 10 * k, 1e9 + 10 * k))


def arrivals(df, time="t", blocks=5):
    """Blocks of time in order, but every seventh row one block late; and the delay that covers it, in seconds."""
    rows = sorted(df.collect(), key=lambda r: (r[time], repr(r)))
    block = [min(blocks - 1, i * blocks // len(rows) + (i % 7 == 3)) for i in range(len(rows))]
    parts, late, top = [], 0, None
    for b in range(blocks):
        part = [r for r, k in zip(rows, block, strict=True) if k == b]
        late = max([late, *[top - r[time] for r in part if top is not None]])
        top = max([r[time] for r in part] + ([] if top is None else [top]))
        parts.append(df.sparkSession.createDataFrame(part[::-1], df.schema))
    return parts, f"{late + 1} seconds"


def read(spark, folder, df):
    x = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "part=*"))
    return x.withColumn("ts", F.timestamp_seconds("t"))


def rows(df, cols):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())


def test_closed_bars(spark, tmp_path):
    prepare(spark)
    ev = spark.read.parquet(f"{SMALL}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("symbol"), "value")
    end = ev.limit(1).select(F.lit(-1).cast("long").alias("event_id"), F.timestamp_seconds(F.lit(FAR)).alias("ts"), F.lit("end").alias("symbol"), "value")
    files(tmp_path / "ticks", [ev, end])
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ticks/part=*"))
    run(S.close_bars(stream, ["symbol"], "1 hour"), "bars_out", tmp_path)
    assert {tuple(r) for r in spark.table("bars_out").collect()} == {tuple(r) for r in S.close_bars(ev, ["symbol"], "1 hour").collect()}


def test_positions_over_triggers(spark, tmp_path):
    """Also a close that arrives a trigger before its open."""
    prepare(spark)
    t = trades(spark, SMALL).where("strategy_id < 3").select("strategy_id", "symbol", "type", "amount", "price", "t", "id")
    odd = [(90, "X", "close_long", None, 12.0, 200, "b"), (90, "X", "open_long", 2.0, 10.0, 100, "a"), (90, "X", "add_long", 1.0, 13.0, 300, "c"), (91, "X", "open_long", None, 10.0, 100, "d"), (91, "X", "open_long", 1.0, None, 101, "e")]
    t = t.unionByName(spark.createDataFrame(odd, t.schema))
    parts, delay = arrivals(t)
    files(tmp_path / "fills", [*parts, t.limit(1).withColumns({"strategy_id": F.lit(-1).cast("long"), "t": F.lit(FAR).cast("long")})])
    run(S.positions(read(spark, tmp_path / "fills", t), delay=delay), "pos_out", tmp_path)
    cols = ["id", "size", "entry", "realized"]
    assert rows(spark.table("pos_out"), cols) == rows(virtual_fills(t), cols)


def test_deltas_over_triggers(spark, tmp_path):
    prepare(spark)
    u = trades(spark, SMALL).where("strategy_id < 4").select("symbol", "t", "id", (F.col("amount") * (1 + F.floor(F.col("t") / 86400) % 50)).alias("cumulative"))
    u = u.unionByName(spark.createDataFrame([("N", 5, "x", None), ("N", 6, "y", 3.0), ("N", 7, "z", None), ("N", 8, "zz", 2.0)], u.schema))
    parts, delay = arrivals(u)
    files(tmp_path / "upd", [*parts, u.limit(1).withColumns({"symbol": F.lit("end"), "t": F.lit(FAR).cast("long")})])
    run(S.deltas(read(spark, tmp_path / "upd", u), "symbol", ["t", "id"], ledger_grain(), delay=delay), "delta_out", tmp_path)
    cols = ["symbol", "t", "id", "filled"]
    assert rows(spark.table("delta_out"), cols) == rows(S.deltas(u, "symbol", ["t", "id"], ledger_grain()), cols)


def test_changes_restart_and_initial_state(spark, tmp_path):
    """Some rows by batch, the others by a stream that starts from its state and is stopped in between."""
    prepare(spark)
    r = spark.range(400).select((F.col("id") % 3).alias("key"), (F.col("id") * 7).alias("t"), F.col("id"), (F.xxhash64("id") % 3).alias("mark"))
    early, late = r.where("t < 700"), r.where("t >= 700")
    parts, delay = arrivals(late)
    f = F.col("mark")
    start = lambda: S.changed(read(spark, tmp_path / "sig", late), "key", ["t", "id"], None, f, delay=delay, initial=S.last_marks(early, "key", ["t", "id"], f))
    files(tmp_path / "sig", parts[:3])
    got = []
    for k in (0, 1):
        if k:
            files(tmp_path / "sig", [*parts[3:], late.limit(1).withColumns({"key": F.lit(-1).cast("long"), "t": F.lit(FAR).cast("long")})], 3)
        q = start().select("key", "t").writeStream.option("checkpointLocation", str(tmp_path / "sig_check")).foreachBatch(lambda df, n: got.extend(map(tuple, df.collect()))).trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
    want = S.changed(r, "key", ["t", "id"], F.floor(F.col("t") / 50), f).where("t >= 700")
    assert sorted(got) == rows(want, ["key", "t"])


def test_alerts_arm_again(spark, tmp_path):
    prepare(spark)
    m, a = marks(spark, SMALL), alerts(spark, SMALL)
    parts, delay = arrivals(m)
    files(tmp_path / "marks", [*parts, m.limit(1).withColumns({"t": F.lit(FAR).cast("long"), "price": F.lit(0.0)})])
    run(S.alert_triggers(a, read(spark, tmp_path / "marks", m), delay=delay), "alerts_out", tmp_path)
    want = S.alert_triggers(a, m)
    assert want.count() > 20
    assert rows(spark.table("alerts_out"), ["alert_id", "t", "id"]) == rows(want, ["alert_id", "t", "id"])


@pytest.mark.parametrize("chunk", [1, 3, 16384])
def test_alert_batch_equals_a_loop(spark, chunk):
    prepare(spark)
    hits = [(k, t, i, w) for k, w in ((1, 0), (2, 10), (3, 7), (4, 100000)) for i, t in enumerate(sorted((j * j * 31 + k) % 997 for j in range(60)))]
    hits += [(5, 10, 0, None), (5, 20, 1, None)]
    want = []
    for k in {h[0] for h in hits}:
        last = None
        for h in sorted((h for h in hits if h[0] == k), key=lambda h: (h[1], h[2])):
            if last is None or h[3] and h[1] - last >= h[3]:
                want.append(h[:3])
                last = h[1]
    df = spark.createDataFrame([*hits, (None, 5, 0, 1), (1, None, 0, 1)], "alert_id long, t long, id long, wait long")
    from tidemark.operators.resting import triggers
    assert rows(triggers(df, "alert_id", ["t", "id"], F.floor(F.col("t") / 100), chunk=chunk), ["alert_id", "t", "id"]) == sorted(want)


@pytest.mark.parametrize("block", [1, 512])
def test_alerts_make_no_pairs_with_marks(spark, block):
    """The triggers of all hits, with alerts that ask the same, odd values, and no join of alerts and marks on the symbol."""
    from tidemark.functions.market import alert_hit
    from tidemark.operators.resting import alerts_on, triggers
    prepare(spark)
    nan, kinds = float("nan"), ("price_above", "price_below", "pnl_above", "pnl_below", "other", None)
    a = [(k, "ab"[k % 2], kinds[k % 6], 10.0 * (k % 13) - 20, ("long", "short", None)[k % 3], (5.0, 20.0, 0.0, -4.0, None)[k % 5], float(k % 4), (0, 5, 90, None, -3)[k % 5]) for k in range(240)]
    a += [(300, "a", "price_above", nan, "long", 5.0, 1.0, 5), (301, "a", "pnl_above", 3.0, "long", nan, 1.0, 5), (302, None, "price_above", 1.0, "long", 5.0, 1.0, 5), (None, "a", "price_above", 1.0, "long", 5.0, 1.0, 5)]
    m = [(i, "abc"[i % 3], (i * i * 31) % 2003, (nan if i % 97 == 5 else None if i % 89 == 3 else float(i * 37 % 101) - 5)) for i in range(2000)] + [(5000, "a", None, 50.0), (5001, None, 7, 50.0)]
    a = spark.createDataFrame(a, "alert_id long, symbol string, kind string, threshold double, side string, entry double, size double, wait long")
    m = spark.createDataFrame(m, "id long, symbol string, t long, price double")
    hit = alert_hit(F.col("kind"), F.col("price"), F.col("threshold"), F.col("side"), F.col("entry"), F.col("size"))
    want = rows(triggers(m.join(a, "symbol").where(hit).select("alert_id", "id", "t", "wait"), "alert_id", ["t", "id"], F.floor(F.col("t") / 100)), ["alert_id", "t", "id"])
    got = alerts_on(a, m, block)
    assert len(want) > 500 and rows(got, ["alert_id", "t", "id"]) == want
    assert S.alert_triggers(a, m).columns == ["alert_id", "id", "symbol", "t", "price", "wait"]


@pytest.mark.parametrize("life,step", [(5, None), (300, None), (900, 40), (5000, None), (9000, 560)])
def test_orders_look_at_few_marks(spark, life, step):
    """The marks a loop finds, where a second holds many; and an order isn't put beside all marks of a span."""
    from tidemark.operators.resting import _near_marks, met_orders
    prepare(spark)
    kinds = ("open_long", "close_long", "open_short", "close_short")
    orders = [(i, "ab"[i % 2], kinds[i % 4], float(i * 13 % 60), 0.0, -3000 + i * i * 7 % 9000) for i in range(300)]
    marks = [(i, "ab"[i % 2], -3000 + i * i * 31 % 1201 * 10, float(i * 37 % 47 + 7)) for i in range(3000)]
    buy = {"open_long", "close_short"}
    meets = lambda o, p: o[3] > 0 and (p <= o[3] if o[2] in buy else p >= o[3])
    want = []
    for o in orders:
        own = sorted((m[2], m[0], m[3]) for m in marks if m[1] == o[1])
        last = [m for m in own if m[0] < o[5]][-1:]
        later = [m for m in own if o[5] <= m[0] <= o[5] + life and meets(o, m[2])]
        if last and o[5] - last[0][0] <= 8 and meets(o, last[0][2]):
            want.append((o[0], o[5], *last[0][::2]))
        elif later:
            want.append((o[0], later[0][0], *later[0][::2]))
    o = spark.createDataFrame(orders, "id long, symbol string, action string, limit double, rate double, t long")
    m = spark.createDataFrame(marks, "id long, symbol string, t long, price double")
    assert rows(met_orders(o, m, 8, life, step), ["id", "met_t", "mark_t", "price"]) == sorted(want) and want
    good = m.select("symbol", F.col("t").alias("mark_t"), F.col("id").alias("mark_id"), "price")
    pairs = _near_marks(o.select("id", "symbol", "t", "limit", F.col("action").isin(*buy).alias("buy")), good, life, step or max(life // 16, 1)).count()
    assert pairs < 40 * len(orders)


@pytest.mark.parametrize("salts", [1, 3])
def test_orders_met_over_triggers(spark, tmp_path, salts):
    prepare(spark)
    o, m = resting(spark, SMALL), marks(spark, SMALL)
    o = o.where("id % 5 < 2")
    (po, d1), (pm, d2) = arrivals(o), arrivals(m)
    delay = f"{max(int(d.split()[0]) for d in (d1, d2)) + 86400 * 7} seconds"
    files(tmp_path / "orders", [*po, o.limit(1).withColumns({"id": F.lit(-1).cast("long"), "t": F.lit(FAR).cast("long"), "limit": F.lit(0.0)})])
    files(tmp_path / "marks", [*pm, m.limit(1).withColumns({"symbol": F.lit("end"), "t": F.lit(FAR).cast("long")})])
    got = S.limit_matches(read(spark, tmp_path / "orders", o), read(spark, tmp_path / "marks", m), age=3600, life=21600, delay=delay, salts=salts)
    run(got, f"met_out_{salts}", tmp_path)
    got = spark.table(f"met_out_{salts}").select(F.col("id").cast("long").alias("id"), F.unix_seconds("met_at").alias("met_t"), F.unix_seconds("mark_at").alias("mark_t"), "price", "fill")
    want = S.limit_matches(o, m, age=3600, life=21600)
    assert want.where("mark_t < met_t").count() and want.where("mark_t = met_t").count()
    assert rows(got, ["id", "met_t", "mark_t", "price", "fill"]) == rows(want, ["id", "met_t", "mark_t", "price", "fill"])


def test_order_updates_as_they_arrive(spark, tmp_path):
    """Older totals add nothing, corrected fees and late fees do; the sums are those of the batch."""
    prepare(spark)
    from tidemark.streaming.stateful import order_updates
    kind = "order_id long, id long, t long, cumulative double, fees map<string,double>, late_fee boolean"
    up = [(1, 1, 10, 2.0, {"USDT": 0.2}, False), (1, 3, 30, 5.0, {"USDT": 0.5}, False), (1, 2, 20, 3.0, {"USDT": 0.3}, False), (1, 4, 40, 5.0, {"USDT": 0.4, "BNB": 0.01}, False),
          (1, 5, 50, 5.0, {"BNB": 0.02}, True), (2, 6, 10, None, None, False), (2, 7, 20, 1.0, None, False), (2, 8, 25, 1.0, {"USDT": 0.1}, True)]
    df = spark.createDataFrame(up, kind)
    files(tmp_path / "upd2", [df.where(F.col("id").isin(*ids)) for ids in ((1, 3), (2, 6), (4, 7), (5, 8))])
    run(order_updates(read(spark, tmp_path / "upd2", df)), "upd_out", tmp_path, "update")
    got = {r["id"]: (r["filled"], {k: round(v, 9) for k, v in r["fees"].items()}) for r in spark.table("upd_out").collect()}
    assert got == {1: (2.0, {"USDT": 0.2}), 3: (3.0, {"USDT": 0.3}), 2: (0.0, {}), 4: (0.0, {"USDT": -0.1, "BNB": 0.01}), 5: (0.0, {"BNB": 0.02}), 6: (0.0, {}), 7: (1.0, {}), 8: (0.0, {"USDT": 0.1})}
    total = S.deltas(df, "order_id", ["t", "id"], F.floor(F.col("t") / 15)).groupBy("order_id").agg(F.sum("filled").alias("filled"))
    assert rows(spark.table("upd_out").groupBy("order_id").agg(F.sum("filled").alias("filled")), ["order_id", "filled"]) == rows(total, ["order_id", "filled"])


def test_once_on_a_stream(spark, tmp_path):
    prepare(spark)
    ev = spark.read.parquet(f"{SMALL}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    ev.unionByName(ev).write.parquet(str(tmp_path / "twice"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "twice"))
    run(S.once(stream, ["event_id"]), "once_out", tmp_path)
    assert spark.table("once_out").count() == ev.count()
