"""State per key on a stream, in order of event time.

A processor here holds the rows of a key until the watermark passes them and then takes them in order of time and tie, so
a stream gives the rows of its batch form whatever the order of arrival inside the watermark delay; Spark drops what comes later
than that. State is what one key needs between two rows: a position, a running maximum, a fingerprint, a last trigger. A
timer per key wakes it when its earliest held row is due, others take away state that can no longer matter.

``transformWithState`` keeps its state in RocksDB, so a key's state isn't bound by the memory of a task; a release reads what one key
holds between two watermarks.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Rows of a key in order of ``_ms`` and ``tie``; subclasses make the output of each row in :meth:`step`."""

    state: str | None = None  # DDL of what is kept between rows

    def __init__(self, held: T.StructType, keys: list[str], tie: list[str], out: T.StructType):
        self.held_type, self.keys, self.tie, self.out = held, keys, tie, out

    def told(self, key, row: Row, **more) -> Row:
        """The output row: keys, columns of the row, and what the processor adds."""
        own = {**row.asDict(), **dict(zip(self.keys, key, strict=True)), **more}
        return Row(*self.out.names)(*[own[n] for n in self.out.names])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.held_type)
        self.due = handle.getValueState("due", "ms long")
        self.kept = handle.getValueState("kept", self.state) if self.state else None
        self.more()

    def more(self) -> None:
        """Further state variables."""

    def step(self, key, row: Row) -> Iterator[Row]:
        raise NotImplementedError

    def overdue(self, key, ms: int) -> None:
        """Takes away state that no row after ``ms`` needs; all rows before are done."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first, part = None, []
        for row in rows:
            part.append(tuple(row[n] for n in self.held_type.names))
            first = row["_ms"] if first is None else min(first, row["_ms"])
            if len(part) == 1000:
                self.held.appendList(part)
                part = []
        if part:
            self.held.appendList(part)
        if first is not None:
            self._wake(first)
        return iter(())

    def _wake(self, ms: int) -> None:
        due = self.due.get()[0] if self.due.exists() else None
        if due is None or ms < due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(ms)
            self.due.update((ms,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, fired = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        if self.due.exists() and fired >= self.due.get()[0]:
            yield from self._release(key, now)
        self.overdue(key, fired)

    def _release(self, key, now: int) -> Iterator[Row]:
        make = Row(*self.held_type.names)
        ready, wait = [], []
        for row in self.held.get():
            (ready if row[0] <= now else wait).append(row)
        if wait:
            self.held.put(wait)
        else:
            self.held.clear()
        self.due.clear()
        if wait:
            self._wake(min(row[0] for row in wait))
        ready = [make(*row) for row in ready]
        ready.sort(key=lambda r: (r["_ms"], *[(r[t] is not None, r[t]) for t in self.tie]))
        for row in ready:
            yield from self.step(key, row)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.kept.update(tuple(initialState[part.split()[0]] for part in self.state.split(",")))


def marked(rows: DataFrame, time: str, delay: str) -> DataFrame:
    """Rows with a watermark; a row without a time can't be placed and fails the job, as in the batch forms."""
    there = F.when(F.col(time).isNotNull(), F.col(time)).otherwise(F.raise_error(F.lit(f"a row has no place in its stream: null in {time}")))
    return rows.withColumn(time, there).withWatermark(time, delay)


def in_order(rows: DataFrame, keys: list[str], time: str, tie: list[str], delay: str | None, processor, out: str, initial: DataFrame | None = None, **how) -> DataFrame:
    """Runs a processor over a stream of rows with a timestamp column ``time``; ``out`` (DDL) is what it adds to keys and row.

    ``delay`` is None where the rows have a watermark already. ``initial`` holds the keys and the processor's state for keys that a
    batch has seen before.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    x = (marked(rows, time, delay) if delay else rows).withColumn("_ms", F.unix_millis(time))
    own = [f for f in x.schema.fields if f.name not in (*keys, time, "_ms")]
    told = T.StructType([x.schema[k] for k in keys] + own + T.StructType.fromDDL(out).fields)
    p = processor(T.StructType([x.schema["_ms"], *own]), keys, tie, told, **how)
    return x.groupBy(*keys).transformWithState(p, told, "append", "EventTime", initial.groupBy(*keys) if initial is not None else None)


class Positions(InOrder):
    """Average-cost position after each fill: size, entry, realized."""

    state = "size double, entry double"

    def step(self, key, row):
        from tidemark.streaming.flows import next_fill
        size, entry = self.kept.get() if self.kept.exists() else (0.0, 0.0)
        size, entry, gain = next_fill(row["type"], row["amount"], row["price"], key[-1] == "short", size, entry)
        self.kept.update((size, entry))
        yield self.told(key, row, size=size, entry=entry, realized=gain)


class Deltas(InOrder):
    """``filled``: what each cumulative total adds to the largest one before."""

    state = "seen double"

    def __init__(self, *where, quantity: str):
        super().__init__(*where)
        self.quantity = quantity

    def step(self, key, row):
        seen = self.kept.get()[0] if self.kept.exists() else 0.0
        total = row[self.quantity]
        if total is not None and (not self.kept.exists() or total > seen):
            self.kept.update((total,))
        yield self.told(key, row, filled=0.0 if total is None else max(total - seen, 0.0))


class Changes(InOrder):
    """Rows whose fingerprint (column ``_f``) differs from the one before."""

    state = "mark string"

    def step(self, key, row):
        first, was = not self.kept.exists(), self.kept.get()
        self.kept.update((row["_f"],))
        if first or None not in (was[0], row["_f"]) and was[0] != row["_f"]:
            yield self.told(key, row)


class Triggers(InOrder):
    """Hits that trigger: the first, and the first of each time that ``_wait`` seconds (0: never again) have passed since the last."""

    state = "last long, wait long"

    def step(self, key, row):
        last = self.kept.get()[0] if self.kept.exists() else None
        wait = 1000 * max(0, row["_wait"] or 0)
        if last is None or wait and row["_ms"] - last >= wait:
            self.kept.update((row["_ms"], wait))
            if wait:
                self.handle.registerTimer(row["_ms"] + wait)
            yield self.told(key, row)

    def overdue(self, key, ms):
        if self.kept.exists() and self.kept.get()[1] and sum(self.kept.get()) <= ms:
            self.kept.clear()  # armed again


class RestingOrders(InOrder):
    """Orders (``_mark`` false) and marks of a symbol: the mark that each order meets first.

    An order meets the last mark before it if that is at most ``age`` seconds old, else the first later one up to ``life`` seconds on.
    """

    def __init__(self, *where, age: int, life: int):
        super().__init__(*where)
        self.age, self.life = 1000 * age, 1000 * life

    def more(self):
        self.last = self.handle.getValueState("last", "ms long, price double")
        self.open = self.handle.getMapState("open", "id string", "buy boolean, edge double, ms long, action string, rate double")

    def _meets(self, buy, edge, price):
        return price > 0 and edge is not None and edge > 0 and (price <= edge if buy else price >= edge)

    def step(self, key, row):
        if not row["_mark"]:
            ms, price = self.last.get() if self.last.exists() else (None, None)
            if ms is not None and row["_ms"] - ms <= self.age and self._meets(row["buy"], row["limit"], price):
                yield self.told(key, row, met_ms=row["_ms"], mark_ms=ms, price=price)
            elif row["limit"] is not None and row["limit"] > 0:
                self.open.updateValue((row["id"],), (row["buy"], row["limit"], row["_ms"], row["action"], row["rate"]))
                self.handle.registerTimer(row["_ms"] + self.life + 1)
            return
        if row["price"] is None or row["price"] <= 0:
            return
        self.last.update((row["_ms"], row["price"]))
        for (number,), (buy, edge, ms, action, rate) in list(self.open.iterator()):
            late = row["_ms"] - ms > self.life
            if late or self._meets(buy, edge, row["price"]):
                self.open.removeKey((number,))
                if not late:
                    yield self.told(key, row, id=number, met_ms=row["_ms"], mark_ms=row["_ms"], limit=edge, action=action, rate=rate)

    def overdue(self, key, ms):
        for (number,), order in list(self.open.iterator()):
            if order[2] + self.life < ms:
                self.open.removeKey((number,))


class Updates(StatefulProcessor):
    """Cumulative updates of an order as they arrive: what each adds to quantity and fees.

    A total below the largest one seen adds nothing, neither quantity nor fees; cumulative fees correct those booked before (up or down), a
    fee that comes by itself (``late_fee``) is added without a fill. State goes ``ttl`` after its last update.
    """

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle):
        self.total = handle.getValueState("total", "quantity double", self.ttl)
        self.booked = handle.getMapState("booked", "ccy string", "amount double", self.ttl)

    def handleInputRows(self, key, rows, timerValues):
        for row in rows:
            seen = self.total.get()[0] if self.total.exists() else 0.0
            now, fees = row["cumulative"] or 0.0, {k: v or 0.0 for k, v in dict(row["fees"] or {}).items()}
            filled = max(now - seen, 0.0)
            add = {}
            if row["late_fee"]:
                add = fees
            elif now + 1e-12 >= seen:
                had = {k: v for (k,), (v,) in self.booked.iterator()}
                add = {k: fees.get(k, 0.0) - had.get(k, 0.0) for k in {*fees, *had}}
            if filled or not self.total.exists():
                self.total.update((max(now, seen),))
            for k, v in add.items():
                was = self.booked.getValue((k,))[0] if self.booked.containsKey((k,)) else 0.0
                self.booked.updateValue((k,), (was + v,))
            yield Row("order_id", "id", "filled", "fees")(key[0], row["id"], filled, {k: v for k, v in add.items() if abs(v) > 1e-12})


def order_updates(updates: DataFrame, ttl: int = 7 * 86400) -> DataFrame:
    """order_id, id, filled, fees of a stream of (order_id, id, cumulative, fees, late_fee), in the order of arrival, without waiting for a watermark."""
    updates.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    kind = updates.schema["order_id"].dataType.simpleString()
    return updates.groupBy("order_id").transformWithState(
        Updates(1000 * ttl), f"order_id {kind}, id {updates.schema['id'].dataType.simpleString()}, filled double, fees map<string,double>", "update", "ProcessingTime")
