"""Time joins and ledger joins.

As-of joins are a union and a running "last" in two levels (``functions.ordered.scan``):
no range condition, no candidate pairs, and a key with a third of the rows is spread over
its time chunks.  The whole right row is carried as a struct, so a null field of the
newest row stays null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordered import Cut, scan

c = F.col
DAY = 86400


def asof(left: DataFrame, right: DataFrame, on, left_time: Column, right_time: Column, span: int,
         cols, name: str, tie=(), equal: bool = True, forward: bool = False, bounded: bool = False) -> DataFrame:
    """Attach to each left row the last right row not after it, as struct ``name``.

    Times are epoch seconds; ``span`` is the length of a time chunk; ``tie`` orders right
    rows of the same time (the last wins); ``equal=False`` asks for strictly earlier rows;
    ``forward`` looks for the first row not before the left row instead; ``bounded`` says that no key has
    more rows in a span than a chunk holds (bars, reports), so that they needn't be counted.  Every left row
    stays: one without a time or with a null key finds nothing.
    """
    on, tie = list(on), list(tie)
    sign = -1 if forward else 1
    right_first = equal
    ties = [c(t).alias(f"_k{i}") for i, t in enumerate(tie)]
    keys = [c(k).alias(f"_on{i}") for i, k in enumerate(on)]
    r = right.select(*keys, (right_time * sign).alias("_t"), F.lit(0 if right_first else 1).alias("_s"), *ties,
                     F.when(right_time.isNotNull(), F.struct(*cols)).alias(name))
    blank = [F.lit(None).cast(right.schema[t].dataType).alias(f"_k{i}") for i, t in enumerate(tie)]
    lt = left.withColumn("_t", left_time * sign)
    lo = lt.select(*keys, "_t", F.lit(1 if right_first else 0).alias("_s"), *blank, F.struct(*left.columns).alias("_l"))
    both = r.unionByName(lo, allowMissingColumns=True).withColumn("_at", F.coalesce("_t", F.lit(0)))
    names = [f"_on{i}" for i in range(len(on))]
    order = ["_t", "_s", *[f"_k{i}" for i in range(len(tie))]]
    out = scan(both, names, order, F.floor(c("_at") / span) if bounded else Cut("_at", span), _found=("last", c(name)))
    known = c("_t").isNotNull()
    for k in names:
        known = known & c(k).isNotNull()
    return out.where("_l IS NOT NULL").select("_l.*", F.when(known, c("_found")).alias(name))


def member_intervals(members: DataFrame) -> DataFrame:
    """All intervals of a symbol in one array (a symbol has few)."""
    return members.groupBy("symbol").agg(F.collect_list(F.struct("valid_from", "valid_to")).alias("_spans"))


def _inside(day: Column, m: Column) -> Column:
    return (m["valid_from"].isNull() | (m["valid_from"] <= day)) & (m["valid_to"].isNull() | (day < m["valid_to"]))


def active_members(rows: DataFrame, members: DataFrame, day: Column) -> DataFrame:
    """Rows whose symbol is a member on ``day`` (half-open intervals)."""
    return rows.withColumn("_d", day).join(member_intervals(members), "symbol").where(
        F.exists("_spans", lambda m: _inside(c("_d"), m))).drop("_d", "_spans")


def membership_flags(rows: DataFrame, members: DataFrame | None, day: Column) -> DataFrame:
    """Flag per row: no list at all means always; listed without dates always; unlisted never."""
    if members is None:
        return rows.withColumn("member", F.lit(True))
    out = rows.withColumn("_d", day).join(member_intervals(members), "symbol", "left")
    hit = F.exists("_spans", lambda m: _inside(c("_d"), m))
    return out.withColumn("member", F.coalesce(hit, F.lit(False))).drop("_d", "_spans")


def boundary_rows(df: DataFrame, key: str, time: str, start: int, end: int, order, cols) -> DataFrame:
    """Last row at or before ``start`` and first row in ``[start, end)`` of each key."""
    row, stamp = F.struct(*cols), F.struct(*order)
    t = c(time)
    return df.where(t < end).groupBy(key).agg(
        F.max_by(row, F.when(t <= start, stamp)).alias("before"), F.min_by(row, F.when(t >= start, stamp)).alias("after"))


def opening_equity(boundary: DataFrame, rebuilt: DataFrame, key: str, start: int, tolerance: int = 900) -> DataFrame:
    """Nearest snapshot to the day start; exact within ``tolerance`` seconds; else the rebuilt value."""
    df = rebuilt.join(boundary, key, "left")
    gap = lambda s: F.abs(c(f"{s}.t") - start)
    early = c("before").isNotNull() & (c("after").isNull() | (gap("before") <= gap("after")))
    chosen = F.when(early, c("before")).otherwise(c("after"))
    none = c("before").isNull() & c("after").isNull()
    return df.withColumn("_row", chosen).select(
        *[n for n in rebuilt.columns if n != "rebuilt"],
        F.coalesce("_row.equity", "rebuilt").alias("opening"),
        F.coalesce(F.abs(c("_row.t") - start) > tolerance, F.lit(True)).alias("estimated"),
        F.when(none, "ledger_reconstruction").when(early, "snapshot_before").otherwise("snapshot_after").alias("source"))


def availability(periods: DataFrame, earnings: DataFrame, today: Column, span: int) -> DataFrame:
    """When a report became usable: the day after its announcement within 120 days, else 91 days later."""
    secs = lambda x: F.unix_date(c(x)).cast("long") * DAY
    out = asof(periods, earnings, ["symbol"], secs("period_end"), secs("announced"), span, ["announced"], "_e",
               equal=False, forward=True)
    near = c("_e.announced") <= F.date_add("period_end", 120)
    late = F.date_add("period_end", 91)
    return out.select(
        *periods.columns,
        F.when(near, F.date_add(c("_e.announced"), 1)).when(late <= today, late).otherwise(today).alias("available_at"),
        F.when(near, "reported_earnings_date").when(late <= today, "conservative_91_day_lag")
        .otherwise("observed_at_sync").alias("basis"))


def common_curve(a: DataFrame, b: DataFrame, time: str = "t", order: str = "seq") -> DataFrame:
    """Two level curves on their common times: invalid levels dropped, last duplicate kept."""
    def levels(df, name):
        ok = c("value").isNotNull() & ~F.isnan("value") & (c("value") > 0) & (c("value") < float("inf"))
        return df.where(ok).groupBy(time).agg(F.max_by("value", order).alias(name))
    return levels(a, "portfolio").join(levels(b, "benchmark"), time)


def full_pairs(scores: DataFrame, returns: DataFrame, by) -> DataFrame:
    """Scores and forward returns on the union of their keys."""
    return scores.join(returns, list(by), "full")


def allocate(payments: DataFrame, positions: DataFrame, fallback: Column) -> DataFrame:
    """Split each payment over the owners of the symbol by open size; else to the fallback owner.

    Owner shares are computed once per symbol, so no window spans the payments.
    """
    own = positions.where(F.abs("size") > 0).groupBy("symbol", "strategy_id").agg(F.sum(F.abs("size")).alias("q"))
    total = own.groupBy("symbol").agg(F.sum("q").alias("_total"))
    shares = own.join(total, "symbol").select("symbol", c("strategy_id").alias("owner"), (c("q") / c("_total")).alias("ratio"))
    out = payments.join(shares, "symbol", "left").withColumns({
        "owner": F.coalesce("owner", fallback), "ratio": F.coalesce("ratio", F.lit(1.0))})
    return out.where(c("owner").isNotNull()).withColumn("paid", c("amount") * c("ratio"))


def coverage(members: DataFrame, reports: DataFrame, fields, as_of: Column, stale_after: int = 200) -> DataFrame:
    """State of each member's newest visible report: no_data, stale, partial or ready."""
    latest = reports.where(c("available_at") <= as_of).groupBy("symbol").agg(
        F.max_by(F.struct("period_end", *fields), F.struct("available_at", "period_end")).alias("r"))
    df = members.join(latest, "symbol", "left")
    bad = [F.when(c(f"r.{f}").isNull() | F.isnan(c(f"r.{f}"))
                  | ((c(f"r.{f}") <= 0) if f in ("market_cap", "shares") else F.lit(False)), F.lit(f)) for f in fields]
    missing = F.array_compact(F.array(*bad))
    age = F.datediff(as_of, c("r.period_end"))
    state = (F.when(c("r").isNull(), "no_data").when(age > stale_after, "stale")
             .when(F.size(missing) > 0, "partial").otherwise("ready"))
    return df.select(*members.columns, missing.alias("missing"), age.alias("age_days"), state.alias("state"))


def in_session(rows: DataFrame, calendar: DataFrame, time: Column) -> DataFrame:
    """Does a boundary close a bar inside a session and outside its break?"""
    cal = calendar.select("market", c("day").alias("_day"), "opens", "closes", "break_start", "break_end")
    df = rows.withColumn("_at", time).withColumn("_day", F.floor(c("_at") / DAY))
    df = df.join(cal, ["market", "_day"], "left")
    ok = (c("opens") < c("_at")) & (c("_at") <= c("closes"))
    rest = F.coalesce((c("break_start") < c("_at")) & (c("_at") <= c("break_end")), F.lit(False))
    return df.withColumn("open", F.coalesce(ok & ~rest, F.lit(False))).select(*rows.columns, "open")


def consecutive_sessions(pairs: DataFrame, calendar: DataFrame, start: str, end: str) -> DataFrame:
    """Are the days of two times neighbouring sessions of the market?"""
    cal = calendar.select("market", "day", "ordinal")
    a = cal.select("market", c("day").alias("_a"), c("ordinal").alias("_na"))
    b = cal.select("market", c("day").alias("_b"), c("ordinal").alias("_nb"))
    df = pairs.withColumns({"_a": F.floor(c(start) / DAY), "_b": F.floor(c(end) / DAY)})
    df = df.join(a, ["market", "_a"], "left").join(b, ["market", "_b"], "left")
    return df.withColumn("consecutive", F.coalesce(c("_nb") - c("_na") == 1, F.lit(False))).select(*pairs.columns, "consecutive")


def fan_out(events: DataFrame, subscriptions: DataFrame, shards: int = 128, size: int = 250) -> DataFrame:
    """Strategies due for each bar event, in batches of at most ``size`` per shard.

    Positions inside a shard come from the subscription table once (per key and shard),
    not from the joined rows.  Few keys hold all batches, so the batches of a key are dealt over
    spots, and an event goes to the spots that hold batches of its key.
    """
    from tidemark.functions.ordered import number
    subs = subscriptions.where("status = 'running'").dropDuplicates(["partition_key", "strategy_id"])
    subs = subs.withColumn("shard", F.pmod("strategy_id", F.lit(shards)))
    subs = number(subs, ["partition_key", "shard"], ["strategy_id"], F.floor(c("strategy_id") / (shards * 10000)))
    batches = subs.withColumn("batch", F.floor(c("pos") / size)).groupBy("partition_key", "shard", "batch").agg(
        F.array_sort(F.collect_list("strategy_id")).alias("strategy_ids"))
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # said, lest small rows be put into one task
    batches = batches.withColumn("_spot", F.pmod(F.hash("shard", "batch"), F.lit(parts)))
    spots = batches.select("partition_key", "_spot").distinct()
    by = ["partition_key", "_spot"]
    return events.join(spots, "partition_key").repartition(parts, *by).join(batches.repartition(parts, *by), by).drop("_spot")
