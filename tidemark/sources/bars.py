"""Reading, normalising, merging and snapshotting bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.ordered import scan
from tidemark.model import PRICES, Panel, finite
from tidemark.session import chunk_rows

HEADER = "t,open,high,low,close,volume"
MILLIS_ABOVE = 10_000_000_000


class BarError(ValueError):
    """Bars that must not be used."""


def csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of CSV files with their place: ``file``, ``block``, ``row``."""
    text = spark.read.text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), F.trim("value").alias("line"),
    ).where((F.col("line") != "") & (F.col("line") != HEADER))


def check_lines(lines: DataFrame, keys, order, grain: Column) -> DataFrame:
    """Parse OHLCV lines and say what is wrong with each (null when it is good)."""
    names = HEADER.split(",")
    parts = F.split("line", ",")
    df = lines.withColumn("_n", F.size(parts)).withColumns({
        n: F.expr(f"try_cast(trim(get(split(line, ','), {i})) AS {'bigint' if n == 't' else 'double'})")
        for i, n in enumerate(names)})
    df = scan(df, keys, order, grain, _before=("last", F.struct("t"), -1))
    c = F.col
    bad = (
        F.when(c("_n") != 6, "columns").when(c("t").isNull(), "time")
        .when(F.greatest(*[c(n).isNull() for n in names[1:]]), "number")
        .when(F.greatest(*[finite(c(n)).isNull() for n in names[1:]]) | (c("high") < c("low")), "range")
        .when((c("open") <= 0) | (c("close") <= 0), "price").when(c("volume") < 0, "volume")
        .when(c("t") <= c("_before.t"), "order"))
    return df.withColumn("bad", bad).drop("_n", "_before")


def read_bars_csv(spark: SparkSession, path: str) -> DataFrame:
    """Bars of one symbol per file; any bad line fails the load and is named."""
    lines = csv_lines(spark, path)
    span = F.struct("block", F.floor(F.col("row") / chunk_rows(spark)))
    checked = check_lines(lines, ["file"], ["block", "row"], span)
    first = checked.where("bad IS NOT NULL").agg(
        F.min_by(F.struct("file", "line", "bad"), F.struct("file", "block", "row")).alias("x")).first()["x"]
    if first is not None:
        raise BarError(f"{first['file']}: {first['bad']} in line {first['line']!r}")
    return checked.select("file", F.timestamp_seconds("t").alias("ts"), *PRICES)


def normalise_provider(df: DataFrame, keys, time: str, start=None, end=None) -> DataFrame:
    """Provider rows to bars: the time unit comes from the median, bad numbers become null."""
    df = df.toDF(*[n.strip().lower() for n in df.columns])
    c = F.col
    df = df.withColumn("_t", F.expr(f"try_cast(`{time}` AS double)"))
    above, size = F.abs("_t") > MILLIS_ABOVE, F.abs("_t")
    unit = df.groupBy(*keys).agg(
        F.count("_t").alias("n"), F.count_if(above).alias("a"),
        F.max(F.when(~above, size)).alias("low"), F.min(F.when(above, size)).alias("high"))
    unit = unit.select(*keys, F.when(c("a") * 2 == c("n"), (c("low") + c("high")) / 2 > MILLIS_ABOVE)
                       .otherwise(c("a") * 2 > c("n")).alias("_ms"))
    df = df.join(unit, list(keys))
    for name in PRICES:
        df = df.withColumn(name, F.expr(f"try_cast(`{name}` AS double)") if name in df.columns else F.lit(0.0))
    df = df.withColumn("ts", F.timestamp_seconds(F.when(c("_ms"), c("_t") / 1000.0).otherwise(c("_t"))))
    df = df.where(c("ts").isNotNull()).dropna(subset=["open", "high", "low", "close"])
    if start is not None:
        df = df.where(c("ts") >= start)
    if end is not None:
        df = df.where(c("ts") <= end)
    return df.select(*keys, "ts", *PRICES)


def merge_bars(current: DataFrame, incoming: DataFrame, keys=("symbol", "ts")) -> DataFrame:
    """Both sets of bars; on the same key the incoming row wins."""
    both = current.withColumn("_src", F.lit(0)).unionByName(incoming.withColumn("_src", F.lit(1)))
    rest = [n for n in current.columns if n not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_src").alias("r")).select(*keys, "r.*")


def upsert(current: DataFrame, incoming: DataFrame, keys, stamp: str) -> DataFrame:
    """Last write wins on the natural key, by ``stamp``."""
    both = current.unionByName(incoming)
    rest = [n for n in current.columns if n not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), stamp).alias("r")).select(*keys, "r.*")


def insert_absent(current: DataFrame, incoming: DataFrame, keys) -> DataFrame:
    """Incoming rows whose key is not there yet, each key once."""
    return incoming.join(current, list(keys), "left_anti").dropDuplicates(list(keys))


def duplicate_bars(df: DataFrame, keys=("symbol", "ts")) -> DataFrame:
    """Per bar: number of rows and whether they disagree."""
    same = F.count_distinct(F.struct(*PRICES))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("copies"), (same > 1).alias("conflict"),
        F.any_value(F.struct(*PRICES)).alias("bar"))


def collapse_duplicates(df: DataFrame, keys=("symbol", "ts")) -> DataFrame:
    """One row per bar; rows that disagree fail the job."""
    d = duplicate_bars(df, keys)
    checked = F.when(F.col("conflict"), F.raise_error(F.concat(
        F.lit("conflicting duplicate bar "), *[F.col(k).cast("string") for k in keys]))).otherwise(F.col("bar"))
    return d.select(*keys, checked.alias("bar")).select(*keys, "bar.*")


#: Part of every id: another value gives other ids.
SNAPSHOT_ROWS = 16384


def snapshot_digest(panel: Panel) -> DataFrame:
    """SHA-256 per symbol: chunks of rows, then chunks in order.

    Chunks are ``SNAPSHOT_ROWS`` steps of the bars, whatever the session's settings, so an id is of the content alone.
    """
    chunk = F.floor(F.unix_seconds("ts") / (panel.step * SNAPSHOT_ROWS))
    row = F.concat_ws(",", F.unix_micros("ts").cast("string"), *[F.col(p).cast("string") for p in PRICES])
    chunks = panel.df.groupBy(*panel.keys, chunk.alias("_b")).agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", row.alias("r")))),
                                        lambda x: x["r"]), "\n"), 256).alias("d"))
    return chunks.groupBy(*panel.keys).agg(F.sha2(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_b", "d"))), lambda x: x["d"]), "\n"), 256).alias("digest"))


def snapshot_id(panel: Panel) -> str:
    """One id for the whole set: symbols are folded by range buckets of their hash first."""
    per = snapshot_digest(panel).withColumn("_k", F.substring("digest", 1, 3))
    item = F.concat_ws("=", *[F.col(k).cast("string") for k in panel.keys], "digest")
    mid = per.groupBy("_k").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(item)), "\n"), 256).alias("d"))
    top = mid.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "d"))),
                                                  lambda x: x["d"]), "\n"), 256).alias("id"))
    return top.first()["id"]


def save_snapshot(panel: Panel, root: str) -> str:
    sid = snapshot_id(panel)
    panel.df.select(*panel.keys, "ts", *PRICES).write.mode("overwrite").parquet(f"{root}/snapshot_id={sid}")
    return sid


def load_snapshot(spark: SparkSession, root: str, sid: str, step: int) -> Panel:
    """Read a snapshot and check that its rows still give its id."""
    if len(sid) != 64 or set(sid) - set("0123456789abcdef"):
        raise BarError(f"not a snapshot id: {sid!r}")
    panel = Panel(spark.read.parquet(f"{root}/snapshot_id={sid}"), step)
    if snapshot_id(panel) != sid:
        raise BarError("snapshot content does not match its id")
    return panel


def merge_catalog(old: DataFrame, new: DataFrame, keys, texts, scope, sticky=()) -> DataFrame:
    """Refresh an instrument catalogue.

    Rows seen in ``new`` become active; unseen rows of a refreshed ``scope`` (venue) become
    inactive; an empty new text in ``sticky`` keeps the old value.
    """
    keys, scope = list(keys), list(scope)
    new = new.dropDuplicates(keys)
    fresh = new.select(*scope).distinct().withColumn("_fresh", F.lit(True))
    o = old.select(*keys, *[F.col(t).alias(f"o_{t}") for t in texts], F.col("active").alias("o_active"), F.lit(True).alias("_old"))
    n = new.select(*keys, *[F.col(t).alias(f"n_{t}") for t in texts], F.lit(True).alias("_new"))
    both = o.join(n, keys, "full").join(fresh, scope, "left")
    kept = {t: F.coalesce(F.nullif(F.col(f"n_{t}"), F.lit("")), F.col(f"o_{t}"), F.col(f"n_{t}")) if t in sticky
            else F.when(F.col("_new"), F.col(f"n_{t}")).otherwise(F.col(f"o_{t}")) for t in texts}
    active = F.when(F.col("_new"), True).when(F.col("_fresh"), False).otherwise(F.col("o_active"))
    return both.select(*keys, *[c.alias(t) for t, c in kept.items()], active.alias("active"))
