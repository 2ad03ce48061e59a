"""Row selection over bars, news and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordered import MANY, scan
from tidemark.model import Panel, epoch

c = F.col


def latest_rows(panel: Panel, n: int, before=None, after=None) -> DataFrame:
    """Bars of ``[after, before)``, the last ``n`` per symbol.

    A symbol's total comes from one small aggregate, so no task sorts a whole symbol.
    """
    df = panel.df
    if after is not None:
        df = df.where(c("ts") >= after)
    if before is not None:
        df = df.where(c("ts") < before)
    df = panel.replace(df).number().df
    size = df.groupBy(*panel.keys).agg(F.max("pos").alias("_end"))
    return df.join(size, list(panel.keys)).where(c("pos") > c("_end") - n).drop("_end", "pos")


def clean_ohlcv(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["close", "high", "low"]).withColumn("open", F.coalesce("open", "close"))


def closed_bars(df: DataFrame, step: int, now: Column) -> DataFrame:
    """Bars whose end is not after ``now``."""
    return df.where(epoch() + step <= now)


def covers_window(df: DataFrame, keys, start: int, end: int, step: int) -> DataFrame:
    """Does a series cover a window: both ends within three bars, 98 % of the rows."""
    want = max(1, (end - start) // step + 1)
    t = epoch()
    g = df.groupBy(*keys).agg(F.min(t).alias("first"), F.max(t).alias("last"), F.count(F.lit(1)).alias("rows"))
    return g.withColumn("covered", (c("first") <= start + 3 * step) & (c("last") >= end - 3 * step)
                        & (c("rows") / F.lit(want) >= 0.98))


def marker_edges(df: DataFrame, keys, order, grain: Column, value: str, dense: float = 0.18) -> DataFrame:
    """Markers that notify: sparse arrays each time, dense ones where they become active."""
    from tidemark.functions.market import active
    df = df.withColumn("_on", active(c(value)))
    share = df.groupBy(*keys).agg(F.avg(c("_on").cast("double")).alias("_share"))
    df = scan(df, keys, order, grain, _was=("last", F.struct("_on"), -1))
    df = df.join(share, list(keys))
    edge = ~F.coalesce(c("_was._on"), F.lit(False))
    return df.where(c("_on") & ((c("_share") <= dense) | edge)).drop("_on", "_was", "_share")


#: Words of an alias that the join compares.
HEAD = 3


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(text, "[^a-z0-9]+", " ")), " ")


def _heads(words: str) -> Column:
    """All runs of one to ``HEAD`` neighbouring words, which repeat; at the end of the text runs are shorter."""
    after = lambda i, n: [F.get(words, i + k) for k in range(1, n)]
    return F.flatten(F.transform(words, lambda w, i: F.array(*[F.concat_ws(" ", w, *after(i, n)) if n > 1 else w for n in range(1, HEAD + 1)])))


def relevant_news(news: DataFrame, aliases: DataFrame, text: Column, id_: str) -> DataFrame:
    """Pairs (news, asset) where an alias occurs as whole words.

    Runs of words of a text meet the first words of the aliases by equality, so many aliases that share their
    first word are no candidates. An alias of one word is found by that; others are then looked for in the text. Up to ``MANY``
    aliases are sent to the texts, of which only the pairs found are shuffled; more are joined by a shuffle of the runs.
    """
    # explode_outer, as explode would filter by the size of the runs, and in that filter the words would be made again for each run
    spark = news.sparkSession
    texts = news.select(id_, F.lower(text).alias("_text")).withColumn("_w", _words(c("_text")))
    a = aliases.select("asset", F.lower(F.trim("alias")).alias("_alias")).where(F.length("_alias") > 0).distinct()
    a = a.withColumn("_head", F.array_join(F.slice(_words(c("_alias")), 1, HEAD), " ")).where("_head <> ''")
    one = (c("_alias") == c("_head")) & ~F.contains("_alias", F.lit(" "))
    at = F.concat(F.lit("(?<![a-z0-9])\\Q"), c("_alias"), F.lit("\\E(?![a-z0-9])"))
    found = F.contains("_text", c("_alias")) & F.regexp_like("_text", at)
    some = a.limit(MANY + 1).collect()
    if len(some) <= MANY:
        heads = sorted({r["_head"] for r in some}) or [""]
        hit = texts.select(id_, "_text", F.array_intersect(_heads("_w"), F.lit(heads)).alias("_h"))
        hit = hit.select(id_, "_text", F.explode_outer("_h").alias("_head")).join(F.broadcast(spark.createDataFrame(some, a.schema)), "_head")
        return hit.where(one | found).select(id_, "asset").distinct()
    hit = texts.select(id_, F.explode_outer(_heads("_w")).alias("_head")).join(a, "_head").distinct()
    rest = hit.where(~one).join(texts.select(id_, "_text"), id_).where(found)
    return hit.where(one).select(id_, "asset").unionByName(rest.select(id_, "asset")).distinct()


def tradable(orders: DataFrame, bars: DataFrame, keys) -> DataFrame:
    return orders.join(bars, list(keys), "left")


def with_previous(panel: Panel, *cols: str) -> DataFrame:
    fr = panel.frame(1)
    return fr.own(fr.df.withColumns({f"prev_{x}": F.lag(x).over(fr.row) for x in cols}))


