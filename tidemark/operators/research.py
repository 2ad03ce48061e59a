"""Cross-sectional factor research on panels of symbols.

Everything runs on the common dates of the panel: a bar's place is the ordinal of its
date among all dates, and frames over ordinals (``rangeBetween``) see a missing bar as
missing without building the dense date x symbol table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ordered import Framed, _shared, number, plain_keys, scan
from tidemark.functions.stats import bucket_of_rank, corr0, cross_ranks, ordered_values, quantile_bin, quantile_bins, quantile_values
from tidemark.model import Panel, div, epoch
from tidemark.operators.joins import membership_flags
from tidemark.session import durable

c, lit, when = F.col, F.lit, F.when
FUNDAMENTAL = {"earnings_yield": "pe_ratio", "size": "market_cap"}


def winsorize_zscore(df: DataFrame, keys, col: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clip to quantiles, then z-score with the population deviation; flat groups give 0.

    The rows are shuffled once, by bins of their value: for the counts of the bins, the values around the quantiles, the moments and the scores.
    What is known of a group comes back to its rows by bins.
    """
    keys, probs = list(keys), {"_lo": low, "_hi": high}
    x = df.where(c(col).isNotNull())
    made = plain_keys(x, keys)
    by, at = [*made], [*made, "_b"]
    x, seen = _shared(x.withColumns({**made, "_b": F.coalesce(quantile_bin(c(col)), lit(0))}), at)  # never null, so that no join filters it
    seen = seen.alias("_seen")  # in each use of the rows, so that all use one shuffle
    bins = x.groupBy(*at).agg(F.count(lit(1)).alias("_n"), seen).where("_seen >= 0").drop("_seen")
    q = x.join(quantile_bins(bins, by, probs, "linear").drop("_n"), at).groupBy(*at, "_before", "_total", c(col).alias("_v"))
    q = ordered_values(q.agg(F.count(lit(1)).alias("_n"), seen).where("_seen >= 0").drop("_seen"), at)
    q = quantile_values(q, by, [], probs, "linear")
    x = x.join(bins.drop("_n").join(q, by), at).withColumn("_x", F.least(F.greatest(c(col), c("_lo")), c("_hi")))
    m = x.groupBy(*by).agg(F.avg("_x").alias("_m"), F.stddev_pop("_x").alias("_s"), seen).where("_seen >= 0")
    x = x.join(bins.drop("_n").join(m.drop("_seen"), by), at)
    return x.select(*df.columns, when(c("_s") > 0, (c("_x") - c("_m")) / c("_s")).otherwise(0.0).alias("zscore"))


def information_coefficient(pairs: DataFrame, keys, score: str, ret: str) -> DataFrame:
    """IC and rank IC per group, with coverage over all keys; fewer than three pairs give 0."""
    keys = list(keys)
    both = pairs.where(c(score).isNotNull() & c(ret).isNotNull())
    x = cross_ranks(cross_ranks(both, keys, score, avg="_rs"), keys, ret, avg="_rr")
    g = x.groupBy(*keys).agg(F.count(lit(1)).alias("n"), corr0(score, ret).alias("ic"), corr0("_rs", "_rr").alias("rank_ic"))
    size = pairs.groupBy(*keys).agg(F.count(lit(1)).alias("_all"))
    g = size.join(g, keys, "left")
    ok, zero = F.coalesce(c("n") >= 3, lit(False)), lit(0.0)
    return g.select(*keys, F.coalesce("n", lit(0)).alias("n"), when(ok, F.coalesce("ic", zero)).otherwise(0.0).alias("ic"),
                    when(ok, F.coalesce("rank_ic", zero)).otherwise(0.0).alias("rank_ic"), when(ok, c("n") / c("_all")).otherwise(0.0).alias("coverage"))


def quantile_returns(pairs: DataFrame, keys, score: str, ret: str, symbol: str, q: int = 5) -> DataFrame:
    keys = list(keys)
    x = cross_ranks(pairs.where(c(score).isNotNull() & c(ret).isNotNull()), keys, score, first="_r", tie=symbol, size="_n").where("_n >= 2")
    b = bucket_of_rank(c("_r"), c("_n"), F.greatest(lit(2), F.least(lit(q), c("_n"))))
    return x.groupBy(*keys, b.alias("quantile")).agg(F.avg(ret).alias("mean_return"), F.count(lit(1)).alias("count"))


def with_ordinals(panel: Panel, start: int | None = None) -> DataFrame:
    """Bars with ``ord``, the ordinal of their date among all dates of the panel.

    The dates are a small table (one row per date); ``_first`` is the ordinal of the first
    date at or after ``start``.
    """
    dates = number(panel.df.select("ts").distinct(), [], ["ts"], dates_grain(), "ord")
    if start is not None:
        first = dates.where(epoch() >= start).agg(F.min("ord").alias("_first")).withColumn("_k", lit(0))  # one row
        dates = dates.withColumn("_k", lit(0)).join(F.broadcast(first), "_k").drop("_k")
    return panel.df.join(dates, "ts")


def _at(col: str, row, k: int) -> Column:
    """Value at the date ``k`` places away, null when there is no bar."""
    return F.max(col).over(row.rangeBetween(k, k))


def factor_column(name: str, row) -> Column:
    name = name.strip().lower()
    tail = name.rsplit("_", 1)[-1]
    n = max(1, int(tail)) if tail.isdigit() else 20
    if name.startswith("momentum"):
        return div(c("close"), _at("close", row, -n)) - 1
    if name.startswith("volatility"):
        run = row.rangeBetween(-(n - 1), 0)
        return when(F.count("_ret1").over(run) == n, F.stddev_samp("_ret1").over(run))
    if name in ("reversal", "reversal_5"):
        return -(div(c("close"), _at("close", row, -5)) - 1)
    field = FUNDAMENTAL.get(name, name)
    if field == "pe_ratio":
        return when(c(field) > 0, 1.0 / c(field))
    if field == "market_cap":
        return when(c(field) > 0, F.ln(field))
    return c(field)


def research_rows(panel: Panel, factors, horizon: int, start: int, end: int, members: DataFrame | None = None) -> DataFrame:
    """Rows at rebalance dates: factor columns, forward return and membership.

    The forward return enters at the next date's open and leaves ``horizon`` dates later;
    rebalance dates are every ``horizon``-th date of the window.
    """
    names = [factors] if isinstance(factors, str) else list(factors)
    x = with_ordinals(panel, start).withColumn("pos", c("ord"))
    back = max([20] + [int(n.rsplit("_", 1)[-1]) for n in names if n.rsplit("_", 1)[-1].isdigit()]) + 1
    fr = panel.replace(x).frame(back, horizon + 1)
    row = fr.row
    df = fr.df.withColumn("_ret1", div(c("close"), _at("close", row, -1)) - 1)
    cols = {("factor" if isinstance(factors, str) else n): factor_column(n, row) for n in names}
    df = df.withColumns({**cols, "forward": div(_at("open", row, horizon + 1), _at("open", row, 1)) - 1})
    df = fr.own(df).drop("_ret1", "pos")
    t = epoch()
    df = df.where((t >= start) & (t <= end) & ((c("ord") - c("_first")) % horizon == 0)).drop("_first")
    return membership_flags(df, members, F.to_date("ts")).where("member")


def with_industry(panel: Panel) -> Panel:
    """Industry of a bar, carried forward from the last bar that named one."""
    return panel.scan(industry_=("last", "industry")) if "industry" in panel.df.columns else panel


def neutralize(rows: DataFrame, col: str, by: str = "ts", industry: str = "industry") -> DataFrame:
    """Subtract the industry mean of the date; industries of one symbol use the mean of all."""
    x = rows.withColumn("_i", F.coalesce(industry, lit("Unclassified")))
    g = x.where(c(col).isNotNull()).groupBy(by, "_i").agg(F.sum(col).alias("_s"), F.count(col).alias("_n"))
    all_ = g.groupBy(by).agg((F.sum("_s") / F.sum("_n")).alias("_all"))
    x = x.join(g, [by, "_i"], "left").join(all_, by, "left")
    return x.withColumn(col, c(col) - when(c("_n") < 2, c("_all")).otherwise(c("_s") / c("_n"))).drop("_i", "_s", "_n", "_all")


def date_sizes(rows: DataFrame) -> DataFrame:
    """Per date: symbols with a forward return and symbols with both values."""
    both = c("factor").isNotNull() & c("forward").isNotNull()
    return rows.groupBy("ts").agg(F.count("forward").alias("observed"), F.count_if(both).alias("usable"), F.count(lit(1)).alias("active"))


def group_count(rows: DataFrame, requested: int = 5) -> DataFrame:
    """One row: number of groups the median usable cross-section allows."""
    s = date_sizes(rows).where("usable >= 3")
    med = F.percentile("usable", 0.5).cast("long")
    return s.agg(F.least(lit(requested), F.greatest(lit(2).cast("long"), F.floor(med / 2))).cast("int").alias("groups"), med.alias("median"))


def ranked_sections(rows: DataFrame, requested: int = 5) -> DataFrame:
    """Usable rows of dates that qualify, with average ranks, buckets and the rank IC.

    A cross-section holds one row per symbol, so windows over the date are bounded by the
    universe whatever the history; the group count is the only value that spans dates.
    """
    day = Window.partitionBy("ts")
    both = c("factor").isNotNull() & c("forward").isNotNull()
    x = rows.join(F.broadcast(group_count(rows, requested)))
    x = x.withColumns({"active": F.count(lit(1)).over(day), "observed": F.count("forward").over(day), "usable": F.count_if(both).over(day)})
    x = x.where(both & (c("active") >= 3) & (c("observed") >= 3) & (c("usable") >= F.greatest(lit(3), c("groups"))))
    average = lambda col: F.rank().over(day.orderBy(col)) + (F.count(lit(1)).over(day.orderBy(col).rangeBetween(0, 0)) - 1) / 2.0
    x = x.withColumns({"rank_f": average("factor"), "rank_r": average("forward"), "_first": F.row_number().over(day.orderBy("factor", "symbol"))})
    flat = (F.min("factor").over(day) == F.max("factor").over(day)) | (F.min("forward").over(day) == F.max("forward").over(day))
    x = x.withColumn("ic", when(~flat, F.corr("rank_f", "rank_r").over(day))).where("ic IS NOT NULL")
    x = x.withColumn("grp", bucket_of_rank(c("_first"), c("usable"), c("groups"))).drop("_first")
    return durable(x)


def ic_series(sections: DataFrame, window: int = 20, least: int = 5) -> DataFrame:
    """Rank IC per date with its rolling mean (one row per date)."""
    s = sections.groupBy("ts").agg(F.max("ic").alias("ic"))
    fr = Framed(s, [], ["ts"], dates_grain(), back=window - 1)
    run = fr.w(window)
    s = fr.own(fr.df.withColumn("rolling", when(F.count("ic").over(run) >= least, F.avg("ic").over(run))))
    total = sections.agg(F.count_distinct("ts").alias("dates")).withColumn("_k", lit(0))
    return s.withColumn("_k", lit(0)).join(F.broadcast(total), "_k").drop("_k")  # one row


def dates_grain() -> Column:
    """Chunks of an axis of dates without a key: a task sees the dates of a year, and one row a year is carried on."""
    return F.year("ts")


def ic_summary(sections: DataFrame, horizon: int, periods: float = 252.0) -> DataFrame:
    """Mean IC, annualised ICIR, positive rate and the means of both halves."""
    early = c("pos") < F.greatest(lit(1), F.floor(c("dates") / 2))
    g = ic_series(sections).agg(
        F.count(lit(1)).alias("dates"), F.avg("ic").alias("rank_ic"), F.stddev_samp("ic").alias("_s"), F.avg(when(c("ic") > 0, 1.0).otherwise(0.0)).alias("positive_rate"),
        F.coalesce(F.avg(when(early, c("ic"))), lit(0.0)).alias("first_half"), F.coalesce(F.avg(when(~early, c("ic"))), lit(0.0)).alias("second_half"))
    return g.withColumn("icir", when(c("_s") > 0, c("rank_ic") / c("_s") * math.sqrt(max(1.0, periods) / horizon)).otherwise(0.0)).drop("_s")


def used_ordinals(sections: DataFrame) -> DataFrame:
    """Ordinal of each used date (one row per date)."""
    return number(sections.select("ts").distinct(), [], ["ts"], dates_grain(), "used")


def rank_autocorrelation(sections: DataFrame) -> DataFrame:
    """Correlation of a date's factor ranks with those of the date used before, on common symbols.

    A symbol's rows here are its rebalance dates, few enough for one window.
    """
    w = Window.partitionBy("symbol").orderBy("used")
    x = sections.select("ts", "symbol", (c("rank_f") / c("usable")).alias("r")).join(used_ordinals(sections), "ts")
    x = x.withColumns({"p": F.lag("r").over(w), "_was": F.lag("used").over(w)}).where(c("_was") == c("used") - 1)
    day = Window.partitionBy("used")
    average = lambda col: F.rank().over(day.orderBy(col)) + (F.count(lit(1)).over(day.orderBy(col).rangeBetween(0, 0)) - 1) / 2.0
    x = x.withColumns({"_a": average("r"), "_b": average("p")})
    g = x.groupBy("used").agg(F.count(lit(1)).alias("n"), corr0("_a", "_b").alias("autocorr"))
    return g.where("n >= 3 AND autocorr IS NOT NULL")


def group_returns(sections: DataFrame, cost_rate: float) -> DataFrame:
    """Gross and net return, turnover and cost per group and date (first formation costs once).

    One row per date and group carries its member list (bounded by the universe), so the
    turnover against the rebalance before is a lag and two array sizes.
    """
    g = sections.groupBy("ts", "grp").agg(F.count(lit(1)).alias("members"), F.avg("forward").alias("gross"), F.collect_list("symbol").alias("_m"))
    w = Window.partitionBy("grp").orderBy("ts")
    g = g.withColumns({"_p": F.lag("_m").over(w), "used": (F.row_number().over(w) - 1).cast("long")})
    kept = F.size(F.array_intersect("_m", "_p"))
    new, old = 1.0 / F.size("_m"), 1.0 / F.size("_p")
    turn = 0.5 * ((F.size("_m") - kept) * new + (F.size("_p") - kept) * old + kept * F.abs(new - old))
    initial = c("_p").isNull()
    g = g.withColumn("turnover", when(initial, 1.0).otherwise(turn))
    g = g.withColumn("cost", c("turnover") * when(initial, 1.0).otherwise(2.0) * cost_rate)
    return g.select("ts", "used", "grp", "members", "gross", (c("gross") - c("cost")).alias("net"), "turnover", "cost", initial.alias("initial"))


def group_members(sections: DataFrame) -> DataFrame:
    """Members of each group, as rows sorted by date, group and symbol."""
    return sections.select("ts", "grp", "symbol")


def monotonicity(groups: DataFrame) -> DataFrame:
    """Rank correlation of group number and group return per date (three groups or more)."""
    day = Window.partitionBy("ts")
    rank = F.rank().over(day.orderBy("gross")) + (F.count(lit(1)).over(day.orderBy("gross").rangeBetween(0, 0)) - 1) / 2.0
    g = groups.withColumn("_r", rank).groupBy("ts").agg(F.count(lit(1)).alias("_n"), corr0("_r", "grp").alias("monotonicity"))
    return g.where("_n >= 3 AND monotonicity IS NOT NULL").drop("_n")


def nav_curves(groups: DataFrame) -> DataFrame:
    """Gross and net value of one unit per group (rows are dates times groups)."""
    w = Window.partitionBy("grp").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return groups.withColumns({"nav_gross": F.product(1.0 + c("gross")).over(w), "nav_net": F.product(1.0 + c("net")).over(w)})


def long_short(groups: DataFrame) -> DataFrame:
    """Top group less bottom group on common dates, both costs charged."""
    top = groups.groupBy("ts").agg(F.max_by(F.struct("gross", "cost"), "grp").alias("h"), F.min_by(F.struct("gross", "cost"), "grp").alias("l"), F.count(lit(1)).alias("_n"))
    x = top.where("_n >= 2").select("ts", (c("h.gross") - c("l.gross")).alias("gross"), (c("h.cost") + c("l.cost")).alias("cost"))
    return scan(x, [], ["ts"], dates_grain(), nav_gross=("product", 1.0 + c("gross")), nav_net=("product", 1.0 + c("gross") - c("cost")))


def coverage_summary(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Share of observations with a factor, and turnover without the first formation."""
    s = date_sizes(rows).where("active >= 3 AND observed >= 3").agg(F.sum("usable").alias("_v"), F.sum("observed").alias("_t"))
    t = groups.agg(F.coalesce(F.avg(when(~c("initial"), c("turnover"))), lit(0.0)).alias("turnover"))
    cov = F.coalesce(div(c("_v"), c("_t")), lit(0.0))
    return s.join(F.broadcast(t)).select(cov.alias("coverage"), (1.0 - cov).alias("missing_rate"), "turnover")


def factor_correlation(rows: DataFrame, names) -> DataFrame:
    """Mean rank correlation of factor pairs over dates, on pairwise complete symbols.

    Pairs come from an array of the row's factors, not from a join of the factor table. A pair's cross-section holds one row per symbol
    and is ranked by plain windows, as in :func:`ranked_sections`: the rows are made and shuffled once.
    """
    names = list(names)
    pairs = [F.struct(lit(a).alias("a"), lit(b).alias("b"), c(a).alias("x"), c(b).alias("y")) for i, a in enumerate(names) for b in names[i:]]
    long = rows.select("ts", F.explode(F.array(*pairs)).alias("p")).select("ts", "p.*").where(c("x").isNotNull() & c("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    keys = ["ts", "a", "b"]
    day = Window.partitionBy(*keys)
    average = lambda col: F.rank().over(day.orderBy(col)) + (F.count(lit(1)).over(day.orderBy(col).rangeBetween(0, 0)) - 1) / 2.0
    x = long.withColumns({"_x": average("x"), "_y": average("y")})
    per = x.groupBy(*keys).agg(F.count(lit(1)).alias("_n"), corr0("_x", "_y").alias("_c")).where("_n >= 3 AND _c IS NOT NULL")
    m = per.groupBy("a", "b").agg(F.avg("_c").alias("correlation"), F.count(lit(1)).alias("observations"))
    return m.unionByName(m.where("a <> b").select(c("b").alias("a"), c("a").alias("b"), "correlation", "observations"))


def sample_diagnostics(sections: DataFrame, requested: int = 5) -> DataFrame:
    """Median and smallest cross-section, members per group, warnings and a quality label."""
    d = sections.groupBy("ts").agg(F.max("usable").alias("n"), F.max("groups").alias("groups"))
    g = d.agg(F.count(lit(1)).alias("dates"), F.percentile("n", 0.5).cast("long").alias("median_size"), F.min("n").alias("minimum_size"), F.max("groups").alias("groups"))
    g = g.withColumn("per_group", c("median_size") / c("groups"))
    warn = F.array_compact(F.array(when(c("groups") < requested, "groupsReduced"), when(c("per_group") < 5, "smallCrossSection"), when(c("dates") < 30, "fewObservations")))
    q = when((c("per_group") >= 5) & (c("dates") >= 30), "robust").when((c("per_group") >= 3) & (c("dates") >= 12), "limited").otherwise("insufficient")
    return g.withColumns({"warnings": warn, "quality": q})
