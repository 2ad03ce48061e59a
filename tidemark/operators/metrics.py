"""Backtest metrics, robustness statistics and decision quality."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ordered import Cut, cut_once, path, scan
from tidemark.functions.stats import EULER_GAMMA, normal_cdf, normal_ppf, quantiles, sigmoid
from tidemark.model import div
from tidemark.operators.ledger import ledger_grain, longest_run

c, lit, when = F.col, F.lit, F.when
DIST = {"median": 0.5, "p5": 0.05, "p25": 0.25, "p75": 0.75, "p95": 0.95}


def result_metrics(curve: DataFrame, keys, time: str, value: str, initial: Column, grain: Column, ppy: float) -> DataFrame:
    """Return, drawdown with its peak and trough, Sharpe and annualised figures of value curves."""
    x = curve.withColumn("_i", initial)
    x = scan(x, keys, [time], grain, _top=("max", F.struct(c(value).alias("v"), (-c(time)).alias("n"))), _was=("last", value, -1))
    # a value must exceed the starting capital to become the peak
    first = x.groupBy(*keys).agg(F.min(time).alias("_t0"))
    x = x.join(first, list(keys))
    own = c("_top.v") > c("_i")
    peak, at = when(own, c("_top.v")).otherwise(c("_i")), when(own, -c("_top.n")).otherwise(c("_t0"))
    x = x.withColumns({"_peak": peak, "_at": at}).withColumns({
        "_dd": when(c("_peak") > 0, (c(value) / c("_peak") - 1.0) * 100.0).otherwise(0.0), "_r": div(c(value), c("_was")) - 1.0})
    worst = F.min_by(F.struct(c("_peak"), c(value).alias("trough"), c("_at"), c(time).alias("tt")), F.struct("_dd", time))
    g = x.groupBy(*keys).agg(
        F.max("_i").alias("initial"), F.max_by(value, time).alias("final"), F.count(lit(1)).alias("samples"),
        F.min(F.least("_dd", lit(0.0))).alias("max_drawdown"), worst.alias("_w"), F.avg("_r").alias("_mean"), F.stddev_pop("_r").alias("_sd"),
        ((F.max(time) - F.min(time)) / 86400.0).alias("_days"))
    growth = F.ln(F.greatest(c("final") / c("initial"), lit(1e-300))) * (365.25 / c("_days"))
    annual = when((c("_days") >= 1) & (c("initial") > 0), when(c("final") <= 0, -100.0).otherwise(
        F.expm1(F.least(growth, lit(math.log(10001.0)))) * 100.0)).otherwise(0.0)
    down = c("max_drawdown") < 0
    return g.select(
        *keys, "initial", "final", "samples", ((c("final") / c("initial") - 1.0) * 100.0).alias("total_return"), "max_drawdown",
        when(down, c("_w._peak")).otherwise(c("initial")).alias("peak"), when(down, c("_w.trough")).otherwise(c("initial")).alias("trough"),
        when(down, c("_w._at")).alias("peak_t"), when(down, c("_w.tt")).alias("trough_t"),
        when(c("_sd") > 0, c("_mean") / c("_sd") * math.sqrt(ppy)).otherwise(0.0).alias("sharpe"),
        (c("_sd") * math.sqrt(ppy) * 100.0).alias("volatility"), annual.alias("annual_return"))


def trade_block(trades: DataFrame, keys, profit: str = "profit") -> DataFrame:
    """Win and loss block over all closed trades."""
    p, zero = c(profit), lit(0.0)
    win, loss = p > 0, p < 0
    g = trades.groupBy(*keys).agg(
        F.count(p).alias("trades"), F.count_if(win).alias("wins"), F.count_if(loss).alias("losses"), F.sum(when(win, p).otherwise(0.0)).alias("gross_profit"),
        F.abs(F.sum(when(loss, p).otherwise(0.0))).alias("gross_loss"), F.max(p).alias("best"), F.min(p).alias("worst"), F.avg(p).alias("average"))
    avg_win, avg_loss = F.coalesce(div(c("gross_profit"), c("wins")), zero), F.coalesce(div(c("gross_loss"), c("losses")), zero)
    return g.withColumns({
        "win_rate": F.coalesce(div(c("wins") * 100.0, c("trades")), zero), "avg_win": avg_win, "avg_loss": -avg_loss,
        "profit_factor": when(c("gross_loss") > 0, c("gross_profit") / c("gross_loss")).otherwise(c("gross_profit")),
        "profit_loss_ratio": F.coalesce(div(avg_win, avg_loss), zero)})


def slice_metrics(curve: DataFrame, trades: DataFrame, keys, time: str, value: str, grain: Column, start: int, end: int, ppy: float) -> DataFrame:
    """Metrics of a window of a curve; the baseline is the last value before it."""
    keys = list(keys)
    base = curve.where(c(time) < start).groupBy(*keys).agg(F.max_by(value, time).alias("_base"))
    first = curve.where((c(time) >= start) & (c(time) <= end)).groupBy(*keys).agg(F.min_by(value, time).alias("_first"))
    x = curve.where((c(time) >= start) & (c(time) <= end)).join(first, keys).join(base, keys, "left")
    x = x.withColumn("_b", F.coalesce("_base", "_first"))
    x = scan(x.withColumnRenamed("_b", "_from"), keys, [time], grain, _run=("max", value), _was=("last", value, -1))
    peak = F.greatest("_run", when(c("_from") > 0, c("_from")))
    prev = F.coalesce("_was", when(c("_from") > 0, c("_from")))
    x = x.withColumns({"_dd": when(peak > 0, (c(value) / peak - 1) * 100).otherwise(0.0), "_r": div(c(value), prev) - 1})
    g = x.groupBy(*keys).agg(F.max("_from").alias("_from"), F.max_by(value, time).alias("_last"), F.count(lit(1)).alias("samples"),
                             F.min(F.least("_dd", lit(0.0))).alias("max_drawdown"), F.avg("_r").alias("_m"), F.stddev_pop("_r").alias("_s"))
    n = trades.where((c(time) >= start) & (c(time) <= end)).groupBy(*keys).agg(
        F.count(lit(1)).alias("trades"), F.avg(when(c("profit") > 0, 100.0).otherwise(0.0)).alias("win_rate"))
    return g.join(n, keys, "left").select(
        *keys, when(c("_from") > 0, (c("_last") / c("_from") - 1) * 100).otherwise(0.0).alias("total_return"),
        when(c("_s") > 1e-12, c("_m") / c("_s") * math.sqrt(ppy)).otherwise(0.0).alias("sharpe"), "max_drawdown", "samples",
        F.coalesce("trades", lit(0)).alias("trades"), F.coalesce("win_rate", lit(0.0)).alias("win_rate"))


def attribution(executions: DataFrame, closed: DataFrame, positions: DataFrame, initial: float) -> DataFrame:
    """Realised, unrealised, fees and contribution per symbol (symbols in any of the three)."""
    e = executions.groupBy("symbol").agg(F.sum("commission").alias("commission"))
    r = closed.groupBy("symbol").agg(F.sum("profit").alias("realized"))
    p = positions.groupBy("symbol").agg(F.sum((c("mark") - c("entry")) * c("size")).alias("unrealized"))
    df = e.join(r, "symbol", "full").join(p, "symbol", "full").na.fill(0.0)
    return df.withColumn("contribution", (c("realized") + c("unrealized")) / initial)


def status_counts(ledger: DataFrame, keys, names=("filled", "partial", "deferred", "rejected")) -> DataFrame:
    return ledger.groupBy(*keys).agg(*[F.coalesce(F.sum(when(c("status") == n, F.greatest("occurrences", lit(1)))), lit(0)).alias(n) for n in names])


def reconcile(executions: DataFrame, reported: DataFrame, cash: float, fee_rate: float, slippage: float) -> DataFrame:
    """Re-add quantities per symbol and count rows whose fee, price or time does not fit."""
    def off(a, b):
        return F.abs(a - b) > F.greatest(lit(1e-8), F.abs(b) * 1e-9)
    buy = c("side") == "buy"
    q = when(buy, c("quantity")).otherwise(-c("quantity"))
    want = c("reference") * when(buy, 1 + slippage).otherwise(1 - slippage)
    g = executions.groupBy("symbol").agg(
        F.count(lit(1)).alias("executions"), F.sum(q).alias("quantity"), F.sum(q * c("price") + c("commission")).alias("spent"),
        F.count_if(off(c("commission"), c("quantity") * c("price") * fee_rate)).alias("fee_mismatches"),
        F.count_if((c("reference") <= 0) | off(c("price"), want)).alias("price_mismatches"), F.count_if(c("t") < c("signal_t")).alias("time_mismatches"))
    df = g.join(reported.select("symbol", c("quantity").alias("_held")), "symbol", "full")
    gap = F.abs(F.coalesce("quantity", lit(0.0)) - F.coalesce("_held", lit(0.0))) > 1e-8
    return df.select("symbol", *[F.coalesce(n, lit(0)).alias(n) for n in ("executions", "fee_mismatches", "price_mismatches", "time_mismatches")],
                     F.coalesce("quantity", lit(0.0)).alias("quantity"), F.coalesce("spent", lit(0.0)).alias("spent"), gap.alias("position_mismatch"))


def metric_bundle(trades: DataFrame, keys, order, grain: Column | Cut, start: float, ppy: float) -> DataFrame:
    """Research metrics of closed trades and the equity they make."""
    keys = list(keys)
    trades, grain = cut_once(trades, keys, grain)
    x = trades.withColumn("_r", c("net") / start)
    x = path(x, keys, order, grain, c("net"), start, from_start=False)
    x = x.withColumn("_dd", when(c("peak") > 0, (c("peak") - c("equity")) / c("peak")).otherwise(0.0))
    q = quantiles(trades.withColumn("_r", c("net") / start), keys, "_r", {"_q": 0.05})
    zero = lit(0.0)
    win, r = c("_r") > 0, c("_r")
    g = x.join(q, keys).groupBy(*keys).agg(
        F.count(lit(1)).alias("n"), F.max_by("equity", F.struct(*order)).alias("_end"), F.avg(r).alias("expectancy"), F.stddev_pop(r).alias("_sd"),
        F.sqrt(F.avg(F.pow(F.least(r, zero), 2))).alias("_down"), F.count_if(win).alias("_w"), F.avg(when(win, r)).alias("avg_win"), F.avg(when(~win, r)).alias("avg_loss"),
        F.sum(when(win, r).otherwise(0.0)).alias("_gw"), F.sum(when(~win, -r).otherwise(0.0)).alias("_gl"), F.avg("holding").alias("avg_holding"),
        F.max("_dd").alias("max_drawdown"), F.avg(when(c("_dd") > 0, c("_dd"))).alias("avg_drawdown"), F.max("_q").alias("_q"), F.avg(when(r <= c("_q"), r)).alias("_tail"))
    isles = [longest_run(x, keys, order, grain, c("_dd") > 0, c("_dd") <= 0, "drawdown_bars"),
             longest_run(trades, keys, order, grain, c("net") > 0, c("net") <= 0, "win_streak"),
             longest_run(trades, keys, order, grain, c("net") <= 0, c("net") > 0, "loss_streak")]
    for part in isles:
        g = g.join(part, keys, "left")
    years = c("n") / max(ppy, 1.0)
    cagr = when(c("_end") > 0, F.pow(c("_end") / start, 1.0 / years) - 1).otherwise(0.0)
    root = math.sqrt(max(ppy, 1.0))
    return g.select(
        *keys, "n", (c("_end") / start - 1).alias("total_return"), cagr.alias("cagr"), "expectancy", (c("_w") / c("n")).alias("win_rate"),
        F.coalesce("avg_win", zero).alias("avg_win"), F.coalesce("avg_loss", zero).alias("avg_loss"),
        when(c("_gl") > 0, c("_gw") / c("_gl")).otherwise(float("inf")).alias("profit_factor"),
        F.coalesce(div(c("avg_win"), F.abs("avg_loss")), zero).alias("payoff"),
        F.coalesce("win_streak", lit(0)).alias("win_streak"), F.coalesce("loss_streak", lit(0)).alias("loss_streak"), "avg_holding", "max_drawdown",
        F.coalesce("drawdown_bars", lit(0)).alias("drawdown_bars"), F.coalesce("avg_drawdown", zero).alias("avg_drawdown"),
        F.greatest(-c("_q"), zero).alias("var_95"), (-c("_tail")).alias("cvar_95"), (c("_sd") * root).alias("volatility"),
        when(c("_sd") > 0, c("expectancy") / c("_sd") * root).otherwise(0.0).alias("sharpe"),
        when(c("_down") > 0, c("expectancy") / c("_down") * root).otherwise(0.0).alias("sortino"),
        when(c("max_drawdown") > 0, cagr / c("max_drawdown")).otherwise(0.0).alias("calmar"))


def distribution(df: DataFrame, keys, col: str) -> DataFrame:
    """Median, tails, extremes and count of a column."""
    keys = list(keys)
    g = df.groupBy(*keys).agg(F.min(col).alias("min"), F.max(col).alias("max"), F.count(col).alias("n"))
    return quantiles(df, keys, col, DIST).join(g, keys)


def regime_slices(trades: DataFrame, keys, order, grain: Column | Cut, start: float) -> DataFrame:
    """Quality per regime; the drawdown runs over the regime's own trades."""
    keys = list(keys)
    r = c("net") / start
    x = path(trades, keys, order, grain, r, 1.0, product=True)
    g = x.groupBy(*keys).agg(F.count(lit(1)).alias("trades"), F.avg(when(c("net") > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.avg(r).alias("expectancy"),
                             F.stddev_pop(r).alias("_sd"), F.max(when(c("peak") > 0, (c("peak") - c("equity")) / c("peak")).otherwise(0.0)).alias("max_drawdown"))
    return g.withColumn("sharpe_per_trade", when(c("_sd") > 0, c("expectancy") / c("_sd")).otherwise(0.0)).drop("_sd")


def excursion_groups(trades: DataFrame, keys) -> DataFrame:
    """Mean excursions by group, winners and losers apart."""
    win = c("net") > 0
    return trades.groupBy(*keys).agg(
        F.count(lit(1)).alias("n"), F.avg("mae").alias("mae"), F.avg("mfe").alias("mfe"), F.avg(when(win, c("mae"))).alias("mae_winners"),
        F.avg(when(~win, c("mae"))).alias("mae_losers"), F.avg(when(win, c("mfe"))).alias("mfe_winners"), F.avg(when(~win, c("mfe"))).alias("mfe_losers"))


def stop_sweep(trades: DataFrame, keys, stops) -> DataFrame:
    """Share of trades a stop would have kept, next to the winners' (upper) median excursion."""
    keys = list(keys)
    share = [F.avg(when(c("mae") < s, 1.0).otherwise(0.0)).alias(f"_s{i}") for i, s in enumerate(stops)]
    g = trades.groupBy(*keys).agg(*share)
    rows = F.array(*[F.struct(lit(float(s)).alias("stop"), c(f"_s{i}").alias("survival")) for i, s in enumerate(stops)])
    med = quantiles(trades.where("net > 0"), keys, "mfe", {"winner_mfe": 0.5}, rule="upper")
    return g.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*").join(med, keys, "left")


def cost_stress(trades: DataFrame, keys, multipliers) -> DataFrame:
    """Net result at cost multipliers; sums are taken once, not once per multiplier."""
    g = trades.groupBy(*keys).agg(F.sum("gross").alias("_g"), F.sum("cost").alias("_c"))
    rows = F.array(*[F.struct(lit(float(m)).alias("multiplier"), (c("_g") - c("_c") * m).alias("net")) for m in multipliers])
    return g.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*").withColumn("profitable", c("net") > 0)


def cost_verdict(stress: DataFrame, keys) -> DataFrame:
    first = F.min(when(~c("profitable"), c("multiplier")))
    g = stress.groupBy(*keys).agg(first.alias("fails_at"))
    return g.withColumn("verdict", when(c("fails_at").isNull(), "ROBUST").when(c("fails_at") <= 1.25, "EXECUTION-SENSITIVE")
                        .when(c("fails_at") <= 2.0, "MODERATE").otherwise("RESILIENT"))


def sensitivity(points: DataFrame, keys, stable: float = 0.8, collapse: float = 0.3) -> DataFrame:
    """Plateau or spike: worst score relative to the baseline and share of viable points."""
    base = F.max(when(c("baseline"), c("score")))
    g = points.groupBy(*keys).agg(base.alias("base"), F.min("score").alias("_low"), F.max("score").alias("_high"), F.avg(when(c("score") > 0, 1.0).otherwise(0.0)).alias("viable"))
    none = F.coalesce(c("base") <= 0, lit(True))
    worst = c("_low") / c("base")
    return g.select(*keys, when(none, 0.0).otherwise(worst).alias("worst"), when(none, 0.0).otherwise(c("viable")).alias("viable"),
                    when(none, "NO_EDGE").when((worst >= stable) & (c("viable") >= 0.8), "STABLE").when(worst < collapse, "UNSTABLE").otherwise("FRAGILE").alias("verdict"))


def walk_forward_summary(folds: DataFrame, keys, least: float = 0.5) -> DataFrame:
    g = folds.groupBy(*keys).agg(F.count(lit(1)).alias("folds"), F.avg(when(c("oos_return") > 0, 1.0).otherwise(0.0)).alias("positive"), F.greatest(F.max("oos_dd"), lit(0.0)).alias("worst_dd"))
    med = quantiles(folds, keys, "oos_sharpe", {"median_sharpe": 0.5}, rule="upper")
    return g.join(med, list(keys)).withColumn("stable", c("positive") >= least)


def pbo_logit(scores: DataFrame, folds: int) -> DataFrame:
    """Overfitting probability: the in-sample winner's out-of-sample rank over half splits.

    ``scores`` holds one row per config with an array of fold scores.  Splits are bit masks
    of the folds, all of them: high and low bits are exploded apart, so no row holds all masks.
    """
    half, low = folds // 2, folds // 2
    bits = F.transform(F.sequence(lit(0), lit(folds - 1)), lambda i: F.get("scores", i))
    x = scores.select("config", bits.alias("s"), F.explode(F.sequence(lit(0), lit(2 ** (folds - low) - 1))).alias("_hi"))
    x = x.select("config", "s", "_hi", F.explode(F.sequence(lit(0), lit(2 ** low - 1))).alias("_lo"))
    x = x.select("config", "s", (c("_hi") * 2 ** low + c("_lo")).alias("mask")).where(F.bit_count("mask") == half)
    total = F.expr("aggregate(s, 0D, (a, v) -> a + v)")
    inside = F.expr(f"aggregate(sequence(0, {folds - 1}), 0D, (a, i) -> a + if((shiftright(mask, i) & 1) = 1, s[i], 0D))")
    x = x.select("config", "mask", (inside / half).alias("ins"), ((total - inside) / (folds - half)).alias("oos"))
    win = x.groupBy("mask").agg(F.max_by("oos", F.struct("ins", (-c("config")).alias("k"))).alias("best"))
    rank = x.join(win, "mask").groupBy("mask").agg((F.count_if(c("oos") < c("best")) + 1).alias("rank"), F.count(lit(1)).alias("n"))
    pct = F.least(F.greatest(c("rank") / (c("n") + 1.0), lit(1e-9)), lit(1.0 - 1e-9))
    return rank.select("mask", "rank", F.ln(pct / (1.0 - pct)).alias("logit"))


def pbo_matrix(scores: DataFrame, low: float = 0.2, high: float = 0.5, escalate: float = 0.5) -> DataFrame:
    """Overfitting by split: is the in-sample best in the lower half out of sample?"""
    best = scores.groupBy("split").agg(F.max_by("oos", F.struct("ins", (-c("config")).alias("k"))).alias("picked"), F.max("ins").alias("best_is"), F.count(lit(1)).alias("n"))
    below = scores.join(best, "split").groupBy("split").agg(F.count_if(c("oos") <= c("picked")).alias("le"), F.max("n").alias("n"))
    mid = quantiles(scores, ["split"], "ins", {"med_is": 0.5}, "upper").join(quantiles(scores, ["split"], "oos", {"med_oos": 0.5}, "upper"), "split")
    x = best.drop("n").join(below, "split").join(mid, "split")
    g = x.agg(F.count(lit(1)).alias("splits"), F.max("n").alias("configs"), F.avg(when(c("le") <= c("n") / 2.0, 1.0).otherwise(0.0)).alias("pbo"),
              *[F.percentile(n, 0.5).alias(n) for n in ("best_is", "med_is", "picked", "med_oos")])
    deg = when(F.abs("best_is") > 1e-12, F.least(F.greatest((c("best_is") - c("picked")) / F.abs("best_is"), lit(0.0)), lit(1.0))).otherwise(1.0)
    g = g.withColumn("degradation", deg)
    level = when(c("pbo") < low, 0).when(c("pbo") <= high, 1).otherwise(2)
    level = F.least(level + when(c("degradation") > escalate, 1).otherwise(0), lit(2))
    return g.withColumn("assessment", F.element_at(F.array(lit("LOW"), lit("MODERATE"), lit("HIGH")), level + 1))


def deflated_sharpe(returns: DataFrame, keys, col: str, trials: int) -> DataFrame:
    """Probability that a Sharpe ratio beats the best of ``trials`` tries by luck."""
    keys = list(keys)
    m = returns.groupBy(*keys).agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_pop(col).alias("sd"))
    z = (c(col) - c("mean")) / c("sd")
    g = returns.join(m, keys).where(c("sd") > 1e-12).groupBy(*keys, "n", "mean", "sd").agg(F.avg(z * z * z).alias("skew"), F.avg(z * z * z * z).alias("kurtosis"))
    g = g.where("n >= 3").withColumn("sharpe", c("mean") / c("sd"))
    den = F.sqrt(F.greatest(lit(1e-12), 1.0 - c("skew") * c("sharpe") + (c("kurtosis") - 1.0) / 4.0 * c("sharpe") * c("sharpe")))
    if trials <= 1:
        top = lit(0.0)
    else:
        top = (1.0 - EULER_GAMMA) * normal_ppf(lit(1.0 - 1.0 / trials)) + EULER_GAMMA * normal_ppf(lit(1.0 - 1.0 / (trials * math.e)))
    g = g.withColumn("_den", den).withColumn("benchmark", c("_den") / F.sqrt(c("n") - 1.0) * top)
    g = g.withColumn("_stat", (c("sharpe") - c("benchmark")) * F.sqrt(c("n") - 1.0) / c("_den"))
    return g.withColumn("probability", normal_cdf(c("_stat"))).drop("_den", "_stat")


def daily_returns(points: DataFrame, key: str, grain_days: int = 4096) -> DataFrame:
    """Last value of each day and the return on the day before (previous value positive)."""
    day = F.floor(c("t") / 86400)
    d = points.groupBy(key, day.alias("day")).agg(F.max_by("value", F.struct("t", "id")).alias("value"))
    d = scan(d, [key], ["day"], F.floor(c("day") / grain_days), _was=("last", "value", -1))
    return d.where(c("_was") > 0).select(key, "day", (c("value") / c("_was") - 1).alias("ret"))


def composite_scores(folds: DataFrame, weights: dict) -> DataFrame:
    """Blend of fold metrics per trial; ``kind`` tells train from validation rows."""
    v, t = c("kind") == "validation", c("kind") == "train"
    act = when(v, F.greatest("activity", lit(0.0)))
    g = folds.groupBy("trial").agg(
        F.avg(when(t, c("sharpe"))).alias("_ts"), F.avg(when(v, c("sharpe"))).alias("_vs"), F.avg(when(v, c("ret"))).alias("_vr"), F.avg(when(v, F.abs("drawdown"))).alias("_dd"),
        F.stddev_pop(when(v, c("ret"))).alias("_sd"), F.sum(act).alias("_act"), F.avg(when(v, when(c("activity") > 0, 1.0).otherwise(0.0))).alias("_rate"), F.count_if(v).alias("_n"))
    g = g.na.fill({"_ts": 0.0, "_vs": 0.0, "_vr": 0.0, "_dd": 100.0, "_sd": 0.0, "_act": 0.0, "_rate": 0.0})
    decay = F.greatest(lit(0.0), (c("_ts") - c("_vs")) / F.greatest(F.abs("_ts"), lit(0.5)))
    parts = {"return": sigmoid(c("_vr") / 12.0), "sharpe": sigmoid(c("_vs")), "drawdown": F.greatest(lit(0.0), 1.0 - F.least(c("_dd") / 50.0, lit(1.0))),
             "stability": F.greatest(lit(0.0), 1.0 - F.least(lit(1.0), c("_sd") / (F.abs("_vr") + 12.0))), "decay": F.greatest(lit(0.0), 1.0 - F.least(decay, lit(1.0)))}
    raw = lit(0.0)
    for name, part in parts.items():
        raw = raw + part * weights.get(name, 0.0)
    evidence = F.least(lit(1.0), c("_act") / F.greatest(lit(8.0), c("_n") * 2.0))
    return g.select("trial", when(c("_act") > 0, raw * 100.0 * F.sqrt(evidence) * c("_rate")).otherwise(0.0).alias("score"), decay.alias("decay"), evidence.alias("evidence"))


def robustness_grade(pbo, probability, loss, stressed) -> Column:
    """Struct score, checks, grade from up to four checks (null when not available)."""
    checks = F.array_compact(F.array(1.0 - pbo, probability, 1.0 - loss, 1.0 / (1.0 + F.pow(lit(2.718281828), -stressed / 10.0))))
    score = when(F.size(checks) > 0, F.aggregate(checks, lit(0.0), lambda a, x: a + x) / F.size(checks) * 100.0).otherwise(0.0)
    grade = when(score >= 80, "A").when(score >= 65, "B").when(score >= 50, "C").otherwise("D")
    return F.struct(F.round(score, 2).alias("score"), F.size(checks).alias("checks"), grade.alias("grade"))


def running_best(trials: DataFrame, keys, chunk: int = 65536) -> DataFrame:
    """Best score so far (from 0); pruned trials do not count."""
    x = scan(trials, keys, ["trial"], F.floor(c("trial") / chunk), _b=("max", when(~c("pruned"), c("score"))))
    return x.withColumn("best", F.greatest(lit(0.0), F.coalesce("_b", lit(0.0)))).drop("_b")


def heat_axes(trials: DataFrame) -> DataFrame:
    """The two numeric parameters with most distinct values."""
    p = trials.where(~c("pruned")).select(F.explode("params").alias("name", "value"))
    n = p.groupBy("name").agg(F.count_distinct("value").alias("distinct"))
    return n.where("distinct > 1").orderBy(c("distinct").desc(), "name").limit(2)


def heat_points(trials: DataFrame, x: str, y: str) -> DataFrame:
    return trials.where(~c("pruned")).groupBy(c("params")[x].alias("x"), c("params")[y].alias("y")).agg(F.count(lit(1)).alias("n"), F.avg("score").alias("score"))


def histogram(df: DataFrame, keys, col: str, bins: int) -> DataFrame:
    """Equal-width bins per group; the top edge belongs to the last bin."""
    keys = list(keys)
    e = df.groupBy(*keys).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    x = df.join(e, keys)
    width = (c("_hi") - c("_lo")) / bins
    i = when(c("_hi") > c("_lo"), F.least(lit(bins - 1), F.floor((c(col) - c("_lo")) / width))).otherwise(lit(0))
    mid = when(c("_hi") > c("_lo"), c("_lo") + (c("bin") + 0.5) * width).otherwise(c("_lo"))
    return x.withColumn("bin", i).groupBy(*keys, "bin", "_lo", "_hi").agg(F.count(lit(1)).alias("count")).select(*keys, "bin", mid.alias("value"), "count")


IR_BANDS = ((0.3, "weak"), (0.5, "acceptable"), (1.0, "good"), (float("inf"), "exceptional"))  # fixed values


def information_ratio(curve: DataFrame, keys, step: int, factor: float, bands, allowed: Column | None = None, time: str = "t") -> DataFrame:
    """Active return over tracking error on common levels; only whole periods count.

    ``allowed`` marks longer gaps that are still one period (neighbouring sessions).
    """
    x = scan(curve, keys, [time], F.floor(c(time) / (step * 16384)), _was=("last", F.struct(time, "portfolio", "benchmark"), -1))
    fits = (c(time) - c(f"_was.{time}") == step) | (F.coalesce(allowed, lit(False)) if allowed is not None else lit(False))
    x = x.where(c("_was").isNotNull() & fits).withColumns({
        "_p": c("portfolio") / c("_was.portfolio") - 1, "_q": c("benchmark") / c("_was.benchmark") - 1})
    g = x.groupBy(*keys).agg(F.count(lit(1)).alias("observations"), (F.avg("_p") * factor).alias("portfolio_return"), (F.avg("_q") * factor).alias("benchmark_return"),
                             (F.avg(c("_p") - c("_q")) * factor).alias("active_return"), F.stddev_samp(c("_p") - c("_q")).alias("_te"))
    ratio = when(c("_te") > 1e-15, c("active_return") / (c("_te") * math.sqrt(factor)))
    label = lit(bands[-1][1])
    for bound, name in reversed(bands):
        label = when(ratio < bound, name).otherwise(label)
    return g.select(*keys, "observations", "portfolio_return", "benchmark_return", "active_return", (c("_te") * math.sqrt(factor)).alias("tracking_error"),
                    ratio.alias("information_ratio"), when(ratio.isNotNull(), label).alias("classification"),
                    when(c("observations") < 2, "insufficient_history").when(ratio.isNull(), "zero_tracking_error").otherwise("available").alias("status"))


def market_distribution(rows: DataFrame) -> DataFrame:
    """Market value, PnL and share of the total per market."""
    g = rows.groupBy("market").agg(F.sum("cost").alias("cost"), F.sum("value").alias("value"), F.sum("pnl").alias("pnl"), F.count(lit(1)).alias("positions"))
    total = g.agg(F.sum("value").alias("_all"))
    return g.crossJoin(F.broadcast(total)).withColumn("percent", when(c("_all") > 0, c("value") / c("_all") * 100).otherwise(0.0)).drop("_all")


def run_score(r: Column) -> Column:
    """Marketplace score of a backtest result struct."""
    v = lambda n: F.coalesce(r[n], lit(0.0))
    s = 50 + v("totalReturn") * 0.2 + v("sharpeRatio") * 10 + v("winRate") * 0.1 - F.abs(v("maxDrawdown")) * 0.25
    return when(v("totalTrades") <= 0, 0.0).otherwise(F.greatest(lit(0.0), F.least(lit(100.0), s)))


def representative_runs(runs: DataFrame, key: str) -> DataFrame:
    """Best run per asset with its figures, and the symbols in first-seen order."""
    x = runs.withColumn("score", run_score(c("r")))
    g = x.groupBy(key).agg(F.max_by(F.struct("id", "score", "r"), F.struct("score", "id")).alias("_b"), F.count(lit(1)).alias("sample_size"))
    s = x.where(F.trim("symbol") != "").groupBy(key, "symbol").agg(F.min("id").alias("_first"))
    s = s.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", "symbol"))), lambda z: z["symbol"]).alias("symbols"))
    return g.join(s, key, "left").select(key, c("_b.id").alias("best_run"), c("_b.score").alias("score"), "sample_size",
                                         c("_b.r.totalReturn").alias("total_return"), c("_b.r.sharpeRatio").alias("sharpe"), "symbols")


# --- decisions --------------------------------------------------------------------------

def decision_correct(decision: Column, pct: Column) -> Column:
    return when(decision == "BUY", pct > 2).when(decision == "SELL", pct < -2).otherwise(F.abs(pct) <= 5)


def by_regime(rows: DataFrame) -> DataFrame:
    """Accuracy, mean return and decision mix by the regime recorded in the raw result."""
    regime = F.lower(F.coalesce(F.get_json_object("raw", "$.consensus.risk_context.trend"), F.get_json_object("raw", "$.consensus.market_regime"), lit("unknown")))
    d = F.upper(F.coalesce("decision", lit("HOLD")))
    return rows.groupBy(regime.alias("regime")).agg(
        F.count(lit(1)).alias("total"), (F.avg(when(c("correct"), 1.0).otherwise(0.0)) * 100).alias("accuracy"), F.coalesce(F.avg("ret"), lit(0.0)).alias("avg_return"),
        F.count_if(d == "BUY").alias("buy"), F.count_if(d == "SELL").alias("sell"), F.count_if(~d.isin("BUY", "SELL")).alias("hold"))


CONFIDENCE = ((50, 60), (60, 70), (70, 80), (80, 90), (90, 101))


def confidence_bucket(x: Column) -> Column:
    out = lit(None).cast("string")
    for lo, hi in reversed(CONFIDENCE):
        out = when((x >= lo) & (x < hi), f"{lo}_{hi}").otherwise(out)
    return out


def confidence_accuracy(rows: DataFrame, least: int = 5) -> DataFrame:
    return rows.groupBy(confidence_bucket(c("confidence")).alias("bucket")).agg(
        F.count(lit(1)).alias("n"), F.avg(when(c("correct"), 1.0).otherwise(0.0)).alias("accuracy")).where((c("n") >= least) & c("bucket").isNotNull())


def adjusted_confidence(rows: DataFrame, accuracy: DataFrame) -> DataFrame:
    """Scale a confidence by the accuracy of its bucket.

    The last bucket has no adjustment: its label differs from the one that is looked up.
    """
    x = rows.withColumn("bucket", confidence_bucket(c("confidence"))).join(accuracy.select("bucket", "accuracy"), "bucket", "left")
    scaled = (c("confidence") * (c("accuracy") / (0.5 + (c("confidence") - 50) / 100.0))).cast("int")
    use = (c("accuracy") > 0) & (c("bucket") != "90_101")
    return x.withColumn("adjusted", F.greatest(lit(1), F.least(lit(99), when(use, scaled).otherwise(c("confidence").cast("int")))))


def calibrate(rows: DataFrame, key: str, thresholds) -> DataFrame:
    """Threshold with the best accuracy per market; ties prefer more BUY and SELL, then the lower one.

    All thresholds are counted in one aggregation.
    """
    aggs, parts = [], []
    for i, t in enumerate(thresholds):
        pred = when(c("score") >= t, "BUY").when(c("score") <= -t, "SELL").otherwise("HOLD")
        aggs += [F.avg(when(decision_correct(pred, c("ret")), 100.0).otherwise(0.0)).alias(f"_a{i}"), F.count_if(pred != "HOLD").alias(f"_c{i}")]
        parts.append(F.struct(c(f"_a{i}").alias("accuracy"), c(f"_c{i}").alias("coverage"), lit(-float(t)).alias("neg")))
    g = rows.groupBy(key).agg(F.count(lit(1)).alias("samples"), *aggs)
    best = F.array_max(F.array(*parts))
    return g.select(key, "samples", best.alias("b")).select(key, "samples", (-c("b.neg")).alias("threshold"), "b.accuracy", "b.coverage")


def sentiment(news: DataFrame, key: str, order, newest: int = 15, cap: float = -55.0) -> DataFrame:
    """Net sentiment of the first items per asset: the limit comes before the relevance filter."""
    # the newest rows of each part of a key first, so a hot key is never sorted whole
    w = Window.partitionBy(key, "_part").orderBy(*order)
    x = news.withColumn("_part", F.pmod(F.xxhash64(*order), lit(64))).withColumn("_n", F.row_number().over(w)).where(c("_n") <= newest)
    x = x.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(c("_n") <= newest)
    x = x.where(c("relevance").isin("direct", "material"))
    hit = F.sum(when(c("level") == "severe", -42.0).when(c("level") == "moderate", -18.0).otherwise(0.0))
    net = (F.count_if(c("sentiment") == "positive") - F.count_if(c("sentiment") == "negative")) / F.count(lit(1)) * 60.0
    return x.groupBy(key).agg(F.greatest(lit(-100.0), F.least(lit(100.0), net + F.greatest(hit, lit(cap)))).alias("score"), F.count(lit(1)).alias("used"))


# --- gates and readiness ----------------------------------------------------------------

def entry_gate(x: dict[str, Column]) -> Column:
    """Reason code of the first failing layer, or 'trade'."""
    return (when(~x["data_ok"], "no_trade_data").when(x["emergency"], "no_trade_emergency").when(x["halted"], "no_trade_risk")
            .when(x["flat"], "idle_flat_signal").when(x["blocked"], "no_trade_regime").when(x["positions"] >= x["max_positions"], "no_trade_positions")
            .when(x["risk"] >= x["max_risk"], "no_trade_open_risk").when(~x["leverage_ok"], "no_trade_leverage").when(~x["stop"], "no_trade_no_stop")
            .when(~x["execution_ok"], "no_trade_execution").otherwise("trade"))


def release_gate(e: Column) -> Column:
    """Gate booleans from an evidence struct; a missing stage counts as failed."""
    ok = lambda x: F.coalesce(x, lit(False))
    wf, pbo, over = ok(e["positive_folds"] >= 0.5), ok(e["pbo"] <= 0.5), ok(e["degradation"] <= 0.5)
    snoop, dd = ok((e["white_p"] < 0.05) & (e["spa_p"] < 0.05)), ok(e["max_dd"] <= e["dd_cap"])
    mc = ok((e["boot_p5"] > 0) & (e["shuffle_p95"] <= F.greatest(e["max_dd"], lit(1e-9)) * 2))
    cost = ~ok(e["cost_verdict"].startswith("EXECUTION-SENSITIVE")) & ~ok(e["cost_verdict"].startswith("MODERATE")) & e["cost_verdict"].isNotNull()
    return F.struct(ok(e["stable"]).alias("walkforward_stable"), (wf & pbo & over & snoop).alias("oos_validated"), mc.alias("monte_carlo_ok"),
                    ok(e["sensitivity"] == "STABLE").alias("sensitivity_ok"), dd.alias("drawdown_ok"), cost.alias("execution_stress_ok"),
                    (dd & ok(e["shadow"] == "Promote")).alias("risk_limits_ok"))


def warmup_ready(bars: DataFrame, starts: DataFrame, need: int) -> DataFrame:
    """Valid positive bars before the first active time of each symbol, against the need."""
    good = (c("open") > 0) & (c("high") > 0) & (c("low") > 0) & (c("close") > 0)
    g = starts.join(bars, "symbol", "left").groupBy("symbol").agg(F.count_if(good & (c("t") < c("first_active"))).alias("usable"))
    return g.withColumn("ready", c("usable") >= need)


def fields_present(rows: DataFrame, key: str, fields) -> DataFrame:
    """Required fields that never have a finite value."""
    seen = [F.bool_or(c(f).isNotNull() & ~F.isnan(f)).alias(f) for f in fields]
    g = rows.groupBy(key).agg(*seen)
    return g.select(key, F.array_compact(F.array(*[when(~F.coalesce(f, lit(False)), f) for f in fields])).alias("missing"))


def all_have_session(members: DataFrame, bars: DataFrame, group: str, expected: Column) -> DataFrame:
    """Do all members of a group have a bar of the expected session as their last one?"""
    last = bars.groupBy("symbol").agg(F.max("t").alias("_last"))
    return members.join(last, "symbol", "left").groupBy(group).agg(
        F.bool_and(F.coalesce(c("_last") == expected, lit(False))).alias("ready"), F.count(lit(1)).alias("members"))


def evidence_quality(obs: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Coverage, freshness and conflicts of snapshots, with the strongest allowed conclusion.

    Rows: snapshot, metric, source, value, valid, age, limit, required.
    """
    ok = c("valid")
    m = obs.groupBy("snapshot", "metric").agg(
        F.bool_or("required").alias("_req"), F.bool_or(ok).alias("covered"), F.bool_or(ok & (c("age") <= c("limit"))).alias("fresh"),
        F.count_distinct(when(ok, F.lower("source"))).alias("_src"), F.min(when(ok, c("value"))).alias("_lo"), F.max(when(ok, c("value"))).alias("_hi"))
    spread = (c("_hi") - c("_lo")) / F.greatest(F.abs("_lo"), F.abs("_hi"), lit(1e-12))
    m = m.withColumn("conflict", (c("_src") >= 2) & (spread > tolerance))
    any_ = m.groupBy("snapshot").agg(F.bool_or("_req").alias("_any"))
    m = m.join(any_, "snapshot").where(c("_req") | ~c("_any"))
    g = m.groupBy("snapshot").agg(F.count(lit(1)).alias("_n"), F.count_if("covered").alias("_c"), F.count_if(c("covered") & c("fresh")).alias("_f"), F.count_if("conflict").alias("_x"))
    g = g.select("snapshot", (c("_c") / c("_n")).alias("coverage"), F.coalesce(div(c("_f"), c("_c")), lit(0.0)).alias("freshness"), (c("_x") / c("_n")).alias("conflict"))
    score = F.greatest(lit(0.0), F.least(lit(1.0), 0.5 * c("coverage") + 0.35 * c("freshness") + 0.15 * (1 - c("conflict"))))
    strength = (when((c("coverage") < 0.6) | (c("freshness") < 0.5) | (c("conflict") > 0.25), "none").when((c("coverage") < 0.8) | (c("freshness") < 0.7) | (c("conflict") > 0.1), "low")
                .when((c("coverage") < 0.95) | (c("freshness") < 0.9) | (c("conflict") > 0), "medium").otherwise("high"))
    return g.withColumns({"score": score, "strength": strength})
