"""Plans and costs that must grow no faster than the input, and the values they give."""

import math
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidemark.functions.ordered import Cut, chunked
from tidemark.model import Panel
from tidemark.operators import features as X
from tidemark.operators import ledger as L
from tidemark.operators.factors import factor_panel
from tidemark.operators.splits import purged_splits
from tidemark.operators.userdef import by_chunk
from tidemark.plans import QUERIES
from tidemark.session import CHUNK_ROWS, prepare


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def panel(spark, n=90, symbols=("a", "b", None), price=None):
    rng = random.Random(7)
    rows = []
    for s in symbols:
        for i in range(n):
            x = price(i) if price else 20.0 + rng.randrange(-80, 80) / 8
            rows.append((s, 60 * i, x, x + 1, x - 1, x, 5.0))
    df = spark.createDataFrame(rows, "symbol string, t long, open double, high double, low double, close double, volume double")
    return Panel(df.withColumn("ts", F.timestamp_seconds("t")).drop("t"), 60)


def test_user_code_gets_whole_groups_out_of_shared_batches(spark):
    """groups of rows come many in a batch, cut by batches, with a null key; none is a job of its own."""
    rows = spark.range(0, 5000, numPartitions=3).select(F.when(F.col("id") % 7 != 3, F.col("id") % 7).alias("k"), (5000 - F.col("id")).alias("pos"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "999")
    try:
        got = by_chunk(rows, ["k"], lambda pdf: pd.DataFrame({"k": pdf["k"].iloc[:1].astype("Int64"), "n": [len(pdf)], "up": [bool(pdf["pos"].is_monotonic_increasing)]}), "k long, n long, up boolean")
        seen = {(r.k, r.n, r.up) for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert seen == {(None if k == 3 else k, len(range(k, 5000, 7)), True) for k in range(7)}
    assert "FlatMapGroups" not in plan(QUERIES["d4_parameter_sweep"](prepare(spark), SMALL))


def test_clusters_look_at_their_last_group_only(spark):
    """the same groups as a search through all of them, without it."""
    rng, rows = random.Random(3), []
    for k in range(300):
        rows.append((k, [rng.randrange(0, 400) / 8 for _ in range(rng.randrange(0, 40))] + ([None] if k % 11 == 0 else []), rng.choice([0.0, 0.2, 1.0, 3.0, None])))
    df = spark.createDataFrame(rows, "k long, v array<double>, tol double").select("k", X._clusters(F.col("v"), F.col("tol")).alias("g"))
    assert "array_position" not in plan(df)
    for r in df.collect():
        values, tol = rows[r.k][1:]
        groups = []
        for v in sorted(x for x in values if x is not None):
            near = [g for g in groups if tol is not None and abs(v - sum(g) / len(g)) <= tol]
            near[0].append(v) if near else groups.append([v])
        want = [(round(sum(g) / len(g), 8), len(g)) for g in groups] + [(None, 1)] * values.count(None)
        assert [(g.price and round(g.price, 8), g.touches) for g in r.g] == want


def test_masks_are_worked_out_once(spark):
    """no search for masks and blocks in each row."""
    rows = spark.range(24).select(F.col("id").alias("pos"), F.lit(24).alias("n"))
    x = purged_splits(rows, "pos", "n", 6, 2, 4, 5)
    assert "lambda" not in plan(x)
    assert {r.split for r in x.collect()} == {(1 << a) | (1 << b) for b in range(6) for a in range(b)}


@pytest.mark.parametrize("price", [None, lambda i: -3.0 if i == 89 else math.sin(i) * 5 + 9, lambda i: float("nan") if i == 40 else 30.0 + i % 9])
def test_deepest_fall_of_two_windows(spark, price):
    """falls of windows made of shorter ones are those of a walk through the window, below zero too."""
    p = panel(spark, 90, ("a",), price)
    df = factor_panel(p, {"x": {"factor": "max_drawdown", "period": 13}, "y": {"factor": "max_drawdown", "period": 4}}).select("ts", "x", "y")
    bars = [r.close for r in p.df.orderBy("ts").collect() if not math.isnan(r.close)]
    for at, r in enumerate(df.where("x IS NOT NULL OR y IS NOT NULL").orderBy("ts").collect(), len(bars) - df.where("x IS NOT NULL OR y IS NOT NULL").count()):
        for n, got in ((13, r.x), (4, r.y)):
            if at >= n - 1:
                top = low = 0.0
                for v in bars[at - n + 1 : at + 1]:
                    top = max(top, v)
                    low = min(low, v / top - 1)
                assert got == low


def test_dense_spans_are_counted_in_two_jobs(spark):
    """Whatever the depth of the cuts, and a span of one second's rows isn't cut at all."""
    prepare(spark)
    rows = [("k", 86400 * d + s, i) for d in range(3) for s in (0, 1, 2) for i in range(40)] + [("one", 5 * 86400 + 7, i) for i in range(90)]
    df = spark.createDataFrame(rows, "key string, t long, id long")
    spark.conf.set(CHUNK_ROWS, "24")
    spark.sparkContext.setJobGroup("cuts", "cuts")
    try:
        cut = chunked(df, ["key"], Cut("t", 30 * 86400))
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("cuts"))
        got = {(r.key, r._b, r["count"]) for r in cut.groupBy("key", "_b").count().collect()}
    finally:
        spark.conf.unset(CHUNK_ROWS)
        spark.sparkContext._jsc.sc().clearJobGroup()
    assert got == {("k", 86400 * d + s, 40) for d in range(3) for s in (0, 1, 2)} | {("one", 0, 90)}
    assert jobs <= 6  # adaptive stages of two counts; five counts before


def test_sizes_need_no_prices(spark):
    """positions without cost have the same sizes, and no rows are gathered in arrays."""
    from tidemark.plans.standins import trades
    t = trades(prepare(spark), SMALL)
    less = L.virtual_fills(t, cost=False)
    assert "collect_list" not in plan(less)
    a, b = ({(r.id, r.t, r.leg, r.size, r.fill) for r in x.select("id", "t", "leg", "size", "fill").collect()} for x in (less, L.virtual_fills(t)))
    assert a == b


def test_aliases_that_share_a_first_word_are_no_candidates(spark):
    """whole words, odd separators and overlapping aliases, without a pair for each alias of a common first word."""
    from tidemark.operators.select import relevant_news
    news = [(1, "Part 7 of PART 12, the end"), (2, "part-7: c++ and at&t."), (3, None), (4, "part  7 x part 70"), (5, "a b c d e")]
    names = ["part 7", "part 12", "part 70", "part", "c++", "at&t", "b c d e", "b c d f", "the", "--", "part 7 x part"]
    got = relevant_news(spark.createDataFrame(news, "id long, text string"), spark.createDataFrame([(n, n) for n in names], "asset string, alias string"), F.col("text"), "id")
    want = {(i, n) for i, x in news if x for n in names if n != "--" and re.search("(?<![a-z0-9])" + re.escape(n) + "(?![a-z0-9])", x.lower())}
    assert {(r.id, r.asset) for r in got.collect()} == want
    assert "_first" not in plan(got) and "array_distinct" not in plan(got)


def test_regimes_run_their_recursions_once_over_the_rows(spark):
    """No array folds, one shuffle for both uses of a scan, and rows that don't depend on chunks or batches."""
    rng, rows = random.Random(5), []
    for s in ("a", None):
        x = 50.0
        for i in range(2600):
            x = x if 900 < i < 1000 else x + rng.randrange(-8, 9) / 8  # a flat stretch has ties and no slope
            close = None if i % 701 == 5 else x
            rows.append((s, 60 * i, x, x + 1, x - 1, close, float(1 + i % 7)))
    df = spark.createDataFrame(rows, "symbol string, t long, open double, high double, low double, close double, volume double")
    p = Panel(df.withColumn("ts", F.timestamp_seconds("t")).drop("t"), 60)
    cfg = {**X.REGIME, "adx_period": 3, "atr_period": 3, "ema_fast": 3, "ema_slow": 5, "atr_window": 20, "rsi_period": 3}
    names = ("adx", "pdi", "mdi", "ef", "es", "atr", "atr_pct", "slope_up", "slope_dn", "rsi")

    def got():
        return {(r.symbol, r.pos): tuple(repr(r[n]) for n in names) for r in X.regime_inputs(p, cfg).df.select("symbol", "pos", *[F.round(n, 9).alias(n) if n[:5] != "slope" else F.col(n) for n in names]).collect()}

    whole = got()
    spark.conf.set(CHUNK_ROWS, "64")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        assert got() == whole and len(whole) == len(rows)
    finally:
        spark.conf.unset(CHUNK_ROWS)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    old = X.fold_frame(p, 400, {k: (lambda w, f=f: f(w, None)) for k, f in X.moves().items()}, lambda a: {
        **X._directional(a, 3), "ef": a.ema(a["close"], 3), "es": a.ema(a["close"], 5), "atr": a.wilder(a["tr"], 3)})
    for r in old.collect():
        for x, y in zip((r.adx, r.pdi, r.mdi, r.ef, r.es, r.atr), whole[r.symbol, r.pos]):
            assert repr(x) == y if x is None else abs(x - float(y)) < 1e-8
    rsi = {(r.symbol, r.t): r.rsi for r in factor_panel(p, {"rsi": {"period": 3}}).select("symbol", F.unix_seconds("ts").alias("t"), F.round("rsi", 9).alias("rsi")).collect()}
    assert {k: v for k, v in rsi.items() if v is not None} == {(s, 60 * i): float(v[-1]) for (s, i), v in whole.items() if v[-1] != "None"}
    for name in ("w21_regimes", "w23_cross_signal", "w24_reversion_signal", "w25_breakout_signal"):
        assert "lambda" not in plan(QUERIES[name](prepare(spark), SMALL)), name


def test_fan_out_deals_the_batches_of_a_key(spark):
    """with one key, its batches and the events that meet them lie in many tasks; no pair of a batch and a time is held."""
    from tidemark.operators.joins import fan_out
    key = F.concat(F.lit("a"), (F.col("id") % 1).cast("string")).alias("partition_key")  # one key, which the optimizer doesn't know
    ev = spark.range(30).select(key, F.col("id").alias("t"))
    subs = spark.range(900).select(F.col("id").alias("strategy_id"), key, F.lit("running").alias("status"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        out = fan_out(ev, subs, 4, 5)
        assert out.columns == ["partition_key", "t", "shard", "batch", "strategy_ids"]
        rows = out.withColumn("p", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted((r.t, s) for r in rows for s in r.strategy_ids) == [(t, s) for t in range(30) for s in range(900)]
    assert len({r.p for r in rows}) > 8
    assert "count(distinct" not in plan(QUERIES["j13_fan_out"](prepare(spark), SMALL))


def test_factor_correlation_makes_its_rows_once(spark):
    """the bars are read for the dates, the first ordinal and the rows, not again for each count and rank."""
    assert plan(QUERIES["x17_factor_correlation"](prepare(spark), SMALL)).count("Relation [l_") <= 12


def test_equity_joins_trades_once(spark):
    """without broadcasts, lineitem is shuffled once for its join with the orders; positions without a symbol have no mark."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = QUERIES["a3_daily_metrics"](prepare(spark), SMALL)
        df.collect()
        p = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len([x for x in p.splitlines() if "Exchange hashpartitioning(l_orderkey" in x and "ReusedExchange" not in x]) == 1
    trades = spark.createDataFrame([(1, "A", "open_long", 2.0, 10.0, 1.0, None, "a", 5), (1, None, "open_short", 1.0, 7.0, 0.5, None, "b", 6), (2, "A", "close_long", 2.0, 12.0, 1.0, 4.0, "c", 7), (2, "B", "add_long", 1.0, 3.0, 0.0, None, "d", 8)],
                                   "strategy_id long, symbol string, type string, amount double, price double, commission double, profit double, id string, t long")
    strategies = spark.createDataFrame([(1, 100.0, "live"), (2, 50.0, "signal"), (3, 9.0, "live")], "strategy_id long, capital double, mode string")
    paid = spark.createDataFrame([(1, 2.0, 1), (1, 3.0, 9)], "strategy_id long, amount double, t long")
    got = L.equity_and_opening(strategies, trades, paid, 6, F.col("symbol") != "B", F.col("symbol") != "B")
    rows = {r.strategy_id: (r.realized, r.funding, r.unrealized, r.open_positions, r.completed_trades, r.wins, r.rebuilt, r.equity) for r in got.collect()}
    assert rows == {1: (-1.5, 5.0, 4.0, 2, 0, 0, 101.0, 107.5), 2: (3.0, 0.0, 0.0, 1, 1, 1, 50.0, 53.0), 3: (0.0, 0.0, 0.0, 0, 0, 0, 9.0, 9.0)}


def test_excursions_carry_a_trade_once(spark):
    """a trade with many looks carries its columns in the first only; one without a look or a bar stays."""
    bars = panel(spark, n=500, symbols=("a",)).df
    trades = spark.createDataFrame([("x", "a", 0, 60 * 499, 1, 20.0), ("y", "a", 60 * 9, 60 * 3, -1, 20.0), ("z", "q", 0, 60, 1, 20.0)], "id string, symbol string, entry_t long, exit_t long, direction int, entry double")
    out = X.excursions(trades, bars, 60, width=4)
    low, high = bars.agg(F.min("low"), F.max("high")).collect()[0]
    assert {r.id: (r.mae, r.mfe) for r in out.collect()} == {"x": ((20.0 - low) / 20.0, (high - 20.0) / 20.0), "y": (0.0, 0.0), "z": (0.0, 0.0)}
    assert "posexplode" in plan(out)


@pytest.mark.parametrize("many", [None, 3])
def test_quantiles_count_in_bins(spark, monkeypatch, many):
    """dense bins are cut finer, a null key is a group, and what lies beyond the bins is ordered exactly; also with more bins than are sent."""
    from tidemark.functions import stats
    rng, rows = random.Random(11), []
    for i in range(3000):
        rows.append((None if i % 3 == 0 else "a", i % 2, rng.choice([rng.gauss(0, 1), 5.0 + rng.random() * 1e-9, 1e200 * rng.random(), -7.0, 1e-12 * i])))
    rows += [("b", 0, x) for x in (None, 2.0, float("inf"), float("-inf"))] + [("c", 1, None)]
    df = spark.createDataFrame(rows, "k string, g long, v double")
    if many:
        monkeypatch.setattr(stats, "MANY", many)
    spark.conf.set(CHUNK_ROWS, "64")
    try:
        for rule in ("linear", "upper", "nearest"):
            probs = {"p0": 0.0, "p3": 0.03, "p37": 0.37, "p50": 0.5, "p90": 0.9}
            got = {(r.k, r.g): r for r in stats.quantiles(df, ["k", "g"], "v", probs, rule).collect()}
            assert set(got) == {(None, 0), (None, 1), ("a", 0), ("a", 1), ("b", 0)}
            for key, r in got.items():
                v = sorted(x for k, g, x in rows if (k, g) == key and x is not None)
                for name, q in probs.items():
                    pos = (len(v) - 1) * q
                    lo, hi = (math.floor(pos), math.ceil(pos)) if rule == "linear" else (min(math.floor(len(v) * q), len(v) - 1),) * 2 if rule == "upper" else (round(pos),) * 2
                    if rule == "linear" and not math.isfinite(v[lo] + v[hi]):
                        continue
                    assert r[name] == pytest.approx(v[lo] + (v[hi] - v[lo]) * (pos - math.floor(pos)) if rule == "linear" else v[lo], rel=1e-12, abs=0), (rule, key, name)
            whole = stats.quantiles(df, [], "v", {"m": 0.4}, rule).collect()
            assert len(whole) == 1 and list(whole[0].asDict()) == ["m"]
    finally:
        spark.conf.unset(CHUNK_ROWS)
    assert stats.quantiles(df.where("v > 1e300"), ["k"], "v", {"m": 0.5}).where("k <> 'b'").collect() == []


def test_spans_of_values_are_short_expressions(spark):
    """the span of the ninth cut doesn't hold that of each cut before it twice."""
    from tidemark.functions.ordered import _sizes, _starts
    starts = _starts(F.col("x"), _sizes(Cut("x", 4096.0), 9))
    assert len(starts[-1]._jc.toString()) < 500
    rows = spark.range(2000).select((F.col("id") * 13.37 - 9000.1).alias("x")).select("x", *[s.alias(f"s{i}") for i, s in enumerate(starts)]).collect()
    for r in rows:
        assert all(r[f"s{i}"] <= r[f"s{i + 1}"] <= r.x < r[f"s{i}"] + 4096.0 / 64 ** i for i in range(9))


def test_winsorized_scores_shuffle_their_rows_once(spark):
    """F2: one reading of lineitem and one shuffle of the bars for bins, quantiles, moments and scores; a null date is a group."""
    from tidemark.operators.research import winsorize_zscore
    df = QUERIES["x1_winsorized_zscore"](prepare(spark), SMALL)
    df.collect()
    p = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert len([x for x in p.splitlines() if "FileScan" in x]) == 1
    rng, rows = random.Random(2), [("z", 3, 4.0), ("y", 3, 4.0), ("x", 3, None), ("w", 4, None)]
    for d in (1, 2, None):
        rows += [(f"s{i}", d, rng.choice([rng.gauss(0, 1), 5.0, -300.0 * rng.random(), 1e6])) for i in range(400)]
    got = {(r.symbol, r.d): r.zscore for r in winsorize_zscore(spark.createDataFrame(rows, "symbol string, d long, v double"), ["d"], "v", 0.05, 0.9).collect()}
    assert len(got) == 1202
    for d in (1, 2, 3, None):
        v = pd.Series({s: x for s, k, x in rows if k == d and x is not None})
        v = v.clip(v.quantile(0.05), v.quantile(0.9))
        sd = v.std(ddof=0)
        assert all(got[s, d] == pytest.approx((x - v.mean()) / sd if sd > 0 else 0.0, abs=1e-9) for s, x in v.items())


@pytest.mark.parametrize("many", [None, 2])
def test_news_shuffles_found_pairs_only(spark, monkeypatch, many):
    """aliases that are few go to the texts even where a broadcast join isn't chosen; words aren't made again for each run; repeated ids and null texts."""
    from tidemark.operators import select as S
    if many:
        monkeypatch.setattr(S, "MANY", many)
    news = [(1, "The  sun, the Sun"), (1, "red ring"), (2, "red  ring of red rings"), (3, None), (4, ""), (5, "ring. red ring"), (6, "s&p 500 up")]
    names = [("SUN", "sun"), ("R", "Red Ring"), ("R", "ring"), ("S", "s&p 500"), ("S", "up"), (None, "of"), ("Q", None), ("Q", " "), ("T", "the sun the")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = S.relevant_news(spark.createDataFrame(news, "id long, text string"), spark.createDataFrame(names, "asset string, alias string"), F.col("text"), "id")
        got = sorted((r.id, r.asset or "") for r in df.collect())
        p = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == [(1, "R"), (1, "SUN"), (2, ""), (2, "R"), (5, "R"), (6, "S")]
    assert many or "Exchange hashpartitioning(_head" not in p and "SortMergeJoin" not in p and plan(df).count("[^a-z0-9]+") == 1


def random_fills(spark, n=700):
    """Fills with null keys, rows of one second, exits that close all, and fills that are rejected."""
    rng = random.Random(9)
    kinds = ["open_long", "add_long", "reduce_long", "close_long", "open_short", " ADD_short", "close_short", "hold_long", None]
    rows = [(rng.choice(["s", None]), rng.choice(["x", "y", None]), str(i).zfill(4), rng.choice([i // 7, i * 5000, i * 20_000_000]), rng.choice(kinds),
             rng.choice([0.0, None, 1.0, 2.5, 4.0, 0.25]), rng.choice([0.0, 9.0, 10.5, 12.0])) for i in range(n)]
    return spark.createDataFrame(rows, "strategy_id string, symbol string, id string, t long, type string, amount double, price double")


def test_final_sizes_are_folded_without_their_rows(spark):
    """the size after the last fill of each position, with one shuffle of the rows and no job that counts them."""
    fills = random_fills(spark)
    key = ["strategy_id", "symbol", "leg"]
    want = {tuple(r) for r in L.latest(L.virtual_fills(fills), key, ["t", "id"], ["size"]).collect()}
    got = {tuple(r) for r in L.final_sizes(fills).collect()}
    assert got == want and len(got) == 18
    with pytest.raises(Exception, match="no place in its order"):
        L.final_sizes(fills.withColumn("t", F.when(F.col("id") != "0003", F.col("t")))).collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = QUERIES["i8_positions"](prepare(spark), SMALL)
        df.collect()
        p = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len([x for x in p.splitlines() if "Exchange hashpartitioning(l_orderkey" in x]) == 1
    assert p.count("Join") == 1


def test_virtual_fills_shuffle_their_rows_once(spark):
    """sizes, fills, entries and profits of a plain loop, in chunks of any size, with one shuffle of the fills."""
    from tidemark.streaming.flows import next_fill
    fills = random_fills(spark)
    rows, state, want = sorted(fills.collect(), key=lambda r: (r.t, r.id)), {}, {}
    for r in rows:
        leg = next((x for x in ("long", "short") if x in (r.type or "").lower()), "")
        size, entry = state.get((r.strategy_id, r.symbol, leg), (0.0, 0.0))
        size, entry, pnl = next_fill(r.type, r.amount, r.price, leg == "short", size, entry)
        state[r.strategy_id, r.symbol, leg] = size, entry
        want[r.id] = (r.strategy_id, r.symbol, leg, size, round(pnl, 6))
    for most in ("16384", "8"):
        spark.conf.set(CHUNK_ROWS, most)
        try:
            got = {r.id: (r.strategy_id, r.symbol, r.leg, r.size, round(r.realized, 6)) for r in L.virtual_fills(fills).collect()}
        finally:
            spark.conf.unset(CHUNK_ROWS)
        assert got == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = QUERIES["a56_virtual_positions"](prepare(spark), SMALL)
        df.collect()
        p = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    made = [x for x in p.splitlines() if "Exchange hashpartitioning(" in x and "ReusedExchange" not in x]
    assert len([x for x in made if "l_orderkey" in x]) == 1 and len([x for x in made if "REPARTITION_BY_COL" in x]) == 1


def test_excursions_within_a_span_are_shuffled_once(spark):
    """bars are shuffled once for all levels; trades within a span, across spans and levels, without bars, times or symbol, as a plain loop has them."""
    p = panel(spark, n=400, symbols=("a", "b", None)).df.withColumn("high", F.when(F.unix_seconds("ts") % 420 != 0, F.col("high")))
    bars = {}
    for r in p.withColumn("u", F.unix_seconds("ts")).collect():
        bars.setdefault(r.symbol, []).append((r.u, r.high, r.low))
    rng, rows = random.Random(4), []
    for i in range(300):
        start = rng.randrange(0, 24000)
        rows.append((str(i), rng.choice(["a", "b", "none", None]), rng.choice([start, None]) if i % 20 == 0 else start, start + rng.choice([-60, 0, 30, 200, 3000, 20000]), rng.choice([1, -1]), 20.0 + rng.randrange(-8, 8) / 4, None if i % 3 else "x"))
    trades = spark.createDataFrame(rows, "id string, symbol string, entry_t long, exit_t long, direction int, entry double, note string")
    want = {}
    for i, s, a, b, way, e, note in rows:
        held = [x for x in bars.get(s, []) if s and a is not None and a <= x[0] <= b]
        hi, lo = max([e] + [h for _, h, _ in held if h is not None]), min([e] + [x for *_, x in held])
        up, down = (hi - e) / e, (e - lo) / e
        want[i] = (s, a, b, note, *((down, up) if way > 0 else (up, down)))
    for width in (4, 64):
        out = X.excursions(trades, p, 60, width)
        assert out.columns == [*trades.columns, "mae", "mfe"]
        got = {r.id: (r.symbol, r.entry_t, r.exit_t, r.note, r.mae, r.mfe) for r in out.collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = QUERIES["w27_excursions"](prepare(spark), SMALL)
        df.collect()
        p = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len([x for x in p.splitlines() if "FileScan" in x]) == 3
