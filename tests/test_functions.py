"""Exact statistics, clusters, snapshots and strict readers against plain Python."""

from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.ordered import path
from tidemark.functions.stats import average_ranks, bucket_of_rank, cross_ranks, normal_cdf, normal_ppf, quantiles
from tidemark.model import Panel
from tidemark.operators.factors import FactorError, factor_series, list_factors
from tidemark.operators.features import support_resistance
from tidemark.operators.joins import asof
from tidemark.operators.ledger import virtual_fills
from tidemark.operators.splits import parameter_grid, split_by_constraints, walk_forward_folds
from tidemark.sources.bars import BarError, collapse_duplicates, load_snapshot, read_bars_csv, save_snapshot
from tidemark.streaming.flows import next_fill


def bars(spark, n=160, symbols=("a", "b"), seed=3):
    rng = np.random.default_rng(seed)
    parts = []
    for s in symbols:
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        parts.append(pd.DataFrame({"symbol": s, "ts": pd.date_range("2024-01-01", periods=n), "open": close, "high": close * 1.01,
                                   "low": close * 0.99, "close": close, "volume": rng.integers(1, 99, n).astype(float)}))
    pdf = pd.concat(parts, ignore_index=True)
    return Panel(spark.createDataFrame(pdf), 86400), pdf


def test_normal_distribution(spark):
    xs = [-9.0, -3.2, -1.0, 0.0, 0.3, 2.5, 7.5]
    ps = [1e-9, 0.01, 0.2, 0.5, 0.9, 0.999999]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", normal_cdf(F.col("x")).alias("y")).collect()
    assert all(abs(r["y"] - NormalDist().cdf(r["x"])) < 1e-13 for r in got)
    inv = spark.createDataFrame([(p,) for p in ps], "p double").select("p", normal_ppf(F.col("p")).alias("y")).collect()
    assert all(abs(r["y"] - NormalDist().inv_cdf(r["p"])) < 1e-9 for r in inv)


def test_quantiles_and_ranks_with_a_hot_group(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": ["hot"] * 900 + ["cold"] * 50, "v": np.round(rng.normal(size=950), 1)})
    df = spark.createDataFrame(pdf)
    got = {r["k"]: r for r in quantiles(df, ["k"], "v", {"a": 0.05, "b": 0.5}).collect()}
    for k, g in pdf.groupby("k"):
        assert abs(got[k]["a"] - g.v.quantile(0.05)) < 1e-12 and abs(got[k]["b"] - g.v.median()) < 1e-12
    want = sorted(pdf.groupby("k").v.rank().tolist())
    assert sorted(r["r"] for r in average_ranks(df, ["k"], {"v": "r"}).collect()) == want
    assert sorted(r["r"] for r in cross_ranks(df, ["k"], "v", avg="r").collect()) == want


@pytest.mark.parametrize("n,q", [(3, 2), (11, 5), (37, 10), (100, 7), (200, 20)])
def test_buckets_are_those_of_qcut(spark, n, q):
    df = spark.range(1, n + 1).select(F.col("id").alias("r"), bucket_of_rank(F.col("id"), F.lit(n), q).alias("b"))
    want = pd.qcut(pd.Series(range(1, n + 1)), q, labels=False) + 1
    assert [r["b"] for r in df.orderBy("r").collect()] == want.tolist()


def test_every_factor_has_finite_values(spark):
    panel, _ = bars(spark, 320, ("a",))
    names = [f["factor_id"] for f in list_factors(factor_type="technical")]
    assert len(names) == 54
    for name in names[::6]:
        rows = factor_series(panel, name).collect()
        assert rows and all(np.isfinite(r["value"]) for r in rows), name


def test_factor_parameters_are_checked(spark):
    panel, _ = bars(spark, 40)
    for bad in ({"period": 1}, {"period": 5001}, {"nothing": 3}):
        with pytest.raises(FactorError):
            factor_series(panel, "sma", **bad)


def test_values_do_not_change_when_later_bars_go(spark):
    panel, _ = bars(spark)
    cut = panel.replace(panel.df.where("ts < '2024-05-01'"))
    for name in ("rsi", "hma"):
        full = {(r["symbol"], r["ts"]): r["value"] for r in factor_series(panel, name).collect()}
        part = factor_series(cut, name).collect()
        assert part and all(abs(full[(r["symbol"], r["ts"])] - r["value"]) < 1e-9 for r in part)


def test_support_and_resistance_match_a_plain_loop(spark):
    panel, pdf = bars(spark, 150, ("a",))
    got = {r["ts"]: r for r in support_resistance(panel).collect()}
    high, low, close = (pdf[x].tolist() for x in ("high", "low", "close"))
    for i in (5, 60, 149):
        start = max(0, i - 120)
        hs = [high[j] for j in range(start + 2, i - 2) if high[j] >= max(high[j - 2], high[j - 1], high[j + 1], high[j + 2])]
        tr = [max(high[j] - low[j], abs(high[j] - close[j - 1]), abs(low[j] - close[j - 1])) for j in range(max(1, i - 13), i + 1)]
        tol = max(sum(tr) / len(tr) * 0.35, close[i] * 0.002)
        groups = []
        for v in sorted(hs + [max(high[start:i])]):
            near = next((g for g in groups if abs(v - sum(g) / len(g)) <= tol), None)
            groups.append([v]) if near is None else near.append(v)
        found = [(round(sum(g) / len(g), 8), len(g)) for g in groups]
        best = sorted((x for x in found if x[0] >= close[i] - tol), key=lambda x: (abs(x[0] - close[i]), -x[1]))[:3]
        row = got[pdf.ts[i]]
        assert [x["price"] for x in row["resistances"]] == pytest.approx([b[0] for b in best])
        assert [x["touches"] for x in row["resistances"]] == [b[1] for b in best]


def test_snapshot_round_trip(spark, tmp_path):
    panel, _ = bars(spark, 30)
    sid = save_snapshot(panel, str(tmp_path))
    assert load_snapshot(spark, str(tmp_path), sid, 86400).df.count() == 60
    other = panel.replace(panel.df.withColumn("close", F.col("close") + 1))
    other.df.write.mode("overwrite").parquet(f"{tmp_path}/snapshot_id={sid}")
    with pytest.raises(BarError):
        load_snapshot(spark, str(tmp_path), sid, 86400)


def test_csv_reader_names_the_bad_line(spark, tmp_path):
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    good.write_text("t,open,high,low,close,volume\n1,1,2,1,2,5\n2,1,2,1,2,5\n")
    bad.write_text("t,open,high,low,close,volume\n1,1,2,1,2,5\n1,1,2,1,2,5\n")
    assert read_bars_csv(spark, str(good)).count() == 2
    with pytest.raises(BarError, match="order"):
        read_bars_csv(spark, str(bad))


def test_conflicting_duplicates_fail(spark):
    panel, _ = bars(spark, 5, ("a",))
    assert collapse_duplicates(panel.df.unionByName(panel.df)).count() == 5
    clash = panel.df.unionByName(panel.df.withColumn("close", F.col("close") + 1))
    with pytest.raises(Exception, match="conflicting duplicate"):
        collapse_duplicates(clash).collect()


def test_walk_forward_plan_and_grid(spark):
    sizes = spark.createDataFrame([("a", 400), ("short", 30)], "k string, n long")
    plan = {(r["fold"], r["role"]): (r["first"], r["last"]) for r in walk_forward_folds(sizes, 4, 0.5, 0.1, warmup=10, embargo=2).collect() if r["k"] == "a"}
    assert plan[0, "blind"] == (360, 399) and plan[1, "train"][1] + 3 == plan[1, "validation"][0]
    assert plan[4, "validation"][1] == 357 and len(plan) == 9
    assert walk_forward_folds(sizes.where("k = 'short'"), 2, 0.5, 0.0).count() == 0
    grid = parameter_grid(spark, {"fast": [1, 2, 3], "slow": [2, 4]})
    good, bad = split_by_constraints(grid, "fast < slow")
    assert (grid.count(), good.count(), bad.count()) == (6, 4, 2)
    assert parameter_grid(spark, {"a": list(range(20)), "b": list(range(20))}, limit=50).count() == 50


FILLS = [("open_long", 2.0, 10.0), ("close_long", 0.0, 20.0), ("open_long", 3.0, 12.0), (" ADD_long ", 1.0, 16.0), ("reduce_long", 1.5, 0.0), ("reduce_long", 1.5, 15.0),
         ("close_long", None, 14.0), ("close_long", 1.0, 9.0), ("open_long", 0.0, 9.0), ("hold_long", 1.0, 9.0), ("open_long", 1.0, 30.0), ("close_long", 9.0, 31.0)]


def test_fills_close_all_and_reject(spark):
    """Batch and stream follow one rule for fills, also where an exit has no quantity or a fill no price."""
    rows = [("s", "x", str(i).zfill(2), i, k, a, p) for i, (k, a, p) in enumerate(FILLS)]
    df = spark.createDataFrame(rows, "strategy_id string, symbol string, id string, t long, type string, amount double, price double")
    got = {r["id"]: r for r in virtual_fills(df, ["strategy_id", "symbol"], ("t", "id")).collect()}
    size = entry = 0.0
    for i, (k, a, p) in enumerate(FILLS):
        size, entry, pnl = next_fill(k, a, p, False, size, entry)
        r = got[str(i).zfill(2)]
        assert (r["size"], round(r["realized"], 9)) == (size, round(pnl, 9)), (i, r)
    assert got["01"]["fill"] == 2 and got["01"]["realized"] == 20 and got["07"]["status"] == "no_position" and got["09"]["status"] == "rejected"


def test_nan_has_no_rank(spark):
    df = spark.createDataFrame([("a", float("nan")), ("a", 1.0), ("a", -5.0), ("a", None)], "k string, v double")
    assert sorted(r["r"] for r in cross_ranks(df, ["k"], "v", avg="r").collect()) == [1.0, 2.0]


def test_asof_keeps_rows_without_key_or_time(spark):
    left = spark.createDataFrame([(1, "a", 10), (2, "a", None), (3, None, 10), (4, "b", 10)], "id long, k string, t long")
    right = spark.createDataFrame([("a", 5, 1.0), ("a", None, 9.0), (None, 5, 7.0), ("a", 11, 2.0)], "k string, t long, v double")
    got = {r["id"]: r["m"] and r["m"]["v"] for r in asof(left, right, ["k"], F.col("t"), F.col("t"), 4, ["v"], "m").collect()}
    assert got == {1: 1.0, 2: None, 3: None, 4: None}


def test_path_keeps_null_keys_and_refuses_rows_without_a_time(spark):
    schema = "k string, t long, x double"
    df = spark.createDataFrame([("a", 1, 1.0), (None, 2, 1.0), (None, 9, 2.0)], schema)
    assert sorted(r["equity"] for r in path(df, ["k"], ["t"], F.floor(F.col("t") / 4), F.col("x")).collect()) == [1.0, 1.0, 3.0]
    df = spark.createDataFrame([("a", 1, 1.0), ("a", None, 1.0)], schema)
    with pytest.raises(Exception, match="no place in its path"):
        path(df, ["k"], ["t"], F.col("t"), F.col("x")).collect()
