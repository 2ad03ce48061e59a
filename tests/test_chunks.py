"""Dense keys are cut by counts, null keys and missing bars lose nothing."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.folds import affine
from tidemark.functions.ordered import Cut, chunked, number, path, scan
from tidemark.functions.smoothing import smoothed
from tidemark.functions.stats import average_ranks, cross_ranks, quantiles
from tidemark.model import Panel
from tidemark.operators.factors import factor_panel
from tidemark.operators.features import excursions
from tidemark.operators.joins import asof
from tidemark.operators.ledger import fee_increments, ledger_grain, virtual_fills
from tidemark.operators.userdef import choices, declared, span, swept, trials
from tidemark.session import CHUNK_ROWS, prepare
from tidemark.streaming import flows as S


@pytest.fixture()
def small(spark):
    prepare(spark)
    spark.conf.set(CHUNK_ROWS, "24")
    yield spark
    spark.conf.unset(CHUNK_ROWS)


def ledger(spark, n=900):
    """Half of all rows under one key, most of them in one day; some rows without a key."""
    rng = random.Random(4)
    rows = []
    for i in range(n):
        key = "hot" if i % 2 else rng.choice(["a", "b", None])
        t = 1_700_000_000 + (rng.randrange(86400) if key == "hot" and i % 10 else rng.randrange(400 * 86400))
        rows.append((key, t, f"{i:05d}", float(rng.randrange(-50, 60))))
    return spark.createDataFrame(rows, "key string, t long, id string, x double"), rows


def test_no_chunk_above_the_bound(small):
    df, rows = ledger(small)
    cut = chunked(df, ["key"], ledger_grain())
    assert cut.count() == len(rows)
    most = cut.groupBy("key", "_b").agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("hi"), F.min("t").alias("lo"))
    assert most.agg(F.max("n")).first()[0] <= 24
    spans = sorted((r.key or "", r._b, r.lo, r.hi) for r in most.collect())
    assert all(a[0] != b[0] or a[3] < b[2] for a, b in zip(spans, spans[1:])) and all(b <= lo for _, b, lo, _ in spans)  # order is kept


def test_rows_of_one_second_stay_together(small):
    df = small.createDataFrame([("k", 5, str(i)) for i in range(60)] + [("k", 6, "z")], "key string, t long, id string")
    cut = chunked(df, ["key"], Cut("t", 3600))
    assert {(r._b, r["count"]) for r in cut.groupBy("_b").count().collect()} == {(5, 60), (6, 1)}


def test_scan_path_affine_keep_null_keys(small):
    df, rows = ledger(small)
    pdf = pd.DataFrame(rows, columns=["key", "t", "id", "x"]).sort_values(["t", "id"])
    by = pdf.groupby("key", dropna=False)["x"]
    want = dict(zip(pdf["id"], zip(by.cumsum(), by.cummax(), by.cumcount()), strict=True))
    got = scan(number(df, ["key"], ["t", "id"], ledger_grain()), ["key"], ["t", "id"], ledger_grain(), s=("sum", "x"), m=("max", "x")).collect()
    assert {r.id: (r.s, r.m, r.pos) for r in got} == want
    top = {i: max(0.0, v) for i, v in zip(pdf["id"], by.cumsum().groupby(pdf["key"].fillna("")).cummax(), strict=True)}
    p = path(df, ["key"], ["t", "id"], ledger_grain(), F.col("x")).collect()
    assert {r.id: (r.equity, r.peak) for r in p} == {i: (want[i][0], top[i]) for i in want}
    y, out = {}, {}
    for k, _, i, x in pdf[["key", "t", "id", "x"]].itertuples(index=False):
        k = k if isinstance(k, str) else None
        y[k] = out[i] = 0.5 * y.get(k, 0.0) + x
    a = affine(df, ["key"], ["t", "id"], ledger_grain(), F.lit(0.5), F.col("x"), "y").collect()
    assert {r.id: round(r.y, 9) for r in a} == {i: round(v, 9) for i, v in out.items()}


def test_a_row_without_a_place_fails(small):
    df = small.createDataFrame([("a", 1, "x", 1.0), ("a", None, "y", 1.0)], "key string, t long, id string, x double")
    for made in (lambda: scan(df, ["key"], ["t"], ledger_grain(), s=("sum", "x")), lambda: scan(df, ["key"], ["t"], F.floor(F.col("t") / 5), s=("sum", "x")), lambda: path(df, ["key"], ["t"], ledger_grain(), F.col("x"))):
        with pytest.raises(Exception, match="no place in its (order|path)"):
            made().collect()


def test_ledgers_keep_rows_with_null_keys(small):
    rows = [(None, "X", "open_long", 2.0, 10.0, 1, "a"), (None, "X", "close_long", None, 12.0, 2, "b"), (1, None, "open_long", 1.0, 5.0, 3, "c"), (1, "X", "open_long", 1.0, 5.0, 4, "d")]
    f = small.createDataFrame(rows, "strategy_id long, symbol string, type string, amount double, price double, t long, id string")
    got = {r.id: (r.fill, r.size, r.realized) for r in virtual_fills(f).collect()}
    assert got == {"a": (2.0, 2.0, 0.0), "b": (2.0, 0.0, 4.0), "c": (1.0, 1.0, 0.0), "d": (1.0, 1.0, 0.0)}
    u = small.createDataFrame([(None, 1, "a", 2.0), (None, 2, "b", 5.0), ("o", 1, "c", 1.0)], "order_id string, t long, id string, cumulative double")
    assert {r.id: r.filled for r in S.deltas(u, "order_id", ["t", "id"], ledger_grain()).collect()} == {"a": 2.0, "b": 3.0, "c": 1.0}
    assert {r.id for r in S.changed(u, "order_id", ["t", "id"], ledger_grain(), F.col("cumulative") > 3).collect()} == {"a", "b", "c"}
    fees = u.select("order_id", "t", "id", F.create_map(F.lit("USDT"), "cumulative").alias("fees"))
    assert {r.id: r.fee for r in fee_increments(fees, "order_id", ["t", "id"], ledger_grain()).collect()} == {"a": 2.0, "b": 3.0, "c": 1.0}


def test_asof_of_a_dense_key(small):
    rng = random.Random(2)
    right = [("k" if i % 3 else None, rng.randrange(5000), float(i)) for i in range(300)]
    left = [(i, "k" if i % 4 else None, rng.randrange(5000) if i % 7 else None) for i in range(300)]
    r = small.createDataFrame(right, "key string, at long, v double")
    x = small.createDataFrame(left, "id long, key string, t long")
    got = {q.id: q.m.v if q.m else None for q in asof(x, r, ["key"], F.col("t"), F.col("at"), 10**6, ["v"], "m", tie=["v"]).collect()}
    want = {i: max([(at, v) for k, at, v in right if k == key and at <= t], default=(0, None))[1] if key is not None and t is not None else None for i, key, t in left}
    assert got == want


def test_quantiles_and_ranks_of_a_dense_group(small):
    rng = random.Random(6)
    rows = [("hot" if i % 3 else "cold", rng.choice([-1e12, -3.5, 0.0, 1e-9, 7.0]) if i % 5 == 0 else rng.uniform(-1, 1) * 10 ** rng.randrange(-3, 6), i) for i in range(700)]
    rows += [("hot", float("inf"), 1000), ("cold", float("-inf"), 1001)]
    df = small.createDataFrame(rows, "g string, x double, i long")
    pdf = pd.DataFrame(rows, columns=["g", "x", "i"])
    q = {r.g: r.m for r in quantiles(df.where("abs(x) < 1e300"), ["g"], "x", {"m": 0.37}).collect()}
    want = pdf[np.isfinite(pdf["x"])].groupby("g")["x"].quantile(0.37)
    assert all(math.isclose(q[g], want[g], rel_tol=1e-12) for g in want.index)
    rank = pdf.groupby("g")["x"].rank()
    assert {r.i: r.r for r in average_ranks(df, ["g"], {"x": "r"}).collect()} == dict(zip(pdf["i"], rank, strict=True))
    got = cross_ranks(df, ["g"], "x", avg="a", first="f", tie="i", size="n").collect()
    first = pdf.sort_values("i").groupby("g")["x"].rank(method="first")
    assert {r.i: (r.a, r.f, r.n) for r in got} == {i: (a, int(first[k]), int((pdf["g"] == g).sum())) for k, (i, a, g) in enumerate(zip(pdf["i"], rank, pdf["g"], strict=True))}


# --- smoothings --------------------------------------------------------------------------

def smooth(values, n, k):
    y, seen, out = None, [], []
    for v in values:
        if v is not None:
            seen.append(v)
            y = sum(seen[:n]) / n if len(seen) == n else (y + k * (v - y) if y is not None else None)
        out.append(y)
    return out


@pytest.mark.parametrize("n,k", [(1, 0.5), (3, 0.5), (14, 1 / 14), (20, 2 / 21), (2, 0.99), (40, 0.004)])
def test_smoothing_equals_a_loop(small, n, k):
    rng = random.Random(n)
    rows = [(s, i, None if rng.random() < 0.2 else rng.uniform(50, 150)) for s in ("a", None) for i in range(400)] + [("empty", i, None) for i in range(5)]
    df = small.createDataFrame(rows, "key string, t long, v double")
    got = {(r.key, r.t): r.y for r in smoothed(df, ["key"], ["t"], F.floor(F.col("t") / 20), "v", n, k, "y").collect()}
    for key in ("a", None, "empty"):
        own = [r for r in rows if r[0] == key]
        for (_, t, _), w in zip(own, smooth([v for *_, v in own], n, k), strict=True):
            assert (got[key, t] is None) == (w is None) and (w is None or math.isclose(got[key, t], w, rel_tol=1e-12))


def test_catalogue_goes_on_after_missing_bars(small):
    """Against pandas-like loops over bars with gaps: the missing values are left out, the rows stay."""
    rng = random.Random(1)
    rows, close = [], 100.0
    for i in range(96):
        close += rng.uniform(-2, 2)
        gone = i in (0, 17, 40, 41, 70)
        rows.append(("s", i * 60, None if gone else close, None if gone else close + rng.random(), None if gone else close - rng.random(), close, 10.0 + i))
    df = small.createDataFrame(rows, "symbol string, t long, open double, high double, low double, close double, volume double").withColumn("ts", F.timestamp_seconds("t"))
    df = df.withColumn("close", F.when(F.col("open").isNotNull(), F.col("close")))
    wanted = {"atr": {}, "atr_pct": {}, "elder_ray": {}, "keltner_channels": {"output": "upper"}, "force_index": {}, "ema": {}}
    got = factor_panel(Panel(df, 60), wanted).orderBy("ts").collect()
    bars = [(r[3], r[4], None if r[2] is None else r[5], r[6]) for r in rows]
    tr = []
    for i, (h, lo, _, _) in enumerate(bars):
        before = bars[i - 1][2] if i else None
        tr.append(None if h is None else max([h - lo] + ([] if before is None else [abs(h - before), abs(lo - before)])))
    atr, atr10 = smooth(tr, 14, 1 / 14), smooth(tr, 10, 1 / 10)
    ema = {n: smooth([b[2] for b in bars], n, 2 / (n + 1)) for n in (13, 20)}
    force = smooth([(bars[i][2] - bars[i - 1][2]) * bars[i][3] if i and bars[i][2] is not None and bars[i - 1][2] is not None else None for i in range(96)], 13, 2 / 14)
    near = lambda a, b: a is None and b is None or a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9)
    by_time = {int(r.ts.timestamp()) // 60: r for r in got}
    for i in range(30, 96):
        r = by_time[i]
        assert near(r.atr, atr[i]), (i, r.atr, atr[i])
        assert near(r.keltner_channels, ema[20][i] + 2.0 * atr10[i])
        assert near(r.force_index, force[i])
        if bars[i][2] is not None:
            assert near(r.atr_pct, atr[i] / bars[i][2]) and near(r.elder_ray, bars[i][0] - ema[13][i]) and near(r.ema, ema[20][i])


def test_supertrend_survives_missing_bars(small):
    rng = random.Random(3)
    rows, close = [], 100.0
    for i in range(200):
        close += rng.uniform(-2, 2)
        rows.append(("s", i * 60, close, close + rng.random(), close - rng.random(), close, 1.0) if i not in (3, 50, 51, 120) else ("s", i * 60, None, None, None, None, None))
    df = small.createDataFrame(rows, "symbol string, t long, open double, high double, low double, close double, volume double").withColumn("ts", F.timestamp_seconds("t"))
    got = {int(r.ts.timestamp()) // 60: r.value for r in factor_panel(Panel(df, 60), {"value": {"factor": "supertrend", "output": "line"}}).collect()}
    bars = [(r[3], r[4], r[5]) for r in rows]
    tr = [None if h is None else max([h - lo] + ([] if not i or bars[i - 1][2] is None else [abs(h - bars[i - 1][2]), abs(lo - bars[i - 1][2])])) for i, (h, lo, _) in enumerate(bars)]
    atr, up, low, side = smooth(tr, 10, 0.1), None, None, 1
    for i, (h, lo, cl) in enumerate(bars):
        if atr[i] is None:
            continue
        before = bars[i - 1][2]
        if h is not None:
            u, d = (h + lo) / 2 + 3 * atr[i], (h + lo) / 2 - 3 * atr[i]
            if up is None:
                up, low = u, d
                continue
            up = u if u < up or before is not None and before > up else up
            low = d if d > low or before is not None and before < low else low
            side = 1 if side < 0 and cl > up else -1 if side > 0 and cl < low else side
        assert math.isclose(got[i], low if side > 0 else up, rel_tol=1e-9), i


# --- excursions, declared parameters ------------------------------------------------------

@pytest.mark.parametrize("width", [2, 3, 64])
def test_excursions_of_any_length(small, width):
    """Trades within a span, over several and over spans of spans; bars with gaps, equal trades, trades without bars."""
    rng = random.Random(width)
    bars = [(s, 10 * i, rng.uniform(100, 200), rng.uniform(1, 100)) for s in "ab" for i in range(300) if rng.random() < 0.8]
    trades = [(i, rng.choice("abc"), a, a + rng.choice([0, 9, 40, 400, 2500]), rng.choice([1, -1]), 100.0) for i in range(150) for a in [rng.randrange(-50, 2900)]]
    trades += [trades[0], (900, "a", 50, 20, 1, 100.0), (901, None, 0, 50, 1, 100.0), (902, "a", None, 50, 1, 100.0)]
    b = small.createDataFrame(bars, "symbol string, t long, high double, low double").withColumn("ts", F.timestamp_seconds("t"))
    t = small.createDataFrame(trades, "id long, symbol string, entry_t long, exit_t long, direction int, entry double")
    want = []
    for i, s, a, z, d, e in trades:
        own = [(h, lo) for q, u, h, lo in bars if q == s and a is not None and a <= u <= z]
        hi, lo = max([e, *[h for h, _ in own]]), min([e, *[x for _, x in own]])
        want.append((i, round(((e - lo) if d > 0 else (hi - e)) / e, 9), round(((hi - e) if d > 0 else (e - lo)) / e, 9)))
    got = [(r.id, round(r.mae, 9), round(r.mfe, 9)) for r in excursions(t, b, 10, width).collect()]
    assert sorted(got) == sorted(want)


def test_declared_parameters():
    def f(pdf, fast=span(5, 3, 7, 2), ratio=span(0.5, 0.1, 0.3, 0.1), mode="x", slow=choices(20, 10, 20, 10), still=span(4, 5, 1, 2)):
        return pdf

    known = declared(f)
    assert known["fast"].values == (3, 5, 7) and known["ratio"].values == (0.1, 0.2, 0.3) and known["slow"].values == (10, 20) and known["still"].values == () and known["mode"].default == "x"
    todo = trials(f, {"slow": [1, 2, 3]}, {"ratio": 0.2})
    assert len(todo) == 9 and todo[0] == {"fast": 3, "ratio": 0.2, "mode": "x", "slow": 1, "still": 4}
    for wrong in (lambda: trials(f, {"strange": [1]}), lambda: trials(f, most=5), lambda: span(1, 0, 5000, 1), lambda: declared(lambda pdf, x: pdf)):
        with pytest.raises(ValueError):
            wrong()


def test_sweep_equals_single_runs(small):
    df = small.createDataFrame([(s, 60 * i, float(i % 7 + (s == "b")), 1.0) for s in "ab" for i in range(80)], "symbol string, t long, close double, volume double")
    df = df.select("symbol", F.timestamp_seconds("t").alias("ts"), *[F.col("close").alias(n) for n in ("open", "high", "low", "close")], "volume")

    def f(pdf, n=choices(2, 2, 5), shift=span(0, 0, 1, 1)):
        return pdf.assign(y=pdf["close"].rolling(n).sum() + shift)

    got = {(r.symbol, r.ts, r.n, r.shift): r.y for r in swept(Panel(df, 60), f, {"y": "double"}, 6, block=3).where("pos >= 5").collect()}
    pdf = df.toPandas().sort_values(["symbol", "ts"])
    want = {}
    for n in (2, 5):
        for k in (0, 1):
            y = pdf.groupby("symbol")["close"].rolling(n).sum().reset_index(level=0, drop=True) + k
            want |= {(s, t.to_pydatetime(), n, k): v for s, t, v, p in zip(pdf["symbol"], pdf["ts"], y, pdf.groupby("symbol").cumcount(), strict=True) if p >= 5}
    assert got == want
