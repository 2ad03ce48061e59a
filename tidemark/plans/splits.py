"""Splits, resampling statistics and grids over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.registry import query
from tidemark.operators import splits as V
from tidemark.operators.features import windowed
from tidemark.plans.standins import hourly, seconds, table, weekly, with_sql

c, lit, when = F.col, F.lit, F.when
R = lambda n, *names: [F.round(x, n).alias(x) for x in names]
P = 2147483647


def sql_draw(n, path, i, seed):
    x = f"(({seed} + {path} * 7919 + {i} * 104729) % {P})"
    x = f"(({x} * 48271 + {path}) % {P})"
    x = f"(({x} * 69621 + {i}) % {P})"
    return f"(({x} * 16807 % {P}) % {n})"


def dated(spark, d):
    return weekly(spark, d).number().df.select("symbol", "pos")


WF = """n AS (SELECT symbol, count(*) AS n FROM x GROUP BY 1), a AS (SELECT symbol, n, n - 74 AS room, CASE WHEN n // 10 > 0 AND n - 76 >= 10 THEN least(greatest(n // 10, 10), n - 76) ELSE 0 END AS blind FROM n WHERE n >= 74),
 b AS (SELECT *, n - blind - CASE WHEN blind > 0 THEN 2 ELSE 0 END AS e FROM a), d AS (SELECT *, least(e - 24, greatest(50, e // 2)) AS s FROM b), h AS (SELECT *, least(3, (e - s) // 12) AS m FROM d),
 f AS (SELECT symbol, k AS fold, s + (k - 1) * ((e - s) // m) AS o, CASE WHEN k = m THEN e ELSE s + k * ((e - s) // m) END AS z FROM h, range(1, 4) r(k) WHERE k <= m),
 w AS (SELECT symbol, fold, 'train' AS role, 0 AS a, o - 1 AS b FROM f UNION ALL SELECT symbol, fold, 'validation', o + 2, z - 1 FROM f UNION ALL SELECT symbol, 0, 'blind', n - blind, n - 1 FROM h WHERE blind > 0)"""


@query("v1_walk_forward", with_sql("x", more=WF) + "SELECT symbol, fold, role, count(*) AS rows, min(pos) AS first, max(pos) AS last FROM x JOIN w USING (symbol) WHERE pos BETWEEN a AND b GROUP BY 1, 2, 3")
def _(spark, d):
    x = dated(spark, d)
    spans = V.walk_forward_folds(x.groupBy("symbol").agg(F.count(lit(1)).alias("n")), 3, 0.5, 0.1, warmup=10, embargo=2)
    return V.tag_folds(x, ["symbol"], "pos", spans).groupBy("symbol", "fold", "role").agg(F.count(lit(1)).alias("rows"), F.min("pos").alias("first"), F.max("pos").alias("last"))


@query("v2_rolling_folds", with_sql("x", more="n AS (SELECT symbol, count(*) AS n FROM x GROUP BY 1)") + "SELECT symbol, k AS fold, k * 20 AS is_start, k * 20 + 100 AS is_end, k * 20 + 130 AS oos_end FROM n, range(50) r(k) WHERE k * 20 + 130 <= n")
def _(spark, d):
    n = dated(spark, d).groupBy("symbol").agg(F.count(lit(1)).alias("n"))
    return V.rolling_folds(n, 100, 30, 20).select("symbol", "fold", "is_start", "is_end", "oos_end")


def purged(spark, d):
    x = dated(spark, d)
    return V.purged_splits(x.join(x.groupBy("symbol").agg(F.count(lit(1)).alias("n")), "symbol"), "pos", "n", 6, 2, 4, 5)


SPLIT = """n AS (SELECT symbol, pos, count(*) OVER (PARTITION BY symbol) AS n FROM x), s AS (SELECT m AS split, list_filter(range(6), lambda k: (m >> k) & 1 = 1) AS b FROM range(64) r(m) WHERE bit_count(CAST(m AS INTEGER)) = 2),
 k AS (SELECT symbol, pos, n, split, len(list_filter(range(6), lambda z: ((z + 1) * n + 5) // 6 <= pos)) AS blk, (b[1] * n + 5) // 6 AS t0, ((b[2] + 1) * n + 5) // 6 AS t1 FROM n, s),
 z AS (SELECT symbol, pos, CAST(split AS INTEGER) AS split, t0, t1, CASE WHEN (split >> blk) & 1 = 1 THEN 'test' WHEN NOT ((pos + 4 >= t0 AND pos < t1) OR (pos >= t1 AND pos < t1 + 5)) THEN 'train' END AS role FROM k)"""


@query("v3_purged_splits", with_sql("x", more=SPLIT) + "SELECT split, role, count(*) AS rows, CAST(sum(pos) AS BIGINT) AS places FROM z WHERE role IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    return purged(spark, d).groupBy("split", "role").agg(F.count(lit(1)).alias("rows"), F.sum("pos").alias("places"))


@query("v4_contiguous_runs", with_sql("x", more="k AS (SELECT symbol, pos, pos - row_number() OVER (PARTITION BY symbol ORDER BY pos) AS g FROM x WHERE CAST(volume AS BIGINT) % 5 <> 0)") + "SELECT symbol, min(pos) AS start, max(pos) + 1 AS end FROM k GROUP BY symbol, g HAVING count(*) >= 4")
def _(spark, d):
    x = weekly(spark, d).number().df.where(c("volume").cast("long") % 5 != 0).select("symbol", "pos")
    return V.contiguous_runs(x, ["symbol"], "pos", 4)


@query("v5_first_leak", with_sql("x", more=SPLIT) + "SELECT symbol, split, min(CASE WHEN role = 'train' AND pos + 40 >= t0 AND pos < t0 THEN pos WHEN role = 'train' AND pos >= t1 AND pos < t1 + 5 THEN pos END) AS leak FROM z GROUP BY 1, 2 HAVING count(*) FILTER (role = 'test') > 0")
def _(spark, d):
    return V.first_leak(purged(spark, d), ["symbol", "split"], "pos", 40, 5)


def hourly_returns(spark, d):
    p = hourly(spark, d)
    fr, _, df = windowed(p.replace(p.df.withColumn("close", c("close") + 10)), 1)
    return fr.own(df).where("ret IS NOT NULL").select("symbol", (c("pos") - 1).alias("i"), (c("ret") / 50).alias("r"))


RET = """hr AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY t) - 2 AS i, ((close + 10) / lag(close + 10) OVER (PARTITION BY symbol ORDER BY t) - 1) / 50 AS r FROM hbars), re AS (SELECT * FROM hr WHERE r IS NOT NULL), n AS (SELECT symbol, count(*) AS n FROM re GROUP BY 1)"""
BOOT = RET + f""", b AS (SELECT *, greatest(1, least(12, CAST(round(power(n, 1.0 / 3)) AS BIGINT), n - 1)) AS b FROM n), s AS (SELECT symbol, n, b, p, k, {sql_draw('n', 'p', 'k', 7)} AS s FROM b, range(20) r(p), range(1000) q(k) WHERE k <= (n - 1) // b),
 w AS (SELECT symbol, p AS path, k * b + o AS step, (s + o) % n AS i FROM s, range(12) r(o) WHERE o < b AND k * b + o < n), x2 AS (SELECT w.*, r FROM w JOIN re USING (symbol, i))"""
STATS = """, e AS (SELECT *, product(1 + r) OVER (PARTITION BY symbol, path ORDER BY step ROWS UNBOUNDED PRECEDING) AS eq FROM x2), f AS (SELECT *, greatest(1, max(eq) OVER (PARTITION BY symbol, path ORDER BY step ROWS UNBOUNDED PRECEDING)) AS pk, sum(CASE WHEN r > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, path ORDER BY step ROWS UNBOUNDED PRECEDING) AS isle FROM e),
 l AS (SELECT symbol, path, max(n) AS loss_streak FROM (SELECT symbol, path, isle, count(*) AS n FROM f WHERE r <= 0 GROUP BY 1, 2, 3) GROUP BY 1, 2)"""
OUT = " SELECT symbol, CAST(path AS INTEGER) AS path, round(last(eq ORDER BY step) - 1, 6) AS total_return, round(max((pk - eq) / pk), 6) AS max_drawdown, round(avg(r) / stddev_pop(r), 6) AS sharpe, max(loss_streak) AS loss_streak FROM f JOIN l USING (symbol, path) GROUP BY 1, 2"


def _stats(x):
    return V.path_stats(x, "symbol").select("symbol", "path", *R(6, "total_return", "max_drawdown", "sharpe"), "loss_streak")


@query("v6_block_bootstrap", with_sql("hbars", more=BOOT + STATS) + OUT)
def _(spark, d):
    return _stats(V.bootstrap(hourly_returns(spark, d), "symbol", 20, 12, 7))


@query("v7_shuffled_paths", with_sql("hbars", more=RET + f", x2 AS (SELECT symbol, p AS path, r, row_number() OVER (PARTITION BY symbol, p ORDER BY {sql_draw(P, 'p', 'i', 9)}, i) - 1 AS step FROM re, range(10) q(p))" + STATS) + OUT)
def _(spark, d):
    return _stats(V.shuffled(hourly_returns(spark, d), "symbol", 10, 9))


@query("v8_stationary_indices", with_sql("hbars", more=RET + f""", g AS (SELECT symbol, n, p AS path, s AS step, s = 0 OR {sql_draw(4, 'p', 's', 3)} = 0 AS fresh, {sql_draw('n', 'p', 's', 4)} AS d FROM n, range(5) q(p), range(100000) r(s) WHERE s < n),
 h AS (SELECT *, max(CASE WHEN fresh THEN step END) OVER (PARTITION BY symbol, path ORDER BY step) AS a FROM g)""") + " SELECT h.symbol, CAST(h.path AS INTEGER) AS path, h.step, (k.d + h.step - h.a) % h.n AS i FROM h JOIN h k ON k.symbol = h.symbol AND k.path = h.path AND k.step = h.a")
def _(spark, d):
    n = hourly_returns(spark, d).groupBy("symbol").agg(F.count(lit(1)).alias("n"))
    return V.stationary_paths(n, "symbol", 5, 4, 3)


DIFF = "df AS (SELECT l_suppkey % 8 AS rule, CAST(epoch(l_shipdate) AS BIGINT) // 2592000 AS m, avg(l_discount - 0.0495) AS d FROM lineitem GROUP BY 1, 2), lo AS (SELECT min(m) AS m0 FROM df), di AS (SELECT rule, m - m0 AS i, d FROM df, lo)"
SNOOP = DIFF + f""", n AS (SELECT max(i) + 1 AS n FROM di), g AS (SELECT n, p, s, s = 0 OR {sql_draw(4, 'p', 's', 5)} = 0 AS fresh, {sql_draw('n', 'p', 's', 6)} AS d FROM n, range(60) q(p), range(100000) r(s) WHERE s < n), h AS (SELECT *, max(CASE WHEN fresh THEN s END) OVER (PARTITION BY p ORDER BY s) AS a FROM g),
 ix AS (SELECT h.p, (k.d + h.s - h.a) % h.n AS i FROM h JOIN h k ON k.p = h.p AND k.s = h.a), mn AS (SELECT rule, avg(d) AS m, count(*) AS t FROM di GROUP BY 1), bo AS (SELECT p, rule, avg(d) AS b FROM ix JOIN di USING (i) GROUP BY 1, 2), x3 AS (SELECT bo.*, m, t, stddev_pop(b * sqrt(t)) OVER (PARTITION BY rule) AS s FROM bo JOIN mn USING (rule)),
 pp AS (SELECT p, max((b - m) * sqrt(t)) AS w, greatest(0, max(b * sqrt(t) / s)) AS lo, greatest(0, max((b - CASE WHEN m * sqrt(t) / s >= -sqrt(2 * ln(ln(t))) THEN m ELSE 0 END) * sqrt(t) / s)) AS mid, greatest(0, max((b - least(m, 0)) * sqrt(t) / s)) AS up, max(m * sqrt(t)) AS st, greatest(0, max(m * sqrt(t) / s)) AS spa FROM x3 GROUP BY 1)"""


@query("v9_data_snooping", "WITH " + SNOOP + " SELECT round(max(st), 6) AS white_stat, round((count(*) FILTER (w >= st) + 1) / (count(*) + 1), 6) AS white_p, round(max(spa), 6) AS spa_stat, round((count(*) FILTER (lo >= spa) + 1) / (count(*) + 1), 6) AS p_lower, round((count(*) FILTER (mid >= spa) + 1) / (count(*) + 1), 6) AS p_consistent, round((count(*) FILTER (up >= spa) + 1) / (count(*) + 1), 6) AS p_upper FROM pp")
def _(spark, d):
    m = F.floor(seconds("l_shipdate") / 2592000)
    x = table(spark, d, "lineitem").groupBy((c("l_suppkey") % 8).alias("rule"), m.alias("m")).agg(F.avg(c("l_discount") - 0.0495).alias("d"))
    low = table(spark, d, "lineitem").agg(F.floor(F.min(seconds("l_shipdate")) / 2592000).alias("m0"))
    x = x.join(F.broadcast(low)).select("rule", (c("m") - c("m0")).alias("i"), "d")
    return V.data_snooping(x, 60, 4, 5).select(*R(6, "white_stat", "white_p", "spa_stat", "p_lower", "p_consistent", "p_upper"))


AXES = {"fast": [2, 4, 6, 8], "slow": [4, 8, 12], "stop": [0.01, 0.02]}
GRID_SQL = "g AS (SELECT fast, slow, CAST(stop AS DOUBLE) AS stop FROM (VALUES (2), (4), (6), (8)) a(fast), (VALUES (4), (8), (12)) b(slow), (VALUES (0.01), (0.02)) c(stop))"


@query("v10_parameter_grid", "WITH " + GRID_SQL + " SELECT fast, slow, stop, count(*) AS parts FROM g JOIN part ON p_size % 13 = (fast + slow) % 13 GROUP BY 1, 2, 3")
def _(spark, d):
    g = V.parameter_grid(spark, AXES).drop("id").withColumn("_k", (c("fast") + c("slow")) % 13)
    p = table(spark, d, "part").groupBy((c("p_size") % 13).alias("_k")).agg(F.count(lit(1)).alias("parts"))
    return g.join(p, "_k").select("fast", "slow", "stop", "parts")


@query("v11_constraints", "SELECT CASE WHEN p_size >= p_partkey % 40 THEN 'p_size < slow' WHEN p_size <= 3 THEN 'p_size > 3' ELSE '' END AS rejected_by, count(*) AS n FROM part GROUP BY 1")
def _(spark, d):
    p = table(spark, d, "part").withColumn("slow", c("p_partkey") % 40)
    good, bad = V.split_by_constraints(p, "p_size < slow", "p_size > 3")
    return good.withColumn("rejected_by", lit("")).unionByName(bad).groupBy("rejected_by").agg(F.count(lit(1)).alias("n"))


TRIALS = [(4, 12), (6, 12), (4, 20)]
GS = """m AS (SELECT symbol, pos, pos // 60 AS fold, CASE WHEN pos >= 3 THEN avg(close) OVER (w ROWS 3 PRECEDING) END AS ma_4, CASE WHEN pos >= 5 THEN avg(close) OVER (w ROWS 5 PRECEDING) END AS ma_6, CASE WHEN pos >= 11 THEN avg(close) OVER (w ROWS 11 PRECEDING) END AS ma_12,
 CASE WHEN pos >= 19 THEN avg(close) OVER (w ROWS 19 PRECEDING) END AS ma_20, lead(close) OVER w / close - 1 AS move FROM x WINDOW w AS (PARTITION BY symbol ORDER BY pos)),
 s AS (SELECT symbol, fold, 0 AS trial, sign(ma_4 - ma_12) AS side, move FROM m UNION ALL SELECT symbol, fold, 1, sign(ma_6 - ma_12), move FROM m UNION ALL SELECT symbol, fold, 2, sign(ma_4 - ma_20), move FROM m)"""


def scored(spark, d, cost):
    fr, w, df = windowed(weekly(spark, d), 20, 1)
    df = df.withColumns({**{f"ma_{n}": when(c("pos") >= n - 1, F.avg("close").over(w(n))) for n in (4, 6, 12, 20)}, "move": F.try_divide(F.lead("close").over(fr.row), "close") - 1, "fold": F.floor(c("pos") / 60)})
    return V.grid_scores(fr.own(df), TRIALS, cost, 52.0)


def _score_sql(cost):
    return f"SELECT trial, symbol, fold, count(*) FILTER (side <> 0) AS activity, round(avg(side * move - {cost} * abs(side)), 6) AS mean, coalesce(round(avg(side * move - {cost} * abs(side)) / nullif(stddev_pop(side * move - {cost} * abs(side)), 0) * sqrt(52), 5), 0) AS sharpe FROM s WHERE side IS NOT NULL AND move IS NOT NULL GROUP BY 1, 2, 3"


@query("v12_grid_scores", with_sql("x", more=GS) + _score_sql(0.001))
def _(spark, d):
    return scored(spark, d, 0.001).select("trial", "symbol", "fold", "activity", *R(6, "mean"), *R(5, "sharpe"))


@query("v13_cost_stressed_scores", with_sql("x", more=GS) + "SELECT trial, k AS multiplier, round(avg(side * move - 0.001 * k * abs(side)), 6) AS mean FROM s, (VALUES (1), (2), (3)) v(k) WHERE side IS NOT NULL AND move IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    fr, w, df = windowed(weekly(spark, d), 20, 1)
    df = fr.own(df.withColumns({**{f"ma_{n}": when(c("pos") >= n - 1, F.avg("close").over(w(n))) for n in (4, 6, 12, 20)}, "move": F.try_divide(F.lead("close").over(fr.row), "close") - 1}))
    items = F.array(*[F.struct(lit(i).alias("trial"), F.signum(c(f"ma_{a}") - c(f"ma_{b}")).alias("side")) for i, (a, b) in enumerate(TRIALS)])
    x = df.withColumn("_t", F.explode(items)).select("move", "_t.*").where("side IS NOT NULL AND move IS NOT NULL")
    g = x.groupBy("trial").agg(F.sum(c("side") * c("move")).alias("g"), F.sum(F.abs("side")).alias("k"), F.count(lit(1)).alias("n"))
    rows = F.array(*[F.struct(lit(m).alias("multiplier"), ((c("g") - 0.001 * m * c("k")) / c("n")).alias("mean")) for m in (1, 2, 3)])
    return g.select("trial", F.explode(rows).alias("r")).select("trial", "r.multiplier", F.round("r.mean", 6).alias("mean"))
