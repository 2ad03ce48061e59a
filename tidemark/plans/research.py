"""Cross-sectional research over weekly supplier bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.registry import add, query
from tidemark.model import epoch
from tidemark.operators import research as X
from tidemark.operators.factors import factor_panel, factor_series
from tidemark.plans.joins import ASOF, reports_on_bars
from tidemark.plans.standins import members, table, weekly, with_sql

c, lit, when = F.col, F.lit, F.when
START, END, H, GROUPS, COST = 830000000, 985000000, 4, 5, 0.001
R = lambda n, *names: [F.round(x, n).alias(x) for x in names]


def T():
    return epoch().alias("t")


def LOGS():
    """Values grow without bound on this data, so their logarithm is shown."""
    return [F.round(F.log10(F.abs(n)), 6).alias(n) for n in ("nav_gross", "nav_net")]


AVG = lambda col, part: f"rank() OVER (PARTITION BY {part} ORDER BY {col}) + (count(*) OVER (PARTITION BY {part}, {col}) - 1) / 2.0"
EDGE = "((n - 1) * (k * (1.0 / q)))"
BUCKET = (f"1 + (SELECT count(*) FILTER (k < q AND CASE WHEN {EDGE} - floor({EDGE}) >= 0.5 THEN floor({EDGE}) + 2 - (1 - ({EDGE} - floor({EDGE}))) "
          f"ELSE floor({EDGE}) + 1 + ({EDGE} - floor({EDGE})) END < fr) FROM range(1, 10) r(k))")

ROWS = f"""od AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS ord FROM (SELECT DISTINCT t FROM bars)), bo AS (SELECT bars.*, ord FROM bars JOIN od USING (t)),
 b1 AS (SELECT *, close / max(close) OVER (s RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) - 1 AS r1, close / max(close) OVER (s RANGE BETWEEN 20 PRECEDING AND 20 PRECEDING) - 1 AS factor, -(close / max(close) OVER (s RANGE BETWEEN 5 PRECEDING AND 5 PRECEDING) - 1) AS rev,
  max(open) OVER (s RANGE BETWEEN {H + 1} FOLLOWING AND {H + 1} FOLLOWING) / max(open) OVER (s RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) - 1 AS fwd FROM bo WINDOW s AS (PARTITION BY symbol ORDER BY ord)),
 b2 AS (SELECT *, CASE WHEN count(r1) OVER (s RANGE BETWEEN 19 PRECEDING AND CURRENT ROW) = 20 THEN stddev_samp(r1) OVER (s RANGE BETWEEN 19 PRECEDING AND CURRENT ROW) END AS vol FROM b1 WINDOW s AS (PARTITION BY symbol ORDER BY ord)),
 rr AS (SELECT * FROM b2 b WHERE t BETWEEN {START} AND {END} AND (ord - (SELECT min(ord) FROM od WHERE t >= {START})) % {H} = 0 AND EXISTS (SELECT 1 FROM members m WHERE m.symbol = b.symbol AND m.valid_from <= to_timestamp(b.t)::DATE AND (m.valid_to IS NULL OR to_timestamp(b.t)::DATE < m.valid_to))),
 sz AS (SELECT t, count(*) AS active, count(fwd) AS observed, count(CASE WHEN factor IS NOT NULL AND fwd IS NOT NULL THEN 1 END) AS usable FROM rr GROUP BY 1),
 gc AS (SELECT CAST(least({GROUPS}, greatest(2, CAST(floor(median(usable)) AS BIGINT) // 2)) AS INTEGER) AS groups, CAST(floor(median(usable)) AS BIGINT) AS median FROM sz WHERE usable >= 3)"""
SECT = ROWS + f""", s1 AS (SELECT rr.*, usable AS n, groups AS q FROM rr JOIN sz USING (t), gc WHERE factor IS NOT NULL AND fwd IS NOT NULL AND active >= 3 AND observed >= 3 AND usable >= greatest(3, groups)),
 s2 AS (SELECT *, {AVG('factor', 't')} AS ra, {AVG('fwd', 't')} AS rb, row_number() OVER (PARTITION BY t ORDER BY factor, symbol) AS fr FROM s1),
 ics AS (SELECT t, corr(ra, rb) AS ic FROM s2 GROUP BY 1), s3 AS (SELECT s2.*, ic, {BUCKET} AS grp FROM s2 JOIN ics USING (t) WHERE ic IS NOT NULL AND NOT isnan(ic)),
 us AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS used FROM (SELECT DISTINCT t FROM s3))"""
GRP = SECT + f""", g1 AS (SELECT used, t, grp, count(*) AS members, avg(fwd) AS gross FROM s3 JOIN us USING (t) GROUP BY 1, 2, 3), wt AS (SELECT used, grp, symbol, 1.0 / members AS w FROM s3 JOIN us USING (t) JOIN g1 USING (used, t, grp)),
 tv AS (SELECT coalesce(a.used, b.used + 1) AS used, coalesce(a.grp, b.grp) AS grp, 0.5 * sum(abs(coalesce(a.w, 0) - coalesce(b.w, 0))) AS tv FROM wt a FULL JOIN wt b ON a.used = b.used + 1 AND a.grp = b.grp AND a.symbol = b.symbol GROUP BY 1, 2),
 gr AS (SELECT g1.*, CASE WHEN used = 0 THEN 1 ELSE tv END AS turnover, CASE WHEN used = 0 THEN 1 ELSE tv * 2 END * {COST} AS cost FROM g1 JOIN tv USING (used, grp))"""
Q = lambda more: with_sql("bars", "members", more=more)


def rows(spark, d, names="momentum_20"):
    return X.research_rows(weekly(spark, d), names, H, START, END, members(spark, d))


def sections(spark, d):
    return X.ranked_sections(rows(spark, d), GROUPS)


def groups(spark, d):
    return X.group_returns(sections(spark, d), COST)


@query("x1_winsorized_zscore", with_sql("bars", more="q AS (SELECT t, quantile_cont(close, 0.01) AS lo, quantile_cont(close, 0.99) AS hi FROM bars GROUP BY 1), k AS (SELECT symbol, t, least(greatest(close, lo), hi) AS v FROM bars JOIN q USING (t)), m AS (SELECT t, avg(v) AS m, stddev_pop(v) AS s FROM k GROUP BY 1)") + "SELECT symbol, t, round(CASE WHEN s > 0 THEN (v - m) / s ELSE 0 END, 6) AS zscore FROM k JOIN m USING (t)")
def _(spark, d):
    return X.winsorize_zscore(weekly(spark, d).df.select("symbol", "ts", "close"), ["ts"], "close").select("symbol", T(), *R(6, "zscore"))


@query("x2_information_coefficient", Q(ROWS + f", p AS (SELECT * FROM rr WHERE factor IS NOT NULL AND fwd IS NOT NULL), k AS (SELECT *, {AVG('factor', 't')} AS a, {AVG('fwd', 't')} AS b FROM p), g AS (SELECT t, count(*) AS n, corr(factor, fwd) AS ic, corr(a, b) AS rank_ic FROM k GROUP BY 1)")
       + "SELECT sz.t, coalesce(n, 0) AS n, round(CASE WHEN n >= 3 THEN coalesce(ic, 0) ELSE 0 END, 6) AS ic, round(CASE WHEN n >= 3 THEN coalesce(rank_ic, 0) ELSE 0 END, 6) AS rank_ic, round(CASE WHEN n >= 3 THEN n / active ELSE 0 END, 6) AS coverage FROM sz LEFT JOIN g USING (t)")
def _(spark, d):
    return X.information_coefficient(rows(spark, d), ["ts"], "factor", "forward").select(T(), "n", *R(6, "ic", "rank_ic", "coverage"))


@query("x3_quantile_returns", Q(ROWS + ", p AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY factor, symbol) AS fr, count(*) OVER (PARTITION BY t) AS n FROM rr WHERE factor IS NOT NULL AND fwd IS NOT NULL), k AS (SELECT *, greatest(2, least(5, n)) AS q FROM p)")
       + f"SELECT t, quantile, round(avg(fwd), 6) AS mean_return, count(*) AS count FROM (SELECT *, CAST({BUCKET} AS INTEGER) AS quantile FROM k WHERE n >= 2) GROUP BY 1, 2")
def _(spark, d):
    return X.quantile_returns(rows(spark, d), ["ts"], "factor", "forward", "symbol", 5).select(T(), "quantile", *R(6, "mean_return"), "count")


NAMES = ["momentum_20", "volatility_20", "reversal_5"]


@query("x4_factor_panel", Q(ROWS) + "SELECT symbol, t, round(factor, 6) AS momentum_20, round(vol, 6) AS volatility_20, round(rev, 6) AS reversal_5 FROM rr")
def _(spark, d):
    return rows(spark, d, NAMES).select("symbol", T(), *R(6, *NAMES))


@query("x5_forward_return", Q(ROWS) + f"SELECT symbol, t, round(fwd, 6) AS forward FROM b1 WHERE fwd IS NOT NULL AND t BETWEEN {START} AND {END}")
def _(spark, d):
    p = weekly(spark, d)
    fr = p.replace(X.with_ordinals(p).withColumn("pos", c("ord"))).frame(0, H + 1)
    df = fr.own(fr.df.withColumn("forward", F.try_divide(X._at("open", fr.row, H + 1), X._at("open", fr.row, 1)) - 1))
    return df.where((epoch() >= START) & (epoch() <= END) & c("forward").isNotNull()).select("symbol", T(), *R(6, "forward"))


@query("x6_rebalance_dates", Q(ROWS) + "SELECT DISTINCT t, ord FROM rr")
def _(spark, d):
    return rows(spark, d).select(T(), "ord").distinct()


@query("x7_group_count", Q(ROWS) + "SELECT groups, median FROM gc")
def _(spark, d):
    return X.group_count(rows(spark, d), GROUPS)


INDUSTRY = """ind AS (SELECT CAST(s_suppkey AS VARCHAR) AS symbol, CAST(n_regionkey AS VARCHAR) AS industry FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 7 <> 0)"""


def industries(spark, d):
    s = table(spark, d, "supplier").where("s_suppkey % 7 <> 0").join(table(spark, d, "nation"), c("n_nationkey") == c("s_nationkey"))
    return s.select(c("s_suppkey").cast("string").alias("symbol"), c("n_regionkey").cast("string").alias("industry"))


@query("x8_neutralized_factor", Q(ROWS + ", " + INDUSTRY + ", k AS (SELECT rr.symbol, t, factor, coalesce(industry, 'Unclassified') AS i FROM rr LEFT JOIN ind USING (symbol) WHERE factor IS NOT NULL)")
       + "SELECT symbol, t, round(factor - CASE WHEN count(*) OVER (PARTITION BY t, i) < 2 THEN avg(factor) OVER (PARTITION BY t) ELSE avg(factor) OVER (PARTITION BY t, i) END, 6) AS factor FROM k")
def _(spark, d):
    x = rows(spark, d).where("factor IS NOT NULL").join(industries(spark, d), "symbol", "left")
    return X.neutralize(x, "factor").select("symbol", T(), *R(6, "factor"))


@query("x9_industry_carry", with_sql("bars", more=INDUSTRY + ", k AS (SELECT symbol, t, CASE WHEN CAST(volume AS BIGINT) % 5 = 0 THEN industry END AS i FROM bars LEFT JOIN ind USING (symbol))") + "SELECT symbol, t, last_value(i IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY t) AS industry FROM k")
def _(spark, d):
    p = weekly(spark, d)
    df = p.df.join(industries(spark, d), "symbol", "left").withColumn("industry", when(c("volume").cast("long") % 5 == 0, c("industry")))
    return X.with_industry(p.replace(df)).df.select("symbol", T(), c("industry_").alias("industry"))


@query("x10_ic_series", Q(SECT + ", i AS (SELECT DISTINCT t, ic FROM s3)") + "SELECT t, round(ic, 6) AS ic, round(CASE WHEN count(*) OVER w >= 5 THEN avg(ic) OVER w END, 6) AS rolling FROM i WINDOW w AS (ORDER BY t ROWS 19 PRECEDING)")
def _(spark, d):
    return X.ic_series(sections(spark, d)).select(T(), *R(6, "ic", "rolling"))


@query("x10_ic_summary", Q(SECT + ", i AS (SELECT ic, row_number() OVER (ORDER BY t) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT t, ic FROM s3))") + f"""SELECT count(*) AS dates, round(avg(ic), 6) AS rank_ic, round(avg(ic) / stddev_samp(ic) * sqrt(52.0 / {H}), 6) AS icir, round(avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0 END), 6) AS positive_rate,
 round(avg(ic) FILTER (p < greatest(1, n // 2)), 6) AS first_half, round(avg(ic) FILTER (p >= greatest(1, n // 2)), 6) AS second_half FROM i""")
def _(spark, d):
    return X.ic_summary(sections(spark, d), H, 52.0).select("dates", *R(6, "rank_ic", "icir", "positive_rate", "first_half", "second_half"))


@query("x11_rank_autocorrelation", Q(SECT + f", u AS (SELECT used, symbol, ra / n AS r FROM s3 JOIN us USING (t)), k AS (SELECT a.used, a.r AS a, b.r AS b FROM u a JOIN u b ON a.used = b.used + 1 AND a.symbol = b.symbol), z AS (SELECT used, {AVG('a', 'used')} AS x, {AVG('b', 'used')} AS y FROM k)")
       + "SELECT used, count(*) AS n, round(corr(x, y), 6) AS autocorr FROM z GROUP BY 1 HAVING count(*) >= 3")
def _(spark, d):
    return X.rank_autocorrelation(sections(spark, d)).select("used", "n", *R(6, "autocorr"))


@query("x12_group_returns", Q(GRP) + "SELECT t, CAST(grp AS INTEGER) AS grp, members, round(gross, 6) AS gross, round(gross - cost, 6) AS net, round(turnover, 6) AS turnover, round(cost, 8) AS cost FROM gr")
def _(spark, d):
    return groups(spark, d).select(T(), "grp", "members", *R(6, "gross", "net", "turnover"), *R(8, "cost"))


@query("x12_group_members", Q(SECT) + "SELECT t, CAST(grp AS INTEGER) AS grp, symbol FROM s3")
def _(spark, d):
    return X.group_members(sections(spark, d)).select(T(), "grp", "symbol")


@query("x13_monotonicity", Q(GRP + f", k AS (SELECT t, {AVG('gross', 't')} AS a, {AVG('grp', 't')} AS b FROM gr)") + "SELECT t, round(corr(a, b), 6) AS monotonicity FROM k GROUP BY 1 HAVING count(*) >= 3")
def _(spark, d):
    return X.monotonicity(groups(spark, d)).select(T(), *R(6, "monotonicity"))


@query("x14_nav_curves", Q(GRP) + "SELECT t, CAST(grp AS INTEGER) AS grp, round(log10(abs(product(1 + gross) OVER w)), 6) AS nav_gross, round(log10(abs(product(1 + gross - cost) OVER w)), 6) AS nav_net FROM gr WINDOW w AS (PARTITION BY grp ORDER BY t ROWS UNBOUNDED PRECEDING)")
def _(spark, d):
    return X.nav_curves(groups(spark, d)).select(T(), "grp", *LOGS())


@query("x15_long_short", Q(GRP + ", k AS (SELECT h.t, h.gross - l.gross AS g, h.cost + l.cost AS c FROM gr h JOIN gr l USING (t), gc WHERE h.grp = groups AND l.grp = 1)") + "SELECT t, round(log10(abs(product(1 + g) OVER w)), 6) AS nav_gross, round(log10(abs(product(1 + g - c) OVER w)), 6) AS nav_net FROM k WINDOW w AS (ORDER BY t ROWS UNBOUNDED PRECEDING)")
def _(spark, d):
    return X.long_short(groups(spark, d)).select(T(), *LOGS())


@query("x16_coverage", Q(GRP) + "SELECT round((SELECT sum(usable) / sum(observed) FROM sz WHERE active >= 3 AND observed >= 3), 6) AS coverage, round(1 - (SELECT sum(usable) / sum(observed) FROM sz WHERE active >= 3 AND observed >= 3), 6) AS missing_rate, round(avg(turnover) FILTER (used > 0), 6) AS turnover FROM gr")
def _(spark, d):
    r = rows(spark, d)
    return X.coverage_summary(r, X.group_returns(X.ranked_sections(r, GROUPS), COST)).select(*R(6, "coverage", "missing_rate", "turnover"))


@query("x17_factor_correlation", Q(ROWS + f""", l AS (SELECT t, 'momentum_20' AS a, 'volatility_20' AS b, factor AS x, vol AS y FROM rr UNION ALL SELECT t, 'momentum_20', 'reversal_5', factor, rev FROM rr UNION ALL SELECT t, 'volatility_20', 'reversal_5', vol, rev FROM rr
 UNION ALL SELECT t, 'momentum_20', 'momentum_20', factor, factor FROM rr UNION ALL SELECT t, 'volatility_20', 'volatility_20', vol, vol FROM rr UNION ALL SELECT t, 'reversal_5', 'reversal_5', rev, rev FROM rr),
 k AS (SELECT t, a, b, {AVG('x', 't, a, b')} AS x, {AVG('y', 't, a, b')} AS y FROM l WHERE x IS NOT NULL AND y IS NOT NULL), p AS (SELECT t, a, b, corr(x, y) AS c FROM k GROUP BY 1, 2, 3 HAVING count(*) >= 3), m AS (SELECT a, b, avg(c) AS c, count(*) AS n FROM p WHERE NOT isnan(c) GROUP BY 1, 2)""")
       + "SELECT a, b, round(c, 6) AS correlation, n AS observations FROM m UNION ALL SELECT b, a, round(c, 6), n FROM m WHERE a <> b")
def _(spark, d):
    return X.factor_correlation(rows(spark, d, NAMES), NAMES).withColumn("correlation", F.round("correlation", 6))


@query("x18_sample_diagnostics", Q(SECT + ", k AS (SELECT t, max(n) AS n, max(q) AS q FROM s3 GROUP BY 1), g AS (SELECT count(*) AS dates, CAST(floor(median(n)) AS BIGINT) AS m, min(n) AS lo, max(q) AS q FROM k)")
       + "SELECT dates, m AS median_size, lo AS minimum_size, round(m / q, 6) AS per_group, CASE WHEN m / q >= 5 AND dates >= 30 THEN 'robust' WHEN m / q >= 3 AND dates >= 12 THEN 'limited' ELSE 'insufficient' END AS quality FROM g")
def _(spark, d):
    return X.sample_diagnostics(sections(spark, d), GROUPS).select("dates", "median_size", "minimum_size", *R(6, "per_group"), "quality")


@query("x19_panel_factors", with_sql("x", more="k AS (SELECT *, avg(close) OVER (PARTITION BY symbol ORDER BY pos ROWS 19 PRECEDING) AS s, lag(close, 12) OVER (PARTITION BY symbol ORDER BY pos) AS b, max(high) OVER (PARTITION BY symbol ORDER BY pos ROWS 13 PRECEDING) AS hh, min(low) OVER (PARTITION BY symbol ORDER BY pos ROWS 13 PRECEDING) AS ll FROM x)")
       + "SELECT symbol, t, round(CASE WHEN pos >= 19 THEN s END, 4) AS sma, round(CASE WHEN pos >= 12 THEN close / b - 1 END, 6) AS roc, round(CASE WHEN pos >= 13 THEN coalesce(-100 * (hh - close) / nullif(hh - ll, 0), -50) END, 6) AS williams_r FROM k")
def _(spark, d):
    p = factor_panel(weekly(spark, d), ["sma", "roc", "williams_r"])
    return p.select("symbol", T(), *R(4, "sma"), *R(6, "roc", "williams_r"))


FUND = (("market_cap", "CASE WHEN close * shares > 0 THEN close * shares END"), ("earnings_yield", "net_income / nullif(close * shares, 0)"), ("book_to_price", "shareholder_equity / nullif(close * shares, 0)"),
        ("return_on_equity", "net_income / nullif(shareholder_equity, 0)"), ("revenue_growth", "revenue_growth"), ("debt_to_equity", "total_debt / nullif(shareholder_equity, 0)"), ("free_cash_flow_yield", "free_cash_flow / nullif(close * shares, 0)"))


def _fundamental(name):
    def run(spark, d):
        p = weekly(spark, d)
        df = reports_on_bars(spark, d)
        cap = c("close") * c("f.shares")
        cols = [c(f"f.{n}").alias(n) for n in ("net_income", "shareholder_equity", "total_debt", "free_cash_flow", "revenue_growth")]
        df = df.select("symbol", "ts", when(cap > 0, cap).alias("market_cap"), *cols)
        return factor_series(p.replace(df), name).select("symbol", T(), F.round("value", 2 if name == "market_cap" else 8).alias("value"))
    return run


for _n, (_id, _sql) in enumerate(FUND, start=55):
    add(f"f{_n}_{_id}", _fundamental(_id), with_sql("bars", "fundamentals") + f"SELECT b.symbol, b.t, round({_sql}, {2 if _id == 'market_cap' else 8}) AS value FROM {ASOF} WHERE {_sql} IS NOT NULL")
