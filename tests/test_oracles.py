"""Queries against their SQL; all of them with TIDEMARK_ALL=1, a few of each family otherwise."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from check import compare
from tests.conftest import SMALL
from tidemark.plans import QUERIES, SQL

FEW = """s1_csv_lines s6_event_id p6_instrument_key p19_news_relevance j1_asof_fundamentals j7_bounded_forward_asof a14_metric_bundle
a52_fifo_commission a56_virtual_positions f02_ema f10_stochastic f15_adx w17_autocorrelation x3_quantile_returns x12_group_returns
v3_purged_splits v6_block_bootstrap t5_sample_curve b7_schedule_monthly i10_cumulative_deltas""".split()
NAMES = list(SQL) if os.environ.get("TIDEMARK_ALL") else FEW


def test_every_query_is_registered_once():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 280


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    text, _, fine = compare(spark, con, name, SMALL)
    assert fine or text.endswith("EMPTY"), text


@pytest.mark.parametrize("name", ["f01_sma", "f08_macd", "f18_supertrend", "a52_fifo_commission", "w21_regimes", "j4_asof_closed_bar", "a4_performance_block"])
def test_small_chunks_give_the_same(spark, con, name):
    """Histories cut into many chunks must not change a value."""
    spark.conf.set("spark.tidemark.chunkRows", "24")
    try:
        text, _, fine = compare(spark, con, name, SMALL)
    finally:
        spark.conf.unset("spark.tidemark.chunkRows")
    assert fine, text


def test_an_account_below_zero_has_no_calmar(spark, con, tmp_path):
    """Losses above the starting capital: the SQL's power of a negative number is NaN."""
    spark.read.parquet(f"{SMALL}/lineitem.parquet").withColumn("l_extendedprice", F.col("l_extendedprice") * 128).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = QUERIES["a14_metric_bundle"](spark, str(tmp_path)).collect()
    assert any(r["total_return"] < -1 for r in got)
    own = duckdb.connect()
    own.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = own.sql(f"SELECT run, calmar FROM ({SQL['a14_metric_bundle']}) ORDER BY run").fetchall()
    assert [repr(x) for x in want] == [repr((r["run"], r["calmar"])) for r in sorted(got, key=lambda r: r["run"])]
