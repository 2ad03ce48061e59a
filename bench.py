"""Headline queries, each timed once after one warm query; prints one JSON line."""

import json
import os
import sys
import time

from check import session
from tidemark.plans import QUERIES

HEADLINE = ("f01_sma f02_ema f20_realized_volatility j1_asof_fundamentals j4_asof_closed_bar j11_current_equity "
            "a4_performance_block a52_fifo_commission w12_log_volatility w27_excursions x4_factor_panel").split()


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    spent = {}
    QUERIES[HEADLINE[0]](spark, folder).write.format("noop").mode("overwrite").save()  # starts the JVM and its compilers
    for name in HEADLINE:
        t0 = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.time() - t0, 3)
        print(name, spent[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(spent.values()), 3), "unit": "sec", "queries": spent,
                      "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
