"""Compare registered queries with their SQL on DuckDB: ``python check.py [-d DIR] [-c CHUNK] [prefix...]``."""

import argparse
import math
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from tidemark.plans import QUERIES, SQL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def session(cores="8", parts="8"):
    return (SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", parts)
            .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
            .config("spark.sql.session.timeZone", "UTC").getOrCreate())


def norm(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, bool):
        return v
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(norm(x) for x in v)
    if hasattr(v, "item"):
        return norm(v.item())
    return v


def rows(pdf):
    cols = sorted(pdf.columns)
    return sorted((tuple(norm(v) for v in r) for r in pdf[cols].itertuples(index=False, name=None)), key=repr)


def compare(spark, con, name, folder, show=3):
    t0 = time.time()
    sdf = QUERIES[name](spark, folder)
    got = pd.DataFrame([tuple(r) for r in sdf.collect()], columns=sdf.columns, dtype=object)
    spent = time.time() - t0
    if name not in SQL:
        return f"rows {len(got)}", spent, True
    rel = con.sql(SQL[name])
    want = pd.DataFrame(rel.fetchall(), columns=list(rel.columns), dtype=object)
    if sorted(got.columns) != sorted(want.columns):
        return f"COLUMNS {sorted(got.columns)} != {sorted(want.columns)}", spent, False
    a, b = rows(got), rows(want)
    if a == b:
        types = {c: type(norm(got[c].iloc[0])).__name__ + "/" + type(norm(want[c].iloc[0])).__name__
                 for c in got.columns if len(got)
                 and type(norm(got[c].iloc[0])) is not type(norm(want[c].iloc[0]))}
        return f"ok {len(a)}" + (f" TYPES {types}" if types else "") + (" EMPTY" if not a else ""), spent, bool(a)
    sa, sb = set(map(repr, a)), set(map(repr, b))
    left, right = sorted(sa - sb), sorted(sb - sa)
    return (f"DIFF rows {len(a)}/{len(b)} only-spark {len(left)} only-sql {len(right)} cols {sorted(got.columns)}\n"
            + "\n".join(f"   s {x[:300]}" for x in left[:show]) + "\n"
            + "\n".join(f"   d {x[:300]}" for x in right[:show])), spent, False


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("-d", default="/root/testdata/sf0.01")
    ap.add_argument("-c", type=int)
    ap.add_argument("prefix", nargs="*")
    a = ap.parse_args()
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    if a.c:
        spark.conf.set("spark.tidemark.chunkRows", str(a.c))
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{a.d}/{t}.parquet'")
    bad = []
    names = [n for n in QUERIES if not a.prefix or any(n.startswith(p) for p in a.prefix)]
    t0 = time.time()
    for n in names:
        try:
            text, spent, fine = compare(spark, con, n, a.d)
        except Exception as e:  # report and go on with the next query
            text, spent, fine = f"ERROR {type(e).__name__}: {str(e)[:700]}", 0.0, False
        if not fine:
            bad.append(n)
        print(f"{n:34s} {spent:6.2f}s {text}", flush=True)
    print(f"{len(names)} queries, {len(bad)} bad, {time.time() - t0:.0f}s: {bad}")


if __name__ == "__main__":
    main()
