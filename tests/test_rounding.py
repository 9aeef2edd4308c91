"""The oracle's DuckDB rounding expressions agree with Spark's ``round`` on doubles,
including exact decimal ties (1.005, 0.145, ...) where DuckDB's own ``round`` differs."""

from __future__ import annotations

import math
import random

import duckdb
from pyspark.sql import functions as F

from sensortwin.plans.oracle import _p, _r


def _values() -> list[float]:
    rng = random.Random(11)
    vals = [1.005, 2.675, 0.125, 0.145, 1.115, 0.285, 10.005, 1234.565, 0.15, 6.25, 87.55, -1.005, -0.145, 0.0]
    for _ in range(600):
        vals.append(round(rng.uniform(-5000, 5000), rng.choice([2, 3, 4, 7])))
    for _ in range(600):  # exact ties at 2 decimals, and their 1-ulp neighbours
        t = rng.randint(-10**6, 10**6) / 100 + 0.005
        vals += [t, math.nextafter(t, math.inf), math.nextafter(t, -math.inf)]
    return vals[:2000]


def test_oracle_rounding_matches_spark(spark):
    vals = _values()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, x double")
    got = {r["i"]: (r["p"], r["r2"]) for r in
           df.select("i", F.round(F.round("x", 9), 6).alias("p"), F.round("x", 2).alias("r2")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE v (i INTEGER, x DOUBLE)")
    con.executemany("INSERT INTO v VALUES (?, ?)", list(enumerate(vals)))
    rows = con.sql(f"SELECT i, {_p('x')} AS p, {_r('x', 2)} AS r2 FROM v").fetchall()
    bad = [(vals[i], got[i], (p, r2)) for i, p, r2 in rows if got[i] != (p, r2)]
    assert not bad, bad[:5]
