"""Percentiles from counts in an order, held against Spark's own."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from millrace.operators import ordering


def test_percentiles(spark):
    r = random.Random(3)
    rows = [(g, round(r.uniform(-9, 9), r.randrange(3))) for g in ("a", "b", None) for _ in range(r.randrange(300, 500))]
    rows += [("one", 5.0), ("none", None), ("two", 1.0), ("two", 2.0), ("a", None), ("same", 3.0), ("same", 3.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = {"low": 0.05, "mid": 0.5, "top": 1.0, "least": 0.0}
    want = df.groupBy("g").agg(*(F.percentile("v", s).alias(n) for n, s in shares.items()))
    assert sorted(map(str, ordering.percentiles(df, "g", "v", shares).collect())) == sorted(map(str, want.collect()))
    assert ordering.percentiles(df.limit(0), "g", "v", shares).count() == 0
