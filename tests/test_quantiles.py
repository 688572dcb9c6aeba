import random

import numpy as np
from pyspark.sql import functions as F

from tallyspark.functions.quantiles import exact_quantiles


def test_against_numpy_with_hot_null_and_tied_keys(spark):
    rng = random.Random(1)
    data = [("hot", float(rng.randint(0, 40))) for _ in range(3000)] + [(None, rng.random()) for _ in range(57)] + [(f"k{i % 9}", float(i)) for i in range(200)] + [("hot", None), ("none", None), ("one", 7.0)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r.g: r.q for r in exact_quantiles(df, {"g": F.col("g")}, F.col("v"), [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    assert set(got) == {g for g, v in data if v is not None}
    for g, q in got.items():
        np.testing.assert_allclose(q, np.quantile([v for k, v in data if k == g and v is not None], [0.0, 0.25, 0.5, 0.9, 1.0]), atol=1e-9)


def test_without_keys_and_empty(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("v"))
    assert [r.q for r in exact_quantiles(df, {}, F.col("v"), [0.5, 0.255]).collect()] == [[50.0, 25.5]]
    assert exact_quantiles(df.limit(0), {}, F.col("v"), [0.5]).collect() == []
    assert exact_quantiles(df.limit(0), {"g": F.col("v")}, F.col("v"), [0.5]).collect() == []
