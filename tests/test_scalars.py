"""Scalar column functions."""

import random

from pyspark.sql import functions as F

from kinelake.functions import scalars as X


def test_two_decimals_round_the_binary_value(spark):
    rng = random.Random(5)
    values = [0.0, 0.005, 0.015, 0.125, 0.375, 0.995, 0.999, 1.005, 2.5, 7.125, 99.995, 228803.835, 1195558.315, 4503599627370495.5, 1e17]
    values += [rng.randrange(10**15) / 1e9 for _ in range(300)] + [rng.randrange(10**9) / 1e3 for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", X.two_decimals(F.col("v")).alias("text")).collect()
    wrong = [(r.v, r.text) for r in got if r.text != f"{r.v:.2f}"]
    assert len(got) == len(values) and wrong == []
