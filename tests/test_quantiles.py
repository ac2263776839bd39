"""Quantiles by rank against Spark's own percentile."""

import random

import pytest
from pyspark.sql import functions as F

from chronogrid.operators import stats

SHARES = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}


def values_of(kind):
    rng = random.Random(kind)
    return {
        "spread": [rng.uniform(-50, 50) for _ in range(1001)],
        "hot": [7.5] * 400 + [rng.randint(0, 20) / 4 for _ in range(300)],
        "one": [3.25],
        "two": [1.0, 2.0],
        "holes": [None, 4.0, None, 1.0, 9.0, 1.0],
        "none": [None, None],
        "empty": [],
    }[kind]


@pytest.mark.parametrize("kind", ["spread", "hot", "one", "two", "holes", "none", "empty"])
def test_equal_to_percentile(spark, kind):
    rows = spark.createDataFrame([(v,) for v in values_of(kind)], "x double").repartition(4)
    want = rows.agg(*[F.percentile("x", p).alias(n) for n, p in SHARES.items()]).first()
    got = stats.exact_quantiles(rows, "x", SHARES).first()
    assert tuple(got) == tuple(want)


def test_no_task_sees_all_values(spark):
    rows = spark.range(20_000).select(F.rand(3).alias("x"))
    plan = stats.exact_quantiles(rows, "x", SHARES)._jdf.queryExecution().toString()
    assert "percentile" not in plan
