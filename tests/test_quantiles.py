"""Order statistics by rounds of selection."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratusqc.operators import quantiles as QU


def plain(values, q):
    return np.sort(values)[int(np.floor((len(values) - 1) * q))], np.quantile(values, q)


@pytest.mark.parametrize("q", [0.03, 0.5, 1.0])
def test_a_million_distinct_values(spark, q):
    """The last step sees a bounded number of entries; a coarse sketch takes more rounds."""
    df = spark.range(1_000_000).select(F.lit("a").alias("g"), F.pmod(F.col("id") * 48271, F.lit(1_000_003)).cast("double").alias("v"))
    values = np.array([r["v"] for r in df.select("v").collect()])
    present = df.select("g", F.col("v").alias("_v"))
    bracket = QU._brackets(present, "g", q, 200, 1000).first()
    inside = ((values >= bracket["_low"]) & (values <= bracket["_high"])).sum()
    assert inside <= 1.1 * 1000
    row = QU.exact_quantile(df, "g", "v", q, accuracy=200, most=1000).first()
    assert (row["lower"], row["n"]) == (plain(values, q)[0], 1_000_000)
    assert row["quantile"] == pytest.approx(plain(values, q)[1])


def test_no_window_over_a_whole_group(spark):
    df = spark.range(1000).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("v"))
    plan = QU.exact_quantile(df, "g", "v", 0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Aggregate [g", plan.index("Window"))


@pytest.mark.parametrize("seed", range(4))
def test_ties_groups_and_skew(spark, seed):
    rng = np.random.default_rng(seed)
    data = {
        "one": np.array([3.5]),
        "same": np.full(500, 2.0),
        "mostly": np.concatenate([np.zeros(3000), rng.normal(size=40)]),
        "wide": rng.lognormal(sigma=6, size=2000),
        "signed": np.round(rng.normal(size=1500), 1),
    }
    rows = [(g, float(v)) for g, x in data.items() for v in x] + [("one", float("nan")), ("same", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for q in (0.0, 0.02, 0.3, 0.98):
        got = {r["g"]: r for r in QU.exact_quantile(df, "g", "v", q, accuracy=50, most=10).collect()}
        assert set(got) == set(data)
        for g, x in data.items():
            assert got[g]["lower"] == plain(x, q)[0], (g, q)
            assert got[g]["quantile"] == pytest.approx(plain(x, q)[1], rel=1e-9, abs=1e-12)


def test_without_values(spark):
    assert QU.exact_quantile(spark.createDataFrame([], "g string, v double"), "g", "v", 0.5).count() == 0
