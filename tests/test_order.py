import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmere.operators import raster, statistics


@pytest.fixture
def many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_quantiles_against_numpy(spark, many_parts):
    """A group that holds most rows, ties, null keys, and groups without a value."""
    draw = random.Random(3)
    rows = [("hot", draw.choice([0.0, 1.0, draw.uniform(-5, 5)])) for _ in range(4000)] + [("tied", 2.5)] * 300 + [(None, float(i)) for i in range(7)] + [("one", 4.0), ("none", None), ("none", None), ("hot", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    ranked = statistics.ranked_counts(df, ["k"], "v")
    assert ranked.filter("k = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count() > 2
    wanted = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p80": 0.8, "p100": 1.0}
    found = {r.k: r for r in statistics.quantiles(df, ["k"], "v", wanted).collect()}
    assert set(found) == {"hot", "tied", None, "one", "none"}
    for k, r in found.items():
        values = [v for key, v in rows if key == k and v is not None]
        for name, p in wanted.items():
            assert r[name] is None if not values else r[name] == pytest.approx(np.quantile(values, p), abs=1e-12)
    old = {r.k: r for r in df.groupBy("k").agg(*(F.percentile("v", F.lit(p)).alias(n) for n, p in wanted.items())).collect()}
    assert all(found[k][n] == pytest.approx(old[k][n], abs=1e-12) for k in old for n in wanted if old[k][n] is not None)


def test_statistics_and_mask_go_by_ranks(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("a", None), ("b", None), (None, 9.0)], "k string, area_ha double")
    assert {tuple(r) for r in statistics.area_statistics(df, ["k"], mean=True).collect()} == {("a", 5.0, 2, 2.5, 2.5), ("b", 0.0, 0, None, None)}
    assert tuple(statistics.area_statistics(df.limit(0), []).first()) == (0.0, 0, None)
    cells = spark.createDataFrame([(0, i, i) for i in range(10)], "row int, col int, value int")
    assert sorted(r.value for r in raster.mask_above_percentile(cells, 0.8).collect()) == [8, 9]


def test_subset_fits_against_least_squares(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 5))
    x[:, 3] = 2 * x[:, 0] - x[:, 1]  # explained by others
    x[:, 4] = 7.0  # never varies
    y = x[:, 0] + 0.5 * x[:, 1] ** 2 + 0.2 * x[:, 2] + rng.normal(size=400)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)] + [(None, 1.0, 1.0, 1.0, 1.0, 99.0)], "a double, b double, c double, d double, e double, y double")
    found = {r.subset: r.r2 for r in statistics.subset_fits(df, "y", list("abcde")).collect()}
    assert set(found) == set(range(1, 32))
    for mask, r2 in found.items():
        design = np.column_stack([np.ones(400), *(x[:, i] for i in range(5) if mask >> i & 1)])
        rest = y - design @ np.linalg.lstsq(design, y, rcond=None)[0]
        assert r2 == pytest.approx(1 - (rest**2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-9)
    parts = {r.term: r for r in statistics.hierarchical_partition(statistics.subset_fits(df, "y", list("abcde")), 5).collect()}
    assert sum(r.total for r in parts.values()) == pytest.approx(found[31], abs=1e-9)  # the parts make up the whole fit
    assert parts[4].total == pytest.approx(0) and parts[0].unique == pytest.approx(found[31] - found[30], abs=1e-9)
    assert {r.r2 for r in statistics.subset_fits(df, "e", ["a", "b"]).collect()} == {None}
    assert statistics.subset_fits(df.limit(0), "y", ["a"]).first().r2 is None
