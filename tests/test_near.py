"""Tolerance matching against brute force, and on a page so dense that pairs would be billions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirework.plans.near import first_near

KIND = "id long, doc_id long, x double, y double"


def _hits(spark, t, s, tol, strict=True):
    targets = spark.createDataFrame(t, KIND).withColumnRenamed("id", "target_id")
    stored = spark.createDataFrame(s, KIND).withColumn("hit", F.struct("id")).drop("id")
    return {r.target_id: r.hit.id for r in first_near(targets, stored, ["doc_id"], ["x", "y"], tol, strict).collect()}


@pytest.mark.parametrize("seed,tol,strict", [(1, 50.0, True), (2, 10.0, False), (3, 1.0, True)])
def test_first_near_brute_force(spark, seed, tol, strict):
    """Clusters, scattered rows, rows on a grid of the tolerance itself, ties and odd values."""
    rng = np.random.default_rng(seed)

    def rows(n):
        spots = np.concatenate([rng.normal(200, tol, (n, 2)), rng.uniform(-300, 300, (n, 2)), rng.integers(-5, 6, (n, 2)) * tol])
        odd = [(None, 1.0), (float("nan"), 1.0), (float("inf"), 1.0), (1e30, 1.0), (-1e18, 1e18), (0.0, -0.0)]
        full = [tuple(map(float, p)) for p in spots] + odd
        return [(int(k), int(d), x, y) for k, d, (x, y) in zip(rng.permutation(len(full)), rng.integers(0, 2, len(full)), full)]

    t, s = rows(150), rows(150)
    want = {}
    for a, d, x, y in t:
        for b, e, u, v in s:
            if d == e and None not in (x, u):
                gaps = abs(x - u), abs(y - v)
                if all(g < tol if strict else g <= tol for g in gaps):
                    want[a] = min(b, want.get(a, b))
    assert _hits(spark, t, s, tol, strict) == want


def test_first_near_empty(spark):
    assert _hits(spark, [], [(1, 1, 0.0, 0.0)], 5.0) == {} == _hits(spark, [(1, 1, 0.0, 0.0)], [], 5.0)


def test_first_near_dense_page(spark):
    """100,000 drawings of one page against as many: 7e8 pairs lie within the tolerance."""
    n = 100_000
    spot = lambda seed: [(F.rand(seed) * 300).alias("x"), (F.rand(seed + 1) * 400).alias("y")]
    t = spark.range(n).select(F.col("id").alias("target_id"), F.lit(1).alias("doc_id"), *spot(1)).cache()
    s = spark.range(n).select(F.struct(F.xxhash64("id").alias("o"), "id").alias("hit"), F.lit(1).alias("doc_id"), *spot(3)).cache()
    got = first_near(t, s, ["doc_id"], ["x", "y"], 50.0).toPandas().sort_values("target_id")
    assert len(got) == n
    tx, sx = t.toPandas(), s.select("hit.o", "x", "y").toPandas()
    order = np.argsort(sx["o"].to_numpy())
    for k in range(0, n, 5000):
        x, y = tx["x"][k], tx["y"][k]
        want = next(o for o in order if abs(sx["x"][o] - x) < 50 and abs(sx["y"][o] - y) < 50)
        assert got["hit"].iloc[k]["o"] == sx["o"][want]
