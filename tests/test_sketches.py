"""Sketches merged from parts against whole counts, and the estimates of a priority sample."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import sketches


def test_merged_sketches_are_within_their_bounds(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(f"g{i % 2}", i % 7, rng.randrange(3000), rng.gauss(10, 3)) for i in range(20_000)], "g string, day int, who int, x double")
    parts = sketches.sketched(rows, ["g", "day"], "who", "x")
    out = {r["g"]: r for r in sketches.merged(parts, ["g"]).select("g", "rows", sketches.distinct_estimate(F.col("distinct_sketch")).alias("d"), *[sketches.quantile_estimate(F.col("quantile_sketch"), q).alias(f"q{int(100 * q)}") for q in (0.1, 0.5, 0.9)]).collect()}
    for g in ("g0", "g1"):
        mine = rows.filter(F.col("g") == g)
        exact = mine.agg(F.count_distinct("who")).first()[0]
        assert out[g]["rows"] == 10_000 and abs(out[g]["d"] - exact) <= 0.03 * exact
        values = sorted(r["x"] for r in mine.collect())
        for q in (0.1, 0.5, 0.9):
            rank = sum(v <= out[g][f"q{int(100 * q)}"] for v in values) / len(values)
            assert abs(rank - q) <= 0.02


def test_nulls_and_nothing(spark):
    rows = spark.createDataFrame([("a", None, None), ("a", 1, 2.0)], "g string, who int, x double")
    row = sketches.sketched(rows, ["g"], "who", "x").select("rows", sketches.distinct_estimate(F.col("distinct_sketch")).alias("d"), sketches.quantile_estimate(F.col("quantile_sketch"), 0.5).alias("q")).first()
    assert tuple(row) == (2, 1, 2.0)
    assert sketches.sketched(rows.limit(0), ["g"], "who", "x").count() == 0
    assert sketches.priority_sample(rows.limit(0), F.col("who"), F.col("x"), 5).count() == 0


def test_sample_estimates_sums(spark):
    rng = random.Random(2)
    weights = [rng.paretovariate(1.2) for _ in range(3000)]
    rows = spark.createDataFrame([(i, w, "even" if i % 2 else "odd") for i, w in enumerate(weights)], "id long, w double, side string").repartition(3)
    guesses = []
    for seed in range(12):
        out = sketches.priority_sample(rows, F.col("id"), F.col("w"), 300, seed).collect()
        assert len(out) == 300 and all(r["estimate"] >= r["w"] for r in out)
        guesses.append(sum(r["estimate"] for r in out if r["side"] == "odd"))
    true = sum(w for i, w in enumerate(weights) if i % 2 == 0)
    assert sum(guesses) / len(guesses) == pytest.approx(true, rel=0.05)
    heavy = max(range(3000), key=weights.__getitem__)
    assert any(r["id"] == heavy for r in out)


def test_small_tables_and_reruns(spark):
    rows = spark.createDataFrame([(1, 2.0), (2, 0.0), (3, None), (4, -1.0), (5, 1.0), (5, 1.0)], "id long, w double")
    out = sketches.priority_sample(rows, F.col("id"), F.col("w"), 10).collect()
    assert sorted((r["id"], r["estimate"]) for r in out) == [(1, 2.0), (5, 1.0), (5, 1.0)]
    many = spark.range(2000).select("id", (F.col("id") % 10 + 1).alias("w"))
    one, two = (sorted(tuple(r) for r in sketches.priority_sample(many.repartition(n), F.col("id"), F.col("w"), 50).collect()) for n in (1, 5))
    assert one == two
