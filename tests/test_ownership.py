"""Owners by shared keys against a plain walk through the rows, over chains, hot keys, re-pointed keys and odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import dedup, ownership

SCHEMA = "id string, place long, keys array<string>"


def plain(rows):
    by_key, out = {}, {}
    for i, _, keys in sorted(rows, key=lambda r: r[1]):
        keys = [k for k in keys or [] if k is not None]
        owner = next((by_key[k] for k in keys if k in by_key), i)
        out[i] = owner
        by_key.update(dict.fromkeys(keys, owner))
    return out


def found(spark, rows):
    return {r["id"]: r["owner"] for r in ownership.owners(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}


@pytest.mark.parametrize("seed", range(4))
def test_random_keys(spark, seed):
    rng = random.Random(seed)
    rows = [(f"r{i}", 1000 - i if seed % 2 else i, [f"k{rng.randrange(6 + 40 * seed)}" for _ in range(rng.randrange(0, 4))]) for i in range(150)]
    assert found(spark, rows) == plain(rows)


def test_hot_keys_and_long_chains(spark):
    hot = [(f"r{i}", i, ["hot"] if i % 3 else [f"own{i}", "hot"]) for i in range(500)]
    chain = [(f"c{i}", 1000 + i, [f"x{i}", f"x{i + 1}"]) for i in range(300)]
    assert found(spark, hot + chain) == plain(hot + chain)


def test_keys_are_pointed_anew(spark):
    # The third row joins the first by its first key and takes the second's key along.
    rows = [("1", 1, ["a", "b"]), ("2", 2, ["c"]), ("3", 3, ["b", "c"]), ("4", 4, ["c"]), ("5", 5, ["d", "c"]), ("6", 6, ["d"])]
    assert found(spark, rows) == plain(rows) == {"1": "1", "2": "2", "3": "1", "4": "1", "5": "1", "6": "1"}
    inside = spark.createDataFrame([(rows,)], f"rows array<struct<{SCHEMA.replace(' ', ':').replace(',:', ',')}>>").select(dedup.equivalence_owners(F.transform("rows", lambda r: F.struct(r["id"].alias("id"), r["keys"].alias("keys")))).alias("o"))
    assert {x["id"]: x["owner"] for x in inside.first()["o"]} == plain(rows)


def test_odd_rows(spark):
    rows = [("a", 1, None), ("b", 2, []), ("c", 3, [None, "k"]), ("d", 4, ["k", "k"]), ("e", 5, [""]), ("f", 6, ["", "k"])]
    assert found(spark, rows) == plain(rows)
    assert ownership.owners(spark.createDataFrame([], SCHEMA)).count() == 0


def test_keys_of_references(spark):
    rows = [("r1", "İmar Kanunu Mart 2024 (revize)", "Madde  5", "x" * 80), ("r2", "imar kanunu ( )", "madde 5", "y"), ("r3", None, "madde 5", None), ("r4", "Mart", "madde", " " + "Z" * 400), ("r5", "Kanun 20245", "1", "short")]
    out = {r["id"]: r["k"] for r in spark.createDataFrame(rows, "id string, title string, article string, excerpt string").select("id", ownership.reference_keys(F.col("title"), F.col("article"), F.col("excerpt"), F.col("id")).alias("k")).collect()}
    assert out["r1"] == ["title-article:imar kanunu ( )|madde 5", "excerpt:" + "x" * 80] and out["r2"] == ["title-article:imar kanunu ( )|madde 5"]
    assert out["r3"] == ["reference:r3"] and out["r4"] == ["excerpt:" + "z" * 360] and out["r5"] == ["title-article:kanun 20245|1"]
