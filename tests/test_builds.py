"""Differences of stored builds against exceptAll, and how much of them is read."""

import random
import re

from pyspark.sql import functions as F

from quillon.operators import builds, graph
from quillon.operators.storage import new_folder

SCHEMA = "id long, text string, tags array<string>, size double"


def stored(spark, rows, groups=32):
    path = new_folder(spark, "build-test")
    builds.write_build(spark.createDataFrame(rows, SCHEMA), ["id"], path, groups=groups)
    return path


def ordered(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_equal_to_except_all(spark):
    rng = random.Random(1)
    a = [(i % 180, rng.choice(["x", "y", None, "", "a|b"]), rng.choice([None, [], ["p"], ["p", "q"]]), rng.choice([None, 0.5])) for i in range(300)]
    b = [r for r in a if r[0] % 17] + [(500, "new", None, None), a[0], a[0]]
    rng.shuffle(b)
    frames = [spark.createDataFrame(x, SCHEMA) for x in (a, b)]
    found = builds.differences(spark, stored(spark, a), stored(spark, b))
    assert found.columns == ["id", "text", "tags", "size", "only_in"]
    assert ordered(found) == ordered(graph.same_rows(*frames)) != []


def test_equal_builds_and_empty_ones(spark):
    rows = [(i, str(i), None, None) for i in range(50)]
    a, b, none = stored(spark, rows), stored(spark, rows[::-1]), stored(spark, [])
    assert builds.changed_groups(spark, a, b) == [] and builds.differences(spark, a, b).count() == 0
    assert builds.differences(spark, a, none).filter("only_in = 'a'").count() == 50
    assert builds.differences(spark, none, none).count() == 0


def test_only_changed_groups_are_read(spark):
    rows = [(i, "text " * 50 + str(i), None, None) for i in range(3000)]
    a = stored(spark, rows, groups=64)
    b = stored(spark, [(i, "changed" if i == 1234 else t, x, y) for i, t, x, y in rows], groups=64)
    changed = builds.changed_groups(spark, a, b)
    assert len(changed) == 1
    out = builds.differences(spark, a, b)
    assert sorted(r["only_in"] for r in out.collect()) == ["a", "b"]
    read = spark.read.parquet(f"{a}/rows").filter(F.col("_group").isin(changed))
    assert 0 < read.count() < 200
    assert read.select(F.input_file_name()).distinct().count() <= 4
    assert len(re.findall(r"PartitionFilters: \[[^\]]*_group", out._jdf.queryExecution().toString())) >= 2
