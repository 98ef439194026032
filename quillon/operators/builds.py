"""Stored builds of a table, and their differences without reading what agrees.

A build keeps its rows in groups by a hash of their key, with a digest of each group and of each sixteen groups. Two
builds are compared from the top: only where digests differ are those below read, and only groups that differ are read
as rows. So what is read follows the change, not the table.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import replace_text, written

GROUPS, FANOUT = 256, 16
#: Digests of changed rows that are broadcast, at most (about 10 MB).
BROADCAST_CHANGES = 100_000


def row_digest(df: DataFrame) -> Column:
    """A digest of a row's columns, by name, null told from every value."""
    parts = [F.coalesce(F.concat(F.octet_length(F.to_json(F.struct(F.col(f"`{c}`").alias("v")))).cast("string"), F.lit(":"), F.to_json(F.struct(F.col(f"`{c}`").alias("v")))), F.lit("-")) for c in sorted(df.columns)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def _set_digest(digest: str) -> list[Column]:
    """Aggregates that name a bag of digests, whatever its order and however it is split: its size, and sums of its four quarters.

    Sums of 64-bit quarters stay exact as decimals for up to 2^60 rows.
    """
    quarter = lambda i: F.conv(F.substring(digest, 16 * i + 1, 16), 16, 10).cast("decimal(20,0)")
    return [F.count(F.lit(1)).alias("n"), *[F.sum(quarter(i)).cast("decimal(38,0)").alias(f"s{i}") for i in range(4)]]


_SUMS = ("n", "s0", "s1", "s2", "s3")
_LEAVES = "_group int, n long, s0 decimal(38,0), s1 decimal(38,0), s2 decimal(38,0), s3 decimal(38,0), _run int"


def write_build(df: DataFrame, key: list[str], path: str, groups: int = GROUPS) -> None:
    """Write a build: rows by group, group digests, and digests of runs of groups. All builds to compare use equal ``groups``.

    Rows of one key share a group; repeated rows stay. A key that holds most rows makes one large group.
    """
    spark = df.sparkSession
    digest = row_digest(df)
    rows = df.withColumn("_digest", digest).withColumn("_group", F.pmod(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in key]), F.lit(groups)).cast("int"))
    # A group's rows may be in several files, so that no task writes all of a large one.
    rows.repartition(F.col("_group"), F.pmod(F.xxhash64("_digest"), F.lit(4))).write.mode("overwrite").partitionBy("_group").parquet(f"{path}/rows")
    stored = spark.read.schema(rows.schema).parquet(f"{path}/rows").select("_group", "_digest")
    leaves = stored.groupBy("_group").agg(*_set_digest("_digest")).withColumn("_run", F.expr(f"_group div {FANOUT}").cast("int"))
    leaves.repartition(1).write.mode("overwrite").partitionBy("_run").parquet(f"{path}/groups")
    sums = [F.sum(c).cast("decimal(38,0)" if c != "n" else "long").alias(c) for c in _SUMS]
    _leaves(spark, path).groupBy("_run").agg(*sums).coalesce(1).write.mode("overwrite").parquet(f"{path}/runs")
    replace_text(spark, f"{path}/schema.json", rows.schema.json())


def _leaves(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_LEAVES).parquet(f"{path}/groups")


def build_rows(spark: SparkSession, path: str) -> DataFrame:
    """A build's rows, with _digest and _group."""
    schema = T.StructType.fromJson(json.loads(spark.read.text(f"{path}/schema.json", wholetext=True).first()[0]))
    return spark.read.schema(schema).parquet(f"{path}/rows")


def _unlike(a: DataFrame, b: DataFrame, by: str) -> list[int]:
    """The numbers whose digests differ or which only one side has: at most as many as there are groups."""
    right = b.select(by, *[F.col(c).alias(f"_{c}") for c in _SUMS])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _SUMS]
    both = a.select(by, *_SUMS).join(right, by, "full_outer")
    return sorted(r[0] for r in both.filter(~(same[0] & same[1] & same[2] & same[3] & same[4])).select(by).collect())


def changed_groups(spark: SparkSession, a: str, b: str) -> list[int]:
    """Groups in which two builds differ, found from the top."""
    runs = _unlike(spark.read.parquet(f"{a}/runs"), spark.read.parquet(f"{b}/runs"), "_run")
    if not runs:
        return []
    some = [_leaves(spark, p).filter(F.col("_run").isin(runs)) for p in (a, b)]
    return _unlike(*some, "_group")


def differences(spark: SparkSession, a: str, b: str) -> DataFrame:
    """Rows that only one of two builds has, as often as it has them more, with ``only_in``; empty if they are the same."""
    changed = changed_groups(spark, a, b)
    sides = [build_rows(spark, p).filter(F.col("_group").isin(changed) if changed else F.lit(False)) for p in (a, b)]
    names = [c for c in sides[0].columns if c not in ("_digest", "_group")]
    # Equal rows have equal digests, whatever types the columns have: digests alone are counted, then their rows fetched.
    marked = sides[0].select("_digest", F.lit(1).alias("_side")).unionByName(sides[1].select("_digest", F.lit(-1).alias("_side")))
    more = written(marked.groupBy("_digest").agg(F.sum("_side").alias("_more")).filter(F.col("_more") != 0), "build-more")
    # Few changes go to where the rows are; many are met by a shuffle of the changed groups.
    few = F.broadcast(more) if more.count() <= BROADCAST_CHANGES else more
    rows = sides[0].unionByName(sides[1]).join(few, "_digest").groupBy("_digest").agg(F.first("_more").alias("_more"), *[F.first(f"`{c}`").alias(c) for c in names])
    repeated = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.abs("_more").cast("int"))))
    return repeated.select(*[F.col(f"`{c}`") for c in names], F.when(F.col("_more") > 0, "a").otherwise("b").alias("only_in"))
