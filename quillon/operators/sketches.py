"""Approximate aggregates that are kept and merged, and a weighted sample that estimates sums.

A sketch is a column of bytes of bounded size: made by day or partition, stored beside other columns, and merged over
any set of them later, without the rows it came from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Registers of a distinct-count sketch as a power of two (error about 0.8 %), and the accuracy of a quantile sketch.
LG_K, KLL_K = 14, 400


def sketched(rows: DataFrame, by: list[str], distinct: str, measured: str) -> DataFrame:
    """For each group its rows, a sketch of distinct values of one column, and one of quantiles of another.

    Null values are in neither sketch. A group of any size is summed in parts before it is shuffled.
    """
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.hll_sketch_agg(distinct, LG_K).alias("distinct_sketch"), F.kll_sketch_agg_double(F.col(measured).cast("double"), KLL_K).alias("quantile_sketch"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of coarser groups, from those of finer ones."""
    return sketches.groupBy(*by).agg(F.sum("rows").alias("rows"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"))


def distinct_estimate(sketch: Column) -> Column:
    return F.hll_sketch_estimate(sketch)


def quantile_estimate(sketch: Column, share: float) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(share))


def priority_sample(rows: DataFrame, key: Column, weight: Column, n: int, seed: int = 1) -> DataFrame:
    """``n`` rows by priority (weight over a uniform number that the key and the seed give), with ``estimate``.

    Sums of the estimates over any part of the rows estimate the sums of the weights, without bias; heavy rows are always
    in. With ``n`` rows or fewer all are in, with their weights. Rows of no positive weight are never in. Each partition
    keeps its best n + 1, so no more are shuffled.
    """
    # 52 bits of a digest, as the part of 2^52 that they are, above 0.
    share = (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"))), 1, 13), 16, 10).cast("double") + 1) / F.lit(2.0**52)
    ranked = rows.withColumn("_weight", weight.cast("double")).filter("_weight > 0").withColumn("_priority", F.col("_weight") / share).withColumn("_key", key.cast("string"))
    best = ranked.orderBy(F.desc("_priority"), "_key").limit(n + 1)
    place = Window.partitionBy(F.lit(0)).orderBy(F.desc("_priority"), "_key")
    # The priority of the next row is the weight below which rows are in by chance.
    out = best.withColumn("_place", F.row_number().over(place))
    least = F.coalesce(F.max(F.when(F.col("_place") == n + 1, F.col("_priority"))).over(Window.partitionBy(F.lit(0))), F.lit(0.0))
    return out.withColumn("estimate", F.greatest(F.col("_weight"), least)).filter(F.col("_place") <= n).drop("_weight", "_priority", "_key", "_place")
