"""Evaluation metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(hit: Column, name: str) -> list[Column]:
    """name, name_num and name_den; the ratio is 0 over nothing."""
    num, den = F.count_if(hit), F.count(hit)
    return [F.coalesce(F.round(num / F.nullif(den, F.lit(0)), 4), F.lit(0.0)).alias(name), num.alias(f"{name}_num"), den.alias(f"{name}_den")]


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def precision_recall(rows: DataFrame, predicted: str, expected: str) -> DataFrame:
    """Micro precision, recall and F1 over sets."""
    sums = rows.agg(F.coalesce(F.sum(F.size(F.array_intersect(predicted, expected))), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.size(F.array_except(predicted, expected))), F.lit(0)).alias("fp"), F.coalesce(F.sum(F.size(F.array_except(expected, predicted))), F.lit(0)).alias("fn"))
    safe = lambda a, b: F.coalesce(F.round(a / F.nullif(b, F.lit(0)), 4), F.lit(0.0))
    return sums.select("tp", "fp", "fn", safe(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), safe(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), safe(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def recall_and_mrr(queries: DataFrame, hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Over all queries (query): share with a relevant item among the first k, and mean reciprocal rank."""
    first = hits.filter(F.col("rank") <= k).join(relevant, ["query", "item"]).groupBy("query").agg(F.min("rank").alias("first"))
    return queries.select("query").join(first, "query", "left").agg(F.round(F.avg(F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0)), 4).alias("recall"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 4).alias("mrr"), F.count(F.lit(1)).alias("queries"))


def confusion(rows: DataFrame, expected: str, actual: str) -> DataFrame:
    return rows.groupBy(F.col(expected).alias("expected"), F.col(actual).alias("actual")).agg(F.count(F.lit(1)).alias("n"))


def sliced(rows: DataFrame, tags: str, hit: str) -> DataFrame:
    """A ratio for each tag; a row counts under each of its tags."""
    return rows.select(F.explode(tags).alias("slice"), F.col(hit).alias("_h")).groupBy("slice").agg(*ratio(F.col("_h"), "accuracy"))


def ranking_metrics(hits: DataFrame, grades: DataFrame, k: int = 5, least: int = 2, counts: DataFrame | None = None) -> DataFrame:
    """For each query of ``grades`` (query, item, grade): precision, recall, reciprocal rank and nDCG at k.

    With ``counts`` (query, grade, n), how many items of each grade a query has, ``grades`` needs only those of the hits.
    """
    counts = grades.groupBy("query", "grade").agg(F.count(F.lit(1)).alias("n")) if counts is None else counts
    better = Window.partitionBy("query").orderBy(F.desc("grade")).rowsBetween(Window.unboundedPreceding, -1)
    gain = (F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("rank") + 1)
    # The best k items of a query stand at the ranks after those of better grades.
    placed = counts.withColumn("_before", F.coalesce(F.sum("n").over(better), F.lit(0))).filter(F.col("_before") < k)
    ideal = placed.select("query", "grade", F.explode(F.sequence(F.col("_before") + 1, F.least(F.col("_before") + F.col("n"), F.lit(k)))).alias("rank")).groupBy("query").agg(F.sum(gain).alias("ideal"))
    total = counts.groupBy("query").agg(F.coalesce(F.sum(F.when(F.col("grade") >= least, F.col("n"))), F.lit(0)).alias("relevant"))
    seen = hits.filter(F.col("rank") <= k).join(grades, ["query", "item"], "left").fillna({"grade": 0})
    got = seen.groupBy("query").agg(F.sum(gain).alias("dcg"), F.count_if(F.col("grade") >= least).alias("found"), F.count(F.lit(1)).alias("returned"), F.min(F.when(F.col("grade") >= least, F.col("rank"))).alias("first"))
    out = total.join(ideal, "query").join(got, "query", "left").fillna({"dcg": 0.0, "found": 0, "returned": 0})
    safe = lambda a, b: F.coalesce(F.round(a / F.nullif(b, F.lit(0)), 4), F.lit(0.0))
    return out.select("query", safe(F.col("found"), F.col("returned")).alias("precision_returned"), F.round(F.col("found") / k, 4).alias("precision_at_k"), safe(F.col("found"), F.col("relevant")).alias("recall_at_k"), F.coalesce(F.round(1 / F.col("first"), 4), F.lit(0.0)).alias("reciprocal_rank"), safe(F.col("dcg"), F.nullif("ideal", F.lit(0.0))).alias("ndcg"))


def family_recall(hits: DataFrame, grades: DataFrame, k: int = 5, least: int = 2) -> DataFrame:
    """For each query of ``grades`` (query, item, grade, family): the share of its relevant families among the first k hits; 0 without any."""
    relevant = grades.filter(F.col("grade") >= least)
    total = relevant.groupBy("query").agg(F.count_distinct("family").alias("families"))
    found = hits.filter(F.col("rank") <= k).join(relevant, ["query", "item"]).groupBy("query").agg(F.count_distinct("family").alias("_n"))
    out = grades.select("query").distinct().join(total, "query", "left").join(found, "query", "left").fillna(0)
    return out.select("query", "families", F.coalesce(F.round(F.col("_n") / F.nullif("families", F.lit(0)), 4), F.lit(0.0)).alias("family_recall"))


def hard_negatives(queries: DataFrame, hits: DataFrame, negatives: DataFrame, k: int = 5) -> DataFrame:
    """For each query: how many of its ``negatives`` (query, item) are among the first k hits."""
    met = hits.filter(F.col("rank") <= k).join(negatives.select("query", "item").distinct(), ["query", "item"]).groupBy("query").agg(F.count_distinct("item").alias("hard_negatives"))
    return queries.select("query").join(met, "query", "left").fillna({"hard_negatives": 0})


def macro(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the mean of each per-query metric over all queries, each query counting once, with their number."""
    return rows.agg(*[F.round(F.avg(F.col(c).cast("double")), 4).alias(c) for c in columns], F.count(F.lit(1)).alias("queries"))


def control_metrics(rows: DataFrame) -> DataFrame:
    """(expected_abstain, abstained): false answers and false abstentions."""
    return rows.agg(F.count_if(F.col("expected_abstain") & ~F.col("abstained")).alias("false_answers"), F.count_if(~F.col("expected_abstain") & F.col("abstained")).alias("false_abstentions"), F.count(F.lit(1)).alias("queries"))


def pass_by_category(rows: DataFrame, category: str, passed: str) -> DataFrame:
    """Pass ratios; what failed is ``failures``, a table of its own, as a category's failures may be many."""
    return rows.groupBy(category).agg(*ratio(F.col(passed), "pass_rate"))


def failures(rows: DataFrame, category: str, passed: str, key: str) -> DataFrame:
    """The keys of the rows that did not pass, with their category; a verdict that is null did not pass."""
    return rows.filter(~F.coalesce(F.col(passed), F.lit(False))).select(category, key)


def nearest_rank(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """p50 and p95 by nearest rank, and the largest."""
    disc = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")
    return rows.groupBy(*by).agg(disc(0.5).alias("p50"), disc(0.95).alias("p95"), F.max(value).alias("largest"), F.count(value).alias("n"))


def metric_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """(metric, value) of two runs: differences of the metrics that both have."""
    return a.select("metric", F.col("value").alias("before")).join(b.select("metric", F.col("value").alias("after")), "metric").withColumn("delta", F.round(F.col("after") - F.col("before"), 4))


def top_k_accuracy(ranked: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 3)) -> DataFrame:
    """One row: of ``truth`` (query, expected) the share whose expected item is among the first k of ``ranked`` (query, item, rank); a query without hits misses."""
    at = ranked.join(truth, "query").filter(F.col("item") == F.col("expected")).groupBy("query").agg(F.min("rank").alias("_at"))
    both = truth.join(at, "query", "left")
    return both.agg(*[F.round(F.avg(F.when(F.col("_at") <= k, 1.0).otherwise(0.0)), 4).alias(f"top{k}") for k in ks], F.count(F.lit(1)).alias("queries"))
