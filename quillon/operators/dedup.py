"""Duplicates and identity: consolidation, owners, fingerprints, near-duplicate suppression in short lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import canonical_json


def consolidated(chunks: DataFrame, key: str, rest: list[str]) -> DataFrame:
    """One row for each key with the least page and greatest page end; ``conflict`` if the other fields differ."""
    same = F.sha2(canonical_json({c: F.col(c) for c in rest}), 256)
    agg = chunks.withColumn("_d", same).groupBy(key).agg(F.min("page").alias("page"), F.max("page_end").alias("page_end"), F.count(F.lit(1)).alias("rows"), (F.min("_d") != F.max("_d")).alias("conflict"), *[F.min_by(c, "page").alias(c) for c in rest])
    return agg


def first_owner(rows: DataFrame, key: str, owner: str, order: str) -> DataFrame:
    """Of each key: its first owner and the number of later copies, credited to that owner."""
    return rows.groupBy(key).agg(F.min_by(owner, order).alias("owner"), (F.count(F.lit(1)) - 1).alias("copies"))


def repeated(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def chunk_fingerprints(chunks: DataFrame, key: str, fields: list[str]) -> DataFrame:
    return chunks.select(F.col(key), F.sha2(canonical_json({c: F.col(c) for c in fields}), 256).alias("digest"))


def corpus_fingerprint(digests: DataFrame, key: str) -> DataFrame:
    """One digest of all rows, in any order: a tree over the key's SHA-256, so that no task holds them all.

    Leaves are groups of rows with equal first six hex digits, 16 million of them; three digits and none follow above.
    """
    spot = F.sha2(F.col(key).cast("string"), 256)
    joined = lambda value: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("_s")), value), ","), 256).alias("_d")
    level = digests.select(F.substring(spot, 1, 6).alias("_g"), F.struct(F.col(key).alias("k"), "digest").alias("_s"))
    level = level.groupBy("_g").agg(joined(lambda s: F.concat_ws(":", s["k"].cast("string"), s["digest"])), F.count(F.lit(1)).alias("_n"))
    level = level.select(F.substring("_g", 1, 3).alias("_up"), F.struct("_g", "_d").alias("_s"), "_n").groupBy("_up").agg(joined(lambda s: s["_d"]), F.sum("_n").alias("_n"))
    return level.select(F.struct(F.col("_up").alias("_g"), "_d").alias("_s"), "_n").agg(joined(lambda s: s["_d"]).alias("fingerprint"), F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"))


def data_class(rows: DataFrame, digest: str, fixtures: DataFrame) -> DataFrame:
    """``synthetic`` for rows whose digest is a known fixture's, else ``unclassified``."""
    known = fixtures.select(F.col("digest").alias("_k")).distinct()
    return rows.join(known, rows[digest] == known["_k"], "left").withColumn("data_class", F.when(F.col("_k").isNotNull(), "synthetic").otherwise("unclassified")).drop("_k")


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def similar_sets(rows: DataFrame, group: str, key: str, tokens: str, threshold: float) -> DataFrame:
    """Pairs of token sets of one group whose Jaccard similarity reaches the threshold: group, a, b, copies_a, copies_b, jaccard.

    Equal sets form a class named by its least key, so copies make no pairs: pairs are of classes, with their copies.
    Similar sets share one of their first tokens in any common order, as many as the threshold leaves room for; rare
    tokens come first, so hot ones are hardly ever met, and only sets that meet and fit in size are compared. Empty and
    null sets are like nothing.
    """
    sets = rows.select(F.col(group).alias("g"), F.col(key).alias("k"), F.array_sort(F.array_distinct(tokens)).alias("w")).filter(F.size("w") > 0)
    classes = sets.groupBy("g", "w").agg(F.min("k").alias("rep"), F.count(F.lit(1)).alias("copies"))
    each = classes.select("g", "rep", F.size("w").alias("n"), F.explode("w").alias("t"))
    often = each.groupBy("t").agg(F.count(F.lit(1)).alias("f"))
    rare = Window.partitionBy("g", "rep").orderBy("f", "t")
    # A hair less than the threshold, so that no rounding shortens the beginnings.
    first = F.col("n") - F.ceil(F.col("n") * (threshold - 1e-9)) + 1
    posts = each.join(often, "t").withColumn("_r", F.row_number().over(rare)).filter(F.col("_r") <= first).select("g", "t", "rep", "n")
    a, b = posts.select("g", "t", F.col("rep").alias("a"), F.col("n").alias("na")), posts.select("g", "t", F.col("rep").alias("b"), F.col("n").alias("nb"))
    near = (F.col("na") >= F.col("nb") * (threshold - 1e-9)) & (F.col("nb") >= F.col("na") * (threshold - 1e-9))
    met = a.join(b, ["g", "t"]).filter((F.col("a") < F.col("b")) & near).select("g", "a", "b").distinct()
    side = lambda name: classes.select("g", F.col("rep").alias(name), F.col("w").alias(f"w{name}"), F.col("copies").alias(f"copies_{name}"))
    both = met.join(side("a"), ["g", "a"]).join(side("b"), ["g", "b"]).withColumn("jaccard", jaccard(F.col("wa"), F.col("wb")))
    return both.filter(F.col("jaccard") >= threshold).select(F.col("g").alias(group), "a", "b", "copies_a", "copies_b", F.round("jaccard", 6).alias("jaccard"))


def greedy_distinct(items: Column, threshold: float, keep: int | None = None) -> Column:
    """From an ordered array of struct(id, tokens): those not too like one kept before them."""
    start = F.slice(items, 1, 0)

    def add(acc: Column, x: Column) -> Column:
        like = F.exists(acc, lambda y: jaccard(x["tokens"], y["tokens"]) >= threshold)
        full = F.size(acc) >= keep if keep else F.lit(False)
        return F.when(like | full, acc).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(items, start, add)


def equivalence_owners(items: Column) -> Column:
    """From an ordered array of struct(id, keys): struct(id, owner), where a row joins the owner of its first known key.

    Its keys then point to that owner; a row whose keys are all new owns them.
    """
    start = F.struct(F.create_map().cast("map<string,string>").alias("owners"), F.array().cast("array<struct<id:string,owner:string>>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        known = F.filter(F.transform(x["keys"], lambda k: F.element_at(acc["owners"], k)), lambda o: o.isNotNull())
        owner = F.coalesce(F.get(known, F.lit(0)), x["id"].cast("string"))
        mine = F.map_from_entries(F.transform(F.array_distinct(x["keys"]), lambda k: F.struct(k, owner)))
        kept = F.map_filter(acc["owners"], lambda k, v: ~F.array_contains(x["keys"], k))
        return F.struct(F.map_concat(kept, mine).alias("owners"), F.concat(acc["out"], F.array(F.struct(x["id"].cast("string").alias("id"), owner.alias("owner")))).alias("out"))

    return F.aggregate(items, start, add, lambda acc: acc["out"])


def ordered_unique(items: Column) -> Column:
    return F.array_distinct(items)


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in an order."""
    last = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r")
