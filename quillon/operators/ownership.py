"""Ownership of rows by shared keys in the order of the rows, over corpora of any size.

Rows come in an order. One whose keys are all new owns itself; another joins the owner of its first known key, and all
its keys then point to that owner. So what a key points to is always decided by the last row before that had it: each
row has at most one earlier row to ask, its parent, and the owner is the root of the chain of parents. Parents come from
one sort by key and order; chains are followed in rounds that double their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import for_search, squeeze

from .storage import written

# Fixed value: words of a title that only say when or in what revision it appeared.
REVISION_WORDS = "ocak|subat|mart|nisan|mayis|haziran|temmuz|agustos|eylul|ekim|kasim|aralik|revize|revision|20[0-9]{2}"
#: An excerpt of at least so many characters is a key, by so many of its first ones.
LEAST_EXCERPT, EXCERPT = 80, 360


def reference_keys(title: Column, article: Column, excerpt: Column, own: Column) -> Column:
    """Keys of a reference, in order: title without its revision and article, the beginning of a long excerpt, else its own id."""
    fold = lambda c: for_search(F.coalesce(c, F.lit("")))
    plain = squeeze(F.regexp_replace(fold(title), rf"(?U)\b(?:{REVISION_WORDS})\b", " "))
    where, said = fold(article), fold(excerpt)
    keys = F.array_compact(F.array(F.when((plain != "") & (where != ""), F.concat(F.lit("title-article:"), plain, F.lit("|"), where)), F.when(F.char_length(said) >= LEAST_EXCERPT, F.concat(F.lit("excerpt:"), F.left(said, F.lit(EXCERPT))))))
    return F.when(F.size(keys) > 0, keys).otherwise(F.array(F.concat(F.lit("reference:"), own.cast("string"))))


def previous(rows: DataFrame, group: str, order: list[str], value: str, to: str = "previous") -> DataFrame:
    """``rows`` with the value of the row before in the same group, or null.

    A range sort deals rows out, so a group may hold any part of them; the last rows of the parts meet in a table with a
    row for each part.
    """
    parts = written(rows.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()), "previous")
    held = F.struct(F.col(group).alias("g"), F.col(value).alias("v"))
    within = Window.partitionBy("_part").orderBy(group, *order)
    lasts = parts.groupBy("_part").agg(F.max_by(held, F.struct(group, *order)).alias("_last"))
    earlier = lasts.select("_part", F.lag("_last").over(Window.partitionBy(F.lit(0)).orderBy("_part")).alias("_earlier"))
    before = F.coalesce(F.col("_lag"), F.col("_earlier"))
    out = parts.withColumn("_lag", F.lag(held).over(within)).join(earlier, "_part")
    return out.withColumn(to, F.when(before["g"] == F.col(group), before["v"])).drop("_part", "_lag", "_earlier")


def owners(rows: DataFrame) -> DataFrame:
    """(id, owner) of ``rows`` (id, place, keys): places order the rows, keys are arrays in order of preference.

    Ids and places are unique. Null keys, and rows without keys, own themselves. An empty table gives no rows.
    """
    keyed = rows.select("id", "place", F.posexplode(F.array_distinct(F.array_compact("keys"))).alias("nth", "key"))
    asked = previous(keyed, "key", ["place"], "id").filter(F.col("previous").isNotNull())
    parents = asked.groupBy("id").agg(F.min_by("previous", "nth").alias("parent"))
    links = rows.select("id").join(parents, "id", "left").select("id", F.coalesce("parent", "id").alias("owner"), F.col("parent").isNull().alias("done"))
    links = written(links, "owners")
    # Every round doubles what a link reaches; rows that have met their root ask no more, so no root is asked by many.
    while not links.filter("not done").isEmpty():
        further = links.select(F.col("id").alias("owner"), F.col("owner").alias("_next"), F.col("done").alias("_done"))
        moved = links.filter("not done").join(further, "owner").select("id", F.col("_next").alias("owner"), F.col("_done").alias("done"))
        links = written(links.filter("done").unionByName(moved), "owners")
    return links.select("id", "owner")
