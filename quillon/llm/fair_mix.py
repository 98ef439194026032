"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a keyed-hash order, read again for a second epoch once it is through.
An entry's virtual finish time is the words its source has given out so far, divided by the source's target. All
entries are ordered by finish time over all sources and the order is truncated at the total budget.

No task sees a whole source: a source's rows are dealt into hash buckets, bucket sums give each bucket its offset,
and the running sum is taken inside a bucket only, over distinct rows. The cut is found from sums over slices of the
finish time, then over slices of the slice that crosses the budget; only the crossing slice of a slice, one part in
16 million of a unit, is ordered row by row. What comes out is one cut per source and epoch, a table as small as the
list of sources, which alone meets in one task; applying it needs no shuffle of the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, text_of, whole_row, written

#: Buckets of a source: one for so many rows of the table, and at least so many.
BUCKET_ROWS, LEAST_BUCKETS = 20_000, 64
#: Slices of one unit of finish time.
SLICES = 4096
#: Sources up to this many are broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 50_000


def _maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_SOURCES else df


def _order_key(key: Column, buckets: int) -> list[Column]:
    """A document's place in its queue: hash bucket, hash of seed, id and text."""
    return [F.pmod(key, F.lit(buckets)).cast("int").alias("_bucket"), key.alias("_key")]


def _crossing(entries: DataFrame, slice_of: str, base: float, budget: float) -> tuple[int, float] | None:
    """The slice in which the running total passes the budget, and the total before it."""
    upto = Window.orderBy(slice_of).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # At most as many rows as there are slices.
    slices = entries.groupBy(slice_of).agg(F.sum("_size").alias("_sum")).withColumn("_total", F.sum("_sum").over(upto) + F.lit(base))
    found = slices.filter(F.col("_total") > budget).orderBy(slice_of).first()
    return None if found is None else (found[slice_of], found["_total"] - found["_sum"])


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), total_percent: float = 150, max_repeats: int = 2) -> DataFrame:
    """Targets of the sources of ``sizes`` (_source, _size): _source, _rank, source_size, target.

    Sources by code point, null last, take the weights in turn. A target stops at ``max_repeats`` times the source's
    size; the excess is shared again by weight until none is above. This is a water level: a source is full if its
    limit over its weight lies below the level, and the level follows from the limits of the full ones.
    """
    totals = sizes.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    rank = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    by_limit = Window.orderBy("_limit", "_rank")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    ranked = totals.withColumn("_rank", rank).withColumn("_weight", weight)
    ranked = ranked.withColumn("_limit", max_repeats * F.col("source_size") / F.col("_weight"))
    ranked = ranked.withColumn("_budget", F.sum("source_size").over(everything) * (total_percent / 100))
    full = F.coalesce(F.sum(max_repeats * F.col("source_size")).over(before), F.lit(0))
    left = F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    ranked = ranked.withColumn("_level", (F.col("_budget") - full) / left)
    # The level is right from the first source that it does not fill on.
    level = F.min(F.when(F.col("_level") <= F.col("_limit"), F.struct("_limit", "_rank", "_level"))).over(everything)["_level"]
    target = F.least(max_repeats * F.col("source_size").cast("double"), F.coalesce(level * F.col("_weight"), max_repeats * F.col("source_size").cast("double")))
    return ranked.select("_source", "_rank", "source_size", target.alias("target"))


def fair_mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), total_percent: float = 150, max_repeats: int = 2, seed: int = 7, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """``docs`` with _size (words), _source_size, _target and _copies (times the mix takes the document).

    - A null or empty text has size 0 and is taken 0 times; a null source is a source of its own; null ids are ids.
    - Texts of any length count whole and are taken whole, so a source misses its target by less than its last one.
    - Ties in finish time go by source, then epoch. Rows that agree in source, id and text share their fate.
    - The order depends on ids, texts and the seed only, so reruns agree.
    - An empty table gives no rows. Other columns may have any names; those of the added names are replaced.
    """
    size = F.coalesce(F.regexp_count(text_of(docs, text_column), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.xxhash64(F.lit(seed), docs[id_column], docs[text_column])
    slim = written(docs.select(docs[source_column].alias("_source"), docs[id_column].alias("_id"), key.alias("_key"), size.alias("_size")), "mix-sizes")
    targets = written(source_targets(slim, weights, total_percent, max_repeats), "mix-targets")
    n_sources = targets.count()
    buckets = max(LEAST_BUCKETS, slim.count() // BUCKET_ROWS)
    # Repeated rows are one entry of their sizes together, so that they cannot crowd a bucket.
    queue = slim.filter("_size > 0").groupBy("_source", "_id", "_key", F.col("_size").alias("_each")).agg(F.sum("_size").alias("_size"))
    queue = queue.select("_source", "_id", "_size", *_order_key(F.col("_key"), buckets))

    group = Window.partitionBy("_source", "_bucket")
    inner = group.orderBy("_key", "_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = queue.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_sum"))
    ahead = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_source", "_bucket", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_offset"))
    run = queue.withColumn("_run", F.sum("_size").over(inner))
    same = [run["_source"].eqNullSafe(offsets["_source"]), run["_bucket"] == offsets["_bucket"]]
    run = run.join(offsets, same).select(run["*"], (run["_run"] + offsets["_offset"]).alias("_through"))
    small = _maybe_broadcast(targets, n_sources)
    run = run.join(small, run["_source"].eqNullSafe(small["_source"])).select(run["*"], small["_rank"], small["source_size"], small["target"])
    epochs = F.explode(F.array(*[F.struct(F.lit(e).alias("epoch"), ((F.col("source_size") * e + F.col("_through")) / F.col("target")).alias("finish")) for e in range(max_repeats)]))
    entries = run.select("_rank", "_bucket", "_key", "_id", "_size", epochs.alias("_e")).select("_rank", "_bucket", "_key", "_id", "_size", "_e.epoch", "_e.finish")
    entries = written(entries.withColumn("_slice", F.least(F.floor(F.col("finish") * SLICES), F.lit(2 * SLICES)).cast("long")), "mix-entries")

    # Everything in earlier slices than the crossing one is taken, and of that one what is in earlier parts of it.
    budget = slim.agg(F.coalesce(F.sum("_size"), F.lit(0)).alias("all")).first()["all"] * total_percent / 100
    crossing = _crossing(entries, "_slice", 0.0, budget)
    taken = entries
    if crossing is not None:
        at, base = crossing
        part = F.least(F.floor((F.col("finish") * SLICES - at) * SLICES), F.lit(SLICES)).cast("long")
        entries = entries.withColumn("_part", F.when(F.col("_slice") == at, part).otherwise(F.sign(F.col("_slice") - at) * 2 * SLICES).cast("long"))
        at, base = _crossing(entries.filter(F.col("_slice") == at), "_part", base, budget)
        in_part = Window.orderBy("finish", "_rank", "epoch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        last = entries.filter(F.col("_part") == at).withColumn("_total", F.sum("_size").over(in_part) + F.lit(base))
        last = last.filter(F.col("_total") <= budget).orderBy(F.desc("finish"), F.desc("_rank")).first()
        cut = (F.col("finish") < last["finish"]) | ((F.col("finish") == last["finish"]) & (F.col("_rank") <= last["_rank"])) if last else F.lit(False)
        taken = entries.filter((F.col("_part") < at) | ((F.col("_part") == at) & cut))

    place = F.struct("_bucket", "_key", "_id")
    cuts = taken.groupBy("_rank").agg(*[F.max(F.when(F.col("epoch") == e, place)).alias(f"_cut{e}") for e in range(max_repeats)])
    cuts = cuts.withColumnRenamed("_rank", "_r")
    plan = written(targets.join(cuts, targets["_rank"] == cuts["_r"], "left").drop("_r", "_rank"), "mix-cuts")
    plan = _maybe_broadcast(plan, n_sources)

    sized = docs.select(whole_row(docs), docs[id_column].alias("_id"), docs[source_column].alias("_own_source"), key.alias("_own_key"), size.alias("_size"))
    own = F.struct(*_order_key(F.col("_own_key"), buckets), F.col("_id"))
    copies = sum((F.coalesce(own <= plan[f"_cut{e}"], F.lit(False)).cast("int") for e in range(max_repeats)), F.lit(0))
    out = sized.join(plan, sized["_own_source"].eqNullSafe(plan["_source"]))
    added = ("_size", "_source_size", "_target", "_copies")
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c.lower() not in added]
    return out.select(*kept, F.col("_size"), plan["source_size"].alias("_source_size"), plan["target"].alias("_target"), F.when(F.col("_size") > 0, copies).otherwise(0).alias("_copies"))


def mixed_rows(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``."""
    mix = fair_mix(docs, **settings)
    repeated = mix.filter("_copies > 0").select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"))
    return repeated.select(*[f"`{c}`" for c in docs.columns])
