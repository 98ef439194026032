"""Dense retrieval: vector checks, normalization, filtered cosine top k."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import products

#: Pairs of columns, of queries and of vectors.
Names = tuple[tuple[str, str], ...]
#: Query vectors up to this many are broadcast at once; more are matched in blocks of the queries, one after the other.
BROADCAST_QUERIES, BROADCAST_BYTES = 10_000, 64 << 20


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_fault(v: Column, dimension: int) -> Column:
    """Why a vector cannot be used, or null."""
    wrong = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(v.isNull(), "missing").when(F.size(v) != dimension, "dimension").when(wrong, "not_finite").when(norm(v) == 0, "zero")


def normalized(v: Column) -> Column:
    n = norm(v)
    return F.transform(v, lambda x: x.cast("double") / n)


def cosine_top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, equal: Names = (), differ: Names = ()) -> DataFrame:
    """``queries`` (query, qv, ...) against ``vectors`` (item, v, ...): query, item, rank, score rounded to 6.

    ``equal`` and ``differ`` name pairs of columns, of the queries and of the vectors, that have to agree or to differ;
    null does neither. Scores are matrix products of blocks inside each task, which keeps its own best, so only k rows a
    query and task are shuffled. Queries beyond the bound are split by hash into blocks, each of which is broadcast; a
    query's rows share a block, so its top k is exact. Vectors and queries that are null, zero, not finite or of another
    dimension have no scores. Ties go to the least item.
    """
    best = Window.partitionBy("query").orderBy(F.desc("score"), "item")

    def top(asked: products.Asked, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        kept = products.Best(k)
        for batch in batches:
            for first, held, scores in asked.scores(batch, equal, differ):
                kept.add(first, held.column(held.schema.get_field_index("item")), scores)
        if (found := kept.table(asked.ids)) is not None:
            yield found

    hits = _multiplied(queries, vectors, top, [], equal, differ)
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def cosine_best(queries: DataFrame, vectors: DataFrame, group: str, equal: Names = (), differ: Names = ()) -> DataFrame:
    """(query, group, item, score): of each block of vectors the best item of each group; for ``best_per_chunk``."""

    def best(asked: products.Asked, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for batch in batches:
            for first, held, scores in asked.scores(batch, equal, differ, (group, "item")):
                column = lambda c: held.column(held.schema.get_field_index(c))  # noqa: B023, E731
                for row, place, score in products.best_of_groups(held, group, scores):
                    yield pa.table({"query": asked.ids.take(pa.array(row + first)), "item": column("item").take(pa.array(place)), "score": pa.array(score), group: column(group).take(pa.array(place))})

    return _multiplied(queries, vectors, best, [group], equal, differ)


def _multiplied(queries: DataFrame, vectors: DataFrame, run: Callable, carry: list[str], equal: Names, differ: Names) -> DataFrame:
    """What ``run`` makes of the queries, a block at a time, and each task's vectors: query, item, score, and carried columns."""
    mine = list(dict.fromkeys(["query", "qv", *[a for a, _ in (*equal, *differ)]]))
    theirs = list(dict.fromkeys(["item", "v", *carry, *[b for _, b in (*equal, *differ)]]))
    asked, held = queries.select(*mine), vectors.select(*theirs)
    schema = T.StructType([T.StructField("query", asked.schema["query"].dataType), T.StructField("item", held.schema["item"].dataType), T.StructField("score", T.DoubleType()), *[held.schema[c] for c in carry]])

    def of(block: DataFrame) -> DataFrame:
        shared = block.sparkSession.sparkContext.broadcast(products.Asked(block.toArrow()))

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in run(shared.value, batches):
                yield from table.combine_chunks().to_batches(max_chunksize=10_000)

        return held.mapInArrow(each, schema)

    wide = asked.agg(F.max(F.size("qv"))).first()[0] or 1
    most = max(1, min(BROADCAST_QUERIES, BROADCAST_BYTES // (8 * max(wide, 1))))
    blocks = in_blocks(asked, most, F.xxhash64(F.lit(5), "query"))
    return reduce(DataFrame.unionByName, [of(b) for b in blocks])


def trusted(vectors: DataFrame, equal: dict[str, object], allowed: DataFrame | None = None) -> DataFrame:
    """Vectors whose columns have the values that a search is bound to (such as a corpus fingerprint), with items of the list if one is given.

    Columns that are null differ from every value. The values reach the scan as filters; the list is a semi-join, which
    keeps each vector once however often the list names it.
    """
    for name, value in equal.items():
        vectors = vectors.filter(F.col(name) == F.lit(value))
    return vectors if allowed is None else vectors.join(allowed.select("item"), "item", "left_semi")


def in_blocks(rows: DataFrame, most: int, key: Column) -> list[DataFrame]:
    """``rows`` whole if there are at most so many, else split by a hash into blocks of about half as many, which chance hardly fills."""
    n = rows.count()
    if n <= most:
        return [rows]
    blocks = -(-2 * n // most)
    return [rows.filter(F.pmod(key, F.lit(blocks)) == b) for b in range(blocks)]


def best_per_chunk(hits: DataFrame, k: int) -> DataFrame:
    """Of (query, chunk, item, score): the best item of each chunk, then the k best chunks; exact, without over-fetching."""
    best = Window.partitionBy("query").orderBy(F.desc("score"), "chunk")
    # Each partition keeps one item of a chunk before anything is shuffled.
    one = hits.groupBy("query", "chunk").agg(F.min(F.struct((-F.col("score")).alias("s"), "item")).alias("_b"))
    one = one.select("query", "chunk", F.col("_b.item").alias("item"), (-F.col("_b.s")).alias("score"))
    return one.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def readiness(vectors: DataFrame, expected: int, compatible: Column) -> DataFrame:
    """One row: expected, total and compatible counts, and whether all agree."""
    counts = vectors.agg(F.lit(expected).cast("long").alias("expected"), F.count(F.lit(1)).alias("total"), F.count_if(compatible).alias("compatible"))
    return counts.withColumn("ready", (F.col("expected") == F.col("total")) & (F.col("total") == F.col("compatible")))


def reverified(hits: DataFrame, digests: DataFrame) -> DataFrame:
    """Hits (item, digest, ...) with ``trusted``: whether the item's recorded digest is still the same."""
    return hits.join(digests.select("item", F.col("digest").alias("_now")), "item", "left").withColumn("trusted", F.col("digest").eqNullSafe(F.col("_now"))).drop("_now")


def passage_text(context: Column, text: Column) -> Column:
    """What is embedded: context and text, both required; null otherwise."""
    return F.when((F.trim(context) != "") & (F.trim(text) != ""), F.concat(F.trim(context), F.lit("\n\n"), F.trim(text)))


def hash_embedding(dimension: int = 64, task: str = "passage"):
    """A deterministic stand-in for a model: bytes of a SHA-256 counter stream, scaled to [-1, 1] and normalized."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[float] | None:
            if text is None:
                return None
            raw = b"".join(hashlib.sha256(f"{task}\0{k}\0{text}".encode()).digest() for k in range(-(-dimension // 32)))[:dimension]
            values = [(b - 127.5) / 127.5 for b in raw]
            n = sum(x * x for x in values) ** 0.5
            return [x / n for x in values]

        return texts.map(one)

    return embed


def contract_faults(provider: dict, store: dict) -> list[str]:
    """Settings (model, revision, dimension, distance, normalized) in which an embedding provider and a store differ."""
    return sorted(k for k in provider.keys() | store.keys() if provider.get(k) != store.get(k))
