"""A stored BM25 index: postings in blocks of documents with what bounds their impact, and search that skips blocks.

``append`` tokenizes documents once and writes a generation of three tables: postings (a row for each term and block of
documents), terms (document frequencies) and corpus (number and length of documents), which is written last and makes
the generation visible. Documents that stand together in the input share a block, so each task makes the postings of its
own blocks, and no posting is shuffled. A block keeps, for each term frequency in it, its shortest document: whatever the
corpus's average length becomes as documents are appended, the greatest of these impacts is the block's, so nothing is
rewritten.

``search`` sums the bounds of a query's terms in each block, scores the blocks of the highest bounds, and so learns a
score that a query's last hit has at least. Blocks in which no query can reach its score are skipped. In the others the
asked terms' postings meet once a block, where all queries are scored together and only the best documents leave, so
neither documents nor hits are multiplied by queries before they are shuffled. The result is exact. A frequent term's
postings are dealt out by block, so none of them meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .dense import in_blocks
from .lexical import DOCUMENT, K1, OFFLINE_K1, B, idf, weight
from .storage import exists, written

#: Documents of a block, and about as many tokens; blocks of each query that are scored before any is skipped.
BLOCK, BLOCK_TOKENS, FIRST_BLOCKS = 128, 500_000, 4
#: Rows of a few numbers that are broadcast, at most.
BROADCAST_ROWS = 1_000_000
#: Sums of doubles in another order differ by less than this; scores are rounded to six places.
SLACK = 2e-6


def append(docs: DataFrame, tokens: Column, path: str, id_column: str = "doc_id", block: int = BLOCK) -> int:
    """Index ``docs`` as a new generation of the index at ``path``; gives its number.

    Ids are unique in the index. A null text has no tokens, and counts as a document of length 0. Readers see all of a
    generation or none: a run that fails before its last write leaves files that nothing reads, under a number that the
    next run overwrites.
    """
    spark = docs.sparkSession
    generation = _generations(spark, path)
    slim = docs.select(docs[f"`{id_column}`"].alias("doc"), *[docs[f"`{c}`"] for c in docs.columns if c not in ("doc", "_t")])
    slim = slim.select("doc", F.coalesce(tokens, F.array().cast("array<string>")).alias("_t"))
    target = f"{path}/postings/generation={generation}"
    _postings(slim, block).write.mode("overwrite").option("compression", "zstd").parquet(target)
    stored = spark.read.parquet(target)
    stored.groupBy("term").agg(F.sum("n").alias("df")).filter(F.col("term") != DOCUMENT).write.mode("overwrite").parquet(f"{path}/terms/generation={generation}")
    lengths = F.aggregate("docs", F.lit(0).cast("long"), lambda a, p: a + p["length"])
    corpus = stored.filter(F.col("term") == DOCUMENT).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum(lengths), F.lit(0)).alias("total_length"))
    corpus.coalesce(1).write.mode("overwrite").parquet(f"{path}/corpus/generation={generation}")
    return generation


def _postings(slim: DataFrame, block: int) -> DataFrame:
    """(term, block, n, shortest, docs) of (doc, _t), each task numbering blocks of its own."""
    kind = slim.schema["doc"].dataType.simpleString()
    schema = f"term string, block long, n int, shortest array<struct<tf:int,length:int>>, docs array<struct<doc:{kind},tf:int,length:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        waiting: list[pa.RecordBatch] = []
        rows = tokens = 0
        for whole in batches:
            sizes = pc.list_value_length(whole.column(1)).to_numpy(zero_copy_only=False)
            first = 0
            for i, n in enumerate(sizes.tolist()):
                rows, tokens = rows + 1, tokens + n
                if rows >= block or tokens >= BLOCK_TOKENS:
                    yield one(number, [*waiting, whole.slice(first, i + 1 - first)])
                    waiting, first, rows, tokens, number = [], i + 1, 0, 0, number + 1
            if first < whole.num_rows:
                waiting.append(whole.slice(first))
        if waiting:
            yield one(number, waiting)

    def one(number: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        lists = table.column(1).combine_chunks()
        ids, length = table.column(0).combine_chunks(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        coded = pc.fill_null(lists.flatten(), DOCUMENT).dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        # Every document has one posting of the term that stands for it, which sorts first.
        term = np.concatenate([np.zeros(len(ids), dtype=np.int64), rank[coded.indices.to_numpy()] + 1])
        owner = np.concatenate([np.arange(len(ids)), np.repeat(np.arange(len(ids)), length)])
        found, tf = np.unique(term * len(ids) + owner, return_counts=True)
        term, owner = found // len(ids), found % len(ids)
        tf, size = tf.astype(np.int32), length[owner].astype(np.int32)
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        ends = np.append(starts[1:], len(term)).astype(np.int32)
        docs = pa.StructArray.from_arrays([ids.take(pa.array(owner)), pa.array(tf), pa.array(size)], names=["doc", "tf", "length"])
        # The first of each term and frequency, in the order of lengths, is the shortest.
        by = np.lexsort((size, tf, term))
        new = np.flatnonzero((np.diff(term[by], prepend=-1) != 0) | (np.diff(tf[by], prepend=-1) != 0))
        least = by[new]
        counts = np.bincount(np.searchsorted(starts, least, side="right") - 1, minlength=len(starts))
        shortest = pa.StructArray.from_arrays([pa.array(tf[least]), pa.array(size[least])], names=["tf", "length"])
        names = pa.concat_arrays([pa.array([DOCUMENT]), coded.dictionary.take(pa.array(order))]).take(pa.array(term[starts]))
        offsets = lambda upto: pa.array(np.concatenate([[0], upto]), pa.int32())
        columns = [names, pa.array(np.full(len(starts), number)), pa.array(ends - starts.astype(np.int32)), pa.ListArray.from_arrays(offsets(np.cumsum(counts)), shortest), pa.ListArray.from_arrays(offsets(ends), docs)]
        return pa.RecordBatch.from_arrays(columns, names=["term", "block", "n", "shortest", "docs"])

    return slim.mapInArrow(run, schema)


def _near(small: DataFrame) -> DataFrame:
    """A table of short rows, broadcast if a count of them says that it is small; else Spark shuffles both sides."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def _generations(spark: SparkSession, path: str) -> int:
    """How many generations are whole; they are numbered from 0 and written one after another."""
    n = 0
    while exists(spark, f"{path}/corpus/generation={n}/_SUCCESS"):
        n += 1
    return n


class Index:
    """What is stored at a path, as of now."""

    def __init__(self, spark: SparkSession, path: str):
        n = _generations(spark, path)
        if not n:
            raise ValueError(f"there is no index at {path}")
        read = lambda table: spark.read.option("basePath", f"{path}/{table}").parquet(*[f"{path}/{table}/generation={g}" for g in range(n)])
        self.postings = read("postings")
        stats = read("corpus").agg(F.sum("n_docs").alias("n"), F.sum("total_length").alias("length")).first()
        self.n_docs, self.average = stats["n"], stats["length"] / max(stats["n"], 1)
        self._terms = read("terms")

    def terms(self) -> DataFrame:
        """(term, df) over all generations."""
        return self._terms.groupBy("term").agg(F.sum("df").alias("df"))

    def _impact(self, tf: Column, length: Column, k1: float) -> Column:
        return weight(tf, length, F.lit(float(self.average)), k1)

    def weights(self, k1: float = OFFLINE_K1) -> DataFrame:
        """(doc, term, weight): the document side of every posting, rounded to 6."""
        each = self.postings.filter(F.col("term") != DOCUMENT).join(self.terms(), "term").select("term", "df", F.inline("docs"))
        return each.select("doc", "term", F.round(idf(F.lit(float(self.n_docs)), F.col("df")) * self._impact(F.col("tf"), F.col("length"), k1), 6).alias("weight"))

    def _asked(self, queries: DataFrame) -> DataFrame:
        """Terms of queries that the index has, with their weights."""
        return written(queries.select("query", "term", "place").join(self.terms(), "term").withColumn("idf", idf(F.lit(float(self.n_docs)), F.col("df"))), "bm25-asked")

    def _bounds(self, asked: DataFrame, k1: float) -> DataFrame:
        """(query, term, generation, block, bound): what a term adds to a document of the block at most. Reads no postings."""
        most = F.array_max(F.transform("shortest", lambda s: self._impact(s["tf"], s["length"], k1)))
        blocks = self.postings.select("term", "generation", "block", most.alias("impact"))
        return blocks.join(asked, "term").select("query", "term", "generation", "block", (F.col("idf") * F.col("impact")).alias("bound"))

    def _scored(self, asked: DataFrame, blocks: DataFrame, k: int, k1: float) -> DataFrame:
        """(query, doc, score, matched_terms): of each block the best k documents of each query, those below its ``least`` left out.

        ``asked`` has query, term, place, idf and least. The postings of the asked terms meet once a block, however many
        queries ask for them; a block is bounded, and the queries come to it by a broadcast of at most so many rows.
        """
        wanted = self.postings.select("term", "generation", "block", "docs").join(_near(blocks.select("generation", "block").distinct()), ["generation", "block"], "left_semi")
        parts = in_blocks(asked, BROADCAST_ROWS, F.xxhash64(F.lit(9), "query"))
        return reduce(DataFrame.unionByName, [self._scored_by(part, wanted, k, k1) for part in parts])

    def _scored_by(self, asked: DataFrame, wanted: DataFrame, k: int, k1: float) -> DataFrame:
        kinds = asked.schema["query"].dataType.simpleString(), self.postings.schema["docs"].dataType.elementType["doc"].dataType.simpleString()
        shared = asked.sparkSession.sparkContext.broadcast(_Asked(asked.select("query", "term", "place", "idf", "least").toArrow()))
        average, b = max(float(self.average), 1.0), B

        def score(table: pa.Table) -> pa.Table:
            return shared.value.best(table.combine_chunks(), average, k, k1, b)

        terms = asked.select("term").distinct()
        # The terms of the queries are a broadcast or a shuffle, as Spark finds them small or not.
        return wanted.join(terms, "term", "left_semi").groupBy("generation", "block").applyInArrow(score, f"query {kinds[0]}, doc {kinds[1]}, score double, matched_terms array<string>")

    def _blocks(self, queries: DataFrame, k: int, k1: float) -> tuple[DataFrame, DataFrame]:
        """Asked terms with ``least``, a score that the k-th hit of the query has at least (or null), and (query, generation, block, bound, least)."""
        asked = self._asked(queries)
        best = Window.partitionBy("query").orderBy(F.desc("bound"), "generation", "block")
        bounds = written(self._bounds(asked, k1).groupBy("query", "generation", "block").agg(F.sum("bound").alias("bound")), "bm25-bounds")
        first = written(bounds.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= FIRST_BLOCKS).drop("_r"), "bm25-first")
        # What the first blocks of any query hold, for every query.
        hits = self._scored(asked.withColumn("least", F.lit(None).cast("double")), first, k, k1)
        last = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
        least = hits.withColumn("_r", F.row_number().over(last)).filter(F.col("_r") == k).select("query", F.col("score").alias("least"))
        least = written(least, "bm25-least")
        return written(asked.join(least, "query", "left"), "bm25-terms"), bounds.join(least, "query", "left")

    def search(self, queries: DataFrame, k: int = 10, k1: float = K1) -> DataFrame:
        """From ``queries`` (query, term, place), distinct terms in order: query, doc, rank, score, matched_terms.

        Scores are rounded before ranking, ties go to the least document. A query without terms of the index has no hits.
        """
        asked, blocks = self._blocks(queries, k, k1)
        hits = self._scored(asked, blocks.filter(~_skipped()), k, k1)
        best = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
        return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    def work(self, queries: DataFrame, k: int = 10, k1: float = K1) -> DataFrame:
        """(query, blocks, skipped): how many blocks hold a term of the query, and in how many of them no document can be a hit."""
        return self._blocks(queries, k, k1)[1].groupBy("query").agg(F.count(F.lit(1)).alias("blocks"), F.count_if(_skipped()).alias("skipped"))


def _skipped() -> Column:
    return F.coalesce(F.col("bound") + SLACK < F.col("least"), F.lit(False))


class _Asked:
    """Terms of queries, to score a block at a time."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks().sort_by([("query", "ascending"), ("place", "ascending")])
        self.terms = table.column("term").to_pylist()
        ids = table.column("query").combine_chunks().dictionary_encode()
        self.queries, self.query = ids.dictionary, ids.indices.to_numpy()
        self.idf = table.column("idf").to_numpy()
        self.least = np.full(len(self.queries), -np.inf)
        self.least[self.query] = table.column("least").to_pandas().fillna(-np.inf).to_numpy()
        self.rows: dict[str, list[int]] = {}
        for i, t in enumerate(self.terms):
            self.rows.setdefault(t, []).append(i)

    def best(self, block: pa.Table, average: float, k: int, k1: float, b: float) -> pa.Table:
        terms, lists = block.column("term").to_pylist(), block.column("docs").combine_chunks()
        sizes = pc.list_value_length(lists).to_numpy()
        docs = lists.flatten()
        ids = docs.field("doc").dictionary_encode()
        tf, length = docs.field("tf").to_numpy().astype(float), docs.field("length").to_numpy()
        impact = tf * (k1 + 1) / (tf + k1 * (1 - b + b * np.maximum(length, 1) / average))
        asked = [self.rows.get(t, []) for t in terms]
        # Every posting of a term, for every query that asks for it.
        starts = np.cumsum(sizes) - sizes
        row = np.concatenate([np.repeat(np.asarray(r, dtype=np.int64), n) for r, n in zip(asked, sizes.tolist(), strict=True)])
        at = np.concatenate([np.tile(np.arange(s, s + n), len(r)) for r, s, n in zip(asked, starts.tolist(), sizes.tolist(), strict=True)])
        width = len(ids.dictionary)
        spot = self.query[row].astype(np.int64) * width + ids.indices.to_numpy()[at]
        order = np.argsort(spot, kind="stable")
        spot, row = spot[order], row[order]
        first = np.flatnonzero(np.diff(spot, prepend=-1))
        score = np.round(np.add.reduceat((self.idf[row] * impact[at[order]]), first), 6) if len(first) else np.empty(0)
        query, doc = spot[first] // width, spot[first] % width
        keep = (score > 0) & (score + SLACK >= self.least[query])
        # The best k of each query, by score, then by document.
        by_doc = np.empty(width, dtype=np.int64)
        by_doc[pc.sort_indices(ids.dictionary).to_numpy()] = np.arange(width)
        some = np.flatnonzero(keep)
        some = some[np.lexsort((by_doc[doc[some]], -score[some], query[some]))]
        some = some[np.arange(len(some)) - np.searchsorted(query[some], query[some]) < k]
        ends = np.append(first[1:], len(spot))
        matched = [[self.terms[i] for i in np.sort(row[first[j] : ends[j]])] for j in some.tolist()]
        return pa.table({"query": self.queries.take(pa.array(query[some])), "doc": ids.dictionary.take(pa.array(doc[some])), "score": pa.array(score[some]), "matched_terms": pa.array(matched, pa.list_(pa.string()))})
