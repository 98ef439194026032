"""Lexical retrieval: postings, corpus statistics, BM25 top k, catalog overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import once

K1, OFFLINE_K1, B = 1.5, 1.2, 0.75


#: The term of the row that every document has beside its postings: its count is 1, whatever the document holds.
DOCUMENT = ""


def postings(docs: DataFrame, tokens: Column, id_column: str = "doc_id", wanted: DataFrame | None = None) -> DataFrame:
    """(doc, length, term, tf) and a row of the term DOCUMENT for each document; of ``wanted`` terms (term) only, if given.

    One scan, one evaluation of the tokens and one shuffle, with partial counts first. Statistics of terms and of the
    corpus are aggregates of the same shuffle, so Spark reuses it for them.
    """
    slim = once(docs.select(docs[id_column].alias("doc"), *_inputs(docs, tokens)), _t=tokens)
    terms = F.explode(F.transform(F.concat(F.array(F.lit(DOCUMENT)), F.coalesce("_t", F.array().cast("array<string>"))), lambda t: F.coalesce(t, F.lit(DOCUMENT))))
    exploded = slim.select("doc", F.greatest(F.size("_t"), F.lit(0)).alias("length"), terms.alias("term"))
    if wanted is not None:
        asked = wanted.select("term").unionByName(docs.sparkSession.range(1).select(F.lit(DOCUMENT).alias("term"))).distinct()
        exploded = exploded.join(asked, "term", "left_semi")
    return exploded.groupBy("doc", "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def _inputs(docs: DataFrame, tokens: Column) -> list[Column]:
    return [docs[f"`{c}`"] for c in docs.columns if c not in ("doc", "_t")]


def term_stats(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("tf").alias("df"))


def corpus_stats(post: DataFrame) -> DataFrame:
    """One row: number of documents and average length."""
    whole = F.col("term") == DOCUMENT
    return post.agg(F.sum(F.when(whole, F.col("tf")).otherwise(0)).alias("n_docs"), F.avg(F.when(whole, F.col("length"))).alias("avg_length"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def weight(tf: Column, length: Column, average: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.greatest(length, F.lit(1)) / F.greatest(average, F.lit(1.0))))


def bm25_top_k(queries: DataFrame, docs: DataFrame, tokens: Column, k: int = 10, id_column: str = "doc_id", k1: float = K1) -> DataFrame:
    """From ``queries`` (query, term, place), distinct terms in order: query, doc, rank, score, matched_terms.

    Postings of terms that no query asks for go before anything is shuffled: the query terms, a vocabulary as small as
    the queries, filter the exploded tokens. Scores are rounded before ranking, ties go to the least document.
    """
    post = postings(docs, tokens, id_column, queries)
    stats, df = corpus_stats(post), term_stats(post)
    scored = queries.join(post, "term").join(df, "term").join(F.broadcast(stats))
    part = idf(F.col("n_docs"), F.col("df")) * weight(F.col("tf"), F.col("length"), F.col("avg_length"), k1)
    hits = scored.withColumn("_w", part).groupBy("query", "doc").agg(F.round(F.sum("_w"), 6).alias("score"), F.transform(F.sort_array(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]).alias("matched_terms"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return hits.filter("score > 0").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def sparse_weights(docs: DataFrame, tokens: Column, id_column: str = "doc_id", k1: float = OFFLINE_K1) -> DataFrame:
    """Document side weights of the offline index: doc, term, weight rounded to 6."""
    post = postings(docs, tokens, id_column)
    joined = post.join(term_stats(post), "term").join(F.broadcast(corpus_stats(post))).filter(F.col("term") != DOCUMENT)
    return joined.select("doc", "term", F.round(idf(F.col("n_docs"), F.col("df")) * weight(F.col("tf"), F.col("length"), F.col("avg_length"), k1), 6).alias("weight"))


def vocabulary(post: DataFrame) -> DataFrame:
    """Terms numbered from 0 in order: numbers within range partitions, and the partitions' sizes before them."""
    terms = post.select("term").distinct().filter(F.col("term") != DOCUMENT).repartitionByRange("term").withColumn("_part", F.spark_partition_id())
    sizes = terms.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("term")) - 1
    return terms.withColumn("_i", inside).join(F.broadcast(before), "_part").select("term", (F.col("_i") + F.col("_before")).alias("term_id"))


def catalog_search(queries: DataFrame, catalog: DataFrame, k: int = 12) -> DataFrame:
    """``queries`` (query, tokens) against ``catalog`` (entry, name, type_tokens, tokens): overlap of tokens of three or more characters, 2 for those of the type."""
    asked = queries.select("query", F.explode(F.array_distinct("tokens")).alias("token")).filter(F.length("token") >= 3)
    listed = catalog.select("entry", "name", F.explode(F.array_distinct(F.concat("tokens", "type_tokens"))).alias("token"), "type_tokens")
    hits = asked.join(listed, "token").groupBy("query", "entry", "name").agg(F.sum(F.when(F.array_contains("type_tokens", F.col("token")), 2).otherwise(1)).alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "name", "entry")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def overlap_ranked(rows: DataFrame, query_tokens: Column, line_tokens: Column, by: str, place: str, k: int = 6) -> DataFrame:
    """Lines by the number of query tokens they hold; ties keep their order."""
    scored = rows.withColumn("overlap", F.size(F.array_intersect(query_tokens, line_tokens)))
    best = Window.partitionBy(by).orderBy(F.desc("overlap"), place)
    return scored.withColumn("rank", F.row_number().over(best)).filter((F.col("rank") <= k) & (F.col("overlap") > 0))
