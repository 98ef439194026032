"""The stored index against a search that scores everything, over appended generations, failed runs, blocks and odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators import lexical, lexical_index
from quillon.operators.storage import new_folder


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(60 * n)]
    return [(i, " ".join(words[60 * i : 60 * i + rng.randrange(1, 60)])) for i in range(n)]


ROWS = [*corpus(900, 3), (9000, None), (9001, ""), (9002, "ve bir"), (9003, "w1 " * 20_000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3, "doc_id").cache()


@pytest.fixture(scope="module")
def asked(spark):
    rng = random.Random(8)
    rows = [(q, w, p) for q in range(30) for p, w in enumerate(dict.fromkeys([*rng.choice(ROWS[:900])[1].split()[:12], "missing"]))]
    return spark.createDataFrame([*rows, (99, "missing", 0)], "query long, term string, place int")


def hits(df):
    return sorted(tuple(r) for r in df.select("query", "doc", "rank", "score", "matched_terms").collect())


def everything(docs, asked, k=10):
    slim = docs.select("doc_id", X.search_tokens(F.col("text")).alias("t"))
    return hits(lexical.bm25_top_k(asked, slim, F.col("t"), k))


def test_equal_to_scoring_everything(spark, docs, asked):
    path = new_folder(spark, "test")
    lexical_index.append(docs, X.search_tokens(F.col("text")), path, block=8)
    index = lexical_index.Index(spark, path)
    for k in (1, 10, 5000):
        assert hits(index.search(asked, k)) == everything(docs, asked, k)
    assert index.n_docs == len(ROWS)
    work = index.work(asked).collect()
    # Of the blocks that hold a term of a query, some have no document that can be a hit.
    assert len(work) == 30 and sum(r["skipped"] for r in work) > 0 and all(0 <= r["skipped"] < r["blocks"] for r in work)
    assert all(r["skipped"] == 0 for r in index.work(asked, 5000).collect())


def test_no_block_that_is_skipped_holds_a_hit(spark, docs, asked):
    path = new_folder(spark, "test")
    lexical_index.append(docs, X.search_tokens(F.col("text")), path, block=8)
    index = lexical_index.Index(spark, path)
    terms, blocks = index._blocks(asked, 10, 1.5)
    bounds = {(r["query"], r["generation"], r["block"]): (r["bound"], r["least"], r["s"]) for r in blocks.withColumn("s", lexical_index._skipped()).collect()}
    scored = index._scored(terms.withColumn("least", F.lit(None).cast("double")), blocks, 5000, 1.5)
    place = index.postings.select("generation", "block", F.explode("docs.doc").alias("doc")).distinct()
    seen = 0
    for r in scored.join(place, "doc").collect():
        bound, least, skipped = bounds[(r["query"], r["generation"], r["block"])]
        assert r["score"] <= bound + 1e-6 and (not skipped or r["score"] < least)
        seen += skipped
    assert seen > 0


def test_appended_and_failed_runs(spark, docs, asked):
    path = new_folder(spark, "test")
    for part in range(3):
        assert lexical_index.append(docs.filter(F.pmod("doc_id", F.lit(3)) == part), X.search_tokens(F.col("text")), path, block=16) == part
    # A run that ended before its last write: nothing of it is read, and the next one takes its number.
    docs.limit(5).selectExpr("'w1' AS term", "0L AS block", "1 AS n").write.parquet(f"{path}/postings/generation=3")
    assert hits(lexical_index.Index(spark, path).search(asked)) == everything(docs, asked)
    more = spark.createDataFrame([(5000 + i, t) for i, t in corpus(60, 5)], "doc_id long, text string")
    assert lexical_index.append(more, X.search_tokens(F.col("text")), path) == 3
    assert hits(lexical_index.Index(spark, path).search(asked)) == everything(docs.unionByName(more), asked)


def test_nothing_indexed_and_no_index(spark, docs, asked):
    path = new_folder(spark, "test")
    with pytest.raises(ValueError, match="no index"):
        lexical_index.Index(spark, path)
    lexical_index.append(docs.limit(0), X.search_tokens(F.col("text")), path)
    index = lexical_index.Index(spark, path)
    assert index.search(asked).count() == 0 and index.weights().count() == 0 and index.n_docs == 0


def test_long_queries(spark, docs):
    """More terms than one word of bits holds."""
    path = new_folder(spark, "test")
    lexical_index.append(docs, X.search_tokens(F.col("text")), path)
    asked = spark.createDataFrame([(1, f"w{i}", i) for i in range(200)] + [(2, "w1", 150)], "query long, term string, place int")
    assert hits(lexical_index.Index(spark, path).search(asked)) == everything(docs, asked)


def test_weights(spark, docs):
    path = new_folder(spark, "test")
    lexical_index.append(docs, X.search_tokens(F.col("text")), path)
    slim = docs.select("doc_id", X.search_tokens(F.col("text")).alias("t"))
    plain = sorted(tuple(r) for r in lexical.sparse_weights(slim, F.col("t")).collect())
    assert sorted(tuple(r) for r in lexical_index.Index(spark, path).weights().collect()) == plain
