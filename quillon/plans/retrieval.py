"""Queries of lexical and dense retrieval, fusion, gates and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators import dense, fusion, lexical, lexical_index, metrics, phrases, storage, vector_index

from .base import Registry, search_tokens_sql, table, tokens_sql

R = Registry()
TOP = 10


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """(query, term, place): the distinct search terms of each benchmark item, in order."""
    items = table(spark, d, "benchmark", "item_id", "text")
    return items.select(F.col("item_id").alias("query"), F.posexplode(F.array_distinct(X.search_tokens(F.col("text")))).alias("place", "term"))


_TOK = search_tokens_sql("text")
_POST = f"""
tok AS (SELECT doc_id AS doc, {_TOK} AS t FROM documents),
len AS (SELECT doc, len(t) AS length FROM tok),
post AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(t) AS term FROM tok) GROUP BY doc, term),
stat AS (SELECT term, count(*) AS df FROM post GROUP BY term),
corpus AS (SELECT count(*) AS n, avg(length) AS av FROM len)"""


def _weight(k1: float) -> str:
    return f"ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1) / (tf + {k1} * (0.25 + 0.75 * greatest(length, 1) / greatest(av, 1.0)))"


_ITEM = f"""
q AS (SELECT item_id AS query, t[i] AS term, i AS place FROM (SELECT item_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT item_id, {_TOK} AS t FROM benchmark)) WHERE list_position(t, t[i]) = i),
hits AS (SELECT query, doc, round(sum({_weight(1.5)}), 6) AS score, string_agg(term, ' ' ORDER BY place) AS matched FROM q JOIN post USING (term) JOIN stat USING (term) JOIN len USING (doc), corpus GROUP BY query, doc),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM hits WHERE score > 0) WHERE rank <= {TOP})"""


_indexes: dict[tuple[str, str], str] = {}


def _index(spark: SparkSession, d: str) -> lexical_index.Index:
    """The stored index of the documents: built by the first query that asks for it, and anew when the table's files differ."""
    docs = _docs(spark, d)
    state = (spark.sparkContext.applicationId, storage.signature(docs))
    if state not in _indexes:
        path = storage.new_folder(spark, "bm25")
        lexical_index.append(docs, X.search_tokens(F.col("text")), path)
        _indexes[state] = path
    return lexical_index.Index(spark, _indexes[state])


@R.add(f"WITH {_POST} SELECT term, df FROM stat")
def bm25_term_stats(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).terms()


def _bm25(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).search(_asked(spark, d), TOP)


@R.add(f"WITH {_POST}, {_ITEM} SELECT query, doc, CAST(rank AS INTEGER) AS rank, score, matched FROM bm")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d).select("query", "doc", "rank", "score", F.array_join("matched_terms", " ").alias("matched"))


@R.add(f"WITH {_POST}, {_ITEM} SELECT query, doc, CAST(rank AS INTEGER) AS rank, score, matched FROM bm")
def bm25_appended(spark: SparkSession, d: str) -> DataFrame:
    """The same hits from an index to which the documents came in three runs."""
    docs, path = _docs(spark, d), storage.new_folder(spark, "bm25-appended")
    for part in range(3):
        lexical_index.append(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == part), X.search_tokens(F.col("text")), path)
    hits = lexical_index.Index(spark, path).search(_asked(spark, d), TOP)
    return hits.select("query", "doc", "rank", "score", F.array_join("matched_terms", " ").alias("matched"))


@R.add(f"WITH {_POST} SELECT doc, term, round({_weight(1.2)}, 6) AS weight FROM post JOIN stat USING (term) JOIN len USING (doc), corpus")
def bm25_sparse_weights(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).weights()


@R.add(f"WITH {_POST} SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id FROM stat")
def term_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return lexical.vocabulary(_index(spark, d).terms()).select("term", F.col("term_id").cast("long").alias("term_id"))


_V = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


@R.add(f"SELECT vec_id, round(sqrt(list_sum(list_transform({_V}, lambda x: x * x))), 6) AS norm, (len(embedding) = 64 AND list_sum(list_transform({_V}, lambda x: x * x)) > 0) AS usable FROM embeddings")
def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(dense.norm(v), 6).alias("norm"), dense.vector_fault(v, 64).isNull().alias("usable"))


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The query set is every vector whose id is divisible by 20; all vectors are searched."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("v"), "label")
    return vectors.filter("item % 20 = 0").select(F.col("item").alias("query"), F.col("v").alias("qv"), F.col("label").alias("q_label")), vectors


_COS = f"""
vec AS (SELECT vec_id, label, {_V} AS v FROM embeddings),
nv AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM vec),
cos AS (SELECT a.vec_id AS query, b.vec_id AS item, a.label AS ql, b.label AS il, round(list_dot_product(a.v, b.v) / (a.n * b.n), 6) AS score FROM nv a, nv b WHERE a.vec_id % 20 = 0 AND b.n > 0)"""


@R.add(f"WITH {_COS} SELECT query, item, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM cos) WHERE rank <= {TOP}")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return dense.cosine_top_k(*_vectors(spark, d), TOP)


@R.add(f"WITH {_COS} SELECT query, item, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM cos WHERE ql = il AND query <> item) WHERE rank <= {TOP}")
def cosine_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    return dense.cosine_top_k(*_vectors(spark, d), TOP, equal=(("q_label", "label"),), differ=(("query", "item"),))


@R.add("SELECT max(vec_id) + 1 AS expected, count(*) AS total, count(*) FILTER (WHERE len(embedding) = 64) AS compatible, (count(*) = max(vec_id) + 1 AND count(*) = count(*) FILTER (WHERE len(embedding) = 64)) AS ready FROM embeddings")
def vector_readiness(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    # A dense numbering from 0 says how many vectors there ought to be.
    return dense.readiness(vectors, vectors.agg(F.max("vec_id")).first()[0] + 1, F.size("embedding") == 64)


@R.add(f"WITH {_COS}, best AS (SELECT query, il AS chunk, item, score, row_number() OVER (PARTITION BY query, il ORDER BY score DESC, item) AS r FROM cos) SELECT query, chunk, item, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk) AS INTEGER) AS rank FROM best WHERE r = 1 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk) <= 5")
def best_per_chunk(spark: SparkSession, d: str) -> DataFrame:
    queries, vectors = _vectors(spark, d)
    hits = dense.cosine_best(queries, vectors.withColumn("chunk", F.col("label")), "chunk")
    return dense.best_per_chunk(hits, 5).select("query", "chunk", "item", "score", "rank")


@R.add(f"WITH {_COS} SELECT query, item, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM cos JOIN documents ON doc_id = item WHERE il = 3 AND lang = 'en') WHERE rank <= {TOP}")
def cosine_topk_trusted(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of one label, of items on a list: the English documents."""
    queries, vectors = _vectors(spark, d)
    listed = _english(spark, d)
    return dense.cosine_top_k(queries, dense.trusted(vectors, {"label": 3}, listed), TOP)


def _vector_index(spark: SparkSession, d: str) -> vector_index.VectorIndex:
    """The stored cells of the embeddings, in two generations; built once, and anew when the table's files differ."""
    vectors = _vectors(spark, d)[1].select("item", "v")
    state = (spark.sparkContext.applicationId, "vectors " + storage.signature(vectors))
    if state not in _indexes:
        path = storage.new_folder(spark, "vectors")
        cells = vector_index.fit(vectors)
        for part in range(2):
            vector_index.append(vectors.filter(F.pmod(F.xxhash64("item"), F.lit(2)) == part), path, cells)
        _indexes[state] = path
    return vector_index.VectorIndex(spark, _indexes[state])


@R.add(f"WITH {_COS} SELECT query, item, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM cos) WHERE rank <= {TOP}")
def vector_index_exact(spark: SparkSession, d: str) -> DataFrame:
    """The hits of ``cosine_topk``, from the stored cells."""
    return _vector_index(spark, d).search(_vectors(spark, d)[0], TOP, exact=True)


@R.add()
def vector_index_topk(spark: SparkSession, d: str) -> DataFrame:
    """Hits of the nearest cells; tests measure how many of the true ones they are."""
    return _vector_index(spark, d).search(_vectors(spark, d)[0], TOP)


def _english(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "lang").filter("lang = 'en'").select(F.col("doc_id").alias("item"))


def _channels(spark: SparkSession, d: str) -> DataFrame:
    """Lexical hits of benchmark items, and dense hits of the vectors of the same ids."""
    lex = _bm25(spark, d).select("query", F.lit("lexical").alias("channel"), F.col("doc").alias("item"), "rank", F.col("score").alias("raw_score"))
    queries, vectors = _vectors(spark, d)
    near = dense.cosine_top_k(queries, vectors, TOP).select("query", F.lit("dense").alias("channel"), "item", "rank", F.col("score").alias("raw_score"))
    return lex.unionByName(near)


_CHAN = f"""{_POST}, {_ITEM}, {_COS},
dn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM cos) WHERE rank <= {TOP}),
ch AS (SELECT query, 'lexical' AS channel, doc AS item, rank, score FROM bm UNION ALL SELECT query, 'dense', item, rank, score FROM dn),
one AS (SELECT query, channel, item, min(rank) AS rank FROM ch GROUP BY ALL),
fused AS (SELECT query, item, round(sum(1.0 / (60 + rank)), 9) AS score, string_agg(channel, '+' ORDER BY channel DESC) AS channels, min(rank) FILTER (WHERE channel = 'lexical') AS lexical_rank FROM one GROUP BY query, item),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM fused)"""


@R.add(f"WITH {_CHAN} SELECT query, item, score, channels, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= {TOP}")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    fused = fusion.fuse(_channels(spark, d), top=TOP)
    return fused.select("query", "item", "score", F.array_join(F.transform("contributions", lambda c: c["channel"]), "+").alias("channels"), "rank")


@R.add(f"WITH {_CHAN} SELECT b.item_id AS query, count(DISTINCT item) FILTER (WHERE channel = 'lexical') AS lexical_candidates, count(DISTINCT item) FILTER (WHERE channel = 'dense') AS dense_candidates, count(DISTINCT item) AS distinct_candidates, count(DISTINCT item) FILTER (WHERE channel = 'dense') = 0 AS fallback FROM benchmark b LEFT JOIN ch ON ch.query = b.item_id GROUP BY b.item_id")
def rrf_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return fusion.diagnostics(table(spark, d, "benchmark").select(F.col("item_id").alias("query")), _channels(spark, d))


@R.add(f"""WITH {_CHAN}, v AS (SELECT r.query, r.item, r.score, r.lexical_rank, n.score AS dense_score, d.source IS NOT NULL AS trusted, CASE WHEN r.item % 7 = 0 THEN true WHEN r.item % 5 = 0 THEN false END AS relevant, max(r.score) OVER (PARTITION BY r.query) AS top FROM ranked r LEFT JOIN dn n ON n.query = r.query AND n.item = r.item LEFT JOIN documents d ON d.doc_id = r.item)
SELECT query, item, CASE WHEN NOT trusted THEN 'untrusted source' WHEN relevant IS FALSE THEN 'not relevant' WHEN NOT (top > 0 AND score / top >= 0.6) THEN 'weak score' WHEN lexical_rank IS NULL AND NOT coalesce(dense_score >= 0.3, false) AND relevant IS NOT TRUE THEN 'no signal' ELSE 'verified' END AS note FROM v""")
def verified_hits(spark: SparkSession, d: str) -> DataFrame:
    fused = fusion.fuse(_channels(spark, d))
    of = lambda channel: F.get(F.filter("contributions", lambda c: c["channel"] == channel), F.lit(0))
    sources = table(spark, d, "documents").select(F.col("doc_id").alias("item"), F.col("source").isNotNull().alias("trusted"))
    relevant = F.when(F.col("item") % 7 == 0, True).when(F.col("item") % 5 == 0, False)
    hits = fused.select("query", "item", "score", of("lexical")["rank"].alias("lexical_rank"), of("dense")["raw_score"].alias("dense_score"), relevant.alias("relevance_accepted")).join(sources, "item", "left")
    return fusion.verified(hits, relative=0.6, dense=0.3).select("query", "item", "note")


_CT = "list_filter({0}, lambda t: length(t) >= 4 AND NOT regexp_matches(t, '^[0-9]+$'))"


@R.add(f"""WITH {_POST}, {_ITEM}, qt AS (SELECT item_id AS query, list_distinct({_CT.format(search_tokens_sql('text'))}) AS q FROM benchmark), dt AS (SELECT doc_id AS doc, list_distinct({_CT.format(search_tokens_sql('text'))}) AS t FROM documents),
g AS (SELECT query, doc, len(q) AS n, len(list_filter(q, lambda a: len(list_filter(t, lambda b: a = b OR (least(5, length(a), length(b)) >= 4 AND left(a, least(5, length(a), length(b))) = left(b, least(5, length(a), length(b)))))) > 0)) AS m FROM bm JOIN qt USING (query) JOIN dt USING (doc))
SELECT query, doc, CAST(m AS BIGINT) AS matched, CASE WHEN m > 0 THEN round(0.5 + 0.5 * least(1.0, m / greatest(least(4, n), 1)), 4) ELSE 0.0 END AS relevance, (least(3, n) >= 2 AND m >= least(3, n) AND CASE WHEN m > 0 THEN round(0.5 + 0.5 * least(1.0, m / greatest(least(4, n), 1)), 4) ELSE 0.0 END >= 0.75) AS accepted FROM g""")
def prefix_overlap_gate(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), fusion.content_terms(F.col("text"), X.STOP_WORDS).alias("q"))
    t = _docs(spark, d).select(F.col("doc_id").alias("doc"), fusion.content_terms(F.col("text"), X.STOP_WORDS).alias("t"))
    pairs = _bm25(spark, d).select("query", "doc").join(q, "query").join(t, "doc")
    return fusion.archive_gate(pairs, "q", "t").select("query", "doc", F.size("matched").cast("long").alias("matched"), "relevance", "accepted")


@R.add(f"""WITH {_POST}, {_ITEM}, rel AS (SELECT item_id AS query, doc_id AS item FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
f AS (SELECT query, min(rank) AS first FROM bm JOIN rel ON rel.query = bm.query AND rel.item = bm.doc GROUP BY ALL)
SELECT round(avg(CASE WHEN first IS NOT NULL THEN 1.0 ELSE 0.0 END), 4) AS recall, round(avg(coalesce(1.0 / first, 0)), 4) AS mrr, count(*) AS queries FROM benchmark b LEFT JOIN f ON f.query = b.item_id""".replace("SELECT query, min(rank) AS first FROM bm JOIN rel ON", "SELECT bm.query AS query, min(rank) AS first FROM bm JOIN rel ON"))
def mrr_recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("passage"))
    relevant = holding(_docs(spark, d), items).select("query", F.col("doc_id").alias("item"))
    hits = _bm25(spark, d).select("query", F.col("doc").alias("item"), "rank")
    return metrics.recall_and_mrr(items, hits, relevant, TOP)


def holding(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents (text, ...), without their texts, with each of the items (query, passage) that they hold."""
    found = phrases.held(docs, items.select(F.col("passage").alias("phrase")))
    return found.withColumnRenamed("phrase", "passage").join(items, "passage")


_NDCG = f"""WITH {_COS}, dn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM cos) WHERE rank <= 5),
gr AS (SELECT a.vec_id AS query, b.vec_id AS item, CASE WHEN a.vec_id = b.vec_id THEN 3 ELSE 2 END AS grade FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 20 = 0),
ideal AS (SELECT query, sum((pow(2.0, grade) - 1) / log2(rank + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY grade DESC, item) AS rank FROM gr) WHERE rank <= 5 GROUP BY query),
tot AS (SELECT query, count(*) AS relevant FROM gr GROUP BY query),
got AS (SELECT dn.query, sum((pow(2.0, coalesce(grade, 0)) - 1) / log2(rank + 1)) AS dcg, count(grade) AS found, count(*) AS returned, min(CASE WHEN grade >= 2 THEN rank END) AS first FROM dn LEFT JOIN gr USING (query, item) GROUP BY dn.query)
SELECT query, round(found / returned, 4) AS precision_returned, round(found / 5, 4) AS precision_at_k, round(found / relevant, 4) AS recall_at_k, coalesce(round(1.0 / first, 4), 0) AS reciprocal_rank, round(dcg / ideal, 4) AS ndcg FROM tot JOIN ideal USING (query) JOIN got USING (query)"""


@R.add(_NDCG)
def ndcg_at_k(spark: SparkSession, d: str) -> DataFrame:
    queries, vectors = _vectors(spark, d)
    hits = dense.cosine_top_k(queries, vectors, 5)
    return metrics.ranking_metrics(hits, _label_grades(hits, queries, vectors), 5, counts=_label_counts(queries, vectors))


def _label_grades(hits: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query, item, grade) of the hits whose label is the query's: 3 for the query itself, 2 for others."""
    found = hits.select("query", "item").distinct().join(queries.select("query", "q_label"), "query").join(vectors.select("item", "label"), "item")
    return found.filter(F.col("q_label") == F.col("label")).select("query", "item", F.when(F.col("query") == F.col("item"), 3).otherwise(2).alias("grade"))


def _label_counts(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query, grade, n): how many items of each grade a query's label has, counted by label and never paired."""
    of_label = vectors.groupBy(F.col("label").alias("q_label")).agg(F.count(F.lit(1)).alias("_all"))
    itself = vectors.groupBy(F.col("item").alias("query"), F.col("label").alias("q_label")).agg(F.count(F.lit(1)).alias("_own"))
    each = queries.select("query", "q_label").join(of_label, "q_label").join(itself, ["query", "q_label"], "left")
    own = F.coalesce("_own", F.lit(0))
    sums = each.groupBy("query").agg(F.sum(own).alias("_own"), F.sum(F.col("_all") - own).alias("_rest"))
    return sums.select("query", F.inline(F.array(F.struct(F.lit(3).alias("grade"), F.col("_own").alias("n")), F.struct(F.lit(2).alias("grade"), F.col("_rest").alias("n"))))).filter("n > 0")


_FIVE = "dn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM cos WHERE query <> item) WHERE rank <= 5)"


@R.add(f"""WITH {_COS}, {_FIVE}, g AS (SELECT vec_id AS query, vec_id - o AS item, o % 4 AS grade, (vec_id - o) % 5 AS family FROM embeddings, range(40) AS t(o) WHERE vec_id % 20 = 0 AND vec_id >= o),
rel AS (SELECT * FROM g WHERE grade >= 2), tot AS (SELECT query, count(DISTINCT family) AS families FROM rel GROUP BY 1), got AS (SELECT query, count(DISTINCT family) AS n FROM dn JOIN rel USING (query, item) GROUP BY 1)
SELECT query, coalesce(families, 0) AS families, coalesce(round(coalesce(n, 0) / families, 4), 0) AS family_recall FROM (SELECT DISTINCT query FROM g) LEFT JOIN tot USING (query) LEFT JOIN got USING (query)""")
def family_recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Forty items before a query are judged, in grades and families by their numbers."""
    queries, vectors = _vectors(spark, d)
    judged = queries.select("query", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("_o")).filter(F.col("query") >= F.col("_o"))
    grades = judged.select("query", (F.col("query") - F.col("_o")).alias("item"), (F.col("_o") % 4).alias("grade"), ((F.col("query") - F.col("_o")) % 5).alias("family"))
    hits = dense.cosine_top_k(queries, vectors, 5, differ=(("query", "item"),))
    return metrics.family_recall(hits, grades)


_MACRO = ["precision_returned", "precision_at_k", "recall_at_k", "reciprocal_rank", "ndcg", "hard_negatives"]


@R.add(f"""WITH m AS ({_NDCG}), {_COS}, {_FIVE}, h AS (SELECT query, count(*) AS n FROM dn WHERE ql <> il GROUP BY 1)
SELECT {', '.join(f"round(avg({c}), 4) AS {c}" for c in _MACRO[:-1])}, round(avg(coalesce(n, 0)), 4) AS hard_negatives, count(*) AS queries FROM m LEFT JOIN h USING (query)""")
def macro_means(spark: SparkSession, d: str) -> DataFrame:
    """Means over queries; hits of another label that a search without the query itself returns are the hard negatives."""
    queries, vectors = _vectors(spark, d)
    near = dense.cosine_top_k(queries, vectors, 5, differ=(("query", "item"),))
    labels = vectors.select("item", F.col("label").alias("i_label"))
    other = near.select("query", "item").join(labels, "item").join(queries.select("query", "q_label"), "query").filter("q_label <> i_label")
    each = ndcg_at_k(spark, d).join(metrics.hard_negatives(queries, near, other), "query")
    return metrics.macro(each, _MACRO)


_ALL = tokens_sql("text")


@R.add(f"""WITH {_POST}, {_ITEM}, a AS (SELECT item_id AS query, list_distinct({_ALL}) AS q FROM benchmark), b AS (SELECT doc_id AS doc, list_distinct({_ALL}) AS t FROM documents),
s AS (SELECT query, doc AS item, round(len(list_intersect(q, t)) / greatest(len(q), 1), 6) AS rerank_score FROM bm JOIN a USING (query) JOIN b USING (doc) WHERE rank <= 30)
SELECT query, item, rerank_score, CAST(row_number() OVER (PARTITION BY query ORDER BY rerank_score DESC, item) AS INTEGER) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY rerank_score DESC, item) <= 10""")
def reranked_hits(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("q"))
    hits = _bm25(spark, d).select("query", F.col("doc").alias("item"), "rank").join(items, "query").join(_docs(spark, d).select(F.col("doc_id").alias("item"), "text"), "item")
    return fusion.reranked(hits, fusion.overlap_scorer, "q", "text").select("query", "item", "rerank_score", "rank")


@R.add("""WITH q AS (SELECT n_nationkey AS query, list_distinct(regexp_extract_all(lower(n_name), '[a-z0-9]+')) AS t FROM nation),
c AS (SELECT p_partkey AS entry, p_name AS name, list_distinct(regexp_extract_all(lower(p_type), '[a-z0-9]+')) AS ty, list_distinct(regexp_extract_all(lower(p_type || ' ' || p_name), '[a-z0-9]+')) AS t FROM part),
h AS (SELECT query, entry, name, sum(CASE WHEN list_contains(ty, w) THEN 2 ELSE 1 END) AS score FROM (SELECT 0 AS query, unnest(['steel', 'part', 'promo', 'ti']) AS w) JOIN c ON list_contains(t, w) AND length(w) >= 3 GROUP BY ALL)
SELECT query, entry, name, CAST(score AS BIGINT) AS score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, name, entry) AS INTEGER) AS rank FROM h QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, name, entry) <= 12""")
def catalog_search(spark: SparkSession, d: str) -> DataFrame:
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    catalog = table(spark, d, "part").select(F.col("p_partkey").alias("entry"), F.col("p_name").alias("name"), words(F.col("p_type")).alias("type_tokens"), words(F.concat_ws(" ", "p_type", "p_name")).alias("tokens"))
    asked = spark.range(1).select(F.lit(0).alias("query"), F.array(*[F.lit(w) for w in ("steel", "part", "promo", "ti")]).alias("tokens"))
    return lexical.catalog_search(asked, catalog)


@R.add("""WITH l AS (SELECT conv_id, turn, len(list_intersect(['the', 'of', 'and', 'la', 'le'], list_distinct(regexp_extract_all(lower(text), '[a-zçğıöşü0-9]+')))) AS overlap FROM conversations)
SELECT conv_id, turn, CAST(overlap AS BIGINT) AS overlap, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY overlap DESC, turn) AS rank FROM l) WHERE rank <= 6 AND overlap > 0""")
def overlap_ranking(spark: SparkSession, d: str) -> DataFrame:
    asked = F.array(*[F.lit(w) for w in ("the", "of", "and", "la", "le")])
    held = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-zçğıöşü0-9]+"), F.lit(0)))
    return lexical.overlap_ranked(table(spark, d, "conversations"), asked, held, "conv_id", "turn").select("conv_id", "turn", F.col("overlap").cast("long").alias("overlap"), "rank")


INTENT = [("road", 1, "the", "any"), ("road", 2, "ing", "any"), ("road", 0, "password", "veto"), ("sea", 1, "eau", "any"), ("sea", 2, "ment", "any")]


@R.add(f"""WITH r(profile, g, phrase, kind) AS (VALUES {', '.join(map(str, INTENT))}),
h AS (SELECT doc_id AS query, profile, list_sort(list(DISTINCT g) FILTER (WHERE kind = 'any')) AS groups, max(CASE WHEN kind = 'veto' THEN 1 ELSE 0 END) AS vetoed FROM documents JOIN r ON contains(lower(text), phrase) GROUP BY ALL)
SELECT query, profile, coalesce(array_to_string(groups, ','), '') AS groups, vetoed, (coalesce(len(list_filter(groups, lambda x: x <= 2)), 0) = 2 AND vetoed = 0) AS supported FROM h""")
def intent_gate(spark: SparkSession, d: str) -> DataFrame:
    asked = _docs(spark, d).select(F.col("doc_id").alias("query"), F.lower("text").alias("text"))
    found = fusion.intent(asked, spark.createDataFrame(INTENT, "profile string, group int, phrase string, kind string"))
    return found.withColumn("groups", F.array_join(F.col("groups").cast("array<string>"), ","))


@R.add("SELECT doc_id, CASE WHEN lang = 'en' THEN 'road' WHEN lang = 'fr' AND contains(lower(text), 'eau') THEN 'sea' END AS profile, CASE WHEN lang = 'en' THEN lang || ' the way' WHEN lang = 'fr' AND contains(lower(text), 'eau') THEN lang || ' la mer' ELSE lang END AS query FROM documents")
def profile_expansion(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text", "lang")
    profile = fusion.profile_for(F.col("lang"), F.lower("text"), [("en", [], "road"), ("fr", ["eau"], "sea")])
    return docs.withColumn("profile", profile).select("doc_id", "profile", fusion.expanded(F.col("lang"), F.col("profile"), {"road": ["the way", "EN"], "sea": ["la mer"]}).alias("query"))


@R.add(f"""WITH {_COS}, t AS (SELECT query, max(score) AS top FROM cos WHERE query <> item GROUP BY 1) SELECT count(*) FILTER (WHERE query % 40 = 0 AND top >= 0.3) AS false_answers, count(*) FILTER (WHERE query % 40 <> 0 AND top < 0.3) AS false_abstentions, count(*) AS queries FROM t""")
def control_metrics(spark: SparkSession, d: str) -> DataFrame:
    queries, vectors = _vectors(spark, d)
    top = dense.cosine_top_k(queries, vectors, 1, differ=(("query", "item"),))
    return metrics.control_metrics(top.select((F.col("query") % 40 == 0).alias("expected_abstain"), (F.col("score") < 0.3).alias("abstained")))
