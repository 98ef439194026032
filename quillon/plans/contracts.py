"""Queries of duplicates, identity, contracts, merges and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators import builds, dedup, graph, ownership, quality, storage
from quillon.sources import sinks

from .base import Registry, fold_sql, search_tokens_sql, squeeze_sql, table

R = Registry()
_FP = f"sha256(lower({squeeze_sql('text')}))"


@R.add(f"SELECT {_FP} AS fingerprint, count(*) AS rows FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dups(spark: SparkSession, d: str) -> DataFrame:
    return dedup.repeated(table(spark, d, "documents", "text").select(X.fingerprint(F.col("text")).alias("fingerprint")), "fingerprint")


@R.add("SELECT o_custkey AS customer, min(o_orderkey) AS page, max(o_orderkey) AS page_end, count(*) AS rows, count(DISTINCT o_orderstatus) > 1 AS conflict, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def dup_consolidation(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("page"), F.col("o_orderkey").alias("page_end"), "o_orderstatus")
    return dedup.consolidated(rows, "customer", ["o_orderstatus"])


@R.add(f"SELECT {_FP} AS fingerprint, arg_min(source, doc_id) AS owner, count(*) - 1 AS copies FROM documents GROUP BY 1")
def first_owner(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents", "doc_id", "text", "source").select("doc_id", "source", X.fingerprint(F.col("text")).alias("fingerprint"))
    return dedup.first_owner(rows, "fingerprint", "source", "doc_id")


@R.add("SELECT p_partkey, sha256('{\"p_brand\":\"' || p_brand || '\",\"p_size\":' || p_size || '}') AS digest FROM part")
def chunk_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return dedup.chunk_fingerprints(table(spark, d, "part"), "p_partkey", ["p_size", "p_brand"])


@R.add("""WITH r AS (SELECT substring(sha256(CAST(p_partkey AS VARCHAR)), 1, 6) AS g, p_partkey AS k, p_partkey || ':' || sha256('{"p_brand":"' || p_brand || '","p_size":' || p_size || '}') AS x FROM part),
a AS (SELECT g, sha256(string_agg(x, ',' ORDER BY k)) AS d, count(*) AS n FROM r GROUP BY g),
b AS (SELECT substring(g, 1, 3) AS g, sha256(string_agg(d, ',' ORDER BY g)) AS d, sum(n) AS n FROM a GROUP BY 1)
SELECT sha256(string_agg(d, ',' ORDER BY g)) AS fingerprint, CAST(sum(n) AS BIGINT) AS rows FROM b""")
def corpus_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    digests = dedup.chunk_fingerprints(table(spark, d, "part"), "p_partkey", ["p_size", "p_brand"])
    return dedup.corpus_fingerprint(digests, "p_partkey")


@R.add(f"SELECT doc_id, CASE WHEN {_FP} IN (SELECT {_FP} FROM benchmark) THEN 'synthetic' ELSE 'unclassified' END AS data_class FROM documents")
def data_classes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents", "doc_id", "text").select("doc_id", X.fingerprint(F.col("text")).alias("fp"))
    fixtures = table(spark, d, "benchmark").select(X.fingerprint(F.col("text")).alias("digest"))
    return dedup.data_class(rows, "fp", fixtures).select("doc_id", "data_class")


_CT = search_tokens_sql("text")


@R.add(f"""WITH RECURSIVE t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, list_distinct({_CT}) AS w FROM conversations),
g AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS kept, CAST([] AS VARCHAR[][]) AS held FROM (SELECT DISTINCT conv_id FROM t)
UNION ALL SELECT g.conv_id, t.i, CASE WHEN bad THEN kept ELSE list_append(kept, turn) END, CASE WHEN bad THEN held ELSE list_append(held, w) END
FROM (SELECT g.*, t.turn, t.w, t.i AS ti, len(list_filter(held, lambda h: len(list_distinct(list_concat(h, t.w))) > 0 AND len(list_intersect(h, t.w)) >= 0.5 * len(list_distinct(list_concat(h, t.w))))) > 0 AS bad FROM g JOIN t ON t.conv_id = g.conv_id AND t.i = g.i + 1) AS g JOIN (SELECT conv_id, i FROM t) AS t ON t.conv_id = g.conv_id AND t.i = g.ti)
SELECT conv_id, array_to_string(kept, ',') AS kept FROM g QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1""")
def greedy_near_dups(spark: SparkSession, d: str) -> DataFrame:
    """Turns of a conversation that are not too like an earlier one; conversations are short lists."""
    turns = table(spark, d, "conversations").select("conv_id", F.struct(F.col("turn").alias("id"), F.array_distinct(X.search_tokens(F.col("text"))).alias("tokens")).alias("s"))
    lists = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("s")).alias("items"))
    return lists.select("conv_id", F.array_join(F.transform(dedup.greedy_distinct(F.col("items"), 0.5), lambda x: x["id"].cast("string")), ",").alias("kept"))


@R.add(f"""WITH t AS (SELECT conv_id, list_sort(list_distinct({_CT})) AS w, min(turn) AS rep, count(*) AS copies FROM conversations GROUP BY 1, 2),
p AS (SELECT a.conv_id, a.rep AS a, b.rep AS b, a.copies AS copies_a, b.copies AS copies_b, len(list_intersect(a.w, b.w)) AS i, len(a.w) + len(b.w) AS n FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.rep < b.rep)
SELECT conv_id, a, b, copies_a, copies_b, round(i / (n - i), 6) AS jaccard FROM p WHERE i > 0 AND i / (n - i) >= 0.2""")
def jaccard_turns(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.array_distinct(X.search_tokens(F.col("text"))).alias("w"))
    return dedup.similar_sets(turns, "conv_id", "turn", "w", 0.2)


@R.add("SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN l_quantity > 45 THEN 'quantity' END, CASE WHEN l_discount > 0.08 THEN 'discount' END, CASE WHEN l_returnflag = 'R' THEN 'returned' END], lambda x: x IS NOT NULL), ',') AS blockers FROM lineitem")
def quality_blockers(spark: SparkSession, d: str) -> DataFrame:
    reasons = quality.blockers({"quantity": F.col("l_quantity") > 45, "discount": F.col("l_discount") > 0.08, "returned": F.col("l_returnflag") == "R"})
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(reasons, ",").alias("blockers"))


@R.add("""WITH c AS (SELECT l_orderkey AS document, count(*) AS found FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey AS document, CAST(o_orderkey % 7 + 1 AS BIGINT) AS declared FROM orders)
SELECT coalesce(o.document, c.document) AS document, declared, coalesce(found, 0) AS found, CASE WHEN o.document IS NULL THEN 'orphan_chunks' WHEN found IS NULL THEN 'no_chunks' WHEN declared <> found THEN 'count_differs' END AS fault
FROM o FULL JOIN c ON o.document = c.document WHERE o.document IS NULL OR found IS NULL OR declared <> found""")
def envelope_integrity(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "orders").select(F.col("o_orderkey").alias("document"), (F.col("o_orderkey") % 7 + 1).cast("long").alias("chunk_count"))
    return quality.envelope_faults(documents, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document")))


@R.add("SELECT c_custkey, count(o_orderkey) AS files, CASE WHEN count(o_orderkey) = 0 THEN 'MISSING' WHEN count(o_orderkey) = 1 THEN 'MATCHED' ELSE 'DUPLICATE' END AS pdf_status FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def manifest_match(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").cast("string").alias("path"))
    return quality.manifest(table(spark, d, "customer").select("c_custkey"), files, "c_custkey").select("c_custkey", "files", "pdf_status")


@R.add("SELECT pdf_status, count(*) AS n, count(*) FILTER (WHERE files > 20) AS large FROM (SELECT c_custkey, count(o_orderkey) AS files, CASE WHEN count(o_orderkey) = 0 THEN 'MISSING' WHEN count(o_orderkey) = 1 THEN 'MATCHED' ELSE 'DUPLICATE' END AS pdf_status FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) GROUP BY 1")
def manifest_summary(spark: SparkSession, d: str) -> DataFrame:
    return manifest_match(spark, d).groupBy("pdf_status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("files") > 20).alias("large"))


@R.add("""WITH r AS (SELECT doc_id, ['MATCHED', 'MISSING', 'DUPLICATE'][1 + doc_id % 3] AS s, ['review_required', 'out_of_scope', 'active'][1 + doc_id % 3] AS sc, ['available', 'read_error', 'not_inspected', 'ocr_required'][1 + doc_id % 4] AS t, lang FROM documents)
SELECT count(*) AS source_records, count(*) AS records, count(*) FILTER (WHERE s = 'MATCHED') AS matched_pdf, count(*) FILTER (WHERE s = 'MISSING') AS missing_pdf, count(*) FILTER (WHERE s = 'DUPLICATE') AS duplicate_pdf, count(*) FILTER (WHERE doc_id % 5 = 0) AS candidates, count(*) FILTER (WHERE doc_id % 10 = 0) AS approved,
count(*) FILTER (WHERE sc = 'review_required') AS review_required, count(*) FILTER (WHERE sc = 'out_of_scope') AS out_of_scope, count(*) FILTER (WHERE t = 'ocr_required') AS ocr_required, count(*) FILTER (WHERE t = 'read_error') AS read_errors, count(*) FILTER (WHERE t = 'not_inspected') AS not_inspected, CAST(7 AS BIGINT) AS unmatched_files,
(SELECT string_agg(l || ':' || n, ',' ORDER BY l) FROM (SELECT coalesce(lang, 'unknown') AS l, count(*) AS n FROM documents GROUP BY 1)) AS domains FROM r""")
def manifest_counts(spark: SparkSession, d: str) -> DataFrame:
    """A manifest whose records' states follow from their numbers."""
    docs = table(spark, d, "documents", "doc_id", "lang")
    pick = lambda *xs: F.get(F.array(*[F.lit(x) for x in xs]), (F.col("doc_id") % len(xs)).cast("int"))
    layer = pick("available", "read_error", "not_inspected", "ocr_required")
    records = docs.select(pick("MATCHED", "MISSING", "DUPLICATE").alias("pdf_status"), (F.col("doc_id") % 5 == 0).alias("candidate"), (F.col("doc_id") % 10 == 0).alias("approved"), pick("review_required", "out_of_scope", "active").alias("scope_status"), (layer == "ocr_required").alias("ocr_required"), layer.alias("text_layer_status"), F.col("lang").alias("domain"))
    out = quality.manifest_summary(records, docs.count(), 7)
    return out.withColumn("domains", F.array_join(F.transform(F.map_entries("domains"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ","))


@R.add("""WITH u AS (SELECT p_partkey + 100 AS p_partkey, p_brand || '!' AS p_brand FROM part WHERE p_size = 7)
SELECT coalesce(p.p_partkey, u.p_partkey) AS p_partkey, CASE WHEN p.p_partkey IS NOT NULL AND u.p_partkey IS NOT NULL THEN u.p_brand ELSE p.p_brand END AS p_brand, CASE WHEN p.p_partkey IS NULL THEN 'unknown_key' END AS fault FROM (SELECT p_partkey, p_brand FROM part) p FULL JOIN u ON p.p_partkey = u.p_partkey""")
def merge_updates(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    updates = part.filter("p_size = 7").select((F.col("p_partkey") + 100).alias("p_partkey"), F.concat("p_brand", F.lit("!")).alias("p_brand"))
    return quality.merged(part.select("p_partkey", "p_brand"), updates, "p_partkey", ["p_brand"])


@R.add("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_missing(spark: SparkSession, d: str) -> DataFrame:
    return quality.absent(table(spark, d, "documents", "doc_id"), table(spark, d, "labels"), "doc_id")


@R.add("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'new' ELSE s_name END AS s_name FROM supplier UNION ALL SELECT s_suppkey + 1000000, 'new' FROM supplier WHERE s_suppkey % 3 = 0")
def vector_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "supplier", "s_suppkey", "s_name")
    third = old.filter("s_suppkey % 3 = 0")
    new = third.unionByName(third.withColumn("s_suppkey", F.col("s_suppkey") + 1_000_000)).withColumn("s_name", F.lit("new"))
    return sinks.upserted(old, new, "s_suppkey")


@R.add("SELECT n_nationkey, CASE WHEN r_regionkey = 0 THEN NULL WHEN r_regionkey < 2 THEN upper(n_name) || '*' ELSE n_name END AS n_name, n_regionkey FROM nation LEFT JOIN region ON r_regionkey = n_regionkey")
def payload_overwrite(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    new = nation.filter("n_regionkey < 2").select("n_nationkey", F.when(F.col("n_regionkey") > 0, F.concat(F.upper("n_name"), F.lit("*"))).alias("n_name"))
    return sinks.overwritten_payload(nation, new, "n_nationkey").select("n_nationkey", "n_name", "n_regionkey")


@R.add("SELECT CAST(vec_id AS VARCHAR) AS vec_id, CAST(label AS VARCHAR) AS label, array_to_string(list_transform(embedding[1:2], lambda x: CAST(round(x * 100) AS INTEGER)), ' | ') AS head FROM embeddings")
def review_csv(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.transform(F.slice("embedding", 1, 2), lambda x: F.round(x * 100).cast("int").cast("string")).alias("head"))
    return sinks.review_table(rows, ["vec_id", "label", "head"])


@R.add("SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS report FROM region")
def report_json(spark: SparkSession, d: str) -> DataFrame:
    return sinks.report(table(spark, d, "region").select("r_regionkey", "r_name"))


# The trade graph: regions hold nations, nations hold customers and suppliers.
_EDGES = "e(source, relation, target) AS (SELECT 'r' || n_regionkey, 'HOLDS', 'n' || n_nationkey FROM nation UNION ALL SELECT 'n' || c_nationkey, 'HOME_OF', 'c' || c_custkey FROM customer UNION ALL SELECT 'n' || s_nationkey, 'SUPPLIES_FROM', 's' || s_suppkey FROM supplier)"
_NODES = "v(node, kind) AS (SELECT 'r' || r_regionkey, 'region' FROM region UNION ALL SELECT 'n' || n_nationkey, 'nation' FROM nation UNION ALL SELECT 'c' || c_custkey, 'customer' FROM customer WHERE c_custkey % 10 <> 0)"


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = lambda n: table(spark, d, n)
    tag = lambda c, k: F.concat(F.lit(k), F.col(c).cast("string"))
    edges = t("nation").select(tag("n_regionkey", "r").alias("source"), F.lit("HOLDS").alias("relation"), tag("n_nationkey", "n").alias("target"))
    edges = edges.unionByName(t("customer").select(tag("c_nationkey", "n").alias("source"), F.lit("HOME_OF").alias("relation"), tag("c_custkey", "c").alias("target")))
    edges = edges.unionByName(t("supplier").select(tag("s_nationkey", "n").alias("source"), F.lit("SUPPLIES_FROM").alias("relation"), tag("s_suppkey", "s").alias("target")))
    nodes = t("region").select(tag("r_regionkey", "r").alias("node"), F.lit("region").alias("kind"))
    nodes = nodes.unionByName(t("nation").select(tag("n_nationkey", "n").alias("node"), F.lit("nation").alias("kind")))
    return nodes.unionByName(t("customer").filter("c_custkey % 10 <> 0").select(tag("c_custkey", "c").alias("node"), F.lit("customer").alias("kind"))), edges


@R.add(f"WITH {_EDGES}, {_NODES} SELECT 'node' AS element, kind, count(*) AS n FROM v GROUP BY kind UNION ALL SELECT 'edge', relation, count(*) FROM e GROUP BY relation")
def graph_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.counts_by_kind(*_graph(spark, d))


@R.add(f"WITH {_EDGES}, {_NODES} SELECT source, relation, target, 'source' AS \"end\" FROM e WHERE source NOT IN (SELECT node FROM v) UNION ALL SELECT source, relation, target, 'target' FROM e WHERE target NOT IN (SELECT node FROM v)")
def dangling_edges(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return graph.dangling(edges, nodes)


@R.add(f"WITH {_EDGES} SELECT a.source AS start, a.target AS \"end\", 1 AS hops, a.relation AS via FROM e a WHERE a.source LIKE 'r%' UNION ALL SELECT a.source, b.target, 2, a.relation || '>' || b.relation FROM e a JOIN e b ON a.target = b.source WHERE a.source LIKE 'r%'")
def two_hop_paths(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    found = graph.paths(edges, nodes.filter("kind = 'region'").select("node"), 2)
    return found.select("start", "end", "hops", F.array_join(F.transform("path", lambda p: p["relation"]), ">").alias("via"))


@R.add("WITH t(node, parent) AS (SELECT p_partkey, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END FROM part), r AS (SELECT node, parent AS ancestor, 1 AS distance FROM t WHERE parent IS NOT NULL) SELECT * FROM (WITH RECURSIVE c AS (SELECT node, ancestor, distance FROM r UNION ALL SELECT c.node, r.ancestor, c.distance + 1 FROM c JOIN r ON c.ancestor = r.node) SELECT node, ancestor, distance FROM c)")
def hierarchy_closure(spark: SparkSession, d: str) -> DataFrame:
    tree = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") > 1, F.floor(F.col("p_partkey") / 2)).alias("parent"))
    return graph.closure(tree)


@R.add("SELECT source, relation, target, count(DISTINCT o) AS evidence FROM (SELECT 'n' || c_nationkey AS source, 'ORDERS' AS relation, o_orderpriority AS target, o_orderstatus AS o FROM orders JOIN customer ON c_custkey = o_custkey) GROUP BY ALL")
def graph_merge_edges(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    edges = rows.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("source"), F.lit("ORDERS").alias("relation"), F.col("o_orderpriority").alias("target"), F.col("o_orderstatus").alias("evidence"))
    return graph.merged_edges(edges).withColumn("evidence", F.size("evidence").cast("long"))


@R.add(f"WITH {_EDGES}, again AS (SELECT source, CASE WHEN target LIKE 'c%7' THEN 'MOVED_TO' ELSE relation END AS relation, target FROM e WHERE target NOT LIKE 's%3') (SELECT * FROM e EXCEPT SELECT * FROM again) UNION ALL (SELECT * FROM again EXCEPT SELECT * FROM e)")
def graph_rebuild_differences(spark: SparkSession, d: str) -> DataFrame:
    """A build against a later one that lost some suppliers and moved some customers."""
    _, edges = _graph(spark, d)
    again = edges.filter(~F.col("target").like("s%3")).withColumn("relation", F.when(F.col("target").like("c%7"), "MOVED_TO").otherwise(F.col("relation")))
    return graph.same_rows(edges, again).select("source", "relation", "target")


_WORDS = "w AS (SELECT l_orderkey AS doc, l_linenumber % 2 AS page, l_linenumber / 8 AS confidence FROM lineitem)"


def _words(spark: SparkSession, d: str) -> DataFrame:
    """Line items as the words of scanned pages."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") % 2).alias("page"), F.col("l_linenumber").alias("x"), F.col("l_quantity").alias("y"), F.col("l_returnflag").alias("text"), (F.col("l_linenumber") / 8).alias("confidence"))


@R.add(f"WITH {_WORDS} SELECT doc, page, round(avg(confidence), 4) AS mean, round(min(confidence), 4) AS least, round(avg(CASE WHEN confidence < 0.5 THEN 1.0 ELSE 0.0 END), 4) AS low_share FROM w GROUP BY 1, 2")
def ocr_page_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.ocr_pages(_words(spark, d))


def _bare_page(words: DataFrame) -> DataFrame:
    """Words on one page, but for the first of every third document, which stands unread on a page of its own."""
    bare = (F.col("doc") % 3 == 0) & (F.col("x") == 1)
    return words.withColumn("confidence", F.when(~bare, F.col("confidence"))).withColumn("page", F.when(bare, 2).otherwise(1))


@R.add(f"WITH {_WORDS}, p AS (SELECT l_orderkey AS doc, l_orderkey % 3 = 0 AND l_linenumber = 1 AS bare, round(avg(CASE WHEN l_orderkey % 3 <> 0 OR l_linenumber <> 1 THEN l_linenumber / 8 END), 4) AS mean, round(min(CASE WHEN l_orderkey % 3 <> 0 OR l_linenumber <> 1 THEN l_linenumber / 8 END), 4) AS least FROM lineitem GROUP BY 1, 2) SELECT doc, round(avg(mean), 4) AS mean, min(least) AS least, count(*) FILTER (WHERE mean IS NULL) AS empty_pages FROM p GROUP BY 1")
def ocr_document_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.ocr_documents(quality.ocr_pages(_bare_page(_words(spark, d))))


@R.add("SELECT l_orderkey AS doc, l_linenumber % 2 AS page, CAST(floor(l_quantity / 8) AS BIGINT) AS band, string_agg(l_returnflag, ' ' ORDER BY l_linenumber, l_returnflag) AS text FROM lineitem GROUP BY 1, 2, 3")
def ocr_reading_order(spark: SparkSession, d: str) -> DataFrame:
    return quality.ocr_lines(_words(spark, d)).select("doc", "page", "band", "text")


@R.add("SELECT o_orderkey, (o_orderstatus IN ('F', 'O') AND o_totalprice / 500000 >= 0.80 AND o_orderpriority <> '1-URGENT') AS applied, (o_orderstatus = 'F' AND o_totalprice > 1000) AS decided FROM orders")
def proposal_gates(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    applied = quality.proposal_applied(F.col("o_orderstatus"), F.array(F.lit("F"), F.lit("O")), F.col("o_totalprice") / 500000, F.col("o_orderpriority") == "1-URGENT")
    decided = quality.decision({"final": F.col("o_orderstatus") == "F", "worth": F.col("o_totalprice") > 1000})["applied"]
    return orders.select("o_orderkey", applied.alias("applied"), decided.alias("decided"))


@R.add("SELECT l_orderkey AS decision, round(avg(l_linenumber / 8), 4) AS confidence, round(avg(CASE WHEN l_returnflag = 'N' THEN 0.0 ELSE l_linenumber / 8 END), 4) AS placed_confidence FROM lineitem GROUP BY 1")
def evidence_confidence(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("decision"), (F.col("l_linenumber") / 8).alias("confidence"), F.when(F.col("l_returnflag") != "N", F.lit("box")).alias("bbox"))
    return quality.evidence_confidence(lines)


@R.add("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'missing' WHEN c_custkey % 5 = 0 THEN 'changed' ELSE 'same' END AS status FROM customer")
def inventory_check(spark: SparkSession, d: str) -> DataFrame:
    listed = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("path"), "c_acctbal", F.lit(1).alias("bytes"), F.lit("d").alias("sha256"), "c_custkey")
    found = listed.filter("c_acctbal >= 0").select("path", "bytes", F.when(F.col("c_custkey") % 5 == 0, "e").otherwise("d").alias("sha256"))
    return quality.inventory_match(listed, found).select("c_custkey", "status")


# Word runs are marked, so that whole words can be told in any script.
_MARKED = f"regexp_replace({fold_sql("left(text, 24)")}, '([\\p{{L}}\\p{{N}}\\p{{M}}_]+)', chr(1) || '\\1' || chr(1), 'g')"
_TITLE = squeeze_sql(f"replace(regexp_replace({_MARKED}, chr(1) || '({ownership.REVISION_WORDS})' || chr(1), ' ', 'g'), chr(1), '')")


@R.add(f"""WITH RECURSIVE f AS (SELECT doc_id AS id, coalesce({_TITLE}, '') AS title, coalesce({fold_sql('source')}, '') AS article, coalesce({fold_sql('text')}, '') AS said FROM documents),
k AS (SELECT id, list_filter([CASE WHEN title <> '' AND article <> '' THEN 'title-article:' || title || '|' || article END, CASE WHEN length(said) >= 80 THEN 'excerpt:' || left(said, 360) END], lambda x: x IS NOT NULL) AS keys FROM f),
n AS (SELECT id, unnest(range(1, len(keys) + 1)) AS nth, unnest(keys) AS key FROM k),
p AS (SELECT id, nth, lag(id) OVER (PARTITION BY key ORDER BY id) AS earlier FROM n),
parents AS (SELECT id, arg_min(earlier, nth) AS parent FROM p WHERE earlier IS NOT NULL GROUP BY id),
walk AS (SELECT k.id, k.id AS root FROM k UNION ALL SELECT walk.id, parents.parent FROM walk JOIN parents ON walk.root = parents.id)
SELECT CAST(id AS VARCHAR) AS id, CAST(min(root) AS VARCHAR) AS owner FROM walk GROUP BY walk.id""")
def equivalence_owners(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are the same reference: equal beginnings and sources, or equal first 360 characters, in the order of ids."""
    docs = table(spark, d, "documents", "doc_id", "text", "source")
    keys = ownership.reference_keys(F.left("text", F.lit(24)), F.col("source"), F.col("text"), F.col("doc_id"))
    return ownership.owners(docs.select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("place"), keys.alias("keys")))


_BUILDS = """b AS (SELECT doc_id, CASE WHEN doc_id % 97 = 5 THEN 'xx' ELSE lang END AS lang, source, text FROM documents WHERE doc_id % 89 <> 7 UNION ALL SELECT doc_id, lang, source, text FROM documents WHERE doc_id % 101 = 3),
a AS (SELECT doc_id, lang, source, text FROM documents)"""


@R.add(f"WITH {_BUILDS} SELECT *, 'a' AS only_in FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'b' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def build_differences(spark: SparkSession, d: str) -> DataFrame:
    """Two stored builds of the documents, of which the second has rows changed, left out and repeated."""
    docs = table(spark, d, "documents", "doc_id", "lang", "source", "text")
    changed = docs.filter("doc_id % 89 <> 7").withColumn("lang", F.when(F.col("doc_id") % 97 == 5, "xx").otherwise(F.col("lang")))
    paths = []
    for rows in (docs, changed.unionByName(docs.filter("doc_id % 101 = 3"))):
        paths.append(storage.new_folder(spark, "build"))
        builds.write_build(rows, ["doc_id"], paths[-1], groups=64)
    return builds.differences(spark, *paths)
