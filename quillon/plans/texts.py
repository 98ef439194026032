"""Queries of text functions, chunking, layouts and text quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators import chunking, quality
from quillon.sources import readers

from .base import Registry, fold_sql, quoted, search_tokens_sql, squeeze_sql, table, tokens_sql

R = Registry()


@R.add(f"SELECT doc_id, sha256({fold_sql('text')}) AS folded_sha256, CAST(length({fold_sql('text')}) AS BIGINT) AS n FROM documents")
def text_fold(spark: SparkSession, d: str) -> DataFrame:
    folded = X.for_search(F.col("text"))
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.sha2(folded, 256).alias("folded_sha256"), F.length(folded).cast("long").alias("n"))


@R.add(f"SELECT doc_id, CAST(len({tokens_sql('text')}) AS BIGINT) AS n_tokens, CAST(len({search_tokens_sql('text')}) AS BIGINT) AS n_search, CAST(len(list_distinct({search_tokens_sql('text')})) AS BIGINT) AS n_distinct, CAST(len(regexp_extract_all(text, '[0-9]+[A-Za-zÇĞİÖŞÜçğıöşü]*|[A-Za-zÇĞİÖŞÜçğıöşü]+')) AS BIGINT) AS n_numbered FROM documents")
def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = X.once(table(spark, d, "documents", "doc_id", "text"), _t=X.tokens(F.col("text")))
    docs = X.once(docs, _s=X.searched(F.col("_t")))
    return docs.select("doc_id", F.size("_t").cast("long").alias("n_tokens"), F.size("_s").cast("long").alias("n_search"), F.size(F.array_distinct("_s")).cast("long").alias("n_distinct"), F.size(X.numbered_tokens(F.col("text"))).cast("long").alias("n_numbered"))


@R.add(f"SELECT doc_id, sha256(lower({squeeze_sql('text')})) AS fingerprint FROM documents")
def text_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", X.fingerprint(F.col("text")).alias("fingerprint"))


@R.add("SELECT doc_id, 'MEV-' || upper(substring(sha256(CAST(doc_id AS VARCHAR) || '|' || coalesce(source, 'None') || '|' || coalesce(lang, 'None')), 1, 16)) AS chunk_id, substring(sha256(coalesce(source, '') || '|' || CAST(doc_id AS VARCHAR)), 1, 20) AS stable_id, 1000000000 + CAST('0x' || substring(sha256(coalesce(source, '')), 1, 8) AS BIGINT) AS inventory FROM documents")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "source", "lang")
    return docs.select("doc_id", X.joined_id("MEV-", 16, [F.col("doc_id"), F.col("source"), F.col("lang")]).alias("chunk_id"), X.stable_hash([F.col("source"), F.col("doc_id")]).alias("stable_id"), X.inventory_number(F.coalesce("source", F.lit(""))).alias("inventory"))


_S = squeeze_sql("text")


@R.add(f"SELECT doc_id, CASE WHEN length({_S}) <= 240 THEN {_S} ELSE rtrim(substring({_S}, 1, 239)) || '…' END AS preview, CASE WHEN length({_S}) <= 480 THEN {_S} ELSE substring({_S}, 1, 238) || '...' || right({_S}, 238) END AS excerpt, CASE WHEN length(text) <= 12000 THEN length(text) ELSE 12000 END AS bounded, CASE WHEN length(source) <= 4 THEN repeat('*', length(source)) ELSE left(source, 2) || '***' || right(source, 2) END AS masked FROM documents")
def previews(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text", "source")
    return docs.select("doc_id", X.truncated(F.col("text")).alias("preview"), X.excerpt(F.col("text")).alias("excerpt"), F.length(X.head_and_tail(F.col("text"))).cast("long").alias("bounded"), X.masked(F.col("source")).alias("masked"))


_LATEX = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.LATEX.items())


@R.add(f"SELECT doc_id, sha256(CASE WHEN trim(text) = '' THEN '[DOLDURULACAK]' ELSE array_to_string(list_transform(string_split(text, ''), lambda c: CASE c {_LATEX} ELSE c END), '') END) AS escaped_sha256 FROM documents")
def latex_escape(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.sha2(X.latex_escaped(F.col("text")), 256).alias("escaped_sha256"))


@R.add("SELECT doc_id, (length(trim(text)) >= 20 AND length(regexp_replace(trim(text), '\\P{L}', '', 'g')) >= 8 AND length(regexp_replace(trim(text), '\\P{L}', '', 'g')) >= 0.25 * length(trim(text)) AND length(trim(text)) - length(replace(trim(text), '�', '')) < 0.01 * length(trim(text))) AS readable FROM documents")
def readable_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", X.readable(F.col("text")).alias("readable"))


@R.add(f"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(translate(text, '{X.INVISIBLE}', ''), '\\r\\n?|\\x0b', chr(10), 'g'), chr(12), chr(10) || chr(10)), '[ \\t\\f\\r]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\n+', ''), '\\n+$', ''))) AS normalized_sha256 FROM documents")
def normalized_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.sha2(X.normalized_document(F.col("text")), 256).alias("normalized_sha256"))


@R.add("SELECT doc_id AS doc, CAST(i AS INTEGER) AS line, trim(l[i]) AS text FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE trim(l[i]) <> ''")
def line_layout(spark: SparkSession, d: str) -> DataFrame:
    return readers.text_lines(table(spark, d, "documents", "doc_id", "text"))


LIMIT = 1800


def _pack_sql(pieces: str) -> str:
    """Pieces joined by blanks while they fit, as one text with chr(1) between parts; what ends in chr(2) stands alone."""
    return f"coalesce(list_reduce({pieces}, lambda a, s: CASE WHEN ends_with(a, chr(2)) OR ends_with(s, chr(2)) OR length(list_last(string_split(a, chr(1)))) + 1 + length(s) > {LIMIT} THEN a || chr(1) || s ELSE a || ' ' || s END), '')"


def _words_sql(sentence: str) -> str:
    """A long sentence's words packed; words beyond the limit in slices."""
    sliced = f"array_to_string(list_transform(range(0, (length(w) - 1) // {LIMIT} + 1), lambda k: substring(w, k * {LIMIT} + 1, {LIMIT})), chr(1)) || chr(2)"
    return _pack_sql(f"list_transform(string_split({sentence}, ' '), lambda w: CASE WHEN length(w) > {LIMIT} THEN {sliced} ELSE w END)")


def _filled(pieces: str) -> str:
    return f"CASE WHEN len({pieces}) = 0 THEN CAST([] AS VARCHAR[]) ELSE string_split(replace({_pack_sql(pieces)}, chr(2), ''), chr(1)) END"


_SENTENCES = f"list_filter(list_transform(string_split(regexp_replace(text, '([.!?;])\\s+', '\\1' || chr(3), 'g'), chr(3)), lambda s: {squeeze_sql('s')}), lambda s: s <> '')"


@R.add(f"""WITH s AS (SELECT doc_id, text, list_transform({_SENTENCES}, lambda s: CASE WHEN length(s) > {LIMIT} THEN {_words_sql('s')} || chr(2) ELSE s END) AS p FROM documents),
c AS (SELECT doc_id, CASE WHEN length(text) <= {LIMIT} THEN [text] ELSE {_filled('p')} END AS parts FROM s),
n AS (SELECT doc_id, parts, unnest(range(len(parts))) AS i FROM c)
SELECT doc_id, CAST(i AS INTEGER) AS part_no, parts[i + 1] AS part, 'MEV-' || upper(substring(sha256(doc_id || '|' || i || '|' || parts[i + 1]), 1, 16)) AS chunk_id FROM n""")
def bounded_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_documents(table(spark, d, "documents", "doc_id", "text"))


@R.add("SELECT conv_id AS doc, turn AS page, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM conversations")
def page_offsets(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "text")
    return chunking.page_offsets(pages).select("doc", "page", F.col("offset").cast("long").alias("offset"))


@R.add("SELECT conv_id AS doc, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id")
def joined_pages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.lit(1).alias("page"), F.col("turn").alias("chunk"), "text")
    return readers.document_pages(rows).select("doc", "text")


@R.add("""
WITH a AS (SELECT conv_id AS doc, sum(length(trim(text))) AS c, count(*) AS p, avg(length(trim(text))) AS av, avg(CASE WHEN length(trim(text)) >= 80 THEN 1.0 ELSE 0.0 END) AS sh, bool_or(contains(text, '�')) AS br FROM conversations GROUP BY conv_id)
SELECT doc, CAST(c AS BIGINT) AS characters, p AS pages, round(av, 2) AS average, round(sh, 3) AS readable_share, array_to_string(list_filter([CASE WHEN av < 200 THEN 'few_characters' END, CASE WHEN sh < 0.70 THEN 'few_readable_pages' END, CASE WHEN br THEN 'replacement_characters' END], lambda x: x IS NOT NULL), ',') AS reasons, CASE WHEN av < 200 OR sh < 0.70 OR br THEN 'yetersiz' ELSE 'uygun' END AS quality FROM a""")
def text_quality(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "text")
    return quality.text_layer(pages).withColumn("reasons", F.array_join("reasons", ","))


# The driver's pages link from their own root and hold no entity but five in list items, so the SQL can be plain.
_PARTS = "list_filter(list_transform(string_split_regex(li, '(?s)<[^>]*>'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '')"
_TITLE = f"array_to_string({_PARTS}, ' ')"
for _n, _s in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _TITLE = f"replace({_TITLE}, '{_n}', '{_s}')"


@R.add(f"SELECT page_id AS page, CAST(i AS INTEGER) AS place, 'https://base.example' || string_split(string_split(li, 'href=\"')[2], '\"')[1] AS address, trim({_TITLE}) AS title FROM (SELECT page_id, i, string_split(l[i], '</li>')[1] AS li FROM (SELECT page_id, l, unnest(range(2, len(l) + 1)) - 1 AS i FROM (SELECT page_id, list_concat(['x'], string_split(html, '<li>')[2:]) AS l FROM pages)) CROSS JOIN (SELECT 1)) WHERE contains(li, 'href=')".replace("string_split(l[i], '</li>')", "string_split(l[i + 1], '</li>')"))
def html_links(spark: SparkSession, d: str) -> DataFrame:
    return readers.html_links(table(spark, d, "pages", "page_id", "html"), base="https://base.example/dir/list.html")


_TERMS = ["the", "password", "rights", "reserved"]


@R.add(f"SELECT doc_id, array_to_string(list_filter([{quoted(_TERMS)}], lambda t: contains(lower(text), t)), ',') AS reasons FROM documents WHERE len(list_filter([{quoted(_TERMS)}], lambda t: contains(lower(text), t))) > 0")
def keyword_reasons(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text").withColumn("_r", readers.keyword_reasons(F.col("text"), _TERMS))
    return docs.filter(F.size("_r") > 0).select("doc_id", F.array_join("_r", ",").alias("reasons"))


@R.add("SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM events")
def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events", "event_id", "user_id", "ts", "event_type", "value").withColumn("value", F.when(F.col("event_type") == "purchase", F.col("value")))
    return chunking.carried_forward(events, "value", "user_id", "ts", "event_id").select("event_id", "user_id", "value")


@R.add("WITH r(first, last, section) AS (VALUES (1, 10, 'small'), (11, 30, 'middle'), (31, 45, 'large')) SELECT p_partkey, p_size AS page, section FROM part LEFT JOIN r ON p_size BETWEEN first AND last")
def section_range_join(spark: SparkSession, d: str) -> DataFrame:
    ranges = spark.createDataFrame([(1, 10, "small"), (11, 30, "middle"), (31, 45, "large")], "first int, last int, section string")
    return chunking.section_of_page(table(spark, d, "part").select("p_partkey", F.col("p_size").alias("page")), ranges).select("p_partkey", "page", "section")


@R.add(f"SELECT o_orderkey, '{{\"o_custkey\":' || o_custkey || ',\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}}' AS json FROM orders")
def canonical_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", X.canonical_json({c: F.col(c) for c in ("o_orderkey", "o_custkey", "o_orderstatus")}).alias("json"))


# The driver's documents hold no article, so each is one page; articles are those of structure_of_laws.
@R.add(f"SELECT doc_id AS doc, CAST(NULL AS VARCHAR) AS section, CAST(NULL AS VARCHAR) AS article, CAST(NULL AS INTEGER) AS paragraph, CAST(NULL AS VARCHAR) AS clause, 'page' AS level, CAST(1 AS INTEGER) AS start, CAST(NULL AS VARCHAR) AS prefix, {squeeze_sql('text')} AS text FROM documents WHERE trim(text) <> ''")
def legal_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text").select(F.col("doc_id").alias("doc"), "text")
    return chunking.structured_or_pages(docs, docs.withColumn("page", F.lit(1)))


_EDGE = "'edge-' || substring(sha256(concat_ws('|', CAST(doc_id AS VARCHAR), raw{0})), 1, 20) AS edge_id, doc_id AS leaf, raw"


@R.add(f"""WITH a AS (SELECT doc_id, '2918 sayılı Karayolları Trafik Kanununun ' || doc_id || ' inci maddesi' AS raw, CAST(doc_id AS VARCHAR) AS article FROM documents WHERE n_chars % 3 <> 0),
b AS (SELECT doc_id, n_chars || ' üncü maddesi' AS raw, CAST(n_chars AS VARCHAR) AS article FROM documents WHERE n_chars % 2 = 0)
SELECT {_EDGE.format('')}, '2918' AS law, 'Karayolları Trafik' AS law_name, article, 0.82::DOUBLE AS confidence FROM a UNION ALL SELECT {_EDGE.format(", 'same-document'")}, NULL, NULL, article, 0.68::DOUBLE FROM b""")
def citations(spark: SparkSession, d: str) -> DataFrame:
    """Sentences that cite, written around each document's numbers; the SQL says what they cite."""
    n, size = F.col("doc_id").cast("string"), F.col("n_chars").cast("string")
    law = F.when(F.col("n_chars") % 3 != 0, F.concat(F.lit("Bu işlem 2918 sayılı Karayolları Trafik Kanununun "), n, F.lit(" inci maddesi gereğidir. "))).otherwise(F.lit("Kanun uygulanır. "))
    own = F.when(F.col("n_chars") % 2 == 0, F.concat(size, F.lit(" üncü maddesine bakılır; "), size, F.lit(" üncü maddesinde yazar."))).otherwise(F.lit("Başka madde yok."))
    return chunking.citation_edges(table(spark, d, "documents").select(F.col("doc_id").alias("leaf"), F.concat(law, own).alias("text")))


@R.add("""WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(CAST(doc_id AS VARCHAR))) AS x FROM documents)
SELECT doc_id, concat_ws('-', x[1:8], x[9:12], '5' || x[14:16], substr('89ab', 1 + (strpos('0123456789abcdef', x[17]) - 1) % 4, 1) || x[18:20], x[21:32]) AS point_id FROM h""")
def point_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id").select("doc_id", X.point_id(F.col("doc_id").cast("string")).alias("point_id"))


_LABEL = "regexp_replace(lower(translate(text, 'Iİ', 'ıi')), '[^\\p{L}\\p{N}]', '', 'g')"


@R.add(f"SELECT doc_id, sha256({_LABEL}) AS compact, sha256(translate({_LABEL}, 'çğıöşü', 'cgiosu')) AS folded FROM documents")
def label_folding(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.sha2(X.compact_label(F.col("text")), 256).alias("compact"), F.sha2(X.folded_label(F.col("text")), 256).alias("folded"))


_BLOCKS = f"list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda b: {squeeze_sql('b')}), lambda b: b <> '')"


@R.add(f"""WITH b AS (SELECT doc_id, source, flatten(list_transform({_BLOCKS}, lambda b: CASE WHEN length(b) <= {LIMIT} THEN [b] ELSE string_split(replace({_words_sql('b')}, chr(2), ''), chr(1)) END)) AS p FROM documents),
c AS (SELECT doc_id, CASE WHEN len(p) = 0 THEN ['[' || coalesce(source, '') || ', 1]'] ELSE {_filled('p')} END AS parts, len(p) = 0 AS bare FROM b),
n AS (SELECT doc_id, parts, bare, unnest(range(len(parts))) AS i FROM c)
SELECT doc_id AS doc, 1 AS page, CAST(i AS INTEGER) AS part_no, parts[i + 1] AS part, bare AS metadata_only FROM n""")
def page_chunks(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.lit(1).alias("page"), F.col("source").alias("title"), "text")
    return chunking.page_chunks(pages)
