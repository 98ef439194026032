"""Queries of gates and structures over rows composed of a table, with faults by their number."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.operators import chunking, dense, fusion, graph, labels, lexical, metrics, quality, rules
from quillon.sources import readers
from quillon.streaming import lifecycle

from .base import Registry, quoted, table

R = Registry()


def _literal(x: object) -> str:
    return "NULL" if x is None else quoted([str(x)])


# Chunks as the gates see them; every row has at most the faults that its number says.
_GATES = {
    "public_gate": (quality.public_blockers, "public_legislation", ["source_kind", "not_approved", "validity", "text_status", "no_document_id", "no_title", "no_section", "no_article", "no_text", "no_source", "no_context_text", "source_url", "source_sha256", "domain", "pages"]),
    "snapshot_gate": (quality.snapshot_blockers, "competition_snapshot", ["source_kind", "active", "validity", "status", "text_status", "no_document_id", "no_title", "no_section", "no_text", "no_source", "no_context_text", "source_path", "source_url", "source_sha256", "domain", "pages"]),
}


def _chunk(public: bool, kind: str, names: list[str]) -> dict[str, Column]:
    """A chunk's columns: right, but wrong for the fault whose place, by two different moduli, the number gives."""
    wrong = lambda name: (F.col("doc_id") % 17 == names.index(name)) | (F.col("doc_id") % 23 == names.index(name)) if name in names else F.lit(False)
    text = lambda name, value: F.when(wrong(f"no_{name}"), "  ").otherwise(value)
    return {
        "source_kind": F.when(wrong("source_kind"), "other").otherwise(kind), "approved_for_active_rag": ~wrong("not_approved") if public else wrong("active"), "validity_status": F.when(wrong("validity"), None).otherwise("verified" if public else "needs_verification"),
        "status": F.when(wrong("status"), "x").otherwise(quality.SNAPSHOT_STATUS), "ocr_status": F.when(wrong("text_status"), "ocr_required").otherwise("text_layer_available"), "document_id": F.when(wrong("no_document_id"), "").otherwise("d"),
        **{c: text(c, "x") for c in ("title", "section", "article", "text", "context_text")}, "source": F.when(wrong("no_source"), " ").when(wrong("source_path"), "../x").otherwise("data/x.pdf"),
        "source_url": F.when(wrong("source_url"), "ftp://x").when(F.lit(not public) & (F.col("doc_id") % 2 == 0), None).otherwise("https://a.org/x"), "source_sha256": F.when(wrong("source_sha256"), "abc").otherwise("a" * 64),
        "domain": F.when(wrong("domain"), "unknown").otherwise("road_transport"), "page": F.lit(3), "page_end": F.when(wrong("pages"), 2).otherwise(4),
    }


def _gate_sql(names: list[str], without: str = "") -> str:
    each = ", ".join(f"CASE WHEN (doc_id % 17 = {i} OR doc_id % 23 = {i}){without if n == 'source_path' else ''} THEN '{n}' END" for i, n in enumerate(names))
    return f"SELECT doc_id, array_to_string(list_filter([{each}], lambda x: x IS NOT NULL), ',') AS blockers FROM documents"


def _gate(name: str) -> None:
    blockers, kind, names = _GATES[name]

    def query(spark: SparkSession, d: str) -> DataFrame:
        chunk = _chunk(name == "public_gate", kind, names)
        rows = table(spark, d, "documents", "doc_id").select("doc_id", *[c.alias(k) for k, c in chunk.items()])
        return rows.select("doc_id", F.array_join(blockers(), ",").alias("blockers"))

    query.__name__ = name
    at = names.index("no_source")
    # A source that is blank has no path to be wrong.
    R.add(_gate_sql(names, f" AND NOT (doc_id % 17 = {at} OR doc_id % 23 = {at})"))(query)


for _name in _GATES:
    _gate(_name)


_RECORD = ["document_id", "review", "scope", "validity", "file", "text", "ocr", "reviewer", "reviewed_at", "source_sha256", "domain"]


@R.add(_gate_sql(_RECORD))
def manifest_gate(spark: SparkSession, d: str) -> DataFrame:
    wrong = lambda name: (F.col("doc_id") % 17 == _RECORD.index(name)) | (F.col("doc_id") % 23 == _RECORD.index(name))
    pick = lambda name, bad, good: F.when(wrong(name), bad).otherwise(good)
    record = {
        "document_id": pick("document_id", "", "d"), "review_status": pick("review", "needs_human_review", "approved"), "scope_status": pick("scope", None, "active"), "validity_status": pick("validity", "needs_verification", "verified"), "pdf_status": F.lit("MATCHED"), "files": pick("file", 2, 1),
        "text_layer_status": pick("text", "ocr_required", "ocr_verified"), "ocr_required": pick("ocr", None, False), "reviewed_by": pick("reviewer", " ", "A"), "reviewed_at": pick("reviewed_at", None, "2024-01-01"), "source_sha256": pick("source_sha256", None, "b" * 64), "domain": pick("domain", "maritime", "road_transport"),
    }
    rows = table(spark, d, "documents", "doc_id").select("doc_id", *[c.alias(k) for k, c in record.items()])
    return rows.select("doc_id", F.array_join(quality.manifest_blockers(), ",").alias("blockers"))


@R.add("SELECT doc_id, array_to_string(list_filter([CASE WHEN n_chars < 200 THEN 'quality' END, CASE WHEN doc_id % 5 = 0 THEN 'chunks' END, CASE WHEN doc_id % 7 = 0 THEN 'sections' END, CASE WHEN lang <> 'en' THEN 'approval' END], lambda x: x IS NOT NULL), ',') AS blockers FROM documents")
def ingestion_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents", "doc_id", "n_chars", "lang").select("doc_id", F.when(F.col("n_chars") < 200, "yetersiz").otherwise("uygun").alias("quality"), (F.col("doc_id") % 5).alias("chunk_count"), (F.col("doc_id") % 7).alias("article_count"), (F.col("lang") == "en").alias("approved"))
    return rows.select("doc_id", F.array_join(quality.ingestion_blockers(), ",").alias("blockers"))


@R.add("SELECT conv_id AS doc, sha256(string_agg(CASE WHEN length(trim(text)) < 80 AND turn % 2 = 0 THEN repeat(text || '.', 3) ELSE text END, chr(10) || chr(10) ORDER BY turn)) AS text_sha256 FROM conversations GROUP BY 1")
def merged_ocr_pages(spark: SparkSession, d: str) -> DataFrame:
    """Turns as pages; every other page was read again."""
    pages = table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "text")
    again = pages.filter("page % 2 = 0").withColumn("text", F.repeat(F.concat("text", F.lit(".")), F.lit(3)))
    return quality.merged_pages(pages, again).select("doc", F.sha2("text", 256).alias("text_sha256"))


@R.add("SELECT p_partkey AS item, p_size % 3 <> 0 AS trusted FROM part")
def reverified_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits with the digest that the index recorded, against what the source says now; every ninth source is gone."""
    part = table(spark, d, "part")
    hits = part.select(F.col("p_partkey").alias("item"), F.sha2("p_name", 256).alias("digest"))
    now = part.filter("p_size % 9 <> 0").select(F.col("p_partkey").alias("item"), F.when(F.col("p_size") % 3 == 0, "other").otherwise(F.sha2("p_name", 256)).alias("digest"))
    return dense.reverified(hits, now).select("item", "trusted")


@R.add("WITH h AS (SELECT o_custkey AS query, o_orderkey AS item, o_totalprice AS relevance, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders WHERE o_orderstatus = 'F') SELECT c_custkey AS query, item, CAST(rank AS INTEGER) AS rank, item IS NULL AS abstained FROM customer LEFT JOIN h ON query = c_custkey AND rank <= 3")
def gated_hits(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "orders").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("item"), F.col("o_totalprice").alias("relevance"), F.lit(0.0).alias("score"), (F.col("o_orderstatus") == "F").alias("accepted"))
    return fusion.gated(table(spark, d, "customer").select(F.col("c_custkey").alias("query")), hits, 3).select("query", "item", "rank", "abstained")


@R.add("SELECT path, CASE WHEN path LIKE '%ECONOMY%' THEN 'keep' WHEN path LIKE '%Brand#1%' THEN 'review' ELSE 'skip' END AS decision FROM (SELECT p_type || '/' || p_brand || '/' || p_partkey AS path FROM part)")
def first_policies(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "part").select(F.concat_ws("/", "p_type", "p_brand", F.col("p_partkey").cast("string")).alias("path"))
    listed = spark.createDataFrame([(1, "ECONOMY", "keep"), (2, "Brand#1", "review")], "place int, pattern string, decision string")
    return readers.first_policy(files, listed, "skip")


@R.add("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'second' ELSE 'first' END AS v FROM supplier")
def layered_catalogs(spark: SparkSession, d: str) -> DataFrame:
    """Two catalogs, the second of which has every other key twice; its last row stays."""
    first = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("first").alias("v"), F.lit(1).alias("line"))
    half = first.filter("id % 2 = 0")
    second = half.withColumn("v", F.lit("second")).withColumn("line", F.lit(9)).unionByName(half.withColumn("v", F.lit("early")).withColumn("line", F.lit(2)))
    return readers.layered_catalog([first, second], ["id"], "line").select("id", "v")


@R.add("SELECT l_orderkey AS doc, l_linenumber % 2 AS page, l_linenumber % 3 AS block, 1 AS line, string_agg(l_returnflag, ' ' ORDER BY l_linenumber, l_returnflag) AS text, min(l_quantity) AS x0, max(l_discount) AS x1 FROM lineitem GROUP BY 1, 2, 3")
def word_lines(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") % 2).alias("page"), (F.col("l_linenumber") % 3).alias("block"), F.lit(1).alias("line"), F.col("l_linenumber").alias("word_no"), F.col("l_returnflag").alias("word"), F.col("l_quantity").alias("x0"), F.lit(0).alias("y0"), F.col("l_discount").alias("x1"), F.lit(1).alias("y1"))
    return readers.word_lines(words).select("doc", "page", "block", "line", "text", "x0", "x1")


@R.add("SELECT doc_id, 'MEV-' || upper(substring(sha256(doc_id || '|' || lang || '|None|None|None|' || source), 1, 16)) AS chunk_id, concat_ws(' > ', source, lang) AS context_text FROM documents")
def chunk_records(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    parts = table(spark, d, "documents", "doc_id", "lang", "source").select("doc_id", F.col("doc_id").alias("document_id"), F.col("source").alias("title"), F.col("lang").alias("section"), none.alias("article"), none.alias("paragraph"), none.alias("clause"), F.col("source").alias("part"))
    return chunking.chunk_records(parts, ["a"]).select("doc_id", "chunk_id", "context_text")


@R.add("SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderkey % 3 = 0 THEN 'not_allowed' END, CASE WHEN o_orderkey % 5 = 0 THEN 'quote' END, CASE WHEN o_orderkey % 7 = 0 THEN 'line' END], lambda x: x IS NOT NULL), ',') AS faults FROM orders")
def cited_evidence(spark: SparkSession, d: str) -> DataFrame:
    at = lambda m: F.col("o_orderkey") % m == 0
    lists = lambda c, a, b: F.when(c, F.array(F.lit(a), F.lit(b))).otherwise(F.array(F.lit(a)))
    rows = table(spark, d, "orders").select("o_orderkey", lists(at(3), "e1", "e9").alias("cited"), F.array(F.lit("e1")).alias("allowed"), F.when(at(5), "not there").otherwise(F.upper("o_orderpriority")).alias("quote"), F.concat(F.lit("is  "), F.col("o_orderpriority"), F.lit(" now")).alias("source_text"), lists(at(7), "l1", "l2").alias("lines"), F.array(F.lit("l1")).alias("known_lines"))
    return quality.cited_evidence(rows).select("o_orderkey", F.array_join("faults", ",").alias("faults"))


@R.add("SELECT n_nationkey AS node, count(DISTINCT r_regionkey) AS kinds FROM nation JOIN region ON r_regionkey <= n_regionkey GROUP BY 1")
def merged_nodes(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") <= F.col("n_regionkey"))
    return graph.merged_edges(pairs.select(F.col("n_nationkey").alias("source"), F.lit("IN").alias("relation"), F.lit("x").alias("target"), F.col("r_regionkey").cast("string").alias("evidence"))).select(F.col("source").alias("node"), F.size("evidence").cast("long").alias("kinds"))


@R.add("SELECT term, term_id FROM (SELECT p_name AS term, row_number() OVER (ORDER BY p_name) - 1 AS term_id FROM (SELECT DISTINCT p_name FROM part))")
def vocabulary_numbers(spark: SparkSession, d: str) -> DataFrame:
    return lexical.vocabulary(table(spark, d, "part").select(F.col("p_name").alias("term"))).select("term", F.col("term_id").cast("long").alias("term_id"))


#: Laws of three shapes, composed of every customer's columns: sections with clauses and sentences about articles, marks
#: inside lines with numbers of any size, and a text without articles.
_SHAPES = [
    ["BİRİNCİ BÖLÜM\nAmaç ", "c_mktsegment", "\nMADDE ", "n", "- (1) Bu Kanun ", "c_name", " işini düzenler.\n(2) Kapsam ", "n", ":\na) Yollar ", "c_custkey", ".\n(b) Köprüler.\nMadde 5 uyarınca yapılır.\nEK MADDE ", "n", "A – Tanımlar ", "c_name", "."],
    ["MADDE ", "n", "- Giriş (", "c_custkey", ") ", "c_mktsegment", " payı. 3. BÖLÜM: Son\nGEÇİCİ MADDE ", "n", " - ", "c_name", " (1) Süre: (a) Bir, b) İki"],
    ["Madde ", "n", " uyarınca ", "c_name", " bildirir."],
]
#: What each shape's leaves are: section, article, paragraph, clause, level, prefix, text, in parts as above.
_LEAVES = [
    (0, ["Birinci Bölüm — Amaç ", "c_mktsegment"], ["Madde ", "n"], ["1"], None, "paragraph", None, ["Bu Kanun ", "c_name", " işini düzenler."]),
    (0, ["Birinci Bölüm — Amaç ", "c_mktsegment"], ["Madde ", "n"], ["2"], "a", "clause", ["Kapsam ", "n", ":"], ["Yollar ", "c_custkey", "."]),
    (0, ["Birinci Bölüm — Amaç ", "c_mktsegment"], ["Madde ", "n"], ["2"], "b", "clause", ["Kapsam ", "n", ":"], ["Köprüler. Madde 5 uyarınca yapılır."]),
    (0, ["Birinci Bölüm — Amaç ", "c_mktsegment"], ["Ek Madde ", "n", "a"], None, None, "article", None, ["Tanımlar ", "c_name", "."]),
    (1, ["Madde ", "n"], ["Madde ", "n"], None, None, "article", None, ["Giriş"]),
    (1, ["Madde ", "n"], ["Madde ", "n"], ["c_custkey"], None, "paragraph", None, ["c_mktsegment", " payı."]),
    (1, ["3. Bölüm — Son"], ["Geçici Madde ", "n"], None, None, "article", None, ["c_name"]),
    (1, ["3. Bölüm — Son"], ["Geçici Madde ", "n"], ["1"], "a", "clause", ["Süre:"], ["Bir,"]),
    (1, ["3. Bölüm — Son"], ["Geçici Madde ", "n"], ["1"], "b", "clause", ["Süre:"], ["İki"]),
]
_FIELDS = ("c_custkey", "c_name", "c_mktsegment", "n")


def _composed_sql(parts: list[str] | None) -> str:
    return "CAST(NULL AS VARCHAR)" if parts is None else " || ".join(f"CAST({p} AS VARCHAR)" if p in _FIELDS else _literal(p) for p in parts)


_LAW_LEAVES = " UNION ALL ".join(
    f"SELECT doc, {_composed_sql(s)} AS section, {_composed_sql(a)} AS article, {_composed_sql(p)} AS paragraph, {_literal(c)} AS clause, {_literal(level)} AS level, {_composed_sql(f)} AS prefix, {_composed_sql(t)} AS text, {k} AS nth FROM c WHERE doc % 3 = {shape}" for k, (shape, s, a, p, c, level, f, t) in enumerate(_LEAVES)
)
_LAW_SQL = f"WITH c AS (SELECT *, CAST(c_custkey AS BIGINT) AS doc, c_custkey % 97 + 1 AS n FROM customer), leaves AS ({_LAW_LEAVES})"


@R.add(f"{_LAW_SQL} SELECT doc, section, article, paragraph, clause, level, prefix, text FROM leaves")
def structure_of_laws(spark: SparkSession, d: str) -> DataFrame:
    """Laws composed of customers, in three shapes."""
    return _laws(spark, d).select("doc", "section", "article", "paragraph", "clause", "level", "prefix", "text")


def _laws(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").withColumn("n", F.col("c_custkey") % 97 + 1)
    text = lambda parts: F.concat(*[F.col(p).cast("string") if p in _FIELDS else F.lit(p) for p in parts])
    shape = F.pmod("c_custkey", F.lit(3))
    return chunking.legal_structure(rows.select(F.col("c_custkey").cast("long").alias("doc"), F.when(shape == 0, text(_SHAPES[0])).when(shape == 1, text(_SHAPES[1])).otherwise(text(_SHAPES[2])).alias("text")))


@R.add(f"{_LAW_SQL} SELECT doc, article, count(*) AS leaves, string_agg(text, chr(10) ORDER BY nth) AS text FROM leaves GROUP BY doc, section, article")
def parents_of_laws(spark: SparkSession, d: str) -> DataFrame:
    return chunking.parents_of(_laws(spark, d)).select("doc", "article", "leaves", "text")


@R.add("SELECT p_partkey, p_name, p_size FROM part")
def zipped_rows(spark: SparkSession, d: str) -> DataFrame:
    """Two columns of a table, put side by side again by place."""
    part = table(spark, d, "part")
    return chunking.zipped(part.select("p_partkey", "p_name"), part.select("p_partkey", "p_size"), "p_partkey")


#: Letters in lines, and the fields that labels give.
_LETTER = "Konu: Yol bakımı\nSender :\nAli Veli\nsubject-less line\nKONU: ikinci\n\nGereğini arz ederim.\nAyşe Kaya"


@R.add("SELECT c_custkey AS doc, f AS field, v AS value, CAST(l AS INTEGER) AS line FROM customer, (VALUES ('subject', 'Yol bakımı', 0), ('sender', 'Ali Veli', 1)) AS t(f, v, l)")
def labelled_fields(spark: SparkSession, d: str) -> DataFrame:
    letters = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(_LETTER).alias("text"))
    aliases = spark.createDataFrame([("sender", "sender", 100), ("konu", "subject", 100)], "alias string, field string, priority int")
    return rules.labelled_lines(letters, aliases)


#: Letters with the fields that their labels give: field, value, rank, line.
_ALIASES = {"sender": ["Gönderen", "Başvuran"], "subject": ["Konu"], "date": ["Tarih"], "phone": ["Telefon"], "email": ["E-posta"], "place": ["Konum"], "request": ["Talep"]}
_ROLES = {k: k for k in ("sender", "date", "email", "phone", "request")}
_SCANS = [
    ("Konu: Yol bakımı Tarih: 01.02.2024", [("subject", "Yol bakımı", 100, 0), ("date", "01.02.2024", 100, 0)]),
    ("K0NU: Köprü onarımı\nTARİH O1.O2.2O24", [("subject", "Köprü onarımı", 85, 0), ("date", "01.02.2024", 100, 1)]),
    ("Gönderen:\nAyşe Kaya\nKonum: Ankara,\nÇankaya", [("sender", "Ayşe Kaya", 75, 0), ("place", "Ankara, Çankaya", 75, 2)]),
    ("K O N U : Tünel\nKonu: Baraj", [("subject", "Baraj", 100, 1)]),
    ("GÖNDEREN Ulaşım Dairesi\nE-posta: a@b.org - Telefon: 0532 123 45 67", [("sender", "Ulaşım Dairesi", 100, 0), ("email", "a@b.org", 100, 1), ("phone", "0532 123 45 67", 100, 1)]),
    ("Bu yazının Konu: kısmı\nTarih: 31.02.2024\nKonu: yok\nTelefon: 12", []),
    ("Gönderen\n:\nYol Şube\nMüdürlüğü\nTalep: bakım istiyorum", [("sender", "Yol Şube Müdürlüğü", 75, 0), ("request", "bakım istiyorum", 100, 4)]),
    ("• Konu = asfalt\nyenileme işi\n\nKonu: ikinci değer", [("subject", "ikinci değer", 100, 3)]),
    ("", []),
    (None, []),
]


@R.add("SELECT c_custkey AS doc, field, value, CAST(r AS INTEGER) AS rank, CAST(l AS INTEGER) AS line FROM customer JOIN (VALUES " + ", ".join(f"({i}, {_literal(f)}, {_literal(v)}, {r}, {n})" for i, (_, xs) in enumerate(_SCANS) for f, v, r, n in xs) + f") AS t(scan, field, value, r, l) ON scan = c_custkey % {len(_SCANS)}")
def scanned_fields(spark: SparkSession, d: str) -> DataFrame:
    """Every customer's letter is one of the scans."""
    text = F.get(F.array(*[F.lit(t) for t, _ in _SCANS]), (F.col("c_custkey") % len(_SCANS)).cast("int"))
    letters = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), text.alias("text"))
    return labels.labelled_fields(letters, _ALIASES, _ROLES, ("subject", "place"))


@R.add("SELECT c_custkey AS doc, 'Ayşe Kaya' AS sender FROM customer WHERE c_custkey % 2 = 0")
def signed_letters(spark: SparkSession, d: str) -> DataFrame:
    letters = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.when(F.col("c_custkey") % 2 == 0, _LETTER).otherwise("Gereğini arz ederim.\n12.03.2024\nSayı: 5\n").alias("text"))
    return rules.signature_sender(letters)


@R.add("""WITH e AS (SELECT user_id AS document, event_id, ts, ['alindi', 'okunuyor', 'siniflandiriliyor', 'tamamlandi', 'bilinmeyen'][1 + event_id % 5] AS status FROM events),
s AS (SELECT *, lag(status) OVER (PARTITION BY document ORDER BY ts, event_id) AS previous FROM e), p(status, i) AS (VALUES ('alindi', 0), ('okunuyor', 1), ('siniflandiriliyor', 2), ('tamamlandi', 12))
SELECT event_id, s.status, previous FROM s LEFT JOIN p ON p.status = s.status LEFT JOIN p q ON q.status = previous WHERE p.i IS NULL OR p.i < q.i - 1""")
def lifecycle_out_of_order(spark: SparkSession, d: str) -> DataFrame:
    named = F.get(F.array(*[F.lit(x) for x in ("alindi", "okunuyor", "siniflandiriliyor", "tamamlandi", "bilinmeyen")]), (F.col("event_id") % 5).cast("int"))
    events = table(spark, d, "events").select(F.col("user_id").alias("document"), "event_id", "ts", named.alias("status"))
    return lifecycle.out_of_order(events, lifecycle.LIFECYCLE).select("event_id", "status", "previous")


@R.add("""WITH r AS (SELECT o_custkey AS query, o_orderpriority AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
t AS (SELECT c_custkey AS query, ['1-URGENT', '2-HIGH', '5-LOW'][1 + c_custkey % 3] AS expected FROM customer),
a AS (SELECT t.query, min(rank) AS place FROM t JOIN r ON r.query = t.query AND item = expected GROUP BY 1)
SELECT round(avg(CASE WHEN place <= 1 THEN 1.0 ELSE 0.0 END), 4) AS top1, round(avg(CASE WHEN place <= 3 THEN 1.0 ELSE 0.0 END), 4) AS top3, count(*) AS queries FROM t LEFT JOIN a ON a.query = t.query""")
def top_k_accuracy(spark: SparkSession, d: str) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.desc("o_totalprice"), "o_orderkey")
    ranked = table(spark, d, "orders").select(F.col("o_custkey").alias("query"), F.col("o_orderpriority").alias("item"), "o_totalprice", "o_orderkey").withColumn("rank", F.row_number().over(best))
    expected = F.get(F.array(F.lit("1-URGENT"), F.lit("2-HIGH"), F.lit("5-LOW")), (F.col("c_custkey") % 3).cast("int"))
    return metrics.top_k_accuracy(ranked, table(spark, d, "customer").select(F.col("c_custkey").alias("query"), expected.alias("expected")))


_RANKED = "row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_totalprice DESC, o_orderkey)"


@R.add(f"""WITH r AS (SELECT o_custkey AS query, o_orderstatus AS channel, o_orderpriority AS item, {_RANKED} AS rank FROM orders), one AS (SELECT query, channel, item, min(rank) AS rank FROM r WHERE rank <= 5 GROUP BY ALL),
f AS (SELECT query, item, round(sum(1.0 / (60 + rank)), 9) AS score, string_agg(channel, '+' ORDER BY channel) AS corpora FROM one GROUP BY 1, 2)
SELECT query, item, score, corpora, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS INTEGER) AS rank FROM f QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, item) <= 3""")
def federated_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Hits of three corpora, each ranked by itself, fused."""
    best = Window.partitionBy("query", "channel").orderBy(F.desc("raw_score"), "o_orderkey")
    ranked = table(spark, d, "orders").select(F.col("o_custkey").alias("query"), F.col("o_orderstatus").alias("channel"), F.col("o_orderpriority").alias("item"), F.col("o_totalprice").alias("raw_score"), "o_orderkey").withColumn("rank", F.row_number().over(best)).filter("rank <= 5")
    return fusion.fuse(ranked, top=3).select("query", "item", "score", F.array_join(F.array_sort(F.transform("contributions", lambda c: c["channel"])), "+").alias("corpora"), "rank")
