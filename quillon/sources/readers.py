"""Readers: texts, pages, JSON corpora, catalogs, reviews, HTML lists, OCR tables."""

from __future__ import annotations

import html
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.text import decoded, squeeze
from quillon.operators import dedup, quality
from quillon.operators.rules import small

#: The chunk schema; parsed when used, as parsing needs a session.
CHUNK = (
    "chunk_id string, document_id string, title string, section string, article string, paragraph string, clause string, text string, source string, source_sha256 string, source_kind string, page int, page_end int, source_url string, document_type string, domain string, subdomain string, validity_status string, approved_for_active_rag boolean, ocr_status string, context_text string, status string, tags array<string>"
)
# The first bytes of each kind of file, as hex.
SIGNATURES = {"pdf": "25504446", "png": "89504e470d0a1a0a", "jpg": "ffd8ff", "jpeg": "ffd8ff", "tif": "49492a00", "zip": "504b0304"}
_BOM = "﻿"


def read_texts(spark: SparkSession, path: str, most: int = 200_000) -> DataFrame:
    """Whole text files: path, text, and ``rejected`` for those that are too long. Nothing is cut."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    text = decoded(F.col("content"))
    return files.select("path", text.alias("text")).withColumn("rejected", F.length("text") > most)


def signature_fits(path: Column, content: Column) -> Column:
    """Whether a file's first bytes belong to its suffix; other suffixes fit."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*[F.lit(x) for p in SIGNATURES.items() for x in p])
    wanted = F.element_at(table, suffix)
    return F.coalesce(F.startswith(F.lower(F.hex(F.substring(content, 1, 8))), wanted), F.lit(True))


def read_corpus(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Chunks of a JSON envelope {..., data: [chunk, ...]}; with ``strict`` a file that fits no envelope raises."""
    envelope = T.StructType([T.StructField("dataset_name", T.StringType()), T.StructField("data", T.ArrayType(T.StructType.fromDDL(CHUNK)))])
    whole = spark.read.schema(envelope).json(path, multiLine=True, mode="FAILFAST" if strict else "PERMISSIVE")
    chunks = whole.select(F.explode("data").alias("c")).select("c.*")
    defaults = {"source_kind": "unknown", "document_type": "unknown", "domain": "unknown", "subdomain": "unknown", "validity_status": "needs_verification", "ocr_status": "not_inspected", "status": "unknown"}
    return chunks.fillna(defaults).fillna({"approved_for_active_rag": False})


# What a chunk of made-up law must be, by its source's kind and its status.
SYNTHETIC_KINDS, SYNTHETIC_STATUS = ["unknown", "synthetic"], "sentetik_demo_kurali"


def mode_blockers(mode: str) -> Column:
    """Why a chunk may not be in a corpus of that mode: 'synthetic', 'snapshot' or 'public'. Null blocks, and so does an empty id."""
    no_id = {"chunk_id": F.trim("chunk_id") == ""}
    if mode == "synthetic":
        return quality.blockers({**no_id, "source_kind": ~F.col("source_kind").isin(SYNTHETIC_KINDS), "status": F.col("status") != SYNTHETIC_STATUS})
    gate = {"snapshot": quality.snapshot_blockers, "public": quality.public_blockers}[mode]
    return F.concat(quality.blockers(no_id), gate())


def read_trusted(spark: SparkSession, path: str, mode: str) -> tuple[DataFrame, DataFrame]:
    """The chunks of a corpus of a mode, and its binding; one chunk that the mode blocks, or one id twice, refuses all.

    The refusal is decided by one aggregate over the corpus before anything is handed on, and names five chunks.
    """
    chunks = read_corpus(spark, path)
    judged = chunks.select("chunk_id", mode_blockers(mode).alias("_b"))
    faults = judged.filter(F.size("_b") > 0).select("chunk_id", F.array_join("_b", ",").alias("fault")).unionByName(dedup.repeated(chunks, "chunk_id").select("chunk_id", F.lit("repeated").alias("fault")))
    few = faults.orderBy("chunk_id", "fault").limit(5).collect()
    if few:
        raise ValueError(f"not a {mode} corpus: " + "; ".join(f"{r['chunk_id']}: {r['fault']}" for r in few))
    if mode == "synthetic":
        chunks = chunks.withColumn("source_kind", F.lit("synthetic"))
    return chunks, binding(chunks)


def binding(chunks: DataFrame) -> DataFrame:
    """One row (fingerprint, rows): the identity of a corpus, whatever the order of its chunks. Every column counts."""
    return dedup.corpus_fingerprint(dedup.chunk_fingerprints(chunks, "chunk_id", sorted(chunks.columns)), "chunk_id")


def read_pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """path, page (from 1), text of the text layer of each PDF; needs the optional package pypdf on the executors.

    A file that cannot be read gives one row with page 0 and null text. Files, not pages, are the unit of work.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")

    def pages(batches):
        from io import BytesIO

        from pypdf import PdfReader

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = [(name, n, page.extract_text() or "") for n, page in enumerate(PdfReader(BytesIO(content)).pages, 1)]
                except Exception:  # noqa: BLE001 - malformed files raise whatever their bytes led to
                    rows = [(name, 0, None)]
                yield pd.DataFrame(rows, columns=["path", "page", "text"])

    return files.mapInPandas(pages, "path string, page int, text string")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_review(spark: SparkSession, path: str) -> DataFrame:
    """A review CSV; a byte order mark before the first name goes."""
    rows = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True)
    return rows.toDF(*[c.lstrip(_BOM) for c in rows.columns])


def read_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Files of a tree without their content: path, number before the first underscore, bytes, digest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.regexp_extract("path", r"(\d+)_[^/]*$", 1).alias("key"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def layered_catalog(parts: list[DataFrame], key: list[str], line: str | None = None) -> DataFrame:
    """Catalog files in order; of a key in several, the last file's last row stays.

    ``line`` names the column of a row's place in its file. Without it a file's rows must be read by one task, whose
    order they then have.
    """
    tagged = [p.withColumn("_file", F.lit(i)).withColumn("_row", F.col(line) if line else F.monotonically_increasing_id()) for i, p in enumerate(parts)]
    rows = tagged[0]
    for t in tagged[1:]:
        rows = rows.unionByName(t)
    last = Window.partitionBy(*key).orderBy(F.desc("_file"), F.desc("_row"))
    return rows.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_file", "_row", "_r")


def read_after(rows: DataFrame, key: str, last: int | None, limit: int | None = None) -> DataFrame:
    """The next rows of a keyed scan after a checkpoint, in order; the filter is pushed to the source."""
    rest = rows if last is None else rows.filter(F.col(key) > last)
    return rest.orderBy(key).limit(limit) if limit else rest


def looked_up(rows: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the wanted keys, and the wanted keys that have none."""
    return rows.join(wanted.select(key).distinct(), key, "left_semi"), wanted.select(key).distinct().join(rows, key, "left_anti")


def text_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Lines numbered from 1; blank ones are left out but keep their numbers."""
    lines = docs.select(docs[id_column].alias("doc"), F.posexplode(F.split(docs[text_column], "\n")).alias("_p", "_t"))
    return lines.select("doc", (F.col("_p") + 1).alias("line"), F.trim("_t").alias("text")).filter("text <> ''")


def word_lines(words: DataFrame) -> DataFrame:
    """(doc, page, block, line, word_no, word, x0, y0, x1, y1) to lines with their box."""
    return words.groupBy("doc", "page", "block", "line").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_no", "word"))), lambda w: w["word"]), " ").alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


TSV = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf double, text string"


def ocr_table(rows: DataFrame) -> DataFrame:
    """Lines with mean confidence from the rows of an OCR engine's table."""
    words = rows.filter((F.col("level") == 5) & (F.trim("text") != "") & (F.col("conf") >= 0))
    return words.groupBy("page_num", "block_num", "par_num", "line_num").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_num", "text"))), lambda w: w["text"]), " ").alias("text"), F.round(F.avg("conf") / 100, 4).alias("confidence"))


def document_pages(rows: DataFrame) -> DataFrame:
    """(doc, page, chunk, text) rows to one text for each page, parts in order."""
    return rows.groupBy("doc", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


@F.pandas_udf(T.StringType())
def unescaped(s: pd.Series) -> pd.Series:
    """All of HTML's entities, which Spark has no function for; a text without "&" passes through."""
    return s.map(lambda x: html.unescape(x) if x is not None and "&" in x else x)


def _without_dots(path: Column, squash: bool) -> Column:
    """A path's segments with ``.`` and ``..`` applied, and with ``squash`` without empty ones; it begins with a slash."""
    parts = F.split(path, "/")
    inner = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    last = F.element_at(parts, -1)
    step = lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))
    kept = F.aggregate(F.concat(F.filter(inner, lambda x: x != "") if squash else inner, F.array(last)), F.array().cast("array<string>"), step)
    # A path that ends in dots names a folder.
    return F.concat(F.lit("/"), F.array_join(F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/"))


def joined_address(base: str, href: Column) -> Column:
    """``href`` as a browser on the page ``base`` resolves it."""
    at = urlsplit(base)
    origin, folder = f"{at.scheme}://{at.netloc}", at.path.rpartition("/")[0]
    path, rest = F.regexp_extract(href, "^[^?#]*", 0), F.regexp_extract(href, "^[^?#]*(.*)$", 1)
    bare = base.partition("#")[0]
    out = F.when(href == "", F.lit(base)).when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.lit(f"{at.scheme}:"), href))
    out = out.when(href.startswith("#"), F.concat(F.lit(bare), href)).when(href.startswith("?"), F.concat(F.lit(bare.partition("?")[0]), href))
    return out.when(href.startswith("/"), F.concat(F.lit(origin), _without_dots(path, False), rest)).otherwise(F.concat(F.lit(origin), _without_dots(F.concat(F.lit(folder + "/"), path), True), rest))


def html_links(pages: DataFrame, id_column: str = "page_id", html_column: str = "html", base: str = "https://localhost/") -> DataFrame:
    """Links of list items in order: place from 1 among the page's items, address resolved on ``base``, title.

    An item without a link is none but keeps its place. A title is the item's text between tags, trimmed and joined by
    blanks; entities are decoded in both.
    """
    item = r"(?is)<li[^>]*>(.*?)</li>"
    rows = pages.select(pages[id_column].alias("page"), F.posexplode(F.regexp_extract_all(html_column, F.lit(item), F.lit(1))).alias("_p", "_li"))
    found = F.regexp_extract("_li", r"""(?is)<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 0)
    rows = rows.withColumn("_a", found).filter("_a <> ''").withColumn("_href", F.regexp_replace(F.regexp_replace("_a", r"""(?is)^.*?\bhref\s*=\s*["']?""", ""), r"""["']$""", ""))
    texts = F.filter(F.transform(F.split("_li", "(?s)<[^>]*>"), lambda x: squeeze(x)), lambda x: x != "")
    rows = rows.select("page", (F.col("_p") + 1).alias("place"), "_href", F.array_join(texts, " ").alias("_title"))
    # Only items with entities leave the JVM; the others are most.
    marked = F.contains("_href", F.lit("&")) | F.contains("_title", F.lit("&"))
    plain, others = rows.filter(~marked), rows.filter(marked)
    decoded_ = others.select("page", "place", unescaped(F.col("_href")).alias("_href"), unescaped(F.col("_title")).alias("_title"))
    return plain.unionByName(decoded_).select("page", "place", joined_address(base, F.trim("_href")).alias("address"), F.trim("_title").alias("title"))


def keyword_reasons(text: Column, terms: list[str]) -> Column:
    """The terms that a text holds, in order; empty if none."""
    low = F.lower(text)
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(low, t))


def first_policy(files: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """Files (path) with the decision of the first rule (place, pattern, decision) whose pattern fits the path."""
    hits = files.join(small(rules), F.expr("path rlike pattern")).groupBy("path").agg(F.min(F.struct("place", "decision"))["decision"].alias("decision"))
    return files.join(hits, "path", "left").fillna({"decision": default})
