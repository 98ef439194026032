"""Splitting texts: bounded parts, legal structure, pages, citations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import squeeze

from .rules import small


def _packed(pieces: Column, limit: int) -> Column:
    """Greedy: neighbours joined by a blank as long as they fit; pieces are within the limit."""
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit("").alias("cur"))

    def add(acc: Column, s: Column) -> Column:
        full = (acc["cur"] != "") & (F.length(acc["cur"]) + 1 + F.length(s) > limit)
        longer = F.when(acc["cur"] == "", s).otherwise(F.concat(acc["cur"], F.lit(" "), s))
        return F.struct(F.when(full, F.concat(acc["parts"], F.array(acc["cur"]))).otherwise(acc["parts"]).alias("parts"), F.when(full, s).otherwise(longer).alias("cur"))

    return F.aggregate(pieces, start, add, lambda acc: F.when(acc["cur"] == "", acc["parts"]).otherwise(F.concat(acc["parts"], F.array(acc["cur"]))))


def _words(s: Column, limit: int, slice_long: bool) -> Column:
    """A long sentence's parts: words packed, words beyond the limit cut into slices that stand alone. White space is squeezed."""
    if not slice_long:
        return _packed(F.split(s, " "), limit)
    # As many whole words as fit, from a word's beginning; inside and at the beginning of a word that does not fit, a slice.
    return F.regexp_extract_all(s, F.lit(rf"(?s)(?<![^ ])[^ ].{{0,{limit - 1}}}(?![^ ])|[^ ]{{1,{limit}}}"), F.lit(0))


def bounded_parts(text: Column, limit: int = 1800, slice_long: bool = True) -> Column:
    """Parts of at most ``limit`` characters: whole text, else packed sentences, else packed words, else slices.

    ``slice_long=False`` is the offline variant, which leaves a word beyond the limit whole.
    """
    sentences = F.filter(F.transform(F.split(text, r"(?<=[.!?;])\s+"), squeeze), lambda s: s != "")
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit("").alias("cur"))

    def add(acc: Column, s: Column) -> Column:
        done = F.when(acc["cur"] != "", F.concat(acc["parts"], F.array(acc["cur"]))).otherwise(acc["parts"])
        alone = F.length(s) > limit
        full = (acc["cur"] != "") & (F.length(acc["cur"]) + 1 + F.length(s) > limit)
        longer = F.when(acc["cur"] == "", s).otherwise(F.concat(acc["cur"], F.lit(" "), s))
        return F.struct(F.when(alone, F.concat(done, _words(s, limit, slice_long))).when(full, done).otherwise(acc["parts"]).alias("parts"), F.when(alone, F.lit("")).when(full, s).otherwise(longer).alias("cur"))

    packed = F.aggregate(sentences, start, add, lambda acc: F.when(acc["cur"] == "", acc["parts"]).otherwise(F.concat(acc["parts"], F.array(acc["cur"]))))
    return F.when(text.isNull(), F.array().cast("array<string>")).when(F.length(text) <= limit, F.array(text)).otherwise(packed)


def chunk_documents(docs: DataFrame, limit: int = 1800, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each part: id, part_no from 0, part, and a stable chunk id."""
    out = docs.select(docs[id_column].alias("doc_id"), F.posexplode(bounded_parts(docs[text_column], limit)).alias("part_no", "part"))
    key = F.concat_ws("|", F.col("doc_id").cast("string"), F.col("part_no").cast("string"), "part")
    return out.withColumn("chunk_id", F.concat(F.lit("MEV-"), F.upper(F.substring(F.sha2(key, 256), 1, 16))))


def page_offsets(pages: DataFrame, separator: int = 2) -> DataFrame:
    """``pages`` (doc, page, text) with the offset at which each page begins in the joined text."""
    before = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("offset", F.coalesce(F.sum(F.length("text") + separator).over(before), F.lit(0)))


def page_at(offsets: Column, at: Column) -> Column:
    """The last page, from 1, that begins at or before an offset; offsets are in order."""
    return F.greatest(F.lit(1), F.size(F.filter(offsets, lambda s: s <= at)))


def section_of_page(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Range join of pages with (first, last, section)."""
    inside, few = F.col("page").between(F.col("first"), F.col("last")), small(ranges)
    if few is not ranges:
        return pages.join(few, inside, "left")
    # An outer range join would broadcast the ranges whatever their number; an inner one of the distinct pages need not.
    found = pages.select("page").distinct().join(ranges, inside)
    return pages.join(found, "page", "left").select(*pages.columns, *ranges.columns)


def carried_forward(rows: DataFrame, value: str, by: str, *order: str) -> DataFrame:
    """``value`` with nulls replaced by the last one before them."""
    upto = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(upto))


def marked_pages(text: Column, marker: str = r"(?m)^=+ *(?:PAGE|SAYFA) +(\d+) *=+ *$") -> Column:
    """Pages of a text with page markers: struct(page, text); null unless the numbers run 1, 2, ... without a gap."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(marker), F.lit(1)), lambda n: n.cast("int"))
    parts = F.filter(F.split(text, marker), lambda t, i: i > 0)
    pages = F.zip_with(numbers, parts, lambda n, t: F.struct(n.alias("page"), F.trim(F.regexp_replace(t, "^\\s+|\\s+$", "")).alias("text")))
    return F.when((F.size(numbers) > 0) & (numbers == F.sequence(F.lit(1), F.greatest(F.size(numbers), F.lit(1)))), pages)


def repaired_articles(text: Column) -> Column:
    """Article marks that OCR turned around, such as '1- MADDE', put right."""
    return F.regexp_replace(text, r"(?m)^(\d+)\s*[-–]\s*MADDE\b", "MADDE $1-")


def articles_complete(articles: Column, expected: list[str]) -> Column:
    """Whether the distinct articles, in order, are the expected ones."""
    return F.array_distinct(articles) == F.array(*[F.lit(x) for x in expected])


# How articles, paragraphs, clauses and sections of a law are marked. A mark may stand inside a line, and
# an article's ends with a dash, so that a sentence about an article opens none.
_ARTICLE = re.compile(r"(?i)\b(?P<mark>(?:(?:GEÇİCİ|EK)\s+)?MADDE\s+(?P<number>\d+[A-ZÇĞİÖŞÜ]?))\s*[-–—]")
_PARAGRAPH = re.compile(r"(?<!\w)\((?P<n>\d+)\)\s*")
_CLAUSE = re.compile(r"(?i)(?<!\w)(?:\((?P<c>[a-zçğıöşü])\)|(?P<plain>[a-zçğıöşü])\))\s*")
_SECTION = re.compile(r"(?i)\b(?P<label>(?:BİRİNCİ|İKİNCİ|ÜÇÜNCÜ|DÖRDÜNCÜ|BEŞİNCİ|ALTINCI|YEDİNCİ|SEKİZİNCİ|DOKUZUNCU|ONUNCU|\d+\.?)\s+BÖLÜM)\b(?:\s*[-–—:]?\s*(?P<title>[^\n]{0,180}))?")
_TITLE_END = re.compile(r"(?i)\b(?:(?:GEÇİCİ|EK)\s+)?MADDE\b")
STRUCTURE = "doc bigint, section string, article string, paragraph string, clause string, level string, start int, prefix string, text string"


def _titled(mark: str) -> str:
    """Words of a mark with a capital first letter, in Turkish."""
    words = mark.translate(str.maketrans("Iİ", "ıi")).lower().split()
    return " ".join({"i": "İ", "ı": "I"}.get(w[0], w[0].upper()) + w[1:] for w in words)


def _section(m: re.Match[str]) -> str:
    title = " ".join(_TITLE_END.split(m["title"] or "", maxsplit=1)[0].split()).strip(" -–—:")
    return f"{_titled(m['label'])} — {title}" if title else _titled(m["label"])


def _cut(text: str, pattern: re.Pattern[str], group: str, start: int, end: int) -> list[tuple[str | None, int, int]]:
    """(mark, begin, end) of the preamble, if any, and of each marked stretch."""
    found = list(pattern.finditer(text, start, end))
    out: list[tuple[str | None, int, int]] = []
    first = found[0].start() if found else end
    if text[start:first].strip():
        out.append((None, start, first))
    bounds = [m.start() for m in found[1:]] + [end]
    return out + [(m[group] or m.groupdict().get("plain"), m.end(), upto) for m, upto in zip(found, bounds, strict=False)]


def _structure(doc: int, text: str) -> Iterator[tuple]:
    sections = [(m.start(), _section(m)) for m in _SECTION.finditer(text)]
    marks = list(_ARTICLE.finditer(text))
    for m, after in zip(marks, [*marks[1:], None], strict=False):
        a0, a1 = m.end(), after.start() if after else len(text)
        a1 = min([a1, *(s for s, _ in sections if a0 < s < a1)])
        article = _titled(m["mark"])
        # An article outside any section is its own.
        section = next((label for s, label in reversed(sections) if s < m.start()), article)
        for number, p0, p1 in _cut(text, _PARAGRAPH, "n", a0, a1):
            parts = _cut(text, _CLAUSE, "c", p0, p1)
            # What stands before the first clause belongs to every clause, and is no part by itself.
            prefix = " ".join(text[parts[0][1] : parts[0][2]].split()) if len(parts) > 1 and parts[0][0] is None else None
            for clause, c0, c1 in parts[1:] if prefix else parts:
                body = " ".join(text[c0:c1].split())
                if body:
                    level = "clause" if clause else "paragraph" if number else "article"
                    yield doc, section, article, number, clause.lower() if clause else None, level, c0, prefix, body


def legal_structure(docs: DataFrame) -> DataFrame:
    """(doc, text) cut into articles, numbered paragraphs and lettered clauses, with the section each stands in.

    Articles are those of the law, temporary and additional ones, and such as "5A"; paragraphs have numbers of any size;
    clauses "a)" and "(a)" carry the text that leads to them as ``prefix``. An article ends at the next section.

    Places of matches are needed, which SQL functions do not give, so this runs in Arrow batches.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in STRUCTURE.split(", ")]
        for f in frames:
            rows = [r for d, t in zip(f["doc"], f["text"], strict=True) if isinstance(t, str) for r in _structure(d, t)]
            yield pd.DataFrame(rows, columns=names)

    return docs.select("doc", "text").mapInPandas(run, STRUCTURE)


def structured_or_pages(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """The structure of each document, or its pages as leaves where it has no article."""
    found = legal_structure(docs)
    rest = pages.join(found.select("doc").distinct(), "doc", "left_anti").filter(F.trim("text") != "")
    fallback = rest.select("doc", F.lit(None).cast("string").alias("section"), F.lit(None).cast("string").alias("article"), F.lit(None).cast("string").alias("paragraph"), F.lit(None).cast("string").alias("clause"), F.lit("page").alias("level"), F.col("page").cast("int").alias("start"), F.lit(None).cast("string").alias("prefix"), squeeze(F.col("text")).alias("text"))
    return found.unionByName(fallback)


# How an article is cited, of a law by number and name, or of the same document.
_NTH = "(?:inci|ıncı|uncu|üncü)?"
EXPLICIT_CITATION = rf"(?iu)(\d{{3,6}})\s+sayılı\s+([A-ZÇĞİÖŞÜa-zçğıöşü0-9 .,'’\-]{{2,100}}?)\s+(?:Kanun|Yönetmelik|Tüzük)[A-ZÇĞİÖŞÜa-zçğıöşü'’]*\s+(\d+[A-ZÇĞİÖŞÜ]?)\s*{_NTH}\s+maddesi"
SAME_CITATION = rf"(?iu)(?<!sayılı\s)(\d+[A-ZÇĞİÖŞÜ]?)\s*{_NTH}\s+madde(?:si|sinin|ye|ye göre|de)?"
#: Confidence of an explicit citation and of one inside the same document.
EXPLICIT, WITHIN = 0.82, 0.68


def citation_edges(leaves: DataFrame) -> DataFrame:
    """From (leaf, text): edge_id, leaf, raw, law, law_name, article, confidence; law is null inside the same document.

    What an explicit citation covers is taken out before the second search, so no stretch is cited twice. A leaf that
    says the same twice has one edge.
    """
    groups = lambda c, p, names: F.arrays_zip(*[F.regexp_extract_all(c, F.lit(p), F.lit(i)).alias(n) for i, n in enumerate(names)])
    first = leaves.select("leaf", F.inline(groups(F.col("text"), EXPLICIT_CITATION, ("raw", "law", "law_name", "article")))).withColumn("law_name", squeeze(F.col("law_name"))).withColumn("confidence", F.lit(EXPLICIT)).withColumn("_scope", F.lit(None).cast("string"))
    rest = F.regexp_replace("text", EXPLICIT_CITATION, "\u0001")
    none = F.lit(None).cast("string")
    second = leaves.select("leaf", F.inline(groups(rest, SAME_CITATION, ("raw", "article")))).select("leaf", "raw", none.alias("law"), none.alias("law_name"), "article", F.lit(WITHIN).alias("confidence"), F.lit("same-document").alias("_scope"))
    edges = first.unionByName(second)
    key = F.concat_ws("|", F.col("leaf").cast("string"), "raw", "_scope")
    named = edges.select(F.concat(F.lit("edge-"), F.substring(F.sha2(key, 256), 1, 20)).alias("edge_id"), *[c for c in edges.columns if c != "_scope"])
    return named.dropDuplicates(["edge_id"])


def page_chunks(pages: DataFrame, limit: int = 1800) -> DataFrame:
    """(doc, page, title, text) cut at blank lines and packed; a page without readable text gives one chunk of its metadata."""
    blocks = F.filter(F.transform(F.split("text", r"\n\s*\n"), squeeze), lambda b: b != "")
    pages = pages.withColumn("_found", _packed(F.flatten(F.transform(blocks, lambda b: F.when(F.length(b) <= limit, F.array(b)).otherwise(_words(b, limit, True)))), limit))
    told = F.concat(F.lit("["), F.coalesce("title", F.lit("")), F.lit(", "), F.col("page").cast("string"), F.lit("]"))
    bare = F.coalesce(F.size("_found"), F.lit(0)) <= 0
    out = pages.withColumn("_parts", F.when(bare, F.array(told)).otherwise(F.col("_found")))
    return out.select("doc", "page", F.posexplode("_parts").alias("part_no", "part"), bare.alias("metadata_only"))


def chunk_records(parts: DataFrame, tags: list[str]) -> DataFrame:
    """Citable chunks of (document_id, title, section, article, paragraph, clause, part): id, breadcrumb, tags."""
    trail = F.concat_ws(" > ", "title", "section", "article", "paragraph", "clause")
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in ("document_id", "section", "article", "paragraph", "clause", "part")])
    return parts.select(F.concat(F.lit("MEV-"), F.upper(F.substring(F.sha2(key, 256), 1, 16))).alias("chunk_id"), "*", trail.alias("context_text"), F.array(*[F.lit(t) for t in tags]).alias("tags"))


def parents_of(leaves: DataFrame) -> DataFrame:
    """The articles over (doc, section, article, start, text) leaves: parent id, first start, leaves, and their text in order."""
    key = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc", "section", "article")]
    whole = F.sort_array(F.collect_list(F.struct("start", "text")))
    out = leaves.groupBy("doc", "section", "article").agg(F.min("start").alias("start"), F.count(F.lit(1)).alias("leaves"), F.array_join(F.transform(whole, lambda x: x["text"]), "\n").alias("text"))
    return out.withColumn("parent", F.concat(F.lit("parent-"), F.substring(F.sha2(F.concat_ws("|", *key), 256), 1, 20)))


def zipped(a: DataFrame, b: DataFrame, place: str) -> DataFrame:
    """Rows of equal place side by side; a place that only one side has fails, as lists of unequal length cannot be zipped."""
    both = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), place, "full_outer")
    uneven = F.col("_a").isNull() | F.col("_b").isNull()
    return both.withColumn(place, F.when(uneven, F.raise_error(F.lit("the two sides differ in length")).cast(dict(a.dtypes)[place])).otherwise(F.col(place))).drop("_a", "_b")
