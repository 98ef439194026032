import random
import re
import uuid

from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators import chunking


def one(spark, column, **values):
    row = spark.range(1)
    for k, v in values.items():
        row = row.withColumn(k, F.lit(v))
    return row.select(column.alias("x")).first()["x"]


def test_turkish_folding(spark):
    assert one(spark, X.for_search(F.col("t")), t="  İSTANBUL \n IŞIK ") == "istanbul ışık"
    assert one(spark, X.tokens(F.col("t")), t="Yol-2 ÇUKUR!") == ["yol", "2", "çukur"]
    assert one(spark, X.search_tokens(F.col("t")), t="bu yol ve a köprü") == ["yol", "köprü"]
    assert one(spark, X.numbered_tokens(F.col("t")), t="12a Km 5") == ["12a", "km", "5"]
    assert one(spark, X.for_search(F.col("t"), compose=True), t="ﬁne") == "fine"


def test_null_and_empty_texts(spark):
    df = spark.createDataFrame([(None,), ("",)], "t string")
    rows = df.select(X.for_search(F.col("t")), X.tokens(F.col("t")), X.latex_escaped(F.col("t")), chunking.bounded_parts(F.col("t"))).collect()
    assert rows[0][2] == rows[1][2] == "[DOLDURULACAK]"
    assert rows[0][3] == [] and rows[1][1] == []


def test_escapes_and_masks(spark):
    assert one(spark, X.latex_escaped(F.col("t")), t=r"a\b{c}_100%") == r"a\textbackslash{}b\{c\}\_100\%"
    assert one(spark, X.masked(F.col("t")), t="abcd") == "****"
    assert one(spark, X.masked(F.col("t")), t="abcdef") == "ab***ef"
    assert one(spark, X.truncated(F.col("t"), 5), t="abc  defgh") == "abc…"


def test_dates_and_numbers(spark):
    assert one(spark, X.valid_official_date(F.col("t")), t="05.11.2024") and one(spark, X.valid_official_date(F.col("t")), t="5 Kasım 2024")
    assert not one(spark, X.valid_official_date(F.col("t")), t="32.01.2024")
    assert one(spark, X.valid_official_number(F.col("t")), t="E-12345678-105.02-99")
    assert one(spark, X.repaired_date(F.col("t")), t="O5.1I.2024") == "05.11.2024"
    assert one(spark, X.repaired_date(F.col("t")), t="31.02.2024") is None


def test_ids(spark):
    given = str(uuid.uuid4())
    assert one(spark, X.point_id(F.col("t")), t=given) == given
    assert one(spark, X.point_id(F.col("t")), t="x") == str(uuid.uuid5(uuid.NAMESPACE_URL, "x"))
    assert one(spark, X.article_of(F.col("t")), t="x GEÇİCİ MADDE 2 y") == "GEÇİCİ MADDE 2"
    assert one(spark, X.paragraph_of(F.col("t")), t="kanun_F3") == 3


def test_wrapped_words(spark):
    assert one(spark, X.normalized_document(F.col("t")), t="Baş-\nvuran: A\r\n\n\n\nD-\n100") == "Başvuran: A\n\nD-\n100"


def test_distinct_parts_and_closings(spark):
    assert one(spark, X.distinct_parts(F.array(F.lit("Yol"), F.lit(" "), F.lit("YOL"), F.lit("köprü")))) == "Yol köprü"
    assert one(spark, X.closing_fits(F.lit("Arz  ederim."), F.lit("superior")))
    assert not one(spark, X.closing_fits(F.lit("Rica ederim."), F.lit("superior")))
    assert not one(spark, X.closing_fits(F.lit("x"), F.lit("unknown")))


def plain_parts(text, limit):
    """The same rules as loops."""
    if len(text) <= limit:
        return [text]
    parts, cur = [], ""
    queue = [" ".join(s.split()) for s in re.split(r"(?<=[.!?;])\s+", text)]
    for s in filter(None, queue):
        if len(s) <= limit:
            if cur and len(cur) + 1 + len(s) > limit:
                parts.append(cur)
                cur = s
            else:
                cur = f"{cur} {s}".strip()
            continue
        if cur:
            parts.append(cur)
            cur = ""
        line = ""
        for w in s.split(" "):
            if len(w) > limit:
                parts += [line] * bool(line) + [w[i : i + limit] for i in range(0, len(w), limit)]
                line = ""
            elif line and len(line) + 1 + len(w) > limit:
                parts.append(line)
                line = w
            else:
                line = f"{line} {w}".strip()
        parts += [line] * bool(line)
    return parts + [cur] * bool(cur)


def test_bounded_parts_match_plain_loops(spark):
    r = random.Random(5)
    texts = [" ".join("".join(r.choices("abc", k=r.choice([1, 3, 9, 40]))) + r.choice(["", "", ".", ";", "!\n"]) for _ in range(r.randrange(1, 60))) for _ in range(120)]
    texts += ["x" * 95, "a b " * 30, "x" * 30]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", chunking.bounded_parts(F.col("t"), 30).alias("p")).collect()
    for row in got:
        assert row["p"] == plain_parts(texts[row["i"]], 30), texts[row["i"]]
        assert all(len(p) <= 30 for p in row["p"])


LAW = "BİRİNCİ BÖLÜM\nAmaç\nMADDE 1- (1) Bu yönetmelik (2008) yılında. (2) İkinci fıkra:\na) birinci bent\nb) ikinci bent\nMADDE 2 - Tanım yok.\nGEÇİCİ MADDE 1- (1) Geçici."


def test_legal_structure(spark):
    docs = spark.createDataFrame([(1, LAW), (2, None), (3, "düz metin")], "doc bigint, text string")
    rows = chunking.legal_structure(docs).orderBy("start").collect()
    # Any number in brackets marks a paragraph.
    assert [(r["article"], r["paragraph"], r["clause"]) for r in rows] == [("Madde 1", "1", None), ("Madde 1", "2008", None), ("Madde 1", "2", "a"), ("Madde 1", "2", "b"), ("Madde 2", None, None), ("Geçici Madde 1", "1", None)]
    assert rows[0]["prefix"] is None and rows[2]["prefix"] == rows[3]["prefix"] == "İkinci fıkra:"
    assert rows[0]["section"] == "Birinci Bölüm — Amaç"
    pages = docs.withColumn("page", F.lit(4))
    rest = chunking.structured_or_pages(docs, pages).filter("level = 'page'").collect()
    assert [(r["doc"], r["start"]) for r in rest] == [(3, 4)]


def test_marks_of_articles_and_sections(spark):
    texts = {
        1: "Madde 5 uyarınca işlem yapılır.\nMADDE 6 – Metin. Madde 7 gereği; bkz. MADDE 8- içeride.",
        2: "MADDE 1- (100) Yüzüncü. (123456789012345678901234567890) Uzun.\nKISA BÖLÜM\nMADDE 2- Son.",
        3: "3. BÖLÜM: Son Hükümler MADDE 9- a) bir (b) iki\nonuncu bölüm\nEK MADDE 1A— x",
        4: "Madde 5 uyarınca",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc bigint, text string")
    rows = sorted((r["doc"], r["start"], r["section"], r["article"], r["paragraph"], r["clause"], r["text"]) for r in chunking.legal_structure(docs).collect())
    assert [r[:1] + r[2:] for r in rows] == [
        (1, "Madde 6", "Madde 6", None, None, "Metin. Madde 7 gereği; bkz."), (1, "Madde 8", "Madde 8", None, None, "içeride."),
        (2, "Madde 1", "Madde 1", "100", None, "Yüzüncü."), (2, "Madde 1", "Madde 1", "123456789012345678901234567890", None, "Uzun. KISA BÖLÜM"), (2, "Madde 2", "Madde 2", None, None, "Son."),
        (3, "3. Bölüm — Son Hükümler", "Madde 9", None, "a", "bir"), (3, "3. Bölüm — Son Hükümler", "Madde 9", None, "b", "iki"), (3, "Onuncu Bölüm", "Ek Madde 1a", None, None, "x"),
    ]


def test_citations_do_not_overlap(spark):
    text = "5018 sayılı Kamu Mali  Yönetimi Kanununun 9 uncu maddesi ile 12 inci maddesi ve 12 inci maddesi uygulanır; 4734 sayılı 3 üncü maddesi, 7A maddeye göre."
    leaves = spark.createDataFrame([(1, text), (2, None), (3, "")], "leaf bigint, text string")
    rows = {(r["law"], r["law_name"], r["article"], r["raw"], r["confidence"]) for r in chunking.citation_edges(leaves).collect()}
    assert rows == {("5018", "Kamu Mali Yönetimi", "9", "5018 sayılı Kamu Mali  Yönetimi Kanununun 9 uncu maddesi", 0.82), (None, None, "12", "12 inci maddesi", 0.68), (None, None, "7A", "7A maddeye", 0.68)}
    assert len({r["edge_id"] for r in chunking.citation_edges(leaves).collect()}) == 3


def test_addresses_are_joined_as_the_standard_library_does(spark):
    from urllib.parse import urljoin

    from quillon.sources import readers

    hrefs = ["", "b", "./b", "../b", "../../b?x=1#y", "/a//b/../c/", "//other.org/x", "https://x.org/a", "mailto:a@b", "?q", "#f", "a/./b/..", "a/", "..", "é/ü", "a?b=/../c"]
    for base in ("https://base/dir/page.html?z#w", "http://h:80/", "https://h.org/a/b/c/"):
        df = spark.createDataFrame([(h,) for h in hrefs], "h string")
        got = [r[0] for r in df.select(readers.joined_address(base, F.col("h"))).collect()]
        assert got == [urljoin(base, h) for h in hrefs]
    pages = spark.createDataFrame([(1, "<ul><li>no link</li><li><b>A&eacute;</b> <a class=x href='../d?a&amp;b'>x\n y</a></li><li><a href=z>&lt;</a></li></ul>")], "page_id int, html string")
    assert [tuple(r) for r in readers.html_links(pages, base="https://base/dir/p").collect()] == [(1, 2, "https://base/d?a&b", "Aé x y"), (1, 3, "https://base/dir/z", "<")]


def test_pages(spark):
    text = "=== SAYFA 1 ===\nbir\n=== SAYFA 2 ===\niki\n"
    assert [(p["page"], p["text"]) for p in one(spark, chunking.marked_pages(F.col("t")), t=text)] == [(1, "bir"), (2, "iki")]
    assert one(spark, chunking.marked_pages(F.col("t")), t=text.replace("2", "3")) is None
    assert one(spark, chunking.page_at(F.array(F.lit(0), F.lit(10), F.lit(20)), F.lit(12))) == 2
    assert one(spark, chunking.repaired_articles(F.col("t")), t="5 - MADDE metin").startswith("MADDE 5-")


def test_labels_and_variants(spark):
    assert "gonderen" in one(spark, X.label_forms(F.col("t")), t="• G0NDEREN:")
    assert one(spark, X.is_number_placeholder(F.col("t")), t="e-12345678-xxx-xxx")
    rules = [(["kiralık"], "sözleşmeli taşıt")]
    assert one(spark, X.query_variants(F.col("t"), rules), t="Kiralık araç") == ["Kiralık araç", "Kiralık araç sözleşmeli taşıt"]
    assert one(spark, X.query_variants(F.col("t"), rules), t="araç") == ["araç"]


def test_page_chunks(spark):
    pages = spark.createDataFrame([(1, 1, "T", "a b\n\nc"), (1, 2, "T", "  "), (1, 3, None, "x" * 50)], "doc int, page int, title string, text string")
    rows = {(r["page"], r["part_no"]): (r["part"], r["metadata_only"]) for r in chunking.page_chunks(pages, 20).collect()}
    assert rows == {(1, 0): ("a b c", False), (2, 0): ("[T, 2]", True), (3, 0): ("x" * 20, False), (3, 1): ("x" * 20, False), (3, 2): ("x" * 10, False)}


def test_long_blocks_are_cut_like_words_packed_one_by_one(spark):
    """whole words as long as they fit; a longer word is slices that stand alone."""

    def plain(words, limit):
        parts, cur = [], ""
        for w in words:
            if len(w) > limit:
                parts += [cur] if cur else []
                parts += [w[i : i + limit] for i in range(0, len(w), limit)]
                cur = ""
            elif cur and len(cur) + 1 + len(w) > limit:
                parts.append(cur)
                cur = w
            else:
                cur = f"{cur} {w}" if cur else w
        return parts + ([cur] if cur else [])

    r, rows = random.Random(6), []
    for n in range(120):
        words = ["".join(r.choices("ab😀ş.", k=r.choice([1, 2, 3, 9, 10, 11, 20, 21, 35]))) for _ in range(r.randrange(1, 40))]
        rows.append((n, words, " ".join(words)))
    for limit in (1, 2, 10, 50):
        got = spark.createDataFrame([(n, t) for n, _, t in rows], "n int, t string").select("n", chunking._words(F.col("t"), limit, True).alias("p"))
        assert {x["n"]: x["p"] for x in got.collect()} == {n: plain(words, limit) for n, words, _ in rows}
    plan = spark.range(1).select(chunking._words(F.lit("a b"), 10, True))._jdf.queryExecution().analyzed().toString()
    assert "aggregate(" not in plan
