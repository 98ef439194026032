"""Text functions as Column expressions; they stay in the JVM except where noted."""

from __future__ import annotations

import unicodedata
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What results must agree on with other systems that read the same corpora.
STOP_WORDS = ["acaba", "adı", "ama", "ancak", "bir", "bu", "da", "de", "daha", "en", "gibi", "ile", "için", "ise", "mi", "mı", "mu", "mü", "ne", "olarak", "olan", "ve", "veya", "şu", "çok", "tarafından"]
TOKEN = "[0-9a-zçğıöşü]+"
TOKEN_WITH_NUMBERS = "[0-9]+[A-Za-zÇĞİÖŞÜçğıöşü]*|[A-Za-zÇĞİÖŞÜçğıöşü]+"
INVISIBLE = "­​‌‍⁠﻿‪‫‬‭‮"
WRAPPED_WORDS = ["başvuran", "başvuru", "basvuran", "basvuru", "düzenleme", "duzenleme", "gönderen", "gönderenin", "gönderici", "gonderen", "gonderenin", "gonderici", "lokasyon", "müracaatçı", "muracaatci"]
LATEX = {"\\": r"\textbackslash{}", "{": r"\{", "}": r"\}", "$": r"\$", "&": r"\&", "#": r"\#", "%": r"\%", "_": r"\_", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}
UNFILLED = "[DOLDURULACAK]"
MONTHS = ["Ocak", "Şubat", "Mart", "Nisan", "Mayıs", "Haziran", "Temmuz", "Ağustos", "Eylül", "Ekim", "Kasım", "Aralık"]
CLOSINGS = {
    "subordinate_internal": ["Rica ederim.", "Gereğini rica ederim."],
    "superior": ["Arz ederim.", "Bilgilerinize arz ederim."],
    "same_level": ["Arz ederim.", "Bilgilerinize arz ederim."],
    "mixed": ["Arz ve rica ederim.", "Arz/rica ederim."],
    "citizen_or_external": ["Saygılarımla.", "İyi dileklerimle.", "Bilgilerinize sunulur."],
}


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def turkish_lower(c: Column) -> Column:
    return F.lower(F.translate(c, "Iİ", "ıi"))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition, which Spark has no function for; ASCII passes through."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def for_search(c: Column, compose: bool = False) -> Column:
    """Folded text. ``compose`` adds NFKC in Python; do that once, on ingest."""
    return squeeze(turkish_lower(nfkc(c) if compose else c))


def tokens(c: Column) -> Column:
    """Tokens of the folded text; none holds white space, so that need not be squeezed first."""
    return F.regexp_extract_all(turkish_lower(c), F.lit(TOKEN), F.lit(0))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are evaluated once, however often they are used: the optimizer merges no generator."""
    for name, c in columns.items():
        df = df.select("*", F.explode(F.array(c)).alias(name))
    return df


def search_tokens(c: Column) -> Column:
    """Tokens of two characters or more that are not stop words."""
    return searched(tokens(c))


def searched(found: Column) -> Column:
    """Of tokens those that searches look for."""
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(STOP_WORDS))


def numbered_tokens(c: Column) -> Column:
    """The offline index's tokens: numbers keep the letters that follow them."""
    return F.transform(F.regexp_extract_all(c, F.lit(TOKEN_WITH_NUMBERS), F.lit(0)), lambda t: F.replace(F.lower(t), F.lit("i̇"), F.lit("i")))


def truncated(c: Column, limit: int = 240) -> Column:
    s = squeeze(c)
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.rtrim(F.substring(s, 1, limit - 1)), F.lit("…")))


def excerpt(c: Column, limit: int = 480) -> Column:
    """Head and tail of a long text."""
    s, side = squeeze(c), (limit - 3) // 2
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.substring(s, 1, side), F.lit("..."), F.right(s, F.lit(side))))


def head_and_tail(c: Column, limit: int = 12_000, share: float = 0.58, gap: str = "\n…\n") -> Column:
    """A bounded text with its head and its tail."""
    head = int((limit - len(gap)) * share)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, head), F.lit(gap), F.right(c, F.lit(limit - len(gap) - head))))


def turkish_title(c: Column) -> Column:
    words = F.split(turkish_lower(c), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.translate(F.substring(w, 1, 1), "i", "İ")), F.substring(w, 2, 1 << 20))), " ")


def latex_escaped(c: Column) -> Column:
    """One pass over the characters, so that what an escape adds is not escaped again."""
    table = F.create_map(*[F.lit(x) for pair in LATEX.items() for x in pair])
    return F.when(c.isNull() | (F.trim(c) == ""), F.lit(UNFILLED)).otherwise(F.array_join(F.transform(F.split(c, ""), lambda ch: F.coalesce(F.element_at(table, ch), ch)), ""))


def fingerprint(c: Column) -> Column:
    return F.sha2(F.lower(squeeze(c)), 256)


def joined_id(prefix: str, length: int, parts: list[Column], missing: str = "None") -> Column:
    """Prefix and the first upper-case hex digits of the SHA-256 of the parts; ``missing`` stands for null."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit(missing)) for p in parts])
    return F.concat(F.lit(prefix), F.upper(F.substring(F.sha2(text, 256), 1, length)))


def stable_hash(parts: list[Column], length: int = 20) -> Column:
    """The first hex digits of the SHA-256 of the parts, null as empty."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, length)


def inventory_number(c: Column) -> Column:
    """A number above a milliard from the first eight hex digits of the SHA-256."""
    return F.lit(1_000_000_000) + F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("bigint")


@F.pandas_udf(T.StringType())
def point_id(s: pd.Series) -> pd.Series:
    """A UUID as it is; of anything else the version 5 UUID in the URL name space."""

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        try:
            return str(uuid.UUID(x))
        except ValueError:
            return str(uuid.uuid5(uuid.NAMESPACE_URL, x))

    return s.map(one)


# The shapes of an official date and number.
OFFICIAL_DATES = [r"^(?:0[1-9]|[12]\d|3[01])\.(?:0[1-9]|1[0-2])\.\d{4}$", rf"(?iu)^(?:0?[1-9]|[12]\d|3[01])\s+(?:{'|'.join(MONTHS)})\s+\d{{4}}$"]
OFFICIAL_NUMBER = r"(?i)^(?:E|Z|O)-\d{8}-\d+(?:\.\d+)*-[A-Za-z0-9]+$"
OPEN_NUMBER = r"^E-\d{8}-XXX-XXX$"


def valid_official_date(c: Column) -> Column:
    return F.trim(c).rlike(OFFICIAL_DATES[0]) | F.trim(c).rlike(OFFICIAL_DATES[1])


def valid_official_number(c: Column) -> Column:
    return F.trim(c).rlike(OFFICIAL_NUMBER)


def repaired_date(c: Column) -> Column:
    """A numeric date with look-alike letters read as digits; null if the calendar has no such day."""
    digits = F.translate(F.trim(c), "OoIl|", "00111")
    parts = F.regexp_extract_all(digits, F.lit(r"\d+"), F.lit(0))
    day, month, year = (F.lpad(F.get(parts, F.lit(i)), n, "0") for i, n in ((0, 2), (1, 2), (2, 4)))
    real = digits.rlike(r"^\d{1,2}[./-]\d{1,2}[./-]\d{4}$") & F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-MM-dd").isNotNull()
    return F.when(real, digits)


def is_web_address(c: Column) -> Column:
    return c.rlike(r"^https?://[^/\s?#]+\S*$")


def is_relative_path(c: Column) -> Column:
    return (F.trim(c) != "") & ~c.rlike(r"^[/\\]|^[A-Za-z]:|(?:^|[/\\])\.\.(?:[/\\]|$)")


def is_sha256(c: Column) -> Column:
    return c.rlike("^[0-9a-f]{64}$")


def masked(c: Column) -> Column:
    return F.when(F.length(c) <= 4, F.repeat(F.lit("*"), F.length(c))).otherwise(F.concat(F.substring(c, 1, 2), F.lit("***"), F.right(c, F.lit(2))))


def canonical_json(columns: dict[str, Column]) -> Column:
    """Compact JSON with sorted keys that keeps nulls."""
    return F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]), {"ignoreNullFields": "false"})


def readable(c: Column, least: int = 20, letters: int = 8, share: float = 0.25) -> Column:
    """Enough characters, letters and share of letters, and few replacement characters."""
    s = F.trim(c)
    n, n_letters, broken = F.length(s), F.length(F.regexp_replace(s, r"\P{L}", "")), F.length(s) - F.length(F.replace(s, F.lit("�"), F.lit("")))
    return (n >= least) & (n_letters >= letters) & (n_letters >= share * n) & (broken < 0.01 * n)


def distinct_parts(parts: Column) -> Column:
    """The parts that are not blank, the first of each folded form, in order, joined by blanks."""
    keyed = F.transform(F.filter(parts, lambda p: p.isNotNull() & (F.trim(p) != "")), lambda p: F.struct(for_search(p).alias("k"), squeeze(p).alias("v")))
    kept = F.filter(keyed, lambda p, i: F.size(F.filter(F.slice(keyed, 1, i), lambda q: q["k"] == p["k"])) == 0)
    return F.array_join(F.transform(kept, lambda p: p["v"]), " ")


def yes_or_no(c: Column) -> Column:
    s = F.lower(F.trim(c))
    return F.when(s.isin("true", "1", "yes", "evet"), True).when(s.isin("false", "0", "no", "hayır", "hayir"), False)


def none_if_blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def article_of(c: Column) -> Column:
    """The article that a heading or source id names, such as 'Madde 5' or 'Geçici Madde 2'."""
    return F.nullif(squeeze(F.regexp_extract(c, r"(?iu)((?:geçici|GEÇİCİ|ek)?\s*madde\s+\d+)", 1)), F.lit(""))


def paragraph_of(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"_F(\d+)$", 1), F.lit("")).cast("int")


def page_range(start: Column, end: Column) -> Column:
    return F.struct(F.least(start, end).alias("page"), F.greatest(start, end).alias("page_end"))


# Where the Windows Turkish code page differs from Latin 1, by code point.
LATIN_1 = "ÐÝÞðýþ\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9f"
TURKISH = "ĞİŞğış€‚ƒ„…†‡ˆ‰Š‹Œ‘’“”•–—˜™š›œŸ"


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 if they are, else as Windows Turkish text, which is Latin 1 with other signs in some places."""
    turkish = F.translate(F.decode(content, "iso-8859-1"), LATIN_1, TURKISH)
    return F.regexp_replace(F.coalesce(F.try_validate_utf8(content.cast("string")), turkish), "^\ufeff", "")


def unwrapped(lines: Column) -> Column:
    """Lines in which the listed form words that a hyphen cuts at a line end are put together, as often as needed."""
    letters = "[A-Za-zÇĞİÖŞÜçğıöşü]+"
    words = F.array(*[F.lit(w) for w in WRAPPED_WORDS])

    def add(acc: Column, line: Column) -> Column:
        last = F.coalesce(F.element_at(acc, -1), F.lit(""))
        word = turkish_lower(F.concat(F.regexp_extract(last, f"({letters})-$", 1), F.regexp_extract(line, f"^({letters})", 1)))
        fits = last.rlike(f"{letters}-$") & F.array_contains(words, word)
        return F.when(fits, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.regexp_replace(last, "-$", ""), line)))).otherwise(F.concat(acc, F.array(line)))

    return F.aggregate(lines, F.array(F.lit("")), add, lambda acc: F.slice(acc, 2, F.size(acc)))


def normalized_document(c: Column, compose: bool = False) -> Column:
    """Invisible signs gone, line ends unified, lines squeezed, form words put together, blank runs collapsed."""
    s = F.translate(nfkc(c) if compose else c, INVISIBLE, "")
    s = F.regexp_replace(F.replace(F.regexp_replace(s, "\r\n?|\u000b", "\n"), F.lit("\f"), F.lit("\n\n")), r"(?U)[^\S\n]+", " ")
    s = F.regexp_replace(s, " ?\n ?", "\n")
    s = F.when(F.contains(s, F.lit("-\n")), F.array_join(unwrapped(F.split(s, "\n")), "\n")).otherwise(s)
    return F.trim(F.regexp_replace(F.regexp_replace(s, "\n{3,}", "\n\n"), "^\n+|\n+$", ""))


def closing_fits(closing: Column, relation: Column) -> Column:
    """Whether a letter's closing belongs to the relation of sender and receiver."""
    said = F.lower(squeeze(closing))
    return F.coalesce(F.array_contains(F.element_at(F.create_map(*[x for k, v in CLOSINGS.items() for x in (F.lit(k), F.array(*[F.lower(F.lit(y)) for y in v]))]), relation), said), F.lit(False))


def compact_label(c: Column) -> Column:
    """Letters and digits of a folded label."""
    return F.regexp_replace(turkish_lower(c), r"[^\p{L}\p{N}]", "")


def folded_label(c: Column) -> Column:
    """A compact label without the signs of Turkish letters."""
    return F.translate(compact_label(c), "çğıöşü", "cgiosu")


def label_forms(c: Column) -> Column:
    """What a label may read as: exact, folded, and folded with look-alike glyphs repaired, in that order."""
    marks = F.regexp_replace(turkish_lower(F.regexp_replace(c, r"^[ \t*•#\[\](){}-]+|[ \t*•#\[\](){}-]+$", "")), r"[^\p{L}\p{N}|!]", "")
    repaired = F.translate(F.translate(marks, "çğıöşü", "cgiosu"), "01|!", "oiii")
    return F.array_distinct(F.array(compact_label(c), folded_label(c), repaired, F.replace(repaired, F.lit("l"), F.lit("i"))))


def is_number_placeholder(c: Column) -> Column:
    """An official number that says openly that it is still to be given."""
    return F.upper(F.trim(c)).rlike(OPEN_NUMBER)


def query_variants(c: Column, rules: list[tuple[list[str], str]], most: int = 300) -> Column:
    """The query, and the query with the additions of the rules one of whose terms it holds."""
    folded = for_search(c)
    added = F.array_compact(F.array(*[F.when(F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(folded, t)), F.lit(more)) for terms, more in rules]))
    longer = F.substring(F.concat_ws(" ", F.array(c), added), 1, most)
    return F.when((F.size(added) > 0) & (for_search(longer) != folded), F.array(c, longer)).otherwise(F.array(c))
