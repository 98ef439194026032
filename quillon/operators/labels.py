"""Labelled fields of scanned letters, inside each row: one expression finds every label, whatever glyphs a scan put in it.

The aliases become one pattern in which each letter stands for all glyphs that scans confuse it with. Labels found are
marked in their line, the line is split at the marks, and values are joined with later lines by place. No Python, and no
shuffle of texts.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import once, squeeze, turkish_lower

# What stands between label and value, around a label, around a value; what is no value; what asks; what names an office.
SEPARATOR = r"(?:[:：=;]|[–—]|\s-\s)"
EDGE = r"[ \t\-*•#\[\](){}]*"
VALUE_EDGE = r"^[ \t:;=\-–—•|]+|[ \t:;=\-–—•|]+$"
PLACEHOLDERS = ["-", "...", "belirsiz", "bilinmiyor", "bulunmuyor", "mevcut degil", "yok"]
REQUEST_MARKERS = ["talep ediyorum", "arz ederim", "rica ederim", "gereğini", "bildiriyorum"]
ORGANIZATION_SUFFIXES = ["başkanlığı", "başkanliği", "başkanligi", "dairesi", "genel müdürlüğü", "il müdürlüğü", "müdürlüğü", "mudurlugu", "şube müdürlüğü"]
# Ranks of a value by how it was read.
WRITTEN, REPAIRED, JOINED, REPAIRED_AND_JOINED = 100, 85, 75, 65
# The most characters of a joined value, of a sender, of other values, and the most words of a sender.
MOST_JOINED, MOST_SENDER, MOST_VALUE, MOST_SENDER_WORDS = 180, 180, 300, 18
# Forms of values.
_PART = r"(?:[A-ZÇĞİÖŞÜ][a-zçğıöşü]{1,24}|[A-ZÇĞİÖŞÜ]{2,25}|[A-ZÇĞİÖŞÜ]\.)"
NAME = rf"^{_PART}(?:\s+{_PART}){{1,3}}$"
DATE = r"^([0-9OoIl|]{1,2})([./-])([0-9OoIl|]{1,2})[./-]([0-9OoIl|]{4})$"
MAIL = r"^[\w.+-]+@[\w-]+(?:\.[\w-]+)+$"
PHONE = r"^(?:\+?90\s*)?0?5\d{2}[\s.-]?\d{3}[\s.-]?\d{2}[\s.-]?\d{2}$"

#: The glyphs that may stand for a folded letter.
_GLYPHS = {"c": "cç", "g": "gğ", "i": "iıİl1|!", "l": "il1|!ıİ", "o": "oö0", "s": "sş", "u": "uü"}
#: Both sides of a look-up are folded this way, which takes l for i.
_FROM, _TO = "çğıöşü01|!l", "cgiosuoiiii"
_MARK, _END = "\x01", "\x02"


def _key(label: str) -> str:
    low = label.replace("I", "ı").replace("İ", "i").lower()
    return "".join(c for c in low if c.isalnum())


def _folded(key: str) -> str:
    return key.translate(str.maketrans(_FROM, _TO))


def _pattern(aliases: dict[str, list[str]]) -> str:
    """Any alias, longest first, with blanks, dots and hyphens allowed between letters."""
    keys = sorted({_key(a) for names in aliases.values() for a in names}, key=lambda k: (-len(k), k))
    one = lambda c: "[" + re.escape(_GLYPHS.get(c.translate(str.maketrans("çğıöşü", "cgiosu")), c)) + "]"
    return "(?:" + "|".join(r"[\s.-]*".join(one(c) for c in k) for k in keys) + ")"


def _holds(c: Column, phrases: list[str]) -> Column:
    low = turkish_lower(c)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in phrases])


def _clean(c: Column) -> Column:
    return F.regexp_replace(squeeze(c), VALUE_EDGE, "")


def field_value(field: Column, value: Column, roles: dict[str, str]) -> Column:
    """The value as a field keeps it, or null. ``roles`` names the fields that are 'sender', 'date', 'email', 'phone', 'request'; others take 2 to 300 characters."""
    role = lambda name: field == roles.get(name, "")
    nothing = F.regexp_replace(F.translate(turkish_lower(value), _FROM, _TO), r"[^\p{L}\p{N}]", "").isin([_folded(_key(p)) for p in PLACEHOLDERS])
    digits = lambda k: F.translate(F.regexp_extract(value, DATE, k), "OoIl|", "00111")
    day = F.concat_ws("-", digits(4), F.lpad(digits(3), 2, "0"), F.lpad(digits(1), 2, "0"))
    sign = F.regexp_extract(value, DATE, 2)
    dated = F.when(F.try_to_date(day, "yyyy-MM-dd").isNotNull(), F.concat(digits(1), sign, digits(3), sign, digits(4)))
    length, asks = F.length(value), _holds(value, REQUEST_MARKERS)
    sender = (length <= MOST_SENDER) & (F.size(F.split(value, " ")) <= MOST_SENDER_WORDS) & ~asks & (F.regexp_count(value, F.lit("[A-Za-zÇĞİÖŞÜçğıöşü]")) >= 2)
    fits = F.when(role("sender"), sender).when(role("email"), value.rlike(MAIL)).when(role("phone"), value.rlike(PHONE)).when(role("request"), asks | _holds(value, ["istiyorum"])).otherwise(True)
    return F.when(value.isNull() | (value == "") | nothing, None).when(role("date"), dated).when((length >= 2) & (length <= MOST_VALUE) & fits, value)


def labelled_fields(docs: DataFrame, aliases: dict[str, list[str]], roles: dict[str, str], flowing: tuple[str, ...] = (), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc, field, value, rank, line of each letter: for each field the value of highest rank, then the first.

    A line may hold several labels, if it starts with one. A label alone takes the next line; one in capitals may lack
    its separator if the value, or a glyph in the label, shows what it is. The last value of a line goes on in the next
    one: a sender's after a comma, slash or hyphen, before an office, or where both make a name; of the ``flowing``
    fields after those signs or in lower case. Rows of one id count as one
    letter; null and empty texts give no rows. Only values found are shuffled.
    """
    names, written = _pattern(aliases), {_key(a): f for f, xs in aliases.items() for a in xs}
    field_of = F.create_map(*[F.lit(x) for k, f in {_folded(k): f for k, f in reversed(written.items())}.items() for x in (k, f)])
    whole = rf"(?iu)^{EDGE}({names}){EDGE}(?:{SEPARATOR}|-)?\s*$"
    bare = rf"(?iu)^{EDGE}({names})\s+(\S.*)$"
    glyphed = r"[01|!]|^\S(?:\s+\S){3,}$"

    def field(label: Column) -> Column:
        return F.element_at(field_of, F.regexp_replace(F.translate(turkish_lower(label), _FROM, _TO), r"[^\p{L}\p{N}]", ""))

    def marked(line: Column) -> Column:
        """The line with each label between marks; separators that a scan lost are put back first."""
        label, rest = F.regexp_extract(line, bare, 1), F.regexp_extract(line, bare, 2)
        scanned = label.rlike(glyphed)
        shows = F.when(field(label) == roles.get("date", ""), rest.rlike(DATE)).when(field(label) == roles.get("sender", ""), scanned | rest.rlike(NAME) | _holds(rest, ORGANIZATION_SUFFIXES)).otherwise(scanned)
        lost = (label != "") & (label == F.upper(label)) & label.rlike(r"\p{L}") & ~line.rlike(rf"(?iu)(?<![\p{{L}}\p{{N}}|!])({names}){EDGE}{SEPARATOR}") & shows
        put = F.when(line.rlike(whole), F.concat(F.regexp_extract(line, whole, 1), F.lit(":"))).when(lost, F.concat(label, F.lit(": "), rest)).otherwise(line)
        return F.regexp_replace(put, rf"(?iu)(?<![\p{{L}}\p{{N}}|!])({names}){EDGE}{SEPARATOR}", f"{_MARK}$1{_END}")

    def segments(line: Column) -> Column:
        parts = F.split(line, _MARK)
        found = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.struct(F.substring_index(p, _END, 1).alias("label"), F.substring_index(p, _END, -1).alias("rest")))
        return F.when(F.get(parts, F.lit(0)).rlike(f"^{EDGE}$"), found).otherwise(F.slice(found, 1, 0))

    def goes_on(name: Column, value: Column, following: Column) -> Column:
        open_end = value.rlike(r"[,/-]$")
        sender = open_end | _holds(following, ORGANIZATION_SUFFIXES) | F.concat_ws(" ", value, following).rlike(NAME)
        fits = F.when(name == roles.get("sender", ""), sender).when(name.isin(list(flowing)), open_end | following.rlike("^[a-zçğıöşü]")).otherwise(False)
        return (following != "") & (F.length(value) + F.length(following) + 1 <= MOST_JOINED) & ~_holds(following, REQUEST_MARKERS) & fits

    # What may be a value's line: one without labels; a separator alone is passed over.
    plain = lambda i: F.coalesce(F.when(F.size(F.get("_segments", i)) == 0, F.get("_lines", i)), F.lit(""))
    next_at = lambda i: i + F.when(F.trim(F.coalesce(F.get("_lines", i + 1), F.lit(""))).rlike("^[:：=;–—-]$"), 2).otherwise(1)

    def placed(xs: Column, i: Column) -> Column:
        return F.transform(xs, lambda x, k: F.struct(field(x["label"]).alias("field"), x["label"].alias("label"), _clean(x["rest"]).alias("own"), _clean(plain(next_at(i))).alias("next"), (k == F.size(xs) - 1).alias("last"), plain(i + 1).alias("after"), plain(next_at(i) + 1).alias("after_next"), i.alias("line"), k.alias("place")))

    slim = docs.select(docs[id_column].alias("doc"), docs[text_column].alias("_text"))
    lines = once(slim, _lines=F.split("_text", r"\r?\n")).drop("_text")
    cut = once(lines, _segments=F.transform(F.transform("_lines", marked), segments))
    each = once(cut, _found=F.flatten(F.transform("_segments", placed))).select("doc", F.posexplode("_found").alias("_n", "f")).select("doc", "_n", "f.*")
    taken = F.col("own") == ""
    value, following = F.when(taken, F.col("next")).otherwise(F.col("own")), F.when(taken, F.col("after_next")).otherwise(F.col("after"))
    each = once(each.withColumn("_taken", taken), _v=value, _f=following)
    each = once(each, _on=F.coalesce((F.col("_taken") | F.col("last")) & (F.col("_v") != "") & goes_on(F.col("field"), F.col("_v"), F.col("_f")), F.lit(False)))
    each = once(each, _joined=F.when(F.col("_on"), _clean(F.concat_ws(" ", "_v", "_f"))).otherwise(F.col("_v")))
    compact = F.regexp_replace(turkish_lower(F.col("label")), r"[^\p{L}\p{N}]", "")
    repaired = ~compact.isin(list(written)) | F.trim("label").rlike(r"^\S(?:\s+\S){3,}$")
    joined = F.col("_taken") | F.col("_on")
    rank = F.when(repaired & joined, REPAIRED_AND_JOINED).when(joined, JOINED).when(repaired, REPAIRED).otherwise(WRITTEN)
    kept = once(each.withColumn("rank", rank), value=field_value(F.col("field"), F.col("_joined"), roles)).filter("value is not null").select("doc", "field", "value", "rank", "line", "place")
    best = kept.groupBy("doc", "field").agg(F.max(F.struct("rank", (-F.col("line")).alias("l"), (-F.col("place")).alias("p"), "value")).alias("b"))
    return best.select("doc", "field", F.col("b.value").alias("value"), F.col("b.rank").alias("rank"), (-F.col("b.l")).alias("line"))
