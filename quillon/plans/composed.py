"""Queries of Column functions over inputs composed of every row of a table; their SQL says the same in other words.

An input is an expression that both engines read alike, or a pair of expressions, Spark's and DuckDB's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators import chunking, dedup, dense, fusion, graph, quality, rules
from quillon.sources import readers, sinks
from quillon.streaming import lifecycle

from .base import Registry, table

R = Registry()
Input = str | tuple[str, str]


def _composed(name: str, source: str, key: str, inputs: dict[str, Input], function: Callable[..., Column], sql: str) -> None:
    """Register the query ``name``: the function, as text, of each row's inputs; ``sql`` is its value over the inputs."""
    spark_side, duck_side = ({k: v if isinstance(v, str) else v[i] for k, v in inputs.items()} for i in (0, 1))
    keys = key.split(", ")

    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = table(spark, d, source).select(*keys, *[F.expr(e).alias(k) for k, e in spark_side.items()])
        return rows.select(*keys, function(*[F.col(k) for k in inputs]).cast("string").alias("result"))

    query.__name__ = name
    R.add(f"SELECT {key}, CAST({sql} AS VARCHAR) AS result FROM (SELECT {key}, {', '.join(f'{e} AS {k}' for k, e in duck_side.items())} FROM {source})")(query)


def _array(*items: str) -> tuple[str, str]:
    return f"array({', '.join(items)})", f"[{', '.join(items)}]"


_joined = lambda c: F.array_join(c, "|")
_or_null = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
_text = lambda e: f"CAST({e} AS STRING)"
_padded = lambda e, n: f"lpad({_text(e)}, {n}, '0')"
_LOW = "lower(translate({0}, 'Iİ', 'ıi'))"
_SQUEEZED = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_FIRSTS = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"

_composed(
    "title_cases", "customer", "c_custkey",
    {"s": "CASE c_custkey % 4 WHEN 0 THEN concat('ISPARTA ', c_mktsegment, ' içi işi') WHEN 1 THEN concat(lower(c_mktsegment), '  IŞIK ', c_name) WHEN 2 THEN '' ELSE c_name END"},
    X.turkish_title, f"array_to_string(list_transform(string_split({_LOW.format('s')}, ' '), lambda w: upper(replace(left(w, 1), 'i', 'İ')) || substr(w, 2)), ' ')",
)
_DAY, _MONTH, _YEAR = "(o_orderkey % 34)", "(o_custkey % 15)", "(2000 + o_orderkey % 30)"
_composed(
    "date_cases", "orders", "o_orderkey",
    {"s": f"CASE o_orderkey % 5 WHEN 0 THEN concat(' ', {_padded(_DAY, 2)}, '.', {_padded(_MONTH, 2)}, '.', {_text(_YEAR)}) WHEN 1 THEN concat({_text(_DAY)}, '.', {_text(_MONTH)}, '.', {_text(_YEAR)}) WHEN 2 THEN concat({_text(_DAY)}, '  Mart ', {_text(_YEAR)}) WHEN 3 THEN concat({_padded(_DAY, 2)}, ' ağustos ', {_text(_YEAR)}) ELSE concat({_text(_DAY)}, ' March ', {_text(_YEAR)}) END"},
    X.valid_official_date, rf"regexp_full_match(trim(s), '(0[1-9]|[12][0-9]|3[01])\.(0[1-9]|1[0-2])\.[0-9]{{4}}') OR regexp_full_match(lower(trim(s)), '(0?[1-9]|[12][0-9]|3[01])\s+(ocak|şubat|mart|nisan|mayıs|haziran|temmuz|ağustos|eylül|ekim|kasım|aralık)\s+[0-9]{{4}}')",
)
_composed(
    "number_cases", "orders", "o_orderkey",
    {"s": f"CASE o_orderkey % 5 WHEN 0 THEN concat('E-', {_padded('o_orderkey', 8)}, '-', {_text('o_custkey')}, '.', {_text('o_orderkey % 7')}, '-', {_text('o_orderkey')}) WHEN 1 THEN concat('o-', {_padded('o_custkey', 8)}, '-1-A', {_text('o_orderkey')}) WHEN 2 THEN concat(' e-', {_padded('o_orderkey', 8)}, '-xxx-XXX') WHEN 3 THEN concat('E-', {_text('o_orderkey')}, '-1-2') ELSE concat({_text('o_custkey')}, '/5') END"},
    lambda s: F.concat_ws(",", X.valid_official_number(s).cast("string"), X.is_number_placeholder(s).cast("string")),
    r"concat_ws(',', regexp_full_match(upper(trim(s)), '[EZO]-[0-9]{8}-[0-9]+(\.[0-9]+)*-[A-Z0-9]+'), regexp_full_match(upper(trim(s)), 'E-[0-9]{8}-XXX-XXX'))",
)
_SIGN = "CASE o_orderkey % 2 WHEN 0 THEN '.' ELSE '/' END"
_composed(
    "repaired_date_cases", "orders", "o_orderkey",
    {"s": f"CASE o_orderkey % 7 WHEN 6 THEN o_orderpriority ELSE translate(concat({_text(_DAY)}, {_SIGN}, {_padded(_MONTH, 2)}, {_SIGN}, {_text(_YEAR)}), '01', CASE o_orderkey % 3 WHEN 0 THEN 'Ol' WHEN 1 THEN 'oI' ELSE '01' END) END"},
    X.repaired_date, r"CASE WHEN regexp_full_match(translate(s, 'OoIl|', '00111'), '[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}') AND try_strptime(replace(translate(s, 'OoIl|', '00111'), '/', '.'), '%d.%m.%Y') IS NOT NULL THEN translate(s, 'OoIl|', '00111') END",
)
_composed(
    "address_predicates", "pages", "page_id",
    {"s": f"CASE page_id % 8 WHEN 0 THEN concat('/etc/', {_text('page_id')}) WHEN 1 THEN concat('data/../', {_text('page_id')}) WHEN 2 THEN concat('data/', {_text('page_id')}, '..pdf') WHEN 3 THEN concat('C:x', {_text('page_id')}) WHEN 4 THEN repeat('a', 60 + CAST(page_id % 7 AS INT)) WHEN 5 THEN ' ' ELSE url END"},
    lambda s: F.concat_ws(",", X.is_web_address(s).cast("string"), X.is_relative_path(s).cast("string"), X.is_sha256(s).cast("string")),
    r"concat_ws(',', regexp_matches(s, '^https?://[^/\s?#]+\S*$'), trim(s) <> '' AND left(s, 1) NOT IN ('/', '\') AND NOT regexp_matches(s, '^[A-Za-z]:') AND NOT list_contains(string_split(replace(s, '\', '/'), '/'), '..'), length(s) = 64 AND regexp_full_match(s, '[0-9a-f]+'))",
)
_composed(
    "coercion_cases", "customer", "c_custkey",
    {"s": "CASE c_custkey % 8 WHEN 0 THEN 'Evet' WHEN 1 THEN ' no ' WHEN 2 THEN '0' WHEN 3 THEN '' WHEN 4 THEN '1' WHEN 5 THEN ' TRUE' WHEN 6 THEN NULL ELSE c_mktsegment END"},
    lambda s: F.concat_ws(",", _or_null(X.yes_or_no(s)), _or_null(X.none_if_blank(s))),
    "concat_ws(',', CASE WHEN lower(trim(s)) IN ('true', '1', 'yes', 'evet') THEN 'true' WHEN lower(trim(s)) IN ('false', '0', 'no', 'hayır', 'hayir') THEN 'false' ELSE 'null' END, coalesce(nullif(trim(s), ''), 'null'))",
)
_NAMED = r"regexp_extract(s, '(?i)((geçici|ek)?\s*madde\s+[0-9]+)', 1)"
_composed(
    "article_cases", "orders", "o_orderkey",
    {"s": f"CASE o_orderkey % 5 WHEN 0 THEN concat('MADDE ', {_text('o_custkey')}, ' - ', o_orderpriority) WHEN 1 THEN concat('Geçici  Madde ', {_text('o_orderkey % 9')}) WHEN 2 THEN concat('K_M', {_text('o_custkey')}, '_F', {_text('o_orderkey % 20')}) WHEN 3 THEN concat('bkz. ek madde  ', {_text('o_orderkey')}, 'x') ELSE o_orderpriority END"},
    lambda s: F.concat_ws(",", _or_null(X.article_of(s)), _or_null(X.paragraph_of(s))),
    rf"concat_ws(',', coalesce(nullif({_SQUEEZED.format(_NAMED)}, ''), 'null'), coalesce(nullif(regexp_extract(s, '_F([0-9]+)$', 1), ''), 'null'))",
)
_composed(
    "page_range_cases", "lineitem", "l_orderkey, l_linenumber, l_partkey",
    {"a": "CAST(l_quantity AS INT)", "b": "CAST(l_suppkey AS INT)"}, lambda a, b: F.concat_ws("-", X.page_range(a, b)["page"].cast("string"), X.page_range(a, b)["page_end"].cast("string")),
    "CASE WHEN a <= b THEN concat_ws('-', a, b) ELSE concat_ws('-', b, a) END",
)
_composed(
    "unwrapped_cases", "conversations", "conv_id, turn",
    {"s": f"concat(CASE conv_id % 4 WHEN 0 THEN concat('Baş-', chr(10), 'vuran: ') WHEN 1 THEN concat('ara-', chr(10), 'ba ') WHEN 2 THEN concat('GÖNDE-', chr(10), 'rilen') ELSE concat('Düzen-', chr(10), 'lemeler') END, role, chr(10), {_text('turn')}, '-', chr(10), role)"},
    lambda s: _joined(X.unwrapped(F.split(s, "\n"))), "replace(replace(s, 'Baş-' || chr(10) || 'vuran', 'Başvuran'), chr(10), '|')",
)
_composed(
    "decoded_cases", "documents", "doc_id",
    {"b": (f"CASE doc_id % 3 WHEN 0 THEN encode(substring(text, 1, 200), 'utf-8') WHEN 1 THEN encode(translate(concat('İşÇ€ ğı ', lang), '{X.TURKISH}', '{X.LATIN_1}'), 'iso-8859-1') ELSE concat(unhex('EFBBBF'), encode(lang, 'utf-8')) END", "CASE doc_id % 3 WHEN 0 THEN left(text, 200) WHEN 1 THEN 'İşÇ€ ğı ' || lang ELSE lang END")},
    X.decoded, "b",
)
_composed(
    "masked_cases", "customer", "c_custkey", {"s": "CASE c_custkey % 12 WHEN 11 THEN NULL ELSE substring(c_name, 1, CAST(c_custkey % 12 AS INT)) END"},
    X.masked, "CASE WHEN length(s) <= 4 THEN repeat('*', length(s)) ELSE left(s, 2) || '***' || right(s, 2) END",
)
_COMPACT, _MARKS = rf"regexp_replace({_LOW.format('s')}, '[^\p{{L}}\p{{N}}]', '', 'g')", r"regexp_replace(lower(translate(trim(s, ' •:-'), 'Iİ', 'ıi')), '[^\p{L}\p{N}|!]', '', 'g')"
_REPAIRED = f"translate(translate({_MARKS}, 'çğıöşü', 'cgiosu'), '01|!', 'oiii')"
_FORMS = f"[{_COMPACT}, translate({_COMPACT}, 'çğıöşü', 'cgiosu'), {_REPAIRED}, replace({_REPAIRED}, 'l', 'i')]"
_composed(
    "label_form_cases", "customer", "c_custkey",
    {"s": f"CASE c_custkey % 4 WHEN 0 THEN concat('• K0NU ', c_mktsegment, ' -') WHEN 1 THEN concat('Gönderen', {_text('c_custkey')}) WHEN 2 THEN concat('- Ta|ih ', c_mktsegment, '!') ELSE c_name END"},
    lambda s: _joined(X.label_forms(s)), f"array_to_string({_FIRSTS.format(_FORMS)}, '|')",
)
_composed(
    "query_variant_cases", "customer", "c_custkey", {"s": "concat(CASE c_custkey % 4 WHEN 0 THEN 'Yol bakımı ' WHEN 1 THEN 'hava ' WHEN 2 THEN 'GEMİ yolu ' ELSE 'Gemi ' END, c_mktsegment)"},
    lambda s: _joined(X.query_variants(s, [(["yol", "karayolu"], "karayolu altyapısı"), (["gemi"], "denizcilik")])),
    f"s || CASE WHEN contains({_LOW.format('s')}, 'yol') OR contains({_LOW.format('s')}, 'gemi') THEN concat_ws(' ', '|' || s, CASE WHEN contains({_LOW.format('s')}, 'yol') THEN 'karayolu altyapısı' END, CASE WHEN contains({_LOW.format('s')}, 'gemi') THEN 'denizcilik' END) ELSE '' END",
)
_URL_SHA1 = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({0}))"
_NAME_BASED = f"concat_ws('-', {_URL_SHA1}[1:8], {_URL_SHA1}[9:12], '5' || {_URL_SHA1}[14:16], substr('89ab', 1 + (strpos('0123456789abcdef', {_URL_SHA1}[17]) - 1) % 4, 1) || {_URL_SHA1}[18:20], {_URL_SHA1}[21:32])"
# Of every four customers two have an id in one of its spellings, one a text that is hashed, one null.
_composed(
    "point_id_cases", "customer", "c_custkey",
    {"s": f"CASE c_custkey % 4 WHEN 0 THEN concat('6ba7b811-9dad-11d1-80b4-', {_padded('c_custkey', 12)}) WHEN 1 THEN concat('6BA7B8119DAD11D180B4', {_padded('c_custkey', 12)}) WHEN 2 THEN concat('http://www.python.org/', c_name) ELSE NULL END"},
    X.point_id, f"CASE c_custkey % 4 WHEN 2 THEN {_NAME_BASED.format('s')} WHEN 3 THEN NULL ELSE '6ba7b811-9dad-11d1-80b4-' || {_padded('c_custkey', 12)} END",
)
_composed(
    "page_at_cases", "lineitem", "l_orderkey, l_linenumber, l_partkey", {"a": _array("CAST(l_linenumber AS INT)", "CAST(l_linenumber + l_quantity AS INT)", "CAST(l_linenumber + l_quantity * 2 AS INT)"), "n": "CAST(l_suppkey AS INT)"},
    chunking.page_at, "CASE WHEN n >= a[3] THEN 3 WHEN n >= a[2] THEN 2 ELSE 1 END",
)
_composed(
    "marked_page_cases", "conversations", "conv_id, turn",
    {"s": f"concat(CASE conv_id % 5 WHEN 0 THEN 'none ' ELSE concat('== PAGE 1 ==', chr(10)) END, role, chr(10), '=== SAYFA ', {_text('2 + conv_id % 2')}, ' ===', chr(10), chr(10), {_text('turn')}, ' ')"},
    lambda s: _joined(F.transform(chunking.marked_pages(s), lambda p: F.concat(p["page"].cast("string"), F.lit(":"), p["text"]))),
    "CASE WHEN conv_id % 5 <> 0 AND conv_id % 2 = 0 THEN '1:' || split_part(s, chr(10), 2) || '|2:' || turn END",
)
_composed(
    "repaired_article_cases", "orders", "o_orderkey",
    {"s": f"concat({_text('o_orderkey')}, CASE o_orderkey % 4 WHEN 0 THEN '- MADDE ' WHEN 1 THEN ' – MADDE ' WHEN 2 THEN '-MADDE' ELSE ' MADDE-' END, o_orderpriority, chr(10), {_text('o_custkey')}, '- MADDE')"},
    chunking.repaired_articles, r"array_to_string(list_transform(string_split(s, chr(10)), lambda x: regexp_replace(x, '^([0-9]+)\s*[-–]\s*MADDE\b', 'MADDE \1-')), chr(10))",
)
_composed(
    "article_sequence_cases", "orders", "o_orderkey", {"a": _array("'1'", _text("1 + o_orderkey % 2"), _text("2 + o_custkey % 2"), "'3'")},
    lambda a: chunking.articles_complete(a, ["1", "2", "3"]), "o_orderkey % 2 = 1 OR a[3] = '2'",
)
_HEAD = "CASE page_id % 4 WHEN 0 THEN '255044462D312E37' WHEN 1 THEN '89504E470D0A1A0A' WHEN 2 THEN 'FFD8FFE000' ELSE '504B0304' END"
_composed(
    "signature_cases", "pages", "page_id", {"p": f"concat('f', {_text('page_id')}, CASE page_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PNG' WHEN 2 THEN '.jpg' WHEN 3 THEN '.txt' ELSE '' END)", "b": (f"unhex({_HEAD})", f"from_hex({_HEAD})")},
    readers.signature_fits, "CASE page_id % 5 WHEN 0 THEN starts_with(hex(b), '25504446') WHEN 1 THEN starts_with(hex(b), '89504E47') WHEN 2 THEN starts_with(hex(b), 'FFD8FF') ELSE true END",
)
_SIDES = ("x0", "y0", "x1", "y1")
_composed(
    "unit_box_cases", "lineitem", "l_orderkey, l_linenumber, l_partkey", {"x0": "l_quantity * 3.0 - 20.0", "y0": "l_linenumber * 10.0", "x1": "l_quantity * 5.0", "y1": "CAST(l_suppkey AS DOUBLE)"},
    lambda *c: F.concat_ws(",", *[F.round(quality.unit_box(*c, F.lit(200.0), F.lit(100.0))[k] * 1000).cast("long").cast("string") for k in _SIDES]),
    "concat_ws(',', " + ", ".join(f"CAST(round(least(1.0, greatest(0.0, CAST({k} AS DOUBLE) / {200 if k[0] == 'x' else 100})) * 1000) AS BIGINT)" for k in _SIDES) + ")",
)
_composed(
    "process_id_cases", "orders", "o_orderkey",
    {"s": f"concat(CASE o_orderkey % 6 WHEN 5 THEN '../' ELSE '' END, 'EVR-', {_padded('o_custkey', 8)}, CASE o_orderkey % 3 WHEN 2 THEN '0' ELSE '' END, '-', CASE o_orderkey % 4 WHEN 3 THEN lower(lpad(hex(o_orderkey + 10000000), 8, 'A')) ELSE lpad(hex(o_orderkey + 10000000), 8, 'A') END)"},
    sinks.process_id_fits, "length(s) = 21 AND s = upper(s) AND left(s, 4) = 'EVR-' AND s[13] = '-' AND regexp_full_match(s[5:12], '[0-9]+') AND regexp_full_match(s[14:], '[0-9A-F]+')",
)
_composed(
    "rendered_cases", "customer", "c_custkey", {"a": "CASE c_custkey % 5 WHEN 0 THEN NULL ELSE c_name END", "b": "CASE c_custkey % 3 WHEN 0 THEN '{{a}}' ELSE c_mktsegment END"},
    lambda a, b: sinks.rendered("Konu: {{a}}\n{{b}} - {{a}}", {"a": a, "b": b}), "'Konu: ' || coalesce(a, '[DOLDURULACAK]') || chr(10) || b || ' - ' || coalesce(a, '[DOLDURULACAK]')",
)
_composed(
    "value_fault_cases", "customer", "c_custkey",
    {"f": "CASE c_custkey % 3 WHEN 0 THEN 'subject' WHEN 1 THEN 'sender' ELSE 'date' END", "v": f"CASE c_custkey % 7 WHEN 0 THEN ' ... ' WHEN 1 THEN '[doldurulacak]' WHEN 2 THEN repeat('y ', 160) WHEN 3 THEN repeat('ad ', CAST(c_custkey % 12 AS INT)) WHEN 4 THEN concat({_padded('c_custkey % 35', 2)}, '.05.2024') WHEN 5 THEN NULL ELSE c_name END"},
    lambda f, v: F.coalesce(rules.value_fault(f, v), F.lit("fine")),
    rf"CASE WHEN v IS NULL OR regexp_full_match({_SQUEEZED.format('v')}, '[\[.…_\-\s\]]*') OR upper({_SQUEEZED.format('v')}) = '[DOLDURULACAK]' THEN 'placeholder' WHEN length({_SQUEEZED.format('v')}) > 300 THEN 'too_long' WHEN f = 'sender' AND len(string_split({_SQUEEZED.format('v')}, ' ')) > 8 THEN 'too_many_words' WHEN f = 'date' AND NOT regexp_full_match({_SQUEEZED.format('v')}, '(0[1-9]|[12][0-9]|3[01])\.(0[1-9]|1[0-2])\.[0-9]{{4}}') THEN 'not_a_date' ELSE 'fine' END",
)


def _draft(subject: Column, summary: Column, date: Column) -> Column:
    made = rules.draft(subject, summary, F.lit("Arz ederim."), F.map_filter(F.create_map(F.lit("date"), date), lambda k, v: v.isNotNull()), F.array(F.lit("date"), F.lit("number")))
    return F.concat_ws("#", made["heading"], _joined(made["paragraphs"]), _joined(made["missing"]))


_composed(
    "draft_cases", "customer", "c_custkey", {"a": "CASE c_custkey % 4 WHEN 0 THEN NULL ELSE c_name END", "m": "CASE c_custkey % 3 WHEN 0 THEN ' ' ELSE c_mktsegment END", "t": "CASE c_custkey % 2 WHEN 0 THEN NULL ELSE '01.02.2024' END"},
    _draft, "concat_ws('#', 'Konu: ' || coalesce(a, '[DOLDURULACAK]'), CASE WHEN trim(m) = '' THEN '' ELSE m END, CASE WHEN t IS NULL THEN 'date|number' ELSE 'number' END)",
)
_composed(
    "trust_cases", "customer", "c_custkey", {"k": "CASE c_custkey % 4 WHEN 0 THEN 'synthetic' WHEN 1 THEN 'official' WHEN 2 THEN 'snapshot' ELSE c_mktsegment END", "a": "CASE c_nationkey % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END", "g": "repeat('a', 62 + CAST(c_custkey % 3 AS INT))"},
    fusion.source_trust, "CASE WHEN k IN ('synthetic', 'snapshot') THEN k WHEN k = 'official' AND a IS TRUE AND length(g) = 64 THEN 'official' ELSE 'untrusted' END",
)
_composed(
    "evidence_text_cases", "customer", "c_custkey", {"s": "CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN ' ' WHEN 2 THEN NULL ELSE '' END", "f": "CASE c_nationkey % 3 WHEN 0 THEN concat(c_mktsegment, ' ') WHEN 1 THEN '' ELSE NULL END", "q": "c_name"},
    lambda s, f, q: F.concat_ws(":", fusion.evidence_text(s, f, q)["basis"], fusion.evidence_text(s, f, q)["text"]),
    "CASE WHEN trim(coalesce(s, '')) <> '' THEN 'submitted:' || trim(s) WHEN trim(coalesce(f, '')) <> '' THEN 'fields:' || trim(f) ELSE 'query:' || q END",
)
_WORDS = _array("role", _text("turn % 3"), "'a'")
_SOME = _array("'a'", "'user'", "'1'")
_composed(
    "visible_term_cases", "conversations", "conv_id, turn", {"m": _WORDS, "e": _SOME, "v": _array("role", "'0'", "CASE conv_id % 2 WHEN 0 THEN 'a' ELSE 'b' END")},
    lambda m, e, v: F.concat_ws(";", *[_joined(x) for x in fusion.visible_and_expanded(m, e, v)]), "array_to_string(list_filter(m, lambda x: list_contains(e, x) AND list_contains(v, x)), '|') || ';' || array_to_string(list_filter(m, lambda x: NOT list_contains(e, x)), '|')",
)
_composed(
    "concept_score_cases", "orders", "o_orderkey", {"t": "concat_ws(' ', CASE o_orderkey % 2 WHEN 0 THEN 'yol' END, CASE o_orderkey % 3 WHEN 0 THEN 'köprü' END, CASE o_orderkey % 5 WHEN 0 THEN 'bakım' END, CASE o_orderkey % 7 WHEN 0 THEN 'gemi' END, o_orderpriority)", "q": "CASE o_custkey % 2 WHEN 0 THEN 'gemi' ELSE 'yol' END"},
    lambda t, q: F.round(10_000 * fusion.concept_score({"place": (0.6, ["yol", "köprü"]), "act": (0.4, ["bakım"])}, t, ["gemi"], q, F.lit(0.5))).cast("long"),
    "CAST(round(10000 * round(greatest(0.0, least(1.0, (CASE WHEN o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 THEN 0.6 ELSE 0.0 END + CASE WHEN o_orderkey % 5 = 0 THEN 0.4 ELSE 0.0 END - CASE WHEN o_orderkey % 7 = 0 AND q <> 'gemi' THEN 0.4 ELSE 0.0 END) * 0.925)), 4)) AS BIGINT)",
)
_composed(
    "passage_text_cases", "customer", "c_custkey", {"c": "CASE c_custkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE concat(' ', c_mktsegment, ' ') END", "t": "CASE c_custkey % 5 WHEN 0 THEN '' ELSE concat(c_name, ' ') END"},
    dense.passage_text, "CASE WHEN trim(coalesce(c, '')) <> '' AND trim(t) <> '' THEN trim(c) || chr(10) || chr(10) || trim(t) END",
)
_KEPT = "array_to_string(CASE WHEN list_has_any(c, a) THEN list_filter(c, lambda x: list_contains(a, x)) ELSE c END, '|')"
_LEFT, _RIGHT = _array("role", _text("turn")), _array("'user'", "CASE conv_id % 3 WHEN 0 THEN '2' ELSE 'x' END")
_composed("guarded_cases", "conversations", "conv_id, turn", {"c": _LEFT, "a": _RIGHT}, lambda c, a: _joined(graph.guarded("c", "a")), _KEPT)
_composed("kept_or_all_cases", "conversations", "conv_id, turn", {"c": _LEFT, "a": _RIGHT}, lambda c, a: _joined(quality.kept_or_all(c, a)), _KEPT)
_composed(
    "ordered_unique_cases", "orders", "o_orderkey", {"c": _array("o_orderstatus", "o_orderpriority", "CASE o_custkey % 2 WHEN 0 THEN o_orderstatus ELSE 'F' END", "o_orderpriority")},
    lambda c: _joined(dedup.ordered_unique(c)), f"array_to_string({_FIRSTS.format('c')}, '|')",
)
_composed(
    "approval_cases", "customer", "c_custkey", {"m": ("filter(array(CASE c_custkey % 2 WHEN 0 THEN 'date' END, CASE c_custkey % 3 WHEN 0 THEN 'number' END), x -> x IS NOT NULL)", "list_filter([CASE c_custkey % 2 WHEN 0 THEN 'date' END, CASE c_custkey % 3 WHEN 0 THEN 'number' END], lambda x: x IS NOT NULL)"), "k": _array("c_acctbal > 0", "c_nationkey <> 3"), "s": "CASE c_custkey % 5 WHEN 0 THEN NULL ELSE c_mktsegment END"},
    lifecycle.may_approve, "c_custkey % 2 <> 0 AND c_custkey % 3 <> 0 AND k[1] AND k[2] AND s IS NOT NULL",
)
_composed(
    "class_policy_cases", "customer", "c_custkey", {"c": "CASE c_custkey % 4 WHEN 0 THEN 'synthetic' WHEN 1 THEN 'public' WHEN 2 THEN 'personal' ELSE NULL END", "t": "CASE c_nationkey % 2 WHEN 0 THEN 'remote' ELSE 'local' END"},
    quality.allowed_by_class, "t = 'local' OR coalesce(c, '') IN ('synthetic', 'public')",
)
_composed(
    "secret_field_cases", "customer", "c_custkey", {"k": "CASE c_custkey % 4 WHEN 0 THEN 'API-Key' WHEN 1 THEN 'note' WHEN 2 THEN 'Parola' ELSE c_mktsegment END", "v": f"CASE c_custkey % 3 WHEN 0 THEN concat('mail a', {_text('c_custkey')}, '@b.org!') ELSE c_name END"},
    lambda k, v: F.element_at(quality.redacted_map(F.create_map(k, v)), k), "CASE WHEN k IN ('API-Key', 'Parola') THEN '[SECRET]' WHEN c_custkey % 3 = 0 THEN 'mail [EMAIL]!' ELSE v END",
)
_NINE = [f"(CAST(substr(n9, {i}, 1) AS INT))" for i in range(1, 10)]
_TENTH = f"((({' + '.join(_NINE[::2])}) * 7 - ({' + '.join(_NINE[1::2])})) % 10 + 10) % 10"
_CITIZEN_SQL = f"concat(n9, CAST({_TENTH} AS STRING), CAST(({' + '.join(_NINE)} + {_TENTH}) % 10 AS STRING))"
_composed(
    "redaction_cases", "orders", "o_orderkey",
    # Every second national number has right check digits; the others are off by one in the last.
    {"s": tuple(
        f"CASE o_orderkey % 4 WHEN 0 THEN concat('IBAN TR33 0006 1005 1978 6457 ', {_padded('o_orderkey % 10000', 4)}, ' 26') WHEN 1 THEN concat({_padded('500 + o_orderkey % 100', 4)}, ' ', {_padded('o_custkey % 1000', 3)}, ' 45 67 ara') WHEN 2 THEN concat('key sk-', repeat('a1B', 6), {_text('o_orderkey')}) ELSE concat('no ', {_CITIZEN_SQL.replace('n9', n9)}, CASE o_custkey % 2 WHEN 0 THEN '' ELSE '0' END, ' x') END"
        for n9 in [f"CAST(100000000 + o_orderkey * 7 AS STRING)"] * 2
    )},
    quality.redacted, "CASE o_orderkey % 4 WHEN 0 THEN 'IBAN [IBAN]' WHEN 1 THEN '[PHONE] ara' WHEN 2 THEN 'key [API_TOKEN]' ELSE CASE WHEN length(s) = 16 THEN 'no [TCKN] x' ELSE s END END",
)

#: A closed schema for what is said of an order, and texts with every kind of fault.
_ORDER = {
    "type": "object", "required": ["id", "status"],
    "properties": {"id": {"type": "integer", "minimum": 100, "maximum": 14000}, "status": {"type": "string", "enum": ["F", "O"]}, "note": {"type": ["string", "null"], "maxLength": 8}, "tags": {"type": "array", "maxItems": 2, "items": {"type": "string"}}, "price": {"type": "number"}, "paid": {"const": True}},
}
_ID = _text("o_orderkey")
_composed(
    "json_faults", "orders", "o_orderkey",
    {"s": f"""CASE o_orderkey % 16 WHEN 0 THEN concat('{{"id": ', {_ID}, '.5, "status": "F"}}') WHEN 1 THEN concat('{{"status": "', o_orderstatus, '"}}') WHEN 2 THEN concat('{{"id": ', {_ID}, ', "status": "O", "more": ', {_text('o_custkey')}, '}}')
    WHEN 3 THEN concat('{{"id": ', {_ID}, ', "id": 1, "status": "O"}}') WHEN 4 THEN concat('{{"id": NaN, "status": "', o_orderstatus, '"}}') WHEN 5 THEN concat('{{"id": ', {_ID}, ', "status": "F"}} ', o_orderpriority) WHEN 6 THEN o_orderpriority
    WHEN 7 THEN concat('{{"id": 500, "status": "F", "note": "', o_orderpriority, '"}}') WHEN 8 THEN concat('{{"id": 500, "status": "F", "tags": ["', o_orderstatus, '", ', CASE o_custkey % 3 WHEN 0 THEN '1' WHEN 1 THEN '"a"' ELSE '"a", "b"' END, ']}}')
    WHEN 9 THEN concat('{{"id": 500, "status": "F", "price": ', {_text('o_custkey')}, CASE o_custkey % 2 WHEN 0 THEN 'e2' ELSE '.25' END, ', "note": null}}') WHEN 10 THEN concat('[', {_ID}, ']') WHEN 11 THEN '' WHEN 12 THEN NULL WHEN 13 THEN concat('{{"id": 500, "status": "F", "paid": ', CASE o_custkey % 2 WHEN 0 THEN 'true' ELSE '1' END, '}}')
    ELSE concat('{{"status": "', o_orderstatus, '", "id": ', {_ID}, '}}') END"""},
    quality.strict_json(_ORDER),
    """CASE o_orderkey % 16 WHEN 0 THEN '$.id: not integer' WHEN 1 THEN '$.id: missing' WHEN 2 THEN '$.more: unknown' WHEN 3 THEN 'not JSON' WHEN 4 THEN 'not JSON' WHEN 5 THEN 'not JSON' WHEN 6 THEN 'not JSON'
    WHEN 7 THEN CASE WHEN length(split_part(s, '"', 10)) > 8 THEN '$.note: length' END WHEN 8 THEN CASE o_custkey_third WHEN 0 THEN '$.tags[]: not string' WHEN 2 THEN '$.tags: items' END WHEN 10 THEN '$: not object' WHEN 11 THEN 'not JSON' WHEN 12 THEN 'null'
    WHEN 13 THEN CASE WHEN contains(s, 'true') THEN NULL ELSE '$.paid: not allowed' END WHEN 9 THEN NULL
    ELSE CASE WHEN o_orderkey < 100 OR o_orderkey > 14000 THEN '$.id: out of bounds' WHEN s[13] NOT IN ('F', 'O') THEN '$.status: not allowed' END END""".replace("o_custkey_third", "CASE WHEN contains(s, ', 1]') THEN 0 WHEN contains(s, '\"b\"') THEN 2 ELSE 1 END"),
)


@R.add("""WITH RECURSIVE k AS (SELECT conv_id, turn AS id, [role, left(coalesce(text, ''), 1)] AS keys FROM conversations),
n AS (SELECT conv_id, id, unnest([1, 2]) AS nth, unnest(keys) AS key FROM k),
p AS (SELECT conv_id, id, nth, max(id) FILTER (WHERE true) OVER (PARTITION BY conv_id, key ORDER BY id RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM n),
parents AS (SELECT conv_id, id, arg_min(earlier, nth) AS parent FROM p WHERE earlier IS NOT NULL GROUP BY 1, 2),
walk AS (SELECT conv_id, id, id AS root FROM k UNION ALL SELECT walk.conv_id, walk.id, parents.parent FROM walk JOIN parents ON walk.conv_id = parents.conv_id AND walk.root = parents.id)
SELECT conv_id, string_agg(id || '>' || root, '|' ORDER BY id) AS result FROM (SELECT conv_id, id, min(root) AS root FROM walk GROUP BY 1, 2) GROUP BY 1""")
def equivalence_cases(spark: SparkSession, d: str) -> DataFrame:
    """Turns of a conversation with the same speaker or first letter, inside one row for each conversation."""
    turns = table(spark, d, "conversations")
    item = F.struct("turn", F.array("role", F.left(F.coalesce("text", F.lit("")), F.lit(1))).alias("keys"))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    owned = dedup.equivalence_owners(F.transform("items", lambda x: F.struct(x["turn"].cast("string").alias("id"), x["keys"].alias("keys"))))
    return rows.select("conv_id", _joined(F.transform(owned, lambda x: F.concat(x["id"], F.lit(">"), x["owner"]))).alias("result"))
