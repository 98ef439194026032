"""Functions and gates over inputs whose results are known."""

import uuid

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators import chunking, dedup, dense, fusion, graph, quality, rules
from quillon.plans import composed
from quillon.sources import readers, sinks
from quillon.streaming import lifecycle

CASES = {}


def _cases(name, function, kinds, rows):
    """The function, as text, of each row's inputs; the last entry of a row is its result."""
    CASES[name] = (function, kinds, rows)


_joined = lambda c: F.array_join(c, "|")
_cases("title_cases", X.turkish_title, "s string", [("ISPARTA il müdürlüğü", "Isparta İl Müdürlüğü"), ("ali", "Ali"), ("", ""), (None, None), ("ŞIRNAK İÇİ", "Şırnak İçi")])
_cases("date_cases", lambda s: X.valid_official_date(s), "s string", [("01.02.2024", "true"), ("1.2.2024", "false"), ("31.13.2024", "false"), ("3 Mart 2024", "true"), ("03 mart 2024", "true"), ("3 March 2024", "false"), ("", "false")])
_cases("number_cases", lambda s: F.concat_ws(",", X.valid_official_number(s).cast("string"), X.is_number_placeholder(s).cast("string")), "s string", [("E-67915368-903.07.02-4752", "true,false"), ("e-67915368-903-A1", "true,false"), ("E-12345678-XXX-XXX", "false,true"), ("12/5", "false,false"), ("K-12345678-1-2", "false,false")])
_cases("repaired_date_cases", X.repaired_date, "s string", [("O1.O2.2O24", "01.02.2024"), ("l5/l2/2023", "15/12/2023"), ("30.02.2024", None), ("29.02.2024", "29.02.2024"), ("no date", None)])
_cases("address_predicates", lambda s: F.concat_ws(",", X.is_web_address(s).cast("string"), X.is_relative_path(s).cast("string"), X.is_sha256(s).cast("string")), "s string", [("https://a.org/x", "true,true,false"), ("http://", "false,true,false"), ("/etc/x", "false,false,false"), ("data/../x", "false,false,false"), ("data/x.pdf", "false,true,false"), ("C:\\x", "false,false,false"), ("a" * 64, "false,true,true")])
_cases("coercion_cases", lambda s: F.concat_ws(",", F.coalesce(X.yes_or_no(s).cast("string"), F.lit("null")), F.coalesce(X.none_if_blank(s), F.lit("null"))), "s string", [("Evet", "true,Evet"), (" no ", "false,no"), ("0", "false,0"), ("", "null,null"), ("maybe", "null,maybe")])
_cases("article_cases", lambda s: F.concat_ws(",", F.coalesce(X.article_of(s), F.lit("null")), F.coalesce(X.paragraph_of(s).cast("string"), F.lit("null"))), "s string", [("MADDE 5 - Amaç", "MADDE 5,null"), ("Geçici  Madde 2", "Geçici Madde 2,null"), ("K_M5_F3", "null,3"), ("Amaç", "null,null")])
_cases("page_range_cases", lambda a, b: F.concat_ws("-", X.page_range(a, b)["page"].cast("string"), X.page_range(a, b)["page_end"].cast("string")), "a int, b int", [(1, 3, "1-3"), (4, 2, "2-4"), (5, 5, "5-5")])
_cases("unwrapped_cases", lambda s: F.array_join(X.unwrapped(F.split(s, "\n")), "|"), "s string", [("Baş-\nvuran: A", "Başvuran: A"), ("ara-\nba", "ara-|ba"), ("gönde-\nren\nson", "gönderen|son"), ("", "")])
_cases("decoded_cases", X.decoded, "b binary", [("şöğ".encode(), "şöğ"), ("İşÇ€".encode("cp1254"), "İşÇ€"), (b"\xef\xbb\xbfx", "x"), (b"", "")])
_cases("masked_cases", X.masked, "s string", [("abcd", "****"), ("abcde", "ab***de"), ("", ""), ("a", "*"), (None, None)])
_cases("label_form_cases", lambda s: _joined(X.label_forms(s)), "s string", [("Gönderen", "gönderen|gonderen"), ("• K0NU:", "k0nu|konu"), ("Tarih", "tarih"), ("Ad!", "ad|adi")])
_cases("query_variant_cases", lambda s: _joined(X.query_variants(s, [(["yol", "karayolu"], "karayolu altyapısı"), (["gemi"], "denizcilik")])), "s string", [("Yol bakımı", "Yol bakımı|Yol bakımı karayolu altyapısı"), ("hava", "hava"), ("gemi yol", "gemi yol|gemi yol karayolu altyapısı denizcilik")])
_cases("point_id_cases", X.point_id, "s string", [("6ba7b811-9dad-11d1-80b4-00c04fd430c8", "6ba7b811-9dad-11d1-80b4-00c04fd430c8"), ("6BA7B8119DAD11D180B400C04FD430C8", "6ba7b811-9dad-11d1-80b4-00c04fd430c8"), ("http://www.python.org/", "c2a8cbf8-d0f1-5ef4-9740-c3faec8ab1a0"), (None, None)])
_cases("page_at_cases", lambda a, n: chunking.page_at(a, n), "a array<int>, n int", [([0, 10, 20], 0, "1"), ([0, 10, 20], 10, "2"), ([0, 10, 20], 19, "2"), ([0, 10, 20], 99, "3"), ([5, 9], 1, "1")])
_cases("marked_page_cases", lambda s: F.array_join(F.transform(chunking.marked_pages(s), lambda p: F.concat(p["page"].cast("string"), F.lit(":"), p["text"])), "|"), "s string", [("== PAGE 1 ==\nab\n== PAGE 2 ==\ncd\n", "1:ab|2:cd"), ("== SAYFA 1 ==\nx", "1:x"), ("== PAGE 2 ==\nx", None), ("no marks", None)])
_cases("repaired_article_cases", chunking.repaired_articles, "s string", [("1- MADDE Amaç", "MADDE 1- Amaç"), ("12 – MADDE x", "MADDE 12- x"), ("MADDE 3- y", "MADDE 3- y"), ("a\n4-MADDE z", "a\nMADDE 4- z")])
_cases("article_sequence_cases", lambda a: chunking.articles_complete(a, ["1", "2", "3"]), "a array<string>", [(["1", "2", "3"], "true"), (["1", "1", "2", "3"], "true"), (["1", "3"], "false"), (["2", "1", "3"], "false")])
_cases("signature_cases", lambda p, b: readers.signature_fits(p, b), "p string, b binary", [("a.pdf", b"%PDF-1.7", "true"), ("a.pdf", b"PK\x03\x04", "false"), ("a.PNG", b"\x89PNG\r\n\x1a\n", "true"), ("a.jpg", b"\xff\xd8\xff\xe0", "true"), ("a.txt", b"anything", "true")])
_cases("unit_box_cases", lambda x0, y0, x1, y1: F.concat_ws(",", *[quality.unit_box(x0, y0, x1, y1, F.lit(200.0), F.lit(100.0))[k].cast("string") for k in ("x0", "y0", "x1", "y1")]), "x0 double, y0 double, x1 double, y1 double", [(0.0, 0.0, 200.0, 100.0, "0.0,0.0,1.0,1.0"), (-5.0, 25.0, 50.0, 400.0, "0.0,0.25,0.25,1.0")])
_cases("process_id_cases", sinks.process_id_fits, "s string", [("EVR-20240824-0A1B2C3D", "true"), ("EVR-2024-0A1B2C3D", "false"), ("EVR-20240824-0a1b2c3d", "false"), ("../EVR-20240824-0A1B2C3D", "false")])
_cases("rendered_cases", lambda a, b: sinks.rendered("Konu: {{a}}\n{{b}} - {{a}}", {"a": a, "b": b}), "a string, b string", [("x", "y", "Konu: x\ny - x"), (None, "{{a}}", "Konu: [DOLDURULACAK]\n{{a}} - [DOLDURULACAK]")])
_cases("value_fault_cases", lambda f, v: F.coalesce(rules.value_fault(f, v), F.lit("fine")), "f string, v string", [("subject", "x", "fine"), ("subject", " ... ", "placeholder"), ("subject", "[DOLDURULACAK]", "placeholder"), ("subject", "y" * 301, "too_long"), ("sender", "a b c d e f g h i", "too_many_words"), ("date", "1.1", "not_a_date"), ("date", "01.02.2024", "fine")])
_cases("draft_cases", lambda s, m: F.concat_ws("|", rules.draft(s, m, F.lit("Arz ederim."), F.create_map(F.lit("date"), F.lit("x")), F.array(F.lit("date"), F.lit("number")))["heading"], _joined(rules.draft(s, m, F.lit("Arz ederim."), F.create_map(F.lit("date"), F.lit("x")), F.array(F.lit("date"), F.lit("number")))["missing"])), "s string, m string", [("Yol", "özet", "Konu: Yol|number"), (None, "", "Konu: [DOLDURULACAK]|number")])
_cases("trust_cases", lambda k, a, g: fusion.source_trust(k, a, g), "k string, a boolean, g string", [("synthetic", None, "", "synthetic"), ("official", True, "a" * 64, "official"), ("official", False, "a" * 64, "untrusted"), ("official", True, "a", "untrusted"), ("snapshot", None, None, "snapshot"), ("other", True, "a" * 64, "untrusted")])
_cases("evidence_text_cases", lambda s, f, q: F.concat_ws(":", fusion.evidence_text(s, f, q)["basis"], fusion.evidence_text(s, f, q)["text"]), "s string, f string, q string", [("a", "b", "c", "submitted:a"), (" ", "b", "c", "fields:b"), (None, "", "c", "query:c")])
_cases("visible_term_cases", lambda m, e, v: F.concat_ws(";", *[_joined(x) for x in fusion.visible_and_expanded(m, e, v)]), "m array<string>, e array<string>, v array<string>", [(["a", "b", "c"], ["a", "b"], ["b"], "b;c"), (["a"], [], ["a"], ";a")])
_cases("concept_score_cases", lambda t, q: fusion.concept_score({"place": (0.6, ["yol", "köprü"]), "act": (0.4, ["bakım"])}, t, ["gemi"], q, F.lit(1.0)), "t string, q string", [("yol bakım", "yol", "1.0"), ("köprü", "yol", "0.6"), ("yol gemi", "yol", "0.2"), ("yol gemi", "gemi", "0.6"), ("hava", "x", "0.0")])
_cases("passage_text_cases", lambda c, t: dense.passage_text(c, t), "c string, t string", [(" a ", "b ", "a\n\nb"), ("", "b", None), ("a", " ", None), (None, "b", None)])
_cases("guarded_cases", lambda c, a: _joined(graph.guarded("c", "a")), "c array<string>, a array<string>", [(["x", "y"], ["y"], "y"), (["x", "y"], ["z"], "x|y"), (["x"], [], "x")])
_cases("kept_or_all_cases", lambda c, a: _joined(quality.kept_or_all(c, a)), "c array<string>, a array<string>", [(["x", "y"], ["y"], "y"), (["x", "y"], ["z"], "x|y")])
_cases("ordered_unique_cases", lambda c: _joined(dedup.ordered_unique(c)), "c array<string>", [(["b", "a", "b"], "b|a"), ([], "")])
_cases("approval_cases", lambda m, k, s: lifecycle.may_approve(m, k, s), "m array<string>, k array<boolean>, s string", [([], [True, True], "x", "true"), (["f"], [True], "x", "false"), ([], [True, False], "x", "false"), ([], [], None, "false")])
_cases("class_policy_cases", lambda c, t: quality.allowed_by_class(c, t), "c string, t string", [("synthetic", "remote", "true"), ("public", "remote", "true"), ("personal", "remote", "false"), ("personal", "local", "true"), (None, "remote", "false")])
_cases("secret_field_cases", lambda k, v: F.element_at(quality.redacted_map(F.create_map(k, v)), k), "k string, v string", [("API-Key", "x", "[SECRET]"), ("note", "mail a@b.org", "mail [EMAIL]"), ("Parola", "p", "[SECRET]"), ("name", "Ali", "Ali")])
_cases("redaction_cases", lambda s: quality.redacted(s), "s string", [("IBAN TR33 0006 1005 1978 6457 8413 26", "IBAN [IBAN]"), ("0532 123 45 67 ara", "[PHONE] ara"), ("no 10000000146 x", "no [TCKN] x"), ("no 10000000145 x", "no 10000000145 x"), ("key sk-abcdefghijklmnop1234", "key [API_TOKEN]")])
_cases("equivalence_cases", lambda a: F.array_join(F.transform(dedup.equivalence_owners(a), lambda x: F.concat(x["id"], F.lit(">"), x["owner"])), "|"), "a array<struct<id:string,keys:array<string>>>", [([("1", ["a", "b"]), ("2", ["c"]), ("3", ["b", "c"]), ("4", ["c"])], "1>1|2>2|3>1|4>1"), ([], "")])


@pytest.mark.parametrize("name", sorted(CASES))
def test_known_results(spark, name):
    function, kinds, rows = CASES[name]
    inputs = spark.createDataFrame([(i, *r[:-1]) for i, r in enumerate(rows)], f"case int, {kinds}")
    out = inputs.select("case", function(*[F.col(c.split()[0]) for c in kinds.split(", ")]).cast("string").alias("result"))
    assert {r["case"]: r["result"] for r in out.collect()} == {i: r[-1] for i, r in enumerate(rows)}


def test_point_ids_of_customers_take_every_branch(spark):
    """ids in both spellings, texts that are hashed, and null."""
    rows = composed.R.queries["point_id_cases"](spark, "/root/testdata/sf0.001").collect()
    by = {r["c_custkey"]: r["result"] for r in rows}
    assert {k % 4 for k, v in by.items() if v is None} == {3}
    assert all(v == str(uuid.uuid5(uuid.NAMESPACE_URL, f"http://www.python.org/Customer#{k:09d}")) for k, v in by.items() if k % 4 == 2)
    assert by[4] == "6ba7b811-9dad-11d1-80b4-000000000004" and by[1] == "6ba7b811-9dad-11d1-80b4-000000000001"
