"""Queries of rule tables: classification, domains, routing, requirements, extraction, letters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import metrics, phrases, quality, rules

from .base import Registry, fold_sql, table, tokens_sql

R = Registry()

KEYWORDS = [("legal", "rights reserved", None), ("legal", "reserved", None), ("secret", "password", 2.5), ("secret", "token", None), ("abuse", "idiot", None), ("abuse", "loser", None), ("abuse", "pathetic", None), ("prose", "the", 0.25), ("prose", "of", 0.25)]
DOMAINS = [("road", "thing", 2.0), ("road", "tion", 1.0), ("sea", "ment", 2.0), ("sea", "eau", 1.0), ("air", "heit", 3.0), ("air", "keit", 1.0), ("rail", "ción", 2.5)]
FIRST = [(1, "password", "secret"), (2, "reserved", "legal"), (3, "ción", "es"), (4, "ment", "fr"), (5, "keit", "de")]


def _values(rows: list[tuple]) -> str:
    def one(x) -> str:
        return "CAST(NULL AS DOUBLE)" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


def _pattern(keyword: str) -> str:
    return " " + " ".join(t + ("[^ ]*" if len(t) >= 5 else "") for t in keyword.split()) + " "


_CLASSIFIED = f"""
k(label, keyword, pattern, w) AS (VALUES {_values([(la, k, _pattern(k), w if w is not None else 1.5 if ' ' in k else 1.0) for la, k, w in KEYWORDS])}),
t AS (SELECT doc_id AS doc, ' ' || array_to_string({tokens_sql('text')}, ' ') || ' ' AS line FROM documents),
s AS (SELECT doc, label, sum(w) AS score, string_agg(keyword, ',' ORDER BY keyword) AS matched FROM t JOIN k ON regexp_matches(line, pattern) GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS second FROM s WINDOW w AS (PARTITION BY doc ORDER BY score DESC, label)),
c AS (SELECT doc, label, score, matched, CASE WHEN second IS NOT NULL AND (score - second < 0.75 OR second >= 0.5 * score) THEN least(0.55 + 0.09 * score, 0.97, 0.58) ELSE least(0.55 + 0.09 * score, 0.97) END AS conf FROM r WHERE rn = 1)"""


def _classified(spark: SparkSession, d: str) -> DataFrame:
    return rules.classify(table(spark, d, "documents", "doc_id", "text"), spark.createDataFrame(KEYWORDS, "label string, keyword string, weight double"))


@R.add(f"WITH {_CLASSIFIED} SELECT t.doc, coalesce(label, 'general') AS label, CAST(coalesce(score, 0) AS DOUBLE) AS score, CAST(round(coalesce(conf, 0.35), 2) AS DOUBLE) AS confidence, coalesce(matched, '') AS matched FROM t LEFT JOIN c USING (doc)")
def keyword_classify(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d).withColumn("matched", F.array_join("matched", ","))


_DOMAIN = f"k(domain, phrase, w) AS (VALUES {_values(DOMAINS)}), s AS (SELECT doc_id AS id, domain, sum(w) AS score FROM documents JOIN k ON contains(lower(text), phrase) GROUP BY ALL), r AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS second FROM s WINDOW w AS (PARTITION BY id ORDER BY score DESC, domain))"


@R.add(f"WITH {_DOMAIN} SELECT id, domain, CAST(score AS DOUBLE) AS score, CAST(second AS DOUBLE) AS second, coalesce(second >= 3 AND second >= 0.55 * score, false) AS ambiguous, CASE WHEN score <= 0 THEN 'none' WHEN coalesce(second >= 2.0 AND second >= 0.8 * score, false) THEN 'unclear' ELSE 'resolved' END AS status FROM r WHERE rn = 1")
def domain_classify(spark: SparkSession, d: str) -> DataFrame:
    scores = rules.domain_scores(table(spark, d, "documents"), F.lower("text"), spark.createDataFrame(DOMAINS, "domain string, phrase string, weight double"), "doc_id")
    return rules.resolved_domain(scores, hint_weight=2.0)


@R.add(f"WITH k(place, phrase, label) AS (VALUES {_values(FIRST)}), m AS (SELECT doc_id AS id, arg_min(label, place) AS label FROM documents JOIN k ON contains(lower(text), phrase) GROUP BY doc_id) SELECT doc_id AS id, coalesce(label, 'other') AS label FROM documents LEFT JOIN m ON m.id = doc_id")
def first_match_label(spark: SparkSession, d: str) -> DataFrame:
    return rules.first_match(table(spark, d, "documents"), F.lower("text"), spark.createDataFrame(FIRST, "place int, phrase string, label string"), "doc_id", "other")


@R.add("""WITH p AS (SELECT DISTINCT array_to_string(regexp_extract_all(text, '[^ ]+')[1:4], ' ') AS phrase FROM documents WHERE len(regexp_extract_all(text, '[^ ]+')) >= 4)
SELECT phrase, count(*) AS documents FROM p JOIN documents ON contains(text, phrase) GROUP BY phrase""")
def opening_phrases(spark: SparkSession, d: str) -> DataFrame:
    """The first four words of every document, and how many documents hold them anywhere."""
    docs = table(spark, d, "documents", "doc_id", "text")
    words = F.regexp_extract_all("text", F.lit("[^ ]+"), F.lit(0))
    openings = docs.filter(F.size(words) >= 4).select(F.array_join(F.slice(words, 1, 4), " ").alias("phrase"))
    return phrases.held(docs, openings).groupBy("phrase").agg(F.count(F.lit(1)).alias("documents"))


@R.add("SELECT conv_id, array_to_string(list_filter(['user', 'assistant', 'system'], lambda x: NOT list_contains(list(DISTINCT role), x)), ',') AS missing FROM conversations GROUP BY conv_id")
def missing_fields(spark: SparkSession, d: str) -> DataFrame:
    present = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("p"))
    required = F.array(F.lit("user"), F.lit("assistant"), F.lit("system"))
    return present.select("conv_id", F.array_join(rules.missing_fields(required, F.col("p")), ",").alias("missing"))


UNITS = [("u1", ["the"], ["of and reha"], ["eau"]), ("u2", ["ción"], ["de la que"], []), ("u3", ["keit"], ["der die und"], ["heit"]), ("u4", ["password"], ["token secret"], [])]


def _list(xs: list[str]) -> str:
    return "CAST([" + ", ".join(f"'{x}'" for x in xs) + "] AS VARCHAR[])"


@R.add(f"""WITH u(unit, kw, rt, pl) AS (VALUES {', '.join(f"('{u}', {_list(k)}, {_list(' '.join(r).split())}, {_list(p)})" for u, k, r, p in UNITS)}),
q AS (SELECT doc_id AS doc, {fold_sql('text')} AS q, list_distinct({tokens_sql('text')}) AS qt FROM documents),
s AS (SELECT doc, unit, CAST(4 * len(list_filter(kw, lambda x: contains(q, x))) + len(list_filter(rt, lambda x: list_contains(qt, x))) + 6 * len(list_filter(pl, lambda x: contains(q, x))) AS DOUBLE) AS score FROM q, u),
t AS (SELECT *, max(score) OVER (PARTITION BY doc) AS top FROM s),
r AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS second FROM t WINDOW w AS (PARTITION BY doc ORDER BY CASE WHEN top < 4 AND unit = 'u2' THEN 0 ELSE 1 END, score DESC, unit))
SELECT doc, unit, score, CAST(rank AS INTEGER) AS rank, round(greatest(score - coalesce(second, 0), 0) / greatest(score, 1), 2) AS margin, (score < 4 OR (coalesce(second, 0) > 0 AND round(greatest(score - coalesce(second, 0), 0) / greatest(score, 1), 2) < 0.20)) AS needs_review FROM r""")
def route_units(spark: SparkSession, d: str) -> DataFrame:
    units = spark.createDataFrame(UNITS, "unit string, keywords array<string>, responsibilities array<string>, places array<string>")
    return rules.route(table(spark, d, "documents"), units, F.col("text"), fallback="u2")


RULES = [("r1", [], ["user"], [], []), ("r2", ["odd"], [], [], ["the"]), ("r3", [], ["system"], ["de la"], []), ("r4", ["even"], ["assistant"], ["of"], ["zz"])]
SOURCES = [("s1", "first", "r1"), ("s1", "first", "r2"), ("s2", "second", "r3")]

_TYPES = "[role, CASE WHEN conv_id % 2 = 0 THEN 'even' ELSE 'odd' END]"
_RULE_SQL = f"""WITH k(rule, cats, typs, subs, excl) AS (VALUES {', '.join(f"('{r}', {_list(c)}, {_list(t)}, {_list(s)}, {_list(e)})" for r, c, t, s, e in RULES)}),
d AS (SELECT conv_id, turn, {_TYPES} AS types, lower(text) AS e FROM conversations),
m AS (SELECT conv_id, turn, rule, len(list_filter(subs, lambda s: contains(e, s))) > 0 AS bysub, cats, typs, subs, excl, types, e FROM d, k)
SELECT conv_id, turn, rule FROM m WHERE (len(cats) = 0 OR list_has_any(cats, types)) AND (len(subs) = 0 OR bysub) AND (len(typs) = 0 OR list_has_any(typs, types) OR bysub) AND len(list_filter(excl, lambda x: contains(e, x))) = 0"""


@R.add(_RULE_SQL)
def select_rules(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("doc"), F.array("role", F.when(F.col("conv_id") % 2 == 0, "even").otherwise("odd")).alias("types"), F.lower("text").alias("evidence"))
    listed = spark.createDataFrame(RULES, "rule string, categories array<string>, types_wanted array<string>, subtypes array<string>, excluded array<string>")
    return rules.selected_rules(docs, listed).select("doc.conv_id", "doc.turn", "rule")


@R.add(f"WITH x AS ({_RULE_SQL}), s(source, title, rule) AS (VALUES {_values(SOURCES)}) SELECT source, title, count(*) AS n FROM x JOIN s USING (rule) GROUP BY ALL")
def rules_join_sources(spark: SparkSession, d: str) -> DataFrame:
    chosen = select_rules(spark, d)
    links = spark.createDataFrame([(s, r) for s, _, r in SOURCES], "source string, rule string")
    titles = spark.createDataFrame(sorted({(s, t) for s, t, _ in SOURCES}), "source string, title string")
    return rules.with_sources(chosen.join(links, "rule"), titles).groupBy("source", "title").agg(F.count(F.lit(1)).alias("n"))


@R.add("""WITH d AS (SELECT doc_id, text, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: s <> '') AS s FROM documents)
SELECT doc_id, nullif(regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+', 0), '') AS email, nullif(regexp_extract(text, '\\+[0-9][ ().0-9-]{7,}[0-9]', 0), '') AS phone, array_to_string(s[1:2], ' ') AS summary FROM d""")
def first_contacts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").withColumn("c", rules.first_contacts(F.col("text"))).select("doc_id", "c.email", "c.phone", "c.summary")


@R.add("SELECT doc_id, CASE lang WHEN 'en' THEN 'plain' WHEN 'de' THEN 'formal' ELSE 'standard' END AS template FROM documents")
def template_selection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", rules.template_for(F.col("lang"), {"en": "plain", "de": "formal"}, "standard").alias("template"))


@R.add(f"WITH {_CLASSIFIED} SELECT coalesce(d.lang, '?') AS expected, coalesce(c.label, 'general') AS actual, count(*) AS n FROM documents d LEFT JOIN c ON c.doc = d.doc_id GROUP BY ALL")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    both = _classified(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.coalesce("lang", F.lit("?")).alias("lang")), "doc")
    return metrics.confusion(both, "lang", "label")


_SETS = f"""WITH {_CLASSIFIED}, x AS (SELECT l.doc_id, CASE WHEN coalesce(c.label, '') = 'abuse' THEN ['toxic'] ELSE CAST([] AS VARCHAR[]) END AS p, CASE WHEN toxic = 1 THEN ['toxic'] ELSE CAST([] AS VARCHAR[]) END AS e, source FROM labels l JOIN documents d ON d.doc_id = l.doc_id LEFT JOIN c ON c.doc = l.doc_id)"""


def _sets(spark: SparkSession, d: str) -> DataFrame:
    flag = lambda c: F.when(c, F.array(F.lit("toxic"))).otherwise(F.array().cast("array<string>"))
    both = table(spark, d, "labels").join(table(spark, d, "documents", "doc_id", "source"), "doc_id").join(_classified(spark, d), F.col("doc_id") == F.col("doc"))
    return both.select("doc_id", flag(F.col("label") == "abuse").alias("p"), flag(F.col("toxic") == 1).alias("e"), "source")


@R.add(f"{_SETS}, z AS (SELECT CAST(sum(len(list_intersect(p, e))) AS BIGINT) AS tp, CAST(sum(len(p) - len(list_intersect(p, e))) AS BIGINT) AS fp, CAST(sum(len(e) - len(list_intersect(p, e))) AS BIGINT) AS fn FROM x) SELECT tp, fp, fn, coalesce(round(tp / nullif(tp + fp, 0), 4), 0) AS precision, coalesce(round(tp / nullif(tp + fn, 0), 4), 0) AS recall, coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0), 4), 0) AS f1 FROM z")
def prf1(spark: SparkSession, d: str) -> DataFrame:
    return metrics.precision_recall(_sets(spark, d), "p", "e")


@R.add(f"{_SETS} SELECT slice, round(count(*) FILTER (WHERE p = e) / count(*), 4) AS accuracy, count(*) FILTER (WHERE p = e) AS accuracy_num, count(*) AS accuracy_den FROM (SELECT p, e, unnest(['all', source]) AS slice FROM x) GROUP BY slice")
def slice_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = _sets(spark, d).select(F.array(F.lit("all"), "source").alias("tags"), metrics.same_set(F.col("p"), F.col("e")).alias("hit"))
    return metrics.sliced(rows, "tags", "hit")


@R.add("SELECT o_orderpriority, quantile_disc(o_totalprice, 0.5) AS p50, quantile_disc(o_totalprice, 0.95) AS p95, max(o_totalprice) AS largest, count(*) AS n FROM orders GROUP BY 1")
def percentiles_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    return metrics.nearest_rank(table(spark, d, "orders"), "o_totalprice", ["o_orderpriority"])


@R.add("WITH a AS (SELECT o_orderpriority AS metric, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 4) AS value FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1), b AS (SELECT o_orderpriority AS metric, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 4) AS value FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1) SELECT metric, a.value AS before, b.value AS after, round(b.value - a.value, 4) AS delta FROM a JOIN b USING (metric)")
def metric_delta(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    share = F.round(F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)), 4).alias("value")
    run = lambda c: orders.filter(c).groupBy(F.col("o_orderpriority").alias("metric")).agg(share)
    at = F.to_timestamp(F.lit("1998-01-01"))
    return metrics.metric_delta(run(F.col("o_orderdate") < at), run(F.col("o_orderdate") >= at))


@R.add(f"WITH {_CLASSIFIED} SELECT d.lang, round(count(*) FILTER (WHERE c.label = 'prose') / count(*), 4) AS pass_rate, count(*) FILTER (WHERE c.label = 'prose') AS pass_rate_num, count(*) AS pass_rate_den FROM documents d LEFT JOIN c ON c.doc = d.doc_id GROUP BY d.lang")
def pass_by_category(spark: SparkSession, d: str) -> DataFrame:
    return metrics.pass_by_category(_prose(spark, d), "lang", "ok")


@R.add(f"WITH {_CLASSIFIED} SELECT d.lang, d.doc_id AS doc FROM documents d LEFT JOIN c ON c.doc = d.doc_id WHERE coalesce(c.label, '') <> 'prose'")
def failed_by_category(spark: SparkSession, d: str) -> DataFrame:
    return metrics.failures(_prose(spark, d), "lang", "ok", "doc")


def _prose(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "lang"), "doc").withColumn("ok", F.col("label") == "prose")


PRIVATE = {"EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "PHONE": r"\+?1? ?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", "SECRET": r"AKIA[A-Z0-9]{16}", "ACCOUNT": r"TR[0-9]{24}"}


@R.add("SELECT doc_id, " + ", ".join(f"CAST(len(regexp_extract_all(text, '{p}')) AS BIGINT) AS n_{k.lower()}" for k, p in PRIVATE.items()) + " FROM documents")
def pii_findings(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "documents", "doc_id", "text").withColumn("f", quality.private_findings(F.col("text"), PRIVATE))
    return found.select("doc_id", *[F.size(F.filter("f", _is(k))).cast("long").alias(f"n_{k.lower()}") for k in PRIVATE])


def _is(kind: str):
    return lambda x: x["kind"] == kind


_RED = "text"
for _k, _p in PRIVATE.items():
    _RED = f"regexp_replace({_RED}, '{_p}', '[{_k}]', 'g')"


@R.add(f"SELECT doc_id, sha256({_RED}) AS redacted_sha256 FROM documents")
def pii_redacted(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.sha2(quality.redacted(F.col("text"), PRIVATE), 256).alias("redacted_sha256"))


_K = "o_orderkey"
#: A letter's faults by the order's key: (condition, error or warning); letters without any pass.
_ERRORS = [("template", 17, 0), ("institution", 19, 1), ("subject", 23, 2), ("date", 29, 3), ("number", 31, 4), ("closing", 37, 5), ("ending", 37, 5), ("ending", 41, 6), ("attachments", 43, 7), ("metadata", 47, 8), ("rules_version", 53, 9), ("unverified_reference", 59, 10), ("signer", 61, 11)]
_WARNED = [("date", 7, 1), ("number", 5, 2), ("no_reference", 3, 0), ("signature", 2, 1)]
_ORDER = ["template", "template_differs", "institution", "subject", "recipient", "date", "number", "body", "relation", "closing", "ending", "attachments", "distribution", "interest", "contact", "initials", "metadata", "rules_version", "unverified_reference", "signer"]


def _letter_sql() -> str:
    when = lambda m, r: f"({_K} % {m} = {r})"
    cases = {name: " OR ".join(when(m, r) for n, m, r in _ERRORS if n == name) or "false" for name in _ORDER}
    # A letter of another template also differs from the chosen one; what is not given, not cited or not there cannot be malformed.
    cases["template_differs"] = cases["template"]
    cases["date"] = f"({cases['date']}) AND NOT {when(7, 1)}"
    cases["number"] = f"({cases['number']}) AND NOT {when(5, 2)}"
    cases["rules_version"] = f"({cases['rules_version']}) AND NOT {when(47, 8)}"
    cases["unverified_reference"] = f"({cases['unverified_reference']}) AND NOT {when(3, 0)}"
    cases["ending"] = f"({cases['ending']}) OR {when(37, 5)}"
    lists = ["[" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in cs) + "]" for cs in (cases.items(), [(n, when(m, r)) for n, m, r in _WARNED])]
    kept = [f"list_filter({x}, lambda y: y IS NOT NULL)" for x in lists]
    return f"WITH c AS (SELECT o_orderkey, {kept[0]} AS e, {kept[1]} AS w FROM orders) SELECT o_orderkey, array_to_string(e, ',') AS errors, array_to_string(w, ',') AS warnings, round(greatest(0, 1 - len(e) / 15 - 0.04 * len(w)), 2) AS score, len(e) = 0 AS passed FROM c"


@R.add(_letter_sql())
def letter_compliance(spark: SparkSession, d: str) -> DataFrame:
    """Letters with one fault or several by their order's number; the SQL lists the faults by number."""
    at = lambda m, r: F.col(_K) % m == r
    texts = lambda *xs: F.array(*[F.lit(x) for x in xs])
    closing = F.when(at(37, 5), "Rica ederim.").otherwise("Arz ederim.")
    metadata = F.map_from_arrays(texts(*rules.LETTER_METADATA), F.array(F.lit("1"), F.lit("public"), F.lit("u1"), F.when(at(53, 9), "other").otherwise("v1")))
    short = F.map_from_arrays(texts("data_class"), texts("public"))
    reference = F.struct((~at(59, 10)).alias("verified"), F.lit(False).alias("snapshot"), F.lit(False).alias("relied_on"), F.lit("").alias("notice"))
    letter = {
        "template": F.when(at(17, 0), "invented").otherwise("ust_yazi_v1"), "selected_template": F.lit("ust_yazi_v1"), "institution": F.when(at(19, 1), "").otherwise("Kurum"), "subject": F.when(~at(23, 2), F.col("o_orderpriority")),
        "recipient": F.col("o_orderstatus"), "date": F.when(at(7, 1), None).when(at(29, 3), "1.13.2024").otherwise(F.date_format("o_orderdate", "dd.MM.yyyy")),
        "number": F.when(at(5, 2), "E-12345678-XXX-XXX").when(at(31, 4), "12").otherwise(F.concat(F.lit("E-"), F.lpad(F.col("o_custkey").cast("string"), 8, "0"), F.lit("-105.02-"), F.col(_K).cast("string"))),
        "relation": F.lit("superior"), "closing": closing, "paragraphs": F.when(at(41, 6) | at(37, 5), F.array(F.lit("Gövde."), F.lit("Arz ederim."), F.lit("Son."))).otherwise(F.array(F.lit("Gövde."), closing)),
        "attachments": F.when(at(43, 7), texts("Plan", " plan ")).otherwise(texts("Plan")), **{n: texts("x") for n in rules.LETTER_LISTS if n != "attachments"}, "metadata": F.when(at(47, 8), short).otherwise(metadata),
        "references": F.when(at(3, 0), F.slice(F.array(reference), 1, 0)).otherwise(F.array(reference)), "signer": F.when(~at(61, 11), "A B"), "signer_title": F.lit("Müdür"), "signature": F.when(~at(2, 1), "imza"), "missing_fields": F.array().cast("array<string>"),
    }
    return table(spark, d, "orders").select("o_orderkey", rules.compliance(letter, "v1").alias("c")).select("o_orderkey", F.array_join("c.errors", ",").alias("errors"), F.array_join("c.warnings", ",").alias("warnings"), "c.score", "c.passed")
