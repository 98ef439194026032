"""Queries of domains and types by phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import domains

from .base import Registry, fold_sql, quoted, table

R = Registry()

RULES = {"road": [("the", 3), ("tion", 4), ("ing", 2)], "sea": [("eau", 4), ("ment", 3), ("la", 1)], "air": [("heit", 5), ("und", 2)], "rail": [("ción", 5), ("que", 2)]}
SUBDOMAINS = {"road": [("works", ["password"]), ("traffic", ["ity", "ness"])], "rail": [("lines", ["dad"])]}
OUTSIDE, ACTIVE, CROSSING = ["sea", "air"], ["road", "rail"], ["tion"]
TYPES = [("objection", ["token"]), ("permit", ["ción", "ment"]), ("request", ["heit"])]
PROFILES = {"en": "request", "de": "complaint"}
HINTS = {"en": ("road", 4), "fr": ("sea", 4), "de": ("air", 6)}


def _rules(name: str = "k") -> str:
    return f"{name}(place, label, phrase, w) AS (VALUES " + ", ".join(f"({i}, '{d}', '{p}', {float(w)})" for i, (d, p, w) in enumerate((d, p, w) for d, xs in RULES.items() for p, w in xs)) + ")"


def _held(phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains(f, '{p}')" for p in phrases) + ")"


_T = f"t AS (SELECT doc_id, lang, source, {fold_sql('text')} AS f FROM documents)"


@R.add(f"SELECT doc_id, CASE {' '.join(f"WHEN {_held(p)} THEN '{t}'" for t, p in TYPES)} {' '.join(f"WHEN lang = '{k}' THEN '{v}'" for k, v in PROFILES.items())} ELSE 'petition' END AS type FROM (SELECT doc_id, lang, {fold_sql('text')} AS f FROM documents)")
def general_types(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "lang", "text")
    return domains.general_type(docs, F.col("text"), F.col("lang"), TYPES, PROFILES, "petition").select("doc_id", "type")


_SUB = "CASE " + " ".join(f"WHEN label = '{d}' THEN CASE {' '.join(f"WHEN {_held(p)} THEN '{s}'" for s, p in xs)} ELSE 'general' END" for d, xs in SUBDOMAINS.items()) + " ELSE label END"


# The decimal digits of a double are rounded half up, as Spark does.
@R.add(f"""WITH {_rules()}, {_T}, h AS (SELECT doc_id, label, phrase, w FROM t JOIN k ON contains(f, phrase)), s AS (SELECT doc_id, label, sum(w) AS score, string_agg(phrase, ',' ORDER BY w DESC, phrase) AS reasons FROM h GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER v AS n, coalesce(lead(score) OVER v, 0) AS second FROM s WINDOW v AS (PARTITION BY doc_id ORDER BY score DESC, label)),
o AS (SELECT doc_id, string_agg(label, ',' ORDER BY n) AS secondary FROM r WHERE n > 1 GROUP BY 1),
a AS (SELECT *, (second >= 3 AND second >= 0.55 * score) OR (label IN ({quoted(OUTSIDE)}) AND {_held(CROSSING)}) AS ambiguous FROM r JOIN t USING (doc_id) WHERE n = 1),
c AS (SELECT *, least(98e-2, 52e-2 + least(CAST(score AS DOUBLE), 15e0) * 25e-3 + CAST(score - second AS DOUBLE) / greatest(CAST(score AS DOUBLE), 1e0) * 2e-1) AS sure FROM a)
SELECT t.doc_id, coalesce(label, 'unknown') AS domain, coalesce(secondary, '') AS secondary, CASE WHEN label IS NULL THEN 'unknown' ELSE {_SUB.replace('f,', 'c.f,')} END AS subdomain, CAST(coalesce(round(CAST(CAST(CASE WHEN ambiguous THEN least(sure, 64e-2) ELSE sure END AS VARCHAR) AS DECIMAL(20, 18)), 2), 0) AS DOUBLE) AS confidence, coalesce(ambiguous, false) AS ambiguous,
CASE WHEN label IN ({quoted(OUTSIDE)}) AND NOT ambiguous THEN 'out_of_scope' ELSE 'review_required' END AS scope, coalesce(label IN ({quoted(ACTIVE)}) AND NOT ambiguous, false) AS candidate, coalesce(reasons, '') AS reasons FROM t LEFT JOIN c ON c.doc_id = t.doc_id LEFT JOIN o ON o.doc_id = t.doc_id""")
def legislation_domains(spark: SparkSession, d: str) -> DataFrame:
    rows = domains.legislation_domain(table(spark, d, "documents", "doc_id", "text"), F.col("text"), RULES, SUBDOMAINS, OUTSIDE, ACTIVE, CROSSING)
    return rows.drop("text").withColumn("secondary", F.array_join("secondary", ",")).withColumn("reasons", F.array_join("reasons", ","))


@R.add(f"""WITH {_rules()}, {_T}, g(lang, label, w) AS (VALUES {', '.join(f"('{k}', '{x}', {float(w)})" for k, (x, w) in HINTS.items())}),
n AS (SELECT *, CASE doc_id % 7 WHEN 0 THEN ' Rail ' WHEN 1 THEN 'ship' WHEN 2 THEN 'unknown' WHEN 3 THEN ' ' END AS given FROM t),
e AS (SELECT doc_id, label, 'kind=' || n.lang AS phrase, w, -1 AS place FROM n JOIN g ON g.lang = n.lang UNION ALL SELECT doc_id, label, phrase, w, place FROM n JOIN k ON contains(f, phrase)),
s AS (SELECT doc_id, label, sum(w) AS score, string_agg(phrase, ',' ORDER BY place) AS because FROM e GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER v AS n, coalesce(lead(score) OVER v, 0) AS second, sum(score) OVER (PARTITION BY doc_id) AS everything FROM s WINDOW v AS (PARTITION BY doc_id ORDER BY score DESC, label)),
z AS (SELECT n.doc_id, given, label, score, everything, because, CASE WHEN lower(trim(given)) = 'rail' THEN 'explicit' WHEN lower(trim(given)) NOT IN ('', 'unknown') THEN 'inactive' WHEN label IS NULL THEN 'none' WHEN second >= 5 AND second >= 0.8 * score THEN 'unclear' ELSE 'resolved' END AS status FROM n LEFT JOIN r ON r.doc_id = n.doc_id AND r.n = 1)
SELECT doc_id, CASE status WHEN 'explicit' THEN 'rail' WHEN 'resolved' THEN label END AS domain, CAST(CASE status WHEN 'explicit' THEN 1 WHEN 'resolved' THEN round(score / everything, 4) END AS DOUBLE) AS confidence, status, CASE WHEN status = 'resolved' THEN because ELSE '' END AS evidence FROM z""")
def retrieval_domains(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh document names a known domain, another one that is unknown, two more a blank."""
    place = F.col("doc_id") % 7
    given = F.when(place == 0, " Rail ").when(place == 1, "ship").when(place == 2, "unknown").when(place == 3, " ")
    rows = domains.retrieval_domain(table(spark, d, "documents", "doc_id", "text", "lang"), F.col("text"), F.col("lang"), given, RULES, HINTS)
    return rows.drop("text", "lang").withColumn("evidence", F.coalesce(F.array_join("evidence", ","), F.lit("")))
