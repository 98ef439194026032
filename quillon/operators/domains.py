"""Domains and types of documents by weighted phrases, evaluated inside each row: no joins, no shuffles.

Rules are plain tables, {label: [(phrase, weight), ...]}, that become literals of the plan. Phrases are sought in folded
text, so a null text holds none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import for_search, once

Rules = dict[str, list[tuple[str, float]]]


def _held(text: Column, phrase: str) -> Column:
    return F.coalesce(F.contains(text, for_search(F.lit(phrase))), F.lit(False))


def _any(text: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [_held(text, p) for p in phrases], F.lit(False))


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def evidence(text: Column, rules: Rules) -> Column:
    """The rules that a folded text meets: an array of (label, phrase, weight) in the table's order."""
    met = [F.when(_held(text, p), F.struct(F.lit(d).alias("label"), F.lit(p).alias("phrase"), F.lit(float(w)).alias("weight"))) for d, xs in rules.items() for p, w in xs]
    return F.array_compact(F.array(*met)) if met else F.array().cast("array<struct<label:string,phrase:string,weight:double>>")


def ranking(found: Column, labels: list[str]) -> Column:
    """Labels with evidence as (score, label), best first, ties by label."""
    each = [F.struct((-_total(F.transform(F.filter(found, _of(d)), lambda r: r["weight"]))).alias("lost"), F.lit(d).alias("label")) for d in sorted(labels)]
    # Ascending by the negated score, then by label.
    best = F.filter(F.array_sort(F.array(*each)), lambda r: r["lost"] < 0)
    return F.transform(best, lambda r: F.struct((-r["lost"]).alias("score"), r["label"].alias("label")))


def _of(label: str):
    return lambda r: r["label"] == label


def first_label(text: Column, rules: list[tuple[str, list[str]]], default: Column) -> Column:
    """The label of the first rule (label, phrases) one of whose phrases the folded text holds."""
    return F.coalesce(*[F.when(_any(text, phrases), label) for label, phrases in rules], default)


def general_type(docs: DataFrame, text: Column, profile: Column, rules: list[tuple[str, list[str]]], of_profile: dict[str, str], default: str) -> DataFrame:
    """``docs`` with ``type``: the first rule that the text meets, else the type of the operational profile, else the default."""
    known = F.coalesce(*[F.when(profile == p, t) for p, t in of_profile.items()], F.lit(default))
    return once(docs, _folded=for_search(text)).withColumn("type", first_label(F.col("_folded"), rules, known)).drop("_folded")


def _ranked(docs: DataFrame, text: Column, rules: Rules, more: Column | None = None) -> DataFrame:
    """Folded text, evidence and ranking, each evaluated once a row, with the best and the runner-up's score."""
    folded = once(docs, _folded=for_search(text))
    met = evidence(F.col("_folded"), rules)
    found = once(folded, _found=met if more is None else F.concat(more, met))
    ranked = once(found, _ranked=ranking(F.col("_found"), list(rules)))
    return ranked.withColumn("_top", F.get("_ranked", F.lit(0))).withColumn("_second", F.coalesce(F.get("_ranked", F.lit(1))["score"], F.lit(0.0)))


def legislation_domain(docs: DataFrame, text: Column, rules: Rules, subdomains: dict[str, list[tuple[str, list[str]]]], outside: list[str], active: list[str], road: list[str]) -> DataFrame:
    """``docs`` with a title's domain, secondary domains, subdomain, confidence, ambiguity, scope, candidacy, reasons.

    A runner-up of 3 or more with at least 55% of the best score is ambiguous, and so is a domain ``outside`` whose
    title holds one of the ``road`` phrases. Ambiguity caps confidence at 0.64 and leaves the scope to review. Domains
    without a table of subdomains are their own; with one, the first that fits counts, else 'general'. Without evidence
    the domain is 'unknown' with confidence 0. Reasons are the domain's phrases by weight, then by name.
    """
    folded, found, second = F.col("_folded"), F.col("_found"), F.col("_second")
    score, domain = F.col("_top.score"), F.col("_top.label")
    unclear = F.coalesce(((second >= 3) & (second >= score * 0.55)) | (domain.isin(outside) & _any(folded, road)), F.lit(False))
    sure = F.least(F.lit(0.98), 0.52 + F.least(score, F.lit(15.0)) * 0.025 + (score - second) / F.greatest(score, F.lit(1.0)) * 0.20)
    own = F.transform(F.filter(found, lambda r: r["label"] == domain), lambda r: F.struct((-r["weight"]).alias("lost"), r["phrase"].alias("phrase")))
    detail = F.coalesce(*[F.when(domain == d, first_label(folded, xs, F.lit("general"))) for d, xs in subdomains.items()], domain)
    out = _ranked(docs, text, rules).withColumn("ambiguous", unclear)
    clear = ~F.col("ambiguous")
    return out.select(
        *[docs[c] for c in docs.columns], F.coalesce(domain, F.lit("unknown")).alias("domain"), F.transform(F.slice("_ranked", 2, max(len(rules), 1)), lambda r: r["label"]).alias("secondary"), F.coalesce(detail, F.lit("unknown")).alias("subdomain"),
        F.coalesce(F.round(F.when(clear, sure).otherwise(F.least(sure, F.lit(0.64))), 2) * F.when(domain.isNotNull(), 1.0), F.lit(0.0)).alias("confidence"), "ambiguous",
        F.when(domain.isin(outside) & clear, "out_of_scope").otherwise("review_required").alias("scope"), F.coalesce(domain.isin(active) & clear, F.lit(False)).alias("candidate"), F.transform(F.array_sort(own), lambda r: r["phrase"]).alias("reasons"),
    )


def retrieval_domain(docs: DataFrame, text: Column, kind: Column, explicit: Column, rules: Rules, hints: dict[str, tuple[str, float]]) -> DataFrame:
    """``docs`` with the one domain to search in (null unless 'explicit' or 'resolved'), confidence, status, evidence.

    An explicit domain counts if the table knows it, and is 'inactive' if not; blank and 'unknown' are not explicit.
    Otherwise the hint of the document's kind and the phrases add up: 'none' without a score, 'unclear' with a runner-up
    of 5 or more and at least 80% of the best. Confidence is the best score's share of all.
    """
    trimmed = F.lower(F.trim(explicit))
    hinted = F.array_compact(F.array(*[F.when(kind == k, F.struct(F.lit(d).alias("label"), F.lit(f"kind={k}").alias("phrase"), F.lit(float(w)).alias("weight"))) for k, (d, w) in hints.items()]))
    out = _ranked(docs.withColumn("_named", F.when(~trimmed.isin("", "unknown"), trimmed)), text, rules, hinted if hints else None)
    named, top, second = F.col("_named"), F.col("_top"), F.col("_second")
    out = out.withColumn("status", F.when(named.isin(list(rules)), "explicit").when(named.isNotNull(), "inactive").when(top.isNull(), "none").when((second >= 5) & (second >= top["score"] * 0.80), "unclear").otherwise("resolved"))
    status = F.col("status")
    share = F.round(top["score"] / _total(F.transform("_found", lambda r: r["weight"])), 4)
    because = F.transform(F.filter("_found", lambda r: r["label"] == F.col("_top.label")), lambda r: r["phrase"])
    return out.select(
        *[docs[c] for c in docs.columns], F.when(status == "explicit", named).when(status == "resolved", top["label"]).alias("domain"),
        F.when(status == "explicit", 1.0).when(status == "resolved", share).alias("confidence"), "status", F.when(status == "resolved", because).alias("evidence"),
    )
