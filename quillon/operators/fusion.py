"""Rank fusion, reranking and relevance gates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import distinct_parts, once, tokens

from .phrases import rule_hits

RRF_K = 60
#: Fixed order of the channels in a hit's contributions; others follow by name.
CHANNELS = ["lexical", "dense"]


def fuse(rankings: DataFrame, k: int = RRF_K, top: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of (query, channel, item, rank, raw_score).

    An item that a channel lists more than once counts once, at its first rank; later items keep their own ranks.
    Ties go to the least item.
    """
    first = rankings.groupBy("query", "channel", "item").agg(F.min(F.struct("rank", "raw_score")).alias("_f"))
    place = F.coalesce(*[F.when(F.col("channel") == c, i) for i, c in enumerate(CHANNELS)], F.lit(len(CHANNELS)))
    part = 1.0 / (k + F.col("_f.rank"))
    entry = F.struct(place.alias("place"), "channel", F.col("_f.rank").alias("rank"), F.col("_f.raw_score").alias("raw_score"), F.round(part, 9).alias("contribution"))
    fused = first.groupBy("query", "item").agg(F.round(F.sum(part), 9).alias("score"), F.sort_array(F.collect_list(entry)).alias("contributions"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "item")
    out = fused.withColumn("rank", F.row_number().over(best))
    return out.filter(F.col("rank") <= top) if top else out


def diagnostics(queries: DataFrame, rankings: DataFrame) -> DataFrame:
    """Candidates of each channel and distinct over all, for every query, with 0 where there are none."""
    counts = rankings.groupBy("query").agg(F.count_distinct(F.when(F.col("channel") == "lexical", F.col("item"))).alias("lexical_candidates"), F.count_distinct(F.when(F.col("channel") == "dense", F.col("item"))).alias("dense_candidates"), F.count_distinct("item").alias("distinct_candidates"))
    return queries.select("query").join(counts, "query", "left").fillna(0).withColumn("fallback", F.col("dense_candidates") == 0)


def reranked(hits: DataFrame, scorer: Callable[[Column, Column], Column], query_text: str, item_text: str, candidates: int = 30, top: int = 10) -> DataFrame:
    """The best candidates by fused rank in the order of a scorer; a score that is not finite makes the row fail."""
    scored = hits.filter(F.col("rank") <= candidates).withColumn("rerank_score", scorer(F.col(query_text), F.col(item_text)).cast("double"))
    bad = F.col("rerank_score").isNull() | F.isnan("rerank_score") | (F.abs("rerank_score") == float("inf"))
    scored = scored.withColumn("rerank_score", F.when(bad, F.raise_error(F.lit("a rerank score is not finite")).cast("double")).otherwise(F.col("rerank_score")))
    best = Window.partitionBy("query").orderBy(F.desc("rerank_score"), "item")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)


def overlap_scorer(query: Column, text: Column) -> Column:
    """A deterministic stand-in for a cross-encoder: the share of query tokens that the text holds."""
    asked = F.array_distinct(tokens(query))
    return F.round(F.size(F.array_intersect(asked, tokens(text))) / F.greatest(F.size(asked), F.lit(1)), 6)


@dataclass(frozen=True)
class Bounds:
    """How far a search in rounds may go. It ends early once ``enough`` queries of later rounds were asked and ``least_rounds`` are over."""

    rounds: int = 4
    queries: int = 4
    calls: int = 6
    enough: int = 4
    least_rounds: int = 3


def in_rounds(plan: Callable[[int, DataFrame | None], list[str]], search: Callable[[list[str]], DataFrame], bounds: Bounds = Bounds()) -> tuple[DataFrame | None, list[tuple[int, str]]]:
    """Search in rounds: ``plan`` sees the round and the hits so far and names queries, ``search`` answers them.

    Returns the hits of all rounds with their round (null if nothing was asked), and what was asked in which round. A
    round asks at most ``queries`` queries, all rounds at most ``calls``; a query that reads like an earlier one, but for
    case and blanks, is not asked again. A round that plans nothing new ends the search. Queries are few and live on
    the driver; hits stay distributed, and the caller checkpoints them if a plan is costly to repeat.
    """
    asked: list[tuple[int, str]] = []
    seen: set[str] = set()
    hits: DataFrame | None = None
    for n in range(1, bounds.rounds + 1):
        fresh: dict[str, str] = {}
        for query in plan(n, hits):
            key = " ".join(query.casefold().split())
            if key and key not in seen:
                fresh.setdefault(key, query)
        chosen = list(fresh.items())[: min(bounds.queries, bounds.calls - len(asked))]
        if not chosen:
            break
        seen.update(key for key, _ in chosen)
        asked += [(n, query) for _, query in chosen]
        found = search([query for _, query in chosen]).withColumn("round", F.lit(n))
        hits = found if hits is None else hits.unionByName(found)
        if n >= bounds.least_rounds and sum(r > 1 for r, _ in asked) >= bounds.enough:
            break
    return hits, asked


def content_terms(c: Column, stop: list[str]) -> Column:
    """Distinct tokens of four or more characters, no numbers, no stop words."""
    words = F.array(*[F.lit(w) for w in stop]) if stop else F.array().cast("array<string>")
    return F.array_distinct(F.filter(tokens(c), lambda t: (F.length(t) >= 4) & ~t.rlike("^[0-9]+$") & ~F.array_contains(words, t)))


def terms_agree(a: Column, b: Column) -> Column:
    """Equal, or equal in their first five characters (of four at least)."""
    n = F.least(F.lit(5), F.length(a), F.length(b))
    return (a == b) | ((n >= 4) & (F.left(a, n) == F.left(b, n)))


def agreement_keys(term: Column, asked: bool) -> Column:
    """Keys such that two terms agree exactly if an asked one and a held one have a key in common.

    Terms of five characters or more meet in their first five; where one of the two has four, these are the other's
    first four; all meet that are equal.
    """
    five, four = F.char_length(term) >= 5, F.left(term, F.lit(4))
    longer, shorter = (F.lit("4"), F.lit("x")) if asked else (F.lit("x"), F.lit("4"))
    return F.array_compact(F.array(F.concat(F.lit("="), term), F.when(five, F.concat(F.lit("5"), F.left(term, F.lit(5)))), F.when(five, F.concat(longer, four)), F.when(F.char_length(term) == 4, F.concat(F.lit("x"), term)), F.when((F.char_length(term) == 4) & F.lit(not asked), F.concat(shorter, term))))


def archive_gate(pairs: DataFrame, query_terms: str, text_terms: str, threshold: float = 0.75) -> DataFrame:
    """Pairs with matched terms, score and acceptance by the overlap of content terms.

    Terms that agree are found by hashing their keys once a row, not by comparing every term with every other.
    """
    asked = F.transform(query_terms, lambda q: agreement_keys(q, True))
    met = F.array_intersect(F.flatten(asked), F.flatten(F.transform(text_terms, lambda t: agreement_keys(t, False))))
    pairs = once(pairs, _met=met)
    matched = F.filter(query_terms, lambda q: F.arrays_overlap(agreement_keys(q, True), F.col("_met")))
    n, m = F.size(query_terms), F.size("matched")
    needed = F.least(F.lit(3), n)
    score = F.when(m > 0, F.round(0.5 + 0.5 * F.least(F.lit(1.0), m / F.greatest(F.least(F.lit(4), n), F.lit(1))), 4)).otherwise(0.0)
    out = pairs.withColumn("matched", matched).drop("_met").withColumn("relevance", score)
    return out.withColumn("accepted", (needed >= 2) & (m >= needed) & (F.col("relevance") >= threshold))


def intent(queries: DataFrame, rules: DataFrame, mandatory: int = 2) -> DataFrame:
    """For each query and profile: the concept groups found, and support.

    ``queries`` (query, text), ``rules`` (profile, group, phrase, kind): any phrase of kind 'any' finds its group, the
    first ``mandatory`` groups must all be found, and a phrase of kind 'veto' rejects.
    """
    hits = rule_hits(queries.select("query", "text"), rules, "text")
    found = hits.groupBy("query", "profile").agg(F.sort_array(F.collect_set(F.when(F.col("kind") == "any", F.col("group")))).alias("groups"), F.max(F.when(F.col("kind") == "veto", 1).otherwise(0)).alias("vetoed"))
    enough = F.size(F.filter("groups", lambda g: g <= mandatory)) == mandatory
    return found.withColumn("supported", enough & (F.col("vetoed") == 0))


def concept_score(parts: dict[str, tuple[float, list[str]]], text: Column, conflict: list[str], query: Column, intent_score: Column) -> Column:
    """Weighted sum of concept groups found in the text, less 0.40 for a conflict that the query does not share, scaled by the intent, within 0 and 1."""
    score: Column = F.lit(0.0)
    for share, phrases in parts.values():
        score = score + F.when(F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(text, p)), share).otherwise(0.0)
    clash = F.exists(F.array(*[F.lit(p) for p in conflict]), lambda p: F.contains(text, p) & ~F.contains(query, p)) if conflict else F.lit(False)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score - F.when(clash, 0.40).otherwise(0.0)) * (0.85 + 0.15 * intent_score))), 4)


def gated(queries: DataFrame, hits: DataFrame, top: int) -> DataFrame:
    """Accepted hits by relevance, score, id; queries without any stay, and abstain."""
    best = Window.partitionBy("query").orderBy(F.desc("relevance"), F.desc("score"), "item")
    kept = hits.filter("accepted").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return queries.select("query").join(kept, "query", "left").withColumn("abstained", F.col("item").isNull())


def visible_and_expanded(matched: Column, evidence: Column, visible: Column) -> tuple[Column, Column]:
    """Matched terms that the query and the visible text hold, and those that expansion put in."""
    return F.array_intersect(F.array_intersect(matched, evidence), visible), F.array_except(matched, evidence)


def evidence_text(submitted: Column, fields: Column, query: Column) -> Column:
    """The text that relevance is judged by, with its basis."""
    s, f = F.nullif(F.trim(submitted), F.lit("")), F.nullif(F.trim(fields), F.lit(""))
    return F.struct(F.coalesce(s, f, query).alias("text"), F.when(s.isNotNull(), "submitted").when(f.isNotNull(), "fields").otherwise("query").alias("basis"))


def verified(hits: DataFrame, relative: float = 0.30, dense: float = 0.20) -> DataFrame:
    """Hits (query, item, score, lexical_rank, dense_score, trusted, relevance_accepted) with ``verified`` and a ``note``.

    relevance_accepted has three states: true passes by itself, false rejects, null leaves it to the other signs.
    """
    top = F.max("score").over(Window.partitionBy("query"))
    near = (top > 0) & (F.col("score") / top >= relative)
    signal = F.col("lexical_rank").isNotNull() | F.coalesce(F.col("dense_score") >= dense, F.lit(False)) | F.col("relevance_accepted").eqNullSafe(F.lit(True))
    rejected = F.col("relevance_accepted").eqNullSafe(F.lit(False))
    trusted = F.coalesce(F.col("trusted"), F.lit(False))
    note = F.when(~trusted, "untrusted source").when(rejected, "not relevant").when(~near, "weak score").when(~signal, "no signal").otherwise("verified")
    return hits.withColumn("verified", trusted & ~rejected & near & signal).withColumn("note", note)


def source_trust(kind: Column, approved: Column, digest: Column) -> Column:
    """The trust decision for a source by its kind."""
    return F.when(kind == "synthetic", "synthetic").when((kind == "official") & F.coalesce(approved, F.lit(False)) & digest.rlike("^[0-9a-f]{64}$"), "official").when(kind == "snapshot", "snapshot").otherwise("untrusted")


def profile_for(kind: Column, text: Column, rules: list[tuple[str, list[str], str]]) -> Column:
    """The profile of the first rule (kind, phrases, profile) whose kind is the document's and one of whose phrases, if it has any, is in the text."""
    out = None
    for wanted, phrases, profile in rules:
        fits = kind == wanted
        if phrases:
            fits = fits & F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(text, p))
        out = F.when(fits, profile) if out is None else out.when(fits, profile)
    return out


def expanded(query: Column, profile: Column, expansions: dict[str, list[str]]) -> Column:
    """The query followed by its profile's phrases; of parts that read the same the first stays."""
    table = F.create_map(*[x for k, v in expansions.items() for x in (F.lit(k), F.array(*[F.lit(p) for p in v]))])
    more = F.coalesce(F.element_at(table, profile), F.array().cast("array<string>"))
    return distinct_parts(F.concat(F.array(query), more))
