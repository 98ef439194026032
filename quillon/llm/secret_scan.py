"""Secret scans by trigram queries.

Each rule's regular expression is parsed into a Boolean trigram query: a list of alternatives, each a set of
trigrams that must all occur. The trigrams that some query asks for are indexed: a document's postings are those that
it holds, and the postings that an alternative needs are intersected with them. The rules with a met alternative are
the document's candidates, and only these run their expression. A rule without mandatory trigrams scans every text.

Every document gets its spans, so its postings stay beside its text: an index of its own, joined back, would shuffle
all texts to hand each a short list.
"""

from __future__ import annotations

from itertools import product
from re import _parser as parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import text_of, whole_row


class SecretRule(NamedTuple):
    """A match counts if its ``group`` has ``least`` characters or more; the span is the whole match."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: Kinds of the base contract, in its order.
BASE_RULES = [
    SecretRule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # Runs of 24 or more are the runs of one or more that pass the length test.
    SecretRule("hex", r"[0-9a-f]{24,}", 0, 24),
]
#: Kinds with public, self-describing formats.
MORE_RULES = [
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("google", r"AIza[0-9A-Za-z_-]{35}"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    SecretRule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    SecretRule("userinfo", r"://[A-Za-z0-9._-]+:[^\x20\x09-\x0D/:@]{3,}@"),
]
#: A set of exact strings grows up to this many before it is turned into trigrams.
MOST_STRINGS = 64


def _trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _both(a: set, b: set) -> set:
    joined = {x | y for x, y in product(a, b)}
    return {x for x in joined if not any(y < x for y in joined)}


def _strings(op: str, arg) -> set[str] | None:
    """All strings that one parsed item can match, lower-cased, if they are few."""
    if op == "LITERAL":
        return {chr(arg).lower()}
    if op == "IN":
        some: set[str] = set()
        for o, a in arg:
            if str(o) == "LITERAL":
                some.add(chr(a).lower())
            elif str(o) == "RANGE" and a[1] - a[0] < 8:
                some |= {chr(c).lower() for c in range(a[0], a[1] + 1)}
            else:
                return None
        return some if len(some) <= 8 else None
    if op == "SUBPATTERN":
        return _sequence(arg[-1])
    if op == "BRANCH":
        each = [_sequence(x) for x in arg[1]]
        return set().union(*each) if all(x is not None for x in each) else None
    if op in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] == 1:
        inner = _sequence(arg[2])
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    if op == "AT":
        return {""}
    return None


def _sequence(items) -> set[str] | None:
    found = {""}
    for op, arg in items:
        some = _strings(str(op), arg)
        if some is None or len(found) * len(some) > MOST_STRINGS:
            return None
        found = {a + b for a in found for b in some}
    return found


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of lower-case trigrams; every match of the pattern holds all trigrams of one. [] means: scan fully."""

    def query(items) -> set:
        asked, run = {frozenset()}, {""}
        for op, arg in items:
            name = str(op)
            some = _strings(name, arg)
            if some is not None and len(run) * len(some) <= MOST_STRINGS:
                run = {a + b for a in run for b in some}
                continue
            asked, run = _both(asked, {_trigrams(s) for s in run}), {""}
            if some is not None:
                run = some
            elif name == "SUBPATTERN":
                asked = _both(asked, query(arg[-1]))
            elif name == "BRANCH":
                asked = _both(asked, set().union(*(query(x) for x in arg[1])))
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
                asked = _both(asked, query(arg[2]))
        asked = _both(asked, {_trigrams(s) for s in run})
        return {x for x in asked if not any(y < x for y in asked)}

    found = query(parser.parse(pattern))
    return [] if frozenset() in found else sorted(found, key=sorted)


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def spans_of(text: Column, rule: SecretRule) -> Column:
    """Spans (s, e) in code points of the rule's leftmost non-overlapping matches that are long enough.

    The text between matches and the matches themselves alternate, so their lengths give the places.
    """
    regex = F.lit(rule.pattern)
    no_spans = F.array().cast("array<struct<s:int,e:int,ok:boolean>>")
    whole, group, between = F.regexp_extract_all(text, regex, F.lit(0)), F.regexp_extract_all(text, regex, F.lit(rule.group)), F.split(text, rule.pattern, -1)
    steps = F.zip_with(F.zip_with(whole, group, lambda w, g: F.struct(F.length(w).alias("n"), (F.length(g) >= rule.least).alias("ok"))), F.slice(F.transform(between, lambda b: F.length(b)), 1, F.size(whole)), lambda m, gap: F.struct(m["n"].alias("n"), m["ok"].alias("ok"), gap.alias("gap")))

    def add(acc: Column, m: Column) -> Column:
        start = acc["at"] + m["gap"]
        return F.struct((start + m["n"]).alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("s"), (start + m["n"]).alias("e"), m["ok"].alias("ok")))).alias("out"))

    all_spans = F.aggregate(steps, F.struct(F.lit(0).alias("at"), no_spans.alias("out")), add)["out"]
    return F.when(text.rlike(rule.pattern), F.filter(all_spans, lambda x: x["ok"])).otherwise(no_spans)


def _ranked(spans: Column, rank: int, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("start"), F.lit(rank).alias("rank"), x["e"].alias("end"), F.lit(kind).alias("kind")))


def alternatives(rules: list[SecretRule]) -> tuple[list[tuple[int, frozenset[str]]], set[int]]:
    """(rule, trigrams) for each alternative of the rules' queries, and the rules without a query."""
    queries = [trigram_query(rule.pattern) for rule in rules]
    return [(r, trigrams) for r, query in enumerate(queries) for trigrams in query], {r for r, query in enumerate(queries) if not query}


def candidate_rules(text: Column, asked: list[tuple[int, frozenset[str]]]) -> Column:
    """Rules of which the text holds all trigrams of an alternative.

    The text's postings, the asked trigrams that occur in it, are intersected with what each alternative needs.
    """
    wanted = F.array(*[F.lit(t) for t in sorted({t for _, needs in asked for t in needs})])
    listed = F.array(*[F.struct(F.lit(r).alias("rule"), F.array(*[F.lit(t) for t in sorted(needs)]).alias("needs")) for r, needs in asked])
    postings = _let(F.lower(text), lambda low: F.filter(wanted, lambda t: F.contains(low, t)))
    met = _let(postings, lambda has: F.filter(listed, lambda a: F.size(F.array_except(a["needs"], has)) == 0))
    return F.array_distinct(F.transform(met, lambda a: a["rule"]))


def scan_secrets(docs: DataFrame, rules: list[SecretRule] | None = None, text_column: str = "text") -> DataFrame:
    """``docs`` with _spans: an array of (start, rank, end, kind) by start, then the rules' order.

    - A null text is empty; an empty one has no spans.
    - Texts of any length are scanned whole, as code points.
    - Spans of several kinds may overlap or begin together (ties go by the rules' order); those of one do not.
    - Each row is scanned for itself, so repeated rows agree. An empty table gives no rows.
    - Other columns may have any names; _spans, in any case, is replaced.
    """
    rules = BASE_RULES + MORE_RULES if rules is None else rules
    asked, always = alternatives(rules)
    keyed = docs.select(whole_row(docs), text_of(docs, text_column).alias("_text"))
    found_rules = candidate_rules(F.col("_text"), asked) if asked else F.array().cast("array<int>")
    # A generator, so that the optimizer does not repeat the postings for every rule.
    keyed = keyed.select("_row", "_text", F.explode(F.array(found_rules)).alias("_rules"))
    none = F.array().cast("array<struct<s:int,e:int,ok:boolean>>")
    found = []
    for r, rule in enumerate(rules):
        spans = spans_of(F.col("_text"), rule)
        if r not in always:
            spans = F.when(F.array_contains("_rules", r), spans).otherwise(none)
        found.append(_ranked(spans, r, rule.kind))
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c.lower() != "_spans"]
    spans = F.sort_array(F.concat(*found)) if found else F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    return keyed.select(*kept, spans.alias("_spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
