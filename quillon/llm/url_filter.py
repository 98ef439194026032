"""URL filters: rules indexed by their rarest literal token.

A pattern rule is a regular expression over the canonical url; a site rule is a host, with its subdomains, and how the
path begins. The tokens that every fit of a rule contains are read off the rule, one set for each alternative of a
pattern. The url table gives the frequency of these tokens, and a rule is filed under the rarest token of each
alternative. A url's own tokens fetch the rules filed under them by a join; only these are tried. An alternative
without a mandatory token is filed under the empty token, which every url has.
"""

from __future__ import annotations

from re import _parser as parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import listed, whole_row

#: A rule table up to this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_RULES = 100_000
#: Up to this many patterns are literals of the plan, so that each is compiled once; more are read from a column.
LITERAL_RULES = 256
#: Alternatives that a pattern is unfolded to; an item that would give more counts as unknown.
MOST_ALTERNATIVES = 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class UrlRule(NamedTuple):
    """A pattern over the canonical url, or, if ``host`` is given, a site: its host and the beginning of its paths."""

    name: str
    verdict: str
    pattern: str = ""
    host: str | None = None
    path: str = ""


def site_rule(verdict: str, rule: str) -> UrlRule:
    """A rule for a host with its subdomains whose paths begin with the rule's, such as ``example.com/en/``."""
    host, slash, path = rule.partition("/")
    return UrlRule(rule, verdict, host=host, path=slash + path)


SITE_RULES = [site_rule("allow", "com/"), site_rule("block", "example.com/en/"), site_rule("allow", "www.example.com/en/"), site_rule("block", "net/es/"), site_rule("block", "net/fr/")]

#: Pages that hold little prose of their own: accounts, shops, listings, tracking links, files of other kinds. The
#: canonical url ends in "#", so that a mark follows its last token too.
PATTERN_RULES = [
    UrlRule("login", "block", r"/(?:wp-)?login[/.?#]"),
    UrlRule("signup", "block", r"/signup[/?#]"),
    UrlRule("cart", "block", r"/(?:cart|checkout)[/?#]"),
    UrlRule("tags", "block", r"/tags?/[^/#]"),
    UrlRule("search", "block", r"/search[/?]"),
    UrlRule("session", "block", r"[?&;](?:sid|phpsessid|jsessionid)="),
    UrlRule("tracking", "block", r"[?&]utm_source=(?:ad|ads|banner)"),
    UrlRule("ads", "block", r"/ads?/"),
    UrlRule("media", "block", r"\.(?:jpe?g|png|gif|mp4|zip|exe)[?#]"),
]

# Parts of an unfolded pattern: a token's character, a certain mark or edge, or something unknown.
_MARK, _UNKNOWN = " ", "?"


def _unfolded(items) -> list[str]:
    """What a parsed pattern matches, as strings of parts; several for its alternatives."""
    found = [""]
    for op, arg in items:
        name = str(op)
        some: list[str] | None = None
        if name == "LITERAL":
            c = chr(arg)
            some = [c.lower() if c.isascii() and c.isalnum() else _MARK if c.isascii() else _UNKNOWN]
        elif name == "IN":
            chars = [chr(a) for o, a in arg if str(o) == "LITERAL"]
            if len(chars) == len(arg) and all(c.isascii() for c in chars):
                some = sorted({c.lower() if c.isalnum() else _MARK for c in chars})
        elif name == "SUBPATTERN":
            some = _unfolded(arg[-1])
        elif name == "BRANCH":
            some = sorted({s for x in arg[1] for s in _unfolded(x)})
        elif name == "AT" and str(arg) in ("AT_BEGINNING", "AT_BEGINNING_STRING", "AT_END_STRING"):
            some = [_MARK]
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] == 1:
            some = sorted({*_unfolded(arg[2]), *([""] if arg[0] == 0 else [])})
        elif name in ("ASSERT", "ASSERT_NOT"):
            some = [""]
        if some is None or len(some) * len(found) > MOST_ALTERNATIVES:
            some = [_UNKNOWN]
        found = [a + b for a in found for b in some]
    return found


def _bounded_tokens(parts: str) -> frozenset[str]:
    """Tokens of a string of parts that have a mark on both sides."""
    out = set()
    for piece in parts.split(_UNKNOWN):
        # What stands at a piece's edges may go on in the unknown part.
        out.update(piece.split(_MARK)[1:-1])
    return frozenset(out - {""})


def mandatory_tokens(rule: UrlRule) -> list[frozenset[str]]:
    """For each alternative of the rule, the whole tokens that every url it fits contains."""
    if rule.host is not None:
        parts = [_MARK + "".join(c.lower() if c.isascii() and c.isalnum() else _MARK if c.isascii() else _UNKNOWN for c in rule.host + rule.path) + _UNKNOWN]
    else:
        parts = [_UNKNOWN + s + _UNKNOWN for s in _unfolded(parser.parse(rule.pattern))]
    found = {_bounded_tokens(s) for s in parts}
    return sorted((x for x in found if not any(y < x for y in found)), key=sorted)


def canonical(url: Column) -> tuple[Column, Column, Column]:
    """Host, path, and the url as patterns see it: ASCII lower-case host, path and query without the scheme, then "#"."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$"
    host = F.translate(F.regexp_extract(url, pattern, 1), _UPPER, _LOWER)
    path = F.regexp_extract(url, pattern, 2)
    return host, path, F.concat(host, path, F.translate(F.regexp_extract(url, pattern, 3), _UPPER, _LOWER), F.lit("#"))


def url_tokens(seen: Column) -> Column:
    """Distinct lower-case alphanumeric tokens, and the empty token under which rules without tokens are filed."""
    return F.array_union(F.array(F.lit("")), F.split(F.translate(seen, _UPPER, _LOWER), "[^a-z0-9]+"))


def _fits(rules: list[UrlRule]) -> Column:
    """Whether the fetched rule fits the url."""
    dotted = F.concat(F.lit("."), F.col("_host"))
    site = F.endswith(dotted, F.concat(F.lit("."), F.col("_site"))) & F.startswith(F.col("_path"), F.col("_begins"))
    patterns = [(i, r.pattern) for i, r in enumerate(rules) if r.host is None]
    if len(patterns) > LITERAL_RULES:
        return F.when(F.col("_site").isNotNull(), site).otherwise(F.expr("_seen rlike _regex"))
    tried = F.when(F.col("_site").isNotNull(), site)
    for i, pattern in patterns:
        tried = tried.when(F.col("_id") == i, F.col("_seen").rlike(pattern))
    return tried.otherwise(F.lit(False))


def filter_urls(pages: DataFrame, rules: list[UrlRule] | None = None, default: str = "allow", url_column: str = "url") -> DataFrame:
    """``pages`` with _host, _path, _rule (the site rule that decided, else null), _pattern (the pattern rule that did) and _verdict.

    A site rule fits its host and all subdomains, if the path begins with the rule's; query and fragment are no part of
    either. The longest fitting site rule wins; without one, the first pattern rule by name; without any, the default.

    - A null url or one without ``://`` has empty host and path, fits no rule, and gets the default.
    - Urls of any length are judged whole. Repeated urls are judged once, and all their rows agree.
    - Ties between site rules of one length go to the first by name.
    - An empty table gives no rows; an empty list of rules gives the default everywhere.
    - Other columns may have any names; columns of the added names, in any case, are replaced.
    """
    spark = pages.sparkSession
    rules = SITE_RULES + PATTERN_RULES if rules is None else rules
    host, path, seen = canonical(pages[url_column])
    judged = pages.select(whole_row(pages), host.alias("_host"), path.alias("_path"), seen.alias("_seen"))
    kept = [F.col("_row")[c].alias(c) for c in pages.columns if c.lower() not in ("_host", "_path", "_rule", "_pattern", "_verdict")]
    if not rules:
        return judged.select(*kept, "_host", "_path", F.lit(None).cast("string").alias("_rule"), F.lit(None).cast("string").alias("_pattern"), F.lit(default).alias("_verdict"))
    url = ["_host", "_path", "_seen"]
    distinct = judged.select(*url).filter("_seen <> '#'").distinct()
    tokens = distinct.select(*url, F.explode(url_tokens(F.col("_seen"))).alias("_token"))

    # Longer site rules come first, patterns last.
    table = listed(spark, [(i, r.name, r.verdict, r.pattern, r.host, r.path, -len(r.name) if r.host is not None else 0) for i, r in enumerate(rules)], "_id int, _name string, _says string, _regex string, _site string, _begins string, _order int")
    small = F.broadcast if len(rules) <= BROADCAST_RULES else lambda df: df
    asked = listed(spark, [(i, a, t) for i, r in enumerate(rules) for a, some in enumerate(mandatory_tokens(r)) for t in sorted(some) or [""]], "_id int, _alternative int, _token string")
    counts = tokens.join(small(asked.select("_token").distinct()), "_token").groupBy("_token").agg(F.count(F.lit(1)).alias("_n"))
    rarest = asked.join(counts, "_token", "left").groupBy("_id", "_alternative").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_token"))["_token"].alias("_token"))
    index = table.join(rarest.select("_id", "_token").distinct(), "_id")

    fetched = tokens.join(small(index), "_token").filter(_fits(rules))
    best = fetched.groupBy(*url).agg(F.min(F.struct(F.col("_order").alias("o"), F.col("_name").alias("name"), F.col("_says").alias("says"), F.col("_site").isNotNull().alias("site"))).alias("_best"))
    out = judged.join(best, url, "left")
    site = F.col("_best.site")
    return out.select(*kept, "_host", "_path", F.when(site, F.col("_best.name")).alias("_rule"), F.when(~site, F.col("_best.name")).alias("_pattern"), F.coalesce(F.col("_best.says"), F.lit(default)).alias("_verdict"))
