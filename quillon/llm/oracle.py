"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .quality_rules import FUNCTION_WORDS, ITERATIONS, LEAST, MOST, START_ACCURACY, START_SHARE
from .secret_scan import BASE_RULES, MORE_RULES

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def op2() -> str:
    # Written from the contract and what each pattern means, with string functions only.
    marked = lambda words, marks: " OR ".join(f"contains(seen, '{w}{m}')" for w in words for m in marks)
    others = " OR ".join([
        marked(["/login", "/wp-login"], "/.?#"), marked(["/signup", "/cart", "/checkout"], "/?#"), marked(["/search"], "/?"), marked(["/ad", "/ads"], "/"),
        "len(list_filter(string_split(replace(seen, '/tags/', '/tag/'), '/tag/')[2:], lambda x: x <> '' AND x[1] NOT IN ('/', '#'))) > 0",
        " OR ".join(f"contains(seen, '{m}{w}=')" for m in "?&;" for w in ("sid", "phpsessid", "jsessionid")),
        " OR ".join(f"contains(seen, '{m}utm_source={w}')" for m in "?&" for w in ("ad", "banner")),
        marked([f".{w}" for w in ("jpg", "jpeg", "png", "gif", "mp4", "zip", "exe")], "?#"),
    ])
    upper, lower = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
    return rf"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS after FROM pages),
ends AS (SELECT page_id, after, least({", ".join(f"coalesce(nullif(strpos(after, '{m}'), 0), length(after) + 1)" for m in "/?#")}) AS h, least({", ".join(f"coalesce(nullif(strpos(after, '{m}'), 0), length(after) + 1)" for m in "?#")}) AS p FROM cut),
parts AS (SELECT page_id, translate(substr(after, 1, h - 1), {upper}, {lower}) AS host, substr(after, h, p - h) AS path, translate(substr(after, p), {upper}, {lower}) AS rest FROM ends),
ruled AS (SELECT *, host || path || rest || '#' AS seen, '.' || host AS dotted FROM parts),
named AS (SELECT *, CASE
  WHEN ends_with(dotted, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN ends_with(dotted, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN ends_with(dotted, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN ends_with(dotted, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN ends_with(dotted, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM ruled)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN {others} THEN 'block' ELSE 'allow' END AS verdict
FROM named"""


def op6() -> str:
    rules = BASE_RULES + MORE_RULES
    parts, names = [], []
    for r, rule in enumerate(rules):
        p = _text(rule.pattern)
        parts.append(f"regexp_extract_all(t, {p}, 0) AS w{r}, regexp_extract_all(t, {p}, {rule.group}) AS g{r}, string_split_regex(t, {p}) AS b{r}")
        start = f"CAST(list_sum(list_transform(b{r}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w{r}[1:i-1], lambda x: length(x))), 0) AS BIGINT)"
        each = f"list_transform(list_filter(range(1, len(w{r}) + 1), lambda i: length(g{r}[i]) >= {rule.least}), lambda i: {{'s': {start}, 'r': {r}, 'e': {start} + length(w{r}[i]), 'k': {_text(rule.kind)}}})"
        names.append(f"{each} AS s{r}")
    say = "array_to_string(list_transform({0}, lambda x: concat_ws(':', x.k, x.s, x.e)), ',')"
    base = "list_sort(list_concat(list_concat(s0, s1), s2))"
    every = "s0"
    for r in range(1, len(rules)):
        every = f"list_concat({every}, s{r})"
    return f"""
WITH m AS (SELECT doc_id, {', '.join(parts)} FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
s AS (SELECT doc_id, {', '.join(names)} FROM m)
SELECT doc_id, CAST(len(s0) AS BIGINT) AS n_assign, CAST(len(s1) AS BIGINT) AS n_access, CAST(len(s2) AS BIGINT) AS n_hex,
  sha256(coalesce({say.format(base)}, '')) AS base_sha256, coalesce({say.format(f'list_sort({every})')}, '') AS spans
FROM s"""


def op1() -> str:
    from .quality_rules import votes

    conditions = [f"CASE WHEN {yes} THEN 1 WHEN {no} THEN -1 ELSE 0 END" for yes, no in votes().values()]
    stops = "[" + ", ".join(_text(w) for w in FUNCTION_WORDS) + "]"
    n = len(conditions)
    rules = range(1, n + 1)
    score = " + ".join(f"v[{j}] * w[{j}]" for j in rules)
    odds = "ln({0} / (1 - {0}))"
    new_w = ", ".join(odds.format(f"least({MOST}, greatest({LEAST}, (sum(c * CASE v[{j}] WHEN 1 THEN g WHEN -1 THEN 1 - g ELSE 0 END) + 8) / (sum(c * abs(v[{j}])) + 10)))") for j in rules)
    share = "least(0.98, greatest(0.5, (sum(c * g) + 1) / (sum(c) + 2)))"
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
runs AS (SELECT doc_id, i, w[i] AS a, w[i+1] AS b, w[i+2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM runs) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
  len(regexp_extract_all(t, '\p{{Lu}}{{2,}}')) AS n_caps, length(t) - length(replace(t, '!', '')) AS n_marks,
  len(list_filter(w, lambda x: list_contains({stops}, lower(x)))) AS n_function,
  len(list_filter(w, lambda x: regexp_matches(x, '[.;:?]$'))) AS n_stops
  FROM d JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, [{', '.join(conditions)}] AS v FROM m),
p AS (SELECT v, CAST(count(*) AS DOUBLE) AS c FROM f GROUP BY v),
em AS (SELECT 0 AS it, list_transform(range({n}), lambda x: {odds.format(START_ACCURACY)}) AS w, {odds.format(START_SHARE)} AS b
  UNION ALL
  SELECT it + 1, [{new_w}], {odds.format(share)} FROM (SELECT it, v, c, 1 / (1 + exp(-(b + {score}))) AS g FROM em, p WHERE it < {ITERATIONS}) GROUP BY it)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND 1 / (1 + exp(-(b + {score}))) >= 0.5) AS kept
FROM f, em WHERE em.it = {ITERATIONS}"""


def op8() -> str:
    return r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM d WHERE len(w) >= 5
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS v, doc_id AS r FROM d UNION SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.v)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, (SELECT min(r) FROM reach WHERE v = d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id)"""


def _crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of ASCII text, four bits at a time."""
    table = []
    for value in range(16):
        for _ in range(4):
            value = value >> 1 ^ 0xEDB88320 * (value & 1)
        table.append(value)
    half = lambda c: f"xor({c} >> 4, {table}[({c} & 15) + 1])"
    low = f"list_transform([xor(c, b)], lambda x: {half('x')})"
    step = f"list_transform({low}, lambda y: {half('y')})[1]"
    return f"xor(list_reduce(list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii({text}[i]) AS BIGINT)), lambda c, b: {step}, CAST(4294967295 AS BIGINT)), 4294967295)"


def op13() -> str:
    # Lists of nodes instead of joins: each level of a source is one list, and six levels hold 16 ** 6 leaves of a source.
    levels = 6
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join([*map(field, ("doc_id", "source", "lang", "n_chars")), field(text)]) + ")"
    up = lambda below: f"CASE WHEN len({below}) > 1 THEN list_transform(range((len({below}) + 15) // 16), lambda r: sha256(array_to_string({below}[r*16+1:r*16+16], ''))) ELSE {below} END"

    def climbing(name: str, base: str) -> str:
        out = f"{name}0 AS ({base})"
        for k in range(levels):
            out += f",\n{name}{k + 1} AS (SELECT *, {up(f'l{k}')} AS l{k + 1} FROM {name}{k})"
        return out

    run = lambda k, i: f"(({i}) // {16**k} // 16)"

    def sides(k: int, i: str, t: str) -> tuple[str, str, str]:
        """What stands before and after a node's place at level k, and whether there is a run at all."""
        return f"array_to_string({t}.l{k}[{run(k, i)}*16+1:(({i}) // {16**k})], '')", f"array_to_string({t}.l{k}[(({i}) // {16**k})+2:{run(k, i)}*16+16], '')", f"len({t}.l{k}) > 1"

    steps = [sides(k, "x.i", "t") for k in range(levels)] + [sides(k, "t.j", "u") for k in range(levels)]
    said = " || ".join(f"CASE WHEN {some} THEN {a} || {b} ELSE '' END" for a, b, some in steps)
    ways = ", ".join(f"CASE WHEN {some} THEN [{a}, {b}] END AS s{k}" for k, (a, b, some) in enumerate(steps))
    folds = ""
    for k in range(len(steps)):
        folds += f",\nf{k} AS (SELECT * EXCLUDE (h), CASE WHEN s{k} IS NULL THEN h ELSE sha256(s{k}[1] || h || s{k}[2]) END AS h FROM {f'f{k - 1}' if k else 'w'})"
    return f"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS g, {leaf("text")} AS leaf,
  CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed FROM documents),
x AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
{climbing("t", "SELECT g, list(leaf ORDER BY i) AS l0 FROM x GROUP BY g")},
t AS (SELECT *, l{levels}[1] AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS j FROM t{levels}),
{climbing("u", "SELECT list(subroot ORDER BY j) AS l0 FROM t")},
u AS (SELECT *, l{levels}[1] AS root FROM u{levels}),
w AS (SELECT x.doc_id, x.leaf, t.subroot, u.root, sha256({said}) AS proof_sha256, coalesce(x.changed, x.leaf) AS h, {ways} FROM x JOIN t USING (g), u){folds}
SELECT doc_id, leaf, subroot, root, proof_sha256, h AS folded_root, h = root AS verified FROM f{len(steps) - 1}"""


SQL = {"op1_quality_rules": op1(), "op2_url_filters": op2(), "op6_secret_scan": op6(), "op8_trie_join": op8(), "op13_merkle_manifest": op13()}
