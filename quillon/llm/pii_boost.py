"""Personal data by candidate gradient boosting.

High-recall generators propose spans, which may overlap: the exact base kinds, and looser forms of mail addresses,
phone numbers, account and identity numbers, network addresses and dates. Each candidate is described by its format
(digits, groups, checksums) and its context (cue words before it, neighbours). Boosted trees score candidates, a
threshold of each kind is calibrated on examples left out of training, and of overlapping candidates the best stays.
Base spans are kept whatever their score.

No labels are given, so they come from the corpus at a distance. In a bounded sample of documents the base spans, which
their checks prove, are personal, and all other numbers are not. Each lends its surroundings to an example: a base
span's mail address or phone number is rewritten in a looser form, or another personal value takes its place; a number
stands for itself, or a value takes its place that only looks personal. Seeded templates add cue words, which a corpus
may lack.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import least_hashed, mapped, replaced

#: Kinds of the base contract, in its order, then those that only the method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("hidden_email", "local_phone", "account", "identity", "hardware", "birth_date")
KINDS = BASE_KINDS + MORE_KINDS
BATCH = 1024
EXAMPLES, ROUNDS, DEPTH, RATE, SEED = 3000, 40, 3, 0.3, 11
#: Bounds of the corpus sample: documents, bytes of one document, and spans that lend their surroundings.
SAMPLE_DOCS, SAMPLE_TEXT, SAMPLE_SPANS = 4000, 1 << 17, 3000
#: Precision that a kind's threshold reaches on examples left out, at least so many of them; else that of all kinds.
PRECISION, LEAST_ASIDE = 0.97, 40
#: Characters before and after a span that its features look at.
BEFORE, AFTER = 40, 20

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Matches end where a run of digits ends, so looking only where one begins changes no match.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE = {
    "local_phone": re.compile(r"(?<![\w+.-])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?![\w-])"),
    "account": re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "identity": re.compile(r"(?<![\w.-])(?:\d{3}-\d{2}-\d{4}|\d{11})(?![\w.-]|\.\d)"),
    "hardware": re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![\w:])"),
    "birth_date": re.compile(r"(?<![\w./-])(?:\d{1,2}[./-]\d{1,2}[./-]\d{4}|\d{4}-\d{2}-\d{2})(?![\w/-])"),
}
_CUES = {
    "phone": re.compile(r"(?i)\b(?:tel|phone|call|mobile|cell|fax|whatsapp|contact)\b"),
    "mail": re.compile(r"(?i)\b(?:e-?mail|mail|contact|write|reach)\b"),
    "money": re.compile(r"(?i)\b(?:iban|account|bank|transfer|bic|swift)\b"),
    "identity": re.compile(r"(?i)\b(?:ssn|social|identity|passport|national id|tax id|citizen|tckn)\b"),
    "birth": re.compile(r"(?i)\b(?:born|birth|dob|birthday|geboren|né|nacid[oa])\b"),
    "device": re.compile(r"(?i)\b(?:mac|device|hardware|adapter|bssid)\b"),
    "thing": re.compile(r"(?i)\b(?:order|invoice|version|isbn|part|serial|page|item|ref|published|released|updated|due|no)\b"),
}


class Candidate(NamedTuple):
    start: int
    end: int
    kind: str


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(text: str) -> bool:
    """The account checksum: the country moved to the end, letters as numbers."""
    bare = text.replace(" ", "")
    moved = bare[4:] + bare[:4]
    return moved.isascii() and moved.isalnum() and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _ascii_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Candidate]:
    """Leftmost non-overlapping matches of each base kind; a match that fails its test is dropped, not retried."""
    out = []
    # The first character class cannot hold an @, so a match's @ is the first after its start: go from @ to @.
    at, done = text.find("@"), 0
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > done and _LOCAL.match(text, start - 1, start):
                start -= 1
            if start < at:
                out.append(Candidate(start, domain.end(), "email"))
                done = domain.end()
        at = text.find("@", max(at + 1, done))
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        for m in pattern.finditer(text):
            s = m[0]
            if kind == "ip":
                fine = all(len(p.lstrip("0")) <= 3 and int(p[-18:]) <= 255 for p in s.split("."))
            elif kind == "card":
                digits = s.replace(" ", "").replace("-", "")
                fine = 12 <= len(digits) <= 19 and luhn(digits)
            else:
                fine = 9 <= len(_ascii_digits(s)) <= 15
            if fine:
                out.append(Candidate(m.start(), m.end(), kind))
    return sorted(out, key=lambda c: (c.start, KINDS.index(c.kind)))


_HAS_DIGITS = re.compile(r"\d{2}")
_HAS_HEX = re.compile(r"[0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-]")
_AT = re.compile(r" ?(?:\[at\]|\(at\)|\{at\}) ?| at ", re.IGNORECASE)
_LOCAL_END = re.compile(r"[\w.+-]")
_AFTER_MARK = re.compile(r"[\w-]{2,}(?: ?(?:\[dot\]|\(dot\)|\{dot\}| dot |\.) ?[A-Za-z]{2,})+\b", re.IGNORECASE)
_AFTER_WORD = re.compile(r"[\w-]{2,}(?: ?(?:\[dot\]|\(dot\)|\{dot\}| dot ) ?[A-Za-z]{2,})+\b", re.IGNORECASE)


def _hidden_emails(text: str) -> list[Candidate]:
    """Around each "at" the name before it, of any length, and the domain after it."""
    out = []
    for a in _AT.finditer(text):
        domain = (_AFTER_WORD if a[0].lower() == " at " else _AFTER_MARK).match(text, a.end())
        if not domain:
            continue
        start = a.start()
        while start > 0 and _LOCAL_END.match(text, start - 1, start):
            start -= 1
        while start < a.start() and not text[start].isalnum():
            start += 1
        if a.start() - start >= 2:
            out.append(Candidate(start, domain.end(), "hidden_email"))
    return out


def loose_candidates(text: str) -> list[Candidate]:
    """Spans of the looser forms, overlapping ones included."""
    out = _hidden_emails(text)
    digits = _HAS_DIGITS.search(text) is not None
    for kind, pattern in _LOOSE.items():
        if _HAS_HEX.search(text) if kind == "hardware" else digits:
            out += [Candidate(m.start(), m.end(), kind) for m in pattern.finditer(text)]
    return sorted(set(out))


def features(text: str, c: Candidate) -> list[float]:
    """Format and context of a candidate."""
    s, before, after = text[c.start : c.end], text[max(0, c.start - BEFORE) : c.start], text[c.end : c.end + AFTER]
    digits = _ascii_digits(s)
    # Lengths beyond those of the examples tell nothing more.
    groups = re.findall(r"\d+", s)
    year = next((int(g) for g in groups if len(g) == 4), 0)
    marked = bool(re.search(r"(?i)[\[({](?:at|dot)[\])}]", s))
    return [
        float(MORE_KINDS.index(c.kind)) if c.kind in MORE_KINDS else -1.0, min(len(s), 60), len(digits), len(groups), max(map(len, groups), default=0), sum(x.isalpha() for x in s) / len(s),
        float(luhn(digits)) if digits else 0.0, float(c.kind == "account" and mod97(s)), float(marked), float("(" in s), float(1900 <= year <= 2015), float(len(set(digits)) <= 2),
        *(float(cue.search(before) is not None) for cue in _CUES.values()), float(before[-1:].isalnum()), float(after[:1].isalnum()), float(":" in before[-3:]), float(before[-1:] in "#$€£/="),
    ]


class Tree(NamedTuple):
    """A complete tree: the feature and cut of each inner node, the values of the leaves."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.feature[node]] > self.cut[node])
        return self.leaf[node - (2**DEPTH - 1)]


class Booster(NamedTuple):
    """``thresholds``: of each of MORE_KINDS."""

    bias: float
    trees: list[Tree]
    thresholds: tuple[float, ...]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + sum((t(x) for t in self.trees), np.zeros(len(x))))))

    def picked(self, x: np.ndarray) -> np.ndarray:
        """Whether the scores of these features reach their kinds' thresholds."""
        return self.scores(x) >= np.asarray(self.thresholds)[x[:, 0].astype(int)]


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> Tree:
    """One regression tree on gradients and curvatures, split where the gain is largest."""
    n_inner = 2**DEPTH - 1
    feature, cut = np.zeros(n_inner, dtype=np.int64), np.full(n_inner, np.inf)
    node = np.zeros(len(x), dtype=np.int64)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 17)[:-1])) for f in range(x.shape[1])]
    for k in range(n_inner):
        inside = node == k
        gs, hs = g[inside].sum(), h[inside].sum()
        best = 1e-6
        for f in range(x.shape[1]):
            for v in cuts[f]:
                right = inside & (x[:, f] > v)
                gr, hr = g[right].sum(), h[right].sum()
                gain = gr**2 / (hr + 1) + (gs - gr) ** 2 / (hs - hr + 1) - gs**2 / (hs + 1)
                if gain > best and min(hr, hs - hr) > 1e-3:
                    best, feature[k], cut[k] = gain, f, v
        node = np.where(inside, 2 * k + 1 + (x[:, feature[k]] > cut[k]), node)
    leaf = node - n_inner
    total_g, total_h = np.bincount(leaf, weights=g, minlength=n_inner + 1), np.bincount(leaf, weights=h, minlength=n_inner + 1)
    return Tree(feature, cut, -RATE * total_g / (total_h + 1))


def _filled(pattern: str, r: random.Random) -> str:
    """# a digit, A a capital letter, a a small one, x a hexadecimal digit, y one that is a letter."""
    pools = {"#": "0123456789", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "a": "abcdefghijklmnopqrstuvwxyz", "x": "0123456789abcdef", "y": "abcdef"}
    return "".join(r.choice(pools[c]) if c in pools else c for c in pattern)


def _valid_account(r: random.Random) -> str:
    body, country = _filled("A###############", r), r.choice(["DE", "FR", "ES", "GB", "IT"])
    rest = int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
    return f"{country}{98 - rest:02d}{body}"


#: Personal values and their like, and cue words of templates.
_GOOD = {
    "hidden_email": (["mail me", "contact", "reach", "write to", "", ""], lambda r: _filled(r.choice(["aaaaa [at] aaaaaa [dot] aaa", "aaaa.aaaa(at)aaaa(dot)aa", "aaaa## [at] aaaaa.aaa", "aaaaaa {at} aaaa {dot} aa", "a" * r.randrange(8, 70) + " [at] aaaaa.aaa"]), r)),
    "local_phone": (["phone", "call", "tel:", "mobile", "fax", "contact", "", ""], lambda r: _filled(r.choice(["(###) ###-####", "###-###-####", "###.###.####", "### ### ####"]), r)),
    "account": (["iban", "account", "bank", "transfer to", "", ""], lambda r: _valid_account(r)),
    "identity": (["ssn", "social security", "identity", "tax id", "passport"], lambda r: _filled(r.choice(["###-##-####", "###########"]), r)),
    "hardware": (["mac", "device", "adapter", "", ""], lambda r: _filled(r.choice(["xx:xx:xx:xx:xx:xx"] * 3 + ["yy:yy:yy:yy:yy:yy"]), r)),
    "birth_date": (["born", "date of birth", "dob", "birthday", "geboren am"], lambda r: f"{r.randrange(1, 29):02d}.{r.randrange(1, 13):02d}.{r.randrange(1930, 2010)}"),
}
_LIKE = {
    "hidden_email": (["look", "stayed", "", ""], lambda r: _filled(r.choice(["aaaa at aaaaa dot aaaaaaa", "aaaaa at aaaa dot aaaa"]), r)),
    "local_phone": (["order", "part", "serial", "item", "invoice no"], lambda r: _filled("###-###-####", r)),
    "account": (["order", "serial", "part", ""], lambda r: _filled(r.choice(["AA## #### ####", "AA##AAAA####", "AA############AA"]), r)),
    "identity": (["order", "version", "item", "ref", "", "", ""], lambda r: _filled(r.choice(["###-##-####", "###########"]), r)),
    "hardware": (["version", "item", "ref"], lambda r: "-".join(_filled("##", r) for _ in range(6))),
    "birth_date": (["published", "released", "updated", "due", "", "", ""], lambda r: r.choice([f"{r.randrange(1, 29):02d}.{r.randrange(1, 13):02d}.{r.randrange(1990, 2026)}", f"{r.randrange(1990, 2026)}-0{r.randrange(1, 10)}-{r.randrange(10, 29)}"])),
}


class Surrounding(NamedTuple):
    """A span of the corpus with what stands around it; ``kind`` is that of a base span, or empty for another number."""

    before: str
    span: str
    after: str
    kind: str


_NUMBER = re.compile(r"(?<![\w.,:/+@-])[0-9][0-9.,:/-]*(?![\w@])")


def surroundings(text: str) -> list[Surrounding]:
    """Those of a text's base spans, and of its numbers that no base span or loose candidate overlaps."""
    base, out = base_spans(text), []
    taken = [(c.start, c.end) for c in base + loose_candidates(text)]
    spans = [(c.start, c.end, c.kind) for c in base]
    spans += [(m.start(), m.end(), "") for m in _NUMBER.finditer(text) if not any(a < m.end() and m.start() < b for a, b in taken)]
    for start, end, kind in sorted(spans):
        out.append(Surrounding(text[max(0, start - BEFORE) : start], text[start:end], text[end : end + AFTER], kind))
    return out


def _loosened(s: Surrounding, r: random.Random) -> tuple[str, str]:
    """A personal value in a looser form: the surrounding's own mail address or phone number, or an invented value."""
    if s.kind == "email" and len(s.span) <= 80:
        at, dot = r.choice([(" [at] ", " [dot] "), ("(at)", "(dot)"), (" {at} ", " {dot} "), (" [at] ", ".")])
        name, _, domain = s.span.partition("@")
        value = name + at + domain.replace(".", dot)
        if any(c == Candidate(0, len(value), "hidden_email") for c in _hidden_emails(value)):
            return "hidden_email", value
    if s.kind == "phone":
        m = _LOOSE["local_phone"].search(s.span)
        if m:
            return "local_phone", m[0]
    kind = r.choice(MORE_KINDS)
    return kind, _GOOD[kind][1](r)


def corpus_examples(found: list[Surrounding], seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """An example of each surrounding, personal where a base span stood."""
    r, rows, y = random.Random(seed + 1), [], []
    for s in found:
        if s.kind:
            kind, value = _loosened(s, r)
        else:
            kind = r.choice(MORE_KINDS)
            value = s.span if r.random() < 0.3 else _LIKE[kind][1](r)
        rows.append(features(s.before + value + s.after, Candidate(len(s.before), len(s.before) + len(value), kind)))
        y.append(float(bool(s.kind)))
    return np.asarray(rows).reshape(len(rows), -1), np.asarray(y)


def examples(n: int = EXAMPLES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Invented candidates in context, half of them personal."""
    r = random.Random(seed)
    filler = ["the", "of", "and", "was", "in", "meeting", "notes", "le", "und", "de", "report", "see"]
    rows, y = [], []
    while len(rows) < n:
        label = len(rows) % 2
        kind = r.choice(MORE_KINDS)
        cues, make = (_GOOD if label else _LIKE)[kind]
        head = " ".join(r.choices(filler, k=r.randrange(0, 8)) + [r.choice(cues)])
        head = head.strip() + (" " if head.strip() else "")
        span = make(r)
        text = f"{head}{span} {' '.join(r.choices(filler, k=4))}"
        rows.append(features(text, Candidate(len(head), len(head) + len(span), kind)))
        y.append(label)
    return np.asarray(rows), np.asarray(y, dtype=float)


def _threshold(scores: np.ndarray, truth: np.ndarray, precision: float) -> float:
    """The least threshold that is precise enough; the highest if none is."""
    fine = [t for t in np.linspace(0.3, 0.95, 14) if (picked := scores >= t).any() and truth[picked].mean() >= precision]
    return float(min(fine, default=0.95))


@lru_cache(maxsize=4)
def train(found: tuple[Surrounding, ...] = (), n: int = EXAMPLES, rounds: int = ROUNDS, seed: int = SEED, precision: float = PRECISION) -> Booster:
    """Boosted trees on three of four examples; by kind the least threshold that is precise enough on the fourth."""
    x, y = examples(n, seed)
    aside = np.arange(len(x)) // 2 % 4 == 3
    if found:
        more, truth = corpus_examples(list(found), seed)
        x, y, aside = np.concatenate([x, more]), np.concatenate([y, truth]), np.concatenate([aside, np.arange(len(more)) % 4 == 3])
    xt, yt = x[~aside], y[~aside]
    bias = float(np.log(yt.mean() / (1 - yt.mean())))
    z, trees = np.full(len(xt), bias), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        trees.append(_grow(xt, p - yt, p * (1 - p)))
        z += trees[-1](xt)
    model = Booster(bias, trees, (0.5,) * len(MORE_KINDS))
    scores, truth, kinds = model.scores(x[aside]), y[aside], x[aside, 0]
    common = _threshold(scores, truth, precision)
    own = [_threshold(scores[kinds == k], truth[kinds == k], precision) if (kinds == k).sum() >= LEAST_ASIDE else common for k in range(len(MORE_KINDS))]
    return model._replace(thresholds=tuple(own))


def fit(docs: DataFrame, text_column: str = "text", sample_docs: int = SAMPLE_DOCS, sample_spans: int = SAMPLE_SPANS) -> Booster:
    """Trees learned from the surroundings in a bounded sample of texts with a digit or an @, those of least hash.

    Texts of more than SAMPLE_TEXT bytes, null and empty ones teach nothing; repeated texts teach once. Reruns agree.
    Without any surrounding the templates alone teach.
    """
    text = docs[text_column].cast("string")
    able = docs.filter(text.rlike("[0-9@]") & (F.octet_length(text) <= SAMPLE_TEXT)).select(F.lit(0).alias("g"), F.xxhash64(F.lit(3), text).alias("k"), text.alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(n, i, *s) for n, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, s in enumerate(surroundings(t))]
            yield pa.RecordBatch.from_pylist([dict(zip(("n", "i", *Surrounding._fields), f, strict=True)) for f in found], schema=pa.schema([("n", pa.int32()), ("i", pa.int32()), *((c, pa.string()) for c in Surrounding._fields)]))

    found = mapped(least_hashed(able, "g", "k", "t", sample_docs).select("_n", "t"), run, "n int, i int, before string, span string, after string, kind string")
    # Half of the bound for base spans, half for other numbers, of the least hashed texts first.
    half = [found.filter(which).orderBy("n", "i").limit(sample_spans // 2) for which in ("kind <> ''", "kind = ''")]
    rows = sorted((r["n"], r["i"], Surrounding(*r[2:])) for r in half[0].unionByName(half[1]).collect())
    return train(tuple(s for _, _, s in rows))


def find(model: Booster, text: str | None) -> list[Candidate]:
    """Base spans, and of the other candidates those above their kinds' thresholds that overlap nothing better."""
    if not text:
        return []
    kept = base_spans(text)
    loose = loose_candidates(text)
    if loose:
        x = np.asarray([features(text, c) for c in loose])
        taken = bytearray(len(text))
        for c in kept:
            taken[c.start : c.end] = b"\1" * (c.end - c.start)
        for score, fine, c in sorted(zip(model.scores(x).tolist(), model.picked(x).tolist(), loose, strict=True), key=lambda x: (-x[0], x[2])):
            if fine and 1 not in taken[c.start : c.end]:
                kept.append(c)
                taken[c.start : c.end] = b"\1" * (c.end - c.start)
    return sorted(kept, key=lambda c: (c.start, KINDS.index(c.kind)))


def redact(text: str, spans: list[Candidate]) -> str:
    """The text with each span, overlapping ones together, replaced by its kind in brackets."""
    parts, at = [], 0
    for c in spans:
        if c.start >= at:
            parts += [text[at : c.start], f"[{c.kind.upper()}]"]
        at = max(at, c.end)
    return "".join([*parts, text[at:]])


SPAN = "array<struct<kind:string,rank:int,start:int,end:int>>"


def find_private(docs: DataFrame, text_column: str = "text", model: Booster | None = None) -> DataFrame:
    """``docs`` with _spans (by start, then kind) and _redacted (each span, overlapping ones together, replaced by its kind).

    - A null text has no spans and null redacted; an empty one has no spans and stays empty.
    - Texts of any length are searched whole, in time about proportional to it.
    - Of overlapping loose spans the higher score stays, on ties the earlier, then the shorter; base spans always do.
    - Each row is searched for itself, so repeated rows agree. An empty table gives no rows.
    - Without a ``model`` one is learned from these texts, the same in every run.
    - Other columns may have any names; those of the added names, in any case, are replaced.
    """
    model = model or fit(docs, text_column)
    docs = replaced(docs, "_spans", "_redacted")
    place = docs.columns.index(text_column)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("kind", pa.string()), ("rank", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for first in range(0, whole.num_rows, BATCH):
                batch = whole.slice(first, BATCH)
                texts = batch.column(place).to_pylist()
                found = [find(model, t) for t in texts]
                spans = pa.array([[{"kind": c.kind, "rank": KINDS.index(c.kind), "start": c.start, "end": c.end} for c in f] for f in found], pa.list_(span))
                clean = pa.array([redact(t, f) if f else t for t, f in zip(texts, found, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, spans, clean], names=[*batch.schema.names, "_spans", "_redacted"])

    fields = [T.StructField("_spans", T.StructType.fromDDL(f"x {SPAN}")[0].dataType), T.StructField("_redacted", T.StringType())]
    return mapped(docs, run, T.StructType([*docs.schema.fields, *fields]))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
