"""Toxicity through a noisy channel.

Texts hide words behind digits and marks, spelled-out letters and repeated letters. Such a stretch becomes a lattice
of what each character may stand for, may join to or may repeat, and Viterbi search under a character trigram model
finds the likeliest clear text. Words without such signs have one path only and stay as they are. The trigrams are
counted over all texts. The restored text is scored by a logistic regression, learned from a labelled sample, over the
words it holds and how they begin.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import held_out, least_hashed, mapped, replaced

#: Bounds of the labelled sample: documents of each label, bytes of one document.
SAMPLE_DOCS, SAMPLE_TEXT = 1500, 1 << 17
#: From this score on a text counts as toxic.
THRESHOLD = 0.3
#: Parameters of the classifier: the features with a weight, those that tell the labels apart most, and in how many
#: labelled texts a feature must stand. They bound the model, not what is scored.
MOST_FEATURES, LEAST_DOCS = 6000, 3
PREFIXES = (4, 5, 6)
SHARE = 0.25
#: Different trigrams that a task holds before it hands them on.
MOST_GRAMS = 500_000
#: Tokens that a Python worker remembers.
CACHE = 120_000
BATCH = 2048

#: What digits and marks may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
JOINERS = " .-_*~'"
#: Log chances of the channel: a character as it is, a stand-in, a joiner dropped, a joiner kept, a repeated letter dropped.
KEEP, SWAP, JOIN, SPLIT, SQUEEZE = 0.0, -1.0, 0.0, -3.0, -0.3

_EDGES = ".,;:!?\"'()[]{}<>…*"
_SPELLED = re.compile(rf"(?<!\S)[{re.escape(_EDGES)}]*(\S(?: \S){{2,}})[{re.escape(_EDGES)}]*(?!\S)")
_ODD = re.compile(r"[^\W\d_][0-9@$!|+(€£¡]+[^\W\d_]|^[0-9@$!|+(€£¡]+[^\W\d_]{2}|[^\W\d_]{2}[0-9@$|+(€£¡]+(?:[^\W\d_]|$)|^[0-9@$!|+(€£¡]*[^\W\d_][0-9@$|+(€£¡]+$|^[0-9@$!|+(€£¡]+[^\W\d_]$|([^\W\d_])\1\1|^(?:\S[.\-_*~]){2,}\S$")


class CharModel(NamedTuple):
    """Log chances of a character after the two before it, backed off to one and none."""

    three: dict[str, float]
    two: dict[str, float]
    one: dict[str, float]
    rest: float

    def log(self, before: str, c: str) -> float:
        x = self.three.get(before + c)
        if x is not None:
            return x
        x = self.two.get(before[1:] + c)
        return x - 0.9 if x is not None else self.one.get(c, self.rest) - 1.8


def gram_counts(words: Iterable[tuple[str, int]], counts: Counter | None = None) -> Counter:
    """Trigrams of words between blanks, weighted by the texts that hold them; added to ``counts`` if given."""
    counts = Counter() if counts is None else counts
    for w, n in words:
        s = f"  {w} "
        for i in range(2, len(s)):
            counts[s[i - 2 : i + 1]] += n
    return counts


def char_model(words: Iterable[tuple[str, int]]) -> CharModel:
    return model_of(gram_counts(words))


def model_of(three: dict[str, int]) -> CharModel:
    """The model of trigram counts; shorter ones are the trigrams' ends."""
    one, two = Counter(), Counter()
    for g, n in three.items():
        one[g[2]] += n
        two[g[1:]] += n
    total = sum(one.values()) or 1
    before2, before3 = Counter(), Counter()
    for g, n in two.items():
        before2[g[0]] += n
    for g, n in three.items():
        before3[g[:2]] += n
    return CharModel({g: math.log(n / before3[g[:2]]) for g, n in three.items()}, {g: math.log(n / before2[g[0]]) for g, n in two.items()}, {g: math.log(n / total) for g, n in one.items()}, math.log(0.5 / total))


def lattice(noisy: str) -> list[list[tuple[str, float]]]:
    """For each character, what it may have been ('' if it was put in), with log chances of the channel."""
    arcs: list[list[tuple[str, float]]] = []
    for i, c in enumerate(noisy):
        options = [(c, SWAP - 2.0 if c in LEET else SPLIT if c in JOINERS else KEEP)]
        options += [(x, SWAP) for x in LEET.get(c, "")]
        if c in JOINERS:
            options.append(("", JOIN))
        if i and c == noisy[i - 1] and c.isalpha():
            options.append(("", SQUEEZE))
        arcs.append(options)
    return arcs


def restore(model: CharModel, noisy: str) -> str:
    """The likeliest clear text of a lower-cased stretch, by Viterbi over its lattice."""
    # State: the last two clear characters. Each holds its best score and a chain of what was read.
    states: dict[str, tuple[float, tuple | None]] = {"  ": (0.0, None)}
    for options in lattice(noisy):
        after: dict[str, tuple[float, tuple | None]] = {}
        for before, (score, chain) in states.items():
            for c, chance in options:
                if c:
                    new, total, link = before[1] + c, score + chance + model.log(before, c), (c, chain)
                else:
                    new, total, link = before, score + chance, chain
                held = after.get(new)
                if held is None or total > held[0]:
                    after[new] = (total, link)
        states = after
    _, chain = max(((s + model.log(b, " "), ch) for b, (s, ch) in states.items()), key=lambda x: x[0])
    clear = []
    while chain:
        clear.append(chain[0])
        chain = chain[1]
    return "".join(reversed(clear))


def _word_features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}+" for k in PREFIXES if len(word) > k)]


class Restorer:
    """Words of texts with hidden ones restored; words seen before are looked up."""

    def __init__(self, model: CharModel):
        self.model = model
        self.known: dict[str, tuple[str, ...]] = {}

    def clear(self, token: str, remember: bool = True) -> tuple[str, ...]:
        """The words that a lower-cased token stands for, without marks at its edges."""
        found = self.known.get(token)
        if found is None:
            bare = token.strip(_EDGES)
            # Marks at the edges may be signs or stand-ins, so both forms are looked at.
            if _ODD.search(token) or bare != token and _ODD.search(bare):
                own = restore(self.model, bare or token).split()
                # A stand-in before the word, which is also a mark of its own.
                if (led := token.lstrip(_EDGES.replace("!", ""))).startswith("!") and bare:
                    own += restore(self.model, "!" + led.strip(_EDGES)).split()
                found = tuple({bare, *(w.strip(_EDGES) for w in own)} - {""})
            else:
                found = (bare,) if bare else ()
            if len(self.known) >= CACHE:
                self.known.clear()
            if remember:
                self.known[token] = found
        return found

    def tokens(self, text: str) -> set[str]:
        """Distinct lower-cased tokens, and words spelled letter by letter put together."""
        low = text.lower()
        tokens = low.split()
        distinct = set(tokens)
        # Within a run, letters stand without marks.
        last = len(tokens) - 1
        if any(len(w) == 1 and 0 < i < last and _single(tokens[i - 1]) and _single(tokens[i + 1]) for i, w in enumerate(tokens)):
            for m in _SPELLED.finditer(" ".join(tokens)):
                distinct.update(restore(self.model, m[1]).split())
        return distinct


def _single(token: str) -> bool:
    return len(token) == 1 or len(token.strip(_EDGES)) == 1


class Scorer(NamedTuple):
    chars: CharModel
    weights: dict[str, float]
    bias: float


def _ratio_statistic(p: np.ndarray, q: np.ndarray, n_pos: float, n_neg: float) -> np.ndarray:
    """How far, as a likelihood ratio statistic, the labels of the texts with a feature are from those of all texts."""
    share = (p + q) / (n_pos + n_neg)
    total = np.zeros_like(p)
    for k, e in ((p, n_pos * share), (q, n_neg * share), (n_pos - p, n_pos * (1 - share)), (n_neg - q, n_neg * (1 - share))):
        real = (k > 0) & (e > 0)
        total[real] += 2 * k[real] * np.log(k[real] / e[real])
    return total


def train(chars: CharModel, texts: list[str], labels: list[int]) -> Scorer:
    """Fit the regression to labelled texts, restored by the character model."""
    restorer = Restorer(chars)
    # Features are numbered as they come, so that a text is an array and not a set of strings.
    number: dict[str, int] = {}
    docs = []
    for t in texts:
        own = {number.setdefault(f, len(number)) for token in restorer.tokens(t) for w in restorer.clear(token) for f in _word_features(w)}
        docs.append(np.fromiter(own, dtype=np.int32, count=len(own)))
    restorer.known.clear()
    y = np.asarray(labels, dtype=float)
    n_pos, n_neg = max(y.sum(), 1), max((1 - y).sum(), 1)
    with_label = [np.bincount(np.concatenate([np.empty(0, dtype=np.int32), *(d for d, label in zip(docs, labels, strict=True) if label == k)]), minlength=len(number)).astype(float) for k in (0, 1)]
    tells = _ratio_statistic(with_label[1], with_label[0], y.sum(), (1 - y).sum())
    often = with_label[0] + with_label[1] >= LEAST_DOCS
    # Chance alone makes the best of n features reach about 2 ln n.
    names = list(number)
    some = np.flatnonzero(often & (tells >= 2 * math.log(often.sum() + 1)))
    some = np.asarray(sorted(some.tolist(), key=lambda i: (-tells[i], names[i]))[:MOST_FEATURES], dtype=np.int64)
    chosen = [names[i] for i in some]
    place = np.full(len(names) + 1, -1, dtype=np.int64)
    place[some] = np.arange(len(some))
    rows = [p[p >= 0] for p in (place[d] for d in docs)]
    row_of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    columns = np.concatenate([np.empty(0, dtype=np.int64), *rows])
    w, b = np.zeros(len(chosen)), math.log(0.1 / 0.9)
    # Labels weigh as in a corpus with this share of toxic texts; a small pull to zero. Adam steps over the whole sample.
    weight = np.where(y == 1, SHARE / n_pos, (1 - SHARE) / n_neg)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, 251):
        z = b + np.bincount(row_of, weights=w[columns], minlength=len(rows))
        g = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y)
        gw, gb = np.bincount(columns, weights=g[row_of], minlength=len(w)) + 1e-5 * w, g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        rate, c1, c2 = 0.05, 1 - 0.9**step, 1 - 0.99**step
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= rate * (mb / c1) / (math.sqrt(vb / c2) + 1e-8)
    return Scorer(chars, {f: float(x) for f, x in zip(chosen, w, strict=True) if abs(x) > 1e-4}, b)


def score_texts(scorer: Scorer, texts: list[str | None], memory: dict[str, tuple]) -> list[float]:
    """Chances of label 1. ``memory`` keeps, from call to call, which weighted features a token has."""
    restorer = memory.setdefault("", Restorer(scorer.chars))
    weights, out = scorer.weights, []
    for text in texts:
        used: dict[str, float] = {}
        for token in restorer.tokens(text or ""):
            found = memory.get(token)
            if found is None:
                found = tuple((f, weights[f]) for w in restorer.clear(token, False) for f in _word_features(w) if f in weights)
                if len(memory) > CACHE:
                    memory.clear()
                    memory[""] = restorer
                memory[token] = found
            if found:
                used.update(found)
        z = scorer.bias + sum(used[f] for f in sorted(used))
        out.append(1 / (1 + math.exp(-max(-50.0, min(50.0, z)))))
    return out


def corpus_chars(docs: DataFrame, text_column: str = "text") -> CharModel:
    """The character model of all texts: tasks count trigrams of the words that each text holds, Spark adds them up.

    What reaches the driver grows with the different trigrams, not with the texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed_on() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], names=["gram", "n"])

        grams: Counter = Counter()
        for batch in batches:
            words: Counter = Counter()
            for t in batch.column(0).to_pylist():
                words.update(set((t or "").lower().split()))
            bare: Counter = Counter()
            for w, n in words.items():
                bare[w.strip(_EDGES)] += n
            gram_counts(((w, n) for w, n in bare.items() if w.isalpha()), grams)
            if len(grams) > MOST_GRAMS:
                yield handed_on()
                grams.clear()
        yield handed_on()

    counted = mapped(docs.select(docs[text_column].cast("string").alias("_text")), run, "gram string, n long")
    return model_of({r["gram"]: r["n"] for r in counted.groupBy("gram").agg(F.sum("n").alias("n")).collect()})


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", sample_docs: int = SAMPLE_DOCS) -> Scorer | None:
    """Learn the labels from a bounded sample of the texts that are not held out, and how words are spelled from all texts.

    The sample has at most ``sample_docs`` documents of each label, those of least hash; texts of more than SAMPLE_TEXT
    bytes teach no labels. Rows with a null id, text or label teach none either. An id with several labels is toxic if
    one says so; an id with several texts teaches the one of least hash. Without any labelled text the model is None.
    """
    marks = labels.filter(labels[id_column].isNotNull() & labels[label_column].isin(0, 1) & ~held_out(labels[id_column]))
    marks = marks.select(marks[id_column].alias("_id"), marks[label_column].cast("int").alias("_label")).groupBy("_id").agg(F.max("_label").alias("_label"))
    # Twice the bound, as some labels may have no document.
    chosen = least_hashed(marks, "_label", "_id", "_id", 2 * sample_docs)
    # As small as the sample.
    texts = docs.select(docs[id_column].alias("_id"), docs[text_column].cast("string").alias("_text")).filter(F.octet_length("_text") <= SAMPLE_TEXT)
    rows = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "_label", "_n").agg(F.min(F.struct(F.xxhash64("_text").alias("h"), "_text"))["_text"].alias("_text"))
    rows = rows.withColumn("_m", F.row_number().over(Window.partitionBy("_label").orderBy("_n"))).filter(F.col("_m") <= sample_docs)
    got = sorted(rows.select("_label", "_m", "_text").collect())
    return train(corpus_chars(docs, text_column), [r["_text"] for r in got], [r["_label"] for r in got]) if got else None


def score(docs: DataFrame, scorer: Scorer | None, text_column: str = "text") -> DataFrame:
    """``docs`` with _toxicity, from 0 to 1.

    - Null and empty texts get the score of no evidence; without a model all get 0.
    - Texts of any length are read whole; a token of many characters costs time and memory in proportion to them.
    - Among readings of a hidden word that are equally likely the first found wins, the same in every run.
    - Each row is scored for itself, so repeated rows agree. An empty table gives no rows.
    - Other columns may have any names; _toxicity, in any case, is replaced.
    """
    docs = replaced(docs, "_toxicity")
    place = docs.columns.index(text_column)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, memory = shared.value, {}
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                texts = batch.column(place).to_pylist()
                found = score_texts(scorer, texts, memory) if scorer else [0.0] * len(texts)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, "_toxicity"])

    return mapped(docs, run, T.StructType([*docs.schema.fields, T.StructField("_toxicity", T.DoubleType())]))
