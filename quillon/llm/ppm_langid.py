"""Language identification by prediction by partial matching.

For each language a context tree over bytes is counted, up to ``DEPTH`` bytes deep, with a node for every context of
the sample. The statistics are then frozen: a byte's probability in its longest context follows from the counts, with
escapes (as many as there are distinct followers) to the next shorter context, from which the followers already seen
are excluded, down to equal chances of all 256 bytes. A text's code length under a language is the exact sum of its
bytes' costs, in floating point, and the shortest code wins.

Frozen trees make the cost of a byte a function of it and its context. A context c that knows the byte b costs
-log P(b | c); one that does not costs its escape, and the next shorter context goes on. The grams (contexts with their
next byte) of all languages' trees are one hash table. For each a row holds, by language, the cost of its last byte
after the others, and the escapes summed over all contexts that end it. A byte's cost is then that of the longest gram
that ends with it, plus the escapes of the contexts before it that are longer: two look-ups, for whole batches of texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import held_out, least_hashed, mapped, replaced

#: Bounds of the labelled sample: documents of each language, bytes of one document, and bytes of each language.
SAMPLE_DOCS, SAMPLE_TEXT, SAMPLE_BYTES = 400, 1 << 17, 1 << 20
#: Bytes of the longest context.
DEPTH = 4
#: Bytes that are scored together.
CHUNK = 1 << 19
BATCH = 4096
_LETTER = re.compile(r"[^\W\d_]")
_PAD = b" " * DEPTH
_U = np.uint64


class Model(NamedTuple):
    """Grams as a hash table, and by gram and language the costs; row 0 is the empty context.

    ``cost``: of the last byte after the others, less the escapes of these. ``escapes``: summed over the gram as a
    context and all shorter ones that end it. ``inner``: the row of the gram without its first byte if it is longer than a context.
    """

    languages: list[str]
    slots: np.ndarray
    keys: np.ndarray
    cost: np.ndarray
    escapes: np.ndarray
    inner: np.ndarray


def _grams(data: np.ndarray, n: int) -> np.ndarray:
    """The grams of n bytes that end at each place from ``DEPTH`` on, as numbers: the bytes, and the length above them."""
    out = np.full(len(data) - DEPTH, n << 56, dtype=np.uint64)
    for k in range(n):
        out |= data[DEPTH - k : len(data) - k].astype(np.uint64) << _U(8 * k)
    return out


def _short(keys: np.ndarray, n: int) -> np.ndarray:
    """Grams of n bytes without their first."""
    return (_U(n - 1) << _U(56)) | (keys & _U((1 << 8 * (n - 1)) - 1))


def _context(keys: np.ndarray, n: int) -> np.ndarray:
    """Grams of n bytes without their last."""
    return (_U(n - 1) << _U(56)) | ((keys & _U((1 << 8 * n) - 1)) >> _U(8))


def _hashed(keys: np.ndarray, shift: int) -> np.ndarray:
    return ((keys * _U(0x9E3779B97F4A7C15)) ^ ((keys * _U(0x9E3779B97F4A7C15)) >> _U(29))) * _U(0xBF58476D1CE4E5B9) >> _U(shift)


def _table(keys: np.ndarray) -> np.ndarray:
    """Open addressing with steps of one: rows of the keys by hash, at most half full."""
    # At least 13 bits, so that the room for steps past the end does not change the size that look-ups read off.
    bits = max(13, int(2 * len(keys)).bit_length())
    slots = np.full((1 << bits) + 4096, -1, dtype=np.int32)
    at, rest = _hashed(keys, 64 - bits).astype(np.int64), np.arange(len(keys), dtype=np.int32)
    while len(rest):
        free = slots[at] < 0
        slots[at[free]] = rest[free]
        lost = slots[at] != rest
        rest, at = rest[lost], at[lost] + 1
    return slots


def _found(model: Model, keys: np.ndarray) -> np.ndarray:
    """Rows of the keys; -1 for those that no tree has."""
    bits = len(model.slots).bit_length() - 1
    at = _hashed(keys, 64 - bits).astype(np.int64)
    rows = model.slots[at]
    todo = np.flatnonzero((rows >= 0) & (model.keys[rows] != keys))
    while len(todo):
        at[todo] += 1
        rows[todo] = model.slots[at[todo]]
        todo = todo[(rows[todo] >= 0) & (model.keys[rows[todo]] != keys[todo])]
    return rows


def _tree(data: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By gram length: the grams of one language, and the costs of their last bytes; the contexts, and their escapes."""
    levels = []
    # Chances of each gram's last byte in the level above, with the grams they belong to; at first all are equal.
    above: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None = None
    for n in range(1, DEPTH + 2):
        grams, times = np.unique(_grams(data, n), return_counts=True)
        contexts, first, total = np.unique(_context(grams, n), return_index=True, return_counts=True)
        of = np.repeat(np.arange(len(contexts)), total)
        # Grams of one context stand together, as the context is their upper part.
        distinct, count = total.astype(float), np.bincount(of, weights=times)
        if above is None:
            lower = np.full(len(grams), 1 / 256)
        else:
            lower = above[1][np.searchsorted(above[0], _short(grams, n))]
        # What the followers leave of the chances in the shorter context.
        rest = np.maximum(1 - np.bincount(of, weights=lower), 0)
        open_ = (distinct < 256) & (rest > 1e-12)
        chance = times / np.where(open_, count + distinct, count)[of]
        escape = np.zeros(len(contexts))
        escape[open_] = -np.log2(distinct[open_] / (count + distinct)[open_] / rest[open_])
        levels.append((grams, -np.log2(chance), contexts, escape))
        above = (grams, chance, contexts, escape)
    return levels


def train(texts: dict[str, list[str]]) -> Model:
    """Freeze a model of the languages' texts."""
    languages = sorted(texts)
    trees = [_tree(np.frombuffer(b"".join(_PAD + t.lower().encode() for t in texts[la]) + _PAD, dtype=np.uint8)) for la in languages]
    by_length = [np.unique(np.concatenate([t[n][0] for t in trees])) for n in range(DEPTH + 1)]
    keys = np.concatenate([np.zeros(1, dtype=np.uint64), *by_length])
    firsts = np.cumsum([1, *map(len, by_length)])
    cost, escapes = np.zeros((len(keys), len(languages))), np.zeros((len(keys), len(languages)))
    inner = np.arange(len(keys), dtype=np.int32)
    own = [np.empty((0, len(languages)))] * (DEPTH + 1)
    for n in range(DEPTH + 2):
        # Escapes of the contexts of n bytes, on top of those of the shorter ones.
        rows = np.arange(1) if n == 0 else np.arange(firsts[n - 1], firsts[n])
        shorter = np.zeros(len(rows), dtype=np.int64) if n <= 1 else firsts[n - 2] + np.searchsorted(by_length[n - 2], _short(keys[rows], n))
        if n > DEPTH:
            inner[rows] = shorter
        else:
            escapes[rows] = 0 if n == 0 else escapes[shorter]
            for j, tree in enumerate(trees):
                _, _, contexts, escape = tree[n]
                at = rows if n == 0 else firsts[n - 1] + np.searchsorted(by_length[n - 1], contexts)
                escapes[at, j] += escape
    for n in range(1, DEPTH + 2):
        rows = np.arange(firsts[n - 1], firsts[n])
        # A gram that a language lacks escapes from its context to the shorter one.
        context = np.zeros(len(rows), dtype=np.int64) if n == 1 else firsts[n - 2] + np.searchsorted(by_length[n - 2], _context(keys[rows], n))
        if n == 1:
            whole = np.full((len(rows), len(languages)), 8.0) + escapes[0]
        else:
            longer = escapes[context] - escapes[_parents(keys, firsts, by_length, context, n - 1)]
            whole = own[n - 2][np.searchsorted(by_length[n - 2], _short(keys[rows], n))] + longer
        for j, tree in enumerate(trees):
            grams, costs, _, _ = tree[n - 1]
            whole[np.searchsorted(by_length[n - 1], grams), j] = costs
        own[n - 1] = whole
        cost[rows] = whole - escapes[context]
    return Model(languages, _table(keys), keys, cost, escapes, inner)


def _parents(keys: np.ndarray, firsts: np.ndarray, by_length: list[np.ndarray], rows: np.ndarray, n: int) -> np.ndarray:
    """Rows of the next shorter contexts of these rows, which are grams of n bytes."""
    return np.zeros(len(rows), dtype=np.int64) if n <= 1 else firsts[n - 2] + np.searchsorted(by_length[n - 2], _short(keys[rows], n))


def _costs(model: Model, data: np.ndarray) -> np.ndarray:
    """Bits of each byte from ``DEPTH`` on, by language."""
    # The longest known gram that ends at each place; a place may end none.
    rows = np.zeros(len(data) - DEPTH + 1, dtype=np.int64)
    todo = np.arange(1, len(rows))
    for n in range(DEPTH + 1, 0, -1):
        got = _found(model, _grams(data, n)[todo - 1])
        here = got > 0
        rows[todo[here]] = got[here]
        todo = todo[~here]
        if not len(todo):
            break
    # The context of the first byte is what stands before it.
    for n in range(DEPTH, 0, -1):
        before = (_U(n) << _U(56)) | _U(int.from_bytes(data[DEPTH - n : DEPTH].tobytes(), "big"))
        got = _found(model, np.asarray([before], dtype=np.uint64))
        if got[0] > 0:
            rows[0] = got[0]
            break
    out = model.cost[rows[1:]] + model.escapes[model.inner[rows[:-1]]]
    out[rows[1:] == 0] += 8.0
    return out


def code_lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """Bits of each lower-cased text under each language."""
    out = np.zeros((len(texts), len(model.languages)))

    def score(some: list[tuple[int, bytes]]) -> None:
        costs = _costs(model, np.frombuffer(b"".join(_PAD + t for _, t in some), dtype=np.uint8))
        # Between two texts lie the costs of the padding, which is left out.
        at = 0
        edges = []
        for _, t in some:
            edges += [at, at + len(t)]
            at += len(t) + DEPTH
        np.add.at(out, [i for i, _ in some], np.add.reduceat(costs, edges[:-1], axis=0)[::2])

    some: list[tuple[int, bytes]] = []
    size = 0
    for i, t in enumerate(texts):
        # A very long text is scored in parts that overlap by the context.
        for at in range(0, len(t), CHUNK):
            if at:
                out[i] += _costs(model, np.frombuffer(t[at - DEPTH : at + CHUNK], dtype=np.uint8)).sum(0)
                continue
            some.append((i, t[:CHUNK]))
            size += min(len(t), CHUNK)
        if size >= CHUNK:
            score(some)
            some, size = [], 0
    if some:
        score(some)
    return out


def predict(model: Model | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and certainty of each text; ``und`` with 0 for null, without letters, or if nothing was learned.

    The certainty is the winner's share of 2 ** -bits over all languages. Ties go to the first language by name.
    """
    letters = [t is not None and _LETTER.search(t) is not None for t in texts]
    if model is None or not model.languages:
        return ["und"] * len(texts), [0.0] * len(texts)
    bits = code_lengths(model, [t.lower().encode() if ok else b"" for t, ok in zip(texts, letters, strict=True)])
    best = bits.argmin(1)
    shares = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
    return [model.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], [float(p) if ok else 0.0 for p, ok in zip(shares, letters, strict=True)]


def fit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """Learn from a bounded sample of each language's texts that are not held out, those of least hash of id and text.

    The sample has at most ``sample_docs`` texts and SAMPLE_BYTES bytes of each language; texts of more than
    SAMPLE_TEXT bytes teach nothing. Rows with a null text or language teach nothing; a null id is never held out and
    may teach. Repeated rows count once, and reruns agree. Without any row the model is None.
    """
    known = docs.filter(docs[lang_column].isNotNull() & docs[text_column].isNotNull() & ~held_out(docs[id_column]) & (F.octet_length(docs[text_column]) <= SAMPLE_TEXT))
    rows = known.select(known[lang_column].alias("la"), F.xxhash64(F.lit(9), known[id_column], known[text_column]).alias("key"), known[text_column].alias("t"))
    texts: dict[str, list[str]] = {}
    left: dict[str, int] = {}
    # As many rows as the bounds say, for each language.
    for r in sorted(least_hashed(rows, "la", "key", "t", sample_docs).collect(), key=lambda r: (r["la"], r["_n"])):
        left.setdefault(r["la"], SAMPLE_BYTES)
        left[r["la"]] -= len(r["t"].encode())
        if left[r["la"]] >= 0:
            texts.setdefault(r["la"], []).append(r["t"])
    return train(texts) if texts else None


def identify(docs: DataFrame, model: Model | None, text_column: str = "text") -> DataFrame:
    """``docs`` with _lang_pred and _lang_score.

    - A null text, and one without letters, is ``und`` with score 0; so is every text without a model.
    - Texts of any length are scored whole, in parts that overlap by the context.
    - Ties go to the first language by name. Each row is judged for itself, so repeated rows agree.
    - An empty table gives no rows. Other columns may have any names; those of the added names are replaced.
    """
    docs = replaced(docs, "_lang_pred", "_lang_score")
    place = docs.columns.index(text_column)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                said, score = predict(model, batch.column(place).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, "_lang_pred", "_lang_score"])

    return mapped(docs, run, T.StructType([*docs.schema.fields, T.StructField("_lang_pred", T.StringType()), T.StructField("_lang_score", T.DoubleType())]))
