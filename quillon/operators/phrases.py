"""Which of many phrases each text holds: one pass of an automaton over every text, however many phrases there are.

A phrase is sought by its first characters, more of them where many phrases begin alike, and checked where these occur.
The keys of a block of phrases make one automaton with failure links, built once by each Python worker; blocks are
bounded, so what is broadcast and held is too. Rule tables of a few phrases become literals of the plan instead.

Phrases beyond one block are sought in one scan too: hashes of all stretches of 1, 2, 4, ... bytes of a text come from
each other, a phrase's hash is that of its two ends, and a filter of bits, bounded in size, says which stretches may be
phrases. These leave, and an equi-join with the phrases decides.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Up to this many rules become literals of the plan.
LITERALS = 256
#: Characters and phrases of a block: what is broadcast and made one automaton.
BLOCK_CHARS, BLOCK_PHRASES = 16_000_000, 200_000
#: Bits of a filter for each phrase, its size in bits as powers of 2, and its blocks; bytes of texts that are hashed together.
BITS_EACH, LEAST_BITS, MOST_BITS, FILTER_BLOCKS = 32, 20, 29, 256
PIECE = 1 << 20
#: Characters of a key, and phrases of one key before longer keys tell them apart.
KEY, CROWD = 16, 32


class Phrases:
    """The automaton of a block of phrases. An empty phrase is in every text."""

    def __init__(self, phrases: list[str]):
        self.phrases = phrases
        self.everywhere = [i for i, p in enumerate(phrases) if not p]
        keys: dict[str, list[int]] = {}
        waiting, size = [i for i, p in enumerate(phrases) if p], KEY
        while waiting:
            groups: dict[str, list[int]] = defaultdict(list)
            for i in waiting:
                groups[phrases[i][:size]].append(i)
            waiting = []
            for key, members in groups.items():
                # Those that a longer key would not tell apart stay.
                longer = [i for i in members if len(phrases[i]) > size] if len(members) > CROWD else []
                waiting += longer
                if rest := members if not longer else [i for i in members if len(phrases[i]) <= size]:
                    keys.setdefault(key, []).extend(rest)
            size *= 2
        self.automaton = ahocorasick.Automaton() if keys else None
        for key, members in keys.items():
            self.automaton.add_word(key, (len(key), members))
        if keys:
            self.automaton.make_automaton()

    def held(self, text: str | None) -> list[int]:
        """Numbers of the phrases that a text holds, in order; a null text holds none."""
        if text is None:
            return []
        found = set(self.everywhere)
        if self.automaton is not None:
            for end, (size, members) in self.automaton.iter(text):
                start = end - size + 1
                found.update(i for i in members if i not in found and text.startswith(self.phrases[i], start))
        return sorted(found)


_built: dict[str, Phrases] = {}


def blocks(phrases: DataFrame) -> list[DataFrame]:
    """Distinct phrases (phrase) whole if they are one block, else split by hash into blocks of about half the bound."""
    some = phrases.select("phrase").filter(F.col("phrase").isNotNull()).distinct()
    n, chars = some.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.char_length("phrase")), F.lit(0))).first()
    if n <= BLOCK_PHRASES and chars <= BLOCK_CHARS:
        return [some]
    count = max(-(-2 * n // BLOCK_PHRASES), -(-2 * chars // BLOCK_CHARS))
    return [some.filter(F.pmod(F.xxhash64("phrase"), F.lit(count)) == b) for b in range(count)]


_rng = np.random.Generator(np.random.PCG64(20261128))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LEFT, _END, _LENGTH = _rng.integers(1, 2**63, 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _stretches(raw: np.ndarray, top: int) -> list[np.ndarray]:
    """Hashes of all stretches of 1, 2, 4, ... up to 2 ** top bytes, by where they begin."""
    out = [_BYTE[raw]]
    for j in range(top):
        half, last = 1 << j, out[-1]
        out.append(_mixed(last[: max(len(last) - half, 0)] * _LEFT + last[half:]))
    return out


def _whole(first: np.ndarray, last: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The hash of a stretch of n bytes from those of the powers of 2 that it begins and ends with."""
    return _mixed(first * _END + last + n.astype(np.uint64) * _LENGTH)


def _spots(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """Four bits of a filter for each hash."""
    again = _mixed(hashes * _LEFT)
    return [(x >> np.uint64(64 - bits)).astype(np.int64) for x in (hashes, hashes << np.uint64(32), again, again << np.uint64(32))]


def _held_in(bits: np.ndarray, size: int, hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes that a filter may hold."""
    at = np.arange(len(hashes))
    for k in range(4):
        spot = _spots(hashes[at], size)[k]
        at = at[(bits[spot >> 3] >> (7 - (spot & 7)) & 1).astype(bool)]
    return at


def _filters(some: DataFrame, n: int) -> tuple[np.ndarray, int, list[int]]:
    """Bits of the phrases and of the powers of 2 that they begin with, their number's logarithm, and the phrases' lengths in bytes."""
    size = min(MOST_BITS, max(LEAST_BITS, int(BITS_EACH * n).bit_length()))
    per_block = (1 << size) // FILTER_BLOCKS

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch.column(0).to_pylist() if t]
            if not texts:
                continue
            n = np.asarray([len(t) for t in texts])
            level, start = np.frexp(n)[1] - 1, np.cumsum(n) - n
            all_of = _stretches(np.frombuffer(b"".join(texts), dtype=np.uint8), int(level.max()))
            for j in np.unique(level):
                own, at, much = all_of[j], start[level == j], n[level == j]
                found = np.unique(np.concatenate([x for h in (own[at], _whole(own[at], own[at + much - (1 << j)], much)) for x in _spots(h, size)]))
                yield pa.RecordBatch.from_arrays([pa.array((found // per_block).astype(np.int32)), pa.array((found % per_block).astype(np.int32))], names=["_block", "_spot"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            block, spot = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for b in np.unique(block).tolist():
                found.setdefault(b, np.zeros(per_block, dtype=bool))[spot[block == b]] = True
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([np.packbits(x).tobytes() for x in found.values()], pa.binary())], names=["_block", "_bits"])

    bits = np.zeros(1 << (size - 3), dtype=np.uint8)
    tasks = min(FILTER_BLOCKS, max(64, int(some.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    for r in some.mapInArrow(spots, "_block int, _spot int").repartition(tasks, "_block").mapInArrow(packed, "_block int, _bits binary").collect():
        part = np.frombuffer(r["_bits"], dtype=np.uint8)
        bits[r["_block"] * len(part) : (r["_block"] + 1) * len(part)] = part
    lengths = [r[0] for r in some.select(F.octet_length("phrase")).distinct().collect()]
    return bits, size, sorted(x for x in lengths if x)


def _scanned(texts: list[str | None], bits: np.ndarray, size: int, lengths: list[int]) -> Iterator[tuple[int, str]]:
    """(place of the text, stretch) that the filter says may be a phrase, each once."""
    data = [t.encode() if t else b"" for t in texts]
    at = 0
    while at < len(data):
        upto, much = at + 1, len(data[at])
        while upto < len(data) and much + len(data[upto]) <= PIECE:
            much, upto = much + len(data[upto]), upto + 1
        joined = b"".join(data[at:upto])
        ends = np.cumsum([len(x) for x in data[at:upto]])
        fitting = [n for n in lengths if n <= len(joined)]
        all_of = _stretches(np.frombuffer(joined, dtype=np.uint8), fitting[-1].bit_length() - 1) if fitting else []
        begun: dict[int, np.ndarray] = {}
        for n in fitting:
            j = n.bit_length() - 1
            own = all_of[j]
            if j not in begun:
                begun[j] = _held_in(bits, size, own)
            p = begun[j][begun[j] + n <= len(joined)]
            whole = _whole(own[p], own[p + n - (1 << j)], np.asarray([n]))
            some = _held_in(bits, size, whole)
            p, whole = p[some], whole[some]
            owner = np.searchsorted(ends, p, side="right")
            inside = p + n <= ends[owner]
            p, owner, whole = p[inside], owner[inside], whole[inside]
            for i in np.unique(np.stack([owner.astype(np.uint64), whole]), axis=1, return_index=True)[1].tolist() if len(p) else []:
                try:
                    yield at + int(owner[i]), joined[p[i] : p[i] + n].decode()
                except UnicodeDecodeError:
                    # Not at the bounds of characters, so no phrase.
                    continue
        at = upto


def held(rows: DataFrame, phrases: DataFrame, text_column: str = "text") -> DataFrame:
    """``rows`` without their texts, once for each distinct phrase (of ``phrases``, phrase) that the text holds, with ``phrase``.

    Case and white space count. Null phrases are in no text, and null texts hold none; an empty phrase is in every other
    text. A row whose text holds no phrase is not returned; repeated rows each are. Texts of any length are read whole.
    """
    place = rows.columns.index(text_column)
    kept = [i for i in range(len(rows.columns)) if i != place]
    schema = T.StructType([*[rows.schema.fields[i] for i in kept], T.StructField("phrase", T.StringType())])

    def of(block: DataFrame) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast([r["phrase"] for r in block.collect()])
        name = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            listed = shared.value
            if name not in _built:
                # One automaton a worker.
                _built.clear()
                _built[name] = Phrases(listed)
            automaton = _built[name]
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    batch = whole.slice(at, 1024)
                    found = [automaton.held(t) for t in batch.column(place).to_pylist()]
                    owner = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
                    out = [batch.column(i).take(owner) for i in kept]
                    yield pa.RecordBatch.from_arrays([*out, pa.array([listed[p] for f in found for p in f], pa.string())], names=[*[batch.schema.names[i] for i in kept], "phrase"])

        return rows.mapInArrow(run, schema)

    parts = blocks(phrases)
    if len(parts) == 1:
        return of(parts[0])
    some = phrases.select("phrase").filter(F.col("phrase").isNotNull()).distinct()
    shared_filters = rows.sparkSession.sparkContext.broadcast(_filters(some, some.count()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, size, lengths = shared_filters.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                found = list(_scanned(batch.column(place).to_pylist(), bits, size, lengths))
                owner = pa.array([i for i, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(owner) for i in kept), pa.array([p for _, p in found], pa.string())], names=[*[batch.schema.names[i] for i in kept], "phrase"])

    hits = rows.mapInArrow(scan, schema).join(some, "phrase", "left_semi").select(*[f.name for f in schema.fields])
    # An empty phrase is in every text.
    empty = some.filter(F.col("phrase") == "").limit(1).count()
    return hits.unionByName(of(some.filter(F.col("phrase") == ""))) if empty else hits


def rule_hits(rows: DataFrame, rules: DataFrame, text_column: str) -> DataFrame:
    """``rows`` without their texts, with the columns of every rule (phrase, ...) whose phrase the text holds.

    Few rules are tested as literals where the rows are, in the JVM; many go through the automaton and meet their rows
    by an equi-join on the phrase. Rules that repeat each hit.
    """
    few = rules.limit(LITERALS + 1).collect()
    others = [c for c in rows.columns if c != text_column]
    if len(few) > LITERALS:
        return held(rows, rules, text_column).join(rules, "phrase")
    literal = lambda r: F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in rules.schema.fields])
    tried: list[Column] = [F.when(F.contains(F.col(text_column), F.lit(r["phrase"])), literal(r)) for r in few if r["phrase"] is not None]
    met = F.array_compact(F.array(*tried)) if tried else F.array().cast(T.ArrayType(rules.schema))
    return rows.select(*[F.col(f"`{c}`") for c in others], F.inline(met))
