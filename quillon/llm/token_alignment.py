"""Alignment of the tokens of two tokenizers by the bytes where both end one.

Each text is encoded by both vocabularies, a batch of texts at a time. Packed bitsets mark the bytes at which a token
ends; their conjunction holds the shared cuts, and ranks by popcount map a cut to the token ranges on either side of
it. Tokens between two cuts form a group, and a group links each of its first tokens with each of its second.

Which pairs of ids are linked in how many texts is counted by Spark over the stored pairs of each text. Pairs that many
texts hold meet their counts in a broadcast of proven size, all others by a shuffle, so no count is lost or guessed.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .shared import mapped, replaced, whole_row, written

FIRST_MODEL, SECOND_MODEL = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: How the first vocabulary cuts texts before it merges (fixed).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: An id of either vocabulary has fewer bits than this.
ID_BITS = 21
#: Texts, and about as many characters, of one batch; links that are expanded at once.
BATCH, BATCH_CHARS, LINKS = 1024, 400_000, 1 << 21
#: Pairs whose counts are broadcast, at most.
HOT = 1 << 20

_U = np.uint64
_LONG_SPACE = re.compile(r"\s{1000}")


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others in order from U+0100."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    others = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(others)}


class _Side:
    """A vocabulary's tokens as bytes, their lengths, and their ids as decimal digits."""

    def __init__(self, tokens: list[bytes]):
        if len(tokens) >= 1 << ID_BITS:
            raise ValueError("a vocabulary has too many ids")
        self.tokens = tokens
        self.lengths = np.asarray([len(t) for t in tokens], dtype=np.int64)


class Aligner:
    def __init__(self, first: bytes, second: bytes):
        model = json.loads(first)
        byte_of = byte_characters()
        special = {t["id"] for t in model.get("added_tokens", ()) if t.get("special")}
        vocabulary = {i: bytes(map(byte_of.__getitem__, t)) for t, i in model["model"]["vocab"].items() if i not in special}
        # Merging by rank is merging by id only if merges come in the order of the ids they give.
        merged = [model["model"]["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError("the first vocabulary's merges are not in the order of its ids")
        self.encoding = tiktoken.Encoding("first", pat_str=SPLIT, mergeable_ranks={t: i for i, t in vocabulary.items()}, special_tokens={})
        # The same tokens, slower: the faster encoder cannot search long white space.
        self.plain = Tokenizer.from_buffer(first)
        self.plain.encode_special_tokens = True
        self.a = _Side([vocabulary.get(i, b"") for i in range(max(vocabulary) + 1)])
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=second)
        texts = (self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size()))
        kinds = [(self.pieces.is_byte(i), self.pieces.is_control(i) or self.pieces.is_unknown(i)) for i in range(self.pieces.get_piece_size())]
        self.b = _Side([bytes([int(t[3:-1], 16)]) if byte else b"" if no_text else t.replace("▁", " ").encode() for t, (byte, no_text) in zip(texts, kinds, strict=True)])
        n = max(len(self.a.tokens), len(self.b.tokens))
        digits = len(str(n - 1))
        self.n_digits = np.asarray([len(str(i)) for i in range(n)])
        # Digits, then room for a separator.
        self.digits = np.frombuffer("".join(str(i).ljust(digits + 1) for i in range(n)).encode(), dtype=np.uint8).reshape(n, digits + 1)
        self.shown = np.arange(digits + 1) <= self.n_digits[:, None]

    def _first(self, text: str) -> list[int]:
        if _LONG_SPACE.search(text):
            return self.plain.encode(text, add_special_tokens=False).ids
        return self.encoding.encode_ordinary(text)

    def align(self, texts: list[str | None]) -> dict[str, list]:
        """Columns n_a, n_b, n_groups, n_links, groups_sha256, and of each text its linked pairs and how many links each has."""
        n = len(texts)
        ids_a, ids_b, sizes, owners = [], [], [], []
        encoded = iter(self.pieces.encode([t for t in texts if t], num_threads=1))
        for i, text in enumerate(texts):
            if not text:
                continue
            seconds, data = next(encoded), (" " + text).encode()
            firsts = self._first(" " + text)
            if b"".join(map(self.a.tokens.__getitem__, firsts)) == data and b"".join(map(self.b.tokens.__getitem__, seconds)) == data:
                ids_a.append(firsts)
                ids_b.append(seconds)
                sizes.append(len(data))
                owners.append(i)
        out = {c: np.zeros(n, dtype=np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
        shas, at = [""] * n, np.zeros(n + 1, dtype=np.int64)
        if not owners:
            return out | {"groups_sha256": shas, "pairs": np.empty(0, dtype=np.int64), "times": np.empty(0, dtype=np.int64), "at": at}
        owner = np.asarray(owners)
        out["n_a"][owner], out["n_b"][owner] = [len(x) for x in ids_a], [len(x) for x in ids_b]
        a, b = (np.fromiter(chain.from_iterable(side), dtype=np.int64) for side in (ids_a, ids_b))
        cuts, upto_a, upto_b = shared_cuts(np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b]), sum(sizes))
        from_a, from_b = (np.concatenate([[0], x[:-1]]) for x in (upto_a, upto_b))
        n_a, n_b = upto_a - from_a, upto_b - from_b
        # A text's last byte is a cut, so no group reaches across texts.
        text_ends = np.cumsum(sizes)
        text_of = np.searchsorted(text_ends, cuts + 1)
        links = n_a * n_b
        out["n_groups"][owner] = np.bincount(text_of, minlength=len(owner))
        last = np.searchsorted(cuts, text_ends - 1)
        out["n_links"][owner] = np.diff(np.concatenate([[0], np.cumsum(links)[last]]))
        for k, said in enumerate(self._said(a, b, n_a, n_b, from_b, upto_a, last)):
            shas[owners[k]] = said
        keys, times = _pairs(a, b, from_a, from_b, n_b, links, text_of)
        counts = np.zeros(n, dtype=np.int64)
        counts[owner] = np.bincount(keys >> (2 * ID_BITS), minlength=len(owner))
        at[1:] = np.cumsum(counts)
        return out | {"groups_sha256": shas, "pairs": keys & ((1 << 2 * ID_BITS) - 1), "times": times, "at": at}

    def _said(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, from_b: np.ndarray, upto_a: np.ndarray, last: np.ndarray) -> Iterator[str]:
        """Digests of the groups as text, one for each text: all digits and separators are laid out in one array."""
        slots_a = np.arange(len(a)) + np.repeat(from_b, n_a)
        slots_b = np.arange(len(b)) + np.repeat(upto_a, n_b)
        ids, marks = np.empty(len(a) + len(b), dtype=np.int64), np.full(len(a) + len(b), ord(","), dtype=np.uint8)
        ids[slots_a], ids[slots_b] = a, b
        upto_b = from_b + n_b
        marks[upto_a - 1 + from_b], marks[upto_b - 1 + upto_a] = ord("|"), ord(";")
        sizes = self.n_digits[ids]
        rows = self.digits[ids]
        rows[np.arange(len(ids)), sizes] = marks
        flat = rows[self.shown[ids]]
        ends = np.cumsum(sizes + 1)[upto_b[last] - 1 + upto_a[last]]
        for lo, hi in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True):
            yield hashlib.sha256(flat[lo : hi - 1]).hexdigest()


def _marked(ends: np.ndarray, n_bytes: int) -> np.ndarray:
    """A bitset in 64-bit words with the byte at which each token ends."""
    bits = np.zeros(-(-n_bytes // 64) * 64, dtype=bool)
    bits[ends - 1] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, n_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The last bytes before shared cuts, and how many tokens of either side have ended there."""
    a, b = _marked(ends_a, n_bytes), _marked(ends_b, n_bytes)
    cuts = np.flatnonzero(np.unpackbits((a & b).view(np.uint8), bitorder="little"))
    word, below = cuts >> 6, ~_U(0) >> (63 - (cuts & 63)).astype(np.uint64)

    def rank(bits: np.ndarray) -> np.ndarray:
        ones = np.bitwise_count(bits).astype(np.int64)
        return (np.cumsum(ones) - ones)[word] + np.bitwise_count(bits[word] & below)

    return cuts, rank(a), rank(b)


def _counted(keys: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of their times."""
    if times is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, dtype=np.int64)
        return keys[first], np.diff(np.append(first, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(times[order], first)


def _pairs(a: np.ndarray, b: np.ndarray, from_a: np.ndarray, from_b: np.ndarray, n_b: np.ndarray, links: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, A id, B id) as one number, in order, with the links of each; expanded in bounded blocks of groups."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    ends = np.cumsum(links)
    lo = 0
    while lo < len(links):
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + LINKS, side="right")))
        if links[lo] > LINKS:
            # One vast group: its distinct ids with their numbers.
            i = lo
            sides = [np.unique(s, return_counts=True) for s in (a[from_a[i] : from_a[i] + links[i] // n_b[i]], b[from_b[i] : from_b[i] + n_b[i]])]
            (x, nx), (y, ny) = sides
            parts.append((((text_of[i] << 2 * ID_BITS | x << ID_BITS)[:, None] | y).reshape(-1), (nx[:, None] * ny).reshape(-1)))
            lo += 1
            continue
        some = slice(lo, hi)
        group = np.repeat(np.arange(lo, hi), links[some])
        within = np.arange(int(ends[hi - 1] - done)) - (ends[group] - links[group] - done)
        row, column = within // n_b[group], within % n_b[group]
        parts.append(_counted(text_of[group] << 2 * ID_BITS | a[from_a[group] + row] << ID_BITS | b[from_b[group] + column]))
        lo = hi
    if len(parts) == 1:
        return parts[0]
    return _counted(np.concatenate([k for k, _ in parts]), np.concatenate([t for _, t in parts]))


@lru_cache(maxsize=2)
def _aligner(first: bytes, second: bytes) -> Aligner:
    """An aligner of this Python worker, kept from task to task."""
    return Aligner(first, second)


def _bounded(whole: pa.RecordBatch, place: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with bounded texts and characters; a longer text stands alone."""
    first, chars = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(whole.column(place)), 0).to_pylist()):
        if i > first and (i - first >= BATCH or chars + n > BATCH_CHARS):
            yield whole.slice(first, i - first)
            first, chars = i, 0
        chars += n
    if first < whole.num_rows:
        yield whole.slice(first)


_FOUND = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, _pairs array<long>, _times array<int>"


def grouped(docs: DataFrame, first: bytes, second: bytes, text_column: str = "text") -> DataFrame:
    """``docs`` without their texts, with n_a, n_b, n_groups, n_links, groups_sha256, _pairs (A id and B id in one number) and _times."""
    docs = replaced(docs, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "_pairs", "_times")
    place = docs.columns.index(text_column)
    shared = docs.sparkSession.sparkContext.broadcast((first, second))
    kept = [i for i in range(len(docs.columns)) if i != place]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*shared.value)
        for whole in batches:
            for batch in _bounded(whole, place):
                out = aligner.align(batch.column(place).to_pylist())
                lists = [pa.ListArray.from_arrays(pa.array(out["at"], pa.int32()), pa.array(out[c], kind)) for c, kind in (("pairs", pa.int64()), ("times", pa.int32()))]
                columns = [*[batch.column(i) for i in kept], *[pa.array(out[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], pa.array(out["groups_sha256"], pa.string()), *lists]
                yield pa.RecordBatch.from_arrays(columns, names=[*[batch.schema.names[i] for i in kept], "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "_pairs", "_times"])

    schema = T.StructType([*[docs.schema.fields[i] for i in kept], *T.StructType.fromDDL(_FOUND).fields])
    return mapped(docs, run, schema)


def first_id(pair: Column) -> Column:
    return F.shiftright(pair, ID_BITS)


def second_id(pair: Column) -> Column:
    return pair.bitwiseAND((1 << ID_BITS) - 1)


def pair_counts(found: DataFrame) -> DataFrame:
    """(_pair, n, _best): in how many texts a pair of ids is linked, and whether no pair of its A id is in more."""
    counts = written(found.select(F.explode("_pairs").alias("_pair")).groupBy("_pair").agg(F.count(F.lit(1)).alias("n")), "alignment-counts")
    # A row for each id of the first vocabulary, at most.
    best = counts.groupBy(first_id(F.col("_pair")).alias("_a")).agg(F.max("n").alias("_most"))
    return counts.withColumn("_a", first_id(F.col("_pair"))).join(F.broadcast(best), "_a").select("_pair", "n", (F.col("n") == F.col("_most")).alias("_best"))


def hot_from(counts: DataFrame, most: int = HOT) -> int:
    """The least power of two such that at most ``most`` pairs are in so many texts or more."""
    sizes = dict(counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).count().collect())
    total, least = 0, 64
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > most:
            break
        least = k
    return 1 << min(least, 62)


def token_links(docs: DataFrame, first: bytes, second: bytes, text_column: str = "text", hot: int = HOT) -> DataFrame:
    """``docs`` without their texts, with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    - Null and empty texts, and texts of which either side's tokens do not give back the bytes (a text that holds the
      second vocabulary's blank sign), have no tokens: zeros and an empty groups_sha256. They count in no pair.
    - Texts of any length are encoded whole. Special tokens' strings are plain text.
    - Repeated rows each count as a text. Of pairs with equal counts (ties) all are the best.
    - An empty table gives no rows. Other columns may have any names; those of the added names are replaced.
    """
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    docs = replaced(docs, *names)
    rest = docs.drop(text_column)
    slim = docs.select(whole_row(rest), docs[f"`{text_column}`"].cast("string").alias("_text"))
    found = grouped(slim, first, second, "_text").withColumn("_key", F.monotonically_increasing_id())
    found = written(found, "alignment-pairs", **{"parquet.dictionary.page.size": str(1 << 24), "compression": "zstd"})
    counts = written(pair_counts(found), "alignment-best")
    least = hot_from(counts, hot)
    many, few = counts.filter(F.col("n") >= least), counts.filter(F.col("n") < least)
    links = found.select("_key", F.inline(F.arrays_zip("_pairs", "_times"))).withColumnRenamed("_pairs", "_pair")

    def summed(joined: DataFrame) -> DataFrame:
        return joined.groupBy("_key").agg(F.sum(F.when(F.col("_best"), F.col("_times")).otherwise(0)).alias("n_best"), F.sum(F.col("_times") * F.col("n")).alias("count_sum"))

    # At most ``hot`` rows are broadcast; the other pairs, each in fewer than ``least`` texts, meet by a shuffle.
    common = summed(links.join(F.broadcast(many), "_pair"))
    rare = summed(links.join(F.broadcast(many.select("_pair")), "_pair", "left_anti").join(few.hint("shuffle_hash"), "_pair"))
    sums = common.unionByName(rare).groupBy("_key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = found.select("_row", "_key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "_key", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("_row.*", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
