"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

The pieces and scores of a SentencePiece BPE model are read from its file. Encoding keeps an agenda of adjacent
pairs whose join is a piece, best score first, then leftmost. With dropout, a candidate merge is skipped for good if
its keyed hash falls below the rate; the hash is of the seed, the document's key, the place of the stretch in it and
the pair's place and length, so every occurrence of a word draws merges of its own and a run can be repeated exactly.
A stretch is what no piece reaches across (blanks and the word after them), so stretches are encoded apart.

Texts are encoded a batch at a time in arrays: the batch is cut into stretches, and equal ones are found by sorting
their hashes. The distinct ones of each length go through their merges together, without dropout. An occurrence that
skips none of the merges proposed there takes that result, as its own merges would be the same; each of the others
goes through its own merges, again together by length.

Characters that the model lacks, and the blank sign itself when it occurs in a text, become byte pieces; decoding
joins pieces and bytes and gives back every text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import mapped, replaced

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Stretches of up to this many characters are merged together in arrays, longer ones each by itself.
TOGETHER = 40
#: Documents, and about as many characters, of one batch.
BATCH, BATCH_CHARS, DECODE_BATCH = 1024, 600_000, 512


def read_pieces(data: bytes) -> list[tuple[str, float, int]]:
    """Pieces of a serialized model: text, score, type (1 normal, 2 unknown, 3 control, 6 byte)."""

    def varint(at: int) -> tuple[int, int]:
        value, shift = 0, 0
        while True:
            b = data[at]
            at, value, shift = at + 1, value | (b & 0x7F) << shift, shift + 7
            if b < 0x80:
                return value, at

    def fields(at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
        while at < end:
            tag, at = varint(at)
            if tag & 7 == 0:
                value, at = varint(at)
                yield tag >> 3, value, at, at
            else:
                size, at = {1: (8, at), 5: (4, at)}.get(tag & 7) or varint(at)
                yield tag >> 3, size, at, at + size
                at += size

    pieces = []
    for number, _, start, end in fields(0, len(data)):
        if number != 1:
            continue
        text, score, kind = "", 0.0, 1
        for n, value, s, e in fields(start, end):
            if n == 1:
                text = data[s:e].decode()
            elif n == 2:
                score = float(np.frombuffer(data[s:e], dtype="<f4")[0])
            elif n == 3:
                kind = value
        pieces.append((text, score, kind))
    return pieces


_U = np.uint64
_FAR = np.int32(1 << 30)


_A, _B, _ALL = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 2**64 - 1


def _mix_int(x: int) -> int:
    """``_mix`` of one number."""
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _ALL
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _ALL
    return x ^ x >> 31


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _places(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A number for the merge of the symbols that begin at these places, with these joined lengths."""
    return left.astype(np.uint64) * _U(_A) + right.astype(np.uint64) * _U(_B) + length.astype(np.uint64)


def _spans_hashed(points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each of the stretches that cover the code points: every point is mixed with its place before they are summed."""
    place = np.arange(len(points)) - np.repeat(starts, lengths)
    return _mix(np.add.reduceat(_mix(points.astype(np.uint64) << _U(40) | place.astype(np.uint64)), starts) ^ lengths.astype(np.uint64))


def _differ(points: np.ndarray, starts: np.ndarray, lengths: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Which stretches are not equal, point by point, to the stretches at the places ``like``."""
    there = np.repeat(starts[like] - starts, lengths) + np.arange(len(points))
    wrong = points[np.minimum(there, len(points) - 1)] != points
    return np.flatnonzero((np.add.reduceat(wrong.astype(np.int64), starts) > 0) | (lengths[like] != lengths))


class PairTable:
    """What two adjacent pieces join to: a hash table in arrays, for whole columns of pairs at once."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]], bits: int = 21):
        keys = np.asarray([a << 21 | b for a, b in pairs], dtype=np.uint64)
        values = np.asarray(list(pairs.values()), dtype=np.int32).reshape(-1, 2)
        self.shift = _U(64 - bits)
        for k in range(1, 200):
            self.factors = tuple(_U(int(x) | 1) for x in np.random.Generator(np.random.PCG64(k)).integers(1 << 62, 1 << 63, 2))
            self.slots = [np.zeros(1 << bits, dtype=np.int32) for _ in self.factors]
            rest = np.arange(len(keys))
            for factor, slot in zip(self.factors, self.slots, strict=True):
                at = ((keys[rest] * factor) >> self.shift).astype(np.int64)
                slot[at] = rest + 1
                rest = rest[slot[at] != rest + 1]
            if not len(rest):
                break
        else:
            raise ValueError("no table fits the pairs")
        # Entry 0 is no pair.
        self.keys = np.concatenate([[_U(2**64 - 1)], keys])
        self.ranks = np.concatenate([[_FAR], values[:, 0]]).astype(np.int32)
        self.joins = np.concatenate([[-1], values[:, 1]]).astype(np.int32)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (far if there is none) and joined piece of each pair."""
        keys = a.astype(np.uint64) << _U(21) | b.astype(np.uint64)
        at = self.slots[0][(keys * self.factors[0]) >> self.shift]
        wrong = self.keys[at] != keys
        if wrong.any():
            other = self.slots[1][(keys[wrong] * self.factors[1]) >> self.shift]
            at[wrong] = np.where(self.keys[other] == keys[wrong], other, 0)
        return self.ranks[at], self.joins[at]


class PieceCoder:
    """Encoder and decoder of one model at one dropout rate and seed."""

    def __init__(self, data: bytes, dropout: float = 0.1, seed: int = 1, encodes: bool = True):
        """``encodes=False`` leaves out the tables that only encoding needs."""
        pieces = read_pieces(data)
        self.dropout, self.seed = dropout, seed
        self.limit = _U(round(dropout * 2**32))
        normal = {t: i for i, (t, _, kind) in enumerate(pieces) if kind == 1}
        self.byte_ids = [0] * 256
        for i, (t, _, kind) in enumerate(pieces):
            if kind == 6:
                self.byte_ids[int(t[1:-1], 16)] = i
        if len(set(self.byte_ids)) != 256:
            raise ValueError("the model has no pieces for bytes")
        self.texts = [t.replace(BLANK, " ").encode() if kind == 1 else b"" for t, _, kind in pieces]
        for b, i in enumerate(self.byte_ids):
            self.texts[i] = bytes([b])
        long_pieces = [t for t in normal if len(t) > 1]
        if any(BLANK in t.lstrip(BLANK) for t in long_pieces):
            raise ValueError("a piece reaches across a blank")
        # Line ends stand alone if no longer piece holds one.
        apart = "".join(c for c in "\n\r\t" if not any(c in t for t in long_pieces))
        self.apart = [ord(c) for c in apart]
        # Characters without a piece get ids of their own beyond the pieces; they join with nothing.
        self.n_pieces = len(pieces)
        if not encodes:
            return
        order = sorted(normal, key=lambda t: (-pieces[normal[t]][1], normal[t]))
        ranks = {t: r for r, t in enumerate(order)}
        self.id_of = np.arange(0x110000, dtype=np.int32) + self.n_pieces
        for t, i in normal.items():
            if len(t) == 1:
                self.id_of[ord(t)] = i
        self.id_of[ord(BLANK)] = self.n_pieces + ord(BLANK)
        self.id_of[ord(" ")] = normal.get(BLANK, self.n_pieces + ord(" "))
        splits = {(normal[t[:k]], normal[t[k:]]): (ranks[t], normal[t]) for t in long_pieces for k in range(1, len(t)) if t[:k] in normal and t[k:] in normal}
        self.pairs = {a << 21 | b: r << 20 | i for (a, b), (r, i) in splits.items()}
        self.table = PairTable(splits)

    def _keys(self, draws: np.ndarray) -> np.ndarray:
        """A key for each occurrence's number, under the seed."""
        return _mix(draws.astype(np.uint64) * _U(0xD6E8FEB86659FD93) + _U(self.seed * 0xA0761D6478BD642F % 2**64))

    def _dropped(self, keys: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Whether the merges at these places are skipped."""
        return _mix(keys ^ places) >> _U(32) < self.limit

    def _spelled(self, ids: list[int]) -> list[int]:
        """Ids in which those of characters without a piece become their bytes."""
        return [y for x in ids for y in ([x] if x < self.n_pieces else [self.byte_ids[c] for c in chr(x - self.n_pieces).encode()])]

    def encode_stretch(self, stretch: str, draw: int | None) -> list[int]:
        """Ids of one stretch, by an agenda of candidate merges; for stretches of any length. Without a draw none is skipped."""
        points = np.frombuffer(stretch.encode("utf-32-le"), dtype=np.uint32)
        symbols: list[int] = self.id_of[points].tolist()
        n, find = len(symbols), self.pairs.get
        after, before, length = list(range(1, n + 1)), list(range(-1, n - 1)), [1] * n
        drops, limit = self.dropout > 0 and draw is not None, int(self.limit)
        key = int(self._keys(np.asarray([draw], dtype=np.uint64))[0]) if drops else 0
        agenda: list[tuple[int, int, int, int, int]] = []

        def propose(a: int, b: int) -> None:
            found = find(symbols[a] << 21 | symbols[b])
            if found is None or drops and _mix_int(key ^ (a * _A + b * _B + length[a] + length[b] & _ALL)) >> 32 < limit:
                return
            heappush(agenda, (found >> 20, a, b, found & 0xFFFFF, length[a] + length[b]))

        for i in range(n - 1):
            propose(i, i + 1)
        while agenda:
            _, a, b, joined, size = heappop(agenda)
            # A merge whose pair has changed since is stale.
            if after[a] != b or length[a] + length[b] != size:
                continue
            symbols[a], symbols[b], length[a], length[b] = joined, -1, size, 0
            c = after[a] = after[b]
            after[b] = -1
            if c < n:
                before[c] = a
                propose(a, c)
            if before[a] >= 0:
                propose(before[a], a)
        return self._spelled([x for x in symbols if x >= 0])

    def _together(self, points: np.ndarray, draws: np.ndarray | None, proposed: list[tuple[np.ndarray, np.ndarray]] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches of equal length, as rows of code points, one after the other, and their numbers.

        A round makes the best merge of every row that has one. Without draws no merge is skipped; ``proposed`` takes
        the rows and places of all candidate merges.
        """
        count, n = points.shape
        drops = self.dropout > 0 and draws is not None
        symbols = self.id_of[points]
        if n > 1:
            keys = self._keys(draws) if drops else None
            after = np.tile(np.arange(1, n + 1, dtype=np.int16), (count, 1))
            before, length = after - np.int16(2), np.ones_like(after)
            rank, joined = self.table.find(symbols[:, :-1].reshape(-1), symbols[:, 1:].reshape(-1))
            rank, joined = rank.reshape(count, n - 1), joined.reshape(count, n - 1)
            if drops or proposed is not None:
                r, i = np.nonzero(rank < _FAR)
                places = _places(i, i + 1, np.full(len(i), 2))
                if drops:
                    lost = self._dropped(keys[r], places)
                    rank[r[lost], i[lost]] = _FAR
                if proposed is not None:
                    proposed.append((r, places))
            rows = np.arange(count)
            while len(rows):
                best = rank[rows].argmin(1)
                alive = rank[rows, best] < _FAR
                rows, a = rows[alive], best[alive]
                if not len(rows):
                    break
                b = after[rows, a].astype(np.int64)
                symbols[rows, a], symbols[rows, b] = joined[rows, a], -1
                length[rows, a] += length[rows, b]
                c = after[rows, b].astype(np.int64)
                after[rows, a] = c
                inner = c < n
                before[rows[inner], c[inner]] = a[inner]
                # The pair that began at the right part is gone; those on both sides of the joined one are new.
                here = b < n - 1
                rank[rows[here], b[here]] = _FAR
                rank[rows[~inner], np.minimum(a[~inner], n - 2)] = _FAR
                p = before[rows, a].astype(np.int64)
                outer = p >= 0
                row2 = np.concatenate([rows[inner], rows[outer]])
                left = np.concatenate([a[inner], p[outer]])
                right = np.concatenate([c[inner], a[outer]])
                found, to = self.table.find(symbols[row2, left], symbols[row2, right])
                if drops or proposed is not None:
                    real = np.flatnonzero(found < _FAR)
                    row3, left3, right3 = row2[real], left[real], right[real]
                    places = _places(left3, right3, length[row3, left3] + length[row3, right3])
                    if drops:
                        found[real[self._dropped(keys[row3], places)]] = _FAR
                    if proposed is not None:
                        proposed.append((row3, places))
                rank[row2, left], joined[row2, left] = found, to
        real = symbols >= 0
        ids, sizes = symbols[real], real.sum(1)
        if (ids >= self.n_pieces).any():
            rows = [self._spelled(r[r >= 0].tolist()) for r in symbols]
            ids, sizes = np.asarray([x for r in rows for x in r], dtype=np.int32), np.asarray([len(r) for r in rows])
        return ids, sizes

    def _cut(self, points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Where stretches begin: at texts, at blanks after something else, and around characters that stand alone."""
        blank = points == 32
        begins = blank & ~np.concatenate([[False], blank[:-1]])
        for c in self.apart:
            alone = points == c
            begins |= alone
            begins[1:] |= alone[:-1]
        begins[firsts] = True
        return np.flatnonzero(begins)

    def encode_batch(self, texts: list[str], keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and where each text's begin and the last one's end.

        A key names its text; each stretch of it draws its own merges. An empty text has no ids.
        """
        sizes = np.asarray([len(t) + 1 if t else 0 for t in texts], dtype=np.int64)
        points = np.frombuffer("".join([" " + t for t in texts if t]).encode("utf-32-le"), dtype=np.uint32)
        if not len(points):
            return np.empty(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        starts = self._cut(points, bounds[:-1][sizes > 0])
        lengths = np.diff(np.append(starts, len(points)))
        owner = np.searchsorted(bounds, starts, side="right") - 1
        place = np.arange(len(starts)) - np.searchsorted(starts, bounds[:-1])[owner]
        draws = _mix(_mix(np.asarray([k % 2**64 for k in keys], dtype=np.uint64)[owner] + _U(self.seed)) + place.astype(np.uint64))
        # Equal hashes find equal stretches; their code points make sure of it.
        _, rep, which = np.unique(_spans_hashed(points, starts, lengths), return_index=True, return_inverse=True)
        odd = _differ(points, starts, lengths, rep[which])
        if len(odd):
            which[odd] = len(rep) + np.arange(len(odd))
            rep = np.concatenate([rep, odd])
        # Long stretches hardly ever skip nothing, so with dropout each is encoded for itself.
        own = lengths > TOGETHER if self.dropout > 0 else np.zeros(len(starts), dtype=bool)
        shared = np.flatnonzero(~own[rep])
        proposed: list[tuple[np.ndarray, np.ndarray]] | None = [] if self.dropout > 0 else None
        parts, n_ids = self._encoded(points, starts[rep[shared]], lengths[rep[shared]], None, proposed)
        unit = np.zeros(len(rep), dtype=np.int64)
        unit[shared] = np.arange(len(shared))
        unit = unit[which]
        if proposed is not None:
            own |= self._varied(proposed, len(shared), unit, np.flatnonzero(~own), draws)
            alone = np.flatnonzero(own)
            unit[alone] = len(shared) + np.arange(len(alone))
            more, more_ids = self._encoded(points, starts[alone], lengths[alone], draws[alone], None)
            parts, n_ids = np.concatenate([parts, more]), np.concatenate([n_ids, more_ids])
        # What each unit gives is put where the stretches ask for it.
        at = np.cumsum(n_ids) - n_ids
        counts = n_ids[unit]
        ends = np.cumsum(counts)
        out = parts[np.repeat(at[unit] - (ends - counts), counts) + np.arange(int(ends[-1]))]
        return out, np.concatenate([[0], ends])[np.searchsorted(starts, bounds)]

    def _encoded(self, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray, draws: np.ndarray | None, proposed: list[tuple[np.ndarray, np.ndarray]] | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these stretches one after the other, and their numbers; those of one length are merged together."""
        parts: list[np.ndarray] = []
        n_ids, at, total = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.int64), 0
        by_length = np.argsort(lengths, kind="stable")
        edges = np.flatnonzero(np.diff(lengths[by_length], prepend=-1, append=-1))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            n = int(lengths[by_length[lo]])
            step = 30_000 if n <= TOGETHER else 1
            for first in range(lo, hi, step):
                some = by_length[first : min(hi, first + step)]
                if n <= TOGETHER:
                    found: list[tuple[np.ndarray, np.ndarray]] | None = None if proposed is None else []
                    ids, counts = self._together(points[starts[some][:, None] + np.arange(n)], None if draws is None else draws[some], found)
                    if proposed is not None:
                        proposed.extend((some[rows], places) for rows, places in found or [])
                else:
                    begin = int(starts[some[0]])
                    ids = np.asarray(self.encode_stretch(points[begin : begin + n].tobytes().decode("utf-32-le"), None if draws is None else int(draws[some[0]])), dtype=np.int32)
                    counts = np.asarray([len(ids)])
                parts.append(ids)
                n_ids[some], at[some] = counts, total + np.cumsum(counts) - counts
                total += len(ids)
        flat = np.concatenate([np.empty(0, dtype=np.int32), *parts])
        ends = np.cumsum(n_ids)
        return flat[np.repeat(at - (ends - n_ids), n_ids) + np.arange(total)], n_ids

    def _varied(self, proposed: list[tuple[np.ndarray, np.ndarray]], n_units: int, unit: np.ndarray, asked: np.ndarray, draws: np.ndarray) -> np.ndarray:
        """Which of the occurrences asked for skip a merge that their stretch proposes without dropout."""
        out = np.zeros(len(unit), dtype=bool)
        if not proposed:
            return out
        rows = np.concatenate([r for r, _ in proposed])
        order = np.argsort(rows, kind="stable")
        places = np.concatenate([p for _, p in proposed])[order]
        counts = np.bincount(rows, minlength=n_units)
        firsts, keys = np.cumsum(counts) - counts, self._keys(draws)
        for lo in range(0, len(asked), 100_000):
            some = asked[lo : lo + 100_000]
            n = counts[unit[some]]
            occurrence = np.repeat(some, n)
            within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out[occurrence[self._dropped(keys[occurrence], places[firsts[unit[occurrence]] + within])]] = True
        return out

    def encode(self, text: str, key: int = 0) -> list[int]:
        return self.encode_batch([text], [key])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids; of foreign ids, bytes that are not UTF-8 become replacement characters."""
        return b"".join(map(self.texts.__getitem__, ids)).decode(errors="replace")[1:]


def _key(key: object, text: str | None) -> int:
    """A number for a document: its key if that is one, else a digest of the key, or of the text if the key is null."""
    if isinstance(key, int):
        return key
    return int.from_bytes(hashlib.blake2b(((text or "") if key is None else str(key)).encode(), digest_size=8).digest(), "little")


@lru_cache(maxsize=2)
def _coder(data: bytes, dropout: float, seed: int, encodes: bool = True) -> PieceCoder:
    """A coder of this Python worker, kept from task to task."""
    return PieceCoder(data, dropout, seed, encodes=encodes)


def _bounded(whole: pa.RecordBatch, place: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with bounded documents and characters; a longer document stands alone."""
    first, chars = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(whole.column(place)), 0).to_pylist()):
        if i > first and (i - first >= BATCH or chars + n > BATCH_CHARS):
            yield whole.slice(first, i - first)
            first, chars = i, 0
        chars += n
    if first < whole.num_rows:
        yield whole.slice(first)


def encode_pieces(docs: DataFrame, model: bytes, dropout: float = 0.1, seed: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with _ids.

    - A null text has null ids, an empty one none. A null id draws by the text; ids that are no numbers draw by their digest.
    - Texts of any length are encoded whole; a stretch of many characters costs a little more than time in proportion.
    - Ties between merges go to the leftmost. Rows with equal id and text agree.
    - An empty table gives no rows. Other columns may have any names; _ids, in any case, is replaced.
    """
    docs = replaced(docs, "_ids")
    place, key_at = docs.columns.index(text_column), docs.columns.index(id_column)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value, dropout, seed)
        for whole in batches:
            for batch in _bounded(whole, place):
                texts = batch.column(place).to_pylist()
                ids, ends = coder.encode_batch([t or "" for t in texts], [_key(k, t) for k, t in zip(batch.column(key_at).to_pylist(), texts, strict=True)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()), mask=pa.array([t is None for t in texts]))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "_ids"])

    return mapped(docs, run, T.StructType([*docs.schema.fields, T.StructField("_ids", T.ArrayType(T.IntegerType()))]))


def decode_pieces(encoded: DataFrame, model: bytes, ids_column: str = "_ids", to: str = "_decoded") -> DataFrame:
    """``encoded`` with the texts of its ids.

    - Null ids give null, no ids an empty text. Lists of any length are decoded whole, repeated rows alike.
    - Ids that this model's encoder cannot give may decode to replacement characters.
    - An empty table gives no rows. Other columns may have any names; one of the added name is replaced.
    """
    encoded = replaced(encoded, to)
    place = encoded.columns.index(ids_column)
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value, 0.0, 0, False)
        for whole in batches:
            for first in range(0, whole.num_rows, DECODE_BATCH):
                batch = whole.slice(first, DECODE_BATCH)
                lists = batch.column(place)
                flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
                known = lists.is_valid().to_pylist()
                texts = [coder.decode(flat[a:b].tolist()) if ok else None for ok, a, b in zip(known, ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, to])

    return mapped(encoded, run, T.StructType([*encoded.schema.fields, T.StructField(to, T.StringType())]))
