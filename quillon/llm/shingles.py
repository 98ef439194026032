"""Word-shingle sets of texts as 64-bit hashes, computed over whole batches of bytes at once."""

from __future__ import annotations

import numpy as np

#: Words of one shingle.
SIZE = 5
#: Bytes that are hashed together.
PIECE = 1 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_rng = np.random.Generator(np.random.PCG64(20240817))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 2**63, SIZE + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of lower-cased bytes."""
    raw = np.frombuffer(data, dtype=np.uint8)
    space = _SPACE[raw]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return starts, np.empty(0, dtype=np.uint64)
    sizes = ends - starts
    firsts = np.cumsum(sizes) - sizes
    # Every byte is mixed with its place in the word before they are summed: a sum of powers has words that collide
    # whatever its base is.
    place = (np.arange(int(sizes.sum())) - np.repeat(firsts, sizes)).astype(np.uint64)
    return starts, mixed(np.add.reduceat(mixed(_BYTE[raw[~space]] + place * _STEP), firsts))


def _pieces(data: bytes) -> list[bytes]:
    """A long text cut at white space, so that no piece splits a word."""
    out, at = [], 0
    while len(data) - at > PIECE:
        cut = max(data.rfind(w, at, at + PIECE) for w in (b" ", b"\n", b"\t", b"\r"))
        if cut <= at:
            cut = min((c for c in (data.find(w, at + PIECE) for w in (b" ", b"\n", b"\t", b"\r")) if c >= 0), default=len(data))
        out.append(data[at:cut])
        at = cut
    return [*out, data[at:]]


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles.

    Words are runs outside ASCII white space with A to Z lower-cased. A text with fewer words than a shingle has its
    whole sequence as one; null and texts without words have none.
    """
    out: list[np.ndarray] = []
    some: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal some, size
        if not some:
            return
        joined = b" ".join(some)
        bounds = np.cumsum([len(t) + 1 for t in some])
        starts, words = word_hashes(joined)
        upto = np.searchsorted(starts, bounds)
        first = 0
        shingles = _runs(words) if len(words) >= SIZE else np.empty(0, dtype=np.uint64)
        for last in upto.tolist():
            n = last - first
            out.append(np.unique(shingles[first : last - SIZE + 1]) if n >= SIZE else _short(words[first:last]))
            first = last
        some, size = [], 0

    for t in texts:
        data = (t or "").encode().translate(_LOWER)
        if len(data) > PIECE:
            flush()
            words = np.concatenate([word_hashes(p)[1] for p in _pieces(data)])
            out.append(np.unique(_runs(words)) if len(words) >= SIZE else _short(words))
            continue
        if size + len(data) > PIECE:
            flush()
        some.append(data)
        size += len(data) + 1
    flush()
    return out


def _runs(words: np.ndarray) -> np.ndarray:
    n = len(words) - SIZE + 1
    total = words[:n] * _PLACE[0]
    for k in range(1, SIZE):
        total = total + words[k : k + n] * _PLACE[k]
    return mixed(total)


def _short(words: np.ndarray) -> np.ndarray:
    if not len(words):
        return np.empty(0, dtype=np.uint64)
    total = np.append(words * _PLACE[: len(words)], np.asarray([len(words)], dtype=np.uint64) * _PLACE[SIZE:]).sum(dtype=np.uint64)
    return mixed(np.asarray([total], dtype=np.uint64))
