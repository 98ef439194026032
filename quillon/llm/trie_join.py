"""N-gram Jaccard join: prefix trees over globally ordered shingle sets.

Documents link if their sets of word shingles have a Jaccard similarity of the threshold or more; the join returns
the connected components of these links, and loses none.

1. Equal sets form a class (a digest of the set); from here on classes are compared, not documents.
2. All documents' shingles are counted by the first 32 bits of their hash. The count's magnitude, then the hash, is
   the global order: common shingles come last. The order only steers the work; any order gives the same links.
   Fewer bits would fill with the input until common shingles no longer stand out; then many classes post them, and
   ties of these grow into components of a large part of the corpus.
3. Two sets that link share shingles among their first (1 - threshold) parts in that order, the more the closer their
   sizes are. Each class posts these shingles; for each posted shingle of few classes all pairs of fitting sizes are
   counted, for one of many classes neighbours by size are tied together. Pairs with enough shared shingles and ties
   are candidates; their components hold every link.
4. Each candidate component is joined by a prefix tree: its sets, in the order of their shingles' frequency there,
   are stored in a radix tree; a probe walks it, sharing the overlap of common prefixes, and leaves subtrees whose
   remaining lengths cannot reach the threshold. Sets that link leave the tree and are probed in turn, so a group of
   near copies costs little more than one walk. A component too large for a task is split into blocks, and each pair
   of blocks is joined.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import mapped, whole_row, written
from .shingles import shingle_sets

#: The threshold as a fraction: 4 / 5.
NUM, DEN = 4, 5
#: Bits of a hash that name its cell in the frequency count, and blocks of cells.
CELL_BITS, BLOCK_BITS = 32, 10
#: Cells that a task counts before it passes them on.
HELD_CELLS = 1 << 22
#: A cell of at least so many documents is common; the most common ones, at most so many, reach the driver.
COMMON, MOST_COMMON = 8, 1 << 22
#: Blocks of a sieve.
BLOCKS = 256
#: Bits of a sieve of rows: about 16 for each row, within these bounds.
LEAST_SIEVE, MOST_SIEVE = 24, 28
#: A shingle posted by up to this many classes has its pairs counted.
FEW = 24
#: Postings of one bucket, and shingles of one block of a component, are about this many.
BUCKET_POSTINGS, BLOCK_SHINGLES = 1 << 20, 1 << 22
#: Postings that a task holds before it passes them on.
HELD_POSTINGS = 1 << 19
#: Classes with the most copies, at most so many, post once only.
MOST_COPIED = 4096
BATCH = 2048
_TIE = 1 << 20


def least_overlap(a, b):
    """Shingles that two linked sets of these sizes share at least: overlap / (a + b - overlap) >= NUM / DEN."""
    return -(-NUM * (a + b) // (NUM + DEN))


def prefix_length(n):
    """Of n ordered shingles, so many first ones cannot all be missing from a linked set."""
    return n - -(-NUM * n // DEN) + 1


def least_shared(a, b):
    """Shingles that two linked sets share at least among the first ones of both."""
    over = least_overlap(a, b)
    return np.maximum(1, np.minimum(over - a + prefix_length(a), over - b + prefix_length(b)))


def digest(shingles: np.ndarray) -> bytes:
    return blake2b(shingles.tobytes(), digest_size=16).digest()


def class_key(d: bytes) -> int:
    """The first 64 bits of a digest, as Spark holds them. Two classes that share them are only compared needlessly."""
    return int.from_bytes(d[:8], "little", signed=True)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list]]:
    for whole in batches:
        for first in range(0, whole.num_rows, BATCH):
            batch = whole.slice(first, BATCH)
            yield batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()


def _cells(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(64 - CELL_BITS)).astype(np.uint32)


def _packed(x: bytes) -> bytes:
    return zlib.compress(x, 1)


def pack_counts(cells: np.ndarray, counts: np.ndarray, block: int) -> bytes:
    """Ascending cells of a block with their counts: differences by planes of bytes, which are mostly zeros above."""
    steps = np.diff(cells.astype(np.int64), prepend=block << (CELL_BITS - BLOCK_BITS)).astype("<u4")
    return _packed(steps.view(np.uint8).reshape(-1, 4).T.tobytes() + np.minimum(counts, 65535).astype("<u2").tobytes())


def unpack_counts(packed: bytes, block: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zlib.decompress(packed), dtype=np.uint8)
    n = len(raw) // 6
    steps = np.ascontiguousarray(raw[: 4 * n].reshape(4, n).T).view("<u4").reshape(-1)
    return (np.cumsum(steps, dtype=np.int64) + (block << (CELL_BITS - BLOCK_BITS))).astype(np.uint32), raw[4 * n :].view("<u2").astype(np.int64)


def _survey(docs: DataFrame) -> DataFrame:
    """One scan of (_id, _mark, _text): a row for each document (_id, _mark, _n, _digest, _key), and rows of counts (_block, _counts)."""
    columns = ["_id", "_mark", "_n", "_digest", "_key", "_block", "_counts"]

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        cells, counts = np.unique(np.concatenate(held), return_counts=True)
        block = (cells >> np.uint32(CELL_BITS - BLOCK_BITS)).astype(np.int32)
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        ends, k = np.append(starts[1:], len(cells)), len(starts)
        packed = [pack_counts(cells[i:j], counts[i:j], int(block[i])) for i, j in zip(starts, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64()), pa.array(block[starts], pa.int32()), pa.array(packed, pa.binary())], names=columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0
        for ids, marks, texts in _texts(batches):
            sets = shingle_sets(texts)
            held.append(_cells(np.concatenate(sets)))
            n_held += len(held[-1])
            digests = [digest(s) if len(s) else None for s in sets]
            none = pa.nulls(len(ids), pa.int32())
            keys = [None if d is None else class_key(d) for d in digests]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.int64()), none, pa.nulls(len(ids), pa.binary())], names=columns)
            if n_held >= HELD_CELLS:
                yield counted(held)
                held, n_held = [], 0
        if n_held:
            yield counted(held)

    return mapped(docs, run, "_id bigint, _mark bigint, _n bigint, _digest binary, _key bigint, _block int, _counts binary")


def _levels(survey: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """The common cells, ascending, and for each the magnitude of its count above what chance fills it with."""
    mean = total / (1 << CELL_BITS)
    usual = max(COMMON, mean + 4 * mean**0.5 + 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed: dict[int, list[bytes]] = {}
        for batch in batches:
            for b, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packed.setdefault(b, []).append(c)
        for b in list(packed):
            cells, counts = (np.concatenate(x) for x in zip(*(unpack_counts(c, b) for c in packed.pop(b)), strict=True))
            order = np.argsort(cells, kind="stable")
            cells, counts = cells[order], counts[order]
            first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
            cells, counts = cells[first], np.add.reduceat(counts, first)
            common = counts >= usual
            cells, level = cells[common], (2 * np.log2(counts[common] - mean)).astype(np.uint8)
            some = np.unique(level)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([int((level == x).sum()) for x in some], pa.int64()), pa.array([_packed(cells[level == x].tobytes()) for x in some], pa.binary())], names=["_level", "_n", "_cells"])

    # A task adds up the counts of its blocks, one block at a time.
    tasks = min(1 << BLOCK_BITS, max(64, int(survey.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    found = written(mapped(survey.filter("_block is not null").select("_block", "_counts").repartition(tasks, "_block"), run, "_level int, _n bigint, _cells binary"), "common")
    least, n = 256, 0
    for r in found.groupBy("_level").agg(F.sum("_n").alias("_n")).orderBy(F.desc("_level")).collect():
        n += r["_n"]
        if n > MOST_COMMON:
            break
        least = r["_level"]
    rows = found.filter(F.col("_level") >= least).collect()
    parts = [np.frombuffer(zlib.decompress(r["_cells"]), dtype=np.uint32) for r in rows]
    cells = np.concatenate([np.empty(0, dtype=np.uint32), *parts])
    levels = np.concatenate([np.empty(0, dtype=np.uint8), *(np.full(len(p), r["_level"], dtype=np.uint8) for p, r in zip(parts, rows, strict=True))])
    order = np.argsort(cells)
    return cells[order], levels[order]


def level_of(cells: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The levels of cells, 0 for those that are not common."""
    known, levels = common
    if not len(known):
        return np.zeros(len(cells), dtype=np.uint8)
    at = np.minimum(np.searchsorted(known, cells), len(known) - 1)
    return np.where(known[at] == cells, levels[at], 0)


def _postings(docs: DataFrame, levels: tuple[np.ndarray, np.ndarray], copied: dict[bytes, tuple[int | None, int]], buckets: int) -> DataFrame:
    """Rows (_bucket, _shingles, _classes, _sizes) of packed arrays: the first shingles of each class in the order."""
    shared = docs.sparkSession.sparkContext.broadcast((levels, copied))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, copied = shared.value
        held: list[tuple[np.ndarray, int, int]] = []
        n_held, here = 0, set()

        def flush() -> pa.RecordBatch:
            nonlocal held, n_held
            shingles = np.concatenate([s for s, _, _ in held])
            times = [len(s) for s, _, _ in held]
            classes = np.repeat(np.asarray([c for _, c, _ in held], dtype=np.int64), times)
            sizes = np.repeat(np.asarray([n for _, _, n in held], dtype=np.int32), times)
            bucket = (shingles % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
            parts = [(b, order[bounds[b] : bounds[b + 1]]) for b in range(buckets) if bounds[b] < bounds[b + 1]]
            held, n_held = [], 0
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in parts], pa.int32()), *(pa.array([x[p].tobytes() for _, p in parts], pa.binary()) for x in (shingles, classes, sizes))], names=["_bucket", "_shingles", "_classes", "_sizes"])

        for ids, marks, texts in _texts(batches):
            for i, mark, s in zip(ids, marks, shingle_sets(texts), strict=True):
                if not len(s):
                    continue
                d = digest(s)
                if d in here or (d in copied and copied[d] != (i, mark)):
                    continue
                if len(here) < 100_000:
                    here.add(d)
                level = level_of(_cells(s), levels)
                first = s[np.argsort(level, kind="stable")[: prefix_length(len(s))]]
                held.append((first, class_key(d), len(s)))
                n_held += len(first)
            if n_held >= HELD_POSTINGS:
                yield flush()
        if held:
            yield flush()

    return mapped(docs, run, "_bucket int, _shingles binary, _classes binary, _sizes binary")


def pairs_of(shingles: np.ndarray, classes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (a, b, size of a, size of b, shared) of classes that post the same shingles; ties count as very many."""
    order = np.lexsort((classes, sizes, shingles))
    shingles, classes, sizes = shingles[order], classes[order], sizes[order].astype(np.int64)
    fresh = np.ones(len(shingles), dtype=bool)
    fresh[1:] = (shingles[1:] != shingles[:-1]) | (classes[1:] != classes[:-1])
    shingles, classes, sizes = shingles[fresh], classes[fresh], sizes[fresh]
    starts = np.flatnonzero(np.concatenate([[True], shingles[1:] != shingles[:-1]])) if len(shingles) else np.empty(0, dtype=np.int64)
    lengths = np.diff(np.append(starts, len(shingles)))
    left, right, weight = [], [], []
    for g in range(2, FEW + 1):
        at = starts[lengths == g]
        if not len(at):
            continue
        i, j = np.triu_indices(g, 1)
        a, b = (at[:, None] + i).reshape(-1), (at[:, None] + j).reshape(-1)
        fits = DEN * sizes[a] >= NUM * sizes[b]
        left.append(a[fits])
        right.append(b[fits])
        weight.append(np.ones(fits.sum(), dtype=np.int64))
    many = lengths > FEW
    if many.any():
        inside = np.repeat(many, lengths)
        inside[starts + lengths - 1] = False
        a = np.flatnonzero(inside)
        a = a[DEN * sizes[a] >= NUM * sizes[a + 1]]
        left.append(a)
        right.append(a + 1)
        weight.append(np.full(len(a), _TIE, dtype=np.int64))
    if not left:
        empty = np.empty(0, dtype=np.int64)
        return empty, empty, empty, empty, empty
    a, b, w = (np.concatenate(x) for x in (left, right, weight))
    swap = classes[a] > classes[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    order = np.lexsort((classes[b], classes[a]))
    a, b, w = a[order], b[order], w[order]
    first = np.flatnonzero(np.concatenate([[True], (classes[a][1:] != classes[a][:-1]) | (classes[b][1:] != classes[b][:-1])]))
    return classes[a[first]], classes[b[first]], sizes[a[first]], sizes[b[first]], np.add.reduceat(w, first)


def _shared_counts(postings: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[bytes]] = [[], [], []]
        for batch in batches:
            for k in range(3):
                parts[k] += batch.column(k + 1).to_pylist()
        kinds = (np.uint64, np.int64, np.int32)
        found = pairs_of(*(np.frombuffer(b"".join(p), dtype=t) for p, t in zip(parts, kinds, strict=True)))
        for first in range(0, len(found[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[first : first + 100_000]) for x in found], names=["_a", "_b", "_na", "_nb", "_shared"])

    return mapped(postings.repartition(buckets, "_bucket"), run, "_a bigint, _b bigint, _na bigint, _nb bigint, _shared bigint")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (_a, _b): (_v, _root), the root being the least vertex.

    Large-star and small-star rounds, each written to the shared folder, until nothing changes.
    """
    edges = written(edges.filter("_a <> _b").select(F.greatest("_a", "_b").alias("_a"), F.least("_a", "_b").alias("_b")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
        least = both.groupBy("_a").agg(F.min("_b").alias("_m")).select(F.col("_a").alias("_u"), F.least("_a", "_m").alias("_m"))
        large = both.join(least, both["_a"] == least["_u"]).filter("_b > _a").select(F.col("_b").alias("_a"), F.col("_m").alias("_b"))
        large = large.filter("_a <> _b").distinct()
        lower = large.groupBy("_a").agg(F.min("_b").alias("_m")).select(F.col("_a").alias("_u"), "_m")
        joined = large.join(lower, large["_a"] == lower["_u"])
        small = joined.select(F.col("_b").alias("_a"), F.col("_m").alias("_b")).unionByName(lower.select(F.col("_u").alias("_a"), F.col("_m").alias("_b")))
        edges = written(small.filter("_a <> _b").distinct(), "edges")
        new = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("_a", "_b").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    return edges.select(F.col("_a").alias("_v"), F.col("_b").alias("_root")).unionByName(edges.select(F.col("_b").alias("_v"), F.col("_b").alias("_root")).distinct())


class PrefixTree:
    """A radix tree over ordered sets; a node holds its part of the path and bounds of the sets below it."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int]):
        self.sets, self.sizes = sets, sizes
        order = sorted(range(len(sets)), key=lambda i: sets[i].tolist())
        # Node columns: path part, children, sets that end here, parent, live sets below, least size, longest rest.
        self.part: list[np.ndarray] = [np.empty(0, dtype=np.int64)]
        self.children: list[list[int]] = [[]]
        self.ends: list[list[int]] = [[]]
        self.parent, self.live, self.least, self.rest = [-1], [0], [1 << 60], [0]
        self.node_of = [0] * len(sets)
        self._build(0, 0, order)

    def _build(self, root: int, depth: int, order: list[int]) -> None:
        """Hang the sets, in order, below a node at this depth."""
        todo = [(root, depth, order)]
        while todo:
            node, depth, order = todo.pop()
            self.live[node], self.least[node] = len(order), min(self.sizes[i] for i in order) if order else 1 << 60
            self.rest[node] = max((len(self.sets[i]) for i in order), default=0) - depth
            at = 0
            while at < len(order) and len(self.sets[order[at]]) == depth:
                self.ends[node].append(order[at])
                self.node_of[order[at]] = node
                at += 1
            while at < len(order):
                first, upto = self.sets[order[at]], at + 1
                while upto < len(order) and self.sets[order[upto]][depth] == first[depth]:
                    upto += 1
                last = self.sets[order[upto - 1]]
                # First and last of a sorted run share what all of it shares.
                n = min(len(first), len(last)) - depth
                unlike = np.flatnonzero(first[depth : depth + n] != last[depth : depth + n])
                common = int(unlike[0]) if len(unlike) else n
                child = len(self.part)
                self.part.append(first[depth : depth + common])
                self.children.append([])
                self.ends.append([])
                self.parent.append(node)
                self.live.append(0)
                self.least.append(0)
                self.rest.append(0)
                self.children[node].append(child)
                todo.append((child, depth + common, order[at:upto]))
                at = upto

    def remove(self, i: int) -> None:
        node = self.node_of[i]
        self.ends[node].remove(i)
        while node >= 0:
            self.live[node] -= 1
            node = self.parent[node]

    def linked(self, i: int, mask: np.ndarray) -> list[int]:
        """Live sets that link with set i; ``mask`` is false everywhere and is given back so."""
        own, n = self.sets[i], self.sizes[i]
        mask[own] = True
        found, walk = [], [(0, 0)]
        while walk:
            node, overlap = walk.pop()
            for j in self.ends[node]:
                if DEN * overlap >= NUM * (n + self.sizes[j] - overlap):
                    found.append(j)
            for child in self.children[node]:
                if not self.live[child]:
                    continue
                part = self.part[child]
                shared = overlap + int(np.count_nonzero(mask[part]))
                left = len(own) - int(np.searchsorted(own, part[-1], side="right"))
                if shared + min(left, self.rest[child]) >= least_overlap(n, self.least[child]):
                    walk.append((child, shared))
        mask[own] = False
        return found


def link_sets(sets: list[np.ndarray]) -> list[int]:
    """For each set the number of its component: the index of one of its members."""
    if len(sets) == 2:
        a, b = sets
        shared = len(np.intersect1d(a, b, assume_unique=True))
        return [0, 0 if DEN * shared >= NUM * (len(a) + len(b) - shared) else 1]
    tokens, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # The order here: most frequent first, so that paths are shared. A shingle of one set only overlaps with nothing.
    rank = np.empty(len(tokens), dtype=np.int64)
    rank[np.argsort(-times, kind="stable")] = np.arange(len(tokens))
    n_shared = int((times > 1).sum())
    bounds = np.cumsum([0, *map(len, sets)])
    ordered = []
    for k in range(len(sets)):
        r = np.sort(rank[place[bounds[k] : bounds[k + 1]]])
        ordered.append(r[: np.searchsorted(r, n_shared)])
    tree, mask = PrefixTree(ordered, [len(s) for s in sets]), np.zeros(max(n_shared, 1), dtype=bool)
    root = [-1] * len(sets)
    for seed in range(len(sets)):
        if root[seed] >= 0:
            continue
        root[seed] = seed
        tree.remove(seed)
        queue = [seed]
        while queue:
            for j in tree.linked(queue.pop(), mask):
                root[j] = seed
                tree.remove(j)
                queue.append(j)
    return root


def _sieve(rows: DataFrame) -> np.ndarray:
    """Bits, bounded in number, set where one of the rows (_id, _mark) falls. It thins out what is shuffled, and decides nothing."""
    bits = min(MOST_SIEVE, max(LEAST_SIEVE, int(16 * rows.count()).bit_length()))
    per_block = (1 << bits) // BLOCKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(b, np.zeros(per_block, dtype=bool))[cell] = True
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([np.packbits(x).tobytes() for x in found.values()], pa.binary())], names=["_block", "_bits"])

    cell = F.pmod(F.xxhash64("_id", "_mark"), F.lit(1 << bits))
    cells = rows.select((cell / per_block).cast("int").alias("_block"), (cell % per_block).cast("int").alias("_cell")).distinct()
    sieve = np.zeros(1 << bits, dtype=bool)
    tasks = min(BLOCKS, max(64, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    for r in cells.repartition(tasks, "_block").mapInArrow(run, "_block int, _bits binary").collect():
        sieve[r["_block"] * per_block : (r["_block"] + 1) * per_block] = np.unpackbits(np.frombuffer(r["_bits"], dtype=np.uint8)).astype(bool)
    return np.packbits(sieve)


def _caught(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the rows with these hashes may be among those of the sieve."""
    at = hashes & (len(bits) * 8 - 1)
    return (bits[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)


def _sifted(slim: DataFrame, sieve: np.ndarray) -> DataFrame:
    """The rows of (_id, _mark, _text) that may be among those of the sieve."""
    shared = slim.sparkSession.sparkContext.broadcast(sieve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            kept = batch.filter(pa.array(_caught(bits, batch.column(3).to_numpy(zero_copy_only=False))))
            yield kept.select(["_id", "_mark", "_text"])

    return mapped(slim.select("_id", "_mark", "_text", F.xxhash64("_id", "_mark")), run, "_id bigint, _mark bigint, _text string")


def mark_of(text: Column) -> Column:
    """A number that tells apart the texts of rows with one id."""
    return F.xxhash64(text)


def without_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one row of each group of linked documents: that of least id (null last), then least mark of its text.

    Of rows with equal id and text, linked or not, one stays: the least by all columns. Documents without words link
    with nothing and so stay. An empty table gives no rows; texts of any length are compared whole; other columns may
    have any names. Only rows that a sieve of dropped and repeated ones catches are shuffled.
    """
    found = written(near_duplicates(docs, id_column, text_column), "groups")
    same = F.col("_id").eqNullSafe(F.col("_component")) & (F.col("_mark") == F.col("_lead"))
    each = found.groupBy("_id", "_mark").agg(F.count(F.lit(1)).alias("_times"), F.max(~same).alias("_drop"))
    special = written(each.filter("_drop or _times > 1").select("_id", "_mark", "_drop"), "special")
    shared = docs.sparkSession.sparkContext.broadcast(_sieve(special))
    mark = mark_of(docs[text_column])
    hashed = docs.select(whole_row(docs), F.xxhash64(docs[id_column].cast("long"), mark).alias("_hash"))

    def part(which: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = shared.value
            for batch in batches:
                hit = _caught(bits, batch.column(1).to_numpy(zero_copy_only=False))
                yield batch.filter(pa.array(hit == which)).select([0])

        return mapped(hashed, run, hashed.select("_row").schema).select("_row.*")

    caught = part(True)
    caught = caught.select(whole_row(caught), caught[id_column].cast("long").alias("_id"), mark_of(caught[text_column]).alias("_mark"))
    dropped = special.filter("_drop").select("_id", "_mark")
    kept = caught.join(dropped, caught["_id"].eqNullSafe(dropped["_id"]) & (caught["_mark"] == dropped["_mark"]), "left_anti")
    return part(False).unionByName(kept.groupBy("_id", "_mark").agg(F.min("_row").alias("_row")).select("_row.*"))


def _joined(tasks: DataFrame) -> DataFrame:
    """Within each (_root, _i, _j) of (_root, _i, _j, _key, _text): the linked digests (_digest, _first)."""

    def run(table: pa.Table) -> pa.Table:
        wanted = set(table.column("_key").to_pylist())
        sets: dict[bytes, np.ndarray] = {}
        texts = table.column("_text").to_pylist()
        for first in range(0, len(texts), BATCH):
            for s in shingle_sets(texts[first : first + BATCH]):
                if len(s) and class_key(d := digest(s)) in wanted:
                    sets[d] = s
        names = sorted(sets)
        root = link_sets([sets[d] for d in names]) if len(names) > 1 else [0] * len(names)
        links = [(names[i], names[r]) for i, r in enumerate(root) if i != r]
        return pa.table({"_digest": pa.array([a for a, _ in links], pa.binary()), "_first": pa.array([b for _, b in links], pa.binary())})

    return tasks.groupBy("_root", "_i", "_j").applyInArrow(run, "_digest binary, _first binary")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each document: _id, _mark (of its text), _n (size of its set), _component (least id that links reach, its own included) and _lead (the mark of the row with that id).

    - Ids are whole numbers. Null ids join no minimum unless all ids of a component are null.
    - Null and empty texts, and those without words, have an empty set, link with nothing, and have their own id.
    - Texts of any length are compared whole. Repeated rows and copies are one class.
    - Ids that repeat with different texts are different documents; a component may be named by an id that another is.
    - An empty table gives no rows. Other columns are not looked at and may have any names.
    """
    spark = docs.sparkSession
    if not isinstance(docs.schema[id_column].dataType, T.IntegralType):
        raise TypeError(f"{id_column} must hold whole numbers")
    text = docs[text_column].cast("string")
    slim = docs.select(docs[id_column].cast("long").alias("_id"), mark_of(text).alias("_mark"), text.alias("_text"))
    survey = written(_survey(slim), "survey")
    rows = survey.filter("_block is null").select("_id", "_mark", "_n", "_digest", "_key")
    empty = rows.filter("_digest is null").select("_id", "_mark", "_n", F.col("_id").alias("_component"), F.col("_mark").alias("_lead"))
    rows = rows.filter("_digest is not null")
    least = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_mark").alias("mark")))
    classes = written(rows.groupBy("_digest").agg(least.alias("_rep"), F.first("_key").alias("_key"), F.first("_n").alias("_n"), F.count(F.lit(1)).alias("_copies")), "classes")

    total = rows.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("t")).first()["t"]
    levels = _levels(survey, total)
    copied = {bytes(r["_digest"]): (r["_rep"]["id"], r["_rep"]["mark"]) for r in classes.filter("_copies > 1").orderBy(F.desc("_copies"), "_digest").limit(MOST_COPIED).collect()}
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (DEN * BUCKET_POSTINGS) + 1)
    counts = _shared_counts(_postings(slim, levels, copied, buckets), buckets)
    pairs = counts.groupBy("_a", "_b").agg(F.max("_na").alias("_na"), F.max("_nb").alias("_nb"), F.sum("_shared").alias("_shared"))
    over = F.ceil(NUM * (F.col("_na") + F.col("_nb")) / F.lit(NUM + DEN))
    needs = F.greatest(F.lit(1), F.least(over - F.ceil(NUM * F.col("_na") / F.lit(DEN)) + 1, over - F.ceil(NUM * F.col("_nb") / F.lit(DEN)) + 1))
    member = components(pairs.filter(F.col("_shared") >= needs))

    return _finish(rows, empty, classes, member, slim)


def _finish(rows: DataFrame, empty: DataFrame, classes: DataFrame, member: DataFrame, slim: DataFrame) -> DataFrame:
    involved = written(classes.join(member, classes["_key"] == member["_v"]).select("_digest", "_key", "_rep", "_n", "_root"), "involved")
    blocks = involved.groupBy("_root").agg(F.sum("_n").alias("_sum")).select("_root", (F.col("_sum") / BLOCK_SHINGLES).cast("int").alias("_more"))
    placed = involved.join(blocks, "_root").withColumn("_x", F.pmod("_key", F.col("_more") + 1).cast("int"))
    placed = placed.withColumn("_y", F.explode(F.sequence(F.lit(0), F.col("_more"))))
    placed = placed.select("_root", "_key", "_rep", F.least("_x", "_y").alias("_i"), F.greatest("_x", "_y").alias("_j"))
    reps = involved.select(F.col("_rep.id").alias("_id"), F.col("_rep.mark").alias("_mark"))
    some = _sifted(slim, _sieve(reps))
    # Copies of the row that stands for a class are one text.
    tasks = some.join(placed, some["_id"].eqNullSafe(placed["_rep.id"]) & (some["_mark"] == placed["_rep.mark"])).select("_root", "_i", "_j", "_key", "_text")
    links = written(_joined(tasks), "links")
    split = blocks.filter("_more > 0").limit(1).count()
    if split:
        # Blocks give stars that may meet; digests as text order as their bytes do.
        met = components(links.select(F.hex("_digest").alias("_a"), F.hex("_first").alias("_b")))
        stars = met.select(F.unhex("_v").alias("_digest"), F.unhex("_root").alias("_first"))
    else:
        stars = links.unionByName(links.select(F.col("_first").alias("_digest"), "_first").distinct())
    starred = stars.join(classes.select("_digest", "_rep"), "_digest")
    least = starred.groupBy("_first").agg(F.min("_rep").alias("_least"))
    linked = starred.join(least, "_first").select("_digest", "_least")
    named = classes.select("_digest", "_rep", "_copies").join(linked, "_digest", "left").select("_digest", "_copies", F.coalesce("_least", "_rep").alias("_least"))
    named = written(named.select("_digest", "_copies", F.col("_least.id").alias("_component"), F.col("_least.mark").alias("_lead")), "named")
    # The classes with the most copies, a bounded number, reach their documents by broadcast; the rest are not skewed.
    most = F.broadcast(named.orderBy(F.desc("_copies"), "_digest").limit(MOST_COPIED).select("_digest", F.struct("_component", "_lead").alias("_soon")))
    marked = rows.join(most, "_digest", "left")
    columns = ["_id", "_mark", "_n", "_component", "_lead"]
    soon = marked.filter("_soon is not null").select("_id", "_mark", "_n", "_soon.*")
    late = marked.filter("_soon is null").join(named, "_digest").select(*columns)
    return soon.unionByName(late).unionByName(empty)
