"""Cosine scores of blocks of vectors as matrix products inside Arrow tasks, and the best of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

#: Queries and vectors of one product.
QUERIES, VECTORS = 512, 4096


def matrix(lists: pa.Array, dimension: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors and these as rows of unit length's numerators: all finite, of one dimension, not zero.

    Without a dimension that of the first vector holds.
    """
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(offsets)
    valid = lists.is_valid().to_numpy(zero_copy_only=False) & (sizes > 0)
    if dimension is None:
        dimension = int(sizes[valid][0]) if valid.any() else 0
    good = np.flatnonzero(valid & (sizes == dimension))
    rows = values[offsets[good][:, None] + np.arange(dimension)] if dimension else np.empty((0, 0))
    usable = np.isfinite(rows).all(1) & (rows != 0).any(1)
    return good[usable], rows[usable]


def lengths(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows * rows).sum(1))


def codes(asked: pa.Array, held: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for the values of two columns, equal where values are; -1 for null, -2 for values that are not asked for."""
    a, b = (pd.Series(x.to_pandas()) for x in (asked, held))
    known = pd.Index(a.dropna().unique())
    one, two = known.get_indexer(a), known.get_indexer(b)
    return np.where(a.isna(), -1, one), np.where(b.isna(), -1, np.where(two < 0, -2, two))


class Asked:
    """Query vectors with the columns that conditions compare."""

    def __init__(self, table: pa.Table, id_column: str = "query", vector_column: str = "qv"):
        self.places, self.rows = matrix(table.column(vector_column)) if table.num_rows else (np.empty(0, dtype=np.int64), np.empty((0, 0)))
        self.table = table.combine_chunks().take(pa.array(self.places))
        self.ids = self.table.column(id_column)
        self.norms = lengths(self.rows)

    def scores(self, batch: pa.RecordBatch, equal: tuple = (), differ: tuple = (), order: tuple[str, ...] = ("item",)) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
        """In blocks: the first query's place, the usable vectors in order, and the scores, rounded to 6; -inf where a condition fails."""
        if not len(self.rows):
            return
        place = batch.schema.get_field_index("v")
        for at in range(0, batch.num_rows, VECTORS):
            some = batch.slice(at, VECTORS)
            good, rows = matrix(some.column(place), self.rows.shape[1])
            if not len(good):
                continue
            held = some.take(pa.array(good))
            sorted_ = pa.Table.from_batches([held.select([c for c in order])]).append_column("_i", pa.array(np.arange(len(good)))).sort_by([(c, "ascending") for c in order]).column("_i").to_numpy()
            held, rows = held.take(pa.array(sorted_)), rows[sorted_]
            norms = lengths(rows)
            for q in range(0, len(self.rows), QUERIES):
                part = slice(q, q + QUERIES)
                found = np.round((self.rows[part] @ rows.T) / (self.norms[part][:, None] * norms), 6)
                for names, want in ((equal, True), (differ, False)):
                    for mine, theirs in names:
                        a, b = codes(self.table.column(mine).slice(q, QUERIES), held.column(held.schema.get_field_index(theirs)))
                        agree = (a[:, None] == b) if want else (a[:, None] != b)
                        found[~(agree & (a[:, None] != -1) & (b != -1))] = -np.inf
                yield q, held, found


class Best:
    """The best k of each query so far: by score, then by the least item."""

    def __init__(self, k: int):
        self.k, self.parts, self.waiting = k, [], 0

    def add(self, first: int, items: pa.Array, scores: np.ndarray) -> None:
        if scores.shape[1] > self.k:
            least = -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1]
            row, column = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        else:
            row, column = np.nonzero(scores > -np.inf)
        self.parts.append(pa.table({"q": pa.array(row + first), "item": items.take(pa.array(column)), "score": pa.array(scores[row, column])}))
        self.waiting += len(row)
        if self.waiting > 1_000_000:
            self._prune()

    def _prune(self) -> None:
        whole = pa.concat_tables(self.parts).combine_chunks().sort_by([("q", "ascending"), ("score", "descending"), ("item", "ascending")])
        q = whole.column("q").to_numpy()
        first = np.searchsorted(q, q)
        self.parts = [whole.filter(pa.array(np.arange(len(q)) - first < self.k))]
        self.waiting = self.parts[0].num_rows

    def table(self, ids: pa.ChunkedArray) -> pa.Table | None:
        """(query, item, score)."""
        if not self.parts:
            return None
        self._prune()
        whole = self.parts[0]
        return pa.table({"query": ids.take(whole.column("q")), "item": whole.column("item"), "score": whole.column("score")})


def best_of_groups(held: pa.RecordBatch, group: str, scores: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of vectors sorted by group and item: rows, places and scores of each row's best of each group."""
    column = held.column(held.schema.get_field_index(group))
    numbers = pd.factorize(pd.Series(column.to_pandas()), use_na_sentinel=False)[0]
    starts = np.flatnonzero(np.diff(numbers, prepend=-1))
    most = np.maximum.reduceat(scores, starts, axis=1)
    sizes = np.diff(np.append(starts, len(numbers)))
    at = np.where(scores == np.repeat(most, sizes, axis=1), np.arange(len(numbers)), len(numbers))
    place = np.minimum.reduceat(at, starts, axis=1)
    row, g = np.nonzero(most > -np.inf)
    yield row, place[row, g], most[row, g]
