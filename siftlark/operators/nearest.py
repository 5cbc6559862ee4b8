"""The best rows of many queries, kept while batches of vectors go by, in memory that depends on neither table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Products that are made at once, and rows that are kept beyond what is asked before they are cut.
PRODUCTS, SPARE = 1_000_000, 1_000_000
ROWS_OUT = 50_000


class Best:
    """The ``limit`` best of each of ``n`` queries: highest score first, ties by id."""

    def __init__(self, n: int, limit: int):
        self.n, self.limit = n, limit
        self.least = np.full(n, -np.inf)
        self.kept = (np.empty(0, np.int32), None, np.empty(0))
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, queries: np.ndarray, ids: np.ndarray, matrix: np.ndarray, scores_of) -> None:
        """Rows of ``matrix``, named by ``ids``, for these queries. ``scores_of`` gives the scores of some of the queries and some rows; -inf is no candidate."""
        rows = min(max(1, len(ids)), PRODUCTS)
        step = max(1, PRODUCTS // rows)
        for low in range(0, len(ids), rows):
            part, names = matrix[low : low + rows], ids[low : low + rows]
            for at in range(0, len(queries), step):
                mine = queries[at : at + step]
                scores = scores_of(mine, part, low)
                least = self.least[mine]
                if scores.shape[1] > self.limit:
                    least = np.maximum(least, np.partition(scores, -self.limit, axis=1)[:, -self.limit])
                q, d = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
                self.new.append((mine[q].astype(np.int32), names[d], scores[q, d]))
                self.waiting += len(q)
                if self.waiting > SPARE:
                    self.cut()

    def cut(self) -> None:
        parts = ([self.kept] if self.kept[1] is not None else []) + self.new
        self.new, self.waiting = [], 0
        if not parts:
            return
        q, d, s = (np.concatenate([p[k] for p in parts]) for k in range(3))
        name = d if d.dtype != object else np.unique(d, return_inverse=True)[1]
        order = np.lexsort((name, -s, q))
        q, d, s = q[order], d[order], s[order]
        counts = np.bincount(q, minlength=self.n)
        place = np.arange(len(q)) - np.repeat(np.cumsum(counts) - counts, counts)
        last = place == self.limit - 1
        self.least[q[last]] = s[last]
        keep = place < self.limit
        self.kept = (q[keep], d[keep], s[keep])

    def rows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(queries, ids, scores) in pieces."""
        self.cut()
        q, d, s = self.kept
        for low in range(0, len(q), ROWS_OUT):
            yield q[low : low + ROWS_OUT], d[low : low + ROWS_OUT], s[low : low + ROWS_OUT]


#: Stands for a missing whole number among ids; it sorts first, as nulls do.
NO_ID = np.iinfo(np.int64).min


def ids_of(column: pa.Array) -> np.ndarray:
    if pa.types.is_integer(column.type):
        return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
    return column.to_numpy(zero_copy_only=False).astype(object)


def id_column(ids: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(ids, kind, mask=ids == NO_ID) if ids.dtype != object else pa.array(ids, kind)


def floats(column: pa.Array, width: int) -> np.ndarray:
    if not np.all(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == width):
        raise ValueError(f"vectors of other than {width} numbers")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
