"""The k best rows of each query within a task, held in bounded memory."""

from __future__ import annotations

import numpy as np

#: Rows held before all but the best go.
_HELD = 200_000


class Best:
    """Rows (query number, id, score): each query's k highest scores, ties to the smaller id."""

    def __init__(self, k: int):
        self.k, self.size = k, 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.parts.append((query, ids, score))
        self.size += len(query)
        if self.size > _HELD:
            self.parts = [self.rows()]
            self.size = 0

    def add_matrix(self, queries: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Scores of all queries (rows) with all ids (columns); those of minus infinity aren't any."""
        k = self.k
        if score.shape[1] > k:
            floor = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k, None]
            taken = (score >= floor) & (score > -np.inf)
        else:
            taken = score > -np.inf
        x, y = np.nonzero(taken)
        self.add(queries[x], ids[y], score[x, y])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        query, ids, score = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        place = np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids
        order = np.lexsort((place, -score, query))
        query = query[order]
        start = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.empty(0, np.int64)
        nth = np.arange(len(query)) - np.repeat(start, np.diff(np.r_[start, len(query)]))
        order = order[nth < self.k]
        return query[nth < self.k], ids[order], score[order]
