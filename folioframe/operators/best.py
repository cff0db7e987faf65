"""What a task keeps of the scores it computes."""

from __future__ import annotations

import numpy as np


class Best:
    """Running best ``k`` (score, id) per query of those that reach ``least``: higher scores first, then smaller ids."""

    def __init__(self, queries: int, k: int, least: float = -np.inf):
        self.k, self.worst = k, np.full(queries, least)
        self.rows = (np.empty(0, dtype=np.int64), np.empty(0), np.empty(0, dtype=np.int64))

    def offer(self, first: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """A tile of scores[query, row] for the queries from ``first`` on; only what can enter is looked at."""
        if scores.shape[1] > self.k:
            least = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
        else:
            least = np.full(len(scores), -np.inf)
        q, r = np.nonzero(scores >= np.maximum(least, self.worst[first:first + len(scores)])[:, None])
        if not len(q):
            return
        ids = ids[r] if not len(self.rows[2]) else np.concatenate([self.rows[2], ids[r]])
        slots, values = np.concatenate([self.rows[0], q + first]), np.concatenate([self.rows[1], scores[q, r]])
        order = np.lexsort((ids, -values, slots))
        slots, values, ids = slots[order], values[order], ids[order]
        place = np.arange(len(slots)) - np.searchsorted(slots, slots)
        kept = place < self.k
        self.rows = slots[kept], values[kept], ids[kept]
        full = place == self.k - 1
        self.worst[slots[full]] = values[full]
