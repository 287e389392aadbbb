"""Ranked lists: (query_id, rank, score, id), ranks from 1."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Scores that a task has in memory at once.
CELLS = 1 << 19


class Best:
    """The k best rows of each of ``queries`` so far, by score to nine places, then the smaller id; some CELLS rows at most besides."""

    def __init__(self, queries: int, k: int):
        self.k, self.held, self.size = k, [], 0
        self.floor, self.tie = np.full(queries, -np.inf), np.zeros(queries, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray, there: np.ndarray | None = None) -> None:
        """Scores of each query with each of ``ids``; only where ``there``, if given."""
        maybe = ~(scores < self.floor[:, None] - 1e-8)  # what is no number stays, as the largest
        if there is not None:
            maybe &= there
        if np.count_nonzero(maybe) > max(maybe.size // 8, 2 * self.k * len(maybe)):  # many, as at first: only the k best of these can stay
            cut = np.partition(np.where(maybe, scores, -np.inf), -self.k, 1)[:, -self.k]
            maybe &= ~(scores < cut[:, None] - 1e-8)
        at, n = np.nonzero(maybe)
        own, exact = ids[n], scores[at, n]
        value = np.round(exact, 9)
        full = self.floor[at] > -np.inf
        better = ~full | ~(value <= self.floor[at]) | ((value == self.floor[at]) & (own < self.tie[at]))
        if better.any():
            self.held.append((at[better], own[better], exact[better]))
            self.size += int(better.sum())
        if self.size > CELLS:
            self.held, self.size = [self.rows()], 0

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the query, id, score) of the best."""
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        at, ids, scores = (np.concatenate(x) for x in zip(*self.held, strict=True))
        value = np.round(scores, 9)
        order = np.lexsort((ids, -value, ~np.isnan(value), at))
        at, ids, scores, value = at[order], ids[order], scores[order], value[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)  # within the query
        last = place == self.k - 1
        self.floor[at[last]], self.tie[at[last]] = value[last], ids[last]
        return at[place < self.k], ids[place < self.k], scores[place < self.k]


def top_k(scores: DataFrame, k: int, by: str = "query_id", score: str = "score", tie: str = "id") -> DataFrame:
    """The k best rows of each query, by score to nine places, then the smaller ``tie``."""
    order = Window.partitionBy(by).orderBy(F.round(score, 9).desc(), F.col(tie))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def last_wins(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows of each key, the last in ``order``; an aggregate, so partial results combine before the shuffle."""
    rest = [c for c in log.columns if c not in keys]
    latest = F.max_by(F.struct(*rest), F.struct(*order))
    return log.groupBy(*keys).agg(latest.alias("_")).select(*keys, *[F.col("_")[c].alias(c) for c in rest]).select(*log.columns)


def pending(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``wanted`` whose key isn't in ``done``."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")
