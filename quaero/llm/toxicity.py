"""Toxicity severity by cumulative-link ordinal regression.

The chance that a text's grade is above k is ``sigmoid(x . w - theta[k])``: all
grades share the weights, and the thresholds are ordered.  x counts the words of
the text with a feature, a word three times at most: the word itself, and its
beginnings of four to seven letters (insults take endings).  The expected
severity is the sum of the chances over the thresholds.

The model is fitted on the driver from a bounded sample of labelled rows
(:data:`SAMPLE` of each class, weighted to the classes' shares).  Labels that
only say whether a text is toxic are graded by how often it uses the features
that set toxic texts apart: thirds of the toxic sample are grades 1, 2 and 3.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows of each class in the sample; hashed features; grades above zero.
SAMPLE, BITS, GRADES = 1500, 20, 3
_WORD = re.compile(r"[^\W\d_]+")
#: Words whose weights a task remembers, and letters of such a word at most; longer ones are worked out each time.
_REMEMBERED, _SHORT = 300_000, 40


def words_of(text: str | None) -> dict[str, int]:
    """The words of a text and how often they count."""
    return {w: min(n, 3) for w, n in Counter(_WORD.findall((text or "").lower())).items()}


def features_of(word: str) -> list[int]:
    """Hashed features of a word: itself and its beginnings."""
    mask = (1 << BITS) - 1
    keys = [word, *(word[:n] + "*" for n in range(4, 8) if len(word) >= n)]
    return [xxhash.xxh64_intdigest(k) & mask for k in keys]


@dataclass(frozen=True)
class Ordinal:
    """Weights by feature (zeros left out) and ordered thresholds."""

    weights: dict[int, float]
    thresholds: np.ndarray

    def severity(self, x: np.ndarray) -> np.ndarray:
        """(text, threshold) chances of grades above each threshold, for linear scores x."""
        return 1 / (1 + np.exp(-np.clip(np.asarray(x)[:, None] - self.thresholds[None, :], -60, 60)))


#: Used where the labels don't have both classes: nothing is toxic.
NONE = Ordinal({}, np.full(GRADES, 60.0))


def _in_rows(rows: list[np.ndarray], of: np.ndarray, value) -> np.ndarray:
    """In how many rows each feature is, of those where ``of`` equals ``value``."""
    return np.bincount(np.concatenate([np.unique(r) for r, k in zip(rows, of, strict=True) if k == value] or [np.zeros(0, np.int64)]), minlength=1 << BITS)


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, weight: np.ndarray, l1: float = 2e-5, steps: int = 400, least: int = 5, sure: float = 3.0) -> Ordinal:
    """The penalized model of greatest weighted likelihood of sparse count rows.

    ``rows`` lists each text's features, with repeats.  Features in fewer than
    ``least`` rows are left out, and those that are not more frequent in texts
    above grade zero by ``sure`` standard errors of the log odds; so weights are
    not negative, and no length of harmless text outweighs an insult.
    Full-batch AdaGrad with a soft threshold.
    """
    top = int(grades.max(initial=0))
    if not len(grades) or top == 0 or grades.min() > 0:
        return NONE
    clean, bad = (_in_rows(rows, grades > 0, k) for k in (False, True))
    n_clean, n_bad = (grades == 0).sum() + 1, (grades > 0).sum() + 1
    odds = np.log((bad + 0.5) / n_bad) - np.log((clean + 0.5) / n_clean)
    seen = (clean + bad >= least) & (odds >= sure * np.sqrt(1 / (bad + 0.5) + 1 / (clean + 0.5)))
    number = np.cumsum(seen) - 1
    kept = [number[r[seen[r]]] for r in rows]
    size = np.array([len(r) for r in kept])
    column, row = np.concatenate(kept), np.repeat(np.arange(len(rows)), size)
    weight = weight / weight.sum()
    w, theta = np.zeros(int(seen.sum())), np.log1p(np.arange(top)) + 1.0
    w_sum, t_sum = np.full(len(w), 1e-12), np.full(top, 1e-12)
    index = np.arange(len(rows))
    for _ in range(steps):
        x = np.bincount(row, w[column], len(rows))
        above = 1 / (1 + np.exp(-np.clip(x[:, None] - theta[None, :], -60, 60)))  # chances of grades 1.. and above
        wide = np.concatenate((np.ones((len(x), 1)), above, np.zeros((len(x), 1))), 1)
        slope = wide * (1 - wide)
        p = np.maximum(wide[index, grades] - wide[index, grades + 1], 1e-9)
        gx = weight * (slope[index, grades] - slope[index, grades + 1]) / p
        gt = np.zeros((len(x), top + 2))
        gt[index, grades] -= slope[index, grades] / p
        gt[index, grades + 1] += slope[index, grades + 1] / p
        gt = (weight[:, None] * gt)[:, 1:-1].sum(0)
        gw = np.bincount(column, gx[row], len(w))
        w_sum += gw * gw
        t_sum += gt * gt
        rate = 0.3 / np.sqrt(w_sum)
        w += rate * gw
        w = np.maximum(0, w - rate * l1)
        theta = np.maximum.accumulate(theta + 0.3 * gt / np.sqrt(t_sum))
    nonzero = np.flatnonzero(w)
    feature = np.flatnonzero(seen)
    return Ordinal({int(feature[i]): float(w[i]) for i in nonzero}, theta)


def grade(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Grades 0 to GRADES of texts that are only known to be toxic or not."""
    counts = [_in_rows(rows, toxic, k) for k in (0, 1)]
    n = [max(1, int((toxic == k).sum())) for k in (0, 1)]
    telling = (counts[1] >= 5) & ((counts[1] + 0.5) / n[1] > 20 * (counts[0] + 0.5) / n[0])
    used = np.array([int(telling[r].sum()) for r in rows])
    cuts = np.quantile(used[toxic == 1], np.arange(1, GRADES) / GRADES) if (toxic == 1).any() else []
    return np.where(toxic == 1, 1 + np.searchsorted(cuts, used, "left"), 0)


def fit_from_labels(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal:
    """The model of a bounded sample of labelled rows, the same whatever the partitioning.

    Labels that are null or contradict each other are left out.
    """
    one = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.min("toxic").cast("int").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").select("doc_id", "toxic")
    shares = {r.toxic: r["count"] for r in one.groupBy("toxic").count().collect()}
    first = lambda k: one.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = first(0).union(first(1))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")

    def run(batches):
        for batch in batches:
            made = [np.array([f for w, n in words_of(t.as_py()).items() for f in features_of(w) * n], np.int32).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], ["doc_id", "toxic", "features"])

    got = {r.doc_id: (r.toxic, np.sort(np.frombuffer(bytes(r.features), np.int32).astype(np.int64))) for r in rows.mapInArrow(run, "doc_id long, toxic int, features binary").toLocalIterator()}
    if not got:
        return NONE
    keys = sorted(got)
    toxic, sparse = np.array([got[k][0] for k in keys]), [got[k][1] for k in keys]
    share = np.array([shares[int(t)] / max(1, int((toxic == t).sum())) for t in toxic])
    return fit_ordinal(sparse, grade(sparse, toxic), share)


def score(docs: DataFrame, model: Ordinal, cut: float = 0.4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, expected_severity, severity, toxic) for each row of ``docs``.

    ``severity`` is the likeliest grade; ``toxic`` says whether the chance of a
    grade above zero is ``cut`` or more.  Whole texts are read; null and empty texts, and
    texts without letters, have the score of no features.  Rows repeated or
    without doc_id each give a row; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        weights = shared.value.weights

        class Known(dict):
            def __missing__(self, word):
                value = sum(weights.get(f, 0.0) for f in features_of(word))
                if len(word) <= _SHORT:
                    if len(self) >= _REMEMBERED:
                        self.clear()
                    self[word] = value
                return value

        known = Known()
        for batch in batches:
            x = np.array([math.fsum(n * known[w] for w, n in words_of(t.as_py()).items()) for t in batch.column(1)], float)
            above = shared.value.severity(x)
            exact = -np.diff(np.concatenate((np.ones((len(x), 1)), above, np.zeros((len(x), 1))), 1), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(above.sum(1)), pa.array(exact.argmax(1), pa.int32()), pa.array(above[:, 0] >= cut)], ["doc_id", "expected_severity", "severity", "toxic"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, expected_severity double, severity int, toxic boolean")
