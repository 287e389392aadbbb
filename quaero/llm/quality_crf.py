"""Document quality by line labelling with a linear-chain conditional random field.

Each line is content (1) or boilerplate (0).  Emission scores come from a few
layout features of the line, transition scores tie neighbouring lines, and the
Viterbi path gives the labels.  A document is retained if at least
``least_share`` of its words are in content lines and it passes the base rules.

The model is fitted on the driver from a bounded sample of labelled documents
(:data:`SAMPLE` documents, of each :data:`RUNS` runs of :data:`RUN` lines spread
over the whole text).  Lines are labelled by what is known of them there: in a
good document a line is content unless it was said before, stands in other
documents of the sample too or is mostly symbols; in a bad one only a line of
clean prose that is found nowhere else is.  Everything else reads all documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaero.llm.filters import keep_rows
from quaero.llm.wordbytes import SPACE, Words, covered, gram_in_doc, grams, mix, segment_sum, span_hashes, text_groups

#: Labelled documents that the model is fitted on, runs of lines of each, and lines of a run; shorter texts are used whole.
SAMPLE, RUNS, RUN = 3000, 10, 40
#: Sampled documents from which on a line that they share is boilerplate.
SHARED = 3
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = _UPPER.copy()
_LETTER[0x61:0x7B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
FEATURES = ("bias", "blank", "symbols", "many symbols", "capitals", "digits", "cells", "shouts", "repeats itself", "repeated line", "one or two words", "few words", "many words", "dozens of clean words", "long words")


@dataclass(frozen=True)
class Crf:
    """Weights of the boilerplate (0) and content (1) labels."""

    emission: np.ndarray  # features x 2
    transition: np.ndarray  # from x to
    start: np.ndarray


#: Used where there are no labels of both kinds: line noise is boilerplate, all else content.
PLAIN = Crf(np.array([[0, 1.5], [0, 0], [0.5, 0], [2, 0], [2, 0], [1, 0], [2, 0], [1.5, 0], [2, 0], [1, 0], [0, 0], [0, 0], [0, 0.5], [0, 2], [1, 0]], float), np.array([[0.5, 0], [0, 0.5]]), np.zeros(2))


@dataclass
class Lines:
    """A group of texts in lines: base counts by text, and features, words and text number by line."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    first: np.ndarray
    words: np.ndarray
    features: np.ndarray
    line: np.ndarray  # hash of each line


def _counts(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[end] - total[start]


def read_lines(data: np.ndarray, offsets: np.ndarray) -> Lines:
    """The counts and line features of a group of texts."""
    n_docs = len(offsets) - 1
    words = Words(data, offsets, ~SPACE)
    doc = words.doc()
    text_start, text_end = offsets[:-1], offsets[1:]
    space = SPACE[data]
    word_chars = _counts(~space & ((data & 0xC0) != 0x80), text_start, text_end)
    symbol = _SYMBOL[data]

    gram = grams(words.hashes(), 3)
    inside = np.flatnonzero(gram_in_doc(doc, 3))
    key = mix(gram[inside] + mix(doc[inside].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    repeat = covered(len(doc), inside[twice], 3)

    newline = np.flatnonzero(data == 0x0A)
    per_doc = np.searchsorted(newline, text_end) - np.searchsorted(newline, text_start) + 1
    first = np.concatenate(([0], np.cumsum(per_doc)))
    start = np.sort(np.concatenate((text_start, newline + 1)))
    end = np.empty_like(start)
    end[:-1] = start[1:] - 1
    end[first[1:] - 1] = text_end
    line_doc = np.repeat(np.arange(n_docs), per_doc)
    word_at = np.searchsorted(words.start, start)
    word_to = np.searchsorted(words.start, end)
    n = word_to - word_at
    line = span_hashes(data, start, end)
    line_key = mix(line + mix(line_doc.astype(np.uint64) + np.uint64(7)))
    worded = np.flatnonzero(n > 0)
    order = worded[np.argsort(line_key[worded], kind="stable")]
    again = np.zeros(len(start), bool)
    again[order[1:][line_key[order][1:] == line_key[order][:-1]]] = True

    chars = np.maximum(1, _counts(~space, start, end))
    letters = np.maximum(1, _counts(_LETTER[data], start, end))
    share = lambda flags: _counts(flags, start, end) / chars
    in_symbols, some = share(symbol), np.maximum(1, n)
    repeats = (np.concatenate(([0], np.cumsum(repeat)))[word_to] - np.concatenate(([0], np.cumsum(repeat)))[word_at]) / some
    columns = (
        np.ones(len(start), bool), n == 0, in_symbols > 0.02, in_symbols > 0.08, (_counts(_UPPER[data], start, end) > 0.6 * letters) & (letters > 3), share(_DIGIT[data]) > 0.2,
        _counts(data == 0x7C, start, end) > 0.2 * some, share(data == 0x21) > 0.04, repeats > 0.5, again, (n > 0) & (n <= 2), (n > 2) & (n <= 6), n > 12, (n > 24) & (in_symbols <= 0.02) & (repeats <= 0.5), chars > 14 * some,
    )
    return Lines(words.n.astype(np.int64), word_chars, _counts(symbol, text_start, text_end), segment_sum(again.astype(np.int64), first), segment_sum(repeat.astype(np.int64), words.first), first, n, np.stack(columns, 1).astype(np.float32), line)


def viterbi(model: Crf, features: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The best labels of all lines; text i has the lines first[i] to first[i + 1].

    All texts take a step at a time, longest first, so texts that have ended
    drop off the end of the arrays.
    """
    score = features @ model.emission
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    back = np.zeros((len(features), 2), np.int8)
    label = np.zeros(len(features), np.int8)
    if not len(features):
        return label
    best = model.start + score[begin]
    finals = np.empty((len(size), 2))
    active = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), "right")  # texts with at least t lines
    for t in range(1, int(size[0])):
        n = int(active[t])
        finals[n : len(best)] = best[n:]
        step = best[:n, :, None] + model.transition
        back[begin[:n] + t] = step.argmax(1)
        best = step.max(1) + score[begin[:n] + t]
    finals[: len(best)] = best
    now = finals.argmax(1)
    label[begin + size - 1] = now
    for t in range(int(size[0]) - 1, 0, -1):
        n = int(active[t])
        at = begin[:n] + t
        label[at - 1] = back[at, label[at]]
    return label


def line_labels(features: np.ndarray, quality: int, shared: np.ndarray) -> np.ndarray:
    """The labels that a document of known quality teaches for its lines; ``shared`` says which lines other documents have too."""
    has = lambda name: features[:, FEATURES.index(name)] != 0
    noise = shared | has("repeats itself") | has("repeated line") | has("many symbols") | has("shouts")
    prose = (has("many words") | has("dozens of clean words")) & ~has("symbols") & ~has("capitals") & ~has("digits") & ~has("cells") & ~has("long words")
    return (~noise & (prose if not quality else ~has("blank"))).astype(np.int64)


def runs_of(n: int) -> list[tuple[int, int]]:
    """Spans of lines of a text of n lines: all of them, or RUNS runs from its start to its end."""
    if n <= RUNS * RUN:
        return [(a, min(n, a + RUN)) for a in range(0, n, RUN)]
    return [(a, a + RUN) for a in np.linspace(0, n - RUN, RUNS).astype(int).tolist()]


def fit(features: list[np.ndarray], labels: list[np.ndarray], steps: int = 120, decay: float = 1e-3) -> Crf:
    """The conditional random field of greatest likelihood of labelled lines, given text by text.

    Full-batch gradients by scaled forward-backward sums of all texts at once;
    texts that hold boilerplate count as much together as those that don't.
    """
    features, labels = [f for f in features if len(f)], [y for y in labels if len(y)]
    bad = np.array([y.min() == 0 for y in labels], bool)
    if not len(labels) or bad.all() or not bad.any():
        return PLAIN
    longest = max(map(len, features))
    x = np.zeros((longest, len(features), len(FEATURES)))
    there = np.zeros((longest, len(features)), bool)
    truth = np.zeros((longest, len(features), 2))
    for i, (f, y) in enumerate(zip(features, labels, strict=True)):
        x[: len(f), i], there[: len(f), i] = f, True
        truth[np.arange(len(y)), i, y] = 1
    weight = np.where(bad, 0.5 / bad.mean(), 0.5 / (~bad).mean()) / there.sum(0) / len(bad)
    paired = there[1:] * weight
    seen = np.einsum("tni,tnj,tn->ij", truth[:-1], truth[1:], paired)
    emission, transition, start = np.zeros((len(FEATURES), 2)), np.zeros((2, 2)), np.zeros(2)
    moments = [np.zeros_like(p) for p in (emission, transition, start) for _ in (0, 1)]
    for step in range(1, steps + 1):
        score = x @ emission
        local = np.exp(score - score.max(2, keepdims=True))
        move = np.exp(transition)
        alpha, beta, scale = np.empty_like(local), np.ones_like(local), np.ones(there.shape)
        alpha[0] = local[0] * np.exp(start)
        alpha[0] /= alpha[0].sum(1, keepdims=True)
        for t in range(1, longest):
            ahead = (alpha[t - 1] @ move) * local[t]
            scale[t] = ahead.sum(1)
            alpha[t] = np.where(there[t, :, None], ahead / scale[t, :, None], alpha[t - 1])
        for t in range(longest - 2, -1, -1):
            ahead = (local[t + 1] * beta[t + 1]) @ move.T / scale[t + 1, :, None]
            beta[t] = np.where(there[t + 1, :, None], ahead, 1)
        belief = alpha * beta
        belief /= belief.sum(2, keepdims=True)
        gap = (truth - belief) * (there * weight)[..., None]
        onward = local[1:] * beta[1:] / scale[1:, :, None]
        expected = np.einsum("tni,tnj,tn->ij", alpha[:-1], onward, paired) * move
        gradients = (np.tensordot(x, gap, ([0, 1], [0, 1])) - decay * emission, seen - expected - decay * transition, gap[0].sum(0) - decay * start)
        for p, (value, g) in enumerate(zip((emission, transition, start), gradients, strict=True)):
            m, v = moments[2 * p], moments[2 * p + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return Crf(emission, transition, start)


def fit_from_labels(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Crf:
    """The model of a bounded sample of labelled documents, the same whatever the partitioning.

    Labels that are null or contradict each other are left out; of several
    texts of one doc_id one is taken, by its hash.
    """
    one = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    chosen = one.where("quality = most").select("doc_id", F.col("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "quality")

    def run(batches):
        for batch in batches:
            for part, data, offsets in text_groups(batch.column(1)):
                found = read_lines(data, offsets)
                spans = [[(a + x, a + y) for x, y in runs_of(b - a)] for a, b in zip(found.first.tolist(), found.first[1:].tolist(), strict=False)]
                cut = lambda of, kind: pa.array([[of[a:b].astype(kind).tobytes() for a, b in own] for own in spans], pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[part.start : part.stop], batch.column(2)[part.start : part.stop], cut(found.features, np.uint8), cut(found.line, "<u8")], ["doc_id", "quality", "features", "lines"])

    got = sorted(rows.mapInArrow(run, "doc_id long, quality int, features array<binary>, lines array<binary>").collect(), key=lambda r: r.doc_id)
    features = [[np.frombuffer(bytes(x), np.uint8).reshape(-1, len(FEATURES)) for x in r.features] for r in got]
    lines = [[np.frombuffer(bytes(x), "<u8") for x in r.lines] for r in got]
    every, of = np.unique(np.concatenate([np.unique(np.concatenate(x)) for x in lines if x] or [np.zeros(0, np.uint64)]), return_counts=True)
    common = every[of >= SHARED]
    truth = [[line_labels(f, r.quality, np.isin(x, common)) for f, x in zip(fs, xs, strict=True)] for r, fs, xs in zip(got, features, lines, strict=True)]
    return fit([f for fs in features for f in fs], [y for ys in truth for y in ys])


_RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def _verdict(found: Lines, model: Crf, least_share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base_failed, kept, content_share) of each text."""
    label = viterbi(model, found.features, found.first)
    content = segment_sum(found.words * (label == 1), found.first) / np.maximum(1, found.n_words)
    failed = (found.n_words < 50) | (100 * found.n_repeat_words > 50 * found.n_words)
    return failed, ~failed & (content >= least_share), content


def judge(docs: DataFrame, model: Crf, least_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The base counts and the verdict for each row of ``docs``.

    ``base_failed``: under 50 words, or over half of them in 3-word windows
    found twice or more in the text.  ``kept`` is false for those, and where
    the words of content lines are less than ``least_share`` of all.  Null and
    empty texts have no words and fail.  Repeated rows and rows without doc_id
    each give a row; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part, data, offsets in text_groups(batch.column(1)):
                found = read_lines(data, offsets)
                columns = (found.n_words, found.word_chars, found.n_symbols, found.n_dup_lines, found.n_repeat_words, *_verdict(found, shared.value, least_share))
                yield pa.RecordBatch.from_arrays([batch.column(0)[part.start : part.stop], *map(pa.array, columns)], [f.split()[0] for f in _RESULT.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _RESULT)


def keep_good(docs: DataFrame, model: Crf, least_share: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text :func:`judge` keeps, each by its own text, with or without doc_id; null and empty texts go."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, lambda column: np.concatenate([np.zeros(0, bool), *(_verdict(read_lines(data, offsets), shared.value, least_share)[1] for _, data, offsets in text_groups(column))]))
