"""Benchmark decontamination by winnowing.

Of every ``window - k + 1`` consecutive k-grams of words the one with the least
hash is a fingerprint (the last of equal ones), so a window of ``window`` words
picks its fingerprint from its own words alone: two texts that share a window
share that fingerprint.  Fingerprints of documents and benchmark items are
joined, and every hit is extended word by word to both sides; a run of at least
``window`` equal words is a shared span.  An item with fewer words is one window
of its own length and is looked up by the hash of all its words.

The benchmark is dealt into blocks of bounded size; each block's fingerprints
are broadcast (:data:`BLOCK` bytes of text at most) and all documents are read
against it.  Usually there is one block and one pass without any shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaero.llm.filters import keep_rows
from quaero.llm.scratch import Scratch
from quaero.llm.wordbytes import ALNUM, LOWER, Words, covered, gram_in_doc, grams, mix, text_groups

#: Bytes of benchmark text whose fingerprints are broadcast at once.
BLOCK = 16_000_000
#: (document position, item position) pairs that are extended at once.
PAIRS = 2_000_000
_FILTER = 1 << 18


def winnow(word: np.ndarray, doc: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the fingerprints of texts given as word hashes and text numbers."""
    gram = grams(word, k)
    width = window - k + 1
    n = len(word) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), gram[:0]
    best = gram[width - 1 : width - 1 + n].copy()
    at = np.full(n, width - 1)
    for j in range(width - 2, -1, -1):
        lower = gram[j : j + n] < best
        best[lower] = gram[j : j + n][lower]
        at[lower] = j
    at += np.arange(n)
    at = at[gram_in_doc(doc, window)]
    at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
    return at, gram[at]


class Block:
    """The fingerprints of some benchmark items, ready for lookups."""

    def __init__(self, items: list[str], texts: list[str | None], window: int, k: int):
        self.window, self.k, self.items = window, k, items
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        hashes, docs, short = [], [], {}
        base = 0
        for rows, data, offsets in text_groups(pa.array(texts, pa.large_string())):
            words = Words(LOWER[data], offsets, ALNUM)
            hash_, doc = words.hashes(), words.doc() + rows.start
            hashes.append(hash_)
            docs.append(doc)
            for i in np.flatnonzero((words.n > 0) & (words.n < window)):
                own = hash_[words.first[i] : words.first[i + 1]]
                short.setdefault(len(own), []).append((grams(own, len(own))[0], rows.start + i))
            base += len(hash_)
        self.word = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        at, key = winnow(self.word, self.doc, window, k)
        at, key = self.contexts(at, key)
        order = np.argsort(key, kind="stable")
        self.at, self.key = at[order], key[order]
        self.seen = np.zeros(_FILTER, bool)
        self.seen[self.key & np.uint64(_FILTER - 1)] = True
        for length, found in short.items():
            key = np.array([f[0] for f in found], np.uint64)
            order = np.argsort(key, kind="stable")
            self.short[length] = (key[order], np.array([f[1] for f in found])[order])

    def contexts(self, at, key):
        """One of the positions of an item whose fingerprint has the same words around it."""
        reach = self.window - self.k
        around = key.copy()
        for j in [*range(-reach, 0), *range(self.k, self.k + reach)]:
            where = np.clip(at + j, 0, max(0, len(self.word) - 1))
            same = (at + j >= 0) & (at + j < len(self.word)) & (self.doc[where] == self.doc[at])
            around = mix(around * np.uint64(31) + np.where(same, self.word[where], np.uint64(j + 100)))
        order = np.lexsort((around, self.doc[at]))
        first = np.ones(len(at), bool)
        first[1:] = (around[order][1:] != around[order][:-1]) | (self.doc[at][order][1:] != self.doc[at][order][:-1])
        keep = np.sort(order[first])
        return at[keep], key[keep]

    def hits(self, word: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, number of words, item number) of the shared spans of texts."""
        out = [(np.zeros(0, np.int64),) * 3]
        at, key = winnow(word, doc, self.window, self.k)
        maybe = self.seen[key & np.uint64(_FILTER - 1)]
        at, key = at[maybe], key[maybe]
        low, high = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        at, low, high = at[high > low], low[high > low], high[high > low]
        size = high - low
        ends = np.cumsum(size)
        start = 0
        while start < len(at):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")))
            n = size[start:stop]
            mine = np.repeat(at[start:stop], n)
            within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            theirs = self.at[np.repeat(low[start:stop], n) + within]
            out.append(self.extend(word, doc, mine, theirs))
            start = stop
        for length, (keys, items) in self.short.items():
            gram = grams(word, length)
            where = np.flatnonzero(gram_in_doc(doc, length) & np.isin(gram, keys))
            low, high = np.searchsorted(keys, gram[where], "left"), np.searchsorted(keys, gram[where], "right")
            n = high - low
            within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out.append((np.repeat(where, n), np.full(int(n.sum()), length), items[np.repeat(low, n) + within]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def extend(self, word, doc, mine, theirs):
        """Runs of equal words around fingerprint hits that are as long as a window."""
        k, reach = self.k, self.window - self.k

        def equal(a, b, j):
            x, y = a + j, b + j
            ok = (x >= 0) & (x < len(word)) & (y >= 0) & (y < len(self.word))
            x, y = np.where(ok, x, 0), np.where(ok, y, 0)
            return ok & (word[x] == self.word[y]) & (doc[x] == doc[a]) & (self.doc[y] == self.doc[b])

        core = np.ones(len(mine), bool)
        for j in range(k):
            core &= equal(mine, theirs, j)
        mine, theirs = mine[core], theirs[core]
        left = right = np.zeros(len(mine), np.int64)
        going = np.ones(len(mine), bool)
        for j in range(1, reach + 1):
            going = going & equal(mine, theirs, -j)
            left = left + going
        going = np.ones(len(mine), bool)
        for j in range(reach):
            going = going & equal(mine, theirs, k + j)
            right = right + going
        long = left + k + right >= self.window
        return (mine - left)[long], (left + k + right)[long], self.doc[theirs[long]]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, size: int):
    """Lists of (items, texts), each of at most ``size`` bytes of text or one item."""
    items, texts, total = [], [], 0
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")), F.col(text_col).cast("string"))
    for item, text in rows.toLocalIterator():
        n = len(text or "") * 2 + 16
        if items and total + n > size:
            yield items, texts
            items, texts, total = [], [], 0
        items.append(item)
        texts.append(text)
        total += n
    yield items, texts


_RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _result(ids, n_words, n_hit, items: list[list[str]]) -> pa.RecordBatch:
    n_hit, n_words = np.asarray(n_hit, np.int64), np.asarray(n_words, np.int64)
    digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
    bad = (n_hit > 0) & (20 * n_hit >= n_words)
    return pa.RecordBatch.from_arrays([ids, pa.array(n_words), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array(digest), pa.array(bad)], [f.split()[0] for f in _RESULT.split(", ")])


def _spans(column: pa.Array, block: Block):
    """For each group of texts: (rows, words by text, hit words by text, item sets by text, span starts and lengths by text)."""
    for rows, data, offsets in text_groups(column):
        words = Words(LOWER[data], offsets, ALNUM)
        doc = words.doc()
        start, length, item = block.hits(words.hashes(), doc)
        yield rows, words, doc, start, length, item


def _one_pass(docs: DataFrame, block: Block) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        for batch in batches:
            for rows, words, doc, start, length, item in _spans(batch.column(1), shared.value):
                hit = covered(len(doc), start, length)
                n_hit = np.bincount(doc[hit], minlength=len(words.n))
                items: list[list[str]] = [[]] * len(words.n)
                pairs = np.unique(np.stack([doc[start], item]), axis=1)
                hit_docs, at = np.unique(pairs[0], return_index=True)
                for d, own in zip(hit_docs, np.split(pairs[1], at[1:]), strict=bool(len(at))):
                    items[d] = sorted({shared.value.items[i] for i in own})
                yield _result(batch.column(0)[rows.start : rows.stop], words.n, n_hit, items)

    return docs.mapInArrow(run, _RESULT)


def _many_passes(docs: DataFrame, blocks) -> DataFrame:
    """As _one_pass, for a benchmark of many blocks: spans of each block are stored, then joined by document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    found = None
    for block in blocks:
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            for batch in batches:
                for rows, words, doc, start, length, item in _spans(batch.column(2), shared.value):
                    order = np.argsort(doc[start], kind="stable")
                    hit, at = np.unique(doc[start][order], return_index=True)
                    where = np.split(order, at[1:]) if len(at) else []
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(hit + rows.start)), batch.column(1).take(pa.array(hit + rows.start)), pa.array([(start[w] - words.first[d]).tolist() for d, w in zip(hit, where, strict=True)], pa.list_(pa.int64())), pa.array([length[w].tolist() for w in where], pa.list_(pa.int64())), pa.array([sorted({shared.value.items[i] for i in item[w]}) for w in where], pa.list_(pa.string()))], ["doc_id", "key", "starts", "lengths", "items"])

        part = scratch.table(keyed.mapInArrow(run, "doc_id long, key long, starts array<long>, lengths array<long>, items array<string>"))
        found = part if found is None else found.union(part)
    own = found.groupBy("doc_id", "key").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("lengths")).alias("lengths"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    own = own.withColumnsRenamed({"doc_id": "d", "key": "k"})
    joined = keyed.join(own, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left").select("doc_id", "text", "starts", "lengths", "items")

    def finish(batches):
        for batch in batches:
            for rows, data, offsets in text_groups(batch.column(1)):
                n = Words(LOWER[data], offsets, ALNUM).n
                part = batch.slice(rows.start, rows.stop - rows.start)
                starts, lengths, items = (part.column(i).to_pylist() for i in (2, 3, 4))
                hit = [int(covered(int(m), np.array(s, np.int64), np.array(w, np.int64)).sum()) if s else 0 for m, s, w in zip(n, starts, lengths, strict=True)]
                yield _result(part.column(0), n, hit, [sorted(x or []) for x in items])

    return joined.mapInArrow(finish, _RESULT)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, k: int = 8, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of ``docs``.

    A word is hit if it lies in an occurrence of any ``window`` consecutive
    words of an item (or of all words of a shorter item); a document is
    contaminated if a twentieth of its words or more are hit.  Null and empty
    texts have no words and no hits.  Rows repeated or without doc_id each give
    a row; items repeated under one item_id count once; an item_id that is null
    counts as the empty string.  An empty benchmark hits nothing.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = _blocks(benchmark, item_col, item_text_col, block)
    first = Block(*next(parts), window, k)
    rest = next(parts, None)
    if rest is None:
        return _one_pass(docs, first)

    def all_blocks():
        yield first
        yield Block(*rest, window, k)
        for part in parts:
            yield Block(*part, window, k)

    return _many_passes(docs, all_blocks())


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, k: int = 8, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` without any occurrence of a benchmark window.

    However long a text is, one window of an item (an item of fewer words is a
    window of its own) takes it out: the share that :func:`decontaminate`
    reports says how much of a text is benchmark, not whether it leaks any.
    Each row is judged by its own text, so rows without doc_id or of one doc_id
    are too; null and empty texts stay, and so do all for an empty benchmark.
    """
    scratch, before = Scratch(docs.sparkSession, "clean"), None
    for part in _blocks(benchmark, "item_id", "text", block):
        if before is not None:  # a benchmark of many blocks: one stored pass for each
            docs = scratch.table(before)
        before = keep_rows(docs, _without_hits(docs.sparkSession.sparkContext.broadcast(Block(*part, window, k))))
    return before


def _without_hits(shared):
    def good(column):
        out = np.ones(len(column), bool)
        for rows, _, doc, start, _, _ in _spans(column, shared.value):
            out[rows.start + doc[start]] = False
        return out

    return good


#: The same result in DuckDB SQL.
SQL = r"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0),
bg AS (SELECT DISTINCT item, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bw)),
ks AS (SELECT DISTINCT k FROM bg),
dg AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT doc_id, k, i, item FROM dg JOIN bg USING (k, g)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, k, i FROM hit)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""
