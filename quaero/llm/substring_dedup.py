"""Substring deduplication by suffix automata of reference shards.

A window of ``window`` words goes where it also starts in a document with a
smaller doc_id.  Streaming every document past every shard of the corpus is
quadratic, so documents are first brought to the shards that can match them:
each window picks the k-gram of least hash in it (winnowing), equal windows pick
equal ones, and only windows whose pick is in two documents or more go on.
Consecutive windows with one pick form a segment.  Equal segments are counted
once, with their smallest doc_id; a later copy loses all its windows.  Of the
distinct segments, dealt to shards by their pick, each shard's task builds a
suffix automaton in order of doc_id and streams every segment through the
automaton of smaller documents for its matching statistics: a match as long as a
window marks that window.

Segments of a pick that very many documents have are cut into windows, dealt by
their own hash, so no pick fills a shard.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaero.llm.scratch import Scratch
from quaero.llm.skew import lookup
from quaero.llm.wordbytes import SPACE, Words, covered, gram_in_doc, grams, mix, text_groups

K = 6
#: Documents with a pick from which on its segments are cut; distinct segments of a shard, on average.
HOT_PICK, SHARD = 20_000, 20_000


class Automaton:
    """A suffix automaton of several word sequences."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _split(self, p: int, word, q: int) -> int:
        """The state for q's words that end after p's; q if that is q itself."""
        if self.length[q] == self.length[p] + 1:
            return q
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = new
            p = self.link[p]
        return new

    def add(self, words) -> None:
        last = 0
        for word in words:
            if (q := self.next[last].get(word)) is not None:
                last = self._split(last, word, q)
                continue
            new, p = len(self.next), last
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, word, self.next[p][word])
            last = new

    def statistics(self, words):
        """For each position, the length of the longest match that ends there."""
        state = size = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if (to := self.next[state].get(word)) is not None:
                state, size = to, size + 1
            yield size


class Segments:
    """The segments of a group of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, k: int):
        self.words = Words(data, offsets, ~SPACE)
        self.hash, doc = self.words.hashes(), self.words.doc()
        self.whole = grams(self.hash, window)
        gram = grams(self.hash, k)
        n = len(self.whole)
        width = window - k + 1
        best, at = gram[width - 1 : width - 1 + n].copy(), np.full(n, width - 1)
        for j in range(width - 2, -1, -1):
            lower = gram[j : j + n] < best
            best[lower] = gram[j : j + n][lower]
            at[lower] = j
        at += np.arange(n)
        valid = np.flatnonzero(gram_in_doc(doc, window)) if n else np.zeros(0, np.int64)
        at = at[valid]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1] + 1)
        starts = np.flatnonzero(new)
        self.start = valid[starts]  # first window
        self.n = np.diff(np.append(starts, len(at)))  # windows
        self.pick = gram[at[starts]]
        self.doc = doc[self.start]


def _name(first: np.ndarray, last: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A segment's hash: its first and last window say all its words."""
    return mix(first * np.uint64(0x9E3779B97F4A7C15) + mix(last) + n.astype(np.uint64))


def _picks(texts: DataFrame, window: int, k: int) -> DataFrame:
    """(pick, doc_id, row), once for each pick of a text; row is the text's hash."""

    def run(batches):
        for batch in batches:
            for rows, data, offsets in text_groups(batch.column(1)):
                s = Segments(data, offsets, window, k)
                order = np.lexsort((s.pick, s.doc))
                doc, pick = s.doc[order], s.pick[order]
                first = np.ones(len(doc), bool)
                first[1:] = (doc[1:] != doc[:-1]) | (pick[1:] != pick[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(pick[first].view(np.int64)), *(batch.column(c).take(pa.array(doc[first] + rows.start)) for c in (0, 2))], ["pick", "doc_id", "row"])

    return texts.select("doc_id", "text", "row").mapInArrow(run, "pick long, doc_id long, row long")


def _segments(candidates: DataFrame, window: int, k: int) -> DataFrame:
    """(doc_id, row, start, n, segment, shard key, words) of the candidates' segments with a shared pick."""

    def run(batches):
        for batch in batches:
            for rows, data, offsets in text_groups(batch.column(1)):
                s = Segments(data, offsets, window, k)
                shared = batch.column(2).slice(rows.start, rows.stop - rows.start)
                lists = [np.frombuffer(x.values.buffers()[1], np.int64)[x.values.offset : x.values.offset + len(x.values)].view(np.uint64) for x in shared]
                hot = [np.array(x.as_py(), bool) for x in batch.column(3).slice(rows.start, rows.stop - rows.start)]
                size = np.array([len(x) for x in lists])
                owner = mix(np.repeat(np.arange(len(lists)), size).astype(np.uint64) + np.uint64(1))
                keys = mix(np.concatenate(lists) + owner) if len(lists) else np.zeros(0, np.uint64)
                order = np.argsort(keys)
                keys, hot = keys[order], np.concatenate(hot)[order] if len(lists) else np.zeros(0, bool)
                mine = mix(s.pick + mix(s.doc.astype(np.uint64) + np.uint64(1)))
                at = np.minimum(np.searchsorted(keys, mine), max(0, len(keys) - 1))
                found = keys[at] == mine if len(keys) else np.zeros(len(mine), bool)
                cut = found & hot[at] if len(keys) else found
                plain = found & ~cut
                n_cut = s.n[cut]
                inside = np.arange(int(n_cut.sum())) - np.repeat(np.cumsum(n_cut) - n_cut, n_cut)
                start = np.concatenate((s.start[plain], np.repeat(s.start[cut], n_cut) + inside))
                n = np.concatenate((s.n[plain], np.ones(int(n_cut.sum()), np.int64)))
                key = np.concatenate((s.pick[plain], s.whole[np.repeat(s.start[cut], n_cut) + inside]))
                doc = np.concatenate((s.doc[plain], np.repeat(s.doc[cut], n_cut)))
                name = _name(s.whole[start], s.whole[start + n - 1], n)
                raw = s.hash.tobytes()
                words = [raw[8 * a : 8 * (a + m + window - 1)] for a, m in zip(start.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(doc + rows.start)) for c in (0, 4)), pa.array((start - s.words.first[doc]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(name.view(np.int64)), pa.array(key.view(np.int64)), pa.array(words, pa.binary())], ["doc_id", "row", "start", "n", "segment", "key", "words"])

    return candidates.mapInArrow(run, "doc_id long, row long, start int, n int, segment long, key long, words binary")


def mark(segments: list[tuple[int, int, bytes]], window: int) -> list[int]:
    """For (doc_id, name, word hashes) of a shard's distinct segments: which of each one's windows, as bits, a smaller document has.

    The automaton grows in order of doc_id, so a match is in a smaller document.
    """
    order = sorted(range(len(segments)), key=lambda i: segments[i][:2])
    out = [0] * len(segments)
    automaton = Automaton()
    for _, same in groupby(order, key=lambda i: segments[i][0]):
        same = [(i, np.frombuffer(segments[i][2], np.uint64).tolist()) for i in same]
        for i, words in same:
            for at, size in enumerate(automaton.statistics(words)):
                if size >= window:
                    out[i] |= 1 << (at - window + 1)
        for _, words in same:
            automaton.add(words)
    return out


def _marks(distinct: DataFrame, window: int, shards: int) -> DataFrame:
    """(segment, low, bits, uses) of the distinct segments (segment, key, low, words, uses)."""

    def run(_, table):
        rows = table.select(["segment", "low", "bits", "uses", "key", "words"])
        # a pick with one segment matches nothing else
        keys, inverse, count = np.unique(table.column("key").to_numpy(), return_inverse=True, return_counts=True)
        many = np.flatnonzero(count[inverse] > 1)
        low, name, words = table.column("low").to_numpy(), table.column("segment").to_numpy(), table.column("words")
        bits = np.zeros(len(table), np.int64)
        if len(many):
            bits[many] = mark([(int(low[i]), int(name[i]), words[int(i)].as_py()) for i in many], window)
        return pa.table([rows.column("segment"), rows.column("low"), pa.array(bits), rows.column("uses")], names=["segment", "low", "bits", "uses"])

    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).withColumn("bits", F.lit(0).cast("long"))
    return dealt.groupBy("shard").applyInArrow(run, "segment long, low long, bits long, uses long")


def dedup(docs: DataFrame, window: int = 13, k: int = K, hot_pick: int = HOT_PICK, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of ``docs``.

    A word is removed if a window over it also starts in a document with a
    smaller doc_id, as the documents come in.  Null and empty texts, and texts
    shorter than a window, lose nothing.  A row without doc_id has no smaller
    document and is none: it stays whole.  Rows with one doc_id and different
    texts are not smaller than each other; each repeated row gives a row.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("row", F.xxhash64("text"))
    scratch = Scratch(docs.sparkSession, "substrings")
    named = texts.where("doc_id is not null")
    picks = _picks(named, window, k)
    shared = scratch.table(picks.groupBy("pick").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("low < high").select("pick", "n"))
    total = shared.agg(F.sum("n")).first()[0] or 0
    own = lookup(picks, shared, "pick", "n", total).groupBy("doc_id", "row").agg(F.collect_set(F.struct("pick", (F.col("n") >= hot_pick).alias("hot"))).alias("p"))
    own = scratch.table(own.select("doc_id", "row", F.col("p.pick").alias("picks"), F.col("p.hot").alias("hot")))
    found = scratch.table(_segments(named.join(own, ["doc_id", "row"]).select("doc_id", "text", "picks", "hot", "row"), window, k))
    scratch.drop(shared, own)
    distinct = scratch.table(found.groupBy("segment", "key").agg(F.min("doc_id").alias("low"), F.count("*").alias("uses"), F.first("words").alias("words")))
    shards = max(1, distinct.count() // shard)
    marks = scratch.table(_marks(distinct, window, shards))
    scratch.drop(distinct)
    uses = marks.agg(F.sum("uses")).first()[0] or 0
    placed = lookup(found.select("segment", "doc_id", "row", "start", "n"), marks, "segment", "uses", uses)
    bits = F.when(F.col("doc_id") > F.col("low"), F.expr("shiftleft(1L, n) - 1")).otherwise(F.col("bits"))
    gone = placed.select("doc_id", "row", "start", bits.alias("bits")).where("bits <> 0").groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "bits")).alias("g"))
    gone = scratch.table(gone.select("doc_id", "row", F.col("g.start").alias("starts"), F.col("g.bits").alias("bits")))
    return _finish(texts.join(gone, ["doc_id", "row"], "left").select("doc_id", "text", "starts", "bits"), window)


def _finish(joined: DataFrame, window: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            n_words, n_removed, digest = [], [], []
            for text, starts, bits in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                words = text.as_py().encode().split()
                n_words.append(len(words))
                removed = 0
                if starts.is_valid:
                    at, has = np.array(starts.as_py()), np.array(bits.as_py())
                    first = np.concatenate([at[(has >> b) & 1 == 1] + b for b in range(int(has.max()).bit_length())])
                    cover = covered(len(words), first, window)
                    removed = int(cover.sum())
                    words = [w for w, c in zip(words, cover.tolist(), strict=True) if not c]
                n_removed.append(removed)
                digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


#: The same result in DuckDB SQL.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
m AS (SELECT g, min(doc_id) AS low FROM g GROUP BY g HAVING min(doc_id) < max(doc_id)),
r AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN m USING (g) WHERE doc_id > low)),
x AS (SELECT doc_id, list(p) AS gone, count(*) AS n FROM r GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN r USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id) LEFT JOIN k USING (doc_id)
"""
