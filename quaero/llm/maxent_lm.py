"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

The most frequent training words (the head) are dealt by frequency into classes
of :data:`WIDTH`; every other word belongs to one of :data:`TAILS` tail classes
by its last bytes, and there to one of WIDTH buckets by its hash.  A word's
chance is that of its class given the context times that of the word, or of the
bucket, given the class and context; inside a bucket of the tail it is the
add-one frequency.  Context features (previous word, the word before it, both)
are hashed to rows of weights.  Biases start at the training frequencies.

Training documents are dealt by a hash of doc_id and text into as many shards as
the training tokens ask for (:data:`SHARD` tokens each).  A shard's task trains
from shared weights, its documents in the order of their hashes; the shards'
weights are averaged by tokens, in the shards' order, between rounds.  So the
weights follow from the table's rows and not from how these are partitioned.
Each distinct training document is used in one of the rounds.

Word counts cover all training tokens.  Words of at least ``N / KNOWN`` tokens
(at most :data:`KNOWN`) are broadcast; the rest are looked up by a shuffle join
of the documents' rare words with the count table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaero.llm.scratch import Scratch, shuffle_cleanup
from quaero.llm.wordbytes import LOWER, SPACE, Words, mix, segment_sum, text_groups

WIDTH, HEADS, TAILS = 64, 16, 16
KNOWN = 1 << 20
ROWS = 1 << 13
SLOTS = 1 << 18
#: Rounds of training between which the shards' weights are averaged, tokens of a gradient step, and of a shard.
ROUNDS, STEP, SHARD = 2, 8192, 1 << 19
#: Parts of the weights that are averaged each on its own, and shards that are averaged at once.
BLOCKS, TOGETHER = 16, 64
END = np.uint64(0x5EED0FE2D)
_CLASSES = HEADS + TAILS
_HEAD_WORDS = WIDTH * HEADS
_NO_DOC = -(1 << 63)


@dataclass
class Vocabulary:
    """What all tasks know of the training counts."""

    n: int  # training tokens
    v: int  # distinct training tokens
    known: np.ndarray  # hashes of frequent words, in order
    counts: np.ndarray
    number: np.ndarray  # each known word's head number, -1 for tail words
    tail_total: np.ndarray  # tokens + words + 1 of each bucket of the tail

    def __post_init__(self):
        """A table from a hash's low bits to a known word's place; where words share them, the last's, and the rest are searched."""
        self.slots = np.full(4 * SLOTS, -1, np.int32)
        low = (self.known & np.uint64(4 * SLOTS - 1)).astype(np.int64)
        self.slots[low] = np.arange(len(low))
        self.shared = np.zeros(4 * SLOTS, bool)
        self.shared[low[self.slots[low] != np.arange(len(low))]] = True

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's place among the known ones, -1 if it isn't."""
        if not len(self.known):
            return np.full(len(hashes), -1)
        low = (hashes & np.uint64(4 * SLOTS - 1)).astype(np.int64)
        at = self.slots[low]
        miss = self.known[at] != hashes
        at[miss] = -1
        again = np.flatnonzero(miss)
        again = again[self.shared[low[again]]]
        found = np.minimum(np.searchsorted(self.known, hashes[again]), len(self.known) - 1)
        at[again] = np.where(self.known[found] == hashes[again], found, -1)
        return at


@dataclass
class Weights:
    class_bias: np.ndarray
    word_bias: np.ndarray
    to_class: np.ndarray  # ROWS x classes
    to_word: np.ndarray  # ROWS x WIDTH

    def flat(self) -> np.ndarray:
        return np.concatenate([self.to_class.ravel(), self.to_word.ravel()])

    def with_flat(self, flat: np.ndarray) -> Weights:
        cut = self.to_class.size
        return Weights(self.class_bias, self.word_bias, flat[:cut].reshape(self.to_class.shape).astype(np.float32), flat[cut:].reshape(self.to_word.shape).astype(np.float32))


class Tokens:
    """The tokens of a group of texts, each text's end among them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = LOWER[data]
        words = Words(data, offsets, ~SPACE)
        n = len(words.n)
        self.first = words.first + np.arange(n + 1)
        self.n = np.diff(self.first)
        self.doc = np.repeat(np.arange(n), self.n)
        ends = self.first[1:] - 1
        body = np.ones(len(self.doc), bool)
        body[ends] = False
        self.hash = np.full(len(self.doc), END, np.uint64)
        self.hash[body] = words.hashes()
        last = np.zeros(len(words.start), np.uint64)
        for back in (1, 2, 3):
            at = words.end - back
            last = last * np.uint64(257) + np.where(at >= words.start, data[np.maximum(at, 0)], 0).astype(np.uint64)
        self.tail = np.zeros(len(self.doc), np.int64)
        self.tail[body] = (mix(last) % np.uint64(TAILS)).astype(np.int64) * WIDTH + (self.hash[body] >> np.uint64(40)).astype(np.int64) % WIDTH

    def symbols(self, vocabulary: Vocabulary) -> np.ndarray:
        """Head numbers, then buckets of the tail after them."""
        self.place = vocabulary.look_up(self.hash)
        head = np.where(self.place >= 0, vocabulary.number[self.place] if len(vocabulary.number) else -1, -1)
        return np.where(head >= 0, head, _HEAD_WORDS + self.tail)


def contexts(symbol: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols one and two tokens before each, one past all symbols at a text's start, for texts of ``size`` tokens."""
    none = WIDTH * _CLASSES
    one, two = np.full(len(symbol), none), np.full(len(symbol), none)
    one[1:], two[2:] = symbol[:-1], symbol[:-2]
    place = np.arange(len(symbol)) - np.repeat(np.cumsum(size) - size, size)
    return np.where(place >= 1, one, none), np.where(place >= 2, two, none)


_SYMBOLS = WIDTH * _CLASSES + 1


def _rows(*parts) -> np.ndarray:
    """Rows of weights by hash; 16 bits, so that they sort by radix."""
    key = np.zeros(1, np.uint64)
    for p in parts:
        key = (key + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93) + np.atleast_1d(p).astype(np.uint64)
    return (mix(key) % np.uint64(ROWS)).astype(np.uint16)


_every = np.arange(_SYMBOLS)
_ROW_ONE, _ROW_TWO = _rows(1, _every), _rows(2, _every)
_GROUP_ONE, _GROUP_TWO = (_rows(k, np.repeat(_every, _CLASSES), np.tile(np.arange(_CLASSES), _SYMBOLS)) for k in (4, 5))


def class_rows(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, ...]:
    both = (one * _SYMBOLS + two).astype(np.uint32) * np.uint32(0x9E3779B1)
    return _ROW_ONE[one], _ROW_TWO[two], ((both >> np.uint32(15)) % np.uint32(ROWS)).astype(np.uint16)


def word_rows(one: np.ndarray, two: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, ...]:
    return _GROUP_ONE[one * _CLASSES + group], _GROUP_TWO[two * _CLASSES + group]


def _scores(bias: np.ndarray, table: np.ndarray, rows: tuple[np.ndarray, ...]) -> np.ndarray:
    """Unnormalized log chances.  Biases are log chances and weights are small, so only a bound keeps them from overflowing."""
    x = np.take(table, rows[0], axis=0)
    for r in rows[1:]:
        x += np.take(table, r, axis=0)
    x += bias
    return np.minimum(x, 60, out=x)


def _totals(x: np.ndarray) -> np.ndarray:
    """Sums of rows, as a product with ones."""
    return x @ np.ones(x.shape[1], x.dtype)


def _chances(weights: Weights, symbol, one, two):
    """(class rows, class scores, word rows, word scores) of tokens; a word's class is its number over WIDTH."""
    rows = class_rows(one, two)
    by_class = _scores(weights.class_bias, weights.to_class, rows)
    group = symbol // WIDTH
    inner = word_rows(one, two, group)
    return rows, by_class, inner, _scores(weights.word_bias[group], weights.to_word, inner)


def log_chances(weights: Weights, symbol, one, two) -> np.ndarray:
    """Natural log chances of symbols in their contexts."""
    out = np.empty(len(symbol))
    for at in range(0, len(symbol), STEP):
        s = symbol[at : at + STEP]
        _, by_class, _, by_word = _chances(weights, s, one[at : at + STEP], two[at : at + STEP])
        out[at : at + STEP] = _log_chance(by_class, s // WIDTH) + _log_chance(by_word, s % WIDTH)
    return out


def _log_chance(x: np.ndarray, target: np.ndarray) -> np.ndarray:
    own = x[np.arange(len(x)), target].astype(np.float64)
    return own - np.log(_totals(np.exp(x, out=x)).astype(np.float64))


def _gradient(x: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What was seen less what was expected; x is overwritten."""
    np.exp(x, out=x)
    x *= (-1 / _totals(x))[:, None]
    x[np.arange(len(x)), target] += 1
    return x


def _step(table: np.ndarray, seen: np.ndarray, rows: tuple[np.ndarray, ...], gradient: np.ndarray, rate: float) -> None:
    """Add each row's summed gradients, over the root of how often the row was met."""
    for own in rows:
        order = np.argsort(own, kind="stable")
        sorted_ = own[order]
        starts = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
        count = np.diff(np.append(starts, len(own)))
        hit = sorted_[starts]
        seen[hit] += count
        table[hit] += (rate / np.sqrt(seen[hit] + 30.0))[:, None].astype(np.float32) * _run_sums(np.take(gradient, order, axis=0), starts, count)


def _run_sums(x: np.ndarray, starts: np.ndarray, count: np.ndarray, long: int = 16) -> np.ndarray:
    """Sums of the runs of rows of x: long ones each as a product with ones, the others place by place."""
    out = np.empty((len(starts), x.shape[1]), x.dtype)
    ones = np.ones(int(count.max(initial=1)), x.dtype)
    for i in np.flatnonzero(count >= long).tolist():
        out[i] = ones[: count[i]] @ x[starts[i] : starts[i] + count[i]]
    short = np.flatnonzero(count < long)
    short = short[np.argsort(-count[short], kind="stable")]
    at, n = starts[short], count[short]
    total = np.take(x, at, axis=0)
    for place in range(1, long):
        m = int(np.searchsorted(-n, -place, "left"))  # runs with more rows than this
        if not m:
            break
        total[:m] += np.take(x, at[:m] + place, axis=0)
    out[short] = total
    return out


def train_on(weights: Weights, seen: tuple[np.ndarray, np.ndarray], symbol, one, two, rate: float = 0.35) -> None:
    """Gradient steps over tokens, in place."""
    for at in range(0, len(symbol), STEP):
        s, a, b = symbol[at : at + STEP], one[at : at + STEP], two[at : at + STEP]
        rows, by_class, inner, by_word = _chances(weights, s, a, b)
        _step(weights.to_class, seen[0], rows, _gradient(by_class, s // WIDTH), rate)
        _step(weights.to_word, seen[1], inner, _gradient(by_word, s % WIDTH), rate)


def _count(docs: DataFrame) -> DataFrame:
    """(h, tail, c): all training tokens' counts."""

    def run(batches):
        kept, size = [], 0

        def counted():
            h, t = np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept])
            h, at, c = np.unique(h, return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(t[at].astype(np.int32)), pa.array(c)], ["h", "tail", "c"])

        for batch in batches:
            for _, data, offsets in text_groups(batch.column(2)):
                tokens = Tokens(data, offsets)
                kept.append((tokens.hash, tokens.tail))
                size += len(tokens.hash)
                if size > 4_000_000:
                    yield counted()
                    kept, size = [], 0
        if size:
            yield counted()

    return docs.where("not held_out").select("doc_id", "key", "text").mapInArrow(run, "h long, tail int, c long").groupBy("h").agg(F.first("tail").alias("tail"), F.sum("c").alias("c"))


def _vocabulary(counts: DataFrame) -> tuple[Vocabulary, Weights]:
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.where(F.col("c") * F.lit(KNOWN) >= F.lit(int(n))).toPandas()
    h, c = top["h"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)
    tail = top["tail"].to_numpy(np.int64)
    order = np.argsort(h)
    h, c, tail = h[order], c[order], tail[order]
    by_count = np.lexsort((h, -c))
    ends = by_count[h[by_count] == END]  # the end is a head token however few texts there are
    head = np.concatenate((ends, by_count[h[by_count] != END]))[:_HEAD_WORDS]
    head = head[np.lexsort((h[head], -c[head]))]
    number = np.full(len(h), -1)
    number[head] = np.arange(len(head))
    total = np.ones(TAILS * WIDTH)
    for r in counts.groupBy("tail").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        total[r.tail] += r.c + r.v
    np.subtract.at(total, tail[head], c[head] + 1)
    words = np.zeros(_HEAD_WORDS)
    words[: len(head)] = c[head]
    words = np.concatenate((words, total)).reshape(_CLASSES, WIDTH)
    share = words.sum(1)
    log_share = lambda x: np.log(np.maximum(x, 1e-6) / np.maximum(x, 1e-6).sum(-1, keepdims=True)).astype(np.float32)
    weights = Weights(log_share(share), log_share(words), np.zeros((ROWS, _CLASSES), np.float32), np.zeros((ROWS, WIDTH), np.float32))
    return Vocabulary(int(n), int(v), h, c, number, total), weights


def _train(docs: DataFrame, vocabulary, weights: Weights, part: int, parts: int, shard: int) -> Weights:
    """One round over a share of the distinct training documents: each shard trains, and the weights are averaged by tokens."""
    shards = max(1, -(-vocabulary.value.n // (parts * shard)))
    start = docs.sparkSession.sparkContext.broadcast(weights)

    def read(batches):
        """(shard, key, symbols) of documents; what this task has met lately is not given again."""
        met: set[tuple[int, int]] = set()
        for batch in batches:
            for rows, data, offsets in text_groups(batch.column(2)):
                own = batch.slice(rows.start, rows.stop - rows.start)
                names = list(zip(own.column(0).to_pylist(), own.column(1).to_pylist(), strict=True))
                new = []
                for i, name in enumerate(names):
                    if name not in met:
                        met.add(name)
                        new.append(i)
                if len(met) > 500_000:
                    met.clear()
                if not new:
                    continue
                tokens = Tokens(data, offsets)
                symbol = tokens.symbols(vocabulary.value).astype("<u2")
                given = pa.array([symbol[tokens.first[i] : tokens.first[i + 1]].tobytes() for i in new], pa.binary())
                yield pa.RecordBatch.from_arrays([own.column(3).take(new), own.column(1).take(new), own.column(0).take(new), given], ["shard", "key", "doc_id", "symbols"])

    def train(key, table):
        table = table.sort_by([("key", "ascending"), ("doc_id", "ascending")])
        names = np.stack([table.column(c).to_numpy() for c in ("key", "doc_id")], 1)
        first = np.append(True, (names[1:] != names[:-1]).any(1))
        texts = [np.frombuffer(x.as_py(), "<u2").astype(np.int64) for x in table.column("symbols").filter(pa.array(first))]
        own, seen, done, at = weights_of(start.value), (np.zeros(ROWS), np.zeros(ROWS)), 0, 0
        while at < len(texts):  # some 64 steps at once
            end = at + 1
            while end < len(texts) and sum(map(len, texts[at:end])) < 64 * STEP and end - at < 4096:
                end += 1
            symbol, size = np.concatenate(texts[at:end]), np.array([len(x) for x in texts[at:end]])
            train_on(own, seen, symbol, *contexts(symbol, size))
            done, at = done + len(symbol), end
        blocks = np.array_split(own.flat(), BLOCKS)
        number = key[0].as_py()
        return pa.table({"block": np.arange(BLOCKS), "team": np.full(BLOCKS, number // TOGETHER), "shard": np.full(BLOCKS, number), "n": np.full(BLOCKS, float(done)), "w": pa.array([b.tobytes() for b in blocks], pa.binary())})

    def average(key, table):
        table = table.sort_by("shard")
        total, n = None, 0.0
        for size, w in zip(table.column("n").to_pylist(), table.column("w"), strict=True):
            value = np.frombuffer(w.as_py(), np.float32) * size
            total, n = (value, size) if total is None else (total + value, n + size)
        first = table.column("shard")[0].as_py()
        return pa.table({"block": [key[0].as_py()], "team": [first // TOGETHER // TOGETHER], "shard": [first // TOGETHER], "n": [n], "w": pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())})

    schema = "block long, team long, shard long, n double, w binary"
    chosen = docs.where(f"not held_out and pmod(key, {parts}) = {part}").select("doc_id", "key", "text", F.expr(f"pmod(xxhash64(key, doc_id), {shards})").alias("shard"))
    trained = chosen.mapInArrow(read, "shard long, key long, doc_id long, symbols binary").groupBy("shard").applyInArrow(train, schema)
    left = shards
    while left > 1:  # a team of shards at a time
        trained = trained.groupBy("block", "team").applyInArrow(average, schema)
        left = -(-left // TOGETHER)
    with shuffle_cleanup(docs.sparkSession):
        rows = sorted(trained.collect(), key=lambda r: r.block)
    start.unpersist()
    return weights.with_flat(np.concatenate([np.frombuffer(bytes(r.w), np.float32) for r in rows])) if rows else weights


def weights_of(shared: Weights) -> Weights:
    """A copy to train."""
    return Weights(shared.class_bias, shared.word_bias, shared.to_class.copy(), shared.to_word.copy())


def _rare(tokens: Tokens, rare: np.ndarray) -> list[pa.Array]:
    """Each text's tokens among ``rare``: their hashes, and how often each comes, as lists."""
    at = np.flatnonzero(rare)
    order = at[np.lexsort((tokens.hash[at], tokens.doc[at]))]
    h, doc = tokens.hash[order], tokens.doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(new)
    cuts = pa.array(np.searchsorted(doc[starts], np.arange(len(tokens.n) + 1)).astype(np.int32))
    times = np.diff(np.append(starts, len(h))).astype(np.int32)
    return [pa.ListArray.from_arrays(cuts, pa.array(h[starts].view(np.int64))), pa.ListArray.from_arrays(cuts, pa.array(times))]


def _repeated(texts: DataFrame, piece: int = 1000) -> DataFrame:
    """Each row ``m`` times; pieces of rows that come very often are dealt out before they are written out."""
    once = texts.where(F.col("m") <= piece)
    often = texts.where(F.col("m") > piece).withColumn("piece", F.explode(F.sequence(F.lit(0), F.expr(f"(m - 1) div {piece}"))))
    often = often.repartition("doc_id", "key", "piece").withColumn("times", F.least(F.lit(piece), F.col("m") - piece * F.col("piece"))).drop("piece")
    both = once.withColumn("times", F.col("m")).unionByName(often)
    return both.withColumn("_", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int")))).drop("_", "times")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``.

    Trains on the rows whose crc32 of doc_id (as text) modulo 7 is not 2; a row
    without doc_id trains.  Null and empty texts have one token, the end.
    Repeated rows each give a row; other columns are not read.  Without training
    rows all words are unknown.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "maxent")
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_DOC)).alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"), held.alias("held_out"))
    counts = scratch.table(_count(docs))
    known, weights = _vocabulary(counts)
    vocabulary = spark.sparkContext.broadcast(known)
    for part in range(ROUNDS):
        weights = _train(docs, vocabulary, weights, part, ROUNDS, shard)
    model = spark.sparkContext.broadcast(weights)

    def by_text(batches):
        words = vocabulary.value
        log_known = np.log10(words.counts + 1.0)
        for batch in batches:
            for rows, data, offsets in text_groups(batch.column(2)):
                part, tokens = batch.slice(rows.start, rows.stop - rows.start), Tokens(data, offsets)
                symbol = tokens.symbols(words)
                p = log_chances(model.value, symbol, *contexts(symbol, tokens.n)) / np.log(10)
                seen = tokens.place >= 0
                frequent = np.where(seen, log_known[tokens.place] if len(log_known) else 0.0, 0.0)
                inner = frequent - np.log10(words.tail_total)[tokens.tail]
                value = p + np.where(symbol >= _HEAD_WORDS, inner, 0.0)
                sums = [tokens.n, segment_sum(seen, tokens.first), segment_sum(frequent, tokens.first) - tokens.n * np.log10(words.n + words.v + 1.0), segment_sum(value, tokens.first)]
                lists = _rare(tokens, ~seen)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), *map(pa.array, sums), *lists], ["doc_id", "key", "held_out", "n_tokens", "known", "base", "value", "rare", "times"])

    schema = "doc_id long, key long, held_out boolean, n_tokens long, known long, base double, value double, rare array<long>, times array<int>"
    read = scratch.table(docs.select("doc_id", "key", "text", "held_out").mapInArrow(by_text, schema))
    texts = read.drop("rare", "times")
    rare = read.select("doc_id", "key", F.inline(F.arrays_zip(F.col("rare").alias("h"), F.col("times").alias("n"))))
    rest = counts.where(F.col("c") * F.lit(KNOWN) < F.lit(known.n)).select("h", "c")
    added = rare.join(rest, "h").groupBy("doc_id", "key").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("n").alias("found"))
    same = ["doc_id", "key", "held_out", "n_tokens", "known"]
    texts = texts.groupBy(*same).agg(F.count("*").alias("m"), F.min("base").alias("base"), F.min("value").alias("value"))  # repeated rows are one, and come back below
    out = _repeated(texts.join(added, ["doc_id", "key"], "left"))
    more = F.coalesce("more", F.lit(0.0)) / F.col("m")
    return out.select(
        F.nullif("doc_id", F.lit(_NO_DOC)).alias("doc_id"), "held_out", "n_tokens", (F.col("known") + F.coalesce(F.expr("found div m"), F.lit(0))).cast("long").alias("n_known"),
        F.lit(known.n).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("value") + more).alias("score"),
    )
