"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most four bits share a 64-bit value that is
within two bits of either.  So every distinct fingerprint stands for the 2,081
values in its ball of radius two, fingerprints meet on equal values, and each
group that shares a value is linked as a star (its members are all within four
bits of each other, so a star loses no connection and costs no pairs).

Shuffling 2,081 rows a fingerprint would cost some 30 KB each.  The values are
dealt out by a linear hash instead: each bit of a slice's number is the parity
of a share of the fingerprint's bits, so a changed bit changes one bit of the
slice, and a ball of radius two reaches 1 + s + s(s - 1)/2 of 2^s slices.  A
fingerprint is sent once to each of those, eight bytes a time, and the slice's
task makes just the values that fall there.  The number of slices grows with
the fingerprints, so a task's values stay bounded.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaero.llm.components import components
from quaero.llm.scratch import Scratch
from quaero.llm.skew import free_name, lookup, sift
from quaero.llm.wordbytes import LOWER, SPACE, Words, grams, mix, text_groups

BITS = 64
#: Values that one task holds at most, on average (16 bytes each with their order).
SLICE_VALUES = 4_000_000
_ONE = np.uint64(1)


def fingerprint(text: str | None, width: int = 4) -> int:
    """The 64-bit SimHash of a text's word shingles; zero if it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends[: len(words) - width]]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s : e - 1], 42) for s, e in zip(starts, ends[width - 1 :], strict=True)]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = np.array(hashes[at : at + (1 << 16)], dtype="<u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row for each input row; fp holds the bits as a signed long."""

    def run(batches):
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, fp long")


def masks(radius: int) -> np.ndarray:
    """All sets of at most ``radius`` bits."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(BITS), r)], np.uint64)


def slice_codes(bits: int) -> np.ndarray:
    """A code for each fingerprint bit, one bit of the slice's number; the XOR of a value's codes is its slice."""
    return 1 << (np.arange(BITS, dtype=np.int64) % bits) if bits else np.zeros(BITS, np.int64)


def slicing(values: int, most: int, inner: int, width: int = BITS) -> tuple[np.ndarray, int, int]:
    """(codes, bits dealt by, all bits) of slices of ``most`` values or fewer on average, for fingerprints of ``width`` bits.

    A task gets the slices that differ in the last ``inner`` bits of their
    number alone, and takes one after the other; a fingerprint is dealt by the
    first ones only.
    """
    every = min(width, max(0, int(np.ceil(np.log2(max(1, values / most))))))
    return slice_codes(every), max(0, every - inner), every


def slice_of(values: np.ndarray, codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values), np.int64)
    for b in range(BITS):
        out ^= np.where((values >> np.uint64(b)) & _ONE, codes[b], 0)
    return out


def meet(xs: np.ndarray, part: int, codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (larger, smaller) among ``xs`` by the values of their balls of half the radius in one slice.

    The links form a forest: as many as are needed to connect what meets here.
    """
    every = masks(radius // 2)
    mask_slice = slice_of(every, codes)
    xs = np.unique(xs)
    home = slice_of(xs, codes)
    made, owner = [], []
    for v in np.unique(home):
        mine = np.flatnonzero(home == v)
        fit = every[mask_slice == (v ^ part)]
        made.append((xs[mine][:, None] ^ fit[None, :]).ravel())
        owner.append(np.repeat(mine, len(fit)))
    if not made:
        return xs[:0], xs[:0]
    made, owner = np.concatenate(made), np.concatenate(owner)
    order = np.argsort(made)
    made, owner = made[order], owner[order]
    del order
    new = np.ones(len(made), bool)
    new[1:] = made[1:] != made[:-1]
    shared = ~new
    shared[:-1] |= ~new[1:]
    owner, new = owner[shared], new[shared]  # values with one owner link nothing
    if not len(owner):
        return xs[:0], xs[:0]
    starts = np.flatnonzero(new)
    least = np.repeat(np.minimum.reduceat(owner, starts), np.diff(np.append(starts, len(owner))))
    other = owner != least
    a, b = owner[other], least[other]
    near = np.bitwise_count(xs[a] ^ xs[b]) <= radius
    a, b = a[near], b[near]
    root = forest(len(xs), a, b)
    moved = np.flatnonzero(root != np.arange(len(xs)))
    return xs[moved], xs[root[moved]]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component, for links a-b among 0..n-1."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        high, low = np.maximum(ra[apart], rb[apart]), np.minimum(ra[apart], rb[apart])
        np.minimum.at(root, high, low)
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
    return root


def ball_links(scratch: Scratch, nodes: DataFrame, count: int, radius: int = 4, slice_values: int = SLICE_VALUES, inner: int = 2) -> DataFrame:
    """Links (a > b) that connect all of ``nodes`` (column fp, distinct) within ``radius`` bits."""
    every = masks(radius // 2)
    codes, bits, all_bits = slicing(count * len(every), slice_values, inner)
    low = np.int64((1 << bits) - 1)
    reach = np.unique(slice_of(every, codes) & low)

    def deal(batches):
        step = max(1, 4_000_000 // len(reach))
        for batch in batches:
            xs = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(xs), step):
                block = xs[at : at + step]
                to = ((slice_of(block, codes) & low)[:, None] ^ reach[None, :]).ravel()
                order = np.argsort(to, kind="stable")
                to = to[order]
                sent = np.repeat(block, len(reach))[order]
                cuts = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
                ends = np.append(cuts[1:], len(to))
                yield pa.RecordBatch.from_arrays([pa.array(to[cuts]), pa.array([sent[s:e].tobytes() for s, e in zip(cuts, ends, strict=True)], pa.binary())], ["part", "xs"])

    def join(key, table):
        xs = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("xs")])
        met = [meet(xs, key[0].as_py() | more << bits, codes, radius) for more in range(1 << (all_bits - bits))]
        a, b = (np.concatenate(x) for x in zip(*met, strict=True))
        return pa.table({"x": pa.array(a.view(np.int64)), "y": pa.array(b.view(np.int64))})

    dealt = nodes.select("fp").mapInArrow(deal, "part long, xs binary")
    met = dealt.groupBy("part").applyInArrow(join, "x long, y long")
    return scratch.table(met.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, id_col: str = "doc_id", text_col: str = "text", slice_values: int = SLICE_VALUES) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``.

    Fingerprints at ``radius`` (even) or fewer differing bits are linked;
    component_id is the smallest doc_id reachable.  Null and empty texts, and
    texts of white space, have fingerprint zero and are linked like any other.
    A row with a null doc_id is kept; its component is the smallest known
    doc_id, null if there is none.  Repeated rows each give a row.  Columns of
    ``docs`` other than the two named are not read.  No rows give no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.table(fingerprints(docs, width, id_col, text_col))
    nodes, seen = scratch.counted(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), count=F.count(F.lit(1)), total=F.sum("n"))
    count, total = seen["count"], seen["total"]
    links = ball_links(scratch, nodes, count, radius, slice_values)
    stars = components(scratch, links)
    placed = nodes.join(stars.withColumnRenamed("a", "fp"), "fp", "left").select("fp", "least", "n", F.coalesce("b", "fp").alias("root"))
    placed = scratch.table(placed)
    roots = scratch.table(placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")))
    named = lookup(placed.select("root", "fp", "n"), roots, "root", "members", count or 0).select("fp", "n", "component_id")
    out = lookup(prints, scratch.table(named), "fp", "n", total or 0)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Chance that a pair just as similar as asked meets, at least; bits of a short fingerprint, at least.
MEETING, LEAST_BITS = 0.97, 26


@dataclass(frozen=True)
class Shape:
    """Sketches of whole texts: lanes of 64 bits, dealt into ``tables`` short fingerprints of ``bits`` bits."""

    bits: int
    lanes: int
    tables: int
    allowed: int
    similarity: float

    @classmethod
    def of(cls, count: int, similarity: float) -> Shape:
        """For ``count`` texts.

        A short fingerprint has so many bits that the values of all balls of
        radius one are fewer than its values: unrelated texts that share one
        stay few however many texts there are.  Pairs meet where two bits or
        fewer differ; there are tables enough for :data:`MEETING`.  ``allowed``
        differing bits of a whole sketch are two and a half deviations over
        the number expected.
        """
        apart = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
        bits = max(LEAST_BITS, int(np.ceil(np.log2((LEAST_BITS + 1) * max(1, count)))))
        meets = sum(comb(bits, k) * apart**k * (1 - apart) ** (bits - k) for k in range(3))
        lanes = int(np.ceil(np.ceil(np.log(1 - MEETING) / np.log1p(-meets)) * bits / BITS))
        return cls(bits, lanes, lanes * BITS // bits, int(lanes * BITS * apart + 2.5 * np.sqrt(lanes * BITS * apart * (1 - apart))), similarity)


def shingle_sets(column: pa.Array, width: int):
    """Each text's distinct word shingles as 64-bit hashes, in order; one for a text of fewer words, none for one without."""
    for _, data, offsets in text_groups(column):
        words = Words(LOWER[data], offsets, ~SPACE)
        hashes = words.hashes()
        every = grams(hashes, width)
        for start, n in zip(words.first.tolist(), words.n.tolist(), strict=False):
            yield np.unique(every[start : start + n - width + 1]) if n >= width else grams(hashes[start : start + n], n) if n else hashes[:0]


def sketch(own: np.ndarray, lanes: int) -> np.ndarray:
    """``lanes`` SimHashes of a text's distinct shingles, as unsigned longs; zeros for none."""
    out = np.zeros(lanes, np.uint64)
    for lane in range(lanes if len(own) else 0):
        ones = np.zeros(BITS, np.int64)
        hashed = mix(own + np.uint64((lane + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        for at in range(0, len(own), 1 << 16):
            ones += np.unpackbits(hashed[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[lane] = np.packbits(2 * ones > len(own), bitorder="little").view("<u8")[0]
    return out


def chunk(sketches: np.ndarray, table: int, bits: int) -> np.ndarray:
    """The short fingerprint of a table: ``bits`` bits of each sketch, from table * bits on."""
    word, at = divmod(table * bits, BITS)
    out = sketches[:, word] >> np.uint64(at)
    if at + bits > BITS:
        out = out | (sketches[:, word + 1] << np.uint64(BITS - at))
    return out & np.uint64((1 << bits) - 1)


@dataclass
class Sketches:
    """Texts of one task: ids, sketches and numbers of distinct shingles."""

    ids: np.ndarray
    sketch: np.ndarray
    size: np.ndarray
    shape: Shape

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Differing bits of the sketches of pairs."""
        return np.bitwise_count(self.sketch[a] ^ self.sketch[b]).sum(1)

    def fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pairs have sizes that allow the similarity: it is at most the smaller over the larger."""
        a, b = self.size[a], self.size[b]
        return np.minimum(a, b) >= self.shape.similarity * np.maximum(a, b)


def meet_near(texts: Sketches, values: np.ndarray, owner: np.ndarray, step: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """Links (larger id, smaller id) that connect all owners that share a value and are near by sketch and size.

    In each group with one value a member that is not linked yet is compared
    with all members, until every member is linked or was compared: as many
    comparisons as members times the groups of copies among them, not pairs.
    Members that are still not connected are then compared pair by pair.  The
    links form a forest, fewer than the owners; by shingles they may fail where
    a pair that they connect would not, so what they connect is to be compared.
    """
    ids, every = texts.ids, (values, owner)
    order = np.lexsort((ids[owner], values))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    shared = ~new
    shared[:-1] |= ~new[1:]
    owner, new = owner[shared], new[shared]
    group = np.cumsum(new) - 1
    free = np.ones(len(owner), bool)
    out = [(owner[:0], owner[:0])]
    while len(owner):
        size = np.bincount(group)
        place = np.where(free, np.arange(len(owner)), len(owner))
        leader = np.full(len(size), len(owner))
        np.minimum.at(leader, group, place)
        on = leader[group] < len(owner)  # groups with a member to compare
        owner, group, free, at = owner[on], group[on], free[on], leader[group[on]] - np.searchsorted(np.flatnonzero(~on), leader[group[on]])
        if not len(owner):
            break
        head = owner[at]
        near = (texts.apart(owner, head) <= texts.shape.allowed) & texts.fit(owner, head)
        pair = near & (owner != head)
        out.append((owner[pair], head[pair]))
        free &= ~near
        pairs_only = np.bincount(group)[group] <= 2  # both were compared
        owner, group, free = owner[~pairs_only], group[~pairs_only], free[~pairs_only]
        group = np.unique(group, return_inverse=True)[1] if len(group) else group
    a, b = (np.concatenate(x) for x in zip(*out, strict=True))
    root = forest(len(ids), a, b)
    linked = np.zeros(len(ids), bool)
    linked[a] = linked[b] = True
    some = linked[every[1]]  # a member near no leader was one itself, and is near none
    for a, b, _ in near_pairs(texts, root, every[0][some], every[1][some], step):
        apart = root[a] != root[b]
        if apart.any():
            moved = np.flatnonzero(root != np.arange(len(root)))
            root = forest(len(root), np.concatenate((moved, a[apart])), np.concatenate((root[moved], b[apart])))
    moved = np.flatnonzero(root != np.arange(len(root)))
    a, b = ids[moved], ids[root[moved]]
    return np.maximum(a, b), np.minimum(a, b)


def near_pairs(texts: Sketches, roots: np.ndarray, values: np.ndarray, owner: np.ndarray, step: int):
    """Yield (a, b, value): owners with different roots that share a value and are near by sketch and size, from some ``step`` pairs a time."""
    order = np.lexsort((texts.ids[owner], roots[owner], values))
    values, owner = values[order], owner[order]
    first = np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    other = first.copy()
    other[1:] |= roots[owner[1:]] != roots[owner[:-1]]
    here = np.arange(len(values))
    start = np.maximum.accumulate(np.where(first, here, 0))
    n = np.maximum.accumulate(np.where(other, here, 0)) - start  # members before it of other roots
    some = np.flatnonzero(n)
    done, at = np.cumsum(n[some]), 0
    while at < len(some):
        end = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + step, "right")))
        own, times = some[at:end], n[some[at:end]]
        a = owner[np.repeat(own, times)]
        b = owner[np.repeat(start[own], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
        near = (texts.apart(a, b) <= texts.shape.allowed) & texts.fit(a, b)
        yield a[near], b[near], np.repeat(values[own], times)[near]
        at = end


def meet_apart(texts: Sketches, roots: np.ndarray, values: np.ndarray, owner: np.ndarray, table: int, step: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (larger id, smaller id) of owners with different roots that share a value and are near by sketch and size.

    Members of a group that have one root are not compared with each other.  A
    pair is given in the first table in which it meets, at one value that both
    balls have, so all tasks together give each pair once.  ``step`` bounds the
    pairs that are held at once.
    """
    ids, out = texts.ids, [np.empty((0, 2), np.int64)]
    for a, b, value in near_pairs(texts, roots, values, owner, step):
        given = meets_first(texts.sketch[a], texts.sketch[b], value, texts.shape, table)
        a, b = ids[a[given]], ids[b[given]]
        out.append(np.stack((np.maximum(a, b), np.minimum(a, b)), 1))
    pairs = np.concatenate(out)
    return pairs[:, 0], pairs[:, 1]


def meets_first(x: np.ndarray, y: np.ndarray, value: np.ndarray, shape: Shape, table: int) -> np.ndarray:
    """Whether pairs of sketches that share ``value`` in ``table`` meet in no table before it, and at no value that comes before this one."""
    a, b = chunk(x, table, shape.bits), chunk(y, table, shape.bits)
    differ = a ^ b
    out = value == (np.minimum(a, b) ^ (differ & (~differ + _ONE)))  # of the values that both have, the one with their lowest differing bit changed
    for before in range(table):
        out &= np.bitwise_count(chunk(x, before, shape.bits) ^ chunk(y, before, shape.bits)) > 2
    return out


def similar_links(scratch: Scratch, nodes: DataFrame, count: int, shape: Shape, slice_values: int = 2_000_000, inner: int = 3) -> DataFrame:
    """Candidate links (a > b) among ``nodes`` (id, sketch, size): ball hashing with half radius one in each table of short fingerprints.

    Each task gives a forest of its links; where ``nodes`` have a column root,
    all its pairs of different roots, which can be as many as the square of a
    family's size.
    """
    every = masks(1)[: shape.bits + 1]
    codes, bits, all_bits = slicing(count * len(every), slice_values, inner, shape.bits)
    low = np.int64((1 << bits) - 1)
    mask_slice = slice_of(every, codes)
    reach = np.unique(mask_slice & low)
    rooted = "root" in nodes.columns
    record = np.dtype([("id", "<i8"), ("size", "<u4"), *([("root", "<i8")] if rooted else []), ("s", "<u8", (shape.lanes,))])

    def deal(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                rows = batch.slice(at, 20_000)
                own = np.zeros(rows.num_rows, record)
                for i, name in enumerate(("id", "size", *["root"] * rooted)):
                    own[name] = rows.column(i).to_numpy(zero_copy_only=False)
                own["s"] = np.frombuffer(b"".join(rows.column(rows.num_columns - 1).to_pylist()), "<u8").reshape(-1, shape.lanes)
                for table in range(shape.tables):
                    home = slice_of(chunk(own["s"], table, shape.bits), codes) & low
                    for r in np.unique(home):
                        mine = own[home == r].tobytes()
                        to = (r ^ reach).tolist()
                        yield pa.RecordBatch.from_arrays([pa.array([table] * len(to)), pa.array(to), pa.array([mine] * len(to), pa.binary())], ["table", "part", "rows"])

    def join(key, table):
        own = np.concatenate([np.frombuffer(x.as_py(), record) for x in table.column("rows")])
        texts, number = Sketches(own["id"].copy(), own["s"].copy(), own["size"].astype(float), shape), key[0].as_py()
        short = chunk(texts.sketch, number, shape.bits)
        home, met = slice_of(short, codes), []
        for more in range(1 << (all_bits - bits)):
            values, owner = [], []
            for m, at in zip(every, mask_slice, strict=True):
                mine = np.flatnonzero(home == (at ^ (key[1].as_py() | more << bits)))
                values.append(short[mine] ^ m)
                owner.append(mine)
            values, owner = np.concatenate(values), np.concatenate(owner)
            met.append(meet_apart(texts, own["root"], values, owner, number) if rooted else meet_near(texts, values, owner))
        a, b = (np.concatenate(x) for x in zip(*met, strict=True))
        return pa.table({"a": a, "b": b})

    dealt = nodes.select("id", "size", *["root"] * rooted, "sketch").mapInArrow(deal, "table long, part long, rows binary")
    met = dealt.groupBy("table", "part").applyInArrow(join, "a long, b long")
    return scratch.table(met if rooted else met.distinct())


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """A row's key, ordered by doc_id, rows without one last; rows of one key are copies of one document."""
    text, number = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col).cast("long")
    return F.struct(number.isNull().alias("unnamed"), F.coalesce(number, F.lit(0)).alias("doc_id"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g"))


def _grouped(docs: DataFrame, scratch: Scratch, width: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """(key, best) for each row of ``docs``: its key, and the least key of its group of similar texts."""
    count = docs.count()
    shape = Shape.of(count, similarity)
    texts = docs.select(_keyed(docs, id_col, text_col).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    key_type = texts.schema["key"].dataType.simpleString()

    def sketched(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), width))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sketch(x, shape.lanes).tobytes() for x in sets], pa.binary()), pa.array(map(len, sets), pa.int64())], ["key", "sketch", "size"])

    prints = scratch.table(texts.mapInArrow(sketched, f"key {key_type}, sketch binary, size long"))
    nodes, seen = scratch.counted(prints.groupBy("sketch").agg(F.min("key").alias("key"), F.min(F.struct("key", "size"))["size"].alias("size"), F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()), n=F.count(F.lit(1)))
    distinct = seen["n"]
    family = components(scratch, similar_links(scratch, nodes, distinct, shape))
    stars = components(scratch, _compared(scratch, texts, nodes, family, count, width, similarity))
    placed = scratch.table(nodes.join(stars.withColumnRenamed("a", "id"), "id", "left").select("sketch", "key", "n", F.coalesce("b", "id").alias("root")))
    best = scratch.table(placed.groupBy("root").agg(F.min("key").alias("best"), F.count("*").alias("members")))
    named = scratch.table(lookup(placed.select("root", "sketch", "n"), best, "root", "members", distinct).select("sketch", "n", "best"))
    return scratch.table(lookup(prints, named, "sketch", "n", count).select("key", "best"))


def similar_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) of the rows that are not the first of their group of similar texts.

    Texts whose distinct word shingles have that Jaccard similarity or more are
    linked.  One fingerprint of 64 bits and a radius of four finds copies that
    are all but equal; at 0.8 some ten of 64 bits differ.  So a longer sketch
    is dealt into short fingerprints (see :class:`Shape`), balls of radius one
    (radius two for pairs) meet in each, and colliding pairs are compared by
    their sketches.

    What these pairs connect is a family.  No pair is listed: a task gives the
    links of a forest, each text's shingles are brought to its family, and there
    all pairs are compared by their shingles but those already in one group.
    So no pair goes untested for another's sake, and rows grow with the texts.
    The first of a group is the row of the smallest doc_id, ties by text; rows
    without doc_id come last, and component_id is null where all are.
    """
    rows = _grouped(docs, Scratch(docs.sparkSession, "similar"), width, similarity, id_col, text_col)
    id_of = lambda c: F.when(~F.col(f"{c}.unnamed"), F.col(f"{c}.doc_id"))
    return rows.where("key <> best").select(id_of("key").alias("doc_id"), id_of("best").alias("component_id"))


#: Shingles of a family, or of a block of a larger one, that are compared in one task (eight bytes each).
BLOCK = 1 << 20


def similar_roots(size: np.ndarray, shingles: np.ndarray, similarity: float, side: np.ndarray | None = None, step: int = 1 << 22) -> np.ndarray:
    """For each set the first of its group, where sets of that Jaccard similarity or more are linked.

    The sets lie one after the other in ``shingles``.  All pairs are compared
    whose sizes allow the similarity and that no link connects yet; with
    ``side`` those of different sides alone.  ``step`` bounds what is held.
    """
    order = np.argsort(size, kind="stable")
    ends = np.cumsum(size)
    starts = ends - size
    codes = np.unique(shingles, return_inverse=True)[1]
    own = np.zeros(len(codes), bool)
    sizes, root = size[order], np.arange(len(size))
    least = np.searchsorted(sizes, similarity * sizes)
    for i, x in enumerate(order.tolist()):
        rest = order[least[i] : i]
        rest = rest[root[rest] != root[x]]
        if side is not None:
            rest = rest[side[rest] != side[x]]
        if not len(rest):
            continue
        mine = codes[starts[x] : ends[x]]
        own[mine] = True
        done = np.cumsum(size[rest])
        at = 0
        while at < len(rest):
            end = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + step, "right")))
            some = rest[at:end]
            n = size[some]
            till = np.cumsum(n)
            found = np.append(0, np.cumsum(own[codes[np.repeat(starts[some] - till + n, n) + np.arange(till[-1])]]))
            both = found[till] - found[till - n]
            linked = np.append(root[some[both >= similarity * (n + size[x] - both)]], root[x])
            if len(linked) > 1:
                root[np.isin(root, linked)] = linked.min()
            at = end
        own[mine] = False
    return root


def _compared(scratch: Scratch, texts: DataFrame, nodes: DataFrame, family: DataFrame, total: int, width: int, similarity: float) -> DataFrame:
    """Links (a > b) that connect all nodes of a family whose shingles are as similar as asked; ``family`` has (a, b) for each node but the smallest.

    The sets of a family meet in one task.  One of more than :data:`BLOCK`
    shingles is dealt into blocks by hash, and each two of its blocks meet.
    """

    def shingled(batches):
        for batch in batches:
            made = [x.view(np.int64) for x in shingle_sets(batch.column(3), width)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.list_(pa.int64()))], ["id", "family", "blocks", "shingles"])

    def links(parts):
        key = parts[0][0]
        ids, side, size, shingles = (np.concatenate(x) for x in list(zip(*parts, strict=True))[1:])
        root = similar_roots(size, shingles, similarity, None if key[1] == key[2] else side)
        moved = np.flatnonzero(root != np.arange(len(root)))
        a, b = ids[moved], ids[root[moved]]
        return np.maximum(a, b), np.minimum(a, b)

    def compare(batches):
        parts = []  # of the family, or the two blocks, that the rows read last belong to
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            ids, side = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            lists = batch.column(5)
            size, flat = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy()
            till = np.append(0, np.cumsum(size))
            cuts = np.append(np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1))), len(ids)) if len(ids) else np.zeros(1, np.int64)
            out = []
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                key = tuple(keys[s].tolist())
                if parts and parts[0][0] != key:
                    out.append(links(parts))
                    parts = []
                parts.append((key, ids[s:e], side[s:e], size[s:e], flat[till[s] : till[e]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["a", "b"])
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in links(parts)], ["a", "b"])

    members = family.select(F.col("a").alias("id"), F.col("b").alias("family")).union(family.select("b", "b").distinct())
    named = scratch.table(nodes.join(members, "id").select("key", "id", "n", "size", "family"))
    large = named.groupBy("family").agg(F.ceil(F.sum("size") / BLOCK).alias("blocks")).where("blocks > 1")
    dealt = scratch.table(named.join(F.broadcast(large), "family", "left").select("key", "id", "n", "family", F.coalesce("blocks", F.lit(1)).alias("blocks")))
    some = sift(texts, F.col("key.h"), dealt, F.col("key.h"), "maybe").where("maybe").drop("maybe")
    schema = "id long, family long, blocks long, shingles array<long>"
    wanted = lookup(some, dealt, "key", "n", total).select("id", "family", "blocks", "text").mapInArrow(shingled, schema)
    sets = wanted.groupBy("id").agg(*[F.first(c).alias(c) for c in ("family", "blocks", "shingles")])
    sent = sets.withColumn("side", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    sent = sent.select("family", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "id", "side", "shingles")
    met = sent.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "id")
    out = scratch.table(met.mapInArrow(compare, "a long, b long"))
    scratch.drop(family, named, dealt)
    return out


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of similar texts, with all its columns.

    It is that of the smallest doc_id (see :func:`similar_groups`).  Rows of
    one doc_id with different texts are different documents; of rows of one
    doc_id and text one stays.  Null texts, empty ones and those of white space
    are copies of each other; a row without doc_id is kept only if its group
    has no other.  An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "similar")
    rows = _grouped(docs, scratch, width, similarity, "doc_id", "text")
    keys = rows.groupBy("key").agg(F.first("best").alias("best"), F.count("*").alias("m"))
    key, m, again, maybe = (free_name(c, docs) for c in ("_key", "_m", "_again", "_maybe"))
    listed = keys.where("key <> best or m > 1").select(F.col("key").alias(key), F.col("m").alias(m), (F.col("key") == F.col("best")).alias(again))
    listed, seen = scratch.counted(listed, total=F.sum(m), repeated=F.count(F.when(F.col(again), 1)))
    repeated = seen["repeated"]
    hash_of = F.col(key)["h"]
    sifted = sift(docs.withColumn(key, _keyed(docs, "doc_id", "text")), hash_of, listed, hash_of, maybe)
    marked = lookup(sifted.where(maybe), listed, key, m, seen["total"] or 0, "left")
    out = sifted.where(~F.col(maybe)).select(*docs.columns).union(marked.where(F.col(again).isNull()).select(*docs.columns))
    if repeated:  # a row of each key; the others are dropped before the shuffle too
        whole = F.first(F.struct(*[F.col(c) for c in docs.columns])).alias("row")
        out = out.union(marked.where(F.col(again)).groupBy(key).agg(whole).select("row.*"))
    return out
