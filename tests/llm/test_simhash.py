import math

import numpy as np
import pytest
import xxhash

from awkward_rows import AWKWARD
from quaero.llm import components, simhash
from quaero.llm.scratch import Scratch
from quaero.llm.skew import sift


def plain_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest(ids, prints):
    """Brute force: the smallest id that each row reaches."""
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    groups = {}
    for i, x in enumerate(ids):
        groups.setdefault(find(i), []).append(x)
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(ids))]


def test_awkward_rows(awkward):
    from awkward_rows import AWKWARD

    out = simhash.near_duplicates(awkward).collect()
    prints = [plain_fingerprint(t) for _, t in AWKWARD]
    expected = smallest([i for i, _ in AWKWARD], prints)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    assert sorted((tuple(r) for r in out), key=key) == sorted([(i, f"{p:016x}", c) for (i, _), p, c in zip(AWKWARD, prints, expected, strict=True)], key=key)
    assert out[0].__fields__ == ["doc_id", "fingerprint", "component_id"]


def test_empty_table(make):
    assert simhash.near_duplicates(make([])).count() == 0


@pytest.mark.parametrize(("slice_values", "inner"), [(4_000_000, 2), (20_000, 0), (20_000, 3)])
def test_links_equal_brute_force(spark, slice_values, inner):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    prints = [int(b) for b in base]
    for b in base:  # chains of steps of at most four bits, and neighbours just out of reach
        x = int(b)
        for _ in range(6):
            for bit in rng.choice(63, rng.integers(1, 6), replace=False):
                x ^= 1 << int(bit)
            prints.append(x)
    prints = sorted(set(prints))
    scratch = Scratch(spark, "test")
    nodes = scratch.table(spark.createDataFrame([(p,) for p in prints], "fp long"))
    links = simhash.ball_links(scratch, nodes, len(prints), 4, slice_values, inner)
    got = {r.a: r.b for r in components.components(scratch, links).collect()}
    assert [got.get(p, p) for p in prints] == smallest(prints, prints)


def test_long_chain_settles(spark):
    scratch = Scratch(spark, "chain")
    links = scratch.table(spark.createDataFrame([(i + 1, i) for i in range(200)], "a long, b long"))
    got = {r.a: r.b for r in components.components(scratch, links).collect()}
    assert got == {i: 0 for i in range(1, 201)}


def test_one_of_each_group_stays(make):
    same, long = "w " * 50, " ".join(f"v{i}" for i in range(90))
    rows = [(1, same), (2, same), (2, same), (3, "other words here now"), (None, same), (4, None), (5, " "), (None, None), (6, "a b"), (7, long), (7, long), (7, "c d e f g"), (None, "only here"), (None, "only here"), (8, long + " end")]
    docs = make(rows)
    out = simhash.keep_one(docs)
    assert out.dtypes == docs.dtypes
    kept = sorted((r.doc_id or 0, r.text or "") for r in out.collect())
    assert kept == sorted([(1, same), (3, "other words here now"), (4, ""), (6, "a b"), (7, long), (7, "c d e f g"), (0, "only here")])
    assert simhash.keep_one(make([])).count() == 0


def test_one_of_each_awkward_text_stays(awkward):
    assert {r.text or "" for r in simhash.keep_one(awkward).collect()} == {"", "one", "one two three", *(t for i, t in AWKWARD if i in (5, 6, 7))}


def test_similar_texts_are_found_and_others_left(make):
    rng = np.random.default_rng(8)
    rows, group, sets = [], [], []
    for i in range(60):
        words = [f"w{k}" for k in rng.integers(0, 2000, 200)]
        for copy in range(3):
            own = list(words)
            for at in rng.choice(200, [0, 2, 8][copy], replace=False):
                own[at] = f"new{i}x{copy}x{at}"
            rows.append((len(rows), " ".join(own)))
            group.append(i)
            sets.append({" ".join(own[k : k + 5]) for k in range(196)})
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(make(rows)).collect()}
    near = [(a, b) for a in range(len(rows)) for b in range(a) if group[a] == group[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(near) > 60
    assert sum(got.get(a, a) == got.get(b, b) for a, b in near) >= 0.95 * len(near)
    linked = {(a, b) for a, b in near} | {(b, a) for a, b in near}
    for a, b in got.items():  # whatever was grouped is connected by similar pairs
        seen, todo = {a}, [a]
        while todo:
            x = todo.pop()
            for y in range(3 * group[a], 3 * group[a] + 3):
                if (x, y) in linked and y not in seen:
                    seen.add(y)
                    todo.append(y)
        assert b in seen


def test_comparing_a_group_of_copies_is_not_quadratic():
    ids = np.arange(5000)
    sketches = np.zeros((5000, 6), np.uint64)
    texts = simhash.Sketches(ids, sketches, np.ones(5000), simhash.Shape(26, 6, 14, 75, 0.8))
    a, b = simhash.meet_near(texts, np.zeros(5000, np.uint64), np.arange(5000))
    assert a.tolist() == list(range(1, 5000)) and not b.any()


def test_each_pair_of_different_roots_that_meets_is_given_once():
    rng = np.random.default_rng(4)
    shape = simhash.Shape(26, 7, 17, 70, 0.8)
    base = rng.integers(0, 2**63, shape.lanes, dtype=np.uint64)
    sketches = np.array([base ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 63, (rng.integers(1, 9), shape.lanes), dtype=np.uint64)) for _ in range(90)])
    ids, roots, size = rng.permutation(90) + 100, rng.integers(0, 7, 90), rng.integers(80, 104, 90).astype(float)
    texts = simhash.Sketches(ids, sketches, size, shape)
    bits = lambda i, t: sum(int(w) << 64 * k for k, w in enumerate(sketches[i])) >> t * shape.bits & (1 << shape.bits) - 1
    meets = lambda i, j: any((bits(i, t) ^ bits(j, t)).bit_count() <= 2 for t in range(shape.tables))
    near = lambda i, j: np.bitwise_count(sketches[i] ^ sketches[j]).sum() <= shape.allowed and min(size[i], size[j]) >= 0.8 * max(size[i], size[j])
    expected = sorted((max(ids[i], ids[j]), min(ids[i], ids[j])) for i in range(90) for j in range(i) if roots[i] != roots[j] and near(i, j) and meets(i, j))
    assert 300 < len(expected) < 0.95 * 90 * 89 / 2
    every = simhash.masks(1)[: shape.bits + 1]
    for step in (7, 500_000):
        got = []
        for table in range(shape.tables):
            short = simhash.chunk(sketches, table, shape.bits)
            assert [int(x) for x in short] == [bits(i, table) for i in range(90)]
            values, owner = np.concatenate([short ^ m for m in every]), np.tile(np.arange(90), len(every))
            a, b = simhash.meet_apart(texts, roots, values, owner, table, step)
            got += zip(a.tolist(), b.tolist(), strict=True)
        assert sorted(got) == expected
    assert not len(simhash.meet_apart(texts, roots * 0, values, owner, 16)[0])


def test_shape_follows_the_number_of_texts():
    few, many = simhash.Shape.of(1000, 0.8), simhash.Shape.of(10**9, 0.8)
    assert few.bits == 26 and 2**many.bits >= 27 * 10**9 and many.tables > few.tables
    for shape in (few, many):
        assert shape.tables * shape.bits <= shape.lanes * 64 and 1 - (1 - sum(math.comb(shape.bits, k) * 0.1515**k * 0.8485 ** (shape.bits - k) for k in range(3))) ** shape.tables > 0.969


def test_a_ball_reaches_few_slices():
    for bits, most in ((0, 1), (3, 7), (10, 56)):
        codes = simhash.slice_codes(bits)
        assert len(np.unique(simhash.slice_of(simhash.masks(2), codes))) == most
    home = np.bincount(simhash.slice_of(np.random.default_rng(0).integers(0, 2**63, 64000, dtype=np.uint64) * np.uint64(2), simhash.slice_codes(6)), minlength=64)
    assert home.min() > 800


def test_sift_misses_no_key(spark, monkeypatch):
    from pyspark.sql import functions as F

    left = spark.range(3000).select(F.col("id").alias("_word"), F.xxhash64("id").alias("h"))
    keys = left.where("_word % 7 = 0").select(F.col("h").alias("k"))
    for words, most in ((1 << 19, 440), (4, 3000)):
        monkeypatch.setattr("quaero.llm.skew.WORDS", words)
        out = sift(left, F.col("h"), keys, F.col("k"), "maybe")
        assert out.columns == ["_word", "h", "maybe"] and out.count() == 3000
        flagged = {r._word for r in out.where("maybe").collect()}
        assert {i for i in range(3000) if i % 7 == 0} <= flagged and len(flagged) <= most


def test_slices_change_no_link(spark):
    rng = np.random.default_rng(2)
    shape = simhash.Shape.of(1000, 0.8)
    base = rng.integers(0, 2**63, (40, shape.lanes), dtype=np.uint64)
    rows = []
    for i in range(400):
        own = base[i % 40].copy()
        for b in rng.choice(shape.lanes * 64, int(rng.integers(0, 50)), replace=False):
            own[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        rows.append((i, 100, i // 2, bytearray(own.tobytes())))
    scratch = Scratch(spark, "slices")
    nodes = scratch.table(spark.createDataFrame(rows, "id long, size long, root long, sketch binary"))
    links = lambda *how: sorted(map(tuple, simhash.similar_links(scratch, nodes, 400, shape, *how).collect()))
    whole = links()
    assert len(whole) > 1000 and links(1000, 0) == links(500, 2) == whole == sorted(set(whole))


@pytest.mark.parametrize("size", [3, 12])
def test_recall_of_families_around_the_bound(make, size):
    """Families of edited copies with pairs on both sides of 0.8: of the pairs of 0.8 or more nine in ten at least end in one group."""
    rng = np.random.default_rng(size)
    rows, sets = [], []
    for i in range(240 // size):
        words = [f"w{k}" for k in rng.integers(0, 3000, 250)]
        for copy in range(size):
            own = list(words)
            for at in rng.choice(250, rng.integers(2, 5), replace=False):
                own[at] = f"new{i}x{copy}x{at}"
            rows.append((len(rows), " ".join(own)))
            sets.append({" ".join(own[k : k + 5]) for k in range(246)})
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(make(rows)).collect()}
    near = [(a, b) for a in range(len(rows)) for b in range(a - a % size, a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    found = sum(got.get(a, a) == got.get(b, b) for a, b in near)
    assert len(near) > 100 and found >= 0.95 * len(near), (found, len(near))


def test_families_near_the_bound_lose_no_link(make):
    """Copies edited at random, some pairs on each side of 0.8: groups are those of all pairs of 0.8 or more."""
    rng = np.random.default_rng(13)
    rows, sets = [], []
    for i in range(10):
        words = [f"w{k}" for k in rng.integers(0, 3000, 300)]
        for copy in range(16):
            own = list(words)
            for at in rng.choice(300, rng.integers(3, 5), replace=False):
                own[at] = f"new{i}x{copy}x{at}"
            rows.append((len(rows), " ".join(own)))
            sets.append({" ".join(own[k : k + 5]) for k in range(296)})
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(make(rows)).collect()}
    near = [(a, b) for a in range(len(rows)) for b in range(a - a % 16, a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    lost = [(a, b) for a, b in near if got.get(a, a) != got.get(b, b)]
    assert len(near) > 500 and not lost, (len(near), len(lost))


def test_near_texts_with_different_leaders_are_connected():
    """Two members are near each other, but each is near another leader, and the leaders are not."""
    spans = [(0, 0), (0, 180), (0, 60), (0, 120)]
    sketches = np.array([np.packbits([s <= k < e for k in range(384)], bitorder="little").view("<u8") for s, e in spans])
    texts = simhash.Sketches(np.arange(4), sketches, np.ones(4), simhash.Shape(26, 6, 14, 75, 0.8))
    a, b = simhash.meet_near(texts, np.zeros(4, np.uint64), np.arange(4))
    assert len(a) == 3 and not simhash.forest(4, a, b).any()


def test_forests_connect_all_that_meets(spark):
    rng = np.random.default_rng(5)
    shape = simhash.Shape.of(1000, 0.8)
    base = rng.integers(0, 2**63, (4, shape.lanes), dtype=np.uint64)
    rows = []
    for i in range(200):
        own = base[i % 4].copy()
        for b in rng.choice(shape.lanes * 64, int(rng.integers(20, 50)), replace=False):
            own[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        rows.append((i, 100, i, bytearray(own.tobytes())))
    scratch = Scratch(spark, "forests")
    nodes = scratch.table(spark.createDataFrame(rows, "id long, size long, root long, sketch binary"))
    linked = lambda some: np.array(simhash.similar_links(scratch, some, 200, shape).collect()).T
    pairs, forests = linked(nodes), linked(nodes.drop("root"))
    assert len(pairs[0]) > len(forests[0])
    assert simhash.forest(200, *pairs).tolist() == simhash.forest(200, *forests).tolist()


@pytest.mark.parametrize("step", [7, 1 << 22])
def test_similar_roots_equal_brute_force(step):
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.choice(60, int(n), replace=False)) for n in rng.integers(40, 60, 80)] + [np.array([], int)] * 2
    side = rng.integers(0, 2, len(sets))
    size, flat = np.array([len(x) for x in sets]), np.concatenate(sets)
    for sides in (None, side):
        near = [(i, j) for i in range(len(sets)) for j in range(i) if (sides is None or side[i] != side[j]) and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
        expected = simhash.forest(len(sets), *np.array(near).T)
        assert 1 < len(set(expected.tolist())) < 80
        assert simhash.similar_roots(size, flat, 0.8, sides, step).tolist() == expected.tolist()


@pytest.mark.parametrize("block", [1 << 20, 10_000])
def test_rows_of_a_family_below_the_bound_grow_with_its_texts(make, monkeypatch, block):
    """All texts of a family are near by sketch, few pairs are 0.8 similar: no step lists the pairs, and none of 0.8 is lost."""
    rng = np.random.default_rng(21)
    rows, sets = [], []
    words = [f"w{k}" for k in rng.integers(0, 3000, 300)]
    for copy in range(150):
        own = list(words)
        for at in rng.choice(300, rng.integers(4, 9), replace=False):
            own[at] = f"new{copy}x{at}"
        rows.append((len(rows), " ".join(own)))
        sets.append({" ".join(own[k : k + 5]) for k in range(296)})
    made = []
    for name in ("similar_links", "_compared"):
        plain = getattr(simhash, name, None)
        if plain:
            monkeypatch.setattr(simhash, name, lambda *x, plain=plain: made.append((out := plain(*x)).count()) or out)
    if hasattr(simhash, "BLOCK"):
        monkeypatch.setattr(simhash, "BLOCK", block)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(make(rows)).collect()}
    assert len(made) > 1 and max(made) < 14 * 150, made
    near = [(a, b) for a in range(150) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = simhash.forest(150, *np.array(near).T)
    assert 20 < len(near) < 0.2 * 150 * 149 / 2 and 10 < len(set(root.tolist()))
    assert [got.get(i, i) for i in range(150)] == root.tolist()
