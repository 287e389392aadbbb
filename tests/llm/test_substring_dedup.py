import hashlib
import random

import pytest

from quaero.llm import substring_dedup as s


def plain(rows):
    first = {}
    split = [(i, (t or "").replace("\t", " ").replace("\n", " ").split(" ")) for i, t in rows]
    split = [(i, [w for w in x if w]) for i, x in split]
    for i, w in split:
        for a in range(len(w) - 12):
            if i is not None:
                g = tuple(w[a : a + 13])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, w in split:
        gone = set()
        for a in range(len(w) - 12):
            if i is not None and first[tuple(w[a : a + 13])] < i:
                gone |= set(range(a, a + 13))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for n, x in enumerate(w) if n not in gone).encode()).hexdigest()))
    return out


def rows(seed):
    rng = random.Random(seed)
    passages = [[f"p{n}w{rng.randrange(30)}" for _ in range(rng.randrange(10, 60))] for n in range(6)]
    made = []
    for i in range(60):
        text = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            text += p[a : a + rng.randrange(5, 40)] + [f"u{rng.randrange(50)}" for _ in range(rng.randrange(3))]
        made.append((rng.randrange(1, 45), " ".join(text)))  # some ids more than once
    return made + [(100, "same " * 40), (101, "same " * 60), (101, "same " * 60), (None, "same " * 40), (103, None), (104, "")]


@pytest.mark.parametrize("hot, shard", [(20_000, 20_000), (3, 5)])
def test_equals_brute_force(make, hot, shard):
    given = rows(hot)
    out = s.dedup(make(given), hot_pick=hot, shard=shard).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted((tuple(r) for r in out), key=order) == sorted(plain(given), key=order)


def test_awkward_and_empty(make, awkward):
    from awkward_rows import AWKWARD

    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted((tuple(r) for r in s.dedup(awkward).collect()), key=order) == sorted(plain(AWKWARD), key=order)
    assert s.dedup(make([])).count() == 0


def test_automaton_statistics():
    rng = random.Random(3)
    seqs = [[rng.randrange(3) for _ in range(rng.randrange(1, 15))] for _ in range(12)]
    automaton = s.Automaton()
    for x in seqs:
        automaton.add(x)
    subs = {tuple(x[a:b]) for x in seqs for a in range(len(x)) for b in range(a + 1, len(x) + 1)}
    query = [rng.randrange(4) for _ in range(200)]
    expected = [max((n for n in range(i + 2) if not n or tuple(query[i + 1 - n : i + 1]) in subs)) for i in range(len(query))]
    assert list(automaton.statistics(query)) == expected
