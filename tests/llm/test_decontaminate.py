import hashlib
import re

import pytest

from awkward_rows import AWKWARD
from quaero.llm import decontaminate as d


def words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(text, items):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        v = words(t)
        k = min(13, len(v))
        grams = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if v else set()
        for i in range(len(w) - k + 1):
            if k and tuple(w[i : i + k]) in grams:
                hit |= set(range(i, i + k))
                found.add("" if item is None else str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


LONG = " ".join(f"word{i}" for i in range(40))
ITEMS = [(10, LONG), (9, "Short item, here"), (None, None), (3, ""), (9, "short item here"), (2, "a " * 60), (7, " ".join(f"word{i}" for i in range(20, 60))), (None, "tiny")]
TEXTS = [
    (1, "x " + LONG.upper() + " y"), (2, " ".join(f"word{i}" for i in range(5, 17))), (3, " ".join(f"word{i}" for i in range(5, 18)) + " z" * 400), (4, "some SHORT-item_here."), (5, "a " * 500), (5, "a " * 500),
    (6, " ".join(f"word{i}" for i in range(15, 45))), (None, LONG), (7, "Tiny ö"), (8, None), (9, " ".join(f"word{i}" for i in range(0, 13))), (11, "word0 " + LONG),
]


@pytest.mark.parametrize("block", [16_000_000, 300])
def test_equals_brute_force(spark, make, awkward, block):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").repartition(2)
    out = d.decontaminate(make(TEXTS), bench, block=block).collect()
    expected = [(i, *plain(t, ITEMS)) for i, t in TEXTS]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted((tuple(r) for r in out), key=order) == sorted(expected, key=order)
    assert d.decontaminate(awkward, bench, block=block).count() == len(AWKWARD)


def test_empty_tables(spark, make):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert d.decontaminate(make([]), bench).count() == 0
    none = d.decontaminate(make(TEXTS), bench.limit(0)).collect()
    assert len(none) == len(TEXTS) and not any(r.contaminated for r in none)


@pytest.mark.parametrize("block", [16_000_000, 300])
def test_stage_drops_every_text_with_a_window(spark, make, awkward, block):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    passage = " ".join(f"word{i}" for i in range(7, 20))
    rows = [*TEXTS, (20, "z " * 2500 + passage + " z" * 2500), (20, "z " * 5000), (None, "z"), (21, "z " * 2500 + passage[:-1] + " z" * 2500)]
    docs = make(rows)
    out = d.drop_contaminated(docs, bench, block=block)
    assert out.dtypes == docs.dtypes
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    expected = [(i, t) for i, t in rows if not plain(t, ITEMS)[1]]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=order) == sorted(expected, key=order)
    assert (20, "z " * 5000) in expected and (None, "z") in expected and sum(i in (20, 21) for i, _ in expected) == 2
    assert d.drop_contaminated(make([]), bench, block=block).count() == 0
    assert d.drop_contaminated(docs, bench.limit(0), block=block).count() == len(rows)
    assert d.drop_contaminated(awkward, bench, block=block).count() == sum(not plain(t, ITEMS)[1] for _, t in AWKWARD)
