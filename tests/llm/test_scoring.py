"""Quality rules, toxicity, token counts, language model, HTML and mixing."""

import collections
import itertools
import math
import os
import re
import zlib

import numpy as np
import pytest
import xxhash

from quaero.llm import html_extract, maxent_lm, mixing, quality_crf, token_count, toxicity
from awkward_rows import AWKWARD

SF = "/root/testdata/sf0.001"


# quality rules

N = len(quality_crf.FEATURES)


def base_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = {g for g, n in collections.Counter(grams).items() if n > 1}
    repeat = {i + k for i, g in enumerate(grams) if g in many for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat)


TEXTS = [(20, "a b c a b c d\na b c\nlast line"), (21, "x\n\nx\r\nx\n"), (22, " ".join(f"w{i}" for i in range(80))), (23, "one | two # three\n" * 3 + "é ü"), (24, "ABC !!! " + " ".join(f"w{i}$$$" for i in range(90)))]


def test_quality_base_counts(make):
    rows = AWKWARD + TEXTS
    out = quality_crf.judge(make(rows), quality_crf.PLAIN).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted((tuple(r)[:6] for r in out), key=order) == sorted([(i, *base_counts(t)) for i, t in rows], key=order)
    verdict = {r.doc_id: (r.base_failed, r.kept) for r in out}
    assert verdict[22] == (False, True) and verdict[24] == (False, False) and verdict[1] == (True, False)
    assert quality_crf.judge(make([]), quality_crf.PLAIN).count() == 0


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    model = quality_crf.Crf(rng.normal(size=(N, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    sizes = [1, 4, 2, 7, 1]
    x = rng.normal(size=(sum(sizes), N))
    first = np.concatenate(([0], np.cumsum(sizes)))
    label = quality_crf.viterbi(model, x, first)
    score = x @ model.emission
    for a, b in zip(first, first[1:], strict=False):

        def value(path, a=a):
            return model.start[path[0]] + sum(score[a + t, y] for t, y in enumerate(path)) + sum(model.transition[p, q] for p, q in itertools.pairwise(path))

        assert tuple(label[a:b]) == max(itertools.product((0, 1), repeat=b - a), key=value)


def test_crf_learns_lines_and_needs_both_labels():
    clean, junk = np.eye(N)[[0, 0, 0]], np.eye(N)[[0, 2, 2]]
    junk[:, 3] = 1
    model = quality_crf.fit([clean, junk] * 10, [np.ones(3, int), np.zeros(3, int)] * 10)
    assert quality_crf.viterbi(model, np.concatenate((clean, junk)), np.array([0, 3, 6])).tolist() == [1, 1, 1, 0, 0, 0]
    assert quality_crf.fit([clean], [np.ones(3, int)]) is quality_crf.PLAIN


def test_lines_are_taught_by_evidence_from_whole_texts(spark, make):
    q = quality_crf
    f = lambda *names: [float(n in names or n == "bias") for n in q.FEATURES]
    lines = np.array([f("many words"), f("many words"), f("blank"), f("few words"), f("repeated line", "few words"), f("many words", "symbols")])
    shared = np.array([False, True, False, False, False, False])
    assert q.line_labels(lines, 1, shared).tolist() == [1, 0, 0, 1, 0, 1] and q.line_labels(lines, 0, shared).tolist() == [1, 0, 0, 0, 0, 0]
    assert q.runs_of(0) == [] and q.runs_of(41) == [(0, 40), (40, 41)]
    spans = q.runs_of(100_000)
    assert len(spans) == q.RUNS and spans[0][0] == 0 and spans[-1][1] == 100_000 and all(b - a == q.RUN for a, b in spans)
    good = [(i, "\n".join(" ".join(f"w{i}x{k}y{n}" for n in range(15)) for k in range(6)) + "\nShare this page now\n" + f"last{i} line here") for i in range(60)]
    bad = [(100 + i, "\n".join(f"$$ {i}{k} ## %% **" for k in range(8))) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i, _ in good + bad], "doc_id long, quality int, toxic int")
    models = [q.fit_from_labels(make(rows, parts), labels) for rows, parts in ((good + bad, 2), ((good + bad + good)[::-1], 7))]
    assert all(np.allclose(getattr(models[0], a), getattr(models[1], a), atol=1e-9) for a in ("emission", "transition", "start"))
    out = {r.doc_id: r for r in q.judge(make(good + bad), models[0]).collect()}
    assert all(out[i].content_share > 0.8 for i, _ in good) and all(out[i].content_share < 0.2 for i, _ in bad)


def test_rows_are_kept_by_their_own_text(make, awkward):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(1, long), (1, "short"), (None, long + " x"), (None, None), (2, ""), (3, long), (3, long)]
    docs = make(rows)
    out = quality_crf.keep_good(docs, quality_crf.PLAIN)
    assert out.dtypes == docs.dtypes
    assert sorted(((r.doc_id or 0, r.text) for r in out.collect())) == sorted([(1, long), (0, long + " x"), (3, long), (3, long)])
    assert quality_crf.keep_good(make([]), quality_crf.PLAIN).count() == 0
    assert quality_crf.keep_good(awkward, quality_crf.PLAIN).count() == quality_crf.judge(awkward, quality_crf.PLAIN).where("kept").count()


# toxicity


def toxic_rows(n):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(n):
        words = [f"w{k}" for k in rng.integers(0, 400, 60)]
        bad = i % 5 == 0
        for _ in range(int(rng.integers(2, 9)) if bad else 0):
            words[rng.integers(60)] = str(rng.choice(["grunk", "blorg", "snarfling", "snarfly"]))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity_held_out(spark, make, awkward):
    rows = toxic_rows(600)
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows[:400]] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_from_labels(make([r[:2] for r in rows]), labels)
    out = {r.doc_id: r for r in toxicity.score(make([r[:2] for r in rows]), model).collect()}
    test = rows[400:]
    assert sum(out[i].toxic != bool(t) for i, _, t in test) <= 4
    severity = [out[i].expected_severity for i, _, t in test if t]
    used = [sum(w in x for w in ("grunk", "blorg", "snarf")) for _, x, t in test if t]
    assert np.corrcoef(severity, used)[0, 1] > 0 and all(np.diff(model.thresholds) >= 0)
    assert toxicity.score(awkward, model).count() == len(AWKWARD)
    none = toxicity.fit_from_labels(make([r[:2] for r in rows]), labels.where("toxic = 0"))
    assert none is toxicity.NONE and not any(r.toxic for r in toxicity.score(awkward, none).collect())
    assert toxicity.score(make([]), model).count() == 0


def test_scores_equal_plain_sums(make):
    """Every text's severities by the formula, a feature at a time."""
    model = toxicity.Ordinal({f: 0.1 * (k + 1) for k, w in enumerate(("grunk", "snarfling", "x" * 60)) for f in toxicity.features_of(w)}, np.array([0.4, 1.1, 2.0]))
    rows = [*AWKWARD, (50, "Grunk grunk GRUNK grunk snarf"), (51, "snarflings, " + "x" * 60 + " " + "x" * 61), (52, "gru-nk 4 snarfling")]
    out = toxicity.score(make(rows), model).collect()

    def plain(text):
        x = 0.0
        for word, n in collections.Counter(re.findall(r"[^\W\d_]+", (text or "").lower())).items():
            for key in [word, *(word[:k] + "*" for k in range(4, 8) if len(word) >= k)]:
                x += min(n, 3) * model.weights.get(xxhash.xxh64_intdigest(key) & (1 << toxicity.BITS) - 1, 0.0)
        above = [1 / (1 + math.exp(t - x)) for t in model.thresholds]
        exact = [a - b for a, b in zip([1, *above], [*above, 0])]
        return round(sum(above), 9), exact.index(max(exact)), above[0] >= 0.4

    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r.doc_id, round(r.expected_severity, 9), r.severity, r.toxic) for r in out), key=key) == sorted([(i, *plain(t)) for i, t in rows], key=key)
    assert len({r.severity for r in out}) > 1


def test_ordinal_gradient_finds_order():
    rng = np.random.default_rng(2)
    rows = [np.full(int(k), 7) for k in rng.integers(0, 10, 300)]
    grades = np.array([min(3, len(r) // 3) for r in rows])
    model = toxicity.fit_ordinal(rows, grades, np.ones(300), steps=600)
    chances = model.severity(np.array([len(r) * model.weights[7] for r in rows])).sum(1)
    assert np.corrcoef(chances, grades)[0, 1] > 0.9


# token counts


def model_path():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


SPACES = ["", " ", "  ", "   a  b   c    ", " a", "a ", "\n", "a\nb\n", "▁", "a▁b", "<s> </s><unk>", "　x ｆ", "a\x00b", "é" * 300, " \n \n", "\t\t x", "日本語 テスト", "😀 😀😀", "x" * 5000]


def test_token_counts_are_the_librarys(make):
    path = model_path()
    library = token_count.load(path)
    rows = AWKWARD + list(enumerate(SPACES, 100))
    out = token_count.count_tokens(make(rows), path).collect()
    expected = [(i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 4096) for i, t in rows]
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted((tuple(r) for r in out), key=order) == sorted(expected, key=order)
    assert token_count.count_tokens(make([]), path).count() == 0


def test_proof_lists_single_tokens_only():
    path = model_path()
    whole, library = token_count.prove(path), token_count.load(path)
    assert len(whole) > 10_000 and all(len(library.encode(w)) == 1 for w in sorted(whole)[:2000])


# language model


def test_language_model(make):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{k}" for k in rng.integers(0, 30, 80)) + (f" rare{i} rare{i % 7}" if i % 3 else "")) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "A1 B2 never"), (202, "A1 B2 never"), (None, "a1 b1")]
    tokens = lambda t: [w.lower() for w in (t or "").split()] + [None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = collections.Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    saved, maxent_lm.KNOWN = maxent_lm.KNOWN, 256  # most words are looked up by the join
    try:
        runs = [maxent_lm.score(make(rows, parts), shard=1500).collect() for parts in (2, 8, 13)]
    finally:
        maxent_lm.KNOWN = saved
    out = runs[0]
    name = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens)
    for other in runs[1:]:  # however the rows are partitioned
        for x, y in zip(sorted(out, key=name), sorted(other, key=name), strict=True):
            assert x[:5] == y[:5] and x.score == pytest.approx(y.score, rel=1e-9)
    expected = [(i, held(i), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t))) for i, t in rows]
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    for got, want in zip(sorted((tuple(r) for r in out), key=order), sorted(expected, key=order), strict=True):
        assert got[:5] == want[:5] and got[5] == pytest.approx(want[5]) and got[6] < 0
    unseen = [r for r in out if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)  # two kinds of text: contexts tell which
    assert maxent_lm.score(make([])).count() == 0
    assert maxent_lm.score(make(AWKWARD)).count() == len(AWKWARD)


def random_weights(seed):
    rng, m = np.random.default_rng(seed), maxent_lm
    classes = m.HEADS + m.TAILS
    normal = lambda *shape: rng.normal(size=shape).astype(np.float32)
    return m.Weights(normal(classes), normal(classes, m.WIDTH), normal(m.ROWS, classes), normal(m.ROWS, m.WIDTH))


def test_chances_sum_to_one_over_vocabulary_and_unknown():
    m, w = maxent_lm, random_weights(4)
    every = np.arange(m.WIDTH * (m.HEADS + m.TAILS))
    p = np.exp(m.log_chances(w, every, np.full(len(every), 5), np.full(len(every), 1500)))
    assert p.sum() == pytest.approx(1, abs=1e-4)
    counts = {i: [3, 1, 2] for i in range(m.WIDTH * m.TAILS)}  # words of each bucket, and one unknown
    inner = {i: sum(c + 1 for c in own) + 1 for i, own in counts.items()}
    words = p[: m.WIDTH * m.HEADS].sum() + sum(p[m.WIDTH * m.HEADS + i] * ((c + 1) / inner[i]) for i, own in counts.items() for c in [*own, 0])
    assert words == pytest.approx(1, abs=1e-4)


def test_chances_equal_plain_sums():
    m, w, rng = maxent_lm, random_weights(6), np.random.default_rng(7)
    symbol, size = rng.integers(0, 2048, 40), np.array([1, 2, 30, 7])
    one, two = m.contexts(symbol, size)
    got, at = m.log_chances(w, symbol, one, two), 0
    for n in size:
        for i in range(at, at + n):
            a, b = symbol[i - 1] if i > at else 2048, symbol[i - 2] if i > at + 1 else 2048
            assert (one[i], two[i]) == (a, b)
            group = symbol[i] // 64
            by_class = w.class_bias + sum(w.to_class[r[0]] for r in m.class_rows(np.array([a]), np.array([b])))
            by_word = w.word_bias[group] + sum(w.to_word[r[0]] for r in m.word_rows(np.array([a]), np.array([b]), np.array([group])))
            expected = by_class[group] - math.log(np.exp(by_class.astype(float)).sum()) + by_word[symbol[i] % 64] - math.log(np.exp(by_word.astype(float)).sum())
            assert got[i] == pytest.approx(expected, abs=1e-3)
        at += n


def test_rows_that_come_very_often(spark):
    rows = [(1, 5, 2500, "a"), (2, 6, 1, "b"), (3, 7, 1000, "c"), (3, 8, 1001, "d")]
    out = maxent_lm._repeated(spark.createDataFrame(rows, "doc_id long, key long, m long, x string"), 100)
    assert {(r.x, r["count"]) for r in out.groupBy("x").count().collect()} == {(x, m) for _, _, m, x in rows}


def test_run_sums():
    x = np.random.default_rng(5).normal(size=(100, 4)).astype(np.float32)
    starts = np.array([0, 1, 3, 40, 90])
    assert maxent_lm._run_sums(x, starts, np.diff(np.append(starts, 100))) == pytest.approx(np.add.reduceat(x, starts, axis=0), abs=1e-5)


# HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><!-- <p>no</p> -->
<div class="ad banner">Buy, now.</div><article><h1>A &amp; B&nbsp;title</h1><p><b>First   line<br>goes on, here.</b><p>Second &lt;b&gt; one.</p><p>No.</p><aside>Aside, text.</aside><ul><li>Item one<li>Item two</ul>
<form><input value="x">Send</form></article><section id="comments"><p>I liked it, very much, indeed; thanks. Truly good.</p></section><div class="cookie-notice">We use cookies.</div><footer>&copy; us</footer></body></html>"""


def test_main_text(spark):
    from pyspark.sql import functions as F

    assert html_extract.extract(PAGE) == "A & B title\n\nFirst line goes on, here.\n\nSecond <b> one.\n\nNo.\n\nItem one\n\nItem two"
    soup = "<body><div id=m><div><p>Hello, world. A long text, with commas, and so on. More here.</p><p>Also this one, right here.</p></div></div><div><ul><li><a href=x>Home</a></li><li><a href=x>About us</a></li></ul></div>"
    assert html_extract.extract(soup) == "Hello, world. A long text, with commas, and so on. More here.\n\nAlso this one, right here."
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<p>cut off &am"), (5, "u", "<article><p>" + "word, " * 50000), (6, "u", '<p a="unclosed> text</p>'), (7, "u", "<script>only"), (8, "u", "plain")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x")).withColumn("n_chars", F.lit(None).cast("int"))
    out = html_extract.extract_pages(pages).collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    text = {r.page_id: r.text for r in out}
    assert text[2] == text[3] == text[7] == "" and text[None] == "cut off &am" and len(text[5]) == 6 * 50000 - 1 and text[8] == "plain"
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


P = "This is a long paragraph, with commas, and so on. It goes further, and says more; much more than a menu would."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<article><p class="share">{P}</p><div class="post comment-policy"><p>{P}</p></div><p>So.</p></article>', [P, P, "So."]),
        (f'<div id=main><h1>Title</h1><p>{P}</p></div><div class="comments-area"><p>I liked it, very much, indeed; thanks. Truly good.</p><p>{P}</p><p>{P}</p><p>{P}</p></div>', ["Title", P]),
        (f"<table><tr><td><a href=1>One</a><br><a href=2>Two</a></td><td>{P}<br><br>{P}</td></tr></table>", [f"{P} {P}"]),
        (f"<header><h1>Site name</h1><p>A site about things, and more.</p></header><main><header><h1>Title</h1></header><p>{P}</p><ul><li>one<li>two</ul></main><aside><p>{P}</p></aside>", ["Title", P, "one", "two"]),
        (f"<div><p>{P}</p><p>Short.</p><form><p>Send us your mail, please, now.</p></form></div>", [P, "Short."]),
        (f'<div class="cookie-notice"><p>We use cookies, and more. {P}</p></div><div><p>{P}</p><h2>Sub</h2><p>{P}</p><p>ok</p></div>', [P, "Sub", P, "ok"]),
        (f"<div><section><h2>A</h2><p>{P}</p></section><section><h2>B</h2><p>{P}</p></section></div><div><ul><li><a href=q>l1</a><li><a href=q>l2</a></ul></div>", ["A", P, "B", P]),
        (f"<article><p>{P}</p><p><a href=x>Just a link.</a></p><pre>code\n  x</pre></article><article class=related><p>{P}</p></article>", [P, "Just a link.", "code x"]),
    ],
)
def test_content_is_chosen_by_path_scores(page, text):
    assert html_extract.extract(f"<html><body>{page}</body></html>") == "\n\n".join(text)


def article(page):
    """The text of a page's article element, by plain substitution."""
    import html

    parts = re.split("</?(?:p|h1)>", re.search("<article>(.*?)</article>", page, re.S)[1])
    parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in parts]
    return "\n\n".join(x for x in parts if x)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_articles_with_and_without_their_names():
    """Every article as the pages are; and where nothing calls itself navigation, article, advert or footer, all but articles shorter than what is around them."""
    import pyarrow.parquet as pq

    pages = pq.read_table(f"{SF.replace('0.001', '0.01')}/pages.parquet").column("html").to_pylist()
    plain = [re.sub(' class="[^"]*"', "", re.sub(r"<(/?)(nav|article|footer)\b", r"<\1div", p)) for p in pages]
    assert all(html_extract.extract(p) == article(p) for p in pages)
    right = sum(html_extract.extract(q) == article(p) for p, q in zip(pages, plain, strict=True))
    assert right >= 0.98 * len(pages), right


def naive_extract(page):
    """The same rules over a tree of a well-formed page without links, one block and path at a time."""
    from html.parser import HTMLParser

    blocks, h = [], html_extract

    def weigh(way):
        weight = 1
        for t in way:
            weight = min(h.MAIN, max(h.ASIDE**2, weight * (h.ASIDE if t in h._ASIDE else h.MAIN if t in h._MAIN else 1)))
        return weight * (1 if way and way[-1] in h._TEXT else h.BARE)

    class Reader(HTMLParser):
        way, count = [("", 0)], 0

        def handle_starttag(self, tag, attrs):
            self.count += 1
            self.way = [*self.way, (tag, self.count)]

        def handle_endtag(self, tag):
            self.way = self.way[:-1]

        def handle_data(self, data):
            if data.strip():
                blocks.append((tuple(self.way), data.strip()))

    Reader().feed(page)
    path = lambda b: tuple(t for t, _ in b[0][1:])
    points = lambda t: sum(t.count(c) for c in ",.;:!?")

    def ratio(b):
        same = [x[1] for x in blocks if path(x) == path(b)]
        return sum(map(len, same)) / len(same) * (0.3 + sum(map(points, same)) / len(same)) * weigh(path(b))

    score = []
    for i, b in enumerate(blocks):
        near = [ratio(x) if x is not None and x[0][:-1] == b[0][:-1] else ratio(b) for x in (blocks[i - 1] if i else None, blocks[i + 1] if i + 1 < len(blocks) else None)]
        score.append(math.sqrt(ratio(b) * (near[0] / 4 + ratio(b) / 2 + near[1] / 4)))
    for i in range(len(blocks) - 2, -1, -1):
        if path(blocks[i])[-1:] == ("h2",) and blocks[i][0][:-1] == blocks[i + 1][0][:-1]:
            score[i] = max(score[i], score[i + 1])
    least = h.THRESHOLD * sum(len(b[1]) * x * x for b, x in zip(blocks, score)) / sum(len(b[1]) * x for b, x in zip(blocks, score))
    core, weight = [x >= least for x in score], [weigh(path(b)) for b in blocks]
    gain = {}
    for b, c, w in zip(blocks, core, weight):
        for e in b[0]:
            gain[e] = gain.get(e, 0) + len(b[1]) * (1 if c else -1 if w >= h.LEAST_WEIGHT * max(weight) else -1 / 8)
    best = max((e for e in gain if e[0] not in h._ONE), key=lambda e: (gain[e], e[1]))
    inside = [best in b[0] for b in blocks]
    floor = h.LEAST_WEIGHT * max(w for w, i in zip(weight, inside) if i)
    return "\n\n".join(b[1] for b, c, w, i in zip(blocks, core, weight, inside) if i and (c or w >= floor))


def test_extraction_equals_a_plain_reading_of_the_rules():
    rng = np.random.default_rng(11)
    words = ["one", "two,", "three.", "four", "five; six", "seven eight nine"]

    def tree(depth):
        out = ""
        for _ in range(int(rng.integers(1, 5))):
            tag = str(rng.choice(["div", "section", "article", "nav", "footer"] if depth and rng.random() < 0.5 else ["p", "h2", "li", "div"]))
            inner = tree(depth - 1) if tag in ("div", "section", "article", "nav", "footer") and depth else " ".join(rng.choice(words, int(rng.integers(1, 40))))
            out += f"<{tag}>{inner}</{tag}>"
        return out

    pages = [f"<body>{tree(3)}</body>" for _ in range(150)]
    assert len({html_extract.extract(p) for p in pages}) > 140
    for page in pages:
        assert html_extract.extract(page) == naive_extract(page)


def test_reading_time_follows_the_page():
    import time

    def spent(page):
        began = time.perf_counter()
        html_extract.extract(page)
        return time.perf_counter() - began

    assert spent("<div>" * 100_000 + "text, here." + "</div>" * 50_000 + "</b>" * 100_000) < 10
    assert spent('<a "' * 200_000) < 5
    assert spent("<!--" * 100_000 + "<a href='" * 100_000) < 5
    short, long = (spent("<p>" * n + "<td><tr><b>" * n + "</p></i>" * n) for n in (10_000, 80_000))
    assert long < 25 * max(short, 0.05)


# mixing


def test_rake_meets_all_marginals():
    rng = np.random.default_rng(6)
    labels = [rng.integers(0, k, 60) for k in (5, 3, 2)]
    tokens = rng.integers(1, 1000, 60).astype(float)
    mix = mixing.Mix(sweeps=300)
    weight = mixing.rake(labels, tokens, mix)
    for label, power in zip(labels, mix.powers, strict=True):
        share = np.bincount(label, tokens / tokens.sum()) ** power
        assert np.bincount(label, weight) == pytest.approx(share / share.sum(), abs=1e-6)
    s = mixing.rate(tokens, weight, 0.5)
    assert (np.minimum(1, s * weight / tokens) * tokens).sum() == pytest.approx(0.5 * tokens.sum())


def test_mixing_rows(make):
    rows = AWKWARD + [(i, "w " * (50 + i)) for i in range(100, 160)]
    mix = mixing.Mix(sweeps=3)
    out = mixing.weigh(make(rows), mix)
    assert out.count() == len(rows) and {"topic", "weight", "text", "key"} <= set(out.columns)
    by_table = mixing.weigh(make(rows), mix, max_cells=1)
    key = lambda df: sorted((r.doc_id or 0, r.n_tokens, round(r.probability, 6), round(r.weight, 6), r.sampled) for r in df.collect())
    assert key(out) == key(by_table)
    assert mixing.weigh(make([])).count() == 0


@pytest.mark.parametrize("max_cells", [100_000, 1])
def test_mixing_to_given_targets(spark, max_cells):
    rng = np.random.default_rng(9)
    rows = [(i, "w " * int(rng.integers(60, 90)), str(rng.choice(["a", "b", "c"])), str(rng.choice(["en", "de"])), ["law", "art"][i % 2]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string")
    wanted = {("source", "a"): 0.6, ("source", "b"): 0.4, ("topic", "law"): 3.0, ("topic", "art"): 1.0}
    targets = spark.createDataFrame([(d, x, s) for (d, x), s in wanted.items()], "dimension string, label string, share double")
    mix = mixing.Mix(sweeps=4 if max_cells == 1 else 50, allowed=0.02, part=0.2)
    out = mixing.weigh(docs, mix, max_cells, targets).collect()
    total = sum(r.n_tokens * r.weight for r in out)
    share = lambda column, label: sum(r.n_tokens * r.weight for r in out if r[column] == label) / total
    assert [share("source", x) for x in "abc"] == pytest.approx([0.6, 0.4, 0], abs=0.02)
    assert share("topic", "law") == pytest.approx(0.75, abs=0.02) and {r.topic for r in out} == {"law", "art"}
    assert not any(r.sampled for r in out if r.source == "c") and sum(r.n_tokens * r.probability for r in out) == pytest.approx(0.2 * sum(r.n_tokens for r in out), rel=1e-3)
    for bad in ([("source", "nowhere", 1.0)], [("source", "a", 0.0)], [("lang", "en", -1.0)]):
        with pytest.raises(ValueError):
            mixing.weigh(docs, mix, max_cells, spark.createDataFrame(bad, targets.schema))
    tied = docs.where("not (source = 'a' and topic = 'law')").where("not (source = 'b' and topic = 'art')").where("source <> 'c'")
    with pytest.raises(mixing.Infeasible):  # a and art go together, and cannot have 0.6 and 0.25
        mixing.weigh(tied, mix, max_cells, targets)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["op6_decontaminate", "op7_mixing", "op8_substring_dedup", "op10_secret_scan"])
def test_queries_equal_sql(spark, name):
    import duckdb

    from quaero.llm import queries

    base = duckdb.connect()
    for t in ("documents", "benchmark"):
        base.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = queries.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rows = base.sql(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(map(tuple, rows))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(p.STAGES)
    kept, seen = docs, docs.columns
    for name, stage in list(stages.items())[:-1]:
        before = kept.count()
        kept = spark.createDataFrame(stage(spark, kept, SF).collect(), kept.schema)
        assert kept.columns == seen and 0 < kept.count() <= before, name
    out = p.run(spark, SF)
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    drawn = {r.doc_id for r in out.collect()}
    assert drawn <= ids and drawn == {r.doc_id for r in mixing.weigh(kept).where("sampled").collect()}
