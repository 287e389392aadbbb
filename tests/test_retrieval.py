import numpy as np
import pytest
from pyspark.sql import functions as F

from quaero.operators import bootstrap, dense, fusion, lexical, metrics, ranking

CORPUS = [(1, "劳动法", "劳动者依法签订劳动合同享有权益"), (2, "婚姻法", "夫妻共同财产的处理规定"), (3, "道路法", "机动车应当遵守交通信号")]


def corpus(spark, rows=CORPUS):
    return spark.createDataFrame(rows, "id long, name string, text string")


def questions(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "query_id long, question string")


def bm25(rows, question, k1=1.5, b=0.75):
    """Scores by the definition."""
    import math
    import re

    tokens = lambda s: [x.lower() for x in re.findall(r"[㐀-䶿一-鿿]|[A-Za-z]+|\d+(?:\.\d+)?", s)]
    docs = {i: tokens(f"{n} {t}") for i, n, t in rows}
    mean = sum(map(len, docs.values())) / len(docs)
    out = {}
    for w in set(tokens(question)):
        df = sum(w in d for d in docs.values())
        for i, d in docs.items():
            if w in d:
                idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
                out[i] = out.get(i, 0) + idf * d.count(w) * (k1 + 1) / (d.count(w) + k1 * (1 - b + b * len(d) / mean))
    return out


def test_bm25_scores_and_ranks(spark):
    found = lexical.search(questions(spark, "劳动者合同权益"), corpus(spark), 2).orderBy("rank").collect()
    expected = sorted(bm25(CORPUS, "劳动者合同权益").items(), key=lambda x: (-x[1], x[0]))[:2]
    assert [(r.id, r.rank) for r in found] == [(i, n) for n, (i, _) in enumerate(expected, 1)]
    assert [r.score for r in found] == pytest.approx([s for _, s in expected])


def test_bm25_edges(spark):
    twins = [(5, "a", "same words"), (2, "a", "same words"), (9, "", "")]
    found = lexical.search(questions(spark, "same same", "unknown"), corpus(spark, twins), 10).orderBy("rank").collect()
    assert [(r.query_id, r.id) for r in found] == [(1, 2), (1, 5)]  # ties by id; no row without a match; repeats in a query count once
    assert found[0].score == pytest.approx(bm25(twins, "same")[2])
    assert lexical.search(questions(spark, "x"), corpus(spark, []), 10).count() == 0
    assert lexical.build_index(corpus(spark, twins)).stats.first().n == 3


def test_dense_matches_numpy_and_blocks_agree(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(40, 8))
    vectors[7] = vectors[3]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, vector array<float>").repartition(3)
    queries = spark.createDataFrame([(q, vectors[q].tolist()) for q in (3, 5, 9)], "query_id long, vector array<float>")
    for block in (2, 100):
        found = dense.search(queries, table, 5, block).collect()
        for q in (3, 5, 9):
            scores = np.round(vectors.astype(np.float32).astype(float) @ vectors[q].astype(np.float32).astype(float), 9)
            assert [r.id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)] == np.lexsort((np.arange(40), -scores))[:5].tolist()
    assert dense.search(queries, table.limit(2), 5).count() == 6
    assert dense.search(queries.limit(0), table, 5).count() == 0


def test_encoder_halves_batches(spark):
    def small(texts):
        if len(texts) > 2:
            raise MemoryError
        return [[len(t), 1.0] for t in texts]

    table = spark.createDataFrame([(i, "x" * i) for i in range(1, 9)], "id long, text string").coalesce(1)
    out = dense.encode(table, small).orderBy("id").collect()
    assert len(out) == 8 and out[2].vector == pytest.approx([3 / 10**0.5, 1 / 10**0.5])


def test_fusion(spark):
    lists = [spark.createDataFrame(rows, "query_id long, id long, rank int") for rows in ([(1, 1, 1)], [(1, 1, 1), (1, 2, 2)])]
    out = fusion.fuse(lists).orderBy("rank").collect()
    assert [(r.id, r.rank) for r in out] == [(1, 1), (2, 2)] and [r.score for r in out] == pytest.approx([2 / 61, 1 / 62])
    tie = [spark.createDataFrame([(1, i, 1)], "query_id long, id long, rank int") for i in (9, 4)]
    assert [r.id for r in fusion.fuse(tie).orderBy("rank").collect()] == [4, 9]


def ranked(spark, rows):
    return spark.createDataFrame(rows, "retriever string, query_id long, rank int, id long")


def test_metrics(spark):
    gold = spark.createDataFrame([(1, 2), (1, 3), (1, 3)], "query_id long, id long")
    out = metrics.per_query(questions(spark, "a", "no gold"), ranked(spark, [("x", 1, 1, 3), ("x", 1, 2, 9)]), gold).orderBy("query_id").collect()
    assert out[0].hit_at_1 == 1 and out[0].recall_at_1 == 0.5 and out[0].mrr == 1 and out[0].recall_at_10 == 0.5
    assert all(out[1][m] == 0 for m in metrics.NAMES)
    empty = metrics.summary(metrics.per_query(questions(spark), ranked(spark, []), gold)).first()
    assert empty.query_count == 0 and all(empty[m] == 0 for m in metrics.NAMES)


def test_all_error_categories(spark):
    flags = [(1, True, False, False), (2, False, True, True), (3, False, False, True), (4, False, False, False), (5, True, True, True)]
    out = metrics.error_categories(spark.createDataFrame(flags, "query_id long, bm25 boolean, dense boolean, hybrid boolean")).collect()
    a, b, c, rescue, regression = metrics.CATEGORIES
    assert sorted((r.query_id, r.category) for r in out) == sorted([(1, a), (1, regression), (2, b), (3, c), (3, rescue), (4, c)])


def test_last_wins(spark):
    log = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, None)], "query_id long, line long, v string")
    assert {r.query_id: r.v for r in ranking.last_wins(log, ["query_id"], ["line"]).collect()} == {1: "c", 2: None}


def test_bootstrap(spark):
    left, right = [1.0, 0, 1, 1, 0], [0.0, 0, 1, 0, 1]
    got = bootstrap.difference(left, right, 2500)
    rng, gap, means = np.random.default_rng(42), np.array(left) - np.array(right), []
    for n in (1000, 1000, 500):
        means += gap[rng.integers(0, 5, (n, 5))].mean(1).tolist()
    assert got == pytest.approx((gap.mean(), *np.percentile(means, [2.5, 97.5])))
    for bad in (([], []), ([1], [1, 2])):
        with pytest.raises(ValueError):
            bootstrap.difference(*bad)
    assert np.percentile([1, 2, 4, 10], [2.5, 97.5]).tolist() == pytest.approx([1.075, 9.55])


def test_one_plan_for_all_retrievers_equals_one_each(spark):
    gold = spark.createDataFrame([(1, 3), (1, 3), (2, 9)], "query_id long, id long")
    lists = ranked(spark, [("x", 1, 1, 3), ("x", 1, 2, 9), ("y", 2, 4, 9), ("z", 2, 1, 9)])
    asked = questions(spark, "a", "b", "no gold")
    both = metrics.per_retriever(asked, lists, gold, ("x", "y"))
    for name in ("x", "y"):
        alone = metrics.per_query(asked, lists.where(F.col("retriever") == name), gold)
        assert sorted(map(tuple, both.where(F.col("retriever") == name).drop("retriever").collect())) == sorted(map(tuple, alone.collect()))
    assert both.count() == 6


@pytest.mark.parametrize("small", [0, 1000])
def test_gold_equals_containment(spark, tmp_path, monkeypatch, small):
    """Whether questions are broadcast or not, short ones, ones of many spaces and repeated passages included."""
    from quaero.plans import tables

    texts = ["one two three four five six seven", "xone two three four five sixx", "a  b   c d e f a  b   c d e f", "", None, "two three", "one two three four five six one two three four five six"]
    asked = ["one two three four five six", "ne two three four five si", "  b   c d ", "two three", "w", "", None, "a  b   c d e f", " two three four five "]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(asked)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    monkeypatch.setattr(tables, "SMALL_QUERIES", small)
    expected = sorted((q, d) for q, a in enumerate(asked) for d, t in enumerate(texts) if a and t is not None and a in t)
    assert sorted(map(tuple, tables.gold(spark, str(tmp_path)).collect())) == expected


def test_dense_search_holds_few_products(spark, monkeypatch):
    """Many steps and merges give the same rows as one matrix, and no task holds more than a few products a query."""
    rng = np.random.default_rng(4)
    vectors = np.round(rng.normal(size=(300, 6)), 1)  # so that many products are equal
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, vector array<double>").repartition(2)
    queries = table.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    expected = {(q, n): i for q in range(0, 300, 20) for n, i in enumerate(np.lexsort((np.arange(300), -np.round(vectors @ vectors[q], 9)))[:7], 1)}
    monkeypatch.setattr(ranking, "CELLS", 64)
    assert {(r.query_id, r["rank"]): r.id for r in dense.search(queries, table, 7).collect()} == expected

    most = 0

    class Watched(np.ndarray):
        def __array_finalize__(self, of):
            nonlocal most
            most = max(most, self.size)

    import pyarrow as pa

    task = []
    monkeypatch.setattr(ranking, "CELLS", 1 << 12)
    monkeypatch.setattr(dense, "_by_blocks", lambda q, v, block, f: task.append(f) or v.selectExpr("id as query_id", "id", "0d as score"))
    dense.search(queries, table, 7)
    part = [(q, rng.normal(size=6)) for q in range(50)]
    monkeypatch.setattr(dense, "_matrix", lambda c: np.stack(c.to_numpy(zero_copy_only=False)).astype(float).view(Watched))
    batch = pa.RecordBatch.from_arrays([pa.array(range(20_000)), pa.array(rng.normal(size=(20_000, 6)).tolist())], ["id", "vector"])
    rows = sum(b.num_rows for b in task[0](part, [batch]))
    assert rows == 350 and most <= 20_000 * 6  # the vectors themselves; the products of one batch are a million


def test_products_of_all_pairs(spark, monkeypatch):
    """Against the column function, with nulls, unequal sizes, halves and several blocks."""
    from quaero.functions import vectors as vec

    rows = [(20, [1.0, 0.5]), (40, [0.0078125, 0.0]), (60, None), (80, [1.0]), (1, [-1.0, 0.0]), (2, [1.0, None]), (3, [3.0, 2e-7]), (4, []), (None, [2.0, 2.0]), (0, [])]
    table = spark.createDataFrame(rows, "id long, vector array<float>").repartition(2)
    queries = table.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    pairs = table.join(queries.withColumnRenamed("vector", "q"))
    expected = pairs.select("query_id", "id", F.round(vec.inner_product(F.col("q"), F.col("vector")), 6).alias("score"))
    order = lambda df: sorted(map(str, df.collect()))
    for cells, width, block in ((1 << 19, 128, 4096), (4, 2, 2)):
        monkeypatch.setattr(ranking, "CELLS", cells)
        monkeypatch.setattr(dense, "ROWS", width)
        found = dense.products(queries, table, 6, block)
        assert order(found) == order(expected)
        assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_token_bag_equals_tokens(spark):
    from quaero.functions.text import token_bag, tokens

    odd = ["a1.5.2b..3 .4 5.", "ABC é ñandú İstanbul K 12.", "法条12.5abc劳动", "x١٢.٣y 1.٢", "é9.8.7.6", "...1..2.", "", None, " a²b⁵ 3", "\U0001d7d8 7 ०", "ſK㐀"]
    for r in spark.createDataFrame([(t,) for t in odd], "text string").select("text", tokens(F.col("text")).alias("t")).collect():
        assert sorted(token_bag((r.text or "").encode())) == sorted(x.encode() for x in r.t)


@pytest.mark.parametrize("direct", [0, 1000])
def test_lists_hold_few_rows_of_all_scores(spark, tmp_path, monkeypatch, direct):
    """The k best by score and by overlap, ties included, as all scores give them, in small steps and by the join; but a task's best are all that is kept."""
    from quaero.plans import retrieval

    rng = np.random.default_rng(7)
    words = [f"w{'abcdefghijklmnopqrstuvwxyz'[i]}" for i in range(26)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 9))) for _ in range(400)] + [None, "", "2.5 法"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s")).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    asked = [" ".join(rng.choice(words, 5)) for _ in range(12)] + ["nothing here", None, "2.5 法"]
    spark.createDataFrame(list(enumerate(asked)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    monkeypatch.setattr(lexical, "DIRECT", direct)
    monkeypatch.setattr(ranking, "CELLS", 300)
    q, c = (f(spark, str(tmp_path)) for f in (retrieval.t.questions, retrieval.t.corpus))
    scores = lexical.score(q, c)
    found = lexical.best(q, c, 10)
    for kind in ("score", "matched"):
        expected = ranking.top_k(scores.select("query_id", "id", F.col(kind).cast("double").alias("score")), 10)
        got = ranking.top_k(found.where(F.col("kind") == kind).drop("kind"), 10)
        pick = lambda df: sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in df.collect())
        assert pick(got) == pick(expected)
    assert found.count() <= 2 * 3 * 10 * len(asked) < 2 * scores.count()
    plan = retrieval.lists(spark, str(tmp_path))
    assert plan.storageLevel.useMemory and (not direct or "Join" not in str(plan._jdf.queryExecution().executedPlan()))


def test_gold_reads_texts_once_without_copies(spark, tmp_path):
    from quaero.plans import tables

    spark.createDataFrame([(1, "one two three four five six seven")], "doc_id long, text string").withColumn("source", F.lit("s")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "one two three four five six"), (2, "five")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = tables.gold(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 2 and plan.count("Scan parquet") == 1 and "Generate" not in plan and "Join" not in plan
