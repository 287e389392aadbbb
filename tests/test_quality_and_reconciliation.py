import pytest

from quaero.operators import quality, reconcile

QA = "query_id long, question string, answer string, match_id array<long>, match_name array<string>"
CORPUS = [(1, "法甲", "甲文"), (2, "法乙", "乙文")]


def corpus(spark, rows=CORPUS):
    return spark.createDataFrame(rows, "id long, name string, text string")


def normalized(spark, *rows, of=CORPUS):
    return quality.normalize_qa(spark.createDataFrame(list(rows), QA), corpus(spark, of)), corpus(spark, of)


def test_normalize(spark):
    qa, c = normalized(spark, (10, "q", "a", [1, 2], ["法甲", "别名"]))
    row = qa.first()
    assert row.gold_texts == ["甲文", "乙文"] and row.gold_names == ["法甲", "别名"] and row.gold_corpus_names == ["法甲", "法乙"] and row.gold_name_matches_corpus == [True, False]
    quality.validate(qa, c)


@pytest.mark.parametrize(
    "rows, of, rule",
    [
        ([(1, "q", "a", [1], ["法甲"])] * 2, CORPUS, "duplicate query id"),
        ([(1, "q", "a", [1], ["法甲"])], [*CORPUS, CORPUS[0]], "duplicate corpus id"),
        ([(1, "q", "a", [999], ["x"])], CORPUS, "missing corpus row"),
        ([(1, " 　", "a", [1], ["法甲"])], CORPUS, "empty question"),
        ([(1, "q", "a", [1, 1], ["法甲"])], CORPUS, "misaligned gold fields: 1"),
        ([(1, "q", "a", [1], ["法甲", "法乙"])], CORPUS, "misaligned gold fields: 1"),
        ([(1, "q", "a", [1], None)], CORPUS, "misaligned gold fields: 1"),
        ([(None, "q", "a", [1], ["法甲"])], CORPUS, "query id is no integer: q"),
        ([(1, "q", "a", [1], ["法甲"])], [*CORPUS, (None, "c", "t")], "corpus id is no integer: c"),
        ([(1, "q", "", [1], ["法甲"])], CORPUS, "empty answer"),
        ([(1, "q", "a", [1], ["法甲"])], [*CORPUS, (3, "c", " ")], "empty corpus text"),
    ],
)
def test_violations(spark, rows, of, rule):
    with pytest.raises(quality.InvalidData, match=rule):
        quality.validate(*normalized(spark, *rows, of=of))


def test_raw_tables_need_their_fields(spark):
    with pytest.raises(quality.InvalidData, match="corpus: missing fields content, name"):
        quality.normalize_corpus(spark.createDataFrame([("1", "x")], "id string, other string"))
    with pytest.raises(quality.InvalidData, match="questions: missing fields match_name"):
        quality.normalize_qa(spark.createDataFrame([(1, "q", "a", [1], ["n"])], QA).drop("match_name"), corpus(spark))
    with pytest.raises(quality.InvalidData, match="corpus id is no integer: zwei"):
        raw = spark.createDataFrame([("1", "a", "t"), ("zwei", "zwei", "t")], "id string, name string, content string")
        quality.validate(normalized(spark, (1, "q", "a", [1], ["a"]))[0], quality.normalize_corpus(raw))


@pytest.mark.parametrize("given, number", [("5", 5), (" 5 ", 5), ("5.0", None), ("x", None), (None, None)])
def test_whole_number(spark, given, number):
    from pyspark.sql import functions as F

    assert spark.range(1).select(quality.whole_number(F.lit(given).cast("string"))).first()[0] == number


def test_statistics(spark):
    row = quality.statistics(*normalized(spark, (1, "ab", "abc", [1], ["法甲"]), (2, "abcd", "a", [1, 2], ["法甲", "?"]))).first()
    assert (row.qa_total, row.corpus_count, row.average_gold, row.average_question_length, row.average_answer_length, row.mismatch_qa, row.mismatch_pairs) == (2, 2, 1.5, 3.0, 2.0, 1, 1)


def run(spark, ids, names, related, of=CORPUS):
    refs = spark.createDataFrame([(1, ids, names)], "query_id long, match_id array<long>, match_name array<string>")
    rel = spark.createDataFrame([(1, i, n, t) for i, (n, t) in enumerate(related)], "query_id long, pos int, name string, text string")
    levels = [r.level[0] for r in reconcile.resolve(rel, corpus(spark, of)).orderBy("pos").collect()]
    return reconcile.reconcile(refs, rel, corpus(spark, of)).first(), levels


@pytest.mark.parametrize(
    "ids, names, related, status, reconciled, canonical, levels",
    [
        ([1, 2], ["法甲", "法乙"], [("法乙", "乙文\n"), ("法甲", "甲文\r\n")], "order_only_conflict", [1, 2], [1, 2], ["A", "A"]),
        ([1], ["法甲"], [("法乙", "乙文")], "true_set_conflict", [2], [], ["A"]),
        ([1], ["法甲"], [("法甲", "甲文")], "clean", [1], [1], ["A"]),
        ([1], ["法甲"], [("法丙", "甲文")], "order_only_conflict", [1], [1], ["B"]),
        ([1], ["法甲"], [("法甲", "丙文")], "clean", [1], [1], ["C"]),
        ([1], ["法甲"], [("法丙", "丙文")], "unresolved", [], [], ["D"]),
        ([1], ["法甲"], [("法甲", "甲文"), ("法丙", "丙文")], "partially_resolved", [1], [], ["A", "D"]),
        ([1], ["法甲"], [], "unresolved", [], [], []),
    ],
)
def test_reconcile(spark, ids, names, related, status, reconciled, canonical, levels):
    row, found = run(spark, ids, names, related)
    assert (row.status, row.reconciled_ids, row.canonical_ids, found) == (status, reconciled, canonical, levels)


def test_ambiguous(spark):
    row, _ = run(spark, [1], ["法甲"], [("法甲", "甲文")], of=[(1, "法甲", "甲文"), (3, "法甲", "甲文")])
    assert row.status == "ambiguous" and not row.all_resolved
    row, levels = run(spark, [1], ["法甲"], [("法甲", "甲文")], of=[(1, "法甲", "x"), (3, "a", "甲文"), (4, "b", "甲文")])
    assert levels == ["C"] and row.status == "clean"


def test_positional_audit(spark):
    qa = spark.createDataFrame([(1, "", "", [1], ["法甲"]), (2, "", "", [1], ["?"]), (3, "", "", [1], ["法甲"]), (4, "", "", [1, 9], ["?", "?"]), (5, "", "", [], [])], QA)
    related = spark.createDataFrame([(2, 0, "法甲"), (3, 0, "法乙")], "query_id long, pos int, related_name string")
    found = {r.query_id: r.classification for r in quality.positional_audit(qa, related, corpus(spark)).collect()}
    assert found == {1: "clean", 2: "name_mismatch_only", 3: "id_evidence_conflict", 4: "unresolved", 5: "clean"}


def test_seeded_sample_is_pythons(spark):
    import random

    table = spark.range(100).withColumnRenamed("id", "k")
    assert sorted(r.k for r in quality.seeded_sample(table, "k", 10, 7).collect()) == sorted(random.Random(7).sample(range(100), 10))
    assert quality.seeded_sample(table.limit(3), "k", 10).count() == 3


def test_reconciliation_shuffles_no_texts(spark):
    """Keys are dealt by digests of fixed size; names and texts that differ by white space alone still meet."""
    corpus = spark.createDataFrame([(i, f"n{i % 3}", f"t {i % 4}" if i < 9 else None) for i in range(12)], "id long, name string, text string")
    related = spark.createDataFrame([(1, 0, " n0", "t\n0 "), (2, 0, "n9", "t 1"), (3, 0, "n1", "new"), (4, 0, "n7", "new"), (5, 0, None, None)], "query_id long, pos int, name string, text string")
    out = reconcile.resolve(related, corpus).select("query_id", "level", "candidates")
    found = {r.query_id: (r.level, r.candidates) for r in out.collect()}
    assert found == {1: ("A_exact_name_and_text", [0]), 2: ("D_ambiguous", [1, 5]), 3: ("D_ambiguous", [1, 4, 7, 10]), 4: ("D_unresolved", []), 5: ("D_ambiguous", [9, 10, 11])}
    long = spark.createDataFrame([(1, "n", "x" * 100_000)], "id long, name string, text string")
    assert [len(x) for x in reconcile._keyed(long, "id").first()[1:]] == [32, 32]
