"""Normalization and validation of corpora and question/answer tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaero.functions.text import is_blank


class InvalidData(ValueError):
    """A table breaks a rule; the message names the first violation."""


def whole_number(value: Column) -> Column:
    """An integer from a number or text; null where it is none."""
    return value.try_cast("bigint")


def missing_fields(columns: list[str], required: tuple[str, ...]) -> list[str]:
    return sorted(set(required) - set(columns))


def _require(what: str, raw: DataFrame, *required: str) -> None:
    if gone := missing_fields(raw.columns, required):
        raise InvalidData(f"{what}: missing fields {', '.join(gone)}")


def normalize_corpus(raw: DataFrame) -> DataFrame:
    """(id, name, text) from raw (id, name, content); ids that are no integers are null, which :func:`validate` reports."""
    _require("corpus", raw, "id", "name", "content")
    return raw.select(whole_number(F.col("id")).alias("id"), F.col("name").cast("string").alias("name"), F.col("content").cast("string").alias("text"))


def duplicates(table: DataFrame, *keys: str) -> DataFrame:
    """The keys that more than one row has, and how many."""
    return table.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > 1)


def unmatched(table: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """The rows whose key isn't in ``parent``."""
    return table.join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def misaligned(table: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """(key, first_size, second_size) of the rows whose two arrays have unequal sizes; a null array has none."""
    size = lambda c: F.size(F.coalesce(F.col(c), F.array()))
    return table.select(key, size(first).alias("first_size"), size(second).alias("second_size")).where("first_size <> second_size")


def pairs(qa: DataFrame) -> DataFrame:
    """One row for each gold reference: (query_id, pos, gold_id, gold_name); arrays of unequal length go on with null."""
    zipped = F.arrays_zip(F.col("match_id").alias("i"), F.col("match_name").alias("n"))
    return qa.select("query_id", F.posexplode(zipped).alias("pos", "g")).select("query_id", "pos", F.col("g.i").alias("gold_id"), F.col("g.n").alias("gold_name"))


def normalize_qa(qa: DataFrame, corpus: DataFrame) -> DataFrame:
    """Questions with their gold references resolved in the corpus.

    ``qa`` is (query_id, question, answer, match_id, match_name); the gold
    columns are arrays in the given order.  The given name stays; the corpus'
    own is beside it, with whether they are equal.  A reference that the corpus
    doesn't have has a null name and text.  Ids and names stay as given, so
    arrays of unequal sizes are seen by :func:`validate`.
    """
    _require("questions", qa, "query_id", "question", "answer", "match_id", "match_name")
    found = pairs(qa).join(corpus.select(F.col("id").alias("gold_id"), F.col("name").alias("corpus_name"), F.col("text").alias("gold_text")), "gold_id", "left")
    item = F.struct("pos", "gold_id", "gold_name", "gold_text", "corpus_name", (F.col("gold_name") == F.col("corpus_name")).alias("same"))
    gold = found.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("g"))
    names = {"gold_texts": "gold_text", "gold_corpus_names": "corpus_name", "gold_name_matches_corpus": "same"}
    given = qa.select("query_id", "question", "answer", F.col("match_id").alias("gold_ids"), F.col("match_name").alias("gold_names"))
    return given.join(gold, "query_id", "left").select("query_id", "question", F.col("answer").alias("reference_answer"), "gold_ids", "gold_names", *[F.col(f"g.{v}").alias(k) for k, v in names.items()])


def validation_report(qa: DataFrame, corpus: DataFrame, split: str = "") -> DataFrame:
    """(rule, key): every violation of the rules by a normalized ``qa`` and ``corpus``."""

    def told(rule: str, df: DataFrame, key: str) -> DataFrame:
        return df.select(F.lit(f"{split}: {rule}" if split else rule).alias("rule"), F.col(key).cast("string").alias("key"))

    refs = qa.select("query_id", F.explode("gold_ids").alias("gold_id"))
    parts = [
        told("corpus id is no integer", corpus.where("id is null"), "name"),
        told("query id is no integer", qa.where("query_id is null"), "question"),
        told("duplicate corpus id", duplicates(corpus, "id"), "id"),
        told("duplicate query id", duplicates(qa, "query_id"), "query_id"),
        told("empty question", qa.where(is_blank(F.col("question"))), "query_id"),
        told("empty answer", qa.where(is_blank(F.col("reference_answer"))), "query_id"),
        told("misaligned gold fields", misaligned(qa, "query_id", "gold_ids", "gold_names"), "query_id"),
        told("missing corpus row", unmatched(refs, "gold_id", corpus, "id").select("query_id").distinct(), "query_id"),
        told("empty corpus text", corpus.where(is_blank(F.col("name")) | is_blank(F.col("text"))), "id"),
    ]
    return reduce(DataFrame.unionByName, parts)


def validate(qa: DataFrame, corpus: DataFrame, split: str = "") -> None:
    """Raise :class:`InvalidData` for the first violation, if there is one."""
    if gone := missing_fields(qa.columns, ("query_id", "question", "reference_answer", "gold_ids", "gold_names", "gold_texts")):
        raise InvalidData(f"missing columns {gone}")
    found = validation_report(qa, corpus, split).orderBy("rule", "key").limit(1).collect()
    if found:
        raise InvalidData(f"{found[0].rule}: {found[0].key}")


def statistics(qa: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row of counts and means, to six places, of a normalized table."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    wrong = F.size(F.filter("gold_name_matches_corpus", lambda x: ~F.coalesce(x, F.lit(False))))
    mine = qa.select(F.size(F.coalesce("gold_ids", F.array())).alias("g"), F.length("question").alias("q"), F.length("reference_answer").alias("a"), F.greatest(F.coalesce(wrong, F.lit(0)), F.lit(0)).alias("w"))
    own = mine.agg(F.count("*").alias("qa_total"), mean("g").alias("average_gold"), mean("q").alias("average_question_length"), mean("a").alias("average_answer_length"), F.count_if(F.col("w") > 0).alias("mismatch_qa"), F.coalesce(F.sum("w"), F.lit(0)).alias("mismatch_pairs"))
    return own.crossJoin(corpus.agg(F.count("*").alias("corpus_count")))


def coverage_gaps(ids: DataFrame, ranked: DataFrame) -> DataFrame:
    """(query_id, retriever, problem): queries that a retriever lacks, and queries that it should not have."""
    retrievers = ranked.select("retriever").distinct()
    wanted = ids.select("query_id").distinct().crossJoin(F.broadcast(retrievers)).withColumn("w", F.lit(True))
    has = ranked.select("query_id", "retriever").distinct().withColumn("h", F.lit(True))
    return wanted.join(has, ["query_id", "retriever"], "full").where("w is null or h is null").select("query_id", "retriever", F.when(F.col("h").isNull(), "missing").otherwise("unexpected").alias("problem"))


def positional_audit(qa: DataFrame, related: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, classification, pairs) of gold references by position.

    ``related`` is (query_id, pos, related_name).  The worst pair decides:
    unresolved, then id_evidence_conflict, then name_mismatch_only, then clean.
    A position without related name takes the given one.
    """
    refs = pairs(qa).where(F.col("gold_id").isNotNull()).withColumn("gold_name", F.coalesce("gold_name", F.lit("")))
    all_ = refs.join(related, ["query_id", "pos"], "left").join(corpus.select(F.col("id").alias("gold_id"), F.col("name").alias("corpus_name"), F.lit(True).alias("there")), "gold_id", "left")
    shown = F.coalesce("related_name", "gold_name")
    worst = F.when(F.col("there").isNull(), 3).when(shown != F.col("corpus_name"), 2).when(F.col("gold_name") != F.col("corpus_name"), 1).otherwise(0)
    rank = all_.groupBy("query_id").agg(F.max(worst).alias("w"), F.count("*").alias("pairs"))
    names = F.array(*map(F.lit, ("clean", "name_mismatch_only", "id_evidence_conflict", "unresolved")))
    return qa.select("query_id").join(rank, "query_id", "left").select("query_id", F.element_at(names, F.coalesce("w", F.lit(0)) + 1).alias("classification"), F.coalesce("pairs", F.lit(0)).alias("pairs"))


def seeded_sample(table: DataFrame, key: str, count: int = 10, seed: int = 20260813) -> DataFrame:
    """``count`` rows drawn without replacement by Python's generator over the keys in order; all rows if there are no more."""
    import random

    ids = [r[0] for r in table.select(key).orderBy(key).collect()]
    chosen = ids if len(ids) <= count else random.Random(seed).sample(ids, count)
    return table.where(F.col(key).isin(chosen))


def hashed_sample(table: DataFrame, key: str, count: int = 10, seed: int = 42) -> DataFrame:
    """``count`` rows of least hash of key and seed: no driver state, one pass."""
    return table.orderBy(F.sha2(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))), 256), key).limit(count)
