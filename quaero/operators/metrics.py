"""Retrieval metrics: hits, recall and reciprocal rank by query, their means, and how retrievers fail."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUTS = (1, 5, 10)
NAMES = tuple(f"{m}_at_{k}" for m in ("hit", "recall") for k in CUTS) + ("mrr",)


def per_query(queries: DataFrame, ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, hit_at_k.., recall_at_k.., mrr) of every query; queries without gold score zero.

    ``ranked`` is (query_id, rank, id), ``gold`` (query_id, id); repeats count
    once.  The reciprocal rank looks at all ranks.
    """
    gold = gold.select("query_id", "id").distinct()
    size = gold.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    found = ranked.groupBy("query_id", "id").agg(F.min("rank").alias("rank")).join(gold, ["query_id", "id"])
    best = found.groupBy("query_id").agg(F.min("rank").alias("first"), *[F.count_if(F.col("rank") <= k).alias(f"in_{k}") for k in CUTS])
    all_ = queries.select("query_id").distinct().join(size, "query_id", "left").join(best, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    hits = [F.coalesce((F.col(f"in_{k}") > 0).cast("double"), F.lit(0.0)).alias(f"hit_at_{k}") for k in CUTS]
    recall = [zero(F.col(f"in_{k}") / F.col("n_gold")).alias(f"recall_at_{k}") for k in CUTS]
    return all_.select("query_id", *hits, *recall, zero(F.lit(1.0) / F.col("first")).alias("mrr"))


def per_retriever(queries: DataFrame, ranked: DataFrame, gold: DataFrame, retrievers: Sequence[str]) -> DataFrame:
    """(retriever, query_id, ...): :func:`per_query` for each of ``retrievers`` in one plan; ``ranked`` has a retriever column.

    Lists and gold are read once, however many retrievers there are.
    """
    pair = lambda r: F.struct(r.alias("retriever"), F.col("query_id").alias("q")).alias("query_id")
    each = lambda df: df.withColumn("retriever", F.explode(F.array(*map(F.lit, retrievers))))
    own = [each(queries).select(pair(F.col("retriever"))), ranked.select(pair(F.col("retriever")), "rank", "id"), each(gold).select(pair(F.col("retriever")), "id")]
    return per_query(*own).select("query_id.retriever", F.col("query_id.q").alias("query_id"), *NAMES)


def summary(by_query: DataFrame, *keys: str) -> DataFrame:
    """Mean metrics, to six places, for each value of ``keys``; zeros over no queries."""
    means = [F.round(F.coalesce(F.avg(m), F.lit(0.0)), 6).alias(m) for m in NAMES]
    counts = [F.count("*").alias("query_count"), *means]
    return by_query.groupBy(*keys).agg(*counts) if keys else by_query.agg(*counts)


def success(ranked: DataFrame, gold: DataFrame, queries: DataFrame, retrievers: Sequence[str]) -> DataFrame:
    """(query_id, one boolean column a retriever): whether any gold id is among all that it returned; ``ranked`` has a retriever column."""
    hit = ranked.join(gold.select("query_id", "id").distinct(), ["query_id", "id"], "left_semi")
    flags = hit.groupBy("query_id").agg(*[F.bool_or(F.col("retriever") == r).alias(r) for r in retrievers])
    return queries.select("query_id").distinct().join(flags, "query_id", "left").select("query_id", *[F.coalesce(r, F.lit(False)).alias(r) for r in retrievers])


# Names of the failure categories and of the gold definitions.
CATEGORIES = ("bm25_success_dense_failure", "dense_success_bm25_failure", "both_bm25_dense_failure", "hybrid_rescue", "hybrid_regression")
GOLD_DEFINITIONS = ("raw_all", "raw_clean", "high_confidence_reconciled", "resolved_agreement")


def error_categories(flags: DataFrame) -> DataFrame:
    """(query_id, category) from success flags of bm25, dense and hybrid; a query may be in two categories."""
    lexical, dense, hybrid = F.col("bm25"), F.col("dense"), F.col("hybrid")
    tests = (lexical & ~dense, dense & ~lexical, ~lexical & ~dense, hybrid & ~lexical & ~dense, (lexical | dense) & ~hybrid)
    cases = [F.when(t, c) for t, c in zip(tests, CATEGORIES, strict=True)]
    return flags.select("query_id", F.explode(F.array_compact(F.array(*cases))).alias("category"))


def subsets(reconciled: DataFrame) -> DataFrame:
    """(gold_definition, query_id, id): the four gold definitions over reconciled queries, each where it has gold.

    ``reconciled`` has query_id, status, raw_ids, reconciled_ids, raw_clean,
    all_high_confidence, all_resolved.
    """
    agreed = F.col("status").isin("clean", "order_only_conflict") & F.col("all_resolved")
    ids = (F.col("raw_ids"), F.when(F.col("raw_clean"), F.col("raw_ids")), F.when(F.col("all_high_confidence") & F.col("all_resolved"), F.col("reconciled_ids")), F.when(agreed, F.col("reconciled_ids")))
    chosen = F.array(*[F.struct(F.lit(d).alias("gold_definition"), i.alias("ids")) for d, i in zip(GOLD_DEFINITIONS, ids, strict=True)])
    return reconciled.select("query_id", F.inline(chosen)).select("gold_definition", "query_id", F.explode("ids").alias("id")).distinct()


def by_subset(ranked: DataFrame, gold_sets: DataFrame) -> DataFrame:
    """Per-query metrics for each gold definition and retriever (gold_definition, retriever, query_id, ...)."""
    retrievers = ranked.select("retriever").distinct()
    pair = F.struct("gold_definition", "retriever", F.col("query_id").alias("q"))
    gold = gold_sets.crossJoin(F.broadcast(retrievers)).select(pair.alias("query_id"), "id")
    named = ranked.join(F.broadcast(gold_sets.select("gold_definition").distinct())).select(pair.alias("query_id"), "rank", "id")
    out = per_query(gold.select("query_id"), named, gold)
    return out.select("query_id.gold_definition", "query_id.retriever", F.col("query_id.q").alias("query_id"), *NAMES)
