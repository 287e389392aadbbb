"""Reconciliation of gold references with a corpus by normalized name and text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaero.functions.text import match_key

# Resolution levels, and statuses of a query.
LEVELS = ("A_exact_name_and_text", "B_exact_text_unique", "C_exact_name_unique", "D_ambiguous", "D_unresolved")
STATUSES = ("clean", "order_only_conflict", "true_set_conflict", "partially_resolved", "ambiguous", "unresolved")


_KINDS = {"pair": ("k_name", "k_text"), "text": ("k_text",), "name": ("k_name",)}


def _keyed(rows: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of rows (name, text, ...) and SHA-256 of both keys: texts are joined by 32 bytes each and not shuffled."""
    key = lambda c: F.unhex(F.sha2(match_key(F.col(c)), 256))
    return rows.select(*columns, key("name").alias("k_name"), key("text").alias("k_text"))


def _held(corpus: DataFrame) -> DataFrame:
    """The corpus's ids and keys, some 80 bytes a row, worked out once: each kind of key reads them, and white space of texts is slow to find."""
    keyed = _keyed(corpus, "id").persist()
    keyed.count()  # else jobs that begin together would each work them out
    return keyed


def resolve_ids(related: DataFrame, corpus: DataFrame) -> DataFrame:
    """``related`` (query_id, pos, name, text) with its keys, level and resolved_id.

    A unique match on name and text is taken first, then one on text, then one
    on name; more than one candidate is ambiguous.  Of each key the count and
    the least id are joined, never its list of ids: a key that many rows share
    costs each of them one row.
    """
    keyed, out = _held(corpus), _keyed(related, "query_id", "pos", "name", "text")
    for kind, keys in _KINDS.items():
        own = keyed.groupBy(*keys).agg(F.count("*").alias(f"{kind}_n"), F.min("id").alias(f"{kind}_id"))
        out = out.join(own, list(keys), "left")
    unique = [F.col(f"{kind}_n") == 1 for kind in _KINDS]
    some = F.coalesce(*[F.col(f"{kind}_n") for kind in _KINDS]).isNotNull()
    level = F.when(unique[0], LEVELS[0]).when(unique[1], LEVELS[1]).when(unique[2], LEVELS[2]).when(some, LEVELS[3]).otherwise(LEVELS[4])
    resolved = F.coalesce(*[F.when(u, F.col(f"{kind}_id")) for u, kind in zip(unique, _KINDS, strict=True)])
    return out.select("query_id", "pos", "name", "text", "k_name", "k_text", level.alias("level"), resolved.alias("resolved_id"))


def resolve(related: DataFrame, corpus: DataFrame) -> DataFrame:
    """``related`` with level, resolved_id (see :func:`resolve_ids`) and candidates.

    The candidates of an ambiguous row are all ids of its keys, in order; those
    lists are joined to ambiguous rows alone.
    """
    rows, keyed = resolve_ids(related, corpus), _held(corpus)
    none = F.array().cast("array<bigint>")
    own = ("query_id", "pos", "name", "text", "level", "resolved_id")
    clear = rows.where(F.col("level") != LEVELS[3]).select(*own, F.when(F.col("resolved_id").isNotNull(), F.array("resolved_id")).otherwise(none).alias("candidates"))
    unclear = rows.where(F.col("level") == LEVELS[3])
    for kind, keys in _KINDS.items():
        unclear = unclear.join(keyed.groupBy(*keys).agg(F.collect_list("id").alias(f"{kind}_ids")), list(keys), "left")
    every = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.coalesce(f"{kind}_ids", none) for kind in _KINDS]))))
    return clear.union(unclear.select(*own, every.alias("candidates")))


def reconcile(queries: DataFrame, related: DataFrame, corpus: DataFrame) -> DataFrame:
    """Each query (query_id, match_id, match_name) with its status and ids by its related rows."""
    item = F.struct("pos", "name", "level", "resolved_id")
    ours = resolve_ids(related, corpus).groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    refs = queries.select("query_id", F.posexplode("match_id").alias("pos", "id")).join(corpus.select("id", F.col("name").alias("own")), "id", "left")
    own = refs.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "own"))).alias("own"))
    row = queries.join(ours, "query_id", "left").join(own, "query_id", "left")
    none = F.array().cast("array<bigint>")
    items = F.coalesce("items", F.array().cast("array<struct<pos:int,name:string,level:string,resolved_id:bigint>>"))
    row = row.select("query_id", "match_name", F.coalesce("match_id", none).alias("raw_ids"), F.coalesce("own.own", F.array().cast("array<string>")).alias("own"), items.alias("items"))
    resolved = F.array_compact(F.col("items.resolved_id"))
    row = row.withColumns(
        {
            "resolved": resolved,
            "reconciled_ids": F.array_sort(F.array_distinct(resolved)),
            "all_high_confidence": (F.size("items") > 0) & F.forall("items", lambda i: i["level"].isin(*LEVELS[:2])),
            "all_resolved": (F.size("items") > 0) & F.forall("items", lambda i: i["resolved_id"].isNotNull()),
            "same_set": F.array_sort(F.array_distinct("raw_ids")) == F.array_sort(F.array_distinct(resolved)),
            "raw_clean": F.coalesce((F.size("raw_ids") == F.size("match_name")) & (F.size("raw_ids") == F.size("items")) & F.forall(F.arrays_zip("own", "match_name", F.col("items.name").alias("r")), lambda z: F.coalesce((z["own"] == z["match_name"]) & (z["own"] == z["r"]), F.lit(False))), F.lit(False)),
        }
    )
    ambiguous = F.exists("items", lambda i: i["level"] == LEVELS[3])
    status = (
        F.when(F.size("items") == 0, "unresolved")
        .when(F.col("all_resolved") & F.col("same_set"), F.when(F.col("raw_clean") & (F.col("raw_ids") == F.col("resolved")), "clean").otherwise("order_only_conflict"))
        .when(F.col("all_resolved"), "true_set_conflict")
        .when(F.size("resolved") > 0, "partially_resolved")
        .when(ambiguous, "ambiguous")
        .otherwise("unresolved")
    )
    row = row.withColumn("status", status)
    canonical = F.when(F.col("status").isin("clean", "order_only_conflict"), F.col("reconciled_ids")).otherwise(none)
    return row.select("query_id", "status", "raw_ids", "reconciled_ids", canonical.alias("canonical_ids"), "raw_clean", "all_high_confidence", "all_resolved", "same_set")


def counts(reconciled: DataFrame) -> DataFrame:
    """One row of how many queries there are of each kind."""
    status = F.col("status")
    agreed = status.isin("clean", "order_only_conflict")
    of = lambda test, name: F.count_if(test).alias(name)
    return reconciled.agg(
        F.count("*").alias("query_count"), of(F.col("raw_clean"), "raw_position_clean"), of(F.col("all_resolved"), "all_related_resolved"), of(F.col("all_high_confidence"), "high_confidence_all_related"),
        of(agreed & F.col("all_high_confidence"), "high_confidence_agreement"), of(~F.col("all_high_confidence"), "not_strict_high_confidence"), of(status.isin("ambiguous", "unresolved", "true_set_conflict"), "actual_unresolved_or_conflicted"),
    )
