"""Reciprocal rank fusion of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaero.operators.ranking import top_k


def fuse(lists: list[DataFrame], k: int = 10, pool: int = 50, constant: int = 60) -> DataFrame:
    """(query_id, rank, score, id): ids by the sum of 1 / (constant + rank) over the lists' first ``pool`` ranks; equal sums go by id."""
    cut = [x.where(F.col("rank") <= pool).select("query_id", "id", "rank") for x in lists]
    score = F.sum(F.lit(1.0) / (F.lit(constant) + F.col("rank")))
    return top_k(reduce(DataFrame.unionByName, cut).groupBy("query_id", "id").agg(score.alias("score")), k).select("query_id", "rank", "score", "id")
