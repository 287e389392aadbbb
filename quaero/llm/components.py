"""Connected components of a link table by alternating star contractions.

Each round points every node's larger neighbours at its smallest neighbour
(large star), then every node and its smaller neighbours at the smallest of
those (small star).  The links end as one star per component.  All state is in
tables; a node with very many links is handled by :func:`quaero.llm.skew.lookup`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaero.llm.scratch import Scratch
from quaero.llm.skew import lookup


def _state() -> dict[str, Column]:
    """What tells whether a round changed anything."""
    return {"n": F.count(F.lit(1)), "sum": F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))}


def _star(scratch: Scratch, links: DataFrame, large: bool) -> tuple[DataFrame, dict]:
    """One contraction of ``links`` (a > b), large star or small star, and its state."""
    if large:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b"), F.col("a")))
    else:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least, seen = scratch.counted(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), total=F.sum("n"))
    seen = lookup(both, least, "u", "n", seen["total"] or 0)
    moved = seen.where(F.col("v") > F.col("u")) if large else seen.where(F.col("v") != F.col("m"))
    out = moved.select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    out, state = scratch.counted(out.where("a <> b").distinct(), **_state())
    scratch.drop(least)
    return out, state


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(a, b): for every linked node but the smallest of its component, that smallest node.

    ``links`` has columns a > b of an ordered type and lies in ``scratch``; it
    is dropped.  Rounds go on until one changes nothing.
    """
    before = links.agg(*[c.alias(k) for k, c in _state().items()]).first().asDict()
    while before["n"]:
        wide, _ = _star(scratch, links, True)
        narrow, now = _star(scratch, wide, False)
        scratch.drop(links, wide)
        links = narrow
        if now == before:
            break
        before = now
    return links
