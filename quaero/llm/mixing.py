"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source x language x topic.  The cells' token
shares are raked: scaled to the target share of every source, then language,
then topic, again and again, until they have all three marginals.  A cell's
sampling probability is its raked share over its share of tokens, times one
rate for all cells chosen so that the expected tokens are the asked part of
all; no probability exceeds one.  A document is drawn if a hash of its doc_id,
as a number in [0, 1), is below its cell's probability, so a rerun draws the
same documents.

The cells are summed over all documents on the executors.  Up to
:data:`MAX_CELLS` of them (counted first) are raked on the driver and
broadcast; more are raked as tables.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaero.llm.scratch import Scratch
from quaero.llm.skew import lookup

DIMENSIONS = ("source", "lang", "topic")
MAX_CELLS = 100_000


@dataclass(frozen=True)
class Mix:
    """The target where none is given: each dimension's shares are its token shares to a power, made to sum to one; power 1 keeps them, 0 makes them equal."""

    powers: tuple[float, float, float] = (0.5, 0.7, 0.8)
    part: float = 0.5
    #: Sweeps at most; they end before that where every marginal is met to ``tolerance``, and must meet them to ``allowed`` of all tokens.
    sweeps: int = 20
    tolerance: float = 1e-12
    allowed: float = 0.01
    seed: str = "mix"


def n_tokens(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic(text: Column, tokens: Column) -> Column:
    """A coarse register of a text, as its topic where the table has none."""
    having = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    return F.when(tokens < 50, "brief").when(4 * having("|") >= tokens, "table").when(4 * having("%") >= tokens, "markup").when(4 * having("!") >= tokens, "emphatic").otherwise("prose")


def _described(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns _source, _lang, _topic and _tokens; an unknown label is an empty string.

    The topic is the table's own column of that name, where it has one.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    label = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    out = docs.withColumn("_tokens", n_tokens(text))
    own = "topic" in (c.lower() for c in docs.columns)
    return out.withColumns({"_source": label("source"), "_lang": label("lang"), "_topic": label("topic") if own else topic(text, F.col("_tokens"))})


def goals(cells: DataFrame, mix: Mix, targets: DataFrame | None) -> dict[str, DataFrame]:
    """(label, goal, uses) of each dimension: the share that each of its labels is to have, and its number of cells.

    ``targets`` has (dimension, label, share): the shares of a dimension named
    there count relative to each other, and its labels that are not listed are
    to have none.  Other dimensions follow ``mix.powers``.  A label that is to
    have some but has no tokens is an error.
    """
    given = {} if targets is None else {r.dimension: float(r.total) for r in targets.groupBy("dimension").agg(F.sum("share").alias("total")).where(F.col("dimension").isin(*DIMENSIONS)).collect()}
    out = {}
    for name, power in zip(DIMENSIONS, mix.powers, strict=True):
        own = cells.groupBy(F.col(f"_{name}").alias("label")).agg(F.sum("t").alias("t"), F.count("*").alias("uses"))
        if name not in given:
            total = cells.agg(F.sum("t")).first()[0] or 1
            own = own.withColumn("goal", F.pow(F.col("t") / F.lit(float(total)), F.lit(power)))
            of = own.agg(F.sum("goal")).first()[0] or 1.0
        else:
            asked = targets.where(F.col("dimension") == name).groupBy(F.coalesce("label", F.lit("")).alias("label")).agg(F.sum("share").cast("double").alias("goal"))
            wrong = asked.where("goal < 0 or goal > 0 and isnan(goal)").first() or asked.where("goal > 0").join(own, "label", "left_anti").first()
            if wrong:
                raise ValueError(f"{name} {wrong.label!r} is to have {wrong.goal} but has no tokens, or the share is no share")
            own, of = own.join(asked, "label", "left").fillna(0.0, "goal"), given[name]
            if of <= 0:
                raise ValueError(f"the shares of {name} are all zero")
        out[name] = own.select("label", (F.col("goal") / F.lit(float(of))).alias("goal"), "uses")
    return out


class Infeasible(ValueError):
    """Targets that no weights of the cells meet."""


def _powers(label: np.ndarray, weight: np.ndarray, power: float) -> np.ndarray:
    share = np.bincount(label, weight) ** power
    return share / share.sum()


def rake(labels: list[np.ndarray], tokens: np.ndarray, mix: Mix, goal: list[np.ndarray] | None = None) -> np.ndarray:
    """The raked share of each cell, for its label numbers in each dimension and its tokens (> 0); ``goal`` has each dimension's shares by label number."""
    weight = tokens / tokens.sum()
    goal = goal or [_powers(label, weight, power) for label, power in zip(labels, mix.powers, strict=True)]
    apart = 0.0
    for _ in range(mix.sweeps):
        for label, target in zip(labels, goal, strict=True):
            has = np.bincount(label, weight, len(target))
            weight = weight * np.divide(target, has, out=np.zeros(len(target)), where=has > 0)[label]
        apart = max(np.abs(np.bincount(label, weight, len(target)) - target).max() for label, target in zip(labels, goal, strict=True))
        if apart <= mix.tolerance:
            break
    if apart > mix.allowed:
        raise Infeasible(f"after {mix.sweeps} sweeps a label's share is off its target by {apart:.4f} of all tokens")
    return weight


def rate(tokens: np.ndarray, weight: np.ndarray, part: float) -> float:
    """The factor s for which sum(min(1, s * weight / tokens) * tokens) is ``part`` of all tokens."""
    some = weight > 0  # cells that the mix has no use for are never drawn
    asked, tokens, weight = part * tokens.sum(), tokens[some], weight[some]
    order = np.argsort(-weight / tokens, kind="stable")
    t, w = tokens[order], weight[order]
    full = np.cumsum(t) - t
    free = w.sum() - (np.cumsum(w) - w)
    s = (asked - full) / free
    fits = np.flatnonzero(s * w / t <= 1 + 1e-12)
    return float(s[fits[0]]) if len(fits) else float(np.max(t / w))


def _raked_table(cells: DataFrame, mix: Mix, targets: DataFrame | None) -> DataFrame:
    """As :func:`rake` and :func:`rate`, for more cells than a driver should hold."""
    scratch = Scratch(cells.sparkSession, "mixing")
    total = cells.agg(F.sum("t")).first()[0]
    now = scratch.table(cells.withColumn("w", F.col("t") / F.lit(float(total))))
    names = [f"_{d}" for d in DIMENSIONS]
    shares = {f"_{d}": scratch.table(g.withColumnRenamed("label", f"_{d}")) for d, g in goals(now, mix, targets).items()}
    count = now.count()
    has = lambda name: now.groupBy(name).agg(F.sum("w").alias("has")).join(shares[name], name)
    apart = 0.0
    for _ in range(mix.sweeps):
        for name in names:
            factor = scratch.table(has(name).select(name, F.when(F.col("has") > 0, F.col("goal") / F.col("has")).otherwise(0.0).alias("f"), "uses"))
            new = scratch.table(lookup(now, factor, name, "uses", count).withColumn("w", F.col("w") * F.col("f")).drop("f", "uses"))
            scratch.drop(now, factor)
            now = new
        apart = max(has(name).agg(F.max(F.abs(F.col("has") - F.col("goal")))).first()[0] for name in names)
        if apart <= mix.tolerance:
            break
    if apart > mix.allowed:
        raise Infeasible(f"after {mix.sweeps} sweeps a label's share is off its target by {apart:.4f} of all tokens")
    some = F.col("w") > 0
    low, high = 0.0, float(now.where(some).agg(F.max(F.col("t") / F.col("w"))).first()[0])
    drawn = lambda s: now.agg(F.sum(F.least(F.lit(1.0), F.lit(s) * F.col("w") / F.col("t")) * F.col("t"))).first()[0]
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if drawn(middle) < mix.part * total else (low, middle)
    return now.select(*names, F.least(F.lit(1.0), F.lit(high) * F.col("w") / F.col("t")).alias("_p"), (F.col("w") / F.col("t") * F.lit(float(total))).alias("_w"), F.col("n").alias("_n"))


def _cells(docs: DataFrame) -> DataFrame:
    names = [f"_{d}" for d in DIMENSIONS]
    return _described(docs).groupBy(*names).agg(F.sum("_tokens").alias("t"), F.count("*").alias("n")).where("t > 0")


def weigh(docs: DataFrame, mix: Mix = Mix(), max_cells: int = MAX_CELLS, targets: DataFrame | None = None) -> DataFrame:
    """``docs`` with topic, n_tokens, weight, probability and sampled.

    ``targets`` (dimension, label, share) gives target shares, see
    :func:`goals`; what no weights can meet raises :class:`Infeasible`.
    ``docs`` may have a column topic; without one it is made from the text.
    ``weight`` is the factor by which a token of the document's cell counts for
    the target mix; ``probability`` that of drawing it.  Texts without a word
    (null, empty) have weight one and are drawn at the asked part.  A null
    source or language is a label of its own; a null doc_id is hashed as an
    empty string; repeated rows are drawn alike.  Columns of these names in
    ``docs`` are replaced, but a topic stays what it is (null: empty).
    """
    spark = docs.sparkSession
    docs = docs.drop("n_tokens", "weight", "probability", "sampled")
    scratch = Scratch(spark, "cells")
    cells = scratch.table(_cells(docs))
    names = [f"_{d}" for d in DIMENSIONS]
    count = cells.count()
    if count <= max_cells:
        rows = cells.orderBy(*names).collect()
        labels = [np.array(list(map({x: k for k, x in enumerate(sorted({r[i] for r in rows}))}.get, (r[i] for r in rows)))) for i in range(3)] if rows else []
        made = []
        if rows:
            tokens = np.array([r.t for r in rows], float)
            shares = [{r.label: r.goal for r in g.collect()} for g in goals(cells, mix, targets).values()]  # labels of the cells, so no more than those
            weight = rake(labels, tokens, mix, [np.array([share[x] for x in sorted({r[i] for r in rows})]) for i, share in enumerate(shares)])
            p = np.minimum(1.0, rate(tokens, weight, mix.part) * weight / tokens)
            made = [(*r[:3], float(a), float(b)) for r, a, b in zip(rows, p, weight / tokens * tokens.sum(), strict=True)]
        table = spark.createDataFrame(made, "_source string, _lang string, _topic string, _p double, _w double")
        joined = _described(docs).join(F.broadcast(table), names, "left")
    else:
        cell = F.to_json(F.array(*names))
        table = scratch.table(_raked_table(cells, mix, targets)).withColumn("_cell", cell).drop(*names)
        total = cells.agg(F.sum("n")).first()[0]
        joined = lookup(_described(docs).withColumn("_cell", cell), table, "_cell", "_n", total, "left")
    number = F.conv(F.substring(F.md5(F.concat(F.lit(mix.seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    p = F.coalesce("_p", F.lit(mix.part))
    return joined.select(*[c for c in docs.columns if c.lower() != "topic"], F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), F.coalesce("_w", F.lit(1.0)).alias("weight"), p.alias("probability"), (number < p).alias("sampled"))


def sql(mix: Mix = Mix()) -> str:
    """DuckDB SQL for the weights and draws of ``documents``."""
    having = lambda c: f"(length(x) - length(replace(x, '{c}', '')))"
    out = f"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS x, coalesce(source, '') AS source, coalesce(lang, '') AS lang FROM documents),
b AS (SELECT doc_id, source, lang, x, CAST(len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n FROM a),
d AS (SELECT doc_id, source, lang, n, CASE WHEN n < 50 THEN 'brief' WHEN 4 * {having('|')} >= n THEN 'table' WHEN 4 * {having('%')} >= n THEN 'markup' WHEN 4 * {having('!')} >= n THEN 'emphatic' ELSE 'prose' END AS topic FROM b),
c0 AS (SELECT source, lang, topic, CAST(sum(n) AS DOUBLE) AS t FROM d GROUP BY ALL HAVING sum(n) > 0),
c1 AS (SELECT *, t / sum(t) OVER () AS w FROM c0)"""
    for name, power in zip(DIMENSIONS, mix.powers, strict=True):
        out += f",\ng_{name} AS (SELECT {name}, g / sum(g) OVER () AS g FROM (SELECT {name}, pow(sum(w), {power}) AS g FROM c1 GROUP BY {name}))"
    out += ",\nr0 AS MATERIALIZED (SELECT c1.*, g_source.g AS g_source, g_lang.g AS g_lang, g_topic.g AS g_topic FROM c1 JOIN g_source USING (source) JOIN g_lang USING (lang) JOIN g_topic USING (topic))"
    step = 0
    for _ in range(mix.sweeps):
        for name in DIMENSIONS:
            step += 1
            out += f",\nr{step} AS MATERIALIZED (SELECT source, lang, topic, t, w * g_{name} / sum(w) OVER (PARTITION BY {name}) AS w, g_source, g_lang, g_topic FROM r{step - 1})"
    out += f""",
o AS (SELECT *, sum(t) OVER () AS total, sum(t) OVER before - t AS whole, sum(w) OVER () - (sum(w) OVER before - w) AS rest FROM r{step} WINDOW before AS (ORDER BY w / t DESC, source, lang, topic)),
s AS (SELECT coalesce((SELECT arg_min(({mix.part} * total - whole) / rest, whole) FROM o WHERE ({mix.part} * total - whole) / rest * w / t <= 1 + 1e-12), (SELECT max(t / w) FROM o)) AS s),
p AS (SELECT source, lang, topic, w / t * total AS weight, least(1.0, s * w / t) AS p FROM o, s)
SELECT doc_id, source, lang, topic, n AS n_tokens, round(coalesce(weight, 1.0), 6) AS weight, round(coalesce(p, {mix.part}), 6) AS probability,
       CAST(CAST('0x' || substr(md5('{mix.seed}' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 < coalesce(p, {mix.part}) AS sampled
FROM d LEFT JOIN p USING (source, lang, topic)
"""
    return out


def op7(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Weights, probabilities and draws of all documents."""
    out = weigh(docs, mix)
    label = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return out.select("doc_id", label("source"), label("lang"), "topic", "n_tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "sampled")
