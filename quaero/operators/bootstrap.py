"""Paired bootstrap intervals of metric differences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1000


def difference(left, right, samples: int = 10_000, seed: int = 42) -> tuple[float, float, float]:
    """The mean difference of paired values and its 2.5 and 97.5 percentiles over resamples.

    The generator is made anew for each comparison and draws CHUNK resamples at
    a time, so the numbers don't depend on what else is compared.
    """
    gap = np.asarray(left, float) - np.asarray(right, float) if len(left) == len(right) else np.zeros(0)
    if not len(gap):
        raise ValueError("paired values must be as many, and some")
    draw = np.random.default_rng(seed)
    means = [gap[draw.integers(0, len(gap), (min(CHUNK, samples - at), len(gap)))].mean(1) for at in range(0, samples, CHUNK)]
    low, high = np.percentile(np.concatenate(means), [2.5, 97.5])
    return float(gap.mean()), float(low), float(high)


def paired(values: DataFrame, keys: list[str], pairs: list[tuple[str, str]], samples: int = 10_000, seed: int = 42) -> DataFrame:
    """Intervals for each of ``keys``, pair of retrievers and metric, in parallel.

    ``values`` is (keys.., retriever, query_id, metric, value).
    """
    spark = values.sparkSession
    wanted = spark.createDataFrame(pairs, "left string, right string")
    a = values.withColumnsRenamed({"retriever": "left", "value": "l"})
    b = values.withColumnsRenamed({"retriever": "right", "value": "r"})
    both = a.join(F.broadcast(wanted), "left").join(b, [*keys, "query_id", "metric", "right"])
    types = dict(values.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("query_id")
        gap, low, high = difference(pdf["l"], pdf["r"], samples, seed)
        head = {c: [pdf[c].iloc[0]] for c in [*keys, "left", "right", "metric"]}
        return pd.DataFrame({**head, "difference": [round(gap, 6)], "ci_low": [round(low, 6)], "ci_high": [round(high, 6)]})

    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], "left string, right string, metric string, difference double, ci_low double, ci_high double"])
    return both.groupBy(*keys, "left", "right", "metric").applyInPandas(run, schema)


def hashed(gaps: DataFrame, samples: int = 200, seed: int = 42) -> DataFrame:
    """(difference, ci_low, ci_high) of paired differences (query_id, gap), with resamples drawn by an integer hash.

    All of it is SQL, so another engine can repeat it: resample r takes at its
    i-th place the value whose number is a 32-bit mix of r * n + i + seed.
    """
    numbered = gaps.withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("query_id")) - 1)
    n = gaps.count()
    values = F.broadcast(numbered.select("pos", "gap"))
    spark = gaps.sparkSession
    draws = spark.range(samples * n).select((F.col("id") / n).cast("long").alias("rep"), hash_index(F.col("id") + seed, n).alias("pos"))
    means = draws.join(values, "pos").groupBy("rep").agg(F.avg("gap").alias("m"))
    interval = means.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("p"))
    return gaps.agg(F.avg("gap").alias("d")).crossJoin(interval).select(F.round("d", 6).alias("difference"), F.round(F.col("p")[0], 6).alias("ci_low"), F.round(F.col("p")[1], 6).alias("ci_high"))


def hash_index(x, n: int):
    """A 32-bit mix of an integer column, modulo n."""
    size = 1 << 32
    h = (x * 2654435761) % size
    for _ in range(2):
        h = (h.bitwiseXOR(F.shiftright(h, 16)) * 73244475) % size
    return h.bitwiseXOR(F.shiftright(h, 16)) % n
