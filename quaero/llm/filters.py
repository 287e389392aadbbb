"""Row filters whose verdict is taken where the row is read, so it holds for that row whatever its id."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def keep_rows(docs: DataFrame, good: Callable[[pa.Array], np.ndarray], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` for whose texts ``good`` is true, with all their columns.

    One pass without a shuffle.  ``good`` gets a batch's texts (nulls included)
    and returns a flag for each.  Rows without an id, repeated rows and rows
    that share an id are judged each by its own text.
    """
    plain = isinstance(docs.schema[text_col].dataType, T.StringType)
    read = docs if plain else docs.withColumn("__text", F.col(text_col).cast("string"))
    at, n = read.columns.index(text_col if plain else "__text"), len(docs.columns)

    def run(batches):
        for batch in batches:
            kept = batch.filter(pa.array(np.asarray(good(batch.column(at)), bool)))
            if kept.num_rows:
                yield kept.select(list(range(n)))

    return read.mapInArrow(run, docs.schema)
