"""Key lookups that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of all rows on, so at most ``HOT`` keys can be hot and their lookup rows may be broadcast.
HOT = 2000


def free_name(name: str, *tables: DataFrame) -> str:
    """``name``, made longer until none of ``tables`` has a column of that name in any case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Words of 64 bits in the table of :func:`sift`: so many rows at most are broadcast, however many keys there are.
WORDS = 1 << 19


def sift(left: DataFrame, value: Column, keys: DataFrame, key: Column, flag: str) -> DataFrame:
    """``left`` with ``flag``: false where the hash ``value`` (long) is none of ``keys``' hashes ``key``, true where it may be one.

    The keys set bits of a table of fixed size, which is broadcast.  Rows of
    which the flag is false need no shuffle to learn that nothing joins them;
    with very many keys more are flagged, and the result is the same.
    """
    word = lambda c: F.pmod(c, F.lit(WORDS))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(c, 24), F.lit(64)).cast("int"))
    at, mask = free_name("_word", left), free_name("_mask", left)
    bits = keys.select(word(key).alias(at), bit(key).alias(mask)).groupBy(at).agg(F.bit_or(mask).alias(mask))
    out = left.join(F.broadcast(bits), word(value) == F.col(at), "left")
    return out.select(*left.columns, F.coalesce(F.col(mask).bitwiseAND(bit(value)) != 0, F.lit(False)).alias(flag))


def lookup(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """Join ``left`` to ``right`` (unique in ``key``) on ``key``.

    ``right[weight]`` counts the rows of ``left`` with that key and ``total``
    all rows of ``left``.  At most ``HOT`` keys hold ``total / HOT`` rows or
    more; those are looked up by a broadcast of that bounded set, all others by
    a shuffle in which no key holds more than that share.  Null keys match
    nothing; ``how`` is "inner" or "left".
    """
    mark = free_name("_hot", left, right)
    hot = right.where(F.col(weight) * F.lit(HOT) > F.lit(int(total)))
    values = [c for c in right.columns if c != key]
    marked = left.join(F.broadcast(hot.select(key, F.struct(*values).alias(mark))), key, "left")
    out = [c for c in left.columns if c != key]
    found = marked.where(F.col(mark).isNotNull()).select(key, *out, *[F.col(mark)[v].alias(v) for v in values])
    rest = marked.where(F.col(mark).isNull()).drop(mark)
    cold = right.where(F.col(weight) * F.lit(HOT) <= F.lit(int(total)))
    if how == "left":  # null keys would meet in one task
        none = rest.where(F.col(key).isNull())
        found = found.unionByName(none, allowMissingColumns=True)
        rest = rest.where(F.col(key).isNotNull())
    return found.unionByName(rest.join(cold, key, how).select(key, *out, *values))
