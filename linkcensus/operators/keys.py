"""Counting through joins by key, without building the joined rows.

The census only counts, so a join can be done on ``(key, how many rows)`` pairs:
both sides are grouped first, with partial aggregation before the shuffle, and the
counts are multiplied. Repeated keys keep their bag semantics, and a key that holds
a third of all rows arrives at the join as one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000  # rows of one or two keys and a count
SALTS = 1_024
THIN_BYTES = 64 << 20  # tables that Spark estimates at less are as well shuffled whole
FILTER_WORDS = 20  # bits of a word's number: 2^20 words of 64 bits are broadcast at most, whatever the number of keys


def key_counts(df: DataFrame, *keys: str | Column, name: str = "n") -> DataFrame:
    """How many rows each key has. Rows with a null key are kept."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def only_keys(df: DataFrame, column: str, wanted: DataFrame, small: bool) -> DataFrame:
    """Map-side filter of ``df`` by a one-column frame, exact if that is of known small size.

    ``small`` tells whether it is; otherwise a bit map takes its place. This never
    changes a result that goes on to be joined on ``column``.
    """
    if not small:
        return perhaps_keys(df, column, wanted)
    keys = wanted.select(F.col(wanted.columns[0]).alias("_wanted"))
    return df.join(F.broadcast(keys), F.col(column) == F.col("_wanted"), "left_semi")


def estimated_bytes(df: DataFrame) -> int:
    """What Spark's statistics say of the size; an estimate from file sizes, no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def perhaps_keys(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Map-side filter of ``df`` by a one-column frame of any size: most rows whose key is not in it go.

    The keys come together in a bit map of bounded size, words of it as rows, and the map is
    broadcast. It lets all wanted keys through, and others by chance, so an exact join has to follow. Null keys go.
    A small ``df`` passes as it is: reading ``wanted`` twice would cost more than its shuffle.
    """
    if estimated_bytes(df) <= THIN_BYTES:
        return df.filter(F.col(column).isNotNull())

    word = F.shiftrightunsigned(F.xxhash64("_key"), 64 - FILTER_WORDS)
    bit = F.expr("shiftleft(1L, int(xxhash64(_key) & 63))")
    keys = wanted.select(F.col(wanted.columns[0]).cast("bigint").alias("_key")).filter("_key IS NOT NULL")
    words = keys.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    own = df.withColumn("_key", F.col(column).cast("bigint")).filter("_key IS NOT NULL")
    met = own.join(F.broadcast(words), word == F.col("_word"))
    return met.filter(F.col("_bits").bitwiseAND(bit) != 0).select(*df.columns)


def weighted(hits: DataFrame, parents: DataFrame, key: str, small: bool, *carry: str) -> DataFrame:
    """Rows of ``parents`` that meet a hit, ``n`` being hits times parent rows.

    ``hits`` has columns ``key`` and ``n`` and perhaps more; ``key`` names the
    column of ``parents``. Hits known to be few are broadcast and the parents are
    not shuffled; beyond that both sides come to the join grouped by key, and parents
    that no hit can meet have gone before they are grouped.
    """
    parents = parents.withColumnRenamed(key, "key")
    if small:
        return parents.join(F.broadcast(hits), "key")
    counted = key_counts(perhaps_keys(parents, "key", hits.select("key")), "key", *carry, name="_rows")
    return counted.join(hits, "key").withColumn("n", F.col("n") * F.col("_rows")).drop("_rows")


def lookup(left: DataFrame, right: DataFrame, key: str, how: str, small: bool, salt_by: str) -> DataFrame:
    """Join ``right``, which has each ``key`` once, to a ``left`` of any skew.

    ``small`` says that ``right`` is known to be within BROADCAST_ROWS. Beyond it
    the rows of a key are spread over ``SALTS`` parts by a hash of ``salt_by``, and
    ``right`` is copied only to the parts that occur.
    """
    if small:
        return left.join(F.broadcast(right), key, how)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)))
    parts = salted.select(key, "_salt").distinct()
    spread = parts.join(right, key, "inner")
    return salted.join(spread, [key, "_salt"], how).drop("_salt")
