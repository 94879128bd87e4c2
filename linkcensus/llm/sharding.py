"""Sharding by sampled splitters: shards of nearly equal bytes, equal texts side by side.

Rows are ordered by (hash of the text, document id). A sample in which a row's chance
grows with its size gives quantile boundaries; every row falls into one of many fine
ranges between them. Ranges that turn out overfull get further splitters from a denser
sample of their own rows. Sums per range, taken over all rows, then place each range on
the line of cumulated bytes, and shards are equal pieces of that line: a range that
holds a piece's end is divided there. So no shard differs from the mean by more than
about one document, and one group of equal texts may spread over shards if it is large.

Only keys and sizes are shuffled here. What reaches the driver is at most
SAMPLES_PER_RANGE keys and one sum for each of at most MAX_RANGES ranges.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkcensus.llm.common import stored

SAMPLES_PER_RANGE = 24
RANGE_BYTES = 4 << 20
MIN_RANGES, MAX_RANGES = 256, 4096
OVERFULL = 2.0
ROUNDS = 3


def assign_shards(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard): each row's place under the law `bytes`.

    size: UTF-8 bytes plus 1. Null texts count as empty, with size 1. Repeated rows are
    placed one by one. An empty table gives an empty result. slot counts from 0 without
    gaps in each shard, in the order of the keys. grown_shard belongs to another law
    and is null. Other columns of `docs` don't matter.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    id_key = F.coalesce(F.hex(F.col(id_col)), F.lit(""))
    rows = stored(
        docs.select(
            F.col(id_col),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.concat(F.lpad(F.hex(F.xxhash64(text)), 16, "0"), F.lpad(id_key, 16, "0")).alias("_key"),
        ),
        "shard-keys",
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    ranges = min(MAX_RANGES, max(MIN_RANGES, total // RANGE_BYTES))
    splitters = _splitters(rows, total, ranges)
    ranged, sums = _subdivided(rows, total, ranges, splitters)
    sums["before"] = sums["bytes"].cumsum() - sums["bytes"]
    spark = docs.sparkSession
    starts = F.broadcast(spark.createDataFrame(sums[["range", "before"]], "_range int, _before long"))
    in_range = Window.partitionBy("_range").orderBy("_key")
    upto = F.sum("size").over(in_range.rowsBetween(Window.unboundedPreceding, 0))
    middle = F.col("_before") + upto - F.col("size") / 2
    shard = F.least(F.floor(middle * n_shards / max(total, 1)), F.lit(n_shards - 1)).cast("int")
    placed = ranged.join(starts, "_range").withColumn("shard", shard)
    placed = stored(
        placed.withColumn("_at", F.row_number().over(Window.partitionBy("_range", "shard").orderBy("_key"))), "shard-places"
    )
    pieces = placed.groupBy("shard", "_range").agg(F.count("*").alias("n")).toPandas().sort_values(["shard", "_range"])
    pieces["first"] = pieces.groupby("shard")["n"].cumsum() - pieces["n"]
    firsts = F.broadcast(spark.createDataFrame(pieces[["shard", "_range", "first"]], "shard int, _range int, _first long"))
    return placed.join(firsts, ["shard", "_range"]).select(
        id_col,
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_first") + F.col("_at") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 16) -> None:
    """Writes `docs`, with all columns, into folders shard=0 to shard=n-1. Ids must be unique."""
    places = assign_shards(docs, n_shards).select("doc_id", "shard", "slot")
    docs.join(places, "doc_id").write.partitionBy("shard").parquet(path)


def _splitters(rows: DataFrame, total: int, ranges: int) -> list[bytes]:
    """Quantiles of a sample in which a row's chance is proportional to its size."""
    chance = F.col("size") * (ranges * SAMPLES_PER_RANGE / max(total, 1))
    return _quantiles(sorted(r[0].encode() for r in rows.filter(_uniform() < chance).select("_key").collect()), ranges)


def _uniform(seed: int = 1):
    return (F.xxhash64("_key", F.lit(seed)) / 2.0**64) + 0.5


def _quantiles(keys: list[bytes], ranges: int) -> list[bytes]:
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def _subdivided(rows: DataFrame, total: int, ranges: int, splitters: list[bytes]) -> tuple[DataFrame, pd.DataFrame]:
    """Rows with their range, and the bytes of each range; overfull ranges are cut by further splitters."""
    for left in range(ROUNDS, -1, -1):
        ranged = rows.withColumn("_range", _range_of(splitters)("_key"))
        sums = ranged.groupBy(F.col("_range").alias("range")).agg(F.sum("size").alias("bytes"))
        sums = sums.toPandas().sort_values("range", ignore_index=True)
        full = sums[sums["bytes"] > OVERFULL * total / ranges]
        if not left or full.empty or len(splitters) + len(full) > 2 * MAX_RANGES:
            return ranged, sums
        parts = {int(r): math.ceil(b * ranges / total) for r, b in zip(full["range"], full["bytes"], strict=True)}
        chance = F.col("size") * (ranges * SAMPLES_PER_RANGE / total)
        sample = ranged.filter(F.col("_range").isin(list(parts)) & (_uniform(left + 1) < chance)).select("_range", "_key")
        keys: dict[int, list[bytes]] = {}
        for number, key in sample.collect():
            keys.setdefault(number, []).append(key.encode())
        more = {k for number, own in keys.items() for k in _quantiles(sorted(own), parts[number])}
        if more <= set(splitters):
            return ranged, sums
        splitters = sorted(more | set(splitters))
    raise AssertionError("unreachable")


def _range_of(splitters: list[bytes]):
    bounds = np.array(splitters, dtype="S32")

    @F.pandas_udf("int")
    def number(keys: pd.Series) -> pd.Series:
        found = np.searchsorted(bounds, keys.to_numpy(dtype="S32"), side="right")
        return pd.Series(found.astype("int32"))

    return number
