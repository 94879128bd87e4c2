"""Left outer joins of rows whose keys may be hot or null.

The joins here keep all rows, so nothing can be counted beforehand. Instead the hot keys
are found by a sketch of frequent items, which partitions fill and merge, and their rows
are dealt over salts by a hash; the partner rows of hot keys, and only those, are copied to each salt.
Rows without a key have no partner and do not go through the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 128  # a key in more than one of HOT_KEYS / 2 rows is found for certain
TRACKED = 4_096  # items that the sketch keeps
SALTS = 64


def hot_keys(rows: DataFrame, columns: list[str]) -> dict[str, list]:
    """For each column the keys that hold more than a HOT_KEYS-th of all rows, at most HOT_KEYS of them."""
    if not columns:
        return {}
    most = [F.expr(f"approx_top_k({c}, {HOT_KEYS}, {TRACKED})").alias(c) for c in columns]
    found = rows.agg(F.count(F.lit(1)).alias("_rows"), *most).first()
    return {c: [x.item for x in found[c] or [] if x["count"] * HOT_KEYS > found["_rows"]] for c in columns}


def left_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, hot: list | None) -> DataFrame:
    """``left`` and all its partners in ``right``, nulls where there is none.

    ``hot`` are the keys whose rows are dealt over SALTS parts; None stands for a ``left`` so
    small that one task could take all its rows.
    """
    on = F.col(left_key) == F.col(right_key)
    if hot is None:
        return left.join(right, on, "left")
    there = left.filter(F.col(left_key).isNotNull())
    if hot:
        part = F.pmod(F.xxhash64(*left.columns), F.lit(SALTS))
        parts = F.when(F.col(right_key).isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        there = there.withColumn("_part", F.when(F.col(left_key).isin(hot), part).otherwise(0).cast("int"))
        copied = right.withColumn("_copy", F.explode(parts))
        joined = there.join(copied, on & (F.col("_part") == F.col("_copy")), "left").drop("_part", "_copy")
    else:
        joined = there.join(right, on, "left")
    nothing = [F.lit(None).cast(kind).alias(c) for c, kind in right.dtypes]
    return joined.unionByName(left.filter(F.col(left_key).isNull()).select(*left.columns, *nothing))
