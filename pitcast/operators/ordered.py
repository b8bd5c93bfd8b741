"""Ranks and running sums along an order, spread over tasks also where one key holds most rows.

Rows are range-partitioned by key and order. Windows run inside a partition only, and what earlier partitions
hold of the same key is added from a table with one row per key and partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitcast.session import staged


def placed(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with its range partition ``_pid``; the partition number is written down with the row."""
    return staged(df.repartitionByRange(*keys, *order).withColumn("_pid", F.spark_partition_id()), "ranged")


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "_pos") -> DataFrame:
    """``df`` with its position from 1 within ``keys``; ``order`` must be unique there."""
    rows = placed(df, keys, order)
    sizes = rows.groupBy(*keys, "_pid").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*keys).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    local = F.row_number().over(W.partitionBy("_pid", *keys).orderBy(*order))
    return rows.withColumn("_local", local).join(offsets, [*keys, "_pid"]).withColumn(name, F.col("_before") + F.col("_local")).drop("_before", "_local", "_pid")


def running_before(df: DataFrame, keys: Sequence[str], order: str, sums: Sequence[str]) -> DataFrame:
    """``df`` with each of ``sums`` replaced by its sum over the rows of the same key with a smaller ``order``."""
    rows = placed(df, keys, [order])
    totals = rows.groupBy(*keys, "_pid").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    earlier = W.partitionBy(*keys).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_pid", *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_t_{c}") for c in sums])
    local = W.partitionBy("_pid", *keys).orderBy(order).rangeBetween(W.unboundedPreceding, -1)
    inside = rows.withColumns({f"_l_{c}": F.coalesce(F.sum(c).over(local), F.lit(0)) for c in sums})
    joined = inside.join(offsets, [*keys, "_pid"]).withColumns({c: F.col(f"_l_{c}") + F.col(f"_t_{c}") for c in sums})
    return joined.drop("_pid", *[f"_l_{c}" for c in sums], *[f"_t_{c}" for c in sums])


def framed(df: DataFrame, keys: Sequence[str], order: Sequence[str], before: int, block: int = 8_192) -> DataFrame:
    """``df`` in blocks of its order, for frames and lags that reach up to ``before`` rows back.

    Rows are numbered (``_pos``) within ``keys`` and dealt to blocks (``_block``) of ``block`` rows, at least ``before``. A block also holds the
    last ``before`` rows of the one ahead of it (``_halo``), so a window partitioned by keys and block, in order of ``_pos``, sees all that
    its own rows need; the halo rows are dropped afterwards. No task holds more than a block, however long a series is.
    """
    size = max(block, before, 1)
    rows = ranked(df, keys, order)
    at = F.expr(f"(_pos - 1) div {size}")
    late = (F.col("_pos") - 1) % size >= size - before
    blocks = F.when(late, F.array(F.struct(at.alias("b"), F.lit(False).alias("h")), F.struct((at + 1).alias("b"), F.lit(True).alias("h")))).otherwise(
        F.array(F.struct(at.alias("b"), F.lit(False).alias("h")))
    )
    return rows.withColumn("_to", F.explode(blocks)).withColumns({"_block": F.col("_to.b"), "_halo": F.col("_to.h")}).drop("_to")
