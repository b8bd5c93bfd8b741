"""Content hashes that do not depend on row order or partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_hash(df: DataFrame) -> Column:
    """SHA-256 of one row, fields in name order, NULL kept distinct from empty text."""
    fields = [F.col(f"`{c}`") for c in sorted(df.columns)]
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def payload_hash(payload: Column | str) -> Column:
    c = F.col(payload) if isinstance(payload, str) else payload
    return F.sha2(c, 256)


def frame_hash(df: DataFrame, *keys: str) -> DataFrame:
    """One content hash per key (or for the table).

    Each row's digest is cut into its four 64-bit words, whose sums and the row count are hashed again, so the
    aggregation keeps a fixed-size buffer however many rows a key holds. Equal tables have equal hashes; different ones
    differ but by chance. It is no defence against rows made up to collide.
    """
    words = [
        F.conv(F.substring("h", 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)") for i in range(4)
    ]
    sums = [F.sum(w).alias(f"w{i}") for i, w in enumerate(words)]
    totals = df.select(*keys, row_hash(df).alias("h")).groupBy(*keys).agg(*sums, F.count(F.lit(1)).alias("n"))
    packed = F.concat_ws("|", *[F.col(f"w{i}").cast("string") for i in range(4)], F.col("n").cast("string"))
    return totals.select(*keys, F.col("n").alias("n_rows"), F.sha2(packed, 256).alias("source_hash"))


#: Rounds of a permutation; each swaps about half of the pairs it looks at.
ROUNDS = 20


def hashed_below(tag: Column, size: Column) -> Column:
    """A number below ``size`` from the hash of a text, the same in every engine that knows MD5."""
    return F.conv(F.substring(F.md5(tag), 1, 15), 16, 10).cast("bigint") % size


def permuted(index: Column, tag: Column, size: Column) -> Column:
    """``index`` under a pseudorandom permutation of 0 to ``size`` - 1 that ``tag`` picks.

    A round pairs x with its mirror at a hashed point modulo the size, and swaps the two or not by a hash of the larger one. Each round is
    one-to-one for every size, so there is nothing to sort, to look up or to walk through again.
    """
    def turn(x: Column, r: Column) -> Column:
        other = F.pmod(hashed_below(F.concat_ws(":", tag, r), size) - x, size)
        return F.when(F.md5(F.concat_ws(":", tag, r, F.greatest(x, other))) < F.lit("8"), other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index, turn)
