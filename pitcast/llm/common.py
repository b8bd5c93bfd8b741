"""Helpers shared by the text operators: tables, staging and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitcast.session import scratch_path

#: White space of the contracts, as a Java and DuckDB character class.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back, which also cuts the lineage."""
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Size of the bitmap below, which bounds its broadcast to ``BITMAP / 64`` rows.
BITMAP = 1 << 24


def likely(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """``rows`` with ``likely``: whether their key may be in ``wanted``; it is never false for a key that is.

    A bitmap of fixed size goes to every task ahead of the join that decides, and spares the shuffle most rows without
    a partner. It lets more rows pass as ``wanted`` grows.
    """
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(BITMAP))
    bits = wanted.select(at(wanted_key).alias("at")).groupBy((F.col("at") / 64).cast("long").alias("bitmap_word")).agg(
        F.expr("bit_or(shiftleft(1L, int(at % 64)))").alias("bitmap_bits")
    )
    bitmap = F.broadcast(stage(bits, "bitmap"))
    found = rows.withColumn("bitmap_at", at(key)).withColumn("bitmap_word", (F.col("bitmap_at") / 64).cast("long")).join(bitmap, "bitmap_word", "left")
    return found.select(*rows.columns, F.expr("coalesce(getbit(bitmap_bits, int(bitmap_at % 64)), 0) = 1").alias("likely"))


def likely_members(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """The ``rows`` that :func:`likely` does not rule out."""
    return likely(rows, key, wanted, wanted_key).where("likely").drop("likely")


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of the undirected ``edges(a, b)``; the component is its smallest node.

    Alternates two star operations until every node has one root: each node hands its larger neighbours, then its
    smaller ones, the smallest node it knows. Every round is written to the shared folder, halves the remaining path lengths
    at least, and its minima combine before the shuffle; only one total per round reaches the driver.
    """
    def neighbours(links: DataFrame) -> DataFrame:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
        return both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def with_least(links: DataFrame) -> DataFrame:
        least = links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return links.join(least, "u")

    def unsettled(links: DataFrame) -> int:
        """Nodes with more than one root; a root is its own."""
        rooted = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), "b"))
        return rooted.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high")).where("low <> high").count()

    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = stage(links.distinct(), "links")
    while unsettled(links):
        large = with_least(neighbours(links)).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        small = with_least(down)
        small = small.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(small.select(F.col("u").alias("a"), F.col("m").alias("b")))
        links = stage(small.where("a <> b").distinct(), "links")
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
