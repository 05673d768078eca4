"""Connected components of a table of links, by alternating large and small stars (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import durable, forget


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1] or 0


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    moved = edges.withColumnRenamed("a", "u").join(least, "u").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links(a, b)`` but the roots themselves; a root is its component's least node.

    Each round is two joins of the links with one row per node (minimums, summed before the shuffle), so no task holds
    the links of a node; a node with many links is a skewed join that Spark splits. Rounds end when the links no
    longer change, after a logarithmic number of them; each is written to the shared folder.
    Null ends and loops are ignored; an empty table gives an empty one.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    edges = durable(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(a.alias("a"), b.alias("b")).distinct())
    mark = _mark(edges)
    while mark[0]:
        done = durable(_small(_large(edges)))
        forget(edges)
        edges, before, mark = done, mark, _mark(done)
        if mark == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
