"""Connected components of a link table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large(links: DataFrame) -> DataFrame:
    """Every node ties its larger neighbours to its least neighbour (or to itself)."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    return both.join(least, both["a"] == least["n"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(links: DataFrame) -> DataFrame:
    """Every node ties itself and its smaller neighbours to the least of them; links run from larger to smaller."""
    least = links.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
    moved = links.join(least, links["a"] == least["n"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); component is the least node that can be reached.

    Links are longs without nulls; loops and repeats do no harm, an empty table gives an empty result. Minima
    are combined before the shuffle, so a node with very many links costs each task one row there. The number of
    rounds grows with the logarithm of the number of links. Each half round is a written table. It ends when every
    link leads to a node that has no smaller one.
    """
    links = written(links.select("a", "b").where("a <> b").distinct(), "links")
    while True:
        links = written(_small(written(_large(links), "star-large")), "star-small")
        inner = links.select(F.col("b").alias("x")).join(links.select(F.col("a").alias("y")), F.col("x") == F.col("y"), "left_semi")
        if inner.isEmpty():
            break
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
