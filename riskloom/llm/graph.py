"""Connected components of an edge table by alternating star contractions (large star, small star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import shuffles_freed, stage


def _each(pairs: DataFrame, *two: tuple[str, str]) -> DataFrame:
    """For each row of ``pairs`` a row (u, v) for each of ``two``, made in one pass."""
    made = pairs.select(F.explode(F.array(*[F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in two])).alias("e"))
    return made.select("e.u", "e.v")


def _starred(pairs: DataFrame) -> DataFrame:
    """``pairs`` (u, v) with m: the least of u and all its v. Partial sums meet hot nodes before the shuffle."""
    least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return pairs.join(least, "u")


def _are_stars(pairs: DataFrame) -> bool:
    """Whether of ``pairs`` (u > v, distinct) each u has one v, and no v is a u."""
    ends = pairs.select(F.explode(F.array(*[F.struct(F.col(c).alias("node"), F.lit(up).alias("up")) for c, up in (("u", 1), ("v", 0))])).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.count("*").alias("n"))
    with shuffles_freed(pairs.sparkSession):
        return nodes.where("up > 1 OR up BETWEEN 1 AND n - 1").agg(F.count("*")).first()[0] == 0


def stars(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) to (node, root): for each node but the roots the least node reachable.

    Null ends and loops are ignored; repeated edges count once; no edges give no rows. What is staged between rounds
    is at most twice the edges; edges that are stars already, such as these rows, take no round.
    """
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    while not _are_stars(now):
        large = _starred(_each(now, ("u", "v"), ("v", "u"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _each(_starred(large), ("v", "m"), ("u", "m"))
        now = stage(small.where("u <> v").distinct(), "stars")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def components(edges: DataFrame) -> DataFrame:
    """As stars(), with the roots' own rows (root, root)."""
    found = stars(edges)
    return found.union(found.select(F.col("root"), F.col("root")).distinct())
