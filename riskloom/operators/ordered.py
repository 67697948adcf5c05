"""Aggregates that depend on an order, as windows: streaks, episodes, slopes, top-n, trailing windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def streaks(df: DataFrame, keys: list[str], order: list[str], flag: str, longest: str, episodes: str) -> DataFrame:
    """Per key the longest run of 1s of ``flag`` (0 if none) and the number of runs, in ``order``. NULL counts as 0."""
    by = Window.partitionBy(*keys).orderBy(*order)
    on = F.coalesce(F.col(flag).cast("int"), F.lit(0))
    marked = df.select(*keys, *[c for c in order if c not in keys], on.alias("_on"))
    marked = marked.withColumn("_island", F.sum(1 - F.col("_on")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    # a run is the 1s of an island; the 0 that opens the island adds nothing
    runs = marked.groupBy(*keys, "_island").agg(F.sum("_on").alias("_run"))
    return runs.groupBy(*keys).agg(F.max("_run").cast("int").alias(longest), F.sum(F.when(F.col("_run") > 0, 1).otherwise(0)).cast("int").alias(episodes))


def newest(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "_rank") -> DataFrame:
    """The first ``n`` rows of each key in ``order``, with their rank from 1."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def slopes(df: DataFrame, keys: list[str], order: list[Column], values: dict[str, str]) -> DataFrame:
    """Per key the least-squares slope of each value over its observed rows, oldest first at places 0, 1, ...

    Places close up over missing values; fewer than two give NULL.
    """
    by = Window.partitionBy(*keys).orderBy(*order)
    placed = df
    for k, column in enumerate(values):
        seen = F.sum(F.when(F.col(column).isNotNull(), 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0))
        placed = placed.withColumn(f"_place{k}", F.when(F.col(column).isNotNull(), seen - 1).cast("double"))
    made = [F.when(F.count(c) > 1, F.regr_slope(F.col(c).cast("double"), F.col(f"_place{k}"))).alias(name) for k, (c, name) in enumerate(values.items())]
    return placed.groupBy(*keys).agg(*made)
