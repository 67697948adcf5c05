"""Places in an order, running sums and exact quantiles of tables of any size: no task sorts more than a part of them.

Rows or distinct values are dealt to consecutive ranges, ranges are counted, and the counts of the ranges before give
each range its start. Only the table of ranges, whose size is a parameter, is ever summed in one task.
"""

from __future__ import annotations

import math
from itertools import cycle

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.numeric import finite

#: Ranges of a running sum; values sampled for each bound; ranges of a hash (four hex digits); bins of a narrowing round.
RANGES, PER_BOUND, DIGITS, BINS = 512, 8, 4, 512


def range_of(value: Column, bounds: Column, most: int) -> Column:
    """How many of the sorted ``bounds`` (an array of at most ``most``) are at or below ``value``, by binary search."""
    steps = [1 << k for k in reversed(range(max(1, most).bit_length()))]
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when(F.get(bounds, at + s - 1) <= value, at + s).otherwise(at))


def bounds_of(values: DataFrame, column: str, ranges: int = RANGES) -> DataFrame:
    """One row, ``_bounds``: at most ``ranges`` - 1 sorted values that cut the distinct ``values`` into like parts.

    They come from the first ``ranges * PER_BOUND`` values by hash. Any bounds give right results; these keep ranges even.
    """
    some = values.select(F.col(column).alias("_v")).where("_v is not null").orderBy(F.xxhash64("_v"), "_v").limit(ranges * PER_BOUND)
    every = F.array_sort(F.array_distinct(F.collect_list("_v")))
    return some.agg(F.filter(every, lambda _, i: i % PER_BOUND == PER_BOUND - 1).alias("_bounds"))


def cumulated(values: DataFrame, column: str, sums: list[str], ranges: int = RANGES) -> DataFrame:
    """``values`` (a row per distinct, non-null ``column`` of any type with an order) with ``<c>_before`` and ``<c>_all``
    for each of ``sums``: the sum over all smaller values, and over all."""
    cut = values.withColumn("_bounds", bounds_of(values, column, ranges).scalar())
    dealt = cut.withColumn("_range", range_of(F.col(column), F.col("_bounds"), ranges)).drop("_bounds")
    table = dealt.groupBy("_range").agg(*[F.sum(c).alias(f"_s_{c}") for c in sums])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # at most ``ranges`` rows
    starts = table.select("_range", *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in sums], *[F.sum(f"_s_{c}").over(every).alias(f"{c}_all") for c in sums])
    inside = Window.partitionBy("_range").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(starts), "_range")
    return out.withColumns({f"{c}_before": F.col(f"_b_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums}).drop("_range", *[f"_b_{c}" for c in sums])


def places_by_hash(df: DataFrame, key: str, within: str, seed: int, name: str = "place", digits: int = DIGITS) -> DataFrame:
    """``df`` with the place from 0 of each row among those of its ``within``, in the order of a seeded hash of ``key``.

    Ranges are the first ``digits`` hex digits of the hash, so they are even and known beforehand; a task sorts one
    range of one class. NULL is a class of its own.
    """
    hashed = df.withColumn("_hash", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))).withColumn("_range", F.coalesce(F.substring("_hash", 1, digits), F.lit("")))
    # ranges by classes: 16 ** digits rows a class
    table = hashed.groupBy(within, "_range").agg(F.count("*").alias("_n"))
    start = F.coalesce(F.sum("_n").over(Window.partitionBy(within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = table.select(F.col(within).alias("_within"), F.col("_range").alias("_of"), start.alias("_start"))
    inside = Window.partitionBy(within, "_range").orderBy("_hash", key)
    ranked = hashed.withColumn("_inside", F.row_number().over(inside) - 1)
    out = ranked.join(starts, F.col(within).eqNullSafe(F.col("_within")) & (F.col("_range") == F.col("_of")))
    return out.withColumn(name, F.col("_start") + F.col("_inside")).select(*df.columns, name)


def order_statistics(df: DataFrame, wanted: dict[str, list[int]], spans: dict[str, tuple[float, float]], bins: int = BINS) -> dict[tuple[str, int], float]:
    """The value at each wanted place (from 0) of each numeric column, exactly; ``spans``: least and greatest value.

    Each round counts, for all columns at once, the rows of every bin of every range still open, and goes on with the
    bin that holds the place, from its least to its greatest value. Rows outside the open ranges fall out before they
    are grouped. A range of one value is done; each round at least splits its least from its greatest value.
    """
    found: dict[tuple[str, int], float] = {}
    # (column, low, high): places in the range, counted from its start, with their names
    todo = {(c, *spans[c]): [((c, p), p) for p in sorted(set(places))] for c, places in wanted.items() if places}
    # bins are even by turns in the logarithm of the size, for values of very different sizes, and in the value
    scales = cycle([(lambda v: F.signum(v) * F.log1p(F.abs(v)), lambda x: math.copysign(math.log1p(abs(x)), x)), (lambda v: v / 2, lambda x: x / 2)])
    while todo:
        for at in [r for r in todo if r[1] == r[2]]:
            found |= {name: at[1] for name, _ in todo.pop(at)}
        if not todo:
            break
        open_ranges, (column, number) = list(todo), next(scales)
        marks = []
        for k, (c, low, high) in enumerate(open_ranges):
            v = finite(F.col(c).cast("double"))
            start, width = number(low), number(high) - number(low)
            share = (column(v) - start) / width if width > 0 else (v > low).cast("double")
            marks.append(F.when((v >= low) & (v <= high), F.struct(F.lit(k).alias("k"), F.greatest(F.least(F.floor(share * bins), F.lit(bins - 1)), F.lit(0)).cast("int").alias("bin"), v.alias("v"))))
        rows = df.select(F.explode(F.array_compact(F.array(*marks))).alias("m")).select("m.*")
        # at most ``bins`` rows a range
        counts = rows.groupBy("k", "bin").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        last, todo = todo, {}
        for k, key in enumerate(open_ranges):
            before = 0
            for row in sorted((r for r in counts if r.k == k), key=lambda r: r.bin):
                inside = [(name, p - before) for name, p in last[key] if before <= p < before + row.n]
                if inside:
                    todo.setdefault((key[0], row.low, row.high), []).extend(inside)
                before += row.n
    return found


def quantiles(df: DataFrame, columns: list[str], shares: list[float], bins: int = BINS) -> dict[str, dict]:
    """Per column: n, mean, deviation, low, high and ``quantiles`` (linear between neighbours), NULL without values.

    Missing, NaN and infinite values don't count. Two passes at least; each further one sees only open ranges' rows.
    """
    if not columns:
        return {}
    x = {c: finite(F.col(c).cast("double")) for c in columns}
    row = df.agg(*[f(x[c]).alias(f"{k}{n}") for k, c in enumerate(columns) for n, f in (("n", F.count), ("m", F.avg), ("d", F.stddev_samp), ("l", F.min), ("h", F.max))]).first()
    out = {c: {"n": row[f"{k}n"], "mean": row[f"{k}m"], "deviation": row[f"{k}d"], "low": row[f"{k}l"], "high": row[f"{k}h"], "quantiles": [None] * len(shares)} for k, c in enumerate(columns)}
    at = {c: [(o["n"] - 1) * q for q in shares] for c, o in out.items() if o["n"]}
    places = {c: [p for h in hs for p in (math.floor(h), math.ceil(h))] for c, hs in at.items()}
    got = order_statistics(df, places, {c: (out[c]["low"], out[c]["high"]) for c in at}, bins)
    for c, hs in at.items():
        below, above = ([got[(c, f(h))] for h in hs] for f in (math.floor, math.ceil))
        out[c]["quantiles"] = [a + (b - a) * (h - math.floor(h)) if a != b else a for a, b, h in zip(below, above, hs, strict=True)]
    return out


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row per column: n, mean, deviation, low, q1, q2, q3, high."""
    rows = [(c, o["n"], o["mean"], o["deviation"], o["low"], *o["quantiles"], o["high"]) for c, o in quantiles(df, columns, [0.25, 0.5, 0.75]).items()]
    return df.sparkSession.createDataFrame(rows, "column string, n long, mean double, deviation double, low double, q1 double, q2 double, q3 double, high double")
